"""Near duplicates at the edge of the similarity bound, in short texts and in crowded buckets."""

import random
from collections import Counter

import numpy as np

from chronospan.llm import neardup
from tests.llm.test_results import edits


def changed(rng, words, n):
    """words with n edits at random places: substitutions, and some insertions and deletions."""
    out = list(words)
    for _ in range(n):
        kind, at = rng.random(), rng.randrange(len(out))
        if kind < 0.7:
            out[at] = f"x{rng.randrange(10**9)}"
        elif kind < 0.85:
            del out[at]
        else:
            out.insert(at, f"y{rng.randrange(10**9)}")
    return out


def found_classes(spark, texts, **options):
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in neardup.classes(frame, **options).collect()}


def brute(texts, similarity=0.8):
    parent = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            most = neardup.most_edits(max(len(a), len(texts[j])), similarity)
            if parent[i] != parent[j] and sum((Counter(a) & Counter(texts[j])).values()) >= max(len(a), len(texts[j])) - most and edits(a, texts[j]) <= most:
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    return dict(enumerate(parent))


def test_recall_of_scattered_edits_at_the_bound(spark):
    rng = random.Random(11)
    texts, level = [], []
    for similarity in (0.8, 0.85, 0.9, 0.95):
        for length in (30, 60, 150, 400):
            for _ in range(50):
                base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
                copy = list(base)
                for at in rng.sample(range(length), int((1 - similarity) * length + 1e-9)):
                    copy[at] = f"x{rng.randrange(10**9)}"
                texts += [base, copy]
                level.append(similarity)
    found = found_classes(spark, texts)
    caught = Counter(s for i, s in enumerate(level) if found[2 * i + 1] == 2 * i)
    assert all(n in (i, i // 2 * 2) for i, n in found.items())
    print({s: caught[s] / 200 for s in sorted(caught)})
    assert caught[0.8] >= 190 and caught[0.85] >= 196 and caught[0.9] >= 199 and caught[0.95] == 200


def test_short_texts_match_brute_force(spark):
    rng = random.Random(12)
    texts = []
    for length in range(5, 21):
        for _ in range(12):
            base = [f"w{rng.randrange(300)}" for _ in range(length)]
            texts += [base] + [changed(rng, base, rng.randint(0, length // 5 + 1)) for _ in range(2)]
    assert found_classes(spark, texts) == brute(texts)


def test_no_met_pair_is_lost_in_crowded_buckets(spark):
    rng = random.Random(13)
    passage = [f"p{i}" for i in range(60)]  # the samples of all texts are mostly from here
    texts = []
    for _ in range(30):  # chains: near ends are within the bound, the smallest id of a class is not near to all of its class
        chain = passage + [f"o{rng.randrange(10**9)}" for _ in range(40)]
        texts.append(chain)
        for _ in range(3):
            chain = changed(rng, chain[:60], 0) + changed(rng, chain[60:], 12)
            texts.append(chain)
    rng.shuffle(texts)
    want = brute(texts)
    assert found_classes(spark, texts) == want
    assert found_classes(spark, texts, crowd=3, block=16) == want


def test_bound_of_word_runs_loses_no_link():
    rng = random.Random(14)
    for _ in range(300):
        a = [rng.randrange(40) for _ in range(rng.randint(60, 160))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 4)):
            b[rng.randrange(len(b))] = rng.randrange(40)
        b = b[rng.randrange(4) :] + [rng.randrange(40) for _ in range(rng.randrange(4))]
        most = neardup.most_edits(max(len(a), len(b)), 0.8)
        assert neardup.similar(np.array(a, np.uint32), np.array(b, np.uint32), 0.8) == (edits(a, b) <= most)

"""Results of the corpus operators against brute force, exact round trips, held-out accuracy or SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chronospan.llm import langid, mixing, neardup, packing, queries, secrets, sharding, tokens, topk
from tests.compare import HERE, spark_rows, sql_rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{HERE}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, HERE)) == sql_rows(queries.ORACLE_SQL[name])


def plain_spans(text):
    out = []
    rules = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    ]
    for nr, (kind, pattern, flags, good) in enumerate(rules):
        out += [(m.start(), nr, kind, m.end()) for m in re.finditer(pattern, text, flags) if good(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def test_secret_base_spans(spark, texts):
    for r in queries.op1_secret_scan(spark, HERE).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_random_strings_found_and_words_left(spark):
    rng = random.Random(5)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, "the key is " + "".join(rng.choice(b64) for _ in range(40)) + "1 here") for i in range(200)]
    rows += [(i, f"see internationalization_of_long_identifiers_{i} and photo-album-summer-holiday-{i} again") for i in range(200, 400)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = {r["doc_id"] for r in found if "random" in r["spans"]}
    assert len([i for i in hit if i < 200]) > 150
    assert not [i for i in hit if i >= 200]


def test_redaction_masks_whole_findings(spark):
    text = "a password = hunter2hunter2 b"
    out = secrets.redact(spark.createDataFrame([(1, text, None)], "doc_id long, text string, spans string")).first()
    assert out["text"] == "a [secret] b"


def test_language_accuracy_on_held_out_documents(spark, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op2_language_id(spark, HERE).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    judged = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in judged)
    assert right >= 0.85 * len(judged)


def test_forward_backward_matches_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], np.zeros(0, np.uint64))
    model.trans[:] = rng.normal(size=(3, 3))
    model.first[:] = rng.normal(size=3)
    w = langid.Words(["one two three four", "five six"])
    score = rng.normal(size=(6, 3)).astype(np.float32)
    node, _ = langid.marginals(model, w, score)
    at = 0
    for n in (4, 2):
        total, want = 0.0, np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            s = model.first[path[0]] + sum(score[at + i, y] for i, y in enumerate(path)) + sum(model.trans[a, b] for a, b in zip(path, path[1:]))
            total += np.exp(s)
            for i, y in enumerate(path):
                want[i, y] += np.exp(s)
        assert np.allclose(node[at : at + n], want / total, atol=1e-5)
        at += n


def test_packing_is_whole_and_tight(spark, docs):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op3_best_fit_packing(spark, HERE).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        mine = sorted(by_doc.pop(r["doc_id"]), key=lambda x: x["piece"])
        assert [x["piece"] for x in mine] == list(range(len(mine)))
        at = 0
        for x in mine:
            assert x["start"] == at and (x["length"] == 2048 or x["piece"] == 0)
            at += x["length"]
            assert x["ids_crc32"] == zlib.crc32(np.array(ids[x["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    assert not by_doc
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_bin) <= -(-total // 2048) + 2


def test_fullest_combination_matches_enumeration():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        slack = rng.randint(0, 30)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.fullest(slack, counts)
        assert all(n <= counts[x] for x, n in chosen.items())
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= slack)


def test_token_counts_match_the_library(spark, texts):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for r in queries.op7_token_counts(spark, HERE).collect():
        text = texts[r["doc_id"]]
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_long_texts_are_cut_at_safe_boundaries(spark):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(2)
    parts = ["word", "  ", " ", "\n", "don't", "123", "über", " \n ", "\U0001f600", "x" * 50, "<|endoftext|>", "\t"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(3000))) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(frame, queries.tokenizer_path(), segment=64).collect()} == {i: len(x) for i, x in want.items()}
    memo = tokens.TextIds(queries.tokenizer_path())
    for (i, _), ids in zip(rows, memo(pa.array([t for _, t in rows], pa.string())), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want[i]


def plain_slots(blocks, weights):
    """(source, block) of every slot: earliest deadline among the blocks whose release has come, slot by slot; a new phase where a source is
    due that has run out."""
    from fractions import Fraction

    done, out, first = dict.fromkeys(blocks, 0), [], 0
    while any(done[s] < n for s, n in blocks.items()):
        live = {s: Fraction(weights[s]) for s, n in blocks.items() if done[s] < n}
        total, ran = sum(live.values()), dict.fromkeys(live, 0)
        while True:
            t = len(out) - first
            due = []
            for s, w in live.items():
                share, j = w / total, ran[s]
                if int(Fraction(j) / share) <= t:
                    due.append((-int(-Fraction(j + 1) // share), int(Fraction(j) / share), s))
            s = min(due)[2]
            if done[s] == blocks[s]:
                break
            out.append((s, done[s]))
            done[s], ran[s] = done[s] + 1, ran[s] + 1
        first = len(out)
    return out


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 10, "c": 7}, {"a": 0.3, "b": 0.31, "c": 0.1}])
def test_slots_are_those_of_plain_earliest_deadline_first(spark, weights):
    sizes = {"a": 33, "b": 47, "c": 21}
    rows = [(n, s) for n, s in enumerate(x for s, k in sizes.items() for x in [s] * k)]
    found = mixing.plan(spark.createDataFrame(rows, "doc_id long, source string").repartition(3), weights=weights, block_rows=2).collect()
    slots = {}
    for r in found:
        slots.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    wanted = plain_slots({s: -(-k // 2) for s, k in sizes.items()}, weights)
    assert [slots[t] for t in range(len(wanted))] == [{x} for x in wanted] and len(slots) == len(wanted)
    total, done = sum(weights.values()), Counter()
    for t, (s, _) in enumerate(wanted[:20]):  # all sources have blocks left here
        done[s] += 1
        assert all(abs(done[x] - weights[x] / total * (t + 1)) < 1 for x in weights)


def test_mixing_keeps_every_row_once(spark, docs):
    rows = queries.op5_pfair_mixing(spark, HERE).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    slots = defaultdict(set)
    for r in rows:
        slots[r["slot"]].add((r["source"], r["block"]))
        assert r["release"] <= r["slot"] < r["deadline"]
    assert all(len(x) == 1 for x in slots.values())
    assert sorted(slots) == list(range(len(slots)))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance_matches_the_full_table():
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        most, want = rng.randint(0, 12), edits(a, b)
        assert neardup.banded_distance(a, b, most) == (want if want <= most else None)


def test_near_duplicate_classes_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, nr = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 3])):
                copy[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((nr, " ".join(copy)))
            nr += 1
    parent = list(range(nr))
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if edits(a.split(), rows[j][1].split()) <= 0.2 * 120:
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == dict(enumerate(parent))


def test_crowded_buckets_are_compared_to_the_end(spark):
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(60)]  # a passage that dominates the samples of many different texts
    rows = []
    for i in range(40):
        own = [f"o{i}_{rng.randrange(10**6)}" for _ in range(12)]
        rows.append((2 * i, " ".join(shared + own)))
        rows.append((2 * i + 1, " ".join(shared[:-1] + own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.classes(frame, similarity=0.9, crowd=3).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {i: i // 2 * 2 for i in range(80)}


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(400, 8)) * rng.uniform(0.1, 3, size=(400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(500, None), (600, [float("nan")] * 8), (700, [None] * 8), (800, [float("inf")] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    out = topk.top_k(frame, lambda i: F.pmod(i, F.lit(100)) == 0, rows_per_bucket=32, block_bytes=200).collect()
    q = np.floor(1024 * data).astype(np.int64)
    want = set()
    for i in range(0, 400, 100):
        score = q @ q[i]
        order = [j for j in np.lexsort((np.arange(400), -score)) if j != i][:10]
        want |= {(i, r + 1, int(j), int(score[j])) for r, j in enumerate(order)}
    assert {tuple(r) for r in out} == want


def test_shards_are_exact_and_gapless(spark, texts):
    rows = queries.op9_sharding(spark, HERE).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_hypergeometric_law():
    rng = random.Random(0)
    seen = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20000))
    from math import comb

    for k in range(5):
        assert abs(seen[k] / 20000 - comb(5, k) * comb(7, 4 - k) / comb(12, 4)) < 0.015
    for most in (1000, 20, 7):
        matrix = list(sharding.communication_matrix([10, 0, 25], [12, 12, 11], 1, most))
        assert [sum(r) for r in matrix] == [10, 0, 25] and [sum(c) for c in zip(*matrix)] == [12, 12, 11]
    first = Counter(next(iter(sharding.communication_matrix([4, 8], [5, 7], seed)))[0] for seed in range(8000))
    for k in range(5):
        assert abs(first[k] / 8000 - comb(5, k) * comb(7, 4 - k) / comb(12, 4)) < 0.03


def test_quality_base_counts(spark, texts):
    for r in queries.op10_quality_rules(spark, HERE).collect():
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        trios = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if trios[t] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])

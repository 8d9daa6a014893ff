"""Tokenizer alignment, delta Lloyd and suffix decontamination against plain versions."""

import hashlib
import math
import re
from collections import Counter

import pytest

from chronospan.llm import align, lloyd, queries, suffixes
from chronospan.llm.common import documents

from ..compare import HERE

ODD = ["", None, " ", "a", "  two  spaces ", "tab\tand\nline\n\n end", "▁sign", "x▁y z", "<|endoftext|> inside <s> </s> <0x41>", "naïve café – ü 漢字 🙂🙂", " nbsp　wide", "a b", "a b", "don't we'll  I'm", "x" * 300, "0 00 000 0000", " lead", "trail ", "\x00null", "é" * 40]


def plain_alignment(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, hash of each text, token by token with the libraries alone."""
    import json

    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    vocab = {i: e for e, i in json.load(open(P.path("byte_bpe_50k.json")))["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    out, links = [], []
    for text in texts:
        out.append([0, 0, 0, 0, 0, 0, ""])
        links.append([])
        if not text:
            continue
        a = t.encode(" " + text, add_special_tokens=False).ids
        b = m.encode(text)
        wa = [bytes(byte[c] for c in vocab[i]) for i in a]
        pieces = [m.id_to_piece(i) for i in b]
        wb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
        if b"".join(wa) != (" " + text).encode() or b"".join(wb) != (" " + text).encode():
            continue
        spans = []
        for words in (wa, wb):
            at = 0
            spans.append([])
            for w in words:
                spans[-1].append((at, at + len(w)))
                at += len(w)
        both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        sides = []
        for ids, ends in ((a, spans[0]), (b, spans[1])):
            sides.append([[]])
            for i, (_, e) in zip(ids, ends, strict=True):
                sides[-1][-1].append(i)
                if e in both:
                    sides[-1].append([])
        groups = list(zip(sides[0][:-1], sides[1][:-1], strict=True))
        j = 0
        for i, (x, y) in enumerate(spans[0]):
            while j and spans[1][j - 1][1] > x:
                j -= 1
            while j < len(b) and spans[1][j][0] < y:
                if spans[1][j][1] > x:
                    links[-1].append((a[i], b[j]))
                j += 1
        text_of = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out[-1] = [len(a), len(b), len(groups), len(links[-1]), 0, 0, hashlib.sha256(text_of.encode()).hexdigest()]
    counts = Counter(p for own in links for p in set(own))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    for o, own in zip(out, links, strict=True):
        o[4] = sum(counts[p] == best[p[0]] for p in own)
        o[5] = sum(counts[p] for p in own)
    return [tuple(o) for o in out]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def paths():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def test_alignment_is_the_plain_one(spark):
    rows = documents(spark, HERE).select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_event_sweep(spark, HERE).collect()}
    assert found == dict(zip([r["doc_id"] for r in rows], plain_alignment([r["text"] for r in rows]), strict=True))


@pytest.mark.parametrize("most_hot", [1 << 20, 40, 0])
def test_alignment_of_odd_texts(spark, most_hot):
    long = " ".join(f"word{i % 700} und-{i % 13}" for i in range(9000))
    texts = [*ODD, long, "the end of the end", None]
    docs = spark.createDataFrame([(i if i % 5 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, at string")
    found = align.align(docs, *paths(), most_hot=most_hot).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in found) == sorted(plain_alignment(texts))


def test_alignment_in_small_blocks(spark, monkeypatch):
    """Groups, counts and hashes do not depend on how a document's tokens are cut into blocks and drains."""
    monkeypatch.setattr(align, "BLOCK", 7)
    texts = [ODD[9] * 20, "one two  three", "the end of the end " * 30]
    lengths = [[len(x) for x in t.to_pylist()] for t in align._sides(*paths())[2:]]
    import numpy as np
    import pyarrow as pa

    sweep, done = align.Sweep([np.array(x) for x in lengths]), []
    for row, pair in enumerate(align.token_ids(pa.array(texts), *align._sides(*paths()))):
        blocks = []
        for side, ids in enumerate(pair):
            at = np.r_[0, np.cumsum(np.array(lengths[side])[ids])]
            blocks += [(int(at[k]), side, ids[k : k + 7]) for k in range(0, len(ids), 7)]
        for at, side, ids in sorted(blocks, key=lambda b: b[:2]):
            sweep.feed(row, row, at, side, ids)
            done += sweep.drain(False)
    done += sweep.drain(True)
    wanted = plain_alignment(texts)
    assert [(*d["n"].tolist(), d["sha"].hexdigest()) for d in done] == [(*w[:4], w[6]) for w in wanted]


def test_alignment_of_nothing(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), *paths()).collect() == []


def plain_lloyd(rows, k, rounds, scale, dim):
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for step in range(rounds + 1):
        own = [min((away(v, c), n) for n, c in enumerate(cents)) for _, v in kept]
        if step < rounds:
            for n in range(len(cents)):
                mine = [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == n]
                if mine:
                    cents[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    per = Counter()
    for d, n in own:
        per[n] += d
    most, every = 2**63 - 1, sum(per.values())
    sha = lambda n: hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()
    return sorted(((i, n, min(d, most), min(per[n], most), min(every, most), sha(n)) for (i, _), (d, n) in zip(kept, own, strict=True)), key=repr)


@pytest.mark.parametrize("kind", ["plain", "large", "ties", "few"])
def test_lloyd_is_the_plain_one(spark, kind):
    import random

    r = random.Random(5)
    scale = {"plain": 1.0, "large": 1e30, "ties": 1.0, "few": 1.0}[kind]
    rows = [(i, [scale * r.choice([0.0, 1.0]) if kind == "ties" else scale * r.uniform(-2, 2) for _ in range(8)]) for i in range(2 if kind == "few" else 300)]
    rows += [(None, rows[0][1]), (1, rows[1][1]), (1, rows[0][1]), (7, None), (8, [1.0] * 7), (9, [None] + [1.0] * 7), (10, [float("nan")] + [1.0] * 7), (11, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, cluster int").repartition(3)
    found = lloyd.cluster(df, k=5, rounds=3, dim=8, block=16).collect()
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted((tuple(f[c] for c in columns) for f in found), key=repr) == plain_lloyd(rows, 5, 3, 64, 8)


def test_lloyd_of_nothing(spark):
    found = lloyd.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def in_words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_contamination(docs, items, width):
    windows = []
    for i, text in items:
        w = in_words(text)
        n = min(width, len(w))
        windows += [(i, tuple(w[a : a + n])) for a in range(len(w) - n + 1)] if w else []
    out = []
    for i, text in docs:
        w, hit, found = in_words(text), set(), set()
        for item, win in windows:
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(str(f) for f in found if f is not None)))
    return out


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 1 << 20), (40, 1 << 20), (1, 60)])
def test_contamination_is_the_plain_one(spark, shard, block):
    items = [(1, "One two three four five"), (2, "three FOUR"), (3, "a a a"), (4, ""), (5, None), (None, "nine ten"), (10, "Äther über, straße"), (2, "three four"), (6, "x1 y2 z3 x1 y2 z3 x1"), (7, "!!"), (8, "one two three four five")]
    long = "lorem ipsum " * 30 + "one two three, four five six " + "dolor sit " * 40 + "nine ten " + "a " * 9 + "end"
    texts = ["one two three four five six", "Two THREE\nfour five", "a a a a", "a a", "x one.two-three", "", None, "äther über straße", "Äther über straße", long, long, "x1 y2 z3 x1 y2 z3 x1 y2 z3 x1", "onetwothree", "three four", "ten nine ten", "!?", "four\x7ffive", "three four" * 3]
    docs = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, id string, spans int").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = suffixes.contamination(df, bench, width=3, shard_bytes=shard, block_bytes=block).collect()
    found = [(r["doc_id"], r["n_words"], sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True)), list(r["items"])) for r in got]
    assert sorted(found, key=repr) == sorted(plain_contamination(docs, items, 3), key=repr)
    left = suffixes.remove(df, bench, width=3, shard_bytes=shard, block_bytes=block)
    assert left.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.filter("doc_id is not null").collect() if r["text"]) == sorted((i, t) for (i, t), (_, _, n, _) in zip(docs, plain_contamination(docs, items, 3), strict=True) if n == 0 and t and i is not None)


def test_contamination_of_nothing(spark):
    empty, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert suffixes.contamination(empty, bench).collect() == []
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert [tuple(r) for r in suffixes.digest(suffixes.contamination(one, bench)).collect()] == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


@pytest.mark.parametrize("shard", [1 << 20, 50])
def test_longest_matches_are_the_plain_ones(spark, shard):
    items = [(1, "a b c d e f g h"), (2, "x y a b"), (3, "none of these")]
    docs = [(1, "q a b c d r"), (2, "z z c d e f g z " + "w " * 60 + "x y a q"), (3, "a b c d"), (4, None)]
    got = suffixes.longest_matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"), least=2, shard_bytes=shard)
    found = sorted((int(r["item_id"]), r["start"], r["n_words"], r["doc_id"], r["at"]) for r in got.collect())
    assert found == [(1, 0, 4, 1, 1), (1, 2, 5, 2, 2), (2, 0, 3, 2, 68), (2, 2, 2, 1, 1)]


def test_suffix_array_is_sorted():
    import numpy as np

    r = np.random.default_rng(3)
    for n, kinds in ((1, 1), (50, 2), (300, 3), (300, 1)):
        rank, ends = r.integers(1, kinds + 1, n), np.sort(r.choice(n, max(1, n // 40), replace=False))
        ends = np.unique(np.r_[ends, n - 1])
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
        suffix = [tuple(rank[i : i + left[i]]) for i in range(n)]
        assert suffixes.suffix_array(rank.astype(np.int64), left).tolist() == sorted(range(n), key=lambda i: (suffix[i], i))


def test_decontamination_of_planted_passages(spark):
    """Documents that hold a benchmark passage are found, and none without a window of it."""
    found = queries.op13_suffix_decontamination(spark, HERE).filter("contaminated").select("doc_id").collect()
    docs, items = documents(spark, HERE).select("doc_id", "text").collect(), spark.read.parquet(f"{HERE}/benchmark.parquet").select("item_id", "text").collect()
    grams = {tuple(w[a : a + 10]) for r in items for w in [in_words(r["text"])] for a in range(max(1, len(w) - 9))}
    wanted = {r["doc_id"] for r in docs for w in [in_words(r["text"])] if any(tuple(w[a : a + 10]) in grams for a in range(len(w)))}
    assert {r["doc_id"] for r in found} >= wanted and wanted

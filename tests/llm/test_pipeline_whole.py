"""The pipeline from end to end against its operators one by one, and top-k search with ties, repeated rows and clashing columns."""

from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from chronospan.llm import langid, neardup, queries, secrets, topk
from chronospan.llm.common import documents

from ..compare import HERE


def test_run_is_its_stages_together(spark):
    docs = documents(spark, HERE)
    known = langid.confident(docs).cache()
    classes = {r["doc_id"]: r["class_id"] for r in neardup.classes(known).collect()}
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(known).select("doc_id", "text").collect()}
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    wanted = {i: len(tokenizer.encode(masked[i], add_special_tokens=False).ids) + 1 for i, c in classes.items() if i == c}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, HERE).collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sum(n for _, _, n in own) for i, own in pieces.items()} == wanted
    for own in pieces.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert all(a + n == b for (_, a, n), (_, b, _) in zip(own, own[1:], strict=False)) and own[0][1] == 0
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 2048


def test_top_k_with_ties_repeats_and_clashes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)]
    rows += [(7, rows[8][1]), (7, rows[7][1]), (100, rows[3][1]), (None, rows[4][1]), (20, None), (21, []), (200, [1.0, float("nan"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, dim int, ids string, score int").repartition(3)
    found = defaultdict(list)
    for r in topk.top_k(df, lambda i: i % 100 == 0, k=6, scale=4, rows_per_bucket=16).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    kept = [(i, [int(np.floor(4 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(np.isfinite(v))]
    for q in (0, 100, 200):
        own = min(v for i, v in kept if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in kept if i != q and len(v) == len(own))[:6]
        assert sorted(found[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]

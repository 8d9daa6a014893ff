"""Mixed order through packing, labels of code-switched texts, memory with many languages, ids that repeat."""

import random
import tracemalloc

import numpy as np

from chronospan.llm import langid, mixing, neardup, packing, queries


def words_of(rng, syllables, n):
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n)]


def test_switches_inside_a_text_are_found():
    rng = random.Random(3)
    kinds = {"xx": ["ka", "ko", "ki", "tak"], "yy": ["lü", "mä", "schn", "eu"], "zz": ["oui", "que", "éa", "ndr"]}
    texts, langs = zip(*[("\n".join(" ".join(words_of(rng, s, 8)) for _ in range(6)), x) for _ in range(60) for x, s in kinds.items()], strict=True)
    model = langid.train(list(texts), list(langs))
    parts = [words_of(rng, kinds[x], 15) for x in ("xx", "zz", "yy")]
    text = " ".join(w for p in parts for w in p)
    found = langid.predict(model, [text, " ".join(words_of(rng, kinds["yy"], 3000))], runs=True)
    assert [r[2] for r in found[0].runs] == ["xx", "zz", "yy"] and found[0].switches == 2
    assert [abs(r[3] - 15) <= 1 for r in found[0].runs] == [True] * 3
    assert [text[a:b].split()[0] for a, b, _, _ in found[0].runs][0] == parts[0][0]
    assert found[1].lang == "yy" and found[1].score > 0.95


def test_memory_is_linear_in_languages_and_windows_join():
    model = langid.Model([f"l{i:02d}" for i in range(64)], np.zeros(0, np.uint64))
    model.affixes[:] = np.random.default_rng(1).normal(size=model.affixes.shape) * 0.3
    text = "some words that go on " * 4000
    tracemalloc.start()
    found = langid.predict(model, [text], most_chars=20_000)[0]
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert sum(int(x.split(":")[1]) for x in found.counts.split(",")) == 20_000


def test_windows_of_a_text_are_one_chain():
    """Labels and scores do not depend on the size of the windows in which a long text is read."""
    rng = random.Random(9)
    model = langid.Model(["a", "b", "c"], np.zeros(0, np.uint64))
    draw = np.random.default_rng(4)
    model.affixes[:] = draw.normal(size=model.affixes.shape) * 0.4
    model.trans[:] = draw.normal(size=model.trans.shape) + 2 * np.eye(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(700)) + "  !! 12 " * 40 + "ende"
    whole, cut = (langid.predict(model, ["x y", text, "z"], runs=True, most_chars=n) for n in (10**9, 150))
    for a, b in zip(whole, cut, strict=True):
        assert (a.lang, a.counts, a.switches) == (b.lang, b.counts, b.switches) and abs(a.score - b.score) < 1e-9
    assert [w for _, _, x, n in whole[1].runs for w in [x] * n] == [w for _, _, x, n in cut[1].runs for w in [x] * n]


def test_long_chains_are_cut_without_loss():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 9, 40, 2])
    emit, trans, first = rng.random((52, 4)), rng.random((4, 4)), rng.random(4)
    one = [langid._messages(emit, np.cumsum(lengths) - lengths, lengths, trans, first, size=n) for n in (3, 1000)]
    assert np.allclose(*(x / x.sum(axis=1, keepdims=True) for x in one))


def test_sequences_follow_the_mixed_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(str(rng.random()) for _ in range(30)), "a" if i < 3000 else "b") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixing.mixed(frame, weights={"a": 0.5, "b": 0.5}).write.parquet(str(tmp_path / "mixed"))
    packed = packing.pack_in_order(spark.read.parquet(str(tmp_path / "mixed")), queries.tokenizer_path(), window_rows=200).collect()
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == list(range(4000))
    first = [r["doc_id"] for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"]))][:1800]
    assert 0.42 < sum(i >= 3000 for i in first) / len(first) < 0.58  # half b while b lasts, though it is a quarter of all
    fill = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048


def test_repeated_ids_lose_no_text(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    frame = spark.createDataFrame([(1, one), (1, two), (2, two), (2, two)], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in neardup.keep_first(frame).collect())
    assert kept == [(1, one), (1, two)]

"""Adaptive quality thresholds against exact quantiles, and sources that differ."""

import random
from collections import defaultdict

import numpy as np

from chronospan.llm import quality


def corpus(rng):
    """Two sources of one language: tables with many symbols in `wiki`, none in `web`; some junk in each."""
    rows = []
    for i in range(1200):
        source = "wiki" if i % 2 else "web"
        words = ["w" * rng.randint(3, 8) for _ in range(rng.randint(60, 200))]
        marks = rng.randint(20, 40) if source == "wiki" else 0
        if i % 40 in (0, 1):
            marks = 400
        for _ in range(marks):
            words[rng.randrange(len(words))] += "|"
        if i % 60 == 7:
            words = [w * 3 for w in words]
        rows.append((i, " ".join(f"{w}{n}" for n, w in enumerate(words)), "en", source))
    rows += [(5000 + i, "word " * 10, "en", "web") for i in range(5)] + [(6000, " ".join(f"x{i}" for i in range(90)), None, "rare")]
    return rows


def brute(rows, prior=200.0):
    measured = {r[0]: dict(zip(quality.COUNTS, quality.measure(r[1]), strict=True)) for r in rows}
    failed = {i for i, m in measured.items() if m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]}
    values = lambda s, keep: [measured[r[0]][quality.SHARES[s][0]] / max(measured[r[0]][quality.SHARES[s][1]], 1) for r in rows if r[0] not in failed and keep(r)]
    limits = defaultdict(dict)
    for lang, source in {(r[2], r[3]) for r in rows if r[0] not in failed}:
        scopes = [lambda r: (r[2], r[3]) == (lang, source), lambda r: r[2] == lang, lambda r: True]
        for s, sides in quality.RULES.items():
            for side, name in zip(sides, ("high", "low"), strict=True):
                if side:
                    at = None
                    for keep in reversed(scopes):
                        v = values(s, keep)
                        edge, mid = np.quantile(v, [side[0], 0.5], method="inverted_cdf")
                        own = edge + side[1] * (edge - mid)
                        at = own if at is None else len(v) / (len(v) + prior) * own + prior / (len(v) + prior) * at
                    limits[lang, source][s, name] = at
    return measured, failed, limits


def test_verdicts_follow_exact_quantiles(spark):
    rows = corpus(random.Random(8))
    measured, failed, limits = brute(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in quality.judge(frame).collect()}
    assert len(found) == len(rows)
    near = agree = 0
    for i, _, lang, source in rows:
        m = measured[i]
        assert found[i]["base_failed"] == (i in failed)
        if i in failed:
            assert not found[i]["kept"]
            continue
        verdict, close = True, False
        for (s, name), limit in limits[lang, source].items():
            count, size = m[quality.SHARES[s][0]], max(m[quality.SHARES[s][1]], 1)
            value = count / size if s == "word_length" else (count - quality.DEVIATIONS * count**0.5) / size
            verdict &= value <= limit if name == "high" else value >= limit
            close |= value != limit and abs(value - limit) < 0.015 * max(abs(limit), 0.05)  # the sketch's error
        near += close
        agree += found[i]["kept"] == verdict or close
    assert agree == len(rows) - len(failed) and near < 0.1 * len(rows)


def test_two_sources_have_their_own_thresholds(spark):
    rng = random.Random(9)
    rows = corpus(rng)
    marked = " ".join(f"{'w' * rng.randint(3, 8)}{'|' * (n % 4 == 0)}{n}" for n in range(120))
    rows += [(9000, marked, "en", "wiki"), (9001, marked, "en", "web")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in quality.judge(frame, prior=20.0).collect()}
    assert found[9000]["kept"] and found[9001]["failed_rules"] == "symbol_share"

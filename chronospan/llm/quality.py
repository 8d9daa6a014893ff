"""Quality rules whose thresholds adapt to language and source through mergeable quantile sketches (KLL).

Signals per text: share of symbol characters, share of words in repeated 3-word windows, share of repeated lines, mean word length. Each
(language, source) group gets a sketch per signal over its texts that pass the base rules; merged by language and over all, the sketches
give the same quantiles there. A rule's threshold is a high quantile of the signal, for word length a low one as well, widened by a share
of its distance from the median; a share fails only where its count exceeds that by three deviations. A group's own quantile counts the more, the more texts it has: thresholds of group, language and corpus
are averaged with weights n / (n + prior), from the group outwards. No threshold is a fixed number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Signal: (quantile, how many of its distances from the median are added) above and below; None: no threshold on that side. Junk in
#: symbols and word lengths may fill some percent of a group, so the quantiles there lie further inside.
RULES = {
    "symbol_share": ((0.9, 2.0), None),
    "repeat_share": ((0.995, 1.0), None),
    "dup_line_share": ((0.995, 1.0), None),
    "word_length": ((0.9, 1.75), (0.1, 1.75)),
}
#: Signals that are shares: (what is counted, of what).
SHARES = {"symbol_share": ("n_symbols", "word_chars"), "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words")}
DEVIATIONS = 3.0  # by which a count must exceed what its threshold allows, so that a few symbols or lines never fail a text


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    k = len(codes)
    if k < 2_000_000:  # k ** 3 fits
        window = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
        _, at, count = np.unique(window, return_inverse=True, return_counts=True)
        hit = count[at] > 1
    else:
        seen: dict[tuple, int] = {}
        trios = list(zip(words, words[1:], words[2:], strict=False))
        for t in trios:
            seen[t] = seen.get(t, 0) + 1
        hit = np.fromiter((seen[t] > 1 for t in trios), bool, n - 2)
    if not hit.any():
        return 0
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= hit
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measured(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            made = np.array([measure(t or "") for t in rows.column(3).to_pylist()], np.int64).reshape(rows.num_rows, 6)
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], *(pa.array(made[:, i]) for i in range(6))], names=["id", "lang", "source", *COUNTS])

    thin = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return thin.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def thresholds(groups: DataFrame, prior: float) -> DataFrame:
    """(lang, source) with <signal>_high and <signal>_low; groups: (lang, source, n) with a sketch per signal."""

    def merged(keys: list[str], tag: str) -> DataFrame:
        return groups.groupBy(*keys).agg(F.sum("n").alias(f"n_{tag}"), *(F.kll_merge_agg_double(s).alias(f"{s}_{tag}") for s in RULES))

    langs = merged(["lang"], "lang").withColumnRenamed("lang", "lang_key")
    table = groups.join(langs, groups["lang"].eqNullSafe(langs["lang_key"])).crossJoin(F.broadcast(merged([], "all")))  # the right side is one row

    def at(sketch: str, q: float, more: float):
        edge, mid = (F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(x)) for x in (q, 0.5))
        return edge + more * (edge - mid)

    out = []
    for s, sides in RULES.items():
        for side, name in zip(sides, ("high", "low"), strict=True):
            if side:
                w, w_lang = F.col("n") / (F.col("n") + prior), F.col("n_lang") / (F.col("n_lang") + prior)
                outer = w_lang * at(f"{s}_lang", *side) + (1 - w_lang) * at(f"{s}_all", *side)
                out.append((w * at(s, *side) + (1 - w) * outer).alias(f"{s}_{name}"))
    return table.select(F.col("lang").alias("lang_t"), F.col("source").alias("source_t"), *out)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: float = 200.0) -> DataFrame:
    """One row per row of df: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules.

    prior: as many texts as a group needs for its own quantiles to weigh as much as those around it. Null language or source is a group of
    its own; null and empty texts have no words and fail the base rule; very long texts are measured whole; repeated rows and null ids are
    kept; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(df.sparkSession)
    made = materialize(measured(df, id_col, text_col, lang_col, source_col))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    signals = {s: F.col(a) / F.greatest(F.col(b), F.lit(1)) for s, (a, b) in SHARES.items()}
    made = made.withColumn("base_failed", base).withColumns(signals)
    groups = materialize(made.filter("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(s).alias(s) for s in signals)))
    limits = thresholds(groups, prior)
    # Texts of a group in which all fail the base rule find no thresholds; they are not kept anyway.
    found = made.join(limits, made["lang"].eqNullSafe(F.col("lang_t")) & made["source"].eqNullSafe(F.col("source_t")), "left")
    sure = {s: (F.col(a) - DEVIATIONS * F.sqrt(F.col(a))) / F.greatest(F.col(b), F.lit(1)) if s != "word_length" else F.col(s) for s, (a, b) in SHARES.items()}
    high = [F.when(sure[s] > F.col(f"{s}_high"), F.lit(s)) for s, (up, _) in RULES.items() if up]
    low = [F.when(F.col(s) < F.col(f"{s}_low"), F.lit(f"{s}_low")) for s, (_, down) in RULES.items() if down]
    failed = F.array_compact(F.array(*high, *low))
    return found.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", ((~F.col("base_failed")) & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed_rules"))

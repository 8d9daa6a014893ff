"""Secret scan: pattern findings plus random-looking strings found by a battery of randomness tests.

Every run of token characters of 20 or more is a candidate. Its encoding (hexadecimal, letters, base32, base36, base62, base64 or the URL form of it) is inferred from
its characters. Against the hypothesis that symbols are drawn evenly from that alphabet it is tested by chi-squared over the
alphabet's parts, by runs about the alphabet's middle and by serial correlation. A candidate that passes is still no finding: short
natural strings pass as well. So each gets the probability that a natural string of its length looks as even as it does, and the
Benjamini-Hochberg step over all candidates of the corpus, held per class of lengths, bounds the share of false findings.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Letters by how common they are in natural words, and their logarithmic weight there against an even draw.
LETTERS = "etaoinsrhdlucmfwygpbvkxqjz"
WEIGHTS = (12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.0, 6.1, 4.3, 4.0, 2.8, 2.8, 2.4, 2.2, 2.4, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.3, 0.3, 0.3, 0.3)
COMMON = {c: math.log(26 * w / sum(WEIGHTS)) for c, w in zip(LETTERS, WEIGHTS, strict=True)}
#: Fixed alphabets by size, each with the number of parts that its chi-squared test counts.
ALPHABETS = {
    "hex": ("0123456789abcdef", 4),
    "HEX": ("0123456789ABCDEF", 4),
    "lower": (LETTERS, 4),
    "UPPER": (LETTERS.upper(), 4),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 4),
    "base32lower": ("abcdefghijklmnopqrstuvwxyz234567", 4),
    "base36": (LETTERS + "0123456789", 4),
    "BASE36": (LETTERS.upper() + "0123456789", 4),
    "letters": (LETTERS.upper() + LETTERS, 8),
    "base62": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 8),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 8),
    "base64url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 8),
}
#: Alphabets without case or without digits: natural strings in them are told by how common their letters are.
TOLD_BY_LETTERS = ("lower", "UPPER", "base32", "base32lower", "base36", "BASE36", "letters")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[+/]")
RANKS = {name: {c: i for i, c in enumerate(letters)} for name, (letters, _) in ALPHABETS.items()}
BINS = 2000  # of -ln p, for the false-discovery step


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern findings by start, then kind as listed; code points, end exclusive."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_z(x: float, df: float) -> float:
    """Wilson-Hilferty: the normal value of a chi-squared one."""
    return ((max(x, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token; None for plain decimal numbers and where characters mix alphabets."""
    chars = set(token)
    if chars <= set("0123456789"):
        return None
    return next((name for name, ranks in RANKS.items() if chars <= ranks.keys()), None)


def battery(token: str) -> tuple[float, float] | None:
    """(p of the three tests joined, if symbols are even over the alphabet; p of looking this even, if the string is natural)."""
    body = token.rstrip("=")
    name = encoding(body)
    if name is None or len(body) < 20:
        return None
    ranks, n = RANKS[name], len(body)
    size, parts = len(ranks), ALPHABETS[name][1]
    values = [ranks[c] for c in body]
    counts = [0] * parts
    for v in values:
        counts[v * parts // size] += 1
    chi2 = sum(c * c / (-(-(i + 1) * size // parts) - -(-i * size // parts)) for i, c in enumerate(counts)) * size / n - n
    p_chi = _normal_tail(_chi2_z(chi2, parts - 1))
    high = [2 * v >= size for v in values]
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    p_runs = 2 * _normal_tail(abs(runs - 1 - (n - 1) / 2) / math.sqrt((n - 1) / 4))
    mid, var = (size - 1) / 2, (size * size - 1) / 12
    serial = sum((a - mid) * (b - mid) for a, b in zip(values, values[1:], strict=False)) / (var * math.sqrt(n - 1))
    p_serial = 2 * _normal_tail(abs(serial))
    even = min(1.0, 3 * min(p_chi, p_runs, p_serial))
    # A natural string sits mostly in one class of characters and repeats letters: half of it or more in one part, so chi-squared
    # has mean (parts - 1) + n * lam with lam = 0.4 and a variance that grows with n.
    lam = 0.4
    natural = _normal_tail(((parts - 1) + n * lam - chi2) / math.sqrt(2 * (parts - 1) + 4 * n * lam))
    # Natural strings consist of few words and numbers, separated or capitalised; random ones change class at nearly every other place.
    if name in TOLD_BY_LETTERS:
        own = [COMMON[c] for c in body.lower() if c in COMMON]
        natural = _normal_tail((0.25 * len(own) - sum(own)) / (0.9 * math.sqrt(len(own))))  # natural words: 0.34 a letter in the mean, deviation 0.68, before words repeat letters
        if name in ("lower", "UPPER"):
            return even, max(natural, 1e-300)
    joins = (len(PIECE.findall(body)) - 1 - sum(c in "-_" for c in body)) / (n - 1)
    words = _normal_tail((joins - 0.15) / math.sqrt(0.16 / (n - 1)))
    both = max(natural * words, 1e-300)
    return even, max(min(1.0, both * (1 - math.log(both))), 1e-300)  # Fisher's joint p of two independent ones


def length_class(n: int) -> int:
    return min(6, int(math.log2(max(n, 20) / 20) * 2))


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int, float]]:
    """(start, end, length class, -ln p) of strings that pass the battery and touch no base span."""
    at = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][2] <= a:
            at += 1
        if any(s < b and e > a for _, s, e in taken[at : at + 4]):
            continue
        tested = battery(m[0])
        if tested and tested[0] >= 0.001:
            yield a, b, length_class(b - a), -math.log(tested[1])


def discovery_bounds(rows: list[tuple[int, int, int, int]], alpha: float) -> dict[int, float]:
    """Benjamini-Hochberg per class from counts (class, bin of -ln p, n passing, n tested in class): the least -ln p accepted.

    The tested count of a class weighs its short, weak strings against it: the shorter the class, the more natural strings it holds.
    """
    bounds = {}
    for c in {r[0] for r in rows}:
        own = sorted(((b, n, m) for k, b, n, m in rows if k == c), reverse=True)
        passed = 0
        for b, n, m in own:
            passed += n
            if math.exp(-b / 10) <= alpha * passed / m:
                bounds[c] = b / 10
    return bounds


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, base string, random array<struct<a:int,b:int,c:int,score:double>>, tested array<int>"


def scan_text(text: str) -> dict:
    base = base_spans(text)
    out = {f"n_{kind}": sum(k == kind for k, _, _ in base) for kind in KINDS[:3]}
    tested = [length_class(len(m[0])) for m in CANDIDATE.finditer(text)]
    found = [{"a": a, "b": b, "c": c, "score": s} for a, b, c, s in candidates(text, base)]
    return out | {"base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "base": joined(base), "random": found, "tested": tested}


def scan_texts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FOUND.split(", ")]
    for texts in parts:
        yield pd.DataFrame([scan_text(t or "") for t in texts], columns=names)


def with_spans(made: DataFrame, alpha: float) -> DataFrame:
    """made, a table with `found` (FOUND), with `spans` of all findings by start, then kind.

    The false-discovery step covers every candidate of df: it needs one count per length class and bin of p.
    """
    bins = made.select(F.explode("found.random").alias("f")).groupBy(F.col("f.c").alias("c"), F.least(F.floor(F.col("f.score") * 10), F.lit(BINS)).alias("b")).agg(F.count("*").alias("n"))
    tested = made.select(F.explode("found.tested").alias("c")).groupBy("c").agg(F.count("*").alias("m"))
    rows = [(r["c"], r["b"], r["n"], r["m"]) for r in bins.join(tested, "c").collect()]  # at most 7 * BINS rows
    bounds = discovery_bounds(rows, alpha)
    least = F.create_map(*(F.lit(x) for c in range(7) for x in (c, float(bounds.get(c, 1e9)))))
    kept = F.filter("found.random", lambda f: F.floor(f["score"] * 10) / 10 >= least[f["c"]])
    more = F.transform(kept, lambda f: F.struct(f["a"].alias("a"), F.lit(3).alias("k"), F.concat(F.lit("random:"), f["a"], F.lit(":"), f["b"]).alias("s")))
    split = F.filter(F.split("found.base", ","), lambda s: s != "")
    base = F.transform(split, lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.array_position(F.lit(list(KINDS)), F.split(s, ":")[0]).cast("int").alias("k"), s.alias("s")))
    spans = F.when(F.size("found.random") == 0, F.col("found.base")).otherwise(F.array_join(F.transform(F.array_sort(F.concat(base, more)), lambda x: x["s"]), ","))
    return made.withColumn("spans", spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.01) -> DataFrame:
    """One row per row of df: id, n_assign, n_access, n_hex, base_sha256, spans (all findings, kind:start:end).

    Null and empty texts have no findings; very long texts are scanned whole; repeated rows and null ids are kept; an empty table gives
    an empty result; other columns are ignored.
    """
    small_batches(df.sparkSession)
    thin = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = with_spans(materialize(thin.withColumn("found", F.pandas_udf(scan_texts, FOUND).asNondeterministic()(F.col("text"))).drop("text")), alpha)
    return found.select(F.col("id").alias(id_col), *(f"found.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256")), "spans")


def cleaned(texts: pd.Series, spans: pd.Series, marks: pd.Series) -> pd.Series:
    out = []
    for t, s, mark in zip(texts, spans, marks, strict=True):
        if t is not None and s:
            ends, done, parts = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in s.split(","))), 0, []
            for a, b in ends:
                if a >= done:
                    parts += [t[done:a], mark]
                done = max(done, b)
            t = "".join(parts) + t[done:]
        out.append(t)
    return pd.Series(out, dtype=object)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]", alpha: float = 0.01) -> DataFrame:
    """df with every finding in text_col replaced by `mark`; rows, column order and all other columns as they were.

    Overlapping findings are replaced as one. Null texts stay null, empty ones empty; very long texts are masked whole; repeated rows are
    masked alike; an empty table gives an empty result. Only texts go to Python, the second time only those with findings.
    """
    small_batches(df.sparkSession)
    names = df.columns
    safe = df.toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index(text_col)}"
    found = with_spans(materialize(safe.withColumn("found", F.pandas_udf(scan_texts, FOUND).asNondeterministic()(F.col(text)))), alpha).withColumn("hit", F.when(F.col("spans") != "", F.col(text)))
    masked = found.withColumn("clean", F.pandas_udf(cleaned, "string")("hit", "spans", F.lit(mark)))
    fixed = masked.withColumn(text, F.when(F.col("spans") == "", F.col(text)).otherwise(F.col("clean")))
    return fixed.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(names)))

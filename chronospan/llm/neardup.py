"""Near duplicates by Order MinHash with verification by banded alignment.

A text's words (runs of letters, digits and underscores in lower case) form `k`-word shingles, each labelled with its occurrence
number. Per band a random order of the labelled shingles is drawn, the `per_band` smallest are taken and kept in text order; the
hash of that list is the band's bucket. Texts of up to `short` words have too few shingles for that: their buckets are segment keys,
which every pair of such texts within the bound shares (see segment_keys). Texts that meet in a bucket are candidates. A candidate
pair is a link if its aligned similarity, 1 - word edits / words of the longer text, is at least `similarity`; the alignment keeps to
the diagonals which that bound leaves. Classes are the connected components of links.

Equal word lists are one text from the start; a text is named by one of its rows (uid), never by its id, which may repeat. In a bucket
every text meets the bucket's smallest uid. Each text is first aligned with the one of these that it shares most buckets with, so a group
of n copies costs about n alignments, then with those of them that are still in another class. Of the pairs that this leaves in
different classes every one is decided: in buckets up to `crowd` members they are joined, in larger ones aligned block by block after
bounds from word counts, which lose no link; only links leave such a task. Links shrink to a forest inside each task before they meet.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, small_batches

WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    x ^= x >> np.uint64(32)
    return x


class WordHashes(dict):
    """32-bit hashes of words, each computed once; the memo is emptied at `most` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh32_intdigest(word)
        return found

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))


LOW = np.uint64((1 << 28) - 1)  # bits of a shingle's place beside its rank in a band's order


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-word shingles of texts of k words or more, in text order, and where each text begins.

    hashes: the word hashes of all texts, one after another; counts: words of each.
    """
    h = _mix(hashes.astype(np.uint64) + np.uint64(1))
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = _mix(out ^ h[j : j + n])
    own = counts - k + 1
    ends = np.cumsum(own)
    starts, text = ends - own, np.repeat(np.arange(len(own), dtype=np.uint64), own)
    out = out[np.arange(ends[-1]) + np.repeat((np.cumsum(counts) - counts) - starts, own)]
    alone = _mix(out + text * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(alone, kind="stable")
    same = np.r_[False, alone[order][1:] == alone[order][:-1]]
    if same.any():
        place = np.arange(len(out))
        label = np.empty(len(out), np.uint64)
        label[order] = place - np.maximum.accumulate(np.where(same, 0, place))
        out = _mix(out + label * np.uint64(0xA0761D6478BD642F))
    return out, starts


def order_minhash(grams: np.ndarray, starts: np.ndarray, bands: int, per_band: int, seed: int = 0) -> np.ndarray:
    """A row per text, a bucket per band: the hash of its smallest shingles, in text order. Texts need per_band shingles at least."""
    rng = np.random.default_rng(seed + 1)
    odd, salt = rng.integers(0, 2**63, bands, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, bands, np.uint64)
    place = np.arange(len(grams), dtype=np.uint64) - np.repeat(starts, np.diff(np.r_[starts, len(grams)])).astype(np.uint64)
    out, x, at = np.empty((len(starts), bands), np.uint64), np.empty_like(grams), np.empty((per_band, len(starts)), np.int64)
    for band in range(bands):
        np.bitwise_xor(grams, salt[band], out=x)
        np.multiply(x, odd[band], out=x)
        np.bitwise_and(x, ~LOW, out=x)
        np.bitwise_or(x, place, out=x)
        for i in range(per_band):
            at[i] = starts + (np.minimum.reduceat(x, starts) & LOW).astype(np.int64)
            x[at[i]] = np.uint64(2**64 - 1)
        chosen = grams[np.sort(at, axis=0)]
        key = np.full(len(starts), band + 1000003 * (seed + 1), np.uint64)
        for j in range(per_band):
            key = _mix(key ^ chosen[j]) + np.uint64(j)
        out[:, band] = key
    return out


def most_edits(longest: int, similarity: float) -> int:
    """Word edits that a pair may have whose longer text has `longest` words."""
    return int((1 - similarity) * longest + 1e-9)


def segment_keys(hashes: np.ndarray, similarity: float, short: int) -> np.ndarray:
    """Buckets of which two texts of up to `short` words share one at least if their similarity is `similarity` or more.

    Of e + 1 segments of the shorter text one stays whole under e edits. The longer text looks it up at the starts which the edits
    before and behind it leave (Pass-Join).
    """
    raw, n, out = hashes.tobytes(), len(hashes), set()

    def add(m: int, e: int, i: int, start: int, size: int) -> None:
        out.add(xxhash.xxh64_intdigest(raw[4 * start : 4 * (start + size)], (m << 32) + (e << 16) + i))

    def segments(m: int, parts: int) -> list[tuple[int, int, int]]:
        cuts = [m * i // parts for i in range(parts + 1)]
        return [(i, cuts[i], cuts[i + 1] - cuts[i]) for i in range(parts)]

    for e in {most_edits(longest, similarity) for longest in range(n, short + 1) if longest - most_edits(longest, similarity) <= n} - {0}:
        for i, start, size in segments(n, e + 1):
            add(n, e, i, start, size)
    e = most_edits(n, similarity)
    for m in range(n - e, n + 1) if e else ():
        for i, start, size in segments(m, e + 1):
            for at in range(max(0, start - i, start + n - m - (e - i)), min(n - size, start + i, start + n - m + e - i) + 1):
                add(m, e, i, at, size)
    return np.fromiter(out, np.uint64, len(out))


def buckets_of(lists: list[np.ndarray], similarity: float, k: int, bands: int, per_band: int, short: int) -> list[np.ndarray]:
    """All buckets of each text; texts that may be near one longer than `short` have bands whatever their own length."""
    found = [segment_keys(h, similarity, short).astype(np.int64) if 0 < len(h) <= short else np.zeros(0, np.int64) for h in lists]
    least = max(k + per_band - 1, short + 1 - most_edits(short + 1, similarity))
    long = [i for i, h in enumerate(lists) if len(h) >= least]
    if long:
        grams, starts = shingles(np.concatenate([lists[i] for i in long]), np.array([len(lists[i]) for i in long]), k)
        for i, row in zip(long, order_minhash(grams, starts, bands, per_band).astype(np.int64), strict=True):
            found[i] = np.concatenate([found[i], row]) if len(found[i]) else row
    return found


class Places:
    """Where the elements of a list stand, as bit masks over a part of it; memory grows with the list, not with its square."""

    def __init__(self, a: list[int], often: int = 256):
        self.at: dict[int, list[int]] = {}
        self.masks: dict[int, int] = {}
        if len(a) <= 4096:
            for i, x in enumerate(a):
                self.masks[x] = self.masks.get(x, 0) | 1 << i
            return
        for i, x in enumerate(a):
            self.at.setdefault(x, []).append(i)
        for x in sorted((x for x, places in self.at.items() if len(places) > 16), key=lambda x: -len(self.at[x]))[:often]:
            bits = np.zeros(len(a), bool)
            bits[self.at[x]] = True
            self.masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def mask(self, x: int, low: int, width: int) -> int:
        """Bit i is set where x stands at low + i, for i below width."""
        if x in self.masks:
            m = self.masks[x]
            return (m >> low if low >= 0 else m << -low) & ((1 << width) - 1)
        found = 0
        places = self.at.get(x, ())
        for p in places[bisect_left(places, low) :]:
            if p >= low + width:
                break
            found |= 1 << (p - low)
        return found


def banded_distance(a: list[int], b: list[int], most: int) -> int | None:
    """Edit distance if it is at most `most`, else None; only cells within `most` of the diagonal are computed.

    The column of a band is held in the bits of an integer (vertical differences), one step per element of b. Wide bands are tried
    narrow first.
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return None
    if not m or not n:
        return max(m, n)
    places = Places(a)
    for width in (*(w for w in (64, 512, 4096) if abs(m - n) <= w < most // 2), most):
        found = _in_band(places, m, b, width)
        if found is not None:
            return found
    return None


def _in_band(places: Places, m: int, b: list[int], most: int) -> int | None:
    n, width = len(b), 2 * most + 1
    mask, bottom = (1 << width) - 1, 1 << (2 * most)
    plus, minus = mask >> most << most, 0
    distance = min(most, m)
    for j, x in enumerate(b):
        match = places.mask(x, j - most, width)
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        up = minus | (mask & ~(diagonal | plus))
        down = diagonal & plus
        if j < m - most:
            distance += not diagonal & bottom
        else:
            bit = m - (j + 1) + most
            distance += (up >> bit & 1) - (down >> bit & 1)
        if distance > most + n - j:
            return None
        plus = down | (mask & ~((diagonal >> 1) | up))
        minus = (diagonal >> 1) & up
    return distance if distance <= most else None


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two word lists align with at most (1 - similarity) of the longer one's words edited."""
    longest = max(len(x), len(y))
    most = most_edits(longest, similarity)
    if abs(len(x) - len(y)) > most:
        return False
    short = min(len(x), len(y))
    off = np.flatnonzero(x[:short] != y[:short])
    head = int(off[0]) if len(off) else short
    x, y = x[head:], y[head:]
    short = min(len(x), len(y))
    off = np.flatnonzero(x[len(x) - short :][::-1] != y[len(y) - short :][::-1])
    tail = int(off[0]) if len(off) else short
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    both = np.concatenate([x, y])
    _, code = np.unique(both, return_inverse=True)
    size = int(code.max()) + 1 if len(both) else 0
    shared = np.minimum(np.bincount(code[: len(x)], minlength=size), np.bincount(code[len(x) :], minlength=size)).sum()
    if max(len(x), len(y)) - shared > most:  # a bound from the words alone, whatever their order
        return False
    if min(len(x), len(y)) > 64:  # an edit takes at most three 3-word runs away; unlike texts of one language fail here
        runs = [_mix(_mix(_mix(c[:-2].astype(np.uint64) + np.uint64(1)) ^ c[1:-1].astype(np.uint64)) ^ c[2:].astype(np.uint64)) for c in (code[: len(x)], code[len(x) :])]
        _, code = np.unique(np.concatenate(runs), return_inverse=True)
        shared = np.minimum(*(np.bincount(c, minlength=int(code.max()) + 1) for c in (code[: len(runs[0])], code[len(runs[0]) :]))).sum()
        if max(map(len, runs)) - shared > 3 * most:
            return False
    return banded_distance(x.tolist(), y.tolist(), most) is not None


def sketched(df: DataFrame, id_col: str, text_col: str, similarity: float, k: int, bands: int, per_band: int, short: int, block: int = 1 << 20) -> DataFrame:
    """(row, id, key, words, sketch) of rows with an id and a text; key tells word lists apart, row rows. Texts go in blocks of `block` characters."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, row = WordHashes(), TaskContext.get().partitionId() << 33
        for rows in it:
            sizes = np.cumsum(rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < rows.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + block)))
                part = rows.slice(at, to - at)
                keys, lists = [], []
                for t in part.column(1).to_pylist():
                    words = WORD.findall(t.lower())
                    keys.append(xxhash.xxh128_digest(" ".join(words)) if words else b"\0" + xxhash.xxh128_digest(t))
                    lists.append(hashes(words))
                sketches = buckets_of(lists, similarity, k, bands, per_band, short)
                ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row + at, row + to)), part.column(0), pa.array(keys, pa.binary()), pa.array([h.tobytes() for h in lists], pa.binary()), made], names=["row", "id", "key", "words", "sketch"])
                at = to
            row += rows.num_rows

    thin = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null").withColumn("size", F.length("text"))
    return thin.mapInArrow(run, f"row long, id {df.schema[id_col].dataType.simpleString()}, key binary, words binary, sketch array<long>")


def verified(pairs: DataFrame, words: DataFrame, similarity: float, share: int = 256) -> DataFrame:
    """The pairs (a, b) whose word lists align, shrunk to a forest in each task; words: (id, words).

    A text with many partners is sent to a task per `share` of them.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def good() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for rows in it:
                x, y = rows.column(2), rows.column(3)
                hit = np.array([similar(np.frombuffer(x[i].as_buffer(), np.uint32), np.frombuffer(y[i].as_buffer(), np.uint32), similarity) for i in range(rows.num_rows)], bool)
                yield rows.column(0).to_numpy()[hit], rows.column(1).to_numpy()[hit]

        yield from forest(good())

    pairs = materialize(pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.col("n") / share + 1).cast("int")))
    # Both sides grow with the corpus: they meet by a sort at every size.
    right = pairs.hint("merge").join(words.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    left = pairs.select("a", "part").distinct().hint("merge").join(words.select(F.col("id").alias("a"), F.col("words").alias("x")), "a")
    return right.join(left, ["a", "part"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def forest(edges: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), a > b, that connect what the given ones do: every vertex with the smallest of its component among `most` vertices."""
    top: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := top.setdefault(v, v)) != v:
            top[v] = v = top[up]
        return v

    def flush() -> pa.RecordBatch:
        found = [(v, find(v)) for v in list(top)]
        a, b = [v for v, r in found if v != r], [r for v, r in found if v != r]
        top.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for some, others in edges:
        for x, y in zip(some.tolist(), others.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                top[max(x, y)] = min(x, y)
        if len(top) > most:
            yield flush()
    yield flush()


def contracted(edges: DataFrame) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from forest((rows.column(0).to_numpy(), rows.column(1).to_numpy()) for rows in it)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex of the edges (a, b), a > b, but the smallest of each component: label is that smallest one.

    Per round every edge moves to the smallest neighbour of its lower end, then the edges of a task's vertices shrink to a forest.
    """
    while True:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), (F.count("*") > 1).alias("twice")).withColumnRenamed("a", "v")
        moved = edges.join(least, F.col("b") == F.col("v"), "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
        twice = least.filter("twice").select(F.col("v").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        now = materialize(moved.union(twice))
        if now.filter("moved").isEmpty():
            return now.select(F.col("a").alias("id"), F.col("b").alias("label"))
        edges = materialize(contracted(now.repartition("a")))


def links(texts: DataFrame, similarity: float, crowd: int, block: int) -> DataFrame:
    """(id, label) of the texts that are not the smallest of their class; texts: (id, words, sketch)."""
    spread = texts.select("id", F.explode("sketch").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("members"), F.min("id").alias("a")).filter("members > 1")
    buckets = materialize(spread.join(shared, "bucket"))
    words = materialize(_words_of(texts, buckets))  # of texts that meet another one; the others' words move once, here
    star = materialize(buckets.filter("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.max("members").alias("n"), F.count("*").alias("shared")))
    nearest = star.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"), "n")).alias("m")).select((-F.col("m.a")).alias("a"), "b", "m.n")
    labels = joined(verified(nearest, words, similarity))
    rest = materialize(_apart(star, labels).select("a", "b", "n"))
    if not rest.isEmpty():
        labels = joined(verified(rest, materialize(_words_of(words, rest.select(F.explode(F.array("a", "b")).alias("id")))), similarity), labels)
    own = buckets.filter("members > 2").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    open_ = own.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("greatest")).filter("least <> greatest").select("bucket")
    left = materialize(own.join(open_, "bucket", "left_semi").filter("id <> a"))  # each was aligned with its bucket's smallest or is in its class
    few = left.filter(F.col("members") <= crowd).select("bucket", "id", "label")
    other = few.select("bucket", F.col("id").alias("b"), F.col("label").alias("other"))
    pairs = materialize(few.join(other, "bucket").filter("id < b and label <> other").groupBy(F.col("id").alias("a"), "b").agg(F.lit(crowd).alias("n")))
    words = materialize(_words_of(words, left))  # what is still open
    found = verified(pairs, words, similarity)
    many = left.filter(F.col("members") > crowd)
    if not many.isEmpty():
        found = found.union(_crowded(many, words, similarity, block))
    elif pairs.isEmpty():
        return labels
    return joined(found, labels)


def _words_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, words) of the texts whose id is among ids."""
    return texts.select("id", "words").join(ids.select("id").distinct().hint("merge"), "id", "left_semi")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose texts are in different classes so far; labels: as of components."""
    of_a, of_b = labels.select(F.col("id").alias("a"), F.col("label").alias("x")), labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left").filter(F.coalesce("x", "a") != F.coalesce("y", "b")).drop("x", "y")


def joined(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """As components, of new edges together with the classes known so far."""
    if labels is not None:
        edges = contracted(edges.union(labels.select(F.col("id").alias("a"), F.col("label").alias("b"))))
    return components(materialize(edges))


def _crowded(left: DataFrame, words: DataFrame, similarity: float, block: int, most_bytes: int = 1 << 24, bins: int = 256) -> DataFrame:
    """Links (a, b), a > b, that connect all classes of crowded buckets which a link between two members connects.

    left: (bucket, id, label, members). Members are dealt into blocks of about `block` texts and `most_bytes` of words, those of the
    bucket's largest class apart from the others, and a task aligns the pairs of two blocks of a bucket, so that only links leave it. Two
    blocks of the largest class never meet: its texts go once to each block of the others. A pair with several such buckets is decided in one of them, drawn by
    a hash. An edit changes at most two counts of words, hence at most two of their sums over `bins` groups of words, and one of them
    where lengths change: other pairs are not aligned. Nor are those whose classes the task has already linked.
    """

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, bucket = rows.column("id").to_numpy(), rows.column("bucket").to_numpy()[:1].astype(np.uint64)
        lists = [np.frombuffer(w.as_buffer(), np.uint32) for w in rows.column("words")]
        n = np.array([len(w) for w in lists])
        counts = np.stack([np.minimum(np.bincount(w % bins, minlength=bins), 255) for w in lists]).astype(np.int16)
        shared = rows.column("crowds").combine_chunks()
        met, at = shared.flatten().to_numpy().astype(np.uint64), np.r_[0, np.cumsum(shared.value_lengths().to_numpy())]
        _, code = np.unique(met, return_inverse=True)
        top = {x: x for x in rows.column("label").to_pylist()}
        label = list(rows.column("label").to_pylist())

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        side = rows.column("side").to_numpy()
        one = side[0] == 2  # a block against itself
        first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        own, a, b = np.zeros(len(met) and int(code.max()) + 1, bool), [], []
        for place, i in enumerate(first):
            js = second[place + 1 :] if one else second
            most = ((1 - similarity) * np.maximum(n[js], n[i]) + 1e-9).astype(np.int64)
            fits = np.abs(n[js] - n[i]) <= most
            js, most = js[fits], most[fits]
            js = js[np.abs(counts[js] - counts[i]).sum(axis=1) <= 2 * most]
            root = find(label[i])
            js = js[np.array([find(label[j]) != root for j in js], bool)]
            if not len(js):
                continue
            size = at[js + 1] - at[js]
            begins = np.cumsum(size) - size
            flat = np.arange(size.sum()) + np.repeat(at[js] - begins, size)
            pair = _mix(ids[js].astype(np.uint64) + ids[i].astype(np.uint64))
            own[code[at[i] : at[i + 1]]] = True
            drawn = np.where(own[code[flat]], _mix(met[flat] ^ np.repeat(pair, size)), np.uint64(2**64 - 1))
            own[code[at[i] : at[i + 1]]] = False
            for j in js[np.minimum.reduceat(drawn, begins) == _mix(bucket ^ pair)]:
                x, y = find(label[i]), find(label[j])
                if x != y and similar(lists[i], lists[j], similarity):
                    top[max(x, y)] = min(x, y)
                    a.append(max(ids[i], ids[j]))
                    b.append(min(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    crowds = left.groupBy("id").agg(F.collect_list("bucket").alias("crowds"))
    made = words.join(crowds, "id").select("id", "crowds", "words")
    sized = left.join(words.select("id", F.octet_length("words").alias("size")), "id")
    per = sized.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    largest = F.max(F.struct("n", (-F.col("label")).alias("of"), "size")).alias("m")
    per = per.groupBy("bucket").agg(largest, F.sum("n").alias("n"), F.sum("size").alias("size"))
    parts = lambda n, size: F.ceil(F.greatest(n / block, size / most_bytes)).cast("int")
    per = per.select("bucket", (-F.col("m.of")).alias("main"), parts(F.col("n") - F.col("m.n"), F.col("size") - F.col("m.size")).alias("few"), parts(F.col("m.n"), F.col("m.size")).alias("many"))
    dealt = left.join(per.filter("few > 0"), "bucket").withColumn("of_main", F.col("label") == F.col("main"))
    draw = F.xxhash64("id", "bucket")
    own = F.when(F.col("of_main"), F.col("few") + F.pmod(draw, F.col("many"))).otherwise(F.pmod(draw, F.col("few"))).cast("int")
    upto = F.when(F.col("of_main"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    dealt = dealt.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), upto)))
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    dealt = dealt.select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), side.alias("side"), "id", "label")
    return dealt.join(made, "id").repartition("bucket", "i", "j").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def _classed(df: DataFrame, id_col: str, text_col: str, similarity: float, k: int, bands: int, per_band: int, short: int, crowd: int, block: int) -> DataFrame:
    """(row, id, label, class_id) of rows with an id and a text; label names the class, class_id is its smallest id."""
    small_batches(df.sparkSession)
    made = materialize(sketched(df, id_col, text_col, similarity, k, bands, per_band, short))
    firsts = materialize(made.groupBy("key").agg(F.min("row").alias("uid"), F.min("id").alias("first")))
    texts = made.select(F.col("row").alias("id"), "words", "sketch").join(firsts.select(F.col("uid").alias("id")), "id", "left_semi")
    with scratch(df.sparkSession):
        labels = materialize(links(texts, similarity, crowd, block).withColumnRenamed("id", "uid"), keep=True)
    of_text = firsts.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    smallest = of_text.groupBy("label").agg(F.min("first").alias("class_id"))
    return made.select("row", "id", "key").join(of_text.join(smallest, "label").select("key", "label", "class_id"), "key").drop("key")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, k: int = 3, bands: int = 40, per_band: int = 2, short: int = 24, crowd: int = 24, block: int = 512) -> DataFrame:
    """One row per row of df with a non-null id: id and class_id, the smallest id of its class of exact and near copies.

    Texts without a word form a class with texts equal to them; a null text is alone in its class; repeated rows share their class, and
    rows of one id with different texts have the classes of their texts; rows with a null id come back with a null class_id; texts of
    any length are compared whole; an empty table gives an empty result; other columns are ignored.
    """
    with scratch(df.sparkSession):
        known = materialize(_classed(df, id_col, text_col, similarity, k, bands, per_band, short, crowd, block).select("id", "class_id"), keep=True)
    rest = df.filter(F.col(id_col).isNull() | F.col(text_col).isNull()).select(F.col(id_col).alias("id"), F.col(id_col).alias("class_id"))
    return known.union(rest).withColumnRenamed("id", id_col)


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, k: int = 3, bands: int = 40, per_band: int = 2, short: int = 24, crowd: int = 24, block: int = 512) -> DataFrame:
    """The rows of df without further copies: of each class one row of its smallest id stays; columns as they were.

    Rows with a null id or text stay, the latter once per id. Empty and very long texts are texts like others. An id with several texts
    keeps one row for each class that it is the first of. An empty table gives an empty result.
    """
    names = df.columns
    safe = df.toDF(*(f"c{i}" for i in range(len(names))))
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    safe = safe.withColumn("digest", F.md5(F.col(text).cast("binary")))
    # A row is known by its id and its text's digest, so that reading df twice needs no stable order.
    marked = safe.select(F.struct(key, "digest").alias("mark"), text).filter(F.col(f"mark.{key}").isNotNull() & F.col(text).isNotNull())
    with scratch(df.sparkSession):
        found = _classed(marked, "mark", text, similarity, k, bands, per_band, short, crowd, block)
        first = materialize(found.groupBy("label").agg(F.min("id").alias("m")).select(F.col(f"m.{key}").alias("key"), "m.digest"), keep=True)
    with_text = safe.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).join(first, (F.col(key) == first["key"]) & (safe["digest"] == first["digest"]), "left_semi")
    no_text = safe.filter(F.col(key).isNotNull() & F.col(text).isNull())
    kept = with_text.dropDuplicates([key, "digest"]).union(no_text.dropDuplicates([key])).union(safe.filter(F.col(key).isNull()))
    return kept.drop("digest").toDF(*names)

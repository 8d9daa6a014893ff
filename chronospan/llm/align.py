"""Alignment of two tokenizers over whole texts by an event sweep.

Every token of either tokenizer is an event at the byte where it ends. Events of both are put in blocks of ids (an id's bytes are known, so
ids and a block's first byte say where each token ends), sent to their document, sorted by offset and streamed through a machine that
holds the tokens since the last place where both tokenizers end. There a group is closed; each stretch between two neighbouring ends is one
link, as exactly one token of each side covers it.

How many documents hold a linked pair of ids is counted next, first within tasks. Frequent pairs, at most `most_hot`, go to the tasks as a
table; all other pairs meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_batches, scratch
from .tokens import TextIds, segments

BLOCK = 1 << 16  # tokens of one event row
EMPTY = np.empty(0, np.int64)


class PlainIds(TextIds):
    """Ids of texts in which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.fast = self.fast and (self.fast[0], self.fast[1], ())


class PieceIds:
    """Ids of texts by a sentencepiece model that puts a space before a text and never joins a space to what stands before it.

    Such texts are the sum of their words: texts with single spaces only have each distinct word of a block encoded once, many in one
    call; others are encoded in parts that end before a single space.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.opens = np.array([p.startswith("▁") for p in pieces])
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")

    def _whole(self, text: str) -> np.ndarray:
        cut = list(segments(text, 1 << 15)) if self.cuts else [text]
        return np.array([i for n, s in enumerate(cut) for i in self.model.encode(s[1:] if n else s, num_threads=1)], np.int64)

    def _words(self, words: list[str], together: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        groups = [words[i : i + together] for i in range(0, len(words), together)]
        ids, sizes = [], []
        for group, found in zip(groups, self.model.encode([" ".join(g) for g in groups], num_threads=1), strict=True):
            found = np.array(found, np.int64)
            at = np.flatnonzero(self.opens[found])
            if len(at) != len(group):  # a word with the space's own sign
                each = self.model.encode(group, num_threads=1)
                found, at = np.array([i for e in each for i in e], np.int64), np.cumsum([0, *map(len, each)])[:-1]
            ids.append(found)
            sizes.append(np.diff(np.r_[at, len(found)]))
        return np.concatenate(ids), np.concatenate(sizes)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none for null."""
        texts = texts.fill_null("").cast(pa.large_string())
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = pc.or_(odd, pc.equal(texts, "")).to_numpy(zero_copy_only=False) | (not self.cuts)
        out: list[np.ndarray] = [EMPTY] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._whole(texts[i].as_py())
        even = np.flatnonzero(~odd)
        if len(even):
            split = pc.split_pattern(texts.take(pa.array(even)), " ")
            ends = split.offsets.to_numpy()
            coded = split.flatten().dictionary_encode()
            ids, sizes = self._words(coded.dictionary.to_pylist())
            index, begins = coded.indices.to_numpy(), np.cumsum(sizes) - sizes
            n = sizes[index]
            upto = np.r_[0, np.cumsum(n)]
            flat = ids[np.arange(upto[-1]) - np.repeat(upto[:-1], n) + np.repeat(begins[index], n)]
            bounds = upto[ends]
            for i, a, b in zip(even.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                out[i] = flat[a:b]
        return out


@lru_cache(maxsize=2)
def _sides(path_a: str, path_b: str) -> tuple[PlainIds, PieceIds, pa.Array, pa.Array]:
    """(encoder A, encoder B, bytes of each id of A, of B), once per worker process."""
    import json

    with open(path_a) as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    entries = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    table = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        table[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    b = PieceIds(path_b)
    return PlainIds(path_a), b, pa.array(table, pa.large_binary()), pa.array(b.bytes, pa.large_binary())


def planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes())


def numbers(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel().astype(np.int64)


def _spelt(ids: np.ndarray, table: pa.Array) -> memoryview:
    taken = table.take(pa.array(ids))
    return memoryview(taken.buffers()[2] or b"").cast("B")[: np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[-1]]


def token_ids(texts: pa.Array, a: PlainIds, b: PieceIds, table_a: pa.Array, table_b: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of both sides of each text; none where the text is null or empty or one side does not spell it."""
    spaced = pc.binary_join_element_wise(pa.scalar(" "), texts.cast(pa.string()), "")
    for text, own, other in zip(texts, a(spaced), b(texts), strict=True):
        if not text.is_valid or not len(text.as_buffer()):
            yield EMPTY, EMPTY
            continue
        ids = np.frombuffer(own, "<u4").astype(np.int64)
        wanted = b" " + bytes(text.as_buffer())
        same = _spelt(ids, table_a) == wanted and _spelt(other, table_b) == wanted
        yield (ids, other) if same else (EMPTY, EMPTY)


def events(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """(row, id, at, side, ids): blocks of end events of both sides; a text without tokens has one empty block."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(path_a, path_b)
        lengths = [pc.binary_length(t).to_numpy(zero_copy_only=False).astype(np.int64) for t in sides[2:]]
        kinds = ["<u2" if len(t) <= 1 << 16 else "<u4" for t in lengths]
        for batch in it:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes) // (8 << 20)
            for p in np.unique(part):  # of about 8 MB
                begin, end = int(np.searchsorted(part, p)), int(np.searchsorted(part, p, "right"))
                rows, out = batch.slice(begin, end - begin), []
                keys, ids = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                for key, i, pair in zip(keys, ids, token_ids(rows.column(2), *sides), strict=True):
                    for side, tokens in enumerate(pair):
                        at = np.r_[0, np.cumsum(lengths[side][tokens])]
                        for k in range(0, len(tokens), BLOCK):
                            out.append((key, i, int(at[k]), side, planes(tokens[k : k + BLOCK], kinds[side])))
                    if not len(pair[0]):
                        out.append((key, i, 0, 0, b""))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("side", pa.int32()), ("ids", pa.binary())])
    thin = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(run, "row bigint, id bigint, at bigint, side int, ids binary")


class Sweep:
    """Streams sorted event blocks of many documents as one long text; documents end where both sides end."""

    def __init__(self, lengths: list[np.ndarray]):
        self.lengths = lengths
        self.shift = int(len(lengths[1]) - 1).bit_length()
        n = max(map(len, lengths))
        self.shown = pa.array([f"{i}{sep}".encode() for i in range(n) for sep in ",|;"], pa.large_binary())
        self.row: int | None = None
        self.base = self.size = 0
        self.docs: list[dict] = []
        self.ends: list[list[np.ndarray]] = [[], []]
        self.ids: list[list[np.ndarray]] = [[], []]
        self.held = 0

    def feed(self, row: int, i: int | None, at: int, side: int, ids: np.ndarray) -> None:
        if row != self.row:
            self.base, self.row, self.size = self.base + self.size, row, 0
            self.docs.append({"row": row, "id": i, "start": self.base, "sha": hashlib.sha256(), "n": np.zeros(4, np.int64), "pairs": []})
        ends = at + np.cumsum(self.lengths[side][ids])
        if len(ends):
            self.ends[side].append(self.base + ends)
            self.ids[side].append(ids)
            self.size = max(self.size, int(ends[-1]))
            self.held += len(ids)

    def drain(self, final: bool) -> list[dict]:
        """Closes the groups that are complete; the documents that have ended."""
        self.held = 0
        ea, eb = (np.concatenate(e) if e else EMPTY for e in self.ends)
        ia, ib = (np.concatenate(i) if i else EMPTY for i in self.ids)
        if len(ea) and len(eb):
            low = int(min(ea[0], eb[0])) - 1
            marks = np.zeros((2, int(max(ea[-1], eb[-1])) - low + 1), bool)  # a byte for each byte of text held
            marks[0, ea - low] = marks[1, eb - low] = True
            both = np.flatnonzero(marks[0] & marks[1])
            if len(both):
                na, nb = np.searchsorted(ea, low + both[-1], "right"), np.searchsorted(eb, low + both[-1], "right")
                self._close(ea[:na] - low, ia[:na], eb[:nb] - low, ib[:nb], both, marks[:, : both[-1] + 1], low)
                ea, ia, eb, ib = ea[na:], ia[na:], eb[nb:], ib[nb:]
        self.ends, self.ids = [[ea], [eb]], [[ia], [ib]]
        done, self.docs = (self.docs, []) if final else (self.docs[:-1], self.docs[-1:])
        return done

    def _close(self, ea: np.ndarray, ia: np.ndarray, eb: np.ndarray, ib: np.ndarray, both: np.ndarray, marks: np.ndarray, low: int) -> None:
        """Ends are counted from `low` on; marks: where A ends and where B ends."""
        starts = np.array([d["start"] for d in self.docs], np.int64)
        met = marks[0] & marks[1]
        upto_a, upto_b, upto_g, upto_l = (np.cumsum(m, dtype=np.int32) for m in (marks[0], marks[1], met, marks[0] | marks[1]))
        cuts = np.flatnonzero(marks[0] | marks[1])
        pair = (ia[upto_a[cuts] - marks[0][cuts]] << self.shift) | ib[upto_b[cuts] - marks[1][cuts]]
        # Ends of a document lie behind its start, up to the next one's.
        edge = np.clip(np.r_[starts, low + len(met) - 1] - low, 0, len(met) - 1)
        n = np.stack([np.diff(u[edge].astype(np.int64)) for u in (upto_a, upto_b, upto_g, upto_l)], axis=1)
        doc_l = np.repeat(np.arange(len(starts)), n[:, 3])
        # The text of the groups: A's ids, a bar, B's ids, a semicolon.
        group_a, group_b = upto_g[ea] - met[ea], upto_g[eb] - met[eb]
        last_a, last_b = met[ea], met[eb]
        before_b = np.r_[0, upto_b[both[:-1]]]
        place_a = np.arange(len(ia)) + before_b[group_a]
        place_b = np.arange(len(ib)) + upto_a[both][group_b]
        sign = np.empty(len(ia) + len(ib), np.int64)
        sign[place_a], sign[place_b] = ia * 3 + last_a, ib * 3 + 2 * last_b
        taken = self.shown.take(pa.array(sign))
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        bytes_at = offsets[np.r_[0, np.cumsum(n[:, 0] + n[:, 1])]].tolist()
        text = memoryview(taken.buffers()[2])
        bits = self.shift + int(len(self.lengths[0]) - 1).bit_length()
        key, times = np.unique((doc_l << bits) | pair, return_counts=True)
        key_at = np.searchsorted(key >> bits, np.arange(len(starts) + 1)).tolist()
        for d, doc in enumerate(self.docs):
            if n[d, 3]:
                if doc["n"][3]:
                    doc["sha"].update(b";")
                doc["sha"].update(text[bytes_at[d] : bytes_at[d + 1] - 1])  # without the last semicolon
                doc["n"] += n[d]
                own = slice(key_at[d], key_at[d + 1])
                doc["pairs"].append((key[own] & ((1 << bits) - 1), times[own]))
                if len(doc["pairs"]) > 8:
                    doc["pairs"] = [_summed(doc["pairs"])]


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers with their counts, each once."""
    if len(found) == 1:
        return found[0]
    if not found:
        return EMPTY, EMPTY
    keys, n = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
    key, at = np.unique(keys, return_inverse=True)
    return key, np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)


DOC = "row bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"
DOC_SCHEMA = pa.schema([("row", pa.int64()), ("id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def swept(sorted_events: DataFrame, path_a: str, path_b: str, hold: int = 1 << 20) -> DataFrame:
    """A row per document: counts, the hash of its groups, and its linked pairs (sorted, as differences) with how often each is linked."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = [pc.binary_length(t).to_numpy(zero_copy_only=False).astype(np.int64) for t in _sides(path_a, path_b)[2:]]
        kinds = ["<u2" if len(t) <= 1 << 16 else "<u4" for t in lengths]
        sweep = Sweep(lengths)

        def rows(done: list[dict]) -> pa.RecordBatch:
            out = []
            for d in done:
                pair, times = _summed(d["pairs"])
                sha = d["sha"].hexdigest() if d["n"][0] else ""
                out.append((d["row"], d["id"], *map(int, d["n"]), sha, planes(np.diff(pair, prepend=0), "<u8"), planes(times, "<u4")))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DOC_SCHEMA, strict=True)], schema=DOC_SCHEMA)

        for batch in it:
            for row, i, at, side, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sweep.feed(row, i, at, side, numbers(data, kinds[side]) if data else EMPTY)
                if sweep.held > hold and (done := sweep.drain(False)):
                    yield rows(done)
        if done := sweep.drain(True):
            yield rows(done)

    return sorted_events.mapInArrow(run, DOC)


def pair_counts(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(pair, n): in how many documents each pair is linked; counted within tasks first, in tables of about `most` pairs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda t: pa.RecordBatch.from_arrays([pa.array(t[0], pa.int64()), pa.array(t[1], pa.int64())], names=["pair", "n"])
        total, held, size = (EMPTY, EMPTY), [], 0
        for batch in it:
            for data in batch.column(0):
                pair = np.cumsum(numbers(data.as_py(), "<u8"))
                held.append((pair, np.ones(len(pair), np.int64)))
                size += len(pair)
                if size > most:
                    total, held, size = _summed([total, *held]), [], 0
                    if len(total[0]) > most:
                        yield out(total)
                        total = (EMPTY, EMPTY)
        total = _summed([total, *held])
        if len(total[0]):
            yield out(total)

    return docs.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, known) -> DataFrame:
    """docs with n_best and count_sum over the pairs in `known` (broadcast of sorted pairs, their counts and whether each is its A id's
    best); the pairs that are not there remain in pairs and times."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = known.value
        for batch in it:
            n_best, sums, pairs, left = [], [], [], []
            for p, t in zip(batch.column("pairs"), batch.column("times"), strict=True):
                pair, times = np.cumsum(numbers(p.as_py(), "<u8")), numbers(t.as_py(), "<u4")
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                at, n = at[hit], times[hit]
                n_best.append(int(n[best[at]].sum()))
                sums.append(int((n * counts[at]).sum()))
                pairs.append(planes(np.diff(pair[~hit], prepend=0), "<u8") if not hit.all() else None)
                left.append(planes(times[~hit], "<u4") if not hit.all() else None)
            kept = [batch.column(i) for i in range(7)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pairs, pa.binary()), pa.array(left, pa.binary()), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64())], names=[*DOC_SCHEMA.names, "n_best", "count_sum"])

    return docs.mapInArrow(run, DOC + ", n_best bigint, count_sum bigint")


def _spread(docs: DataFrame) -> DataFrame:
    """(row, pair, times) of the pairs that a document's row still holds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row, p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, times = np.cumsum(numbers(p, "<u8")), numbers(t, "<u4")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), row)), pa.array(pair), pa.array(times)], names=["row", "pair", "times"])

    return docs.filter("pairs is not null").select("row", "pairs", "times").mapInArrow(run, "row bigint, pair bigint, times bigint")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most_hot: int = 1 << 20) -> DataFrame:
    """A row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or that one of the tokenizers does not spell byte for byte, has zeros and an empty hash. Repeated rows are
    documents of their own and null ids are kept; ids are longs. An empty table gives an empty result; other columns are ignored. Long
    texts travel in blocks of tokens. Frequent pairs: the counts from the smallest power of two on that at most most_hot pairs reach.
    """
    spark = docs.sparkSession
    shift = (_vocabulary(path_b) - 1).bit_length()
    with scratch(spark):
        with row_batches(spark, 500):
            found = materialize(swept(events(docs, path_a, path_b, id_col, text_col).repartition("row").sortWithinPartitions("row", "at", "side"), path_a, path_b))
        with row_batches(spark, 2000):
            counts = materialize(pair_counts(found))
            a = F.shiftright("pair", shift)
            best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
            rated = materialize(counts.withColumn("a", a).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
            log = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
            total, least = 0, 0
            for level, n in rated.groupBy(log.alias("level")).count().orderBy(F.desc("level")).collect():  # 63 rows at most
                if total + n > most_hot:
                    least = 1 << (level + 1)
                    break
                total += n
            hot = rated.filter(F.col("n") >= least).orderBy("pair").toArrow()  # at most most_hot rows
            table = [hot.column(c).to_numpy() for c in ("pair", "n", "best")]
            known = spark.sparkContext.broadcast((table[0], table[1], table[2].astype(bool)))
            out = materialize(scored(found, known), keep=not least)
            known.destroy()
            if least:
                cold = _spread(out).join(rated.filter(F.col("n") < least), "pair")
                sums = cold.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
                both = out.drop("pairs", "times").join(sums, "row", "left")
                out = materialize(both.withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("s", F.lit(0))), keep=True)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _vocabulary(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()

"""Benchmark decontamination by suffix arrays of the training texts.

Texts of a task are put together in shards of bounded size and each shard gets the array of its words' suffixes, sorted by prefix doubling.
Every suffix of every test item is looked up in each shard by binary search, word by word, which gives its longest match and all places
where it occurs. Words are compared as 64-bit hashes in the search; each place of a window is then compared byte by byte. A long text
is cut into parts with as many words of context on both sides as a window has; each part answers for its own words only.

The test items travel to the tasks in blocks of a checked size, one pass over the texts for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, n_bytes, row_batches, scratch, small_batches

WORD = np.zeros(256, bool)
WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash's base and of its inverse, grown as needed."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)], dtype=np.uint64) for b in (BASE, INVERSE))
        return cls.up, cls.down


def words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of the words of texts that are laid end to end; no word crosses one of the breaks."""
    low = LOWER[data]
    inside = np.r_[False, WORD[data], False]
    turn = inside[1:] != inside[:-1]
    at = np.flatnonzero(turn)
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut + 1]])  # a break between two letters ends a word and begins one
    if len(cut):
        at = np.sort(np.r_[at, cut, cut])
    return low, at[::2], at[1::2]


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    up, down = Powers.to(len(low) + 1)
    total = np.empty(len(low) + 1, np.uint64)
    total[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Shard:
    """Words of several texts with the array of their suffixes; `rank` numbers distinct words from 1 in the order of `vocabulary`."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # of each word, the text it stands in
    rank: np.ndarray
    vocabulary: np.ndarray
    suffixes: np.ndarray


def shard_of(data: np.ndarray, breaks: np.ndarray) -> Shard:
    """breaks: where texts begin, from 0."""
    low, starts, ends = words(data, breaks)
    text = np.searchsorted(breaks, starts, side="right") - 1
    vocabulary, rank = np.unique(hashes(low, starts, ends), return_inverse=True)
    rank = rank.astype(np.int64) + 1
    last = np.r_[np.flatnonzero(text[1:] != text[:-1]), len(text) - 1][: len(text)] if len(text) else np.empty(0, np.int64)
    left = np.empty(len(text), np.int64)  # words from here to the end of the text, this one included
    if len(text):
        left = last[np.searchsorted(last, np.arange(len(text)))] - np.arange(len(text)) + 1
    return Shard(low, starts, ends, text, rank, vocabulary, suffix_array(rank, left))


def suffix_array(rank: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places of the words in the order of their suffixes, which end with their text; equal suffixes in the order of their places.

    Prefix doubling: after a round places are ordered by twice as many words, and only those that are not yet told apart go on.
    """
    n = len(rank)
    if n == 0:
        return np.empty(0, np.int64)
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    at = np.arange(n)
    group = np.empty(n, np.int64)  # of each place, 1 + the first place in `order` of those equal so far
    first = np.r_[True, key[1:] != key[:-1]]
    group[order] = np.maximum.accumulate(np.where(first, at, 0)) + 1
    width = 1
    size = np.diff(np.r_[np.flatnonzero(first), n])
    todo = np.flatnonzero(np.repeat(size > 1, size))  # places in `order` whose suffixes are still equal to others
    while len(todo):
        place = order[todo]
        nxt = np.where(left[place] > width, group[np.minimum(place + width, n - 1)], 0)
        head = group[place]
        if n < 2**31:
            by = np.argsort((head << 32) | nxt, kind="stable")
        else:
            by = np.lexsort((nxt, head))
        place, head, nxt = place[by], head[by], nxt[by]
        order[todo] = place
        new = np.r_[True, (head[1:] != head[:-1]) | (nxt[1:] != nxt[:-1])]
        group[place] = np.maximum.accumulate(np.where(new, todo, 0)) + 1
        size = np.diff(np.r_[np.flatnonzero(new), len(todo)])
        ended = np.repeat((size == 1) | (nxt[new] == 0), size)  # alone, or equal to the end of their texts
        todo = todo[~ended]
        width *= 2
    return order


@dataclass
class Items:
    """Test items as words: suffix i of all begins at word i; `left` counts the words to its item's end."""

    ids: list
    hash: np.ndarray
    left: np.ndarray
    item: np.ndarray
    window: np.ndarray  # words of the window that begins here, 0 if none does or an earlier suffix begins with the same one
    first: np.ndarray  # for words with a window the first suffix that begins with it, else -1
    owners: dict[int, set]  # the items of each window, by its first suffix
    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    begin: np.ndarray  # the word's place in its item

    @classmethod
    def of(cls, rows: list[tuple[object, str]], width: int) -> Items:
        texts = [t.encode() for _, t in rows]
        breaks = np.cumsum([0, *map(len, texts)])[: max(len(texts), 1)].astype(np.int64)
        low, starts, ends = words(np.frombuffer(b"".join(texts), np.uint8), breaks)
        place = np.arange(len(starts))
        item = np.searchsorted(breaks, starts, side="right") - 1
        n = np.bincount(item, minlength=len(rows))
        begin = (np.r_[0, np.cumsum(n)] if len(n) else np.zeros(1, np.int64))[item]
        left = n[item] - (place - begin)
        window = np.where(left >= width, width, np.where((place == begin) & (n[item] < width), n[item], 0))
        hashed = hashes(low, starts, ends)
        has = np.flatnonzero(window)
        step = np.arange(width)
        cells = np.where(step < window[has][:, None], hashed[np.minimum(has[:, None] + step, len(hashed) - 1)] if len(hashed) else 0, 0).astype(np.uint64)
        keyed = np.c_[window[has].astype(np.uint64), cells].reshape(len(has), width + 1)
        _, at, kind = np.unique(keyed, axis=0, return_index=True, return_inverse=True)
        first = np.full(len(starts), -1, np.int64)
        first[has] = has[at][kind.ravel()]
        owners: dict[int, set] = {}
        for suffix, i in zip(first[has].tolist(), item[has].tolist(), strict=True):
            owners.setdefault(suffix, set()).add(rows[i][0])
        return cls([i for i, _ in rows], hashed, left, item, np.where(first == place, window, 0), first, owners, low, starts, ends, place - begin)


def bounds(shard: Shard, active: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Of each range [lo, hi) of the suffix array, equal in `depth` words, the first place whose next word is `wanted` or after (right: after)."""
    lo, hi = lo.copy(), hi.copy()
    n = len(shard.rank)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        place = shard.suffixes[np.minimum(mid, n - 1)] + depth
        inside = np.minimum(place, n - 1)
        same = (place < n) & (shard.text[inside] == shard.text[np.minimum(place - depth, n - 1)])
        word = np.where(same, shard.rank[inside], 0)
        before = (word <= wanted) if right else (word < wanted)
        lo, hi = np.where(open_ & before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
    return lo


def known_ranks(shard: Shard, items: Items) -> np.ndarray:
    """The shard's number of each word of the items, -1 for words that it does not hold."""
    if not len(shard.vocabulary):
        return np.full(len(items.hash), -1)
    slot = np.minimum(np.searchsorted(shard.vocabulary, items.hash), len(shard.vocabulary) - 1)
    return np.where(shard.vocabulary[slot] == items.hash, slot + 1, -1)


def search(shard: Shard, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix of the items: (words of its longest match, one place of it, first and last + 1 place in the array of its window)."""
    m = len(items.hash)
    longest, where = np.zeros(m, np.int64), np.zeros(m, np.int64)
    first, behind = np.zeros(m, np.int64), np.zeros(m, np.int64)
    if m == 0 or len(shard.rank) == 0:
        return longest, where, first, behind
    rank = known_ranks(shard, items)
    active = np.flatnonzero(rank > 0)
    lo, hi = np.zeros(len(active), np.int64), np.full(len(active), len(shard.rank))
    depth = 0
    ordered = shard.rank[shard.suffixes]
    while len(active):
        wanted = rank[active + depth]
        if depth == 0:
            lo, hi = np.searchsorted(ordered, wanted, "left"), np.searchsorted(ordered, wanted, "right")
        else:
            hi, lo = bounds(shard, active, lo, hi, depth, wanted, True), bounds(shard, active, lo, hi, depth, wanted, False)
        found = (lo < hi) & (wanted > 0)
        active, lo, hi, depth = active[found], lo[found], hi[found], depth + 1
        longest[active], where[active] = depth, shard.suffixes[lo]
        done = items.window[active] == depth
        first[active[done]], behind[active[done]] = lo[done], hi[done]
        more = items.left[active] > depth
        active, lo, hi = active[more], lo[more], hi[more]
    return longest, where, first, behind


def same_bytes(shard: Shard, places: np.ndarray, items: Items, suffix: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n words from each place are those of the item's suffix, byte by byte."""
    if not len(places):
        return np.empty(0, bool)
    of = np.repeat(np.arange(len(places)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b = places[of] + step, suffix[of] + step
    size, other = shard.ends[a] - shard.starts[a], items.ends[b] - items.starts[b]
    bad = size != other
    least = np.minimum(size, other)
    byte = np.arange(least.sum()) - np.repeat(np.cumsum(least) - least, least)
    differ = shard.low[np.repeat(shard.starts[a], least) + byte] != items.low[np.repeat(items.starts[b], least) + byte]
    wrong = np.bincount(np.repeat(np.arange(len(a)), least)[differ], minlength=len(a)) > 0
    return np.bincount(of[bad | wrong], minlength=len(places)) == 0


def windows_found(shard: Shard, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(place, suffix of the items whose window occurs there), every occurrence once for each different item suffix."""
    _, _, first, behind = search(shard, items)
    hit = np.flatnonzero(behind > first)
    n = behind[hit] - first[hit]
    suffix = np.repeat(hit, n)
    place = shard.suffixes[np.repeat(first[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    same = same_bytes(shard, place, items, suffix, items.window[suffix])
    return place[same], suffix[same]


@dataclass
class Part:
    """Bytes of one text with context; it answers for the words that begin in [own, upto)."""

    text: int
    data: np.ndarray
    own: int
    upto: int


def _back(data: np.ndarray, at: int, n: int) -> int:
    """Where the n-th last word before `at` begins, 0 if there are fewer; `at` is no place inside a word."""
    reach = 64 * (n + 1)
    while reach < at:
        inside = WORD[data[at - reach : at]]
        begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        if len(begins) >= n:
            return at - reach + int(begins[-n]) if n else at
        reach *= 2
    return 0


def _ahead(data: np.ndarray, at: int, n: int) -> int:
    """Where the n-th next word from `at` ends, the text's end if there are fewer."""
    reach = 64 * (n + 1)
    while at + reach < len(data):
        inside = WORD[data[at : at + reach]]
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        if len(ends) >= n:
            return at + int(ends[n - 1]) if n else at
        reach *= 2
    return len(data)


def parts(text: int, data: np.ndarray, size: int, context: int) -> Iterator[Part]:
    """A text in parts of about `size` bytes, cut where no word is."""
    at = 0
    while at < len(data):
        to = min(at + size, len(data))
        while to < len(data) and WORD[data[to]]:
            gap = np.flatnonzero(~WORD[data[to : to + 4096]])
            to = to + int(gap[0]) if len(gap) else min(to + 4096, len(data))
        low, high = _back(data, at, context), _ahead(data, to, context)
        yield Part(text, data[low:high], at - low, to - low)
        at = to


def shards(column: pa.Array, size: int, context: int) -> Iterator[list[Part]]:
    """The texts of a batch, null ones left out, in groups of about `size` bytes."""
    column = column.cast(pa.large_binary())
    group, room = [], size
    for i in range(len(column)):
        if column[i].is_valid:
            data = np.frombuffer(column[i].as_buffer(), np.uint8)
            for part in parts(i, data, size, context):
                group.append(part)
                room -= len(part.data)
                if room <= 0:
                    yield group
                    group, room = [], size
    if group:
        yield group


def joined(group: list[Part]) -> tuple[Shard, np.ndarray, np.ndarray]:
    """(shard of the parts, text of each word, whether its part answers for it)."""
    sizes = np.array([len(p.data) for p in group], np.int64)
    breaks = np.cumsum(np.r_[0, sizes[:-1]])
    shard = shard_of(np.concatenate([p.data for p in group]), breaks)
    at = shard.starts - breaks[shard.text]
    own = (at >= np.array([p.own for p in group])[shard.text]) & (at < np.array([p.upto for p in group])[shard.text])
    return shard, np.array([p.text for p in group], np.int64)[shard.text], own


def _merged(spans: list[int]) -> list[int]:
    """Pairs (from, to) laid flat, in order and without overlap."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def scanned(texts: pa.Array, items: Items, width: int, size: int) -> tuple[list[int], list[list[int]], list[set]]:
    """Of each text: its words, the hit ones as flat pairs (from, to), and the items with an occurring window."""
    n_words, spans, found = [0] * len(texts), [[] for _ in range(len(texts))], [set() for _ in range(len(texts))]
    for group in shards(texts, size, width - 1):
        shard, text, own = joined(group)
        if not len(text):
            continue
        place, suffix = windows_found(shard, items)
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + items.window[suffix], -1)
        hit = (np.cumsum(edge[:-1]) > 0) & own
        count = np.bincount(text[own], minlength=len(texts))
        before = np.cumsum(own) - own  # own words before, over all texts of the shard
        first = np.r_[0, np.cumsum(count)]
        turn = np.flatnonzero(np.diff(np.r_[0, np.where(hit, text + 1, 0), 0]))
        for a, b in zip(turn[:-1].tolist(), turn[1:].tolist(), strict=True):
            if hit[a]:
                t = int(text[a])
                shift = n_words[t] - int(first[t])
                spans[t] += [int(before[a]) + shift, int(before[b - 1]) + 1 + shift]
        for t, s in {*zip(text[place].tolist(), suffix.tolist(), strict=True)}:
            found[t] |= items.owners[s]
        for t in np.flatnonzero(count).tolist():
            n_words[t] += int(count[t])
    return n_words, spans, found


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The test items (id, text) in blocks of about block_bytes of text; a null text has no words."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    total = rows.agg(F.sum(n_bytes(F.col("text")))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return [rows] if n == 1 else [rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) for i in range(n)]


def _sent(block: DataFrame):
    return block.sparkSession.sparkContext.broadcast([(r["id"], r["text"]) for r in block.collect()])


def contamination(
    docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    shard_bytes: int = 4 << 20, block_bytes: int = 4 << 20,
) -> DataFrame:
    """A row per document: id, n_words, spans (its hit words as pairs from, to), items (ids as strings, sorted).

    A window is `width` consecutive words of an item, or all of an item with fewer. Words within any occurrence of a window are hit. Null
    and empty texts have no words; repeated rows and null ids are kept as they are; an item's null id is not listed, though its windows
    count; items without words find nothing. Empty tables give an empty result or one without hits. Other columns are ignored.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    none = [F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items")]
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *none)
    blocks = _blocks(items, item_col, item_text, block_bytes)
    with row_batches(spark, 1000), scratch(spark):
        for block in blocks:
            sent, last = _sent(block), block is blocks[-1]

            def run(it: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
                known = Items.of(sent.value, width)
                for batch in it:
                    n_words, spans, found = scanned(batch.column(1), known, width, shard_bytes)
                    spans = [_merged(old + new) for old, new in zip(batch.column(2).to_pylist(), spans, strict=True)]
                    listed = [sorted({*old, *(x for x in new if x is not None)}) for old, new in zip(batch.column(3).to_pylist(), found, strict=True)]
                    columns = [batch.column(0), pa.array(spans, pa.list_(pa.int64())), pa.array(listed, pa.list_(pa.string()))]
                    columns.insert(1, pa.array(n_words, pa.int64()) if last else batch.column(1))
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words" if last else "text", "spans", "items"])

            schema = f"id {id_type}, {'n_words bigint' if last else 'text string'}, spans array<bigint>, items array<string>"
            state = materialize(state.mapInArrow(run, schema), keep=last)  # the text travels on while there are blocks to come
            sent.destroy()
    return state.withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """contamination() with n_hit, n_items, items_sha256 and contaminated in place of the lists."""
    pairs = F.sequence(F.lit(0), F.size("spans") - 1, F.lit(2))
    n_hit = F.when(F.size("spans") > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda n, i: n + F.get("spans", i + 1) - F.get("spans", i))).otherwise(0)
    out = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop("spans", "items")


def remove(docs: DataFrame, items: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_bytes: int = 4 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs, whole, in which no window of an item occurs; null texts stay. Rows left are written between blocks of items."""
    spark, blocks = docs.sparkSession, _blocks(items, item_col, item_text, block_bytes)
    schema, names = docs.schema, docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    inner, at = docs.schema, names.index(text_col)
    with row_batches(spark, 1000), scratch(spark):
        for block in blocks:
            sent = _sent(block)

            def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                known = Items.of(sent.value, width)
                for batch in it:
                    yield batch.filter(pa.array([not s for s in scanned(batch.column(at), known, width, shard_bytes)[1]], pa.bool_()))

            docs = materialize(docs.mapInArrow(run, inner), keep=block is blocks[-1])
            sent.destroy()
    return docs.toDF(*schema.names)


def longest_matches(
    docs: DataFrame, items: DataFrame, least: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    shard_bytes: int = 4 << 20, block_bytes: int = 4 << 20,
) -> DataFrame:
    """(item_id, start, n_words, doc, at): of each suffix of an item its longest verbatim match of at least `least` words in any document and
    the place of one, by words: the smallest (document, place) among the longest. Suffixes inside the match of the one before are left
    out. A long text's parts overlap by as many words as the longest item has, so no match is cut. Nulls as in contamination().
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(items, item_col, item_text, block_bytes):
        sent = _sent(block)

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Items.of(sent.value, 1)
            deepest = int(known.left.max(initial=0))
            best: dict[int, tuple] = {}
            for batch in it:
                ids, n_words = batch.column(0).to_pylist(), [0] * batch.num_rows
                for group in shards(batch.column(1), shard_bytes, deepest):
                    shard, text, own = joined(group)
                    longest, where, _, _ = search(shard, known)
                    hit = np.flatnonzero(longest >= least)
                    rank = shard.rank
                    known_rank = known_ranks(shard, known)
                    inverse = np.empty(len(rank), np.int64)
                    inverse[shard.suffixes] = np.arange(len(rank))
                    opened = np.r_[True, text[1:] != text[:-1]] if len(text) else np.empty(0, bool)
                    for s in hit.tolist():
                        n, at = int(longest[s]), int(inverse[where[s]])
                        while at < len(rank):  # every place of the longest match
                            p = int(shard.suffixes[at])
                            if p + n > len(rank) or shard.text[p] != shard.text[p + n - 1] or (rank[p : p + n] != known_rank[s : s + n]).any():
                                break
                            at += 1
                            if not own[p]:
                                continue
                            t = int(text[p])
                            first = p - int(np.flatnonzero(opened[: p + 1])[-1])
                            lead = int((~own[p - first : p]).sum())
                            key = (-n, ids[t] is None, ids[t], n_words[t] + first - lead)
                            if s not in best or key < best[s]:
                                best[s] = key
                    for t, c in zip(*np.unique(text[own], return_counts=True), strict=True):
                        n_words[t] += int(c)
            rows = [{"item_id": known.ids[known.item[s]], "start": int(known.begin[s]), "n_words": -k[0], "doc": k[2], "at": k[3]} for s, k in best.items()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

        schema = pa.schema([("item_id", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])
        found = thin.mapInArrow(run, f"item_id string, start bigint, n_words bigint, doc {id_type}, at bigint")
        out = found if out is None else out.union(found)
    small_batches(spark)
    key = F.struct((-F.col("n_words")).alias("o"), F.col("doc").isNull().alias("no"), "doc", "at")
    one = out.groupBy("item_id", "start").agg(F.min(key).alias("m")).select("item_id", "start", (-F.col("m.o")).alias("n_words"), F.col("m.doc").alias(id_col), "m.at")
    earlier = one.select("item_id", (F.col("start") + 1).alias("start"), (F.col("n_words") - 1).alias("inside"))
    return one.join(earlier, ["item_id", "start"], "left").filter("inside is null or inside < n_words").drop("inside")

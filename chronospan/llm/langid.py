"""Language identification by a linear-chain conditional random field over words.

A word's score for a language is the sum of learned weights of its affixes, character n-grams and lexicon entry; learned
transitions join neighbouring words, so switches of language inside a text cost what they cost in training. Forward-backward gives
each word its language probabilities; a text's language is the one with the largest mean, and that mean is its score.

Everything is array arithmetic over the code points of a batch of texts. Forward-backward runs over the texts of a batch side by side,
long ones in parts; its memory is linear in the words and in the languages.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BITS = 17
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 of everything else."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    return x ^ (x >> np.uint64(29))


class Words:
    """The words (runs of letters) of a batch of texts and the hashed features of their characters."""

    def __init__(self, texts: list[str]):
        data = ("\0\0" + "\0\0".join(texts) + "\0\0\0").encode("utf-32-le", "surrogatepass")
        c = letters()[np.frombuffer(data, "<u4")].astype(np.uint64)
        inside = c > 0
        edge = np.flatnonzero(np.diff(inside))
        self.start, self.end = edge[::2] + 1, edge[1::2] + 1  # end exclusive
        self.count = len(self.start)
        ends = np.cumsum([len(t) + 2 for t in texts])
        self.text = np.searchsorted(ends, self.start, side="right")  # the text of each word
        at = np.flatnonzero(inside)
        self.lengths = self.end - self.start
        self.first = np.cumsum(self.lengths) - self.lengths  # of each word among letter positions
        left, mid, right = c[at - 1], c[at], c[at + 1]
        left2, right2 = np.where(left > 0, c[at - 2], 0), np.where(right > 0, c[at + 2], 0)
        three = (left << np.uint64(42)) ^ (mid << np.uint64(21)) ^ right
        shift, mask = np.uint64(64 - BITS), np.uint64(1)
        self.grams = [  # n-grams centred on every letter; 0 marks a word's edge, so affixes are among them
            (_mix(three ^ mask) >> shift).astype(np.int32),
            (_mix(_mix(three) ^ (left2 << np.uint64(21)) ^ right2) >> shift).astype(np.int32),
        ]
        s, e = self.start, self.end
        p2, s2 = np.where(self.lengths > 1, c[s + 1], 0), np.where(self.lengths > 1, c[e - 2], 0)
        p3, s3 = np.where(self.lengths > 2, c[np.minimum(s + 2, len(c) - 1)], 0), np.where(self.lengths > 2, c[e - 3], 0)
        pack = lambda a, b, d, k: (_mix(_mix((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ d) + np.uint64(k)) >> shift).astype(np.int32)
        zero = np.zeros(self.count, np.uint64)
        self.affixes = [pack(c[s], p2, zero, 1), pack(c[s], p2, p3, 2), pack(c[e - 1], s2, zero, 3), pack(c[e - 1], s2, s3, 4)]
        place = (np.arange(len(at)) - np.repeat(self.first, self.lengths)).astype(np.uint64)
        self.key = np.add.reduceat(_mix(mid + (place << np.uint64(32))), self.first) if self.count else np.zeros(0, np.uint64)
        self.restart = np.r_[True, self.text[1:] != self.text[:-1]][: self.count]


class Model:
    """Weights of a trained field; languages in the order of its columns."""

    def __init__(self, languages: list[str], lexicon: np.ndarray):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.grams = np.zeros((2, 1 << BITS, n), np.float32)
        self.affixes = np.zeros((1 << BITS, n), np.float32)
        self.words = np.zeros((len(lexicon) + 1, n), np.float32)  # the last row: not in the lexicon
        self.trans = np.zeros((n, n), np.float32)
        self.first = np.zeros(n, np.float32)

    def entry(self, w: Words) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(w.count, np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, w.key), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == w.key, at, len(self.lexicon))

    def scores(self, w: Words) -> np.ndarray:
        out = self.words[self.entry(w)].copy()
        for x in w.affixes:
            out += self.affixes[x]
        gram = self.grams[0][w.grams[0]] + self.grams[1][w.grams[1]]
        return out + np.add.reduceat(gram, w.first, axis=0) / w.lengths[:, None].astype(np.float32) * 2


def _messages(emit: np.ndarray, begins: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray, size: int | None = None) -> np.ndarray:
    """Row vectors v_t = (v_{t-1} @ trans) * emit[t], scaled now and then, over chains side by side; a chain begins with first * emit.

    Chains longer than `size` are cut: what an inner part does to any vector is a matrix, which gives every part the vector before it.
    Memory: a vector per step and a matrix per inner part.
    """
    k = emit.shape[1]
    size = size or (64 if k <= 16 else 512)  # a matrix costs k vectors
    parts = -(-lengths // size)
    chain = np.repeat(np.arange(len(begins)), parts)
    nr = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = begins[chain] + nr * size
    length = np.minimum(size, lengths[chain] - nr * size)

    def sweep(rows: np.ndarray, v: np.ndarray, out: np.ndarray | None) -> np.ndarray:
        order = np.argsort(-length[rows], kind="stable")
        rows, v = rows[order], v[order]
        top, own, at = nr[rows] == 0, length[rows], start[rows]
        longest = int(own.max(initial=0))
        going = np.searchsorted(-own, -np.arange(longest), side="left").tolist()  # parts with more than t steps
        for t, n in enumerate(going):
            e, now = emit[at[:n] + t], v[:n]
            now[:] = (now.reshape(-1, k) @ trans).reshape(now.shape)
            if t == 0:
                now[top[:n]] = first
            now *= e.reshape((n,) + (1,) * (v.ndim - 2) + (k,))
            if out is not None:
                out[at[:n] + t] = now
            if t % 4 == 3 or t == longest - 1:
                now /= now.reshape(n, -1).max(axis=1).reshape((n,) + (1,) * (v.ndim - 1))
        back = np.empty_like(v)
        back[order] = v
        return back

    heads = np.full((len(chain), k), 1.0 / k)
    more = np.flatnonzero((nr == 0) & (parts[chain] > 1))
    if len(more):
        heads[more + 1] = sweep(more, heads[more], None)
        inner = np.flatnonzero((nr > 0) & (nr < parts[chain] - 1))
        does = sweep(inner, np.broadcast_to(np.eye(k), (len(inner), k, k)).copy(), None)
        for i, m in zip(inner.tolist(), does, strict=True):
            v = heads[i] @ m
            heads[i + 1] = v / v.sum()
    out = np.empty_like(emit)
    sweep(np.arange(len(chain)), heads, out)
    return out


def _emissions(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30


def _backward(model: Model, w: Words, emit: np.ndarray, end: np.ndarray | None) -> np.ndarray:
    """From the end the chains run the same way: emissions times what the later words say. end: the message of the word behind, if any."""
    begins = np.flatnonzero(w.restart)
    lengths = np.diff(np.r_[begins, w.count])
    trans = np.exp(model.trans.astype(np.float64)).T
    return _messages(emit[::-1], (w.count - begins - lengths)[::-1], lengths[::-1], trans, np.ones(len(trans)) if end is None else end @ trans)[::-1]


def _forward(model: Model, w: Words, emit: np.ndarray, start: np.ndarray | None) -> np.ndarray:
    """start: the message of the word before, if any."""
    begins = np.flatnonzero(w.restart)
    trans = np.exp(model.trans.astype(np.float64))
    return _messages(emit, begins, np.diff(np.r_[begins, w.count]), trans, np.exp(model.first.astype(np.float64)) if start is None else start @ trans)


def marginals(model: Model, w: Words, scores: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(language probabilities of every word, expected transitions summed over the chain's inner steps if asked for)."""
    emit, trans = _emissions(scores), np.exp(model.trans.astype(np.float64))
    forward, backward = _forward(model, w, emit, None), _backward(model, w, emit, None)
    node = forward * backward / emit
    node /= node.sum(axis=1, keepdims=True)
    if not pairs:
        return node, None
    inner = np.flatnonzero(~w.restart)
    before, here = forward[inner - 1], backward[inner]
    total = ((before @ trans) * here).sum(axis=1, keepdims=True)
    return node, trans * ((before / total).T @ here)


def train(texts: list[str], langs: list[str], epochs: int = 5, batch: int = 64, rate: float = 0.3, seed: int = 7, batch_chars: int = 400_000) -> Model | None:
    """Fits the field by AdaGrad on the log-likelihood of word labels, up to `batch` texts or about `batch_chars` characters a step.

    Half of the chains keep one text; in the others sentences of different texts alternate, which teaches switches.
    """
    languages = sorted(set(langs))
    if not languages:
        return None
    rng = random.Random(seed)
    column = {x: i for i, x in enumerate(languages)}
    seen: dict[int, int] = {}
    for at in range(0, len(texts), batch):
        for key, n in zip(*(x.tolist() for x in np.unique(Words(texts[at : at + batch]).key, return_counts=True)), strict=True):
            seen[key] = seen.get(key, 0) + n
    model = Model(languages, np.array(sorted(key for key, n in seen.items() if n >= 3), np.uint64))
    n = len(languages)
    tables = {"grams0": model.grams[0], "grams1": model.grams[1], "affixes": model.affixes, "words": model.words, "trans": model.trans, "first": model.first[None]}
    sums = {name: np.full_like(table, 1e-6) for name, table in tables.items()}

    def step(name: str, index: np.ndarray, gradient: np.ndarray, scale: float) -> None:
        """Moves the touched rows of a table."""
        touched = np.bincount(index, minlength=len(tables[name])) > 0
        rows, at = np.flatnonzero(touched), (np.cumsum(touched) - 1)[index]
        g = np.stack([np.bincount(at, weights=gradient[:, j], minlength=len(rows)) for j in range(n)], axis=1)
        g = (g * scale - 1e-4 * tables[name][rows]).astype(np.float32)
        sums[name][rows] += g * g
        tables[name][rows] += rate * g / np.sqrt(sums[name][rows])

    sentences = [[(s, column[x]) for s in t.split("\n") if s] for t, x in zip(texts, langs, strict=True)]
    everything = [s for t in sentences for s in t]
    for _ in range(epochs):
        order = list(range(len(texts)))
        rng.shuffle(order)
        while order:
            chains, size = [], 0
            while order and len(chains) < batch and size < batch_chars:
                i = order.pop()
                if rng.random() < 0.5 or len(everything) < 4:
                    chains.append(sentences[i])
                else:
                    chains.append([s for own in sentences[i] for s in ([own, rng.choice(everything)] if rng.random() < 0.3 else [own])])
                size += sum(len(s) for s, _ in chains[-1])
            parts = [(s, y, c) for c, chain in enumerate(chains) for s, y in chain]
            w = Words([s for s, _, _ in parts])
            if not w.count:
                continue
            gold = np.array([y for _, y, _ in parts])[w.text]
            of = np.array([c for _, _, c in parts])[w.text]
            w.restart = np.r_[True, of[1:] != of[:-1]]
            node, pair = marginals(model, w, model.scores(w))
            miss = -node
            miss[np.arange(w.count), gold] += 1.0  # the gradient at every word
            moves = np.zeros((n, n))
            inner = np.flatnonzero(~w.restart)
            np.add.at(moves, (gold[inner - 1], gold[inner]), 1.0)
            scale = 1.0 / len(chains)
            spread = np.repeat(miss / w.lengths[:, None] * 2, w.lengths, axis=0)
            entries = model.entry(w)
            for g in range(2):
                step(f"grams{g}", w.grams[g], spread, scale)
            step("affixes", np.concatenate(w.affixes), np.concatenate([miss] * len(w.affixes)), scale)
            step("words", entries, miss, scale)
            step("trans", np.arange(n), moves - pair, scale)
            step("first", np.zeros(int(w.restart.sum()), np.int64), miss[w.restart], scale)
    return model


class Labels:
    """What the field says of one text: language and score, words per language, switches between neighbouring words, runs of words."""

    __slots__ = ("lang", "score", "counts", "switches", "runs")

    def __init__(self):
        self.lang, self.score, self.counts, self.switches, self.runs = "und", 0.0, "", 0, []


def predict(model: Model | None, texts: list[str], runs: bool = False, most_chars: int = 200_000) -> list[Labels]:
    """Labels of each text; 'und' and 0 without a letter or a model. About most_chars characters at once bound the memory; a longer
    text is one chain all the same: messages pass from window to window, back to front first, then front to back."""
    out = [Labels() for _ in texts]
    if model is None:
        return out
    sums: dict[int, np.ndarray] = {}
    seen: dict[int, np.ndarray] = {}
    last: dict[int, int] = {}
    for i, t in enumerate(texts):
        if len(t) > most_chars:
            _long(model, i, t, _windows(t, most_chars), sums, seen, last, out, runs)
    todo = [(i, 0, len(t)) for i, t in enumerate(texts) if len(t) <= most_chars]
    at = 0
    while at < len(todo):
        to, size = at, 0
        while to < len(todo) and (to == at or size + todo[to][2] - todo[to][1] < most_chars):
            size += todo[to][2] - todo[to][1]
            to += 1
        w = Words([texts[i][a:b] for i, a, b in todo[at:to]])
        if w.count:
            _read(model, w, marginals(model, w, model.scores(w), pairs=False)[0], todo[at:to], sums, seen, last, out, runs)
        at = to
    for i, total in sums.items():
        found, best = out[i], int(total[:-1].argmax())
        found.lang, found.score = model.languages[best], float(min(1.0, total[best] / total[-1]))
        found.counts = ",".join(f"{model.languages[j]}:{n}" for j, n in sorted(enumerate(seen[i].tolist()), key=lambda x: (-x[1], x[0])) if n)
    return out


def _windows(text: str, size: int) -> list[tuple[int, int]]:
    """Parts of a text of at most about `size` characters, cut where no word is."""
    cuts = [0]
    while len(text) - cuts[-1] > size:
        cut = cuts[-1] + size
        while cut < len(text) and cut - cuts[-1] < 2 * size and text[cut - 1].isalpha() and text[cut].isalpha():
            cut += 1
        cuts.append(cut)
    return list(zip(cuts, [*cuts[1:], len(text)], strict=True))


def _long(model: Model, i: int, text: str, windows: list[tuple[int, int]], sums: dict, seen: dict, last: dict, out: list[Labels], runs: bool) -> None:
    """Labels a text window by window; what is kept between windows is a message each."""
    behind: list[np.ndarray | None] = [None]
    for a, b in reversed(windows[1:]):
        w = Words([text[a:b]])
        if w.count:
            message = _backward(model, w, _emissions(model.scores(w)), behind[-1])[0]
            behind.append(message / message.sum())
        else:
            behind.append(behind[-1])
    before = None
    for a, b in windows:
        w, end = Words([text[a:b]]), behind.pop()
        if not w.count:
            continue
        emit = _emissions(model.scores(w))
        forward = _forward(model, w, emit, before)
        node = forward * _backward(model, w, emit, end) / emit
        before = forward[-1] / forward[-1].sum()
        _read(model, w, node / node.sum(axis=1, keepdims=True), [(i, a, b)], sums, seen, last, out, runs)


def _read(model: Model, w: Words, node: np.ndarray, windows: list[tuple[int, int, int]], sums: dict, seen: dict, last: dict, out: list[Labels], runs: bool) -> None:
    begin = np.flatnonzero(w.restart)
    label = node.argmax(axis=1)
    weighed = np.add.reduceat(np.concatenate([node * w.lengths[:, None], w.lengths[:, None].astype(float)], axis=1), begin, axis=0)
    turned = np.r_[False, label[1:] != label[:-1]]
    turned[begin] = False
    turns = np.add.reduceat(turned.astype(np.int64), begin)
    k, ends = len(model.languages), np.r_[begin[1:], w.count]
    of = np.repeat(np.arange(len(begin)), ends - begin)
    per = np.bincount(of * k + label, minlength=len(begin) * k).reshape(-1, k)
    base = np.cumsum([0, *(b - a + 2 for _, a, b in windows)]) + 2  # where each window's text begins among the characters
    for x, (s, e) in enumerate(zip(begin.tolist(), ends.tolist(), strict=True)):
        i, a, _ = windows[int(w.text[s])]
        sums[i] = sums[i] + weighed[x] if i in sums else weighed[x]
        out[i].switches += int(turns[x]) + int(i in last and last[i] != label[s])
        seen[i] = seen[i] + per[x] if i in seen else per[x]
        last[i] = int(label[e - 1])
        if runs:
            shift = a - int(base[int(w.text[s])])
            cuts = [s, *(np.flatnonzero(turned[s:e]) + s).tolist(), e]
            for p, q in zip(cuts, cuts[1:], strict=False):
                out[i].runs.append((int(w.start[p]) + shift, int(w.end[q - 1]) + shift, model.languages[label[p]], q - p))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 300, longest: int = 20_000) -> Model | None:
    """Trains on a bounded sample: about `per_language` texts of each language, drawn by a hash of the id among rows that are not held
    out and have a language; of a longer text `longest` characters from a place drawn by a hash. Every language of the table is learned."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("id is not null and lang is not null and text is not null and text <> ''").filter(~held_out(F.col("id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    if not counts:
        return None
    share = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000_007)) / 1_000_000_007
    rate = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["n"]))))
    begin = F.pmod(F.xxhash64("id", F.lit(17)), F.greatest(F.length("text") - longest, F.lit(0)) + 1).cast("int") + 1
    drawn = rows.filter(share < rate[F.col("lang")]).select("id", "lang", F.substr("text", begin, F.lit(longest)).alias("text"))
    sample = drawn.orderBy(F.xxhash64("id"), "id", "text").limit(2 * per_language * len(counts)).collect()  # twice what is expected
    sample.sort(key=lambda r: (r["id"], r["text"]))
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


FOUND = "lang_pred string, score double, word_langs string, n_switches long, runs array<struct<start:int,end:int,lang:string,n_words:int>>"


def labelled(df: DataFrame, id_col: str, text_col: str, lang_col: str, runs: bool = False) -> DataFrame:
    """df with a column `found` (FOUND) from text_col alone; only texts go to Python, and only what is found comes back."""
    small_batches(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col, lang_col))  # size: languages x fixed tables

    @F.pandas_udf(FOUND)
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            every = []
            for at in range(0, len(texts), 500):
                every += predict(model.value, ["" if t is None else t for t in texts.iloc[at : at + 500]], runs)
            yield pd.DataFrame({"lang_pred": [x.lang for x in every], "score": [x.score for x in every], "word_langs": [x.counts for x in every], "n_switches": [x.switches for x in every], "runs": [[dict(zip(("start", "end", "lang", "n_words"), r, strict=True)) for r in x.runs] for x in every]})

    return df.withColumn("found", find.asNondeterministic()(F.col(text_col)))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of df: id, held_out, lang_pred, score, and by the labels of its words: word_langs (language:words, most first,
    comma-joined) and n_switches (neighbouring words of different languages).

    Only text is an input of a prediction. Null texts and texts without a letter are `und` with score 0; very long texts are labelled
    whole, as one chain; repeated rows are kept; a null id is neither held out nor learned from; without learnable rows all are `und`; an
    empty table gives an empty result; other columns are ignored.
    """
    thin = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = labelled(thin, "id", "text", "lang").withColumn("held", held_out(F.col("id")))
    return found.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), *(f"found.{c}" for c in ("lang_pred", "score", "word_langs", "n_switches")))


def segments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per run of neighbouring words of one language: id, start, end (code points, end exclusive), lang, n_words.

    Texts without a letter have no runs; else as identify.
    """
    thin = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    runs = labelled(thin, "id", "text", "lang", runs=True).select("id", F.explode("found.runs").alias("run"))
    return runs.select(F.col("id").alias(id_col), "run.start", "run.end", "run.lang", "run.n_words")


def confident(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.35) -> DataFrame:
    """The rows of df whose language is found with a score of at least `least`; columns as they were, the predicted language in
    lang_col. Rejected: null texts, texts without a letter, and texts in which no language holds a share of `least`. Repeated rows are
    judged alike; an empty table gives an empty result."""
    names = df.columns
    safe = df.toDF(*(f"c{i}" for i in range(len(names))))
    col = {name: f"c{i}" for i, name in enumerate(names)}
    found = labelled(safe, col[id_col], col[text_col], col[lang_col])
    found = found.filter((F.col("found.lang_pred") != "und") & (F.col("found.score") >= least))
    return found.select(*(F.col("found.lang_pred" if name == lang_col else c).alias(name) for name, c in col.items()))

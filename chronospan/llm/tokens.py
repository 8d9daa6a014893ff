"""Token counts and token ids of whole texts with a public tokenizer file.

Texts are encoded in Arrow functions. Long texts are cut before a single space that stands between two characters that are
no white space: byte-level BPE with the usual word pattern always starts a word there, so the parts' ids joined are the ids of
the whole. Tokenizers of another kind get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def load(path: str):
    """(function from a list of texts to their lists of ids, whether CUT is safe), once per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one process per core
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1), False
    from tokenizers import Tokenizer

    with open(path) as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    safe = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    safe = safe and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec.get("added_tokens", []))
    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], safe


#: Words of these characters are the same to both libraries' patterns; others, and words with an added token inside, go to `tokenizers`.
PLAIN = r"^[!-~\x{a1}-\x{24f}][\n!-~\x{a1}-\x{24f}]*$"
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # the usual pattern of byte-level tokenizers


@lru_cache(maxsize=4)
def ranked(path: str):
    """(the same vocabulary for tiktoken, whether the token of an id begins with a space, the added tokens), or None if the file's
    merges are not in the order of their ids. tiktoken needs a quarter of the time for words not met before."""
    import numpy as np
    import tiktoken

    with open(path) as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = [t["content"] for t in spec.get("added_tokens", [])]
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if made != sorted(made) or spec["model"].get("ignore_merges") or not set(map(chr, shown)) <= vocabulary.keys():
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in added}
    opens = np.zeros(max(vocabulary.values()) + 4096, bool)
    opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), opens, added


def segments(text: str, size: int) -> Iterator[str]:
    """The text in parts of at least `size` characters, cut at the next safe boundary."""
    at = 0
    while len(text) - at > size and (m := CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _batches(parts: Iterable[tuple[int, str]], batch_bytes: int) -> Iterator[list[tuple[int, str]]]:
    batch, size = [], 0
    for part in parts:
        batch.append(part)
        size += len(part[1].encode()) + 16
        if size >= batch_bytes:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, segment: int = 1 << 15, batch: int = 1 << 22) -> DataFrame:
    """One row per row of df: id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Only lengths leave the Arrow function. Batches are filled up to `batch` bytes whatever the number of texts, and texts
    over `segment` characters are cut at safe boundaries, so memory does not depend on the longest text's token count. Where
    such boundaries exist, each distinct word of a batch is encoded once.
    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are kept as they are; an empty table gives an
    empty result; other columns are ignored.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = TextIds(path)
        encode, safe = ids_of.encode, ids_of.safe
        for rows in it:
            texts = rows.column(1)
            counts = [0] * rows.num_rows
            parts = ((i, s) for i, t in enumerate(texts) if (x := t.as_py()) for s in (segments(x, segment) if safe else [x]))
            for group in _batches(parts, batch):
                own = [s for _, s in group]
                sizes = (len(ids) // 4 for ids in ids_of(pa.array(own, pa.string()))) if safe else map(len, encode(own))
                for (i, _), n in zip(group, sizes, strict=True):
                    counts[i] += n
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.octet_length(F.col(text_col)).cast("long"), F.lit(0).cast("long"))
    thin = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), size.alias("n_bytes"))
    return thin.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


class TextIds:
    """Ids of whole texts as little-endian uint32 bytes.

    Words are the parts between the spaces that stand before something other than white space. Arrow splits a block of texts and numbers
    its distinct words, each of them is encoded once, and a `take` of their ids gives the ids of the texts. A space before other white
    space is no boundary: the parts around it are one word. Nothing is kept between blocks.
    """

    def __init__(self, path: str):
        self.encode, self.safe = load(path)
        self.fast = ranked(path) if self.safe else None

    def _each(self, texts: list[str]) -> pa.Array:
        import numpy as np

        found = (np.asarray(ids, "<u4").tobytes() for at in range(0, len(texts), 2048) for ids in self.encode(texts[at : at + 2048]))
        return pa.array(found, pa.large_binary())

    def _spaced(self, words: pa.Array) -> pa.Array:
        """The ids of plain words, each behind a space."""
        import numpy as np

        if not len(words):
            return pa.array([], pa.large_binary())
        encoding, opens, _ = self.fast
        # Encoded joined: the one token with a leading space opens each word.
        ids = np.asarray(encoding.encode_to_numpy(" " + " ".join(words.to_pylist()), disallowed_special=()), "<u4")
        cuts = np.flatnonzero(opens[ids])
        if len(cuts) != len(words):
            return self._each([" " + w for w in words.to_pylist()])
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(4 * np.r_[cuts, len(ids)].astype(np.int64)), pa.py_buffer(ids)])

    def _joined(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of texts that are not null."""
        import numpy as np

        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        begins = ends[:-1]
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        plain = pc.match_substring_regex(words, PLAIN) if self.fast else pa.array(np.zeros(len(words), bool))
        for added in self.fast[2] if self.fast else ():
            plain = pc.and_not(plain, pc.match_substring(words, added))
        plain = plain.to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(~plain)
        odd_words = words.take(pa.array(odd)).to_pylist()
        hangs = np.fromiter((not w or w[0].isspace() for w in odd_words), bool, len(odd_words))
        glue, table = np.zeros(len(words), bool), np.empty(len(words), np.int64)
        glue[odd] = hangs
        table[plain], table[odd] = np.arange(plain.sum()), plain.sum() + np.arange(len(odd))
        data = [self._spaced(words.filter(pa.array(plain))), self._each(["" if h else " " + w for w, h in zip(odd_words, hangs, strict=True)])]
        size, place, hung = len(words), table[index], glue[index]
        hung[begins] = False
        heads = words.take(pa.array(index[begins])).to_pylist()
        if hung.any():  # a run of parts that hang on the part before them is one word with it
            runs = np.flatnonzero(np.diff(np.r_[False, hung, False]))
            at_head = dict(zip(begins.tolist(), range(len(begins)), strict=True))
            places, merged = [], []
            for a, b in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
                word = " ".join(words.take(pa.array(index[a - 1 : b])).to_pylist())
                if (head := at_head.get(a - 1)) is not None:
                    heads[head] = word
                else:
                    places.append(a - 1)
                    merged.append(" " + word)
            place[places] = size + np.arange(len(places))
            size += len(places)
            data.append(self._each(merged))
        place[begins] = size + np.arange(len(begins))
        data.append(self._each(heads))
        if hung.any():
            ends = np.r_[0, np.cumsum(~hung)][ends]
            place = place[~hung]
        taken = pa.concat_arrays(data).take(pa.array(place))
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[ends].tolist()
        whole = memoryview(taken.buffers()[2] or b"")
        for a, b in zip(offsets, offsets[1:], strict=False):
            yield bytes(whole[a:b])

    def __call__(self, texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[bytes]:
        """The ids of each text, in blocks of about most_bytes of text; none for null."""
        import numpy as np

        texts = texts.fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes)))
            block = texts.slice(at, to - at)
            yield from self._joined(block) if self.safe else (x.as_py() for x in self._each(block.to_pylist()))
            at = to

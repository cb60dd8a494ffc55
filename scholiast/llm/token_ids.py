"""Token ids of whole texts by a given tokenizer, each distinct word encoded once, written as binary files.

White space separates what the tokenizer sees: its normalisers and its splitting never look across a space, nor
do they where ASCII letters, digits and other characters meet, so the ids of a text are those of its pieces in order. Each worker keeps the ids of the words it has met (up
to a fixed number, the frequent ones longest), and a text is a gather from them. That holds for tokenizers of one pattern, which
`splits_at_space` checks; others encode each text as a whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholiast.llm.token_files import write_ids
from scholiast.llm.tokens import blocks, runs_at, spans, white, word_strings

#: Words whose ids a worker keeps; beyond them it forgets the half that it met least often. Bytes of texts that it looks at together.
KNOWN_WORDS, TEXT_BYTES = 1 << 18, 1 << 21
#: Kinds of bytes: letters, digits and other visible ones of ASCII, and 0 for the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1
_KIND[ord("0") : ord("9") + 1] = 2
# fixed value: the pattern of pre-tokens that words_of goes by
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces that the normalisers and the splitting leave as they are, and what the byte-level step makes of their bytes: visible ones of Latin 1 stand for themselves, the others, in order, for the characters from 256 on.
_PLAIN = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\\[-`{-~]+")
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPELT = dict(zip((b for b in range(256) if b not in _VISIBLE), itertools.count(256)))


def splits_at_space(tokenizer: str) -> bool:
    """Whether a tokenizer lower-cases, drops white space and cuts words as `words_of` does before anything else can join them."""
    known = json.loads(tokenizer)
    first, *others = (known.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    steps = [n.get("type") for n in (known.get("normalizer") or {}).get("normalizers", [])]
    return steps == ["NFC", "Replace", "Lowercase"] and [o.get("type") for o in others] == ["ByteLevel"] and first.get("type") == "Split" and first.get("invert") is True and (first.get("pattern") or {}).get("Regex") == _PATTERN


class _Encoder:
    """Ids of words, each encoded once."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(tokenizer)
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)  # where each known word's ids begin; one more than words
        self.met = np.zeros(0, np.int64)

    def encoded(self, texts: list[str]) -> list[list[int]]:
        parts = (texts[i : i + 4096] for i in range(0, len(texts), 4096))
        return [e.ids for part in parts for e in self.model.encode_batch_fast(part, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of some pieces of words: plain ones go straight to the model."""
        rest = iter(self.encoded([w for w in words if not _PLAIN.fullmatch(w)]))
        tokenize = self.model.model.tokenize
        for word in words:
            if not _PLAIN.fullmatch(word):
                yield next(rest)
            else:
                spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_SPELT)
                yield [t.id for t in tokenize(spelt)]

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.met, kind="stable")[: KNOWN_WORDS // 2])
        words = list(self.known)
        self.known = {words[i]: n for n, i in enumerate(kept.tolist())}
        sizes = np.diff(self.at)[kept]
        self.ids = self.ids[runs_at(self.at[kept], sizes)]
        self.at = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        self.met = self.met[kept] // 2

    def numbers(self, words: list[str]) -> np.ndarray:
        """The known number of each of some distinct words."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        if new := [w for w in words if w not in self.known]:
            lists = list(self._pieces(new))
            self.known.update(zip(new, itertools.count(len(self.known))))
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(lists), np.uint32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.met[found] += 1
        return found


@functools.lru_cache(1)
def _encoder(tokenizer: str) -> _Encoder:
    return _Encoder(tokenizer)


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, number of the first word of each row plus the total): what stands between white space, cut further into runs of letters, single digits and runs of other characters.

    Such a cut is made between two ASCII characters only, so no mark is parted from its letter, and not in words with an apostrophe, which
    the pattern may join with letters, or with `<|`, which may begin a special token. There capitals stay too; elsewhere those that an ASCII
    character or the word's end follows become small, as the tokenizer would make them.
    """
    n, gap = len(raw), white(raw)
    first, ends, _ = spans(raw, at, gap)
    odd = raw == ord("'")
    odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    whole = np.zeros(len(first), bool)
    whole[np.searchsorted(first, np.flatnonzero(odd), "right") - 1] = True
    loose = np.repeat(~whole, ends - first)  # for the bytes of words, one after another
    kind = _KIND[raw]
    cut = np.zeros(n, bool)
    cut[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    cut[~gap] &= loose
    cut[first] = True
    followed = np.zeros(n, bool)
    followed[:-1] = raw[1:] >= 0x80
    capital = (raw >= ord("A")) & (raw <= ord("Z")) & ~followed
    capital[~gap] &= loose
    first = np.flatnonzero(cut)
    ends = np.append(np.minimum(first[1:], ends[np.searchsorted(ends, first[:-1], "right")]), ends[-1:])
    return word_strings(np.where(capital, raw + np.uint8(32), raw), first, ends, gap), np.searchsorted(first, at)


def _binary(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * 4
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])


def token_ids(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text as little-endian unsigned 32-bit numbers, with `end_id` after them if given.

    `tokenizer` is the JSON of a tokenizer of the tokenizers library; special tokens are neither added nor, where
    a text spells one, treated otherwise than the library does. Null texts are empty. Rows, their order and their
    partitions stay as they are; doc_id is made a long, other columns aren't looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, splits_at_space(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by_word = shared.value
        encoder = _encoder(known)
        ends = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        for batch in batches:
            for first, end, raw, at in blocks(batch.column("text"), TEXT_BYTES):
                if by_word:
                    words, row_at = words_of(raw, at)
                    coded = words.dictionary_encode()
                    numbers = encoder.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                    begins, sizes = encoder.at[numbers], encoder.at[numbers + 1] - encoder.at[numbers]
                    ids = encoder.ids[runs_at(begins, sizes)]
                    of_row = np.concatenate([[0], np.cumsum(sizes)])[row_at]
                else:
                    lists = encoder.encoded(batch.column("text").slice(first, end - first).fill_null("").to_pylist())
                    ids = np.array([i for x in lists for i in x], np.uint32)
                    of_row = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                if len(ends):
                    ids = np.insert(ids, of_row[1:], ends[0])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), _binary(ids, np.diff(of_row) + len(ends))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_bytes: int = 2, overwrite: bool = False, **options: int) -> None:
    """Encodes every text of `docs` (doc_id, text) and writes token files in ascending order of doc_id; `tokenizer` is a path on the driver.

    Rows without a doc_id come first; rows of one doc_id are in order of their texts' hashes, so equal runs write
    equal files, and repeated rows stand side by side. An empty table gives no file but a listing of none. Ranges
    are cut by doc_id, text hash and row, so that no doc_id, however often repeated, has to fit in one task. Texts
    are sorted before they are encoded: that moves them once, and tasks write what they encode.
    """
    with open(tokenizer, encoding="utf-8") as file:
        model = file.read()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash")
    write_ids(token_ids(ordered, model, end_id), path, id_bytes, overwrite, **options)

"""Encoding a corpus with a public byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be joined by
a merge, so a cut between its bytes is certain. A cut is taken where the pair is
such a one *and* the tokenizer's pre-splitting cannot look across it:

* a character that is no white space, then a blank: a pre-token always ends there and
  its pattern never looks back. ASCII, and all longer characters but those with a lead
  byte under which some white space lies;
* between two letters of one script written without blanks, that is two CJK ideographs,
  two Hangul syllables or two kana: both lie in one run of letters, and a run of letters
  is split by merges alone.

Where neither occurs (a long run of ASCII letters, say) no cut is certain.

The fragments are encoded independently and the ids are joined. Cutting is done on the whole batch's bytes at once.

Semantics: null and empty text give an empty list; strings that look like
special tokens are ordinary text; whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-splitting pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of which at most one fragment begins in each.
BLOCK = 512
_LOADED: dict[str, ForcedBoundaryEncoder] = {}


class ForcedBoundaryEncoder:
    """Encodes batches of texts with the ranks of a ``.tiktoken`` file."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros(65536, dtype=bool)
        joined = np.frombuffer(b"".join(ranks), dtype=np.uint8).astype(np.uint16)
        ends = np.cumsum([len(x) for x in ranks]) - 1
        pairs = joined[:-1] * 256 + joined[1:]
        within = np.ones(len(pairs), dtype=bool)
        within[ends[:-1]] = False
        inside[pairs[within]] = True
        self.never = ~inside
        byte = np.arange(256)
        solid = (byte > 0x20) & (byte < 0x7F)
        self.before_blank = np.zeros(65536, dtype=bool)
        self.before_blank[np.flatnonzero(solid) * 256 + 0x20] = True
        self.before_blank &= self.never

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions in UTF-8 bytes at which a cut is certain."""
        if len(data) < 2:
            return np.zeros(0, dtype=np.int64)
        pairs = data[:-1].astype(np.uint16) * 256 + data[1:]
        certain = self.before_blank[pairs]
        if not (data >= 0x80).any():
            return np.flatnonzero(certain) + 1
        # the end of a longer character, then a blank; white space has lead bytes C2 and E1 to E3
        ends = (data[:-1] >= 0x80) & (data[1:] == 0x20)
        for back, leads in ((1, (0xC2,)), (2, (0xE1, 0xE2, 0xE3))):
            for byte in leads:
                ends[back:] &= data[: -1 - back] != byte
        certain |= ends & self.never[pairs]
        # lead bytes E5..E9: U+5000 to U+9FFF, ideographs throughout
        # EB and EC: U+B000 to U+CFFF, Hangul syllables throughout
        # E3 81 81 to E3 81 BF and E3 83 80 to E3 83 BA: kana
        kana = np.zeros(len(data), dtype=bool)
        kana[:-2] = (data[:-2] == 0xE3) & (((data[1:-1] == 0x81) & (data[2:] > 0x80)) | ((data[1:-1] == 0x83) & (data[2:] <= 0xBA)))
        for lead in ((data >= 0xE5) & (data <= 0xE9), (data == 0xEB) | (data == 0xEC), kana):
            if lead.any():
                both = np.zeros(len(pairs), dtype=bool)
                both[2:] = lead[:-3] & lead[3:]
                certain |= both & self.never[pairs]
        return np.flatnonzero(certain) + 1

    def encode_batch(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that lie one behind another in ``data``: (all ids, ends by text).

        Of the certain cuts the first in every ``BLOCK`` bytes is used, which
        bounds the work on a fragment however long the text is.
        """
        certain = self.cuts(np.frombuffer(data, dtype=np.uint8))
        if len(certain):
            certain = certain[np.flatnonzero(np.diff(certain // BLOCK, prepend=-1))]
        edges = np.union1d(certain, offsets)
        bounds = edges.tolist()
        encode = self.encoding.encode_to_numpy
        coded = [encode(str(data[a:b], "utf-8", "replace"), disallowed_special=()) for a, b in zip(bounds, bounds[1:])]
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        ids = np.concatenate(coded).astype(np.int32) if coded else np.zeros(0, np.int32)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[np.searchsorted(edges, offsets)]


def encoder(path: str) -> ForcedBoundaryEncoder:
    """One encoder a process and file."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryEncoder(path)
    return _LOADED[path]


def _buffers(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """Bytes of a string array, nulls as empty, and n + 1 offsets."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start, end = int(offsets[0]), int(offsets[-1])
    return (data.slice(start, end - start).to_pybytes() if data is not None and end > start else b""), offsets - start


def tokenizer_file(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or DEFAULT_TOKENIZERS, f"{name}.tiktoken")


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``key`` and ``ids ARRAY<INT>`` of every row of ``df``; no shuffle."""
    path = tokenizer_file(tokenizer, folder)
    rows = df.select(F.col(key), F.col(text).alias("__text"))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _buffers(batch.column(1))
            ids, ends = code.encode_batch(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The columns ``keys`` and ``tokens BIGINT``; ids never leave the worker."""
    path = tokenizer_file(tokenizer, folder)
    kinds = dict(df.dtypes)
    rows = df.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            if batch.num_rows:
                data, offsets = _buffers(batch.column(len(keys)))
                _, ends = code.encode_batch(data, offsets)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(np.diff(ends), pa.int64())], names=[*keys, "tokens"])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", tokens bigint")



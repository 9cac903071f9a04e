"""Byte-level BPE by forced boundaries: a text is cut where no piece of the vocabulary can join two bytes.

A merge gives a piece of the vocabulary, so two neighbouring bytes that stand in no piece one behind the other are
never in one id: between them is a certain cut, whatever else the text holds. The fragments between cuts are encoded
by themselves, each different one once, and their ids concatenated are the text's. Of those cuts the ones are taken
that the splitter into words (fixed pattern of the byte-level scheme) can't notice: it reads from the left and looks
ahead behind white space only, so no cut stands behind white space, or before an apostrophe that a word's ending may
begin with.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.llm.common import hold, slices, texts

#: Fragments, and their bytes, that a Python worker remembers; past either, it forgets all and begins anew.
REMEMBERED, REMEMBERED_BYTES = 500_000, 16_000_000
#: Fragments that one call encodes.
TOGETHER = 16_384
#: White space beyond ASCII, in UTF-8.
ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SCHEMA = "doc_id long, text_hash long, n_tokens long, packed binary, decoded string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: printable ones for themselves, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class _Numbered(dict):
    """Fragments by the order in which they came; the new ones are listed, too."""

    new: list[bytes]

    def __missing__(self, fragment: bytes) -> int:
        n = self[fragment] = len(self)
        self.new.append(fragment)
        return n


class ByteBpe:
    """Encodes and decodes by one file of the tokenizers library.

    Only plain byte-level BPE can be cut this way; files with a normaliser, another splitter, dropout, affixes, or added
    tokens that touch their neighbours are refused."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = byte_letters()
        pieces = {i: bytes(letters[c] for c in p) if all(c in letters for c in p) else p.encode() for p, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.size = np.zeros(max(pieces) + 1, dtype=np.int64)
        self.size[list(pieces)] = [len(p) for p in pieces.values()]
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces[i] for i in sorted(pieces)), dtype=np.uint8)
        self.cuts = self._cuts(list(pieces.values()))
        added = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.forget()

    @staticmethod
    def _check(spec: dict) -> None:
        model, split, decoder = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "fuse_unk", "ignore_merges") if model.get(k)]
        plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and decoder.get("type") == "ByteLevel"
        flagged = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if odd or not plain or spec["normalizer"] or flagged:
            raise ValueError("forced boundaries need plain byte-level BPE, without a normaliser or options that join words")

    @staticmethod
    def _cuts(pieces: list[bytes]) -> np.ndarray:
        """Whether there is a certain cut between two bytes, at 256 * left + right."""
        cuts = np.ones((256, 256), dtype=bool)
        flat, ends = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum([len(p) for p in pieces])
        inside = np.ones(len(flat), dtype=bool)
        inside[ends[ends > 0] - 1] = False
        at = np.flatnonzero(inside)
        cuts[flat[at], flat[at + 1]] = False
        cuts[:, 0x80:0xC0] = False  # inside a character
        cuts[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = False  # behind white space
        lettered = [c for c in range(128) if chr(c).isalnum()]
        cuts[[c for c in range(256) if c not in lettered], ord("'")] = False
        return cuts.reshape(-1)

    def forget(self) -> None:
        self.at, self.held = _Numbered(), 0
        self.at.new = []
        self.ids = np.zeros(1 << 20, dtype=np.int32)
        self.start = np.zeros(1 << 16, dtype=np.int64)

    def boundaries(self, raw: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts one behind the other, where fragments begin and end there, and where texts do."""
        data, ends = b"".join(raw), np.cumsum([0, *(len(r) for r in raw)])
        buf = np.frombuffer(data, dtype=np.uint8)
        cut = np.zeros(len(buf) + 1, dtype=bool)
        if len(buf) > 1:
            cut[1:-1] = self.cuts[buf[:-1].astype(np.int32) << 8 | buf[1:]]
        for m in ODD_SPACE.finditer(data):
            cut[m.end()] = False
        for r, first in zip(raw if self.added else (), ends[:-1].tolist(), strict=False):
            for m in self.added.finditer(r):  # an added token is one fragment
                cut[first + m.start() : first + m.end()] = False
                cut[[first + m.start(), first + m.end()]] = True
        cut[ends] = True
        return data, np.flatnonzero(cut), ends

    def _learn(self) -> None:
        fragments, self.at.new = self.at.new, []
        for k in range(0, len(fragments), TOGETHER):
            some = fragments[k : k + TOGETHER]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([f.decode() for f in some], add_special_tokens=False)]
            flat, sizes = np.fromiter((i for ids in found for i in ids), dtype=np.int32), np.array([len(ids) for ids in found], dtype=np.int64)
            n = len(self.at) - len(fragments) + k
            to = int(self.start[n])
            while to + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(sizes) + 1 > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.ids[to : to + len(flat)] = flat
            self.start[n + 1 : n + 1 + len(sizes)] = to + np.cumsum(sizes)
        self.held += sum(map(len, fragments))

    def encode(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where each text's begin and end there."""
        if len(self.at) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.forget()
        data, at, ends = self.boundaries([v.encode(errors="replace") for v in values])
        places = at.tolist()
        numbers = np.fromiter((self.at[data[a:b]] for a, b in zip(places[:-1], places[1:], strict=True)), dtype=np.int64, count=len(places) - 1)
        self._learn()
        begin = self.start[numbers]
        size = self.start[numbers + 1] - begin
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - upto[:-1], size) + np.arange(int(upto[-1]))]
        return ids, upto[np.searchsorted(at, ends)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become U+FFFD, and ids beyond the vocabulary nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.size)), ids, -1).astype(np.int64)
        size = np.where(ids < 0, 0, self.size[ids])
        upto = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.repeat(self.begin[ids] - upto[:-1], size) + np.arange(int(upto[-1]))].tobytes()
        at = upto[ends].tolist()
        return [data[a:b].decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]


_held: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    hold("byte_bpe", _held.clear)
    if path not in _held:
        _held[path] = ByteBpe(path)
    return _held[path]


def encode_bpe(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text_hash, n_tokens, packed, decoded for every row of docs: its ids as little-endian unsigned 32-bit
    integers, without special tokens around them, and the text that they decode to.

    docs: doc_id and text; other columns don't matter. A null text is the empty text, which has no ids. Strings of added
    tokens in a text become those, as the library takes them. Null ids and repeated rows each keep their row; an empty table
    gives none. Texts of any length are taken whole: what is held for one is a small multiple of its bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for b in slices(batches, "text"):
            ids, ends = bpe.encode(texts(b))
            decoded, raw = bpe.decode(ids, ends), memoryview(ids.astype("<u4")).cast("B")
            packed = [bytes(raw[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(np.diff(ends)), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "text_hash", "n_tokens", "packed", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(encode, SCHEMA)


def decode_bpe(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, decoded for rows (doc_id, packed): what the ids stand for. Null is no ids; bytes behind the last whole id are left out."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for b in slices(batches, "packed"):
            packed = [p or b"" for p in b.column("packed").to_pylist()]
            whole = [p[: len(p) // 4 * 4] for p in packed]
            ids = np.frombuffer(b"".join(whole), dtype="<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bpe.decode(ids, np.cumsum([0, *(len(w) // 4 for w in whole)])), pa.string())], ["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "packed").mapInArrow(decode, "doc_id long, decoded string")

"""Token ids in ORC files, in ascending order of the document id.

The ids of each document are one list column: ORC packs it with its integer run-length encoding, in
stripes that tasks read by themselves; row indexes and a Bloom filter on doc_id let a lookup skip
stripes and row groups by metadata only.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.llm.common import hold, slices

#: Words, and their characters, that a Python worker remembers; past either, it forgets all and begins anew.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 32_000_000
STRIPE_BYTES = 16 << 20
#: Beyond these characters case and composition depend on neighbours; such texts keep their words as they are.
UNUSUAL = re.compile("[^\x00-\u0245]|<\\|")
#: Marks between a letter and white space stand alone for the tokenizer; an apostrophe may not.
MARKS = re.compile("(?<=[a-zß-öø-ȳ])([!-&(-/:-@\\[-`{-~]+)(?=[ \n]|$)")


#: Fixed value: the splitter of files that can be encoded word by word.
WORD_SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Text bytes of a range of ids, which one task sorts, encodes and writes.
RANGE_BYTES = 256 << 20


def goes_by_words(spec: dict) -> bool:
    """Whether a tokenizer's file says that a text's ids are its words' ids one after the other: white space is dropped, letters
    are composed and lower-cased and nothing else, and no piece goes on from one word into the next."""
    flat = lambda x, key: [y for z in x.get(key, []) for y in flat(z, key)] if x and x.get("type") == "Sequence" else [x]
    normal, split = flat(spec["normalizer"], "normalizers"), flat(spec["pre_tokenizer"], "pretokenizers")
    kinds = [n and n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
    words = [s and s["type"] for s in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": WORD_SPLITS} and split[0]["behavior"] == "Removed" and split[0]["invert"]
    bytes_only = words and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
    added = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    return bool(kinds and bytes_only and added and spec["model"].get("end_of_word_suffix") == "</w>" and not spec["model"].get("dropout"))


class _Numbered(dict):
    """Words by the order in which they came; the new ones are listed, too."""

    new: list[str]

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class _WordIds:
    """Encodes texts word by word, each different word once, where the tokenizer's file allows it (goes_by_words): it
    drops white space, lower-cases, and never merges across white space or from a letter to a mark, so a text's ids are
    its words' ids one after the other. With any other file texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.by_words = goes_by_words(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.at, self.chars = _Numbered(), 0
        self.at.new = []
        self.ids = np.zeros(1 << 20, dtype=np.int32)
        self.start = np.zeros(1 << 16, dtype=np.int64)

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def sizes_and_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, many words of letters only to a text: each of those ends where its last piece does."""
        lettered = [w.isalpha() for w in words]
        plain = [w for w, x in zip(words, lettered, strict=True) if x]
        joined = self.encoded([" ".join(plain[k : k + 256]) for k in range(0, len(plain), 256)])
        flat = np.fromiter(chain.from_iterable(joined), dtype=np.int32)
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) != len(plain):
            found = self.encoded(words)
            return np.array([len(x) for x in found], dtype=np.int64), np.fromiter(chain.from_iterable(found), dtype=np.int32)
        rest = self.encoded([w for w, x in zip(words, lettered, strict=True) if not x])
        x = np.array(lettered, dtype=bool)
        sizes = np.empty(len(words), dtype=np.int64)
        sizes[x] = np.diff(ends, prepend=0)
        sizes[~x] = [len(r) for r in rest]
        ids, of_plain = np.empty(int(sizes.sum()), dtype=np.int32), np.repeat(x, sizes)
        ids[of_plain] = flat
        ids[~of_plain] = np.fromiter(chain.from_iterable(rest), dtype=np.int32)
        return sizes, ids

    def learn(self) -> None:
        words, self.at.new = self.at.new, []
        for k in range(0, len(words), 16_384):
            sizes, flat = self.sizes_and_ids(words[k : k + 16_384])
            n = len(self.at) - len(words) + k
            to = int(self.start[n])
            while to + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(sizes) + 1 > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.ids[to : to + len(flat)] = flat
            self.start[n + 1 : n + 1 + len(sizes)] = to + np.cumsum(sizes)
        self.chars += sum(map(len, words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and the ids of all."""
        if not self.by_words:
            found = self.encoded(texts)
            return np.array([len(x) for x in found], dtype=np.int64), np.fromiter(chain.from_iterable(found), dtype=np.int32)
        if len(self.at) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        words = [(t if UNUSUAL.search(t) else MARKS.sub(r" \1", t.lower())).replace("\n", " ").split(" ") for t in texts]
        n_words = np.array([len(ws) for ws in words])
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(n_words.sum()))
        self.learn()
        begin = self.start[at]
        size = self.start[at + 1] - begin
        before = np.cumsum(size) - size
        ids = self.ids[np.repeat(begin - before, size) + np.arange(int(size.sum()))]
        return np.add.reduceat(size, np.cumsum(n_words) - n_words), ids


_held: dict[str, _WordIds] = {}


def _word_ids(path: str) -> _WordIds:
    hold("token_files", _held.clear)
    if path not in _held:
        _held[path] = _WordIds(path)
    return _held[path]


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for b in slices(batches, "text"):
            n, found = words.encode([t or "" for t in b.column("text").to_pylist()])
            sizes = n + 1
            ends = np.cumsum(sizes)
            flat = np.empty(int(ends[-1]), dtype=np.int32)
            of_text = np.ones(len(flat), dtype=bool)
            of_text[ends - 1] = False
            flat[of_text], flat[ends - 1] = found, end_id
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), b.column("n"), pa.array(sizes), ids], ["part", "doc_id", "n", "n_tokens", "ids"])

    return encode


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = ids.offsets.to_numpy()
        crc = [zlib.crc32(memoryview(flat[s:e])) for s, e in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("n"), b.column("doc_id"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["part", "n", "doc_id", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, partitions: int | None = None) -> None:
    """Writes each document's ids, with end_id after them, as ORC files at path.

    docs: doc_id and text; other columns don't matter. A null text is the empty text: one id, the
    end. Null ids come first; rows with the same id stand in the order of their texts. Each file is one
    range of ids (part), in order (n: place in it), so files in the order of part are the table in
    the order of doc_id. An empty table gives files without rows, or none. There are as many ranges as shuffle partitions, or
    as many more as the texts have RANGE_BYTES.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = partitions
    if not n:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    # the hash in the range key deals out rows with one id, too; rows alike in both are the same text
    dealt = rows.repartitionByRange(n, order[0], order[1]).sortWithinPartitions(*order)
    numbered = dealt.withColumn("at", F.monotonically_increasing_id()).select(
        F.shiftright("at", 33).cast("int").alias("part"), "doc_id", F.expr("at & 8589934591").alias("n"), "text"
    )
    ids = numbered.mapInArrow(_encode(tokenizer, end_id), "part int, doc_id long, n long, n_tokens long, ids array<int>")
    (
        ids.write.option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", 10_000).option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).option("compression", "zstd").orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, n, n_tokens, ids of the files at path; filters on doc_id skip stripes by their
    indexes and Bloom filters."""
    return spark.read.schema("part int, doc_id long, n long, n_tokens long, ids array<int>").orc(path)


def token_ranges(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: where each document's ids start in the
    table's order, how many there are, and their checksum.

    The sum before a file is summed over one row a file; inside a file, over its own rows.
    """
    files = read_token_files(spark, path)
    found = files.mapInArrow(_checksums, "part int, n long, doc_id long, n_tokens long, ids_crc32 long")
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return (
        found.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(offsets, "part")
        .select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )

"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of shards, bounded runs of documents: a shard's row has its terms, and for each term the
documents and positions where it stands. Tasks search shards by themselves, so nothing is shuffled, and one index
serves any number of searches. A search takes the terms of phrases from the rarest on, moves each posting list
back by the term's place in the phrase, and intersects, for all phrases of a shard at once; what is left are the
phrases' starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townhall.llm.common import fresh_path, materialize, slices

WINDOW = 13
#: Text bytes of a shard, and shards of a row group, which a reader holds whole.
SHARD_BYTES, GROUP_SHARDS = 1 << 20, 16
#: Words of benchmark items that one search holds; a larger benchmark is searched in blocks of items.
BLOCK_WORDS = 500_000
#: Starts that a search follows at a time.
TOGETHER = 1 << 20
INDEX_SCHEMA = "shard string, ids array<long>, hashes array<long>, lengths array<int>, terms array<binary>, starts array<int>, docs array<int>, positions array<int>"
#: Bytes as words hold them: A-Z in lower case, and blanks for all that isn't a word's.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8: runs of digits, letters, and characters beyond ASCII; A-Z in lower case."""
    return (text or "").encode(errors="replace").translate(_FOLD).split()


class _Numbers(dict):
    """Terms by number, in the order of their first place."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype=np.int32)), pa.array(values))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    for b in slices(batches, "text", SHARD_BYTES):
        terms, found, lengths = _Numbers(), [], []
        for text in b.column("text").to_pylist():
            ws = words_of(text)
            lengths.append(len(ws))
            found.append(np.fromiter(map(terms.__getitem__, ws), dtype=np.int32, count=len(ws)))
        at, size = np.concatenate(found), np.array(lengths, dtype=np.int64)
        order = np.argsort(at, kind="stable")
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        place = (np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(terms)))])
        one = lambda values: _lists(np.array([0, len(values)]), values)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{task}-{number}"]),
                pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("doc_id")),
                pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("text_hash")),
                one(size.astype(np.int32)),
                pa.array([list(terms)], pa.list_(pa.binary())),
                one(starts.astype(np.int32)),
                one(doc[order]),
                one(place[order]),
            ],
            ["shard", "ids", "hashes", "lengths", "terms", "starts", "docs", "positions"],
        )
        number += 1


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Writes the positional index of docs (doc_id, text) at path, with all terms, and returns it as a table.

    A null text has no words; its document is listed all the same. Null ids and repeated rows each stay a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows.mapInArrow(_index, INDEX_SCHEMA).write.option("parquet.block.row.count.limit", GROUP_SHARDS).parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


class Shard:
    """A shard's posting lists. Its documents stand one after the other with a gap behind each, so that a place is
    one number and no phrase goes on into the next document."""

    def __init__(self, row: dict, gap: int = WINDOW):
        self.ids, self.hashes = row["ids"], row["hashes"]
        self.lengths = np.asarray(row["lengths"], dtype=np.int64)
        room = self.lengths + gap
        self.first = np.cumsum(room) - room
        self.terms: list[bytes] = row["terms"]
        self.starts = np.asarray(row["starts"], dtype=np.int64)
        docs = np.asarray(row["docs"], dtype=np.int64)
        self.places = self.first[docs] + np.asarray(row["positions"], dtype=np.int64) if len(docs) else np.zeros(0, np.int64)
        self.size = int(room.sum()) + gap
        # sorted by term and place: a posting of any list is one number, too
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * self.size + self.places

    def numbers(self, of: dict[bytes, int], n: int) -> np.ndarray:
        """For each of n terms, numbered by `of`, its place among the shard's terms, or -1."""
        found = np.fromiter(map(of.get, self.terms, repeat(-1)), dtype=np.int64, count=len(self.terms))
        out = np.full(n, -1)
        there = np.flatnonzero(found >= 0)
        out[found[there]] = there
        return out

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """phrase, start of every occurrence of phrases: rows of places among the shard's terms, -1 behind the end of
        short ones and -2 for terms that aren't there."""
        able = np.flatnonzero((windows > -2).all(1) & (windows[:, 0] >= 0)) if windows.size else np.zeros(0, np.int64)
        w = windows[able]
        count = np.where(w < 0, np.iinfo(np.int64).max, np.diff(self.starts)[w]) if len(w) else w
        order = np.argsort(count, axis=1, kind="stable")
        rarest = count[np.arange(len(w)), order[:, 0]] if len(w) else np.zeros(0, np.int64)
        ends, begin = np.cumsum(rarest), 0
        while begin < len(w):
            until = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TOGETHER, side="right")))
            some = np.arange(begin, until)
            n, k = rarest[some], order[some, 0]
            of, row = np.repeat(some, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = self.places[np.repeat(self.starts[w[some, k]], n) + row] - np.repeat(k, n)
            for j in range(1, w.shape[1]):
                k = order[of, j]
                term = w[of, k]
                keys = term * self.size + at + k
                found = np.searchsorted(self.keys, keys)
                ok = (term < 0) | ((at >= 0) & (self.keys[np.minimum(found, len(self.keys) - 1)] == keys))
                of, at = of[ok], at[ok]
                if not len(of):
                    break
            yield able[of], at
            begin = until

    def phrase(self, words: list[bytes]) -> np.ndarray:
        """The starts of one exact phrase."""
        different = list(dict.fromkeys(words))
        there = self.numbers({w: i for i, w in enumerate(different)}, len(different))
        row = there[[different.index(w) for w in words]] if words else np.zeros(0, np.int64)
        return np.sort(np.concatenate([at for _, at in self.phrases(np.where(row < 0, -2, row)[None, :])] or [np.zeros(0, np.int64)]))

    def near(self, words: list[bytes], within: int) -> np.ndarray:
        """Places of the rarest term that have every other term within so many words, in the same document."""
        different = list(dict.fromkeys(words))
        there = self.numbers({w: i for i, w in enumerate(different)}, len(different))
        if not len(there) or (there < 0).any():
            return np.zeros(0, dtype=np.int64)
        lists = sorted((self.places[self.starts[t] : self.starts[t + 1]] for t in there), key=len)
        places = lists[0]
        for other in lists[1:]:
            doc = self.document(places)
            low, high = np.maximum(places - within, self.first[doc]), np.minimum(places + within, self.first[doc] + self.lengths[doc])
            places = places[np.searchsorted(other, low) < np.searchsorted(other, high, side="right")]
        return places


class Windows:
    """The windows of benchmark items: rows of numbers of terms, -1 behind the end of an item that is shorter."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], size: int):
        self.size, self.terms = size, _Numbers()
        rows, of = [np.zeros((0, size), np.int64)], [np.zeros(0, np.int64)]
        self.items = [i for i, ws in items if ws]
        for k, ws in enumerate(ws for _, ws in items if ws):
            numbers = np.array([self.terms[w] for w in ws])
            if len(ws) < size:
                numbers = np.pad(numbers, (0, size - len(ws)), constant_values=-1)
            found = np.unique(np.lib.stride_tricks.sliding_window_view(numbers, size), axis=0)
            rows.append(found)
            of.append(np.full(len(found), k))
        self.rows, self.item = np.concatenate(rows), np.concatenate(of)
        self.length = (self.rows >= 0).sum(1)

    def hits(self, shard: Shard) -> tuple[np.ndarray, dict[int, set]]:
        """Which places of the shard any window covers, and the items that have one there, by document."""
        there = np.append(np.where((n := shard.numbers(self.terms, len(self.terms))) < 0, -2, n), -1)
        edges, found = np.zeros(shard.size + 1, np.int64), {}
        for window, at in shard.phrases(there[self.rows]):
            np.add.at(edges, at, 1)
            np.add.at(edges, at + self.length[window], -1)
            pairs = np.unique(shard.document(at) * max(1, len(self.items)) + self.item[window])
            for doc, item in zip(*(x.tolist() for x in np.divmod(pairs, max(1, len(self.items)))), strict=True):
                found.setdefault(doc, set()).add(self.items[item])
        return np.cumsum(edges[:-1]) > 0, found


def _shards(batches: Iterator[pa.RecordBatch], gap: int = WINDOW) -> Iterator[tuple[str, Shard]]:
    for b in batches:
        flat = {c: b.column(c) for c in ("ids", "hashes", "lengths", "starts", "docs", "positions")}
        for i, name in enumerate(b.column("shard").to_pylist()):
            row = {c: v[i].values for c, v in flat.items()}
            row = {c: v.to_pylist() if c in ("ids", "hashes") else v.to_numpy(zero_copy_only=False) for c, v in row.items()}
            yield name, Shard(row | {"terms": b.column("terms")[i].values.to_pylist()}, gap)


def _search(windows: Windows, with_bits: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, shard in _shards(batches, windows.size):
            covered, found = windows.hits(shard)
            total = np.concatenate([[0], np.cumsum(covered)])
            n = len(shard.ids)
            bits = [np.packbits(covered[a : a + m]).tobytes() if m else None for a, m in zip(shard.first, shard.lengths, strict=True)] if with_bits else [None] * n
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(shard.ids, pa.int64()), pa.array(shard.hashes, pa.int64()), pa.array(shard.lengths),
                 pa.array(total[shard.first + shard.lengths] - total[shard.first]), pa.array(bits, pa.binary()),
                 pa.array([sorted(str(i) for i in found.get(d, ()) if i is not None) for d in range(n)], pa.list_(pa.string()))],
                ["shard", "doc", "doc_id", "text_hash", "n_words", "n_hit", "hit", "items"],
            )

    return search


def _blocks(benchmark: DataFrame, words: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items in blocks of so many words at most (one item at least), streamed to the driver."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        ws = words_of(row["text"])
        if block and held + len(ws) > words:
            yield block
            block, held = [], 0
        block.append((row["item_id"], ws))
        held += len(ws)
    yield block


def _joined_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n_hit = []
        for masks in pdf["hits"]:
            total = None
            for m in masks:
                bits = np.frombuffer(m, dtype=np.uint8)
                total = bits if total is None else total | bits
            n_hit.append(0 if total is None else int(np.unpackbits(total).sum()))
        yield pdf[["doc_id", "text_hash", "n_words", "items"]].assign(n_hit=n_hit)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items for every document: words covered by occurrences of benchmark
    windows (window words of an item in a row; all of a shorter item), and the items they are of.

    docs: doc_id, text; benchmark: item_id, text; other columns don't matter. Null texts have no words
    and no windows. Repeated rows and null ids each keep their row; an item with a null id covers
    words but isn't listed, and repeated item ids are listed once. Empty tables give no rows, or no
    hits. The corpus is indexed once; the benchmark is searched in blocks of block_words, each over the
    index, so no task and no broadcast holds more than one block, and the driver no more than two.
    """
    spark: SparkSession = docs.sparkSession
    index = build_index(docs, fresh_path(spark, "positional-index"))
    blocks = _blocks(benchmark, block_words)
    first, second = next(blocks), next(blocks, None)
    schema = "shard string, doc int, doc_id long, text_hash long, n_words long, n_hit long, hit binary, items array<string>"
    if second is None:
        return index.mapInArrow(_search(Windows(first, window), False), schema).select("doc_id", "text_hash", "n_words", "n_hit", "items")
    each = None
    for items in chain([first, second], blocks):  # a block's hits are written before the next but one is read
        part = materialize(index.mapInArrow(_search(Windows(items, window), True), schema), "block-hits")
        each = part if each is None else each.unionByName(part)
    met = each.groupBy("shard", "doc", "doc_id", "text_hash", "n_words").agg(F.collect_list("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    schema = "doc_id long, text_hash long, n_words long, items array<string>, n_hit long"
    return met.drop("shard", "doc").mapInPandas(_joined_bits, schema).select("doc_id", "text_hash", "n_words", "n_hit", "items")


def contaminated() -> Column:
    """The rule over n_hit and n_words: a twentieth of the words at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def phrase_matches(index: DataFrame, phrases: dict[int, str], within: int | None = None) -> DataFrame:
    """phrase, doc_id, position: where phrases stand in an index; with within, where the rarest word of a phrase
    has all its other words within so many words. A phrase without words stands nowhere."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard in _shards(batches):
            for k, text in phrases.items():
                ws = words_of(text)
                at = shard.phrase(ws) if within is None else shard.near(ws, within)
                doc = shard.document(at)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int64()), pa.array([shard.ids[i] for i in doc], pa.int64()), pa.array(at - shard.first[doc], pa.int64())], ["phrase", "doc_id", "position"])

    return index.mapInArrow(search, "phrase long, doc_id long, position long")

"""Ranked search by MaxScore with bounds of term pairs, over an index of shards.

Three tables are made once: the index (a row a shard of documents: its terms, and for each the documents that hold it
and how often), the impact lists of a workload's terms (what each posting adds to a score, which needs the corpus's
numbers), and beside them the intersection lists of pairs of its terms with the greatest joint impact of each.

A search keeps the k best of each item. Of a shard's terms some are too weak to lift a document over the k-th best score
even together; documents that hold no other term aren't looked at. How strong terms are together is bounded by the
sum of their greatest impacts, or, for two that make a pair, by their joint maximum, which is less: the two maxima rarely
are the same document's. Before the search starts, the joint maxima of all shards give each item a score that k
documents reach for sure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.llm.common import forget, fresh_path, materialize, slices
from townhall.llm.decontamination import words_of

#: Text bytes of a shard, and shards of a row group, which a reader holds whole.
SHARD_BYTES, GROUP_SHARDS = 4 << 20, 4
#: Words of items that one search holds; more items are searched in blocks.
BLOCK_WORDS = 500_000
#: Weights in thousandths, impacts in thousandths of a thousandth; a length counts for half. Fixed values of the score.
WEIGHT, IMPACT, LENGTH = 1_000, 1_000_000_000, 50
INDEX_SCHEMA = "shard string, n_docs long, n_words long, ids array<long>, lengths array<int>, terms array<binary>, starts array<int>, docs array<int>, times array<int>"
LISTS_SCHEMA = "shard string, ids array<long>, terms array<int>, starts array<int>, docs array<int>, impacts array<long>, pairs array<int>, pair_starts array<int>, pair_docs array<int>, joint array<long>"


def _lists(*arrays) -> list[pa.ListArray]:
    """Columns of one row, each an array."""
    return [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.array(a)) for a in arrays]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    for b in slices(batches, "text", SHARD_BYTES):
        terms, found = {}, []
        for text in b.column("text").to_pylist():
            ws = words_of(text)
            found.append(np.fromiter((terms.setdefault(w, len(terms)) for w in ws), dtype=np.int64, count=len(ws)))
        lengths = np.array([len(f) for f in found], dtype=np.int32)
        keys, times = np.unique(np.concatenate(found) * len(found) + np.repeat(np.arange(len(found)), lengths), return_counts=True)
        term, doc = np.divmod(keys, len(found))
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))]).astype(np.int32)
        columns = _lists(b.column("doc_id"), lengths, pa.array(list(terms), pa.binary()), starts, doc.astype(np.int32), times.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{number}"]), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum(dtype=np.int64))]), *columns], [c.split()[0] for c in INDEX_SCHEMA.split(", ")])
        number += 1


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Writes the index of docs (doc_id, text) at path, with all terms, and returns it as a table. Null texts have no terms;
    null ids and repeated rows each stay a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows.mapInArrow(_index, INDEX_SCHEMA).write.option("parquet.block.row.count.limit", GROUP_SHARDS).parquet(path)
    index = docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)
    index.folder = path
    return index


class Workload:
    """Items by their different terms (numbers), the weights of terms, and the pairs that get intersection lists.

    Pairs are terms that stand next to each other, or next but one, in an item's order of weights: terms of like strength,
    of which the weaker ones are what bounds have to hold down."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]):
        self.ids, self.terms, self.of = [i for i, _ in items], {}, []
        for _, ws in items:
            self.of.append(np.array(sorted({self.terms.setdefault(w, len(self.terms)) for w in ws}), dtype=np.int64))
        self.weight = np.zeros(len(self.terms), dtype=np.int64)
        self.n, self.length = 0, 1
        self.pairs = np.zeros((0, 2), dtype=np.int64)
        self.pairs_of: list[np.ndarray] = []

    def weigh(self, n: int, length: int, df: dict[int, int]) -> None:
        """Takes the corpus's numbers: documents with terms, all their terms, and the documents of each term."""
        self.n, self.length = n, max(1, length)
        for t, d in df.items():
            self.weight[t] = math.floor(WEIGHT * math.log((2 * n + 2) / (2 * d + 1)))
        numbers: dict[tuple[int, int], int] = {}
        for ts in self.of:
            ranked = ts[np.argsort(-self.weight[ts], kind="stable")].tolist()
            near = [(a, b) for gap in (1, 2) for a, b in zip(ranked, ranked[gap:], strict=False)]
            self.pairs_of.append(np.array([numbers.setdefault((min(p), max(p)), len(numbers)) for p in near], dtype=np.int64))
        self.pairs = np.array(list(numbers) or np.zeros((0, 2)), dtype=np.int64)

    def impacts(self, terms: np.ndarray, times: np.ndarray, docs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What postings add to scores; the length's part in Python's integers, whatever the product of the corpus's numbers."""
        room = np.array([20 * (100 - LENGTH + LENGTH * n * self.n // self.length) for n in lengths.tolist()], dtype=np.int64)
        times = times.astype(np.int64)
        return self.weight[terms] * ((IMPACT * times) // (1000 * times + room[docs]))


def _row(b: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    return [b.column(n)[i].values.to_numpy(zero_copy_only=False) for n in names]


def _impact_lists(work: Workload):
    """Impact lists and pair lists of the workload's terms, shard by shard."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, shard in enumerate(b.column("shard").to_pylist()):
                lengths, starts, docs, times = _row(b, i, "lengths", "starts", "docs", "times")
                here = np.fromiter((work.terms.get(t, -1) for t in b.column("terms")[i].values.to_pylist()), dtype=np.int64)
                order = np.flatnonzero(here >= 0)
                order = order[np.argsort(here[order])]
                size = np.diff(starts)[order].astype(np.int64)
                at = np.repeat(starts[:-1][order] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                terms = here[order]
                docs, times = docs[at].astype(np.int64), times[at]
                impacts = work.impacts(np.repeat(terms, size), times, docs, lengths)
                ends = np.concatenate([[0], np.cumsum(size)])
                pairs, pair_of, pair_docs, joint = _intersect(work, terms, ends, docs, impacts, len(lengths))
                pair_starts = np.concatenate([[0], np.cumsum(np.bincount(pair_of, minlength=len(pairs)))]) if len(pairs) else np.zeros(1)
                columns = _lists(b.column("ids")[i].values, terms.astype(np.int32), ends.astype(np.int32), docs.astype(np.int32), impacts, pairs.astype(np.int32), pair_starts.astype(np.int32), pair_docs.astype(np.int32), joint)
                yield pa.RecordBatch.from_arrays([pa.array([shard]), *columns], [c.split()[0] for c in LISTS_SCHEMA.split(", ")])

    return lists


def _intersect(work: Workload, terms: np.ndarray, ends: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
    """The pairs that some document of a shard holds: their numbers, the intersection lists (place of the pair, document) and
    the greatest joint impact of each. The shorter list is looked up in the longer, all pairs at once."""
    place = np.full(len(work.weight), -1)
    place[terms] = np.arange(len(terms))
    both = place[work.pairs] if len(work.pairs) else np.zeros((0, 2), np.int64)
    there = np.flatnonzero((both >= 0).all(1))
    both, size = both[there], np.diff(ends)
    swap = size[both[:, 0]] > size[both[:, 1]]
    both[swap] = both[swap][:, ::-1]
    n = size[both[:, 0]] if len(both) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(both)), n)
    at = np.repeat(ends[both[:, 0]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    keys = np.repeat(np.arange(len(terms)), size) * n_docs + docs  # sorted: by term, then document
    wanted = both[of, 1] * n_docs + docs[at]
    found = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    ok = keys[found] == wanted if len(keys) else np.zeros(0, bool)
    of, at, found = of[ok], at[ok], found[ok]
    sums = impacts[at] + impacts[found]
    some, of = np.unique(of, return_inverse=True)
    joint = np.zeros(len(some), dtype=np.int64)
    np.maximum.at(joint, of, sums)
    return there[some], of, docs[at], joint


def _floors(work: Workload, k: int):
    """item, floor: each task's k best joint maxima of its shards, one a shard, so that they are different documents' for sure."""

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(work.of), k + 1), dtype=np.int64)
        for b in batches:
            for i in range(b.num_rows):
                pairs, joint = _row(b, i, "pairs", "joint")
                of = np.zeros(len(work.pairs), dtype=np.int64)
                of[pairs] = joint
                best[:, 0] = [of[ps].max(initial=0) for ps in work.pairs_of]
                best.sort(axis=1)
        at, which = np.nonzero(best[:, 1:])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(best[:, 1:][at, which])], ["item", "floor"])

    return floors


class _Best:
    """The k best of an item: scores and ids, the best first; equal scores by id, null first."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, max(1, floor)
        self.scores, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score under this has no place."""
        return max(self.floor, int(self.scores[-1])) if len(self.scores) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        s, i, n = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.known, known])
        order = np.lexsort((i, n, -s))[: self.k]
        self.scores, self.ids, self.known = s[order], i[order], n[order]


class _Shard:
    """A shard's impact and pair lists, for the search of one item after the other."""

    def __init__(self, b: pa.RecordBatch, i: int, work: Workload):
        ids = b.column("ids")[i].values
        self.known, self.ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        terms, self.starts, self.docs, self.impacts, pairs, self.pair_starts, self.pair_docs, joint = _row(b, i, "terms", "starts", "docs", "impacts", "pairs", "pair_starts", "pair_docs", "joint")
        self.place = np.full(len(work.weight), -1)
        self.place[terms] = np.arange(len(terms))
        self.most = np.maximum.reduceat(self.impacts, self.starts[:-1]) if len(terms) else np.zeros(0, np.int64)
        self.pair_place = np.full(len(work.pairs), -1)
        self.pair_place[pairs] = np.arange(len(pairs))
        self.joint = joint
        self.work = work

    def list_of(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, z = self.starts[t], self.starts[t + 1]
        return self.docs[a:z], self.impacts[a:z]

    def bounds(self, item: int, ts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms from the weakest on, and what the first 0, 1, 2 ... of them add to any document at most.

        Two terms of a pair add its joint maximum, or the greater of theirs where a document holds one of them only. Each
        term is in one pair at most: those that save the most come first."""
        ts = ts[np.argsort(self.most[ts], kind="stable")]
        rank = {t: j for j, t in enumerate(ts.tolist())}
        pairs = self.work.pairs_of[item]
        a, z = self.place[self.work.pairs[pairs]].T if len(pairs) else np.zeros((2, 0), np.int64)
        ok = (a >= 0) & (z >= 0)
        pairs, a, z = pairs[ok], a[ok], z[ok]
        at = self.pair_place[pairs]
        joint = np.where(at >= 0, self.joint[np.maximum(at, 0)] if len(self.joint) else 0, 0)
        together = np.maximum(joint, np.maximum(self.most[a], self.most[z]))
        saves = self.most[a] + self.most[z] - together
        adds, mated = self.most[ts].copy(), np.zeros(len(ts), bool)
        for p in np.argsort(-saves, kind="stable").tolist():
            x, y = sorted((rank[int(a[p])], rank[int(z[p])]))
            if saves[p] > 0 and not mated[x] and not mated[y]:
                mated[[x, y]] = True
                adds[y] -= saves[p]
        return ts, np.concatenate([[0], np.cumsum(adds)])

    def seeds(self, item: int, k: int) -> np.ndarray:
        """Documents of the pairs with the greatest joint impacts: k of them or more, if there are."""
        at = self.pair_place[self.work.pairs_of[item]]
        at = at[at >= 0]
        at = at[np.argsort(-self.joint[at], kind="stable")]
        size = np.cumsum(self.pair_starts[at + 1] - self.pair_starts[at])
        at = at[: int(np.searchsorted(size, 2 * k)) + 1]
        return np.unique(np.concatenate([self.pair_docs[self.pair_starts[p] : self.pair_starts[p + 1]] for p in at] or [np.zeros(0, np.int32)]))

    def lookup(self, t: int, docs: np.ndarray) -> np.ndarray:
        """What documents (sorted) get from a term."""
        held, impacts = self.list_of(t)
        found = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        return np.where(held[found] == docs, impacts[found], 0)

    def search(self, item: int, best: _Best) -> int:
        """Puts the item's best documents of the shard among the best; returns how many postings were read."""
        ts = self.place[self.work.of[item]]
        ts = ts[ts >= 0]
        if not len(ts):
            return 0
        ts, bound = self.bounds(item, ts)
        least, read = best.least, 0
        if bound[-1] < least:
            return 0
        if len(best.scores) < best.k and best.floor <= 1:  # nothing is known yet: documents of strong pairs give a first k-th score
            docs = self.seeds(item, best.k)
            if len(docs) >= best.k:
                scores = sum(self.lookup(t, docs) for t in ts.tolist())
                read += len(docs) * len(ts)
                least = max(least, int(np.partition(scores, len(scores) - best.k)[len(scores) - best.k]))
        weak = int(np.searchsorted(bound, least)) - 1  # the first `weak` terms stay under `least` together
        lists = [self.list_of(t) for t in ts[weak:].tolist()]
        every = np.concatenate([d for d, _ in lists])
        read += len(every)
        docs, at = np.unique(every, return_inverse=True)
        scores = np.zeros(len(docs), dtype=np.int64)
        np.add.at(scores, at, np.concatenate([x for _, x in lists]))
        for j in range(weak - 1, -2, -1):
            alive = scores + bound[j + 1] >= least
            docs, scores = docs[alive], scores[alive]
            if j < 0 or not len(docs):
                break
            scores = scores + self.lookup(int(ts[j]), docs)
            read += len(docs)
        if len(docs):
            best.add(scores, self.ids[docs], self.known[docs])
        return read


def _search(work: Workload, k: int, floors: np.ndarray):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k, int(f)) for f in floors]
        for b in batches:
            for i in range(b.num_rows):
                shard = _Shard(b, i, work)
                for item, of in enumerate(best):
                    shard.search(item, of)
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(x.scores) for x in best])
        none = np.zeros(0, np.int64)
        ids, known = np.concatenate([x.ids for x in best] or [none]), np.concatenate([x.known for x in best] or [none.astype(bool)])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=~known), pa.array(np.concatenate([x.scores for x in best] or [none]))], ["item", "doc_id", "score"])

    return search


def _blocks(items: DataFrame, words: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items in blocks of so many words at most (one item at least), streamed to the driver."""
    block, held = [], 0
    for row in items.toLocalIterator():
        ws = words_of(row["text"])
        if not ws:
            continue
        if block and held + len(ws) > words:
            yield block
            block, held = [], 0
        block.append((row["item_id"], ws))
        held += len(ws)
    if block:
        yield block


def document_frequencies(index: DataFrame, work: Workload) -> dict[int, int]:
    """How many documents hold each of the workload's terms; a row for each of them reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(work.weight), dtype=np.int64)
        for b in batches:
            for i in range(b.num_rows):
                here = np.fromiter((work.terms.get(t, -1) for t in b.column("terms")[i].values.to_pylist()), dtype=np.int64)
                total[here[here >= 0]] += np.diff(_row(b, i, "starts")[0])[here >= 0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    counted = index.select("terms", "starts").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counted.collect()}


def ranked(found: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score, rank: the k best of each item, first within shares of its documents, then among those."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
    share = F.pmod(F.xxhash64("doc_id", "score"), F.lit(16))
    each = found.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).filter(F.col("rank") <= k)
    return each.drop("share", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents (doc_id, text) with the highest scores over 0 for each item (item_id, text);
    fewer, if fewer score. Equal scores stand by ascending doc_id, null first.

    Other columns don't matter. Null texts have no terms: such documents aren't found and such items find nothing. Repeated
    rows of documents are each ranked; of repeated rows of items one is, and items of one id and different texts each have
    their own ranks. Empty tables give no rows. What the driver holds is one block of items and the numbers of its terms."""
    spark: SparkSession = docs.sparkSession
    index = build_index(docs, fresh_path(spark, "ranked-index"))
    n, length = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    wanted = items.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    out = None
    for block in _blocks(wanted, block_words):
        work = Workload(block)
        work.weigh(n, length, document_frequencies(index, work))
        lists = materialize(index.select("shard", "ids", "lengths", "terms", "starts", "docs", "times").mapInArrow(_impact_lists(work), LISTS_SCHEMA), "impact-lists")
        met = lists.select("pairs", "joint").mapInArrow(_floors(work, k), "item int, floor long")
        kth = met.withColumn("rn", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("floor")))).filter(F.col("rn") == k)
        floors = np.zeros(len(block), dtype=np.int64)
        for r in kth.collect():  # one number an item of the block
            floors[r["item"]] = r["floor"]
        best = ranked(lists.drop("shard").mapInArrow(_search(work, k, floors), "item int, doc_id long, score long"), k)
        ids = F.broadcast(spark.createDataFrame(list(enumerate(work.ids)), "item int, item_id long"))  # a block's items, at most one a word
        part = materialize(best.join(ids, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        forget(lists)
        out = part if out is None else out.unionByName(part)
    forget(index)  # the ranks are written
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out

"""Near-duplicate groups by circulant MinHash, with every link confirmed on whole shingle sets.

Signatures: two permutations of one universe. The first scatters the shingles; the second, shifted
circularly by one place for each coordinate, orders them, and a coordinate is the least place in
that order. Bands of coordinates make buckets.

Groups are closed without pairing the members of a bucket with one another: texts with one set are
one node; each bucket first links its members to one center, and only members that are still in
different components go on. Small buckets compare those directly. In large ones two members can
only be similar if they share one of their rarest shingles (as many as a similar text can lack), so
those shingles are the join keys: exact, and members whose rare shingles are all their own drop out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.llm.common import forget, hold, if_small, materialize, slices

WORDS = 5
UNIVERSE_BITS = 20
#: Bits of the two words that hold one bit of each coordinate.
HALF = 50
#: Buckets up to this size compare their members of different components directly.
SMALL_BUCKET = 48
REMEMBERED_WORDS = 250_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A = np.uint64(0x9E3779B97F4A7C15)


def bands_for(percent: int) -> tuple[int, int]:
    """Coordinates a band and bands, so that a pair at the threshold escapes all bands less than once in 100,000."""
    rows = 5 if percent >= 85 else 4
    s = (percent / 100) ** rows
    return rows, math.ceil(math.log(1e-5) / math.log(1 - s))


class _Words(dict):
    """Hashes of words, each counted once; it forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def _known_words() -> _Words:
    hold("near_dup", _words.clear)
    if len(_words) > REMEMBERED_WORDS:
        _words.clear()
    return _words


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles; of the whole sequence if it has fewer words."""
    ws = (text or "").encode(errors="replace").translate(_LOWER).split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_known_words().__getitem__, ws), dtype=np.uint64, count=len(ws))
    n = min(words, len(ws))
    x = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        x = x * _A + h[i : len(h) - n + 1 + i]
    return np.unique(_mixed(x))


@lru_cache(maxsize=2)
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    first = rng.permutation(1 << UNIVERSE_BITS)
    second = rng.permutation(1 << UNIVERSE_BITS).astype(np.int32)
    return first, np.concatenate([second, second[:coordinates]])


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """The circulant MinHash signatures of sets that aren't empty: a row each."""
    first, second = _permutations(coordinates)
    at = first[(np.concatenate(sets) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), coordinates), dtype=np.int32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(second[k : k + (1 << UNIVERSE_BITS)].take(at), starts)
    return out


def _profile(words: int, rows: int, bands: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            n = len(sets)
            fp, keys, low, high = np.zeros(n, np.int64), np.zeros((n, bands), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            if full:
                sig = signatures([sets[i] for i in full], rows * bands)
                x = np.arange(1, bands + 1, dtype=np.uint64)[None, :].repeat(len(full), 0)
                for i in range(rows):
                    x = _mixed(x * _A + sig[:, i::rows].astype(np.uint64))
                keys[full] = x.view(np.int64)
                bits = (sig & 1).astype(np.int64)
                low[full] = (bits[:, :HALF] << np.arange(min(HALF, bits.shape[1]))).sum(1)
                high[full] = (bits[:, HALF : 2 * HALF] << np.arange(max(0, min(HALF, bits.shape[1] - HALF)))).sum(1)
                fp[full] = [np.uint64(xxhash.xxh64_intdigest(sets[i].tobytes())).view(np.int64) for i in full]
            none = np.array([not len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(fp, mask=none), pa.array([len(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1))), pa.array(low), pa.array(high)],
                ["doc_id", "text_hash", "fp", "n", "keys", "low", "high"],
            )

    return profile


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            found = [shingle_set(t, words).view(np.int64) for t in b.column("text").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))], ["fp", "shingles"])

    return sets


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root for every node of the edges (a, b): root is the least node of its component.

    Large-star and small-star steps in turn, each over edges only, until nothing changes; each round
    is written to the shared folder. Every step sends a row for an edge, whatever a node's degree.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, name)
    before = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
            out.folder = e.folder
            return out
        before = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = large.join(near, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(near.select("a", F.col("m").alias("b")).unionByName(lower).distinct(), name)
        forget(e)
        e = after


class _Job:
    """The steps of one run; percent, words and docs stand for all of them."""

    def __init__(self, docs: DataFrame, percent: int, words: int):
        self.percent, self.words = percent, words
        self.rows, self.bands = bands_for(percent)
        kept = min(2 * HALF, self.rows * self.bands)
        p = (1 + percent / 100) / 2  # bits agree by chance half the time where coordinates differ
        self.agree = math.floor(kept * p - 6 * math.sqrt(kept * p * (1 - p)))
        self.kept = kept
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
        self.tested: DataFrame | None = None
        self.held: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A table that later steps read; done() removes it."""
        out = materialize(df, name)
        self.held.append(out)
        return out

    def done(self) -> None:
        forget(*self.held)

    def profiles(self) -> DataFrame:
        schema = "doc_id long, text_hash long, fp long, n long, keys array<long>, low long, high long"
        return materialize(self.texts.mapInArrow(_profile(self.words, self.rows, self.bands), schema), "profiles")

    def likely(self, a: str, b: str):
        """What a pair over the threshold meets: sizes (surely) and bits of the signature (6 sigma)."""
        t = self.percent
        bits = F.bit_count(F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low"))) + F.bit_count(F.col(f"{a}.high").bitwiseXOR(F.col(f"{b}.high")))
        sizes = (100 * F.col(f"{a}.n") >= t * F.col(f"{b}.n")) & (100 * F.col(f"{b}.n") >= t * F.col(f"{a}.n"))
        return sizes & (bits <= self.kept - self.agree)

    def fetch(self, nodes: DataFrame) -> DataFrame:
        """fp, shingles of the given nodes (fp, text_hash), from their texts."""
        wanted = if_small(nodes.select("fp", "text_hash"), "wanted")
        found = self.texts.drop("doc_id").join(wanted, "text_hash").mapInArrow(_sets(self.words), "fp long, shingles array<long>")
        # copies of a text give the same row again
        sets = materialize(found.groupBy("fp").agg(F.first("shingles").alias("shingles")), "sets")
        forget(wanted)
        return sets

    def confirm(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) with the demanded similarity of their whole sets."""
        pairs = self.keep(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        if pairs.isEmpty():
            return pairs
        ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        sets = self.fetch(nodes.join(ends, "fp", "left_semi"))
        one = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("of_a")), "a")
        two = one.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("of_b")), "b")
        common = two.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("i"), (F.size("of_a") + F.size("of_b")).alias("s"))
        links = self.keep(common.filter(100 * F.col("i") >= self.percent * (F.col("s") - F.col("i"))).select("a", "b"), "links")
        forget(sets)
        return links

    def centers(self, members: DataFrame) -> DataFrame:
        """Each bucket's members with its center: the one whose buckets are the fullest in sum."""
        weight = members.groupBy("fp").agg(F.sum("m").alias("weight"))
        weighed = members.join(weight, "fp")
        center = weighed.groupBy("key").agg(F.max(F.struct("weight", "fp", "n", "low", "high")).alias("c"))
        pairs = members.alias("x").join(center, "key").filter(F.col("x.fp") != F.col("c.fp")).filter(self.likely("x", "c"))
        return pairs.select(F.greatest("x.fp", "c.fp").alias("a"), F.least("x.fp", "c.fp").alias("b")).distinct()

    def apart(self, members: DataFrame, links: DataFrame) -> DataFrame:
        """The members of buckets that still hold different components, with their root."""
        roots = components(links)
        rooted = members.join(roots, members.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
        rooted = materialize(rooted, "rooted")
        mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
        apart = self.keep(rooted.join(mixed, "key", "left_semi"), "apart")
        forget(rooted, roots)
        return apart

    def pairs_by(self, keyed: DataFrame, placed: bool = False) -> DataFrame:
        """Likely pairs of different components with one key that weren't tested before.

        placed: keys are shingles with their place in the common order. The first shingle that a similar
        pair has in common stands so early in both that what is left suffices; a pair goes only by such."""
        x, y = keyed.alias("x"), keyed.alias("y")
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") > F.col("y.fp")) & (F.col("x.root") != F.col("y.root")) & self.likely("x", "y")
        if placed:
            left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
            on = on & (left + 1 >= F.ceil(self.percent * (F.col("x.n") + F.col("y.n")) / (100 + self.percent)))
        pairs = x.join(y, on).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
        return pairs.join(self.tested, ["a", "b"], "left_anti")

    def rare_keys(self, members: DataFrame, nodes: DataFrame) -> DataFrame:
        """The members again, with their rarest shingles for keys: as many as a similar set may lack, and one."""
        one = members.select("fp", "n", "low", "high", "root").distinct()
        sets = self.fetch(nodes.join(one, "fp", "left_semi"))
        each = sets.select("fp", F.explode("shingles").alias("key"))
        held = each.groupBy("key").agg(F.count("*").alias("df"), F.min("fp").alias("fp"))
        shared = each.join(held.filter("df > 1").select("key", "df"), "key")
        alone = held.filter("df = 1").groupBy("fp").agg(F.count("*").alias("alone"))
        order = Window.partitionBy("fp").orderBy("df", "key")
        spare = F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1
        ranked = shared.withColumn("place", F.row_number().over(order)).join(one, "fp").join(alone, "fp", "left")
        ranked = ranked.withColumn("place", F.col("place") + F.coalesce("alone", F.lit(0)))
        keys = self.keep(ranked.filter(F.col("place") <= spare).select("key", "fp", "n", "low", "high", "root", "place"), "rare-keys")
        forget(sets)
        return keys

    def links(self, profiles: DataFrame) -> DataFrame:
        nodes = self.keep(
            profiles.filter("n > 0").groupBy("fp", "n", "low", "high").agg(F.min("text_hash").alias("text_hash"), F.first("keys").alias("keys")), "nodes"
        )
        rows = nodes.select("fp", "n", "low", "high", F.explode("keys").alias("key"))
        full = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
        members = self.keep(rows.join(full, "key"), "members")
        links = self.confirm(self.centers(members), nodes)
        apart = self.apart(members, links)
        if apart.isEmpty():
            return links
        small = self.pairs_by(apart.filter(F.col("m") <= SMALL_BUCKET))
        links = links.unionByName(self.confirm(small, nodes))
        apart = self.apart(apart.filter(F.col("m") > SMALL_BUCKET).drop("root"), links)
        if apart.isEmpty():
            return links
        large = self.pairs_by(self.rare_keys(apart, nodes), placed=True)
        return links.unionByName(self.confirm(large, nodes))


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of docs.

    docs: doc_id and text; other columns don't matter. Two documents are linked where
    100 * |common shingles| >= percent * |all shingles|; component_id is the least doc_id reachable
    over links, itself included, and kept marks the row with doc_id = component_id.

    Null and empty texts and texts without words have no shingles and are linked with nothing. A row
    with a null doc_id takes part in links but lends its component no id; its own component_id is
    the component's, or null if it has none, and it is kept only in the latter case. Repeated rows
    share everything (so each of them is kept, or none). An empty table gives an empty result.
    """
    job = _Job(docs, percent, words)
    profiles = job.profiles()
    roots = components(job.links(profiles), "groups")
    of = profiles.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = of.join(roots, of.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    # one row for a set of shingles: no group is ever collected
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = materialize(rooted.join(least, "root").select("fp", "component_id"), "component-ids")
    job.done()
    forget(roots)
    out = profiles.select("doc_id", "text_hash", "fp", F.col("n").alias("n_shingles")).join(ids, "fp", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )

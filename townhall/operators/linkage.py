"""Matching of records across sources and spellings."""

from __future__ import annotations

import difflib
import itertools
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from townhall.functions.patterns import lexicon_matches  # noqa: F401
from townhall.functions.text import has_tamil, norm_name, without_reservation
from townhall.operators.graph import forget, written

#: Honorifics and roles that stand before names and aren't part of them.
STOP_TOKENS = ["cm", "chief", "minister", "mla", "mp", "dr", "mr", "mrs", "thiru", "selvi"]
#: Fixed value: what a Tamil seat's name says for "assembly constituency".
SEAT_WORDS = "சட்டமன்றத் தொகுதி"


@F.pandas_udf(T.StringType())
def nfkd(texts: pd.Series) -> pd.Series:
    """Decomposed texts; only for rows that aren't ASCII."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Texts with letters and digits of all widths and forms as their plain ones, as department names are compared."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def decomposed(name: Column | str) -> Column:
    """Names with marks apart from their letters, as norm_name() takes them."""
    return nfkd(F.col(name) if isinstance(name, str) else name)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks of two short names, for pairs that share a block already."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def alias_join(rows: DataFrame, names: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """rows with `code` from names (name_key, code), by their name or what aliases (name_key, alias_of) say for it; null if neither."""
    known = names.select(F.col("name_key").alias("k_name"), "code")
    also = aliases.select(F.col("name_key").alias("a_name"), "alias_of")
    key = rows.join(also, F.col(name) == F.col("a_name"), "left").withColumn("k", F.coalesce("alias_of", name))
    return key.join(known, F.col("k") == F.col("k_name"), "left").drop("a_name", "alias_of", "k", "k_name")


def validated_join(ours: DataFrame, theirs: DataFrame, key: str, value: str, tolerance: float = 0.01) -> DataFrame:
    """Rows of ours with a confidence from theirs: 1.0 for the same value, 0.9 within the tolerance, else null."""
    other = theirs.select(key, F.col(value).alias("their_value"))
    drift = F.try_divide(F.abs(F.col(value) - F.col("their_value")), F.abs(F.col("their_value")))
    return ours.join(other, key, "left").withColumn("confidence", F.when(F.col(value) == F.col("their_value"), 1.0).when(drift <= tolerance, 0.9))


def two_signal(first: Column, second: Column) -> Column:
    """1.0 if both signals agree, 0.9 if one does, null for a problem."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return F.when(a & b, 1.0).when(a | b, 0.9)


def unique_claims(claims: DataFrame, item: str, value: str) -> DataFrame:
    """Claims of items that claim one value only, which no other item claims."""
    pairs = claims.select(item, value).distinct()
    of_item = pairs.groupBy(item).agg(F.count("*").alias("n")).filter("n = 1").select(item)
    of_value = pairs.groupBy(value).agg(F.count("*").alias("n")).filter("n = 1").select(value)
    return pairs.join(of_item, item, "left_semi").join(of_value, value, "left_semi")


def first_valid(candidates: DataFrame, key: str, priority: str, valid: Column) -> DataFrame:
    """The valid candidate of each key whose source comes first; keys without one aren't there."""
    order = Window.partitionBy(key).orderBy(priority, "value")
    return candidates.filter(valid).withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def pieces(name: Column, size: Column | int) -> Column:
    """The different runs of so many characters of a name; the whole name if it is shorter."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - n + 1)), lambda i: F.substring(name, i, n)))


#: Runs have so many characters at most, and so many of them make a key at most: two, or three from so many names on,
#: where what meets by chance costs more than the keys.
LONGEST_RUN, RUNS_TOGETHER, MANY_NAMES = 3, 2, 200_000


def shared_runs(total: int, least: float, q: int) -> int:
    """How many runs of q characters two names of `total` characters together surely share, if their ratio reaches `least`.

    At least M = least * total / 2 characters are matched, in at most total - 2 * M + 1 blocks, since a gap between blocks
    takes a character of either; a block has its length less q - 1 runs."""
    matched = math.ceil(least * total / 2 - 1e-9)
    return matched - (q - 1) * (total - 2 * matched + 1)


#: Parts of what two names have in common are so many characters long at most, and a name has so many keys of one kind at most.
LONGEST_PART, MOST_KEYS = 7, 1000


def part_plan(n: int, m: int, least: float) -> list[tuple[str, int, int]] | None:
    """part, size, edits: keys of names of n and m characters that meet if the ratio reaches `least`; None if there were too many.

    At least M characters are matched, in one order, so n + m - 2 * M are left out. Where names have few choices of M
    characters, those are the keys (whole). Else fewer than that are left out between the first characters that are
    matched, or between the last ones: the parts' edits add up to one less than all, so one of the two parts is met."""
    matched = math.ceil(least * (n + m) / 2 - 1e-9)
    edits = n + m - 2 * matched
    if math.comb(max(n, m), matched) <= 150:
        return [("whole", matched, 0)]
    first = min(matched // 2, LONGEST_PART)
    last, of_first = min(matched - first, LONGEST_PART), (edits - 1) // 2
    plan = [(part, size, e) for part, size, e in (("first", first, of_first), ("last", last, edits - 1 - of_first)) if e >= 0]
    return plan if all(e < 8 for _, _, e in plan) and sum(math.comb(size + e, e) for _, size, e in plan) <= MOST_KEYS else None


def part_keys(plan: dict[int, list[tuple[str, int, int]]]):
    """Function of Arrow batches of names (id, name): keys (key, id, size, skipped) by the plan of each length.

    A key is a hash of some characters in their order; skipped says how many were left out before the last of them (first)
    or after the first (last). A name has each key once, with the fewest left out."""
    salt = {"whole": 1, "first": 2, "last": 3}

    def of(chars: np.ndarray, part: str, size: int, e: int) -> np.ndarray:
        n = chars.shape[1]
        span = n if part == "whole" else min(n, size + e)
        at = np.array(list(itertools.combinations(range(span), size)), dtype=np.int64).reshape(-1, size)
        skipped = np.zeros(len(at), np.uint64) if part == "whole" else (at[:, -1] + 1 - size if part == "first" else span - at[:, 0] - size).astype(np.uint64)
        at = at + (n - span if part == "last" else 0)
        h = np.full((len(chars), len(at)), salt[part] * 1000 + size, np.uint64)
        for i in range(size):
            h = (h ^ chars[:, at[:, i]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h & ~np.uint64(7)) | skipped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), dtype=object)
            sizes = np.array([len(x) for x in names], dtype=np.int64)
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                for start in range(0, len(rows) if plan.get(int(n)) else 0, 1000):
                    some = rows[start : start + 1000]
                    chars = np.frombuffer("".join(names[some]).encode("utf-32-le"), dtype=np.uint32).reshape(len(some), n).astype(np.uint64)
                    keys = np.sort(np.concatenate([of(chars, *x) for x in plan[int(n)]], axis=1), axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] >> np.uint64(3) != keys[:, :-1] >> np.uint64(3)
                    who, flat = np.repeat(ids[some], keys.shape[1])[new.ravel()], keys[new]
                    skipped = (flat & np.uint64(7)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array((flat >> np.uint64(3)).astype(np.int64)), pa.array(who), pa.array(np.full(len(flat), n, np.int32)), pa.array(skipped)], names=["key", "id", "size", "skipped"])

    return run


def comparable(n: int, m: int, least: float) -> bool:
    """Whether names of so many characters can have the ratio."""
    return min(n, m) > 0 and 2 * min(n, m) >= least * (n + m) - 1e-9


def run_plan(lefts: list[int], rights: list[int], least: float, together: int = RUNS_TOGETHER, skip: set[tuple[int, int]] = frozenset()) -> list[tuple[bool, int, int, int, int]]:
    """is_left, n, q, k, first: a name of n characters has keys of k runs of q characters each, from its `first` rarest runs.

    Two names that share c runs have k of them among their first so many less c - k, in any order that holds for all
    names. Which q and k a pair goes by depends on its length: those that tell most apart and that it surely shares.
    Only lengths that names of the two sides have count, without those to skip."""
    fits = lambda total: max(((q * k, q, k) for q in range(1, LONGEST_RUN + 1) for k in range(1, together + 1) if shared_runs(total, least, q) >= k), default=None)
    need: dict[tuple[bool, int, int, int], int] = {}
    for n in lefts:
        for m in rights:
            if (n, m) not in skip and comparable(n, m, least) and (best := fits(n + m)) is not None:
                _, q, k = best
                for is_left, size in ((True, n), (False, m)):
                    first = size - q + 1 - shared_runs(n + m, least, q) + k
                    need[is_left, size, q, k] = max(need.get((is_left, size, q, k), 0), first)
    return [(*key, first) for key, first in need.items()]


def _together(runs: Column, k: Column) -> Column:
    """All choices of k (up to three) of some runs, each as one number."""
    n = F.size(runs)
    after = lambda i: F.slice(runs, i + 2, F.greatest(n - i - 1, F.lit(0)))
    twos = F.flatten(F.transform(runs, lambda x, i: F.transform(after(i), lambda y: F.xxhash64(x, y))))
    threes = F.flatten(F.flatten(F.transform(runs, lambda x, i: F.transform(after(i), lambda y, j: F.transform(after(i + j + 1), lambda z: F.xxhash64(x, y, z))))))
    return F.when(k == 1, F.transform(runs, lambda x: F.xxhash64(x))).when(k == 2, twos).otherwise(threes)


def _meet_on_runs(names: DataFrame, sides: list[list[int]], least: float, skip: set[tuple[int, int]], many: int) -> DataFrame:
    """l_name, r_name of the names (name, is_left, n) that meet on runs, for lengths that aren't to be skipped."""
    spark, rows = names.sparkSession, run_plan(*sides, least, RUNS_TOGETHER + (many >= MANY_NAMES), skip)
    plan = F.broadcast(spark.createDataFrame(rows, "is_left boolean, n int, q int, k int, first int"))
    sized = names.join(F.broadcast(spark.createDataFrame(sorted({r[:3] for r in rows}), "is_left boolean, n int, q int")), ["is_left", "n"])
    runs = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("q") + 1), lambda i: F.substring("name", i, F.col("q")))
    # a run that a name has twice is two runs
    numbered = F.transform(runs, lambda r, i: F.struct(r.alias("run"), F.size(F.filter(F.slice(runs, 1, i), lambda o: o == r)).alias("nth")))
    each = sized.select("name", "is_left", "n", "q", F.explode(numbered).alias("run"))
    seen = each.groupBy("q", "run").agg(F.count("*").alias("df"))
    ordered = each.join(seen, ["q", "run"]).groupBy("name", "is_left", "n", "q").agg(F.array_sort(F.collect_list(F.struct("df", "run"))).alias("runs"))
    chosen = ordered.join(plan, ["is_left", "n", "q"]).select("name", "is_left", "q", "k", F.slice("runs", F.lit(1), F.col("first")).alias("runs"))
    keys = written(chosen.select("name", "is_left", F.explode(_together(F.transform("runs", lambda x: x["run"]), F.col("k"))).alias("h"), "q", "k").select("name", "is_left", F.xxhash64("q", "k", "h").alias("key")), "run-keys")
    l, r = (keys.filter(F.col("is_left") == side).select(F.col("name").alias(f"{c}_name"), "key") for side, c in ((True, "l"), (False, "r")))
    shorter, total = F.least(F.length("l_name"), F.length("r_name")), F.length("l_name") + F.length("r_name")
    return l.join(r, "key").filter(2 * shorter >= least * total - 1e-9).select("l_name", "r_name").distinct()


def close_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """l_id, r_id, l_name, r_name, ratio of the pairs of left (l_id, l_name) and right (r_id, r_name) with a ratio of at least `least`.

    Names meet on choices of characters that a pair surely shares in their order (part_plan), each different name once;
    long ones, of which such choices were too many, on their rarest runs of characters (run_plan). No pair is lost. What
    meets by chance is a small part of what is similar, unless most names begin or end alike. The ratio decides in the
    end. Two empty names have the ratio 1; a null is no name."""
    names = written(left.select(F.col("l_name").alias("name"), F.lit(True).alias("is_left")).union(right.select("r_name", F.lit(False))).filter("name is not null").distinct().select("name", "is_left", F.length("name").alias("n"), F.monotonically_increasing_id().alias("id")), "names")
    lengths = names.groupBy("is_left", "n").agg(F.count("*").alias("names")).collect()  # a row for each length of a name
    sides = [sorted(r["n"] for r in lengths if r["is_left"] == side) for side in (True, False)]
    plans, planned = ({}, {}), set()
    for n, m in itertools.product(*sides):
        if comparable(n, m, least) and (plan := part_plan(n, m, least)) is not None:
            planned.add((n, m))
            for side, size in zip(plans, (n, m), strict=True):
                for part, length, e in plan:
                    kinds = side.setdefault(size, {})
                    kinds[part, length] = max(kinds.get((part, length), 0), e)
    schema = "key long, id long, size int, skipped int"
    l, r = (
        names.filter(F.col("is_left") == side).select("id", "name").repartition("id").mapInArrow(part_keys({n: [(*k, e) for k, e in kinds.items()] for n, kinds in plan.items()}), schema).select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "size", "skipped")))
        for side, x, plan in ((True, "l", plans[0]), (False, "r", plans[1]))
    )
    both = F.col("l_size") + F.col("r_size")
    edits = both - 2 * F.ceil(least * both / 2 - 1e-9)
    pairs = l.hint("merge").join(r, "key").filter((2 * F.least("l_size", "r_size") >= least * both - 1e-9) & (2 * (F.col("l_skipped") + F.col("r_skipped")) <= edits)).select("l_id", "r_id").distinct()
    known = lambda x: names.select(F.col("id").alias(f"{x}_id"), F.col("name").alias(f"{x}_name"))
    met = pairs.join(known("l"), "l_id").join(known("r"), "r_id").select("l_name", "r_name")
    if any((n, m) not in planned and comparable(n, m, least) for n, m in itertools.product(*sides)):
        met = met.unionByName(_meet_on_runs(names, sides, least, planned, sum(x["names"] for x in lengths))).distinct()
    empty = names.filter("n = 0").select(F.col("name").alias("l_name"), F.col("name").alias("r_name")).distinct()
    alike = met.unionByName(empty).withColumn("ratio", similarity("l_name", "r_name")).filter(F.col("ratio") >= least)
    return left.join(alike, "l_name").join(right, "r_name").select("l_id", "r_id", "l_name", "r_name", "ratio")


def fuzzy_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, least: float) -> DataFrame:
    """left_id, right_id, ratio: the most similar right name of each left name, if it reaches `least`; of equals the least id."""
    scored = close_pairs(left.select(F.col(left_id).alias("l_id"), F.col(name).alias("l_name")), right.select(F.col(right_id).alias("r_id"), F.col(name).alias("r_name")), least)
    best = scored.groupBy("l_id").agg(F.max_by("r_id", F.struct("ratio", -F.col("r_id"))).alias("r_id"), F.max("ratio").alias("ratio"))
    return best.select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), F.round("ratio", 6).alias("ratio"))


def containments(left: DataFrame, right: DataFrame) -> DataFrame:
    """l_id, r_id of the names of left (l_id, l_name) and right (r_id, r_name) of which one contains the other.

    The contained one's first four characters (all, if it is shorter) are a run of the other, so that is where they meet."""
    first, runs = lambda c: F.substring(c, 1, 4), lambda c: F.explode(F.flatten(F.array(*(pieces(F.col(c), q) for q in (1, 2, 3, 4)))))
    inner = left.filter("l_name <> ''").withColumn("key", first("l_name")).join(right.select("r_id", "r_name", runs("r_name").alias("key")), "key").filter(F.contains("r_name", "l_name"))
    outer = right.filter("r_name <> ''").withColumn("key", first("r_name")).join(left.select("l_id", "l_name", runs("l_name").alias("key")), "key").filter(F.contains("l_name", "r_name"))
    return inner.select("l_id", "r_id").unionByName(outer.select("l_id", "r_id")).distinct()


def only_one(pairs: DataFrame) -> DataFrame:
    """l_id, r_id of those that have one partner only."""
    return pairs.distinct().groupBy("l_id").agg(F.min("r_id").alias("r_id"), F.count("*").alias("n")).filter("n = 1").select("l_id", "r_id")


def person_match(names: DataFrame, persons: DataFrame, least: float = 0.88) -> DataFrame:
    """name_id, person_id, rule for names (name_id, name) among persons (person_id, name_en, name_ta); no row without a match.

    A Tamil name matches the only person whose Tamil name contains it or is contained (rule script). Others match the most
    similar English name, if it reaches `least` (ratio; of equals the least id); else the only person that has all
    the name's words but for honorifics and single letters (words). Two such persons are no match."""
    ta = has_tamil("name")
    script = only_one(containments(names.filter(ta).select(F.col("name_id").alias("l_id"), F.col("name").alias("l_name")), persons.filter(F.coalesce(F.col("name_ta"), F.lit("")) != "").select(F.col("person_id").alias("r_id"), F.col("name_ta").alias("r_name"))))
    left = names.filter(~ta & F.col("name").isNotNull()).select(F.col("name_id").alias("l_id"), norm_name(decomposed("name")).alias("l_name"))
    right = persons.filter("name_en is not null").select(F.col("person_id").alias("r_id"), norm_name(decomposed("name_en")).alias("r_name"))
    scored = close_pairs(left, right, least)
    ratio = scored.groupBy("l_id").agg(F.max_by("r_id", F.struct("ratio", -F.col("r_id"))).alias("r_id"))
    tokens = F.filter(F.array_distinct(F.split("l_name", " ")), lambda t: (F.length(t) > 1) & ~t.isin(STOP_TOKENS))
    asked = left.join(ratio.select("l_id"), "l_id", "left_anti").select("l_id", tokens.alias("ts")).select("l_id", F.size("ts").alias("n"), F.explode("ts").alias("token"))
    have = right.select("r_id", F.explode(F.array_distinct(F.split("r_name", " "))).alias("token"))
    words = only_one(asked.join(have, "token").groupBy("l_id", "r_id", "n").agg(F.count("*").alias("met")).filter("met = n").select("l_id", "r_id"))
    each = [(script, "script"), (ratio, "ratio"), (words, "words")]
    out = [df.select(F.col("l_id").alias("name_id"), F.col("r_id").alias("person_id"), F.lit(rule).alias("rule")) for df, rule in each]
    return out[0].unionByName(out[1]).unionByName(out[2])


def seat_match(rows: DataFrame, seats: DataFrame, aliases: DataFrame, least: float = 0.8) -> DataFrame:
    """rows (row_id, seat) with code, rule from seats (code, name_en, name_ta); null for both where nothing fits.

    A name is taken without what its script says for "constituency", then as its alias (alias, alias_of), and has to be equal
    (exact). Else a Tamil name fits the only seat that contains it or is contained (containment), an English one the
    most similar seat from `least` on (close; of equals the last name)."""
    ta = has_tamil("seat")
    bare = F.when(ta, F.trim(F.replace("seat", F.lit(SEAT_WORDS), F.lit("")))).otherwise(norm_name(decomposed("seat")))
    also = aliases.select(F.col("alias").alias("l_name"), "alias_of")
    named = rows.filter("seat is not null").select("row_id", ta.alias("ta"), bare.alias("l_name")).join(also, "l_name", "left").select(F.col("row_id").alias("l_id"), "ta", F.coalesce("alias_of", "l_name").alias("l_name"))
    en = seats.filter("name_en is not null").select(F.col("code").alias("r_id"), norm_name(decomposed("name_en")).alias("r_name"))
    local = seats.filter("name_ta is not null").select(F.col("code").alias("r_id"), F.col("name_ta").alias("r_name"))
    known = en.withColumn("ta", F.lit(False)).unionByName(local.withColumn("ta", F.lit(True)))
    exact = named.join(known, (named.l_name == known.r_name) & (named.ta == known.ta)).groupBy("l_id").agg(F.min("r_id").alias("r_id"))
    rest = named.join(exact.select("l_id"), "l_id", "left_anti")
    inside = only_one(containments(rest.filter("ta").select("l_id", "l_name"), local))
    close = close_pairs(rest.filter("not ta").select("l_id", "l_name"), en, least).groupBy("l_id").agg(F.max_by("r_id", F.struct("ratio", "r_name", "r_id")).alias("r_id"))
    rules = [(exact, "exact"), (inside, "containment"), (close, "close")]
    found = [df.select(F.col("l_id").alias("f_id"), F.col("r_id").alias("code"), F.lit(rule).alias("rule")) for df, rule in rules]
    all_found = found[0].unionByName(found[1]).unionByName(found[2])
    return rows.join(all_found, rows.row_id == all_found.f_id, "left").drop("f_id")


def _ratio_bounds(a: Column, b: Column) -> tuple[Column, Column]:
    """known, most: the ratio of two names where one is in the other, else null; and what it can't exceed, null where a name is.

    One more character that is changed, added or left out is at least one less in common. Long names, where common
    characters aren't compared, are never known."""
    n, m = F.length(a), F.length(b)
    inside = ((n > 0) | (m == 0)) & ((m > 0) | (n == 0)) & (n < 200) & (m < 200) & (F.contains(a, b) | F.contains(b, a))
    known = F.when(inside, F.when(n + m == 0, F.lit(1.0)).otherwise(2.0 * F.least(n, m) / (n + m)))
    return known.alias("known"), F.coalesce(known, (n + m - F.levenshtein(a, b)) / F.nullif(n + m, F.lit(0))).alias("most")


def listing_match(listing: DataFrame, holders: DataFrame, aliases: DataFrame, least: float = 0.45, close: float = 0.85, most: int = 3) -> DataFrame:
    """row_id, person_id, seat_key, ratio, skipped for rows of a listing (row_id, name, seat, assets) among holders (person_id, name, seat).

    A row's seat, without its reservation, is one of the holders' seats (or the alias of one), else the `most` closest ones from
    `close` on; without any the row isn't there. The best holder's name has to reach `least`, and assets have to be
    known; else person_id is null and skipped says why. Of equal names the last seat, then the larger id."""
    key = lambda c: norm_name(decomposed(without_reservation(c)))
    also = aliases.select(F.col("alias").alias("key"), "alias_of")
    rows = listing.select("row_id", norm_name(decomposed("name")).alias("name"), "assets", key("seat").alias("key")).join(also, "key", "left").select("row_id", "name", "assets", F.coalesce("alias_of", "key").alias("key"))
    held = holders.select("person_id", norm_name(decomposed("name")).alias("holder"), key("seat").alias("seat_key"))
    seats = held.select("seat_key").distinct()
    exact = rows.join(seats, rows.key == seats.seat_key).select("row_id", "seat_key")
    rest = rows.join(exact.select("row_id"), "row_id", "left_anti")
    near = close_pairs(rest.select(F.col("row_id").alias("l_id"), F.col("key").alias("l_name")), seats.select(F.col("seat_key").alias("r_id"), F.col("seat_key").alias("r_name")), close)
    order = Window.partitionBy("l_id").orderBy(F.desc("ratio"), F.desc("r_name"))
    near = near.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).select(F.col("l_id").alias("row_id"), F.col("r_id").alias("seat_key"))
    # the holders of one seat; a row's name is only measured against those that could be as near as the nearest that is known
    at_seat = held.groupBy("seat_key").agg(F.collect_list(F.struct("holder", "person_id")).alias("holders"))
    seen = F.transform("holders", lambda h: F.struct(h["holder"].alias("holder"), h["person_id"].alias("person_id"), *_ratio_bounds(F.col("name"), h["holder"])))
    met = exact.unionByName(near).join(rows.select("row_id", "name", "assets"), "row_id").join(at_seat, "seat_key").withColumn("seen", seen)
    could = F.filter("seen", lambda h: F.coalesce(h["most"], F.lit(0.0)) >= F.coalesce(F.array_max(F.transform("seen", lambda o: o["known"])), F.lit(0.0)) - 1e-9)
    left = met.select("row_id", "assets", "name", "seat_key", F.explode(could).alias("h"))
    ratio = F.coalesce("h.known", similarity(F.when(F.col("h.known").isNull(), F.col("name")), F.col("h.holder")))
    tried = left.select("row_id", "assets", "seat_key", F.col("h.person_id").alias("person_id"), ratio.alias("ratio"))
    best = tried.groupBy("row_id", "assets").agg(F.max(F.struct("ratio", "seat_key", "person_id")).alias("b"))
    skipped = F.when(F.coalesce(F.col("b.ratio"), F.lit(0.0)) < least, "name differs").when(F.col("assets").isNull(), "no assets")
    return best.select("row_id", F.when(skipped.isNull(), F.col("b.person_id")).alias("person_id"), F.col("b.seat_key").alias("seat_key"), F.round("b.ratio", 6).alias("ratio"), skipped.alias("skipped"))


def resolve_district(current: Column, claims: Column, older: Column, was_split: Column) -> tuple[Column, Column]:
    """The district and where it comes from: the current source; else the only claim; else the older source, unless that
    district was split since, which is withheld; a problem where no source knows one."""
    single = F.array_distinct(F.array_compact(claims))
    one = F.when(F.size(single) == 1, F.element_at(single, 1))
    split = F.coalesce(was_split, F.lit(False))
    district = F.when(current.isNotNull(), current).when(one.isNotNull(), one).when(split, None).otherwise(older)
    reason = F.when(current.isNotNull(), "current").when(one.isNotNull(), "single claim").when(split, "withheld").when(older.isNotNull(), "older source").otherwise("problem")
    return district, reason


def after_party(cells: Column, wanted: Column, parties: Column) -> Column:
    """The first cell that follows a cell with the wanted party and is no party itself."""
    pairs = F.arrays_zip(F.slice(cells, 1, F.greatest(F.size(cells) - 1, F.lit(0))).alias("a"), F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))).alias("b"))
    return F.try_element_at(F.filter(pairs, lambda p: (p["a"] == wanted) & ~F.array_contains(parties, p["b"]) & (p["b"] != "")), F.lit(1))["b"]


def linkage_layers(seats: DataFrame, records: DataFrame, close: float = 0.75, most: int = 3) -> DataFrame:
    """code, record_id, layer, problem for each seat (code, name, base, number, districts, and maybe also: another name) among
    records (record_id, name, base, ordinals, districts), as a walk over the seats in the order of their codes finds them.

    A seat takes the record of its whole name, or else of its other name; else the only free record of its base name in a
    fitting district; else the one with its number, if its district fits; else it tries the `most` closest of all whole
    and base names, the closest first, and takes the first that only one free record in a fitting district has. Of
    records with one whole name or number the last counts; of equally close names the greater comes first, and one that is
    both a whole and a base name counts twice. Districts fit unless both sides name some and none in common. A record is free
    until a seat has it; a seat that comes to one by name or number that isn't is a problem, as is one that finds none.

    The walk goes in rounds of joins: a seat's turn has come when no earlier seat is left that could take any of the
    records it could. Each round takes all such seats, so the rounds are as many as seats hang one on the other."""
    cols = {c: F.col(c) for c in seats.columns}
    s = written(seats.select("code", "name", "base", "number", F.coalesce("districts", F.array().cast("array<string>")).alias("s_districts"), cols.get("also", F.lit(None).cast("string")).alias("also")), "link-seats")
    r = written(records.select("record_id", F.col("name").alias("r_name"), F.col("base").alias("r_base"), "ordinals", F.coalesce("districts", F.array().cast("array<string>")).alias("r_districts")), "link-records")
    fits = (F.size("s_districts") == 0) | (F.size("r_districts") == 0) | F.arrays_overlap("s_districts", "r_districts")
    of_name = r.groupBy("r_name").agg(F.max_by(F.struct("record_id", "r_districts"), "record_id").alias("x")).select("r_name", "x.*")
    of_number = r.withColumn("ordinal", F.explode("ordinals")).groupBy("ordinal").agg(F.max_by(F.struct("record_id", "r_districts"), "record_id").alias("x")).select("ordinal", "x.*")
    take = lambda df, layer, rank, fit: df.select("code", "record_id", F.lit(layer).alias("layer"), rank.cast("int").alias("rank"), fit.alias("fit"))
    zero, yes = F.lit(0), F.lit(True)
    whole = take(s.join(of_name, s.name == of_name.r_name), 0, zero, yes).unionByName(take(s.join(of_name, s.also == of_name.r_name), 0, F.lit(1), yes))
    base = take(s.join(r, s.base == r.r_base), 1, zero, fits)
    number = take(s.join(of_number, s.number == of_number.ordinal), 2, zero, fits)
    wholes, bases = r.filter("r_name is not null").select(F.col("r_name").alias("key")).distinct(), r.filter("r_base is not null").select(F.col("r_base").alias("key")).distinct()
    keys = wholes.withColumn("kind", F.lit(0)).unionByName(bases.withColumn("kind", F.lit(1)))
    near = close_pairs(wholes.union(bases).distinct().select(F.col("key").alias("l_id"), F.col("key").alias("l_name")), s.filter("base is not null").select(F.col("base").alias("r_id"), F.col("base").alias("r_name")).distinct(), close)
    order = Window.partitionBy("r_id").orderBy(F.desc("ratio"), F.desc("key"))
    tried = near.select("r_id", "ratio", F.col("l_id").alias("key")).join(keys, "key").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    tried = written(tried.groupBy("r_id", "key").agg(F.min("rank").alias("rank")), "link-tried")
    meant = of_name.select(F.col("r_name").alias("key"), "record_id", "r_districts").unionByName(r.join(wholes, r.r_base == wholes.key, "left_anti").select(F.col("r_base").alias("key"), "record_id", "r_districts"))
    closest = take(s.join(tried, s.base == tried.r_id).join(meant, "key"), 3, F.col("rank"), fits)
    options = whole.unionByName(base).unionByName(number).unionByName(closest).filter("fit or layer = 0").select("code", "record_id", "layer", "rank").distinct()
    decided = _walk(options)
    names = F.element_at(F.array(*map(F.lit, ("name", "base name", "number", "close name"))), F.col("layer") + 1)
    problem = F.when(F.col("record_id").isNotNull(), F.lit(None)).when(F.col("twice"), "record taken").otherwise("no record")
    return seats.select("code").join(decided, "code", "left").select("code", "record_id", F.when(F.col("record_id").isNotNull(), names).alias("layer"), problem.alias("problem"))


def _walk(options: DataFrame) -> DataFrame:
    """code, record_id, layer, twice: what a walk over codes comes to, each having options (code, record_id, layer, rank)."""
    left = written(options, "link-options")
    decided = written(left.select("code", "record_id", "layer", F.lit(False).alias("twice")).limit(0), "link-decided")
    while not left.isEmpty():
        first = left.filter("record_id is not null").groupBy("record_id").agg(F.min("code").alias("first"))
        # an option whose record is taken has lost its number, so nobody waits for it
        waits = left.join(first, "record_id", "left").groupBy("code").agg(F.max(F.coalesce(F.col("first") < F.col("code"), F.lit(False))).alias("waits"))
        turn = left.join(waits.filter("not waits").select("code"), "code", "left_semi")
        free = turn.groupBy("code", "layer", "rank").agg(F.count("record_id").alias("n"), F.min("record_id").alias("record_id"), F.count("*").alias("all"))
        # a whole name and a number lead to one record, taken or not; the others need exactly one free record
        goes = free.filter(((F.col("layer").isin(0, 2)) & (F.col("all") == 1)) | (F.col("n") == 1))
        chosen = goes.groupBy("code").agg(F.min(F.struct("layer", "rank", "record_id")).alias("c")).select("code", "c.record_id", "c.layer", F.col("c.record_id").isNull().alias("twice"))
        now = written(turn.select("code").distinct().join(chosen, "code", "left").select("code", "record_id", "layer", F.coalesce("twice", F.lit(False)).alias("twice")), "link-decided")
        decided = decided.unionByName(now)
        taken = now.filter("record_id is not null").select(F.col("record_id").alias("t_id"))
        rest = left.join(now.select("code"), "code", "left_anti").join(taken, F.col("record_id") == F.col("t_id"), "left")
        after = written(rest.select("code", F.when(F.col("t_id").isNull(), F.col("record_id")).alias("record_id"), "layer", "rank"), "link-options")
        forget(left)
        left = after
    return decided


def layered(layers: list[DataFrame], left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id, layer: matches layer by layer; a record of either side is used once.

    A layer's match counts if neither record was used before and, in its layer, each has no other partner. What each
    layer gives is written, since all later ones read it."""
    done: DataFrame | None = None
    for i, layer in enumerate(layers):
        free = layer.select(left_id, right_id).distinct()
        if done is not None:
            free = free.join(done.select(left_id), left_id, "left_anti").join(done.select(right_id), right_id, "left_anti")
        free = written(free, "layer-pairs")
        alone = written(unique_claims(free, left_id, right_id).select(left_id, right_id, F.lit(i).alias("layer")), "layer")
        done = alone if done is None else done.unionByName(alone)
    return done


def bilingual_merge(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both languages' rows (key, name) of each key; either may be missing; confidence 1.0 with both, else 0.9."""
    both = first.select(key, F.col("name").alias("name_en")).join(second.select(key, F.col("name").alias("name_ta")), key, "full_outer")
    return both.withColumn("confidence", F.when(F.col("name_en").isNotNull() & F.col("name_ta").isNotNull(), 1.0).otherwise(0.9))


def single_place(hits: DataFrame, item: str, place: str) -> DataFrame:
    """item with its place, if all its hits name one; others have none."""
    return hits.groupBy(item).agg(F.count_distinct(place).alias("n"), F.min(place).alias(place)).select(item, F.when(F.col("n") == 1, F.col(place)).alias(place))

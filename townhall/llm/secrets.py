"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by patterns; their hashes are aggregated over the whole corpus by the distinct
documents (repositories; copies of a text are one) and sources (owners) that hold them. A value that
many owners hold, or many repositories of one owner, is a widely copied example; one that a single owner
holds in a few repositories, and that looks random, looks live. The latter adds spans that no fixed
pattern is strict enough to report by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.llm.common import materialize

#: Kinds in the order in which they are listed: pattern, least length, group that has it. Fixed values.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": (r"AKIA[A-Z0-9]+", 20, 0),
    "hex": (r"[0-9a-f]{24,}", 24, 0),
}
#: Runs that may be credentials; by themselves they prove nothing.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Owners, and repositories, that a value may have at most to look live.
LIVE_OWNERS, LIVE_REPOSITORIES = 1, 5
ORDER = [*KINDS, "owned"]
#: Hashes that may be sent to every task: those that one span in so many has.
HOT = 10_000


#: Values that a running sum copies at a time, and code points of a text's pieces.
RUN, PIECE = 64, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often body's own functions of elements use it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of some integers, what it and all before it come to, from 0 on.

    By runs, then over the runs' ends: an array that grows by one is copied each time, so none of them grows long."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def within(run: Column) -> Column:
        return F.aggregate(run, start, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(combine(acc["at"], x))).alias("out")))

    def joined(scanned: Column) -> Column:
        before = F.aggregate(scanned, start, lambda acc, b: F.struct(combine(acc["at"], b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(scanned, before, lambda b, at: F.transform(b["out"], lambda x: combine(at, x))))

    runs = let(values, lambda vs: F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / RUN).cast("int")), lambda k: F.slice(vs, k * RUN + 1, RUN)))
    return let(F.transform(runs, within), joined)


def spans_of(text: str, kind: str, pattern: str, least: int, group: int) -> Column:
    """The matches of a pattern, leftmost and not overlapping: kind, start, end (code points), value.

    A text is its pieces between matches and its matches in turn; a match ends after all of both up to it.
    """
    column = F.col(text)
    found, values, pieces = F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), F.regexp_extract_all(column, F.lit(pattern), F.lit(group)), F.split(column, pattern, -1)

    def placed(found: Column) -> Column:
        lengths = F.transform(found, lambda f: F.length(f))
        ends = running(F.zip_with(pieces, lengths, lambda p, n: F.length(p) + F.coalesce(n, F.lit(0))), lambda a, b: a + b)
        zipped = F.arrays_zip(F.slice(ends, F.lit(1), F.size(found)).alias("end"), lengths.alias("n"), values.alias("value"))
        kept = F.filter(zipped, lambda x: F.length(x["value"]) >= least)
        return F.transform(kept, lambda x: F.struct((x["end"] - x["n"]).alias("start"), F.lit(ORDER.index(kind)).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    return let(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")))


def looks_random(value: Column) -> Column:
    """Digits, letters of both cases, and many different characters: rarely a word or a number."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9].*[0-9].*[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & (different * 2 >= F.least(F.length(value), F.lit(40)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, owner, text_hash, base, candidates: the spans of every row, found in one pass over the texts.

    docs: doc_id, text and source. A null or empty text has no spans; a null source is an owner of its
    own; null ids and repeated rows each keep their row. Empty tables give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
    base = F.concat(*(spans_of("text", k, *KINDS[k]) for k in KINDS))
    candidates = F.filter(spans_of("text", "owned", CANDIDATE, 20, 0), lambda x: looks_random(x["value"]))
    found = rows.select("doc_id", "owner", F.xxhash64("text").alias("text_hash"), F.array_sort(base).alias("base"), candidates.alias("candidates"))
    hashed = lambda spans: F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"], F.sha2(x["value"], 256).alias("hash")))
    return materialize(found.select("doc_id", "owner", "text_hash", hashed(F.col("base")).alias("base"), hashed(F.col("candidates")).alias("candidates")), "secret-spans")


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, repositories, owners, n: how many different texts and sources of the corpus hold each candidate, and how many spans.

    Both counts begin with distinct rows before the shuffle, so a value that a third of the rows hold is dealt
    out by its texts and owners; only their numbers meet."""
    each = scanned.select("text_hash", "owner", F.explode(F.concat("base", "candidates")).alias("x")).select(F.col("x.hash").alias("hash"), "text_hash", "owner")
    met = each.groupBy("hash", "text_hash", "owner").agg(F.count("*").alias("n"))
    return met.groupBy("hash").agg(F.count_distinct("text_hash").alias("repositories"), F.count_distinct("owner").alias("owners"), F.sum("n").alias("n"))


def with_counts(spans: DataFrame, counts: DataFrame) -> DataFrame:
    """spans with the columns of counts for their hash. Hashes of one span in HOT or more go to all tasks, at most HOT of them;
    the others are too rare for one of them to weigh on the task that it meets in."""
    counts = materialize(counts, "ownership")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT >= total
    hot = F.broadcast(counts.filter(often).drop("n").withColumn("hot", F.lit(True)))  # HOT rows at most
    marked = spans.join(hot, "hash", "left")
    rest = marked.filter("hot is null").drop("repositories", "owners", "hot").join(counts.filter(~often).drop("n"), "hash")
    return marked.filter("hot").drop("hot").unionByName(rest)


def secrets(docs: DataFrame, live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """doc_id, text_hash, base, added, copied for every row of docs: spans (start, kind, end; kind: place in
    ORDER) of the base patterns, the candidates added since at most live_owners owners and live_repositories
    repositories hold them, and how many of all are copied examples (more hold them). Edge cases: see scan().

    The work is in proportion to the spans, also where one text has all of them: spans go their ways as rows, and whether
    a candidate overlaps a base span is seen from its neighbours in the order of their starts.
    """
    scanned = scan(docs)
    # repeated rows have the same spans: one row for each id and text
    once = scanned.filter(F.size(F.concat("base", "candidates")) > 0).select("doc_id", "text_hash", F.concat("base", "candidates").alias("xs")).dropDuplicates(["doc_id", "text_hash"])
    known = with_counts(once.select("doc_id", "text_hash", F.inline("xs")), ownership(scanned))
    of_text = Window.partitionBy("doc_id", "text_hash")
    onward, back = (of_text.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (("start", "kind"), (F.desc("start"), F.desc("kind"))))
    is_base = F.col("kind") != ORDER.index("owned")
    before = F.max(F.when(is_base, F.col("end"))).over(onward)
    after = F.min(F.when(is_base, F.col("start"))).over(back)
    apart = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (after.isNull() | (after >= F.col("end")))
    live = (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)
    judged = known.withColumn("new", ~is_base & live & apart).withColumn("live", live)
    each = judged.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.when(F.col("new"), F.struct("start", "kind", "end")))).alias("added"), F.count_if(~F.col("live")).cast("int").alias("copied")
    )
    each = each.withColumnsRenamed({"doc_id": "e_id", "text_hash": "e_hash"})
    out = scanned.join(each, scanned.doc_id.eqNullSafe(each.e_id) & (scanned.text_hash == each.e_hash), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    plain = F.transform("base", lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return out.select("doc_id", "text_hash", plain.alias("base"), F.coalesce("added", none).alias("added"), F.coalesce("copied", F.lit(0)).alias("copied"))


def span_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    name = F.array(*(F.lit(k) for k in ORDER))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column, mask: str = "<secret>") -> Column:
    """The text with its sorted spans masked; spans that overlap are masked as one. What stays is taken from pieces of
    the text, so that no place is searched for from the text's start."""

    def part(pieces: Column, a: Column, b: Column) -> Column:
        """The code points from a to b."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        at = lambda k: F.coalesce(F.try_element_at(pieces, k + 1), F.lit(""))
        within = F.substring(at(first), a % PIECE + 1, b - a)
        across = F.concat(F.substring(at(first), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(at(last), F.lit(1), b - last * PIECE))
        return F.when(b <= a, "").when(first == last, within).otherwise(across)

    def masked(pieces: Column, spans: Column) -> Column:
        ends = running(F.transform(spans, lambda x: x["end"]), F.greatest)
        # what stands before each span, if none before it reaches over its start
        before = lambda ends: F.zip_with(F.transform(spans, lambda x: x["start"]), F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1)), lambda s, e: F.when(s >= e, F.concat(part(pieces, e, s), F.lit(mask))).otherwise(""))
        return let(ends, lambda es: F.concat(F.array_join(before(es), ""), part(pieces, F.element_at(es, -1), F.size(pieces) * PIECE)))

    whole = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda ps: let(spans, lambda xs: masked(ps, xs)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)

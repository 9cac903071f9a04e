"""Merkle manifest of a dataset by butterfly exchange; DataFrame functions only.

Leaves are numbered in their source's order and dealt out in aligned blocks, which are the tree's partitions. A block
hashes its own leaves up to one node. From there on blocks climb together: in each round the blocks of fanout aligned
groups swap the roots of their groups, block by block with the same place, and every one of them hashes the run to the
common parent. So each block meets all siblings on its way up and has its proof, and the root, when the rounds end;
nothing is sent down again. Where the last group of a source has fewer blocks than its neighbours, its blocks answer
for the missing ones in turn. The roots of the sources are the leaves of one more tree, built in the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.llm.common import materialize

FANOUT = 16
#: Levels inside a block: a block has 4,096 leaves.
BLOCK_LEVELS = 3
STEPS = "array<struct<before:string,after:string>>"


def digest(fields: list[Column]) -> Column:
    """SHA-256, in hex, of fields as length, colon, value; a null field is a hyphen."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text)), 256)


def source_key(source: Column) -> Column:
    """A source as text that is never null and sorts like it, null first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _parents(nodes: Column) -> Column:
    """The next level: a hash for each run of nodes."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, (i * FANOUT + 1).cast("int"), FANOUT), ""), 256))


def _step(run: Column, at: Column) -> Column:
    """The siblings to the left and to the right of a node in its run."""
    before, after = F.slice(run, F.lit(1), at.cast("int")), F.slice(run, (at + 2).cast("int"), FANOUT)
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx, their place in their group by order (nulls first), and n, the group's size.

    The rows are ranged once over all partitions, whatever group they are of, so a hot group is spread; what else is
    needed is one number for a partition and group."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ordered")
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    parts = Window.partitionBy(group)
    before = F.coalesce(F.sum("size").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(group, "part", "first", before.alias("ahead"), F.sum("size").over(parts).alias("n"))
    return placed.join(starts, [group, "part"]).withColumn("idx", F.col("at") - F.col("first") + F.col("ahead")).drop("at", "part", "first", "ahead")


def blocks_of(leaves: DataFrame, levels: int) -> DataFrame:
    """grp, n, block, kept (the leaves' payloads in order), nodes (each level inside the block) and node, what the block
    comes to, for leaves (grp, n, idx, node, payload). A level is there while the group has several nodes."""
    size = FANOUT**levels
    one = F.struct("idx", "node", "payload")
    held = leaves.groupBy("grp", "n", F.floor(F.col("idx") / size).alias("block")).agg(F.sort_array(F.collect_list(one)).alias("held"))
    out = held.select("grp", "n", "block", F.transform("held", lambda x: x["payload"]).alias("kept"), F.transform("held", lambda x: x["node"]).alias("nodes0"))
    for i in range(levels):
        out = out.withColumn(f"nodes{i + 1}", F.when(F.col("n") > FANOUT**i, _parents(F.col(f"nodes{i}"))))
    top = F.coalesce(*(F.col(f"nodes{i}")[0] for i in range(levels, -1, -1)))
    return out.select("grp", "n", "block", "kept", F.array(*(f"nodes{i}" for i in range(levels + 1))).alias("nodes"), top.alias("node"))


def _receivers(size: int, place: Column, m: Column):
    """The blocks of a group of `size` blocks that a block at this place in its own group of m sends to."""

    def of_group(g: Column) -> Column:
        there = F.least(F.lit(size), F.col("blocks") - g * size)
        every = F.transform(F.sequence(place, F.greatest(place, there - 1), m), lambda j: g * size + j)
        return F.when(place < there, every).otherwise(F.array().cast("array<bigint>"))

    return of_group


def exchange(blocks: DataFrame, levels: int) -> DataFrame:
    """grp, block, node, path for blocks (grp, n, block, node): the root that all blocks of a group arrive at, and each
    block's siblings on the way, one step a round.

    In round r, blocks stand in groups of fanout ** r. A block sends its group's root to the blocks with the same place in
    the other groups of its run; if its group is a short last one of m blocks, to every m-th from its own place on. Each
    gets at most fanout nodes, and their number is what limits a task's rows, not the number of blocks."""
    width = FANOUT**levels
    state = blocks.select("grp", "block", F.ceil(F.col("n") / width).alias("blocks"), "node", F.array().cast(STEPS).alias("path"))
    most, size = state.agg(F.max("blocks")).first()[0] or 0, 1
    while size < most:
        active, own, place = F.col("blocks") > size, F.expr(f"block div {size}"), F.col("block") % size
        m = F.least(F.lit(size), F.col("blocks") - own * size)
        first, last = own - own % FANOUT, F.least(own - own % FANOUT + FANOUT - 1, F.expr(f"(blocks - 1) div {size}"))

        targets = F.when(active, F.flatten(F.transform(F.sequence(first, last), _receivers(size, place, m)))).otherwise(F.array("block"))
        sent = state.select("grp", "blocks", F.explode(targets).alias("to"), F.struct((own % FANOUT).alias("at"), "node").alias("sent"), F.when(F.col("to") == F.col("block"), F.col("path")).alias("path"))
        got = sent.groupBy("grp", "blocks", F.col("to").alias("block")).agg(F.sort_array(F.collect_list("sent")).alias("sent"), F.max("path").alias("path"))
        run = F.transform("sent", lambda x: x["node"])
        step = _step(run, own % FANOUT)
        state = got.select(
            "grp", "block", "blocks", F.when(active, F.sha2(F.array_join(run, ""), 256)).otherwise(run[0]).alias("node"),
            F.when(active, F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"),
        )
        size *= FANOUT
    return state.select("grp", "block", "node", "path")


def climbed(leaves: DataFrame, levels: int, name: str) -> DataFrame:
    """grp, top, kept, nodes, upper: the blocks of leaves (grp, n, idx, node, payload) with their group's root (top) and the steps above the block."""
    blocks = materialize(blocks_of(leaves, levels), f"{name}-blocks")
    upper = materialize(exchange(blocks, levels), f"{name}-proofs")
    upper = upper.withColumnsRenamed({"grp": "u_grp", "block": "u_block", "node": "top", "path": "upper"})
    return blocks.join(upper, (F.col("grp") == F.col("u_grp")) & (F.col("block") == F.col("u_block"))).select("grp", "top", "kept", "nodes", "upper")


def proofs(blocks: DataFrame, levels: int) -> DataFrame:
    """The blocks' columns, and payload, node and path (the steps up to the root) of each of their leaves.

    A leaf's steps inside its block are made before the block's rows part, so none of them carries the block."""

    def proved(payload: Column, p: Column) -> Column:
        nodes, at = F.col("nodes"), lambda i: F.floor(p / FANOUT**i)
        inner = [F.when(nodes[i + 1].isNotNull(), _step(F.slice(nodes[i], (at(i + 1) * FANOUT + 1).cast("int"), FANOUT), at(i) % FANOUT)) for i in range(levels)]
        return F.struct(payload.alias("payload"), nodes[0][p].alias("node"), F.array_compact(F.array(*inner)).alias("inner"))

    rest = [c for c in blocks.columns if c not in ("kept", "nodes", "upper")]
    each = blocks.select(*rest, "upper", F.explode(F.transform("kept", proved)).alias("x"))
    return each.select(*rest, "x.payload", "x.node", F.concat("x.inner", "upper").alias("path"))


def manifest(rows: DataFrame, fields: list[str], changed: dict[str, Column] | None = None, when: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, changed_leaf, subroot, root, path for every row: its leaf over fields (doc_id first), the leaf with some
    fields changed where `when` holds (else null), the roots of its source and of all, and the steps of its proof.

    rows: the fields, doc_id and source among them; other columns don't matter. Leaves stand by doc_id, null first, rows
    with one id by their leaves; repeated rows each keep their leaf. A null source is a source of its own and comes
    first. Nulls count as nulls in a leaf, not as empty texts. An empty table gives no rows, and no root. Texts are read
    once; what is sorted and grouped after that are digests."""
    after = [(changed or {}).get(f, F.col(f)) for f in fields]
    of_change = F.when(when, digest(after)) if when is not None else F.lit(None).cast("string")
    leaves = rows.select(source_key(F.col("source")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), digest([F.col(f) for f in fields]).alias("node"), of_change.alias("changed"))
    leaves = materialize(leaves, "leaves")
    ordered = numbered(leaves, "grp", ["doc_id", "node"]).select("grp", "n", "idx", "node", F.struct("doc_id", "changed").alias("payload"))
    own = climbed(ordered, levels, "leaves")
    subroots = own.groupBy("grp").agg(F.max("top").alias("node")).select(F.lit("").alias("grp"), F.col("grp").alias("payload"), "node")
    sources = climbed(numbered(subroots, "grp", ["payload"]).select("grp", "n", "idx", "node", "payload"), levels, "sources")
    above = proofs(sources, levels).select(F.col("payload").alias("a_grp"), F.col("top").alias("root"), F.col("path").alias("above"))
    # blocks meet the steps above their source, a row each; only then their leaves part
    met = own.join(above, F.col("grp") == F.col("a_grp")).withColumn("upper", F.concat("upper", "above")).drop("grp", "a_grp", "above")
    return proofs(met, levels).select("payload.doc_id", F.col("node").alias("leaf"), F.col("payload.changed").alias("changed_leaf"), F.col("top").alias("subroot"), "root", "path")


def proof_digest(path: Column) -> Column:
    """One hash over all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof come to."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def lower_ascii(text: Column) -> Column:
    """A text with A-Z in lower case and nothing else changed; null stays."""
    capitals = [chr(c) for c in range(ord("A"), ord("Z") + 1)]
    other = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c.lower())), capitals, text)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(other)

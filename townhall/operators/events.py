"""Event grouping of news items: signatures, candidate pairs, clusters and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.operators.graph import forget, least_labels, written

#: Strings too common to link two stories. Fixed values.
GENERIC = ["tamil nadu", "தமிழ்நாடு", "tamilnadu", "india", "இந்தியா", "tn"]
HOURS = 72


def signatures(items: DataFrame, entities: DataFrame) -> DataFrame:
    """item_id, published_at, persons, districts, strings of every item with a time; entities: item_id, kind, value."""
    value = F.when(F.col("kind") == "string", F.lower(F.trim("value"))).otherwise(F.col("value"))
    known = entities.withColumn("value", value).filter((F.col("kind") != "string") | ~F.col("value").isin(GENERIC))
    sets = known.groupBy("item_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(f"{k}s") for k in ("person", "district", "string")))
    none = F.array().cast("array<string>")
    joined = items.filter("published_at is not null").select("item_id", "published_at").join(sets, "item_id", "left")
    return joined.select("item_id", "published_at", *(F.coalesce(f"{k}s", none).alias(f"{k}s") for k in ("person", "district", "string")))


def candidate_pairs(signed: DataFrame, hours: int = HOURS) -> DataFrame:
    """item_a < item_b, n_persons, n_strings of items that share a person, two strings, or a district and a string, less than so many hours apart.

    Items meet within neighbouring windows of time on just that: a person, a pair of strings, or a district with a string.
    So a word that all items have joins none by itself, and all that meets in time is a pair of the result."""
    window = F.floor(F.unix_timestamp(F.col("published_at").cast("timestamp")) / (hours * 3600))
    strings = F.array_sort("strings")
    apart = lambda tag, x, y: F.concat(F.lit(tag), x, F.lit("\0"), y)
    twos = F.flatten(F.transform(strings, lambda x, i: F.transform(F.slice(strings, i + 2, F.greatest(F.size(strings) - 1 - i, F.lit(0))), lambda y: apart("2:", x, y))))
    local = F.flatten(F.transform("districts", lambda d: F.transform(strings, lambda x: apart("d:", d, x))))
    keys = F.concat(F.transform("persons", lambda p: F.concat(F.lit("p:"), p)), twos, local)
    one = signed.select("item_id", F.unix_timestamp(F.col("published_at").cast("timestamp")).alias("at"), F.explode(F.transform(keys, lambda k: F.xxhash64(k))).alias("key"), window.alias("w"))
    a = one.select(F.col("item_id").alias("item_a"), F.col("at").alias("at_a"), "key", F.explode(F.array(F.col("w") - 1, "w", F.col("w") + 1)).alias("w"))
    b = one.select(F.col("item_id").alias("item_b"), F.col("at").alias("at_b"), "key", "w")
    met = a.join(b, ["key", "w"]).filter((F.col("item_a") < F.col("item_b")) & (F.abs(F.col("at_a") - F.col("at_b")) < hours * 3600)).select("item_a", "item_b").distinct()
    of = lambda x: signed.select(F.col("item_id").alias(f"item_{x}"), F.col("persons").alias(f"p_{x}"), F.col("strings").alias(f"s_{x}"), F.col("districts").alias(f"d_{x}"))
    sized = lambda c: F.size(F.array_intersect(f"{c}_a", f"{c}_b")).cast("bigint")
    counted = met.join(of("a"), "item_a").join(of("b"), "item_b").select("item_a", "item_b", sized("p").alias("n_persons"), sized("s").alias("n_strings"), F.arrays_overlap("d_a", "d_b").alias("near"))
    # keys are hashes; the sets decide
    linked = (F.col("n_persons") >= 1) | (F.col("n_strings") >= 2) | (F.coalesce("near", F.lit(False)) & (F.col("n_strings") >= 1))
    return counted.filter(linked).select("item_a", "item_b", "n_persons", "n_strings")


def event_clusters(signed: DataFrame, confirmed: DataFrame) -> DataFrame:
    """item_id, cluster_id: components of the confirmed pairs (item_a, item_b), under their least item."""
    links = confirmed.select(F.col("item_a").alias("a"), F.col("item_b").alias("b"))
    return least_labels(links, signed.select(F.col("item_id").alias("node"))).select(F.col("node").alias("item_id"), F.col("label").alias("cluster_id"))


def greedy_clusters(signed: DataFrame, confirmed: DataFrame) -> DataFrame:
    """item_id, cluster_id by the order of time: an item joins the first (least) of the clusters of earlier items
    that it has a confirmed pair with, or else begins one; clusters never merge.

    Pairs lead from the earlier item to the later one. Each item points to the earlier item whose cluster is the least so
    far, and follows the pointers to where they begin, in steps that double; then it looks again, until nobody finds a
    lesser one. So a cluster passes along a chain of pairs in rounds as its length has digits, and not one by one.
    What rounds join is shuffled: sent to all tasks, each round's table would pass through the driver."""
    items = written(signed.groupBy("item_id").agg(F.min(F.struct(F.col("published_at").isNull(), "published_at", "item_id")).alias("at")), "items")
    a, b = (items.select(F.col("item_id").alias(f"item_{x}"), F.col("at").alias(f"at_{x}")) for x in "ab")
    met = confirmed.select("item_a", "item_b").filter("item_a <> item_b").join(a, "item_a").join(b, "item_b")
    first = F.col("at_a") < F.col("at_b")
    links = written(met.select(F.when(first, F.col("item_a")).otherwise(F.col("item_b")).alias("earlier"), F.when(first, F.col("item_b")).otherwise(F.col("item_a")).alias("later"), F.when(first, F.col("at_a")).otherwise(F.col("at_b")).alias("at")).distinct(), "links")
    # at first everyone points to the earliest item of its pairs
    starts = links.groupBy(F.col("later").alias("item_id")).agg(F.min_by("earlier", "at").alias("to"))
    pointed = written(items.join(starts, "item_id", "left").select("item_id", F.coalesce("to", "item_id").alias("to")), "pointed")
    labels = _followed(pointed)
    while True:
        l, e = (labels.select(F.col("item_id").alias(x), F.col("label").alias(f"{x}_label")) for x in ("later", "earlier"))
        lesser = links.select("earlier", "later").hint("merge").join(e, "earlier").groupBy("later").agg(F.min(F.struct("earlier_label", "earlier")).alias("m"))
        better = written(lesser.hint("merge").join(l, "later").filter("m.earlier_label < later_label").select(F.col("later").alias("item_id"), F.col("m.earlier").alias("turned")), "turned")
        if better.isEmpty():
            break
        turned = written(pointed.hint("merge").join(better, "item_id", "left").select("item_id", F.coalesce("turned", "to").alias("to")), "pointed")
        after = _followed(turned)
        forget(pointed, labels, better)
        pointed, labels = turned, after
    forget(items, links, pointed, better)
    return labels.select("item_id", F.col("label").alias("cluster_id"))


def _followed(pointed: DataFrame) -> DataFrame:
    """item_id, label: where the pointers (item_id, to) of each item lead; an item that points to itself is an end."""
    at = pointed
    while True:
        on = at.select(F.col("item_id").alias("to"), F.col("to").alias("next"))
        after = written(at.hint("merge").join(on, "to").select("item_id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "followed")
        if at is not pointed:
            forget(at)
        at = after
        if not at.filter("moved").limit(1).count():
            labels = at.select("item_id", F.col("to").alias("label"))
            labels.folder = at.folder
            return labels


def fitting_clusters(new: DataFrame, members: DataFrame, hours: int = HOURS) -> DataFrame:
    """item_id, cluster_id of the new items and the clusters that they fit; new and members (these with cluster_id) are signatures.

    An item fits a cluster whose joint signature (all that its members have) shares a person, two strings, or a district and
    a string with it, and that has a member less than so many hours away. They meet on a person or string within the windows
    of time around the cluster's members, so a word that all have joins none that are far apart."""
    seconds = lambda: F.unix_timestamp(F.col("published_at").cast("timestamp"))
    window = F.floor(seconds() / (hours * 3600))
    tokens = F.concat(F.transform("persons", lambda p: F.concat(F.lit("p:"), p)), F.transform("strings", lambda s: F.concat(F.lit("s:"), s)))
    own = new.select("item_id", window.alias("w"), F.explode(F.array_distinct(tokens)).alias("token"))
    around = members.select("cluster_id", F.explode(F.array(window - 1, window, window + 1)).alias("w")).distinct()
    joint = members.select("cluster_id", F.explode(tokens).alias("token")).distinct().join(around, "cluster_id")
    shared = own.join(joint, ["token", "w"]).groupBy("item_id", "cluster_id").agg(F.count_if(F.startswith("token", F.lit("p:"))).alias("n_persons"), F.count_if(F.startswith("token", F.lit("s:"))).alias("n_strings"))
    places = members.select("cluster_id", F.explode("districts").alias("district")).distinct()
    near = shared.filter("n_persons = 0 and n_strings = 1").join(new.select("item_id", F.explode(F.array_distinct("districts")).alias("district")), "item_id").join(places, ["cluster_id", "district"]).select("item_id", "cluster_id").distinct()
    fits = shared.filter("n_persons > 0 or n_strings > 1").select("item_id", "cluster_id").unionByName(near)
    at = lambda df, c: df.select(c, seconds().alias(f"{c}_at"))
    return fits.join(at(new, "item_id"), "item_id").join(at(members, "cluster_id"), "cluster_id").filter(F.abs(F.col("item_id_at") - F.col("cluster_id_at")) < hours * 3600).select("item_id", "cluster_id").distinct()


def assign_to_clusters(new: DataFrame, members: DataFrame, judged: DataFrame, tries: int = 3, hours: int = HOURS) -> DataFrame:
    """item_id, cluster_id of the new items that join a cluster; new and members (these with cluster_id) are signatures.

    Of the clusters that an item fits (fitting_clusters) the first `tries` are judged (item_id, cluster_id, same), and it
    joins the first that is the same event."""
    timely = fitting_clusters(new, members, hours)
    order = Window.partitionBy("item_id").orderBy("cluster_id")
    tried = timely.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= tries)
    same = tried.join(judged.filter("same").select("item_id", "cluster_id").distinct(), ["item_id", "cluster_id"])
    return same.groupBy("item_id").agg(F.min("cluster_id").alias("cluster_id"))


def advance_clusters(state: DataFrame, batch: DataFrame, judged: DataFrame, confirmed: DataFrame, since: Column, tries: int = 3) -> DataFrame:
    """The state of clusters after one more run: signatures with cluster_id, null for items that wait without a cluster.

    New items join a cluster of the state if they can (assign_to_clusters); the rest and those that waited pair with one
    another by confirmed (item_a, item_b): an item joins what the earlier one of its pairs began, under its id. Items
    not published after `since` take no part, however late they come, and clusters show those after it only."""
    columns = ["item_id", "published_at", "persons", "districts", "strings"]
    live = F.col("published_at") > since
    old, new = state.filter(live), batch.filter(live).select(*columns)
    joined = assign_to_clusters(new, old.filter("cluster_id is not null"), judged, tries)
    placed = written(new.join(joined, "item_id", "left"), "placed")
    pool = written(old.filter("cluster_id is null").select(*columns).unionByName(placed.filter("cluster_id is null").select(*columns)), "pool")
    known = pool.select("item_id")
    pairs = confirmed.join(known.withColumnRenamed("item_id", "item_a"), "item_a", "left_semi").join(known.withColumnRenamed("item_id", "item_b"), "item_b", "left_semi")
    began = greedy_clusters(pool, pairs)
    real = began.groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n > 1").select("cluster_id")
    paired = pool.join(began.join(real, "cluster_id", "left_semi"), "item_id", "left")
    past = state.filter(~F.coalesce(live, F.lit(False)))
    kept = [past, old.filter("cluster_id is not null"), placed.filter("cluster_id is not null"), paired]
    out = kept[0].select(*columns, "cluster_id")
    for df in kept[1:]:
        out = out.unionByName(df.select(*columns, "cluster_id"))
    return out


def cluster_locality(members: DataFrame) -> DataFrame:
    """cluster_id, district: the one district of all members that name exactly one; null if they differ or none does."""
    one = members.filter(F.size("districts") == 1).groupBy("cluster_id").agg(F.count_distinct(F.element_at("districts", 1)).alias("n"), F.min(F.element_at("districts", 1)).alias("d"))
    return members.select("cluster_id").distinct().join(one, "cluster_id", "left").select("cluster_id", F.when(F.col("n") == 1, F.col("d")).alias("district"))


def membership_hash(members: DataFrame) -> DataFrame:
    """cluster_id, hash: the first 32 hex digits over ids and headlines in the order of ids."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "headline"))), lambda m: F.concat_ws(":", m["item_id"], F.coalesce(m["headline"], F.lit("")))), "\n")
    return members.groupBy("cluster_id").agg(F.substring(F.sha2(text, 256), 1, 32).alias("hash"))


def changed_groups(now: DataFrame, before: DataFrame) -> DataFrame:
    """Clusters whose hash isn't what it was; new ones among them."""
    old = before.select("cluster_id", F.col("hash").alias("old"))
    return now.join(old, "cluster_id", "left").filter(~F.col("hash").eqNullSafe(F.col("old"))).select("cluster_id", "hash")


def evidence_pack(members: DataFrame, order: list[Column], cap: int = 6) -> DataFrame:
    """cluster_id, outlet, item_id, slot: one item for each outlet, the last one, in the slot of its first; the first `cap` slots."""
    ordered = members.withColumn("n", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order)))
    each = ordered.groupBy("cluster_id", "outlet").agg(F.min("n").alias("first"), F.max_by("item_id", "n").alias("item_id"))
    slot = F.row_number().over(Window.partitionBy("cluster_id").orderBy("first"))
    return each.withColumn("slot", slot).filter(F.col("slot") <= cap).select("cluster_id", "outlet", "item_id", "slot")


def citation_links(summaries: DataFrame, citations: DataFrame) -> DataFrame:
    """cluster_id, marker, item_id: each different [n] of a summary with the n-th citation; null if there is none."""
    marks = summaries.select("cluster_id", F.explode(F.array_distinct(F.regexp_extract_all("summary", F.lit(r"\[(\d{1,6})\]"), F.lit(1)))).alias("m")).select("cluster_id", F.col("m").cast("int").alias("marker"))
    placed = citations.select("cluster_id", F.posexplode("citations").alias("pos", "item_id")).withColumn("marker", F.col("pos") + 1).drop("pos")
    return marks.join(placed, ["cluster_id", "marker"], "left")


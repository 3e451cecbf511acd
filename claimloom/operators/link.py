"""Records and their links: which records speak of one entity.

Everything is keyed by strings and joined by equality; no step gathers the records of a key in one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import name_key
from claimloom.operators.components import components
from claimloom.operators.reserve import in_order
from claimloom.storage import stored

_IDS = ("candidate_ids", "emails", "phones")


def record_id(source: Column, record_key: Column) -> Column:
    """One string per record that sorts by source, then key."""
    return F.concat(source, F.lit("\u0001"), record_key)


def records(claims: DataFrame) -> DataFrame:
    """(rid, source, record_key, candidate_ids, emails, phones, names): the claims of a source about one record."""
    value = lambda field: F.when(F.col("field_path") == field, F.col("value_str"))
    sets = [F.array_sort(F.collect_set(value(f))).alias(n) for f, n in (("candidate_id", "candidate_ids"), ("emails", "emails"), ("phones", "phones"))]
    names = F.array_sort(F.collect_set(name_key(value("full_name")))).alias("names")
    # most claims say nothing that links records: these become one row a record before anything is collected
    told = F.col("field_path").isin("candidate_id", "emails", "phones", "full_name")
    said = claims.where("source is not null and record_key is not null").select(
        "source", "record_key", F.when(told, F.col("field_path")).alias("field_path"), F.when(told, F.col("value_str")).alias("value_str")
    )
    grouped = said.distinct().groupBy("source", "record_key").agg(*sets, names)
    return grouped.withColumn("rid", record_id(F.col("source"), F.col("record_key")))


def identifier_edges(recs: DataFrame) -> DataFrame:
    """(u, v): each record tied to the least record that shares an id, address or number; linear in identifiers."""

    def tagged_as(kind: str) -> Column:
        return F.transform(F.col(kind), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    tagged = F.array(*map(tagged_as, _IDS))
    owned = recs.select("rid", F.explode(F.flatten(tagged)).alias("id")).select("rid", "id.kind", "id.value")
    least = owned.groupBy("kind", "value").agg(F.min("rid").alias("v"), F.count("*").alias("n")).where("n > 1")
    return owned.join(least, ["kind", "value"]).select(F.col("rid").alias("u"), "v").where("u != v")


def strong_clusters(recs: DataFrame) -> DataFrame:
    """(rid, cluster): records joined by shared identifiers; a cluster is named after its least record."""
    comp = components(identifier_edges(recs)).withColumnRenamed("node", "rid")
    return recs.select("rid").join(comp, "rid", "left").select("rid", F.coalesce("component", "rid").alias("cluster"))


def attach_by_name(recs: DataFrame, strong: DataFrame, compat: str = "default") -> DataFrame:
    """(rid, cluster): clusters that share a name key become one, unless they hold two explicit ids.

    Empty name keys link nothing.  ``compat="reference"`` looks ids up by the clusters' state before any
    name was handled, and lets empty keys link, as the design this engine follows does.
    """
    own = recs.join(strong, "rid")
    named = own.select("cluster", F.explode("names").alias("name"))
    if compat != "reference":
        named = named.where("name != ''")
    named = named.distinct()
    ids = own.select("cluster", F.explode("candidate_ids").alias("id")).distinct()
    if compat != "reference":
        # clusters only gain ids, so a name that two ids bear already can never link anything
        torn = named.join(ids, "cluster").groupBy("name").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b")
        named = named.join(torn, "name", "left_anti")
    shared = named.groupBy("name").agg(F.min("cluster").alias("least"), F.count("*").alias("n")).where("n > 1")
    ties = stored(named.join(shared, "name").select("cluster", "name", "least", "n"), "name-ties")
    if compat != "reference" and ties.where("n > 2").isEmpty():
        # names of two clusters are all handled in few rounds, so groups without two ids need not be told apart first
        moved = in_order(ties, ids)
        return strong.join(moved, "cluster", "left").select("rid", F.coalesce("merged", "cluster").alias("cluster"))
    group = components(ties.select(F.col("cluster").alias("u"), F.col("least").alias("v"))).select(
        F.col("node").alias("cluster"), F.col("component").alias("super")
    )
    per_super = group.join(ids, "cluster").groupBy("super").agg(F.count_distinct("id").alias("n_ids"))
    judged = stored(group.join(per_super, "super", "left").withColumn("n_ids", F.coalesce("n_ids", F.lit(0))), "name-groups")
    free = judged.where("n_ids < 2").select("cluster", F.col("super").alias("merged"))
    torn_groups = judged.where("n_ids >= 2").select("cluster")
    tight = in_order(ties.join(torn_groups, "cluster", "left_semi").select("cluster", "name"), ids, compat == "reference")
    moved = free.union(tight)
    return strong.join(moved, "cluster", "left").select("rid", F.coalesce("merged", "cluster").alias("cluster"))


def link(claims: DataFrame, compat: str = "default") -> DataFrame:
    """(source, record_key, cluster) for every record of the claims."""
    recs = stored(records(claims), "records")
    strong = stored(strong_clusters(recs), "strong-clusters")
    return recs.select("rid", "source", "record_key").join(attach_by_name(recs, strong, compat), "rid").drop("rid")


def over_merged(claims: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, candidate_ids): clusters that hold more than one explicit id; a sign of wrong shared identifiers."""
    ids = claims.where("field_path = 'candidate_id'").join(clusters, ["source", "record_key"])
    found = ids.groupBy("cluster").agg(F.array_sort(F.collect_set("value_str")).alias("candidate_ids"))
    return found.where("size(candidate_ids) > 1")


def unknown_sources(claims: DataFrame) -> DataFrame:
    """(source, claims): sources without a trust value, whose claims always lose."""
    from claimloom.schema import trust

    return claims.where(trust(F.col("source")) == 0).groupBy("source").agg(F.count("*").alias("claims"))


#: Rows of one identifier on either side that one cell of the join may hold.
CELL_ROWS = 4096


def _cells(side: DataFrame, heavy: DataFrame, own: str, other: str, by: list[str]) -> DataFrame:
    """Rows of ``side`` under (id, ``own``, ``other``): their own cell by a hash of ``by``, and every cell of the other side."""
    split = lambda n: F.coalesce(F.col(n), F.lit(1))
    cut = side.join(heavy, "id", "left").withColumn("mine", F.pmod(F.xxhash64(*by), split(f"{own}_cells")).cast("int"))
    return cut.select(*side.columns, F.col("mine").alias(own), F.explode(F.sequence(F.lit(0), (split(f"{other}_cells") - 1).cast("int"))).alias(other))


def attribute_sources(profiles: DataFrame, claims: DataFrame, by: str = "record_key", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(candidate_id, source, ``by``): sources that share an identifier or a name key with a profile.

    Identifiers are counted on both sides first; one that many bear is joined in cells of about ``cell_rows`` rows of each side, so a
    task sees a bounded part of it.  Empty tables give an empty table; rows with nulls in the place of identifiers match nothing.
    """
    mine = F.array_compact(F.concat("emails", "phones", F.array("candidate_id", name_key(F.col("full_name")))))
    wanted = profiles.select("candidate_id", F.explode(F.array_distinct(mine)).alias("id")).distinct()
    theirs = claims.select(
        "source",
        by,
        F.when(F.col("field_path").isin("emails", "phones", "candidate_id"), F.col("value_str"))
        .when(F.col("field_path") == "full_name", name_key(F.col("value_str")))
        .alias("id"),
    )
    theirs = stored(theirs.where("id is not null").distinct(), "attributed-records")
    wanted = stored(wanted, "attributed-profiles")
    cells = lambda n: F.ceil(F.col(n) / F.lit(cell_rows))
    heavy = (
        wanted.groupBy("id").agg(F.count("*").alias("a"))
        .join(theirs.groupBy("id").agg(F.count("*").alias("b")), "id")
        .where((F.col("a") > cell_rows) | (F.col("b") > cell_rows))
        .select("id", cells("a").alias("p_cells"), cells("b").alias("r_cells"))
    )
    heavy = stored(heavy, "attributed-heavy")
    pairs = _cells(theirs, heavy, "r", "p", ["source", by]).join(_cells(wanted, heavy, "p", "r", ["candidate_id"]), ["id", "p", "r"])
    return pairs.select("candidate_id", "source", by).distinct()

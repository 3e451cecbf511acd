"""Names handled in order, in parallel: deterministic reservations.

Each name would merge all clusters that bear it, names in order, unless two explicit ids met.  In a round every cluster is
reserved by the least name that still waits at it.  A name that holds all its clusters is decided, as no earlier name can
change them.  A name that holds all but one, where the held ones bear no id, is decided too: whatever happens at the other one
first, its own clusters come to it alone and without an id.  So every cluster without an id moves in each round where names have two
clusters; a long chain takes about log2 rounds.  A name's clusters are only counted and compared, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.storage import stored


def _decided(left: DataFrame, stale: bool) -> DataFrame:
    """(name, verdict, target): merge, drop or wait for each name of ``left`` (name, root, own, lo, hi).

    ``target`` is the one cluster that the others of a merging name go to: one with an id or held by an earlier name, else the least.
    """
    holder = left.groupBy("root").agg(F.min("name").alias("holder"))
    held = F.col("name") == F.col("holder")
    bare = held & F.col("lo").isNull()
    counted = F.col("own") if stale else F.lit(True)
    per_name = left.join(holder, "root").groupBy("name").agg(
        F.count("*").alias("n"),
        F.min(F.when(counted, F.col("lo"))).alias("lo"),
        F.max(F.when(counted, F.col("hi"))).alias("hi"),
        F.count_if(held).alias("held"),
        F.count_if(bare).alias("bare"),
        F.coalesce(F.min(F.when(~bare, F.col("root"))), F.min("root")).alias("target"),
    )
    torn = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))
    all_held = F.col("held") == F.col("n")
    if stale:
        # the clusters that count change with every merge, so only a name's own turn can tell
        drop, merge = (F.col("n") < 2) | (all_held & torn), all_held
    else:
        # clusters only gain ids: two that meet now will meet later
        drop, merge = (F.col("n") < 2) | torn, all_held | (F.col("bare") >= F.col("n") - 1)
    return per_name.select("name", "target", F.when(drop, "drop").when(merge, "merge").otherwise("wait").alias("verdict"))


def _jumped(pointers: DataFrame) -> DataFrame:
    """(root, to) with every pointer followed to its end.  A root moves by its holder only, and holders fall along a path: no circles."""
    while True:
        for _ in range(2):
            beyond = pointers.select(F.col("root").alias("to"), F.col("to").alias("beyond"))
            pointers = pointers.join(beyond, "to", "left").select("root", F.coalesce("beyond", "to").alias("to"))
        pointers = stored(pointers, "reserve-pointers")
        if pointers.join(pointers.select(F.col("root").alias("to")), "to", "left_semi").isEmpty():
            return pointers


def in_order(ties: DataFrame, ids: DataFrame, stale: bool = False) -> DataFrame:
    """(cluster, merged): the least cluster each cluster of ``ties`` (cluster, name) ends in, by ``ids`` (cluster, id).

    Equal to handling the names one after another.  ``stale`` looks ids up only at clusters that stand by themselves and bear
    the name; then a name waits until it holds all its clusters.  Repeated rows count once; null ids are none; an empty
    table gives an empty table.  Rounds end as the least name left is decided in each.
    """
    where = stored(ties.select("cluster", F.col("cluster").alias("root")).distinct(), "reserve-roots")
    marks = ids.where("id is not null").groupBy(F.col("cluster").alias("root")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    left = ties.select("name", F.col("cluster").alias("root"), F.lit(True).alias("own")).distinct().join(marks, "root", "left")
    left = stored(left, "reserve-names")
    while not left.isEmpty():
        verdicts = stored(_decided(left, stale), "reserve-verdicts")
        pointers = left.join(verdicts.where("verdict = 'merge'"), "name").where("root != target").select("root", F.col("target").alias("to"))
        ends = _jumped(pointers)
        least = ends.groupBy("to").agg(F.least(F.min("root"), F.first("to")).alias("new"))
        moved = stored(ends.join(least, "to").select("root", "new").union(least.select("to", "new")), "reserve-moves")
        new = F.coalesce("new", "root")
        where = stored(where.join(moved, "root", "left").select("cluster", new.alias("root")), "reserve-roots")
        relabelled = left.join(moved, "root", "left").withColumn("new", new)
        marks = relabelled.groupBy("new").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        waiting = relabelled.join(verdicts.where("verdict = 'wait'").select("name"), "name", "left_semi")
        waiting = waiting.groupBy("name", "new").agg(F.max(F.col("own") & (F.col("root") == F.col("new"))).alias("own"))
        left = stored(waiting.join(marks, "new").withColumnRenamed("new", "root").select(*left.columns), "reserve-names")
    return where.withColumnRenamed("root", "merged")

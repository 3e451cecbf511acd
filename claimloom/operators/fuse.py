"""Fusion: the claims of a cluster become one profile, with confidences and the trace of every value.

Confidences are counted in ten-thousandths, where all of the model's constants are whole numbers, so results do not depend
on the order of additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import name_key
from claimloom.schema import LISTS, SCALARS, trust

# Fixed values, in ten-thousandths: boost per further source and at most, highest confidence, share left after a conflict.
BOOST, BOOST_MOST, HIGHEST, AFTER_CONFLICT = 500, 1500, 9900, 7000


def clustered(claims: DataFrame, clusters: DataFrame) -> DataFrame:
    """Claims with their cluster, the trust of their source and their support in ten-thousandths."""
    return (
        claims.join(clusters, ["source", "record_key"])
        .withColumn("trust", trust(F.col("source")))
        .withColumn("support", (F.col("trust") * F.col("raw_confidence") * 100).cast("int"))
    )


def confidence(support: Column, sources: Column, conflict: Column) -> Column:
    """Ten-thousandths from the best support, the number of distinct sources, and whether values disagreed."""
    sure = F.least(F.lit(HIGHEST), support + F.least(F.lit(BOOST_MOST), F.lit(BOOST) * (sources - 1)))
    return F.when(conflict, F.round(sure * AFTER_CONFLICT / 10000)).otherwise(sure).cast("int")


def scalars(claims: DataFrame) -> DataFrame:
    """(cluster, field_path, value, winner, conflict, units) of single-valued fields; numbers as text."""
    best = F.col("best")
    return _entries(claims, *SCALARS).select(
        "cluster", F.col("field").alias("field_path"), best["value"].alias("value"), best["backer"]["winner"].alias("winner"), "conflict", _units(False)
    )


def string_lists(claims: DataFrame) -> DataFrame:
    """(cluster, field_path, items, units): sorted union of values; lists never conflict."""
    rows = claims.where(F.col("field_path").isin(*LISTS) & F.col("value_str").isNotNull())
    return rows.groupBy("cluster", "field_path").agg(
        F.array_sort(F.collect_set("value_str")).alias("items"),
        confidence(F.max("support"), F.count_distinct("source"), F.lit(False)).alias("units"),
    )


def skills(claims: DataFrame) -> DataFrame:
    """(cluster, name, sources, units)."""
    return _entries(claims, "skills").select("cluster", F.col("entry").alias("name"), F.array_sort("sources").alias("sources"), _units(False))


def _entries(claims: DataFrame, *fields: str, jobs: tuple[str, ...] = (), schools: tuple[str, ...] = ()) -> DataFrame:
    """Entries of some fields; see :func:`claimloom.operators.assemble.entries`."""
    from claimloom.operators import assemble

    rows = claims.where(F.col("field_path").isin(*fields))
    return assemble.entries(assemble.values(rows, jobs, schools, False), jobs, schools).where("best is not null and field != ''")


def _units(title: bool) -> Column:
    from claimloom.operators import assemble

    return assemble.units(title).alias("units")


def experience(claims: DataFrame) -> DataFrame:
    """(cluster, company, title, start, end, units, title_winner): one entry per employer."""
    parts = ("company", "title", "start", "end")
    return _entries(claims, "experience", jobs=parts).select(
        "cluster",
        *(F.col(f"of_{f}.value").alias(f) for f in parts),
        _units(True),
        F.when(F.col("of_title.conflict"), F.col("of_title.winner")).alias("title_winner"),
    )


def education(claims: DataFrame) -> DataFrame:
    """(cluster, institution, degree, field, end_year, units): one entry per institution and year."""
    parts = ("institution", "degree", "field")
    return _entries(claims, "education", schools=parts).select(
        "cluster", *(F.col(f"of_{f}.value").alias(f) for f in parts), F.col("year").alias("end_year"), _units(False)
    )


class Parts:
    """The branches of a profile by themselves; each is lazy and reads its own fields only."""

    def __init__(self, claims: DataFrame):
        self.claims = claims
        self.scalars = scalars(claims)
        self.lists = string_lists(claims)
        self.skills = skills(claims)
        self.experience = experience(claims)
        self.education = education(claims)

    def candidate_ids(self) -> DataFrame:
        """(cluster, candidate_id, derived): the explicit id, else the first address, name key or record key."""
        told = F.col("field_path").isin("emails", "full_name")
        # most claims only name their record: these become one row a record, by the layout of their join, before they are dealt out
        said = self.claims.select("cluster", "source", "record_key", F.when(told, F.col("field_path")).alias("field_path"), F.when(told, F.col("value_str")).alias("value_str"))
        pick = lambda field: F.min(F.when(F.col("field_path") == field, F.col("value_str")))
        offered = said.distinct().groupBy("cluster").agg(
            pick("emails").alias("email"), pick("full_name").alias("name"), F.min(F.nullif("record_key", F.lit(""))).alias("key")
        )
        explicit = _entries(self.claims, "candidate_id").select("cluster", F.nullif("best.value", F.lit("")).alias("explicit"))
        from_name = F.coalesce(F.nullif(F.replace(name_key(F.col("name")), F.lit(" "), F.lit("_")), F.lit("")), F.col("name"))
        return offered.join(explicit, "cluster", "left").select(
            "cluster",
            F.coalesce("explicit", "email", from_name, "key", F.lit("unknown")).alias("candidate_id"),
            (F.col("explicit").isNull() & F.coalesce("email", "name", "key").isNotNull()).alias("derived"),
        )

    def provenance(self) -> DataFrame:
        """(cluster, field, source, method): distinct."""
        from claimloom.operators.assemble import origins

        derived = self.candidate_ids().where("derived")
        return origins(self.claims).union(derived.select("cluster", F.lit("candidate_id"), F.lit("merge"), F.lit("derived_id")))

    def overall(self) -> DataFrame:
        """(cluster, overall_confidence): weighted mean, four places."""
        from claimloom.operators.assemble import overall

        return overall(self.claims)


def asked(claims: DataFrame, fields: set[str]) -> DataFrame:
    """Claims that the given fields of profiles and their ids rest on; of other claims their records once, without what they say."""
    root = F.coalesce(F.substring_index("field_path", ".", 1), F.lit(""))
    wanted = root.isin(*{"candidate_id", "emails", "full_name", *fields})
    # a record may hold nothing else, and its key may still name the profile
    bare = claims.where(~wanted).select("source", "record_key").distinct()
    empty = [F.col(f.name) if f.name in bare.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in claims.schema]
    return claims.where(wanted).union(bare.select(*empty))


def fuse(claims: DataFrame, clusters: DataFrame, fields: set[str] | None = None, traced: bool = True) -> DataFrame:
    """Profiles of all clusters: (cluster, *PROFILE), in one pass over the claims, and one more for traces.

    ``fields`` names the parts of profiles that are read afterwards, if not all are; others but the id, name and
    addresses are left empty, so neither confidences nor traces may be read then.  ``traced=False`` leaves traces empty.
    """
    from claimloom.operators.assemble import profiles

    return profiles(clustered(claims if fields is None else asked(claims, fields), clusters), traced and fields is None)

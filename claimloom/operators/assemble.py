"""Profiles in one pass: claims become values, values are laid out by cluster once, and all that follows streams over that layout.

Claims are dealt out by cluster as they are; what they say is unfolded there and sorted once.  Sources of a value, values of a field, parts of
an entry are then aggregations by ever shorter prefixes of that order, of minima and counts only: none collects anything, so none needs a
table of all groups or a sort of its own.  Lists are collected once, for the profile.  Traces (`origins`) are distinct rows of their own,
worked out only where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import company_key, name_key
from claimloom.operators.fuse import confidence
from claimloom.schema import LISTS, SCALARS, weight

JOB, SCHOOL = ("company", "title", "start", "end"), ("institution", "degree", "field")
#: A value of a list beside the list as a whole.
ITEM = "item"
_TRACE = "array<struct<field:string,source:string,method:string>>"
_ENTRY = ("cluster", "field", "entry", "year")


def _item(field: Column, value: Column, entry: Column | None = None, year: Column | None = None, sub: str = "") -> Column:
    return F.struct(
        field.alias("field"), (F.lit("") if entry is None else entry).alias("entry"), (F.lit(None) if year is None else year).cast("int").alias("year"),
        F.lit(sub).alias("sub"), value.cast("string").alias("value"),
    )


def _keyed(claims: DataFrame) -> DataFrame:
    """Claims with the keys of their entries: employer and place."""
    company, institution = F.col("value_exp.company"), F.col("value_edu.institution")
    return claims.withColumns(
        {
            "employer": F.when(F.coalesce(company, F.lit("")) != "", company_key(company)).otherwise(F.col("record_key")),
            "place": F.when(F.col("value_edu").isNotNull(), company_key(F.coalesce(institution, F.lit("")))),
            "number": F.coalesce("value_str", F.col("value_num").cast("string")),
        }
    )


def _items(jobs: tuple[str, ...], schools: tuple[str, ...], items: bool) -> Column:
    """What a claim says: one value of a field, or a list or an entry (as a value that all its claims share) with its parts; null where a part is missing."""
    path, text, number, job, school = (F.col(c) for c in ("field_path", "value_str", "number", "value_exp", "value_edu"))
    employer, place, year, shared = F.col("employer"), F.col("place"), school["end_year"], F.lit("")
    listed = [_item(path, shared), *([_item(path, shared, text, sub=ITEM)] if items else [])]
    job_parts = [_item(path, shared, employer), *(F.when(job[p] != "", _item(path, job[p], employer, sub=p)) for p in jobs)]
    school_parts = [_item(path, shared, place, year), *(F.when(school[p].isNotNull(), _item(path, school[p], place, year, p)) for p in schools)]
    nothing = F.array(_item(F.lit(""), F.lit(None)))  # its record's key may still name the profile
    return (
        F.when(path.isin(*SCALARS) & number.isNotNull(), F.array(_item(path, number)))
        .when(path.isin(*LISTS) & text.isNotNull(), F.array(*listed))
        .when((path == "skills") & (text != ""), F.array(_item(path, shared, text)))
        .when((path == "experience") & job.isNotNull(), F.array(*job_parts))
        .when((path == "education") & school.isNotNull(), F.array(*school_parts))
        .otherwise(nothing)
    )


def values(claims: DataFrame, jobs: tuple[str, ...] = JOB, schools: tuple[str, ...] = SCHOOL, items: bool = True) -> DataFrame:
    """One row for each value that a source gives a cluster's field or part of an entry, laid out and sorted by cluster."""
    # of an outer explosion Spark infers no filter that would work the items out a second time
    said = _keyed(claims.repartition("cluster")).select("cluster", "source", "record_key", "seq", "trust", "support", F.explode_outer(_items(jobs, schools, items)).alias("i"))
    return said.where("i is not null").select("*", "i.*").groupBy(*_ENTRY, "sub", "value", "source").agg(
        F.min(-F.col("trust")).alias("less"),
        F.min(F.struct("record_key", "seq")).alias("place"),
        F.max("support").alias("support"),
        F.min(F.nullif("record_key", F.lit(""))).alias("key"),
    )


def entries(given: DataFrame, jobs: tuple[str, ...] = JOB, schools: tuple[str, ...] = SCHOOL) -> DataFrame:
    """(cluster, field, entry, year, best, conflict, least, item, key, *parts) from ``values``: a field or entry with its winner and those of its parts.

    ``best`` has the value with the most trusted backer (ties go to the alphabetically first source, then to the first value seen) and the
    support and number of sources of its backers; of a list or entry as a whole all claims are backers.
    """
    sources = F.collect_list("source").over(Window.partitionBy(*_ENTRY, "sub", "value"))
    valued = given.withColumn("sources", sources).groupBy(*_ENTRY, "sub", "value").agg(
        F.min(F.struct("less", F.col("source").alias("winner"))).alias("backer"),
        F.min(F.struct("source", "place")).alias("first"),
        F.max("support").alias("support"),
        F.count("*").alias("n_sources"),
        F.max("sources").alias("sources"),
        F.min("key").alias("key"),
    )
    won = valued.groupBy(*_ENTRY, "sub").agg(
        F.min(F.struct("backer", "first", "value", "support", "n_sources")).alias("best"),
        (F.count("*") > 1).alias("conflict"),
        F.min("value").alias("least"),
        F.max("sources").alias("sources"),
        F.min("key").alias("key"),
    )
    of = lambda name, c: F.max(F.when(F.col("sub") == name, F.col(c) if isinstance(c, str) else c))
    part = lambda name: of(name, F.struct("best.value", "best.backer.winner", "conflict")).alias(f"of_{name}")
    # the field of a school is named like the column of fields
    return won.groupBy(*_ENTRY).agg(
        of("", "best").alias("best"), of("", "conflict").alias("conflict"), of("", "least").alias("least"), of("", "sources").alias("sources"),
        (of(ITEM, F.lit(1)) == 1).alias("item"), F.min("key").alias("key"), *map(part, (*jobs, *schools)),
    )


def units(title: bool = True) -> Column:
    """Confidence in ten-thousandths of a row of ``entries``; null where it is no field or entry as a whole."""
    best, field = F.col("best"), F.col("field")
    contested = field.isin(*SCALARS) & F.col("conflict")
    if title:
        contested |= (field == "experience") & F.coalesce(F.col("of_title.conflict"), F.lit(False))
    return F.when((field != "") & best.isNotNull(), confidence(best["support"], best["n_sources"], contested))


def mean(field: Column, units: Column) -> Column:
    """The weighted mean of a profile's confidences, four places."""
    w = F.when(units.isNotNull(), weight(field))
    return F.bround(F.sum(w * units) / F.sum(w), 0) / 10000


def overall(claims: DataFrame) -> DataFrame:
    """(cluster, overall_confidence) of clusters that have any; of entries only titles matter, as they may disagree."""
    told = entries(values(claims, ("title",), (), False), ("title",), ()).select("cluster", "field", units().alias("units"))
    return told.where("units is not null").groupBy("cluster").agg(mean(F.col("field"), F.col("units")).alias("overall_confidence"))


def origins(claims: DataFrame) -> DataFrame:
    """(cluster, field, source, method), distinct: where the values of each cluster's fields come from, and who won where they disagreed.

    Of single-valued fields only the winner's backers count.  A derived id is no origin of a claim and so not among them.
    """
    path, text, job, school = (F.col(c) for c in ("field_path", "value_str", "value_exp", "value_edu"))
    method, norm, none = F.col("method"), F.col("normalize_method"), F.lit(None).cast("string")

    def origin(how: Column, field: Column = path, entry: Column = F.lit(""), value: Column = F.lit(""), record: Column = F.lit(""), seq: Column = F.lit(None)) -> Column:
        return F.struct(
            field.alias("field"), entry.alias("entry"), value.alias("value"), record.alias("record"), seq.cast("bigint").alias("seq"), how.alias("method")
        )

    single = {"value": F.col("number"), "record": F.col("record_key"), "seq": F.col("seq")}
    both = F.array(origin(method), F.when(norm.isNotNull(), origin(norm)))
    title = F.when(job["title"] != "", origin(none, F.lit("experience.title"), F.col("employer"), job["title"]))
    said = (
        F.when(path.isin(*SCALARS) & F.col("number").isNotNull(), F.array(origin(method, **single), F.when(norm.isNotNull(), origin(norm, **single))))
        .when(path.isin(*LISTS) & text.isNotNull(), both)
        .when((path == "experience") & job.isNotNull(), F.array(origin(method), F.when(norm.isNotNull(), origin(norm)), title))
        .when((path == "education") & school.isNotNull(), F.array(origin(method)))
        .when((path == "skills") & (text != ""), F.array(origin(F.lit("skill_canonicalize"))))
    )
    rows = _keyed(claims).select("cluster", "source", "record_key", "trust", F.explode_outer(said).alias("o")).where("o is not null").select("*", "o.*")
    once = rows.groupBy("cluster", "field", "entry", "value", "source", "method", "trust", "record", "record_key").agg(F.min("seq").alias("seq"))
    of_value, of_field = Window.partitionBy("cluster", "field", "entry", "value"), Window.partitionBy("cluster", "field", "entry")
    backer = F.struct((-F.col("trust")).alias("less"), F.col("source").alias("winner"))
    ranked = once.repartition("cluster").withColumns(
        {"backer": F.min(backer).over(of_value), "first": F.min(F.struct("source", "record", "seq")).over(of_value)}
    ).withColumn("rank", F.struct("backer", "first", "value"))
    ranked = ranked.withColumns({"best": F.min("rank").over(of_field), "conflict": F.min("value").over(of_field) != F.max("value").over(of_field)})
    mark = lambda source, how: F.struct("field", source.alias("source"), how.alias("method"))
    marks = F.array(F.when(F.col("method").isNotNull(), mark(F.col("source"), F.col("method"))), F.when(F.col("conflict"), mark(F.col("best.backer.winner"), F.lit("merge_winner"))))
    kept = ranked.where(F.col("rank") == F.col("best")).select("cluster", F.explode(F.array_compact(marks)).alias("t"))
    return kept.select("cluster", "t.*").distinct()


def profiles(claims: DataFrame, traced: bool = True) -> DataFrame:
    """One row per cluster in the shape of ``schema.PROFILE``, with its cluster, from clustered claims; ``traced=False`` leaves provenance empty."""
    field, best = F.col("field"), F.col("best")
    part = lambda name: F.col(f"of_{name}.value").alias(name)
    job = F.struct(*map(part, JOB), F.lit(None).cast("string").alias("summary"))
    school = F.struct(*map(part, SCHOOL), F.col("year").alias("end_year"))
    skill = F.struct(F.col("entry").alias("name"), (units() / 10000).alias("confidence"), F.array_sort("sources").alias("sources"))
    told = entries(values(claims)).select(
        "cluster", "field", "key", best["value"].alias("value"), "least", units().alias("units"),
        "item", F.when(F.col("item"), F.col("entry")).alias("listed"),
        F.when(field == "skills", skill).alias("skill"),
        F.when(field == "experience", F.struct(F.coalesce("of_start.value", F.lit("")).alias("a"), F.coalesce("of_company.value", F.lit("")).alias("b"), job.alias("e"))).alias("job"),
        F.when(field == "education", F.struct(F.coalesce("year", F.lit(0)).alias("a"), F.coalesce("of_institution.value", F.lit("")).alias("b"), school.alias("e"))).alias("school"),
    )
    of = lambda name: F.max(F.when(field == name, F.col("value"))).alias(name)
    summed = told.groupBy("cluster").agg(
        *map(of, SCALARS),
        F.min(F.when(field == "full_name", F.col("least"))).alias("first_name"), F.min("key").alias("key"),
        # one list of all, taken apart afterwards, as each list that is collected is packed and unpacked by itself
        F.collect_list(F.when(F.coalesce("item", F.lit(False)) | field.isin("skills", "experience", "education"), F.struct("field", "listed", "skill", "job", "school"))).alias("all"),
        mean(field, F.col("units")).alias("overall_confidence"),
    )
    every = lambda name, what: F.transform(F.filter("all", lambda x: (x["field"] == name) & x[what].isNotNull()), lambda x: x[what])
    newest = lambda name, what: F.transform(F.sort_array(every(name, what), asc=False), lambda k: k["e"])
    lists = {name.replace(".", "_"): F.array_sort(every(name, "listed")) for name in LISTS}
    summed = summed.withColumns({**lists, "skills": F.array_sort(every("skills", "skill")), "jobs": newest("experience", "job"), "schools": newest("education", "school")}).drop("all")
    if traced:
        origin = origins(claims).groupBy("cluster").agg(F.collect_list(F.struct("field", "source", "method")).alias("origin"))
        summed = summed.join(origin, "cluster", "left")
    explicit, email, name = F.nullif("candidate_id", F.lit("")), F.get("emails", F.lit(0)), F.col("first_name")
    from_name = F.coalesce(F.nullif(F.replace(name_key(name), F.lit(" "), F.lit("_")), F.lit("")), name)
    derived = explicit.isNull() & F.coalesce(email, name, F.col("key")).isNotNull()
    mark = F.array(F.struct(F.lit("candidate_id").alias("field"), F.lit("merge").alias("source"), F.lit("derived_id").alias("method")))
    none = F.array().cast(_TRACE)
    trace = F.array_sort(F.concat(F.coalesce("origin", none), F.when(derived, mark).otherwise(none))) if traced else none
    return summed.select(
        "cluster",
        F.coalesce(explicit, email, from_name, F.col("key"), F.lit("unknown")).alias("candidate_id"),
        "full_name",
        "emails",
        "phones",
        F.struct(*(F.col(f"`location.{p}`").alias(p) for p in ("city", "region", "country"))).alias("location"),
        F.struct(*(F.col(f"`links.{p}`").alias(p) for p in ("linkedin", "github", "portfolio")), F.col("links_other").alias("other")).alias("links"),
        "headline",
        F.col("years_experience").cast("double").alias("years_experience"),
        "skills",
        F.col("jobs").alias("experience"),
        F.col("schools").alias("education"),
        trace.alias("provenance"),
        F.coalesce("overall_confidence", F.lit(0.0)).alias("overall_confidence"),
    )

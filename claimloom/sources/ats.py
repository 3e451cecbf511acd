"""Applicant systems' JSON as columns: members of an envelope become rows, each a VARIANT that keeps JSON's types.

A document is taken apart once by Spark's JSON reader (a list, an object with ``candidates``, or one candidate); its
members leave as rows and are dealt out anew, so a file of many candidates is normalised by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import BLANKS, clean_email, strip


def members(files: DataFrame) -> DataFrame:
    """``path``, ``k`` (place in the envelope), ``rec`` (variant object), ``error`` of files (``path``, ``text``).

    Members that are no objects are left out but counted; a text that is no JSON is one row with an error.
    """
    body = F.ltrim("text", F.lit(BLANKS))
    typed = files.select(
        "path",
        F.when(body.startswith("["), F.from_json("text", "array<variant>")).alias("list"),
        F.when(body.startswith("{"), F.from_json("text", "struct<candidates: array<variant>>")).alias("envelope"),
        F.when(body.startswith("{"), F.col("text")).alias("text"),
        # to its end: what follows a first value is no JSON either
        F.coalesce(F.json_array_length(F.concat(F.lit("["), F.col("text"), F.lit("]"))) == 1, F.lit(False)).alias("valid"),
    )
    all_of = F.coalesce("list", "envelope.candidates", F.array(F.try_parse_json("text")))
    kept = typed.select("path", "valid", F.posexplode_outer(F.when(F.col("valid"), all_of)).alias("k", "rec"))
    is_object = F.coalesce(F.schema_of_variant("rec").startswith("OBJECT"), F.lit(False))
    return kept.where(~F.col("valid") | is_object).select(
        "path", "k", "rec", F.when(~F.col("valid"), F.lit("JSONDecodeError: no JSON")).alias("error")
    ).hint("rebalance")


def _at(key: str) -> Column:
    return F.variant_get("rec", f"$.{key}", "variant")


def _string(value: Column) -> Column:
    """Text of a variant that is a JSON string; numbers and the like are none."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def first_string(*keys: str) -> Column:
    """The first of the members that is a string and not blank, trimmed."""
    return F.coalesce(*(F.nullif(strip(_string(_at(k))), F.lit("")) for k in keys))


def _list(key: str) -> Column:
    return F.coalesce(F.try_variant_get("rec", f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))


def addresses() -> Column:
    """Distinct addresses of the list ``emails`` and of ``email``, in order."""
    given = F.concat(F.transform(_list("emails"), _string), F.array(_string(_at("email"))))
    return F.array_distinct(F.array_compact(F.transform(given, clean_email)))


def years() -> Column:
    """A number under one of two names, the first if it is there at all; truth values are no numbers."""
    value = F.coalesce(_at("yearsExperience"), _at("years_experience"))
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))


def tags() -> Column:
    """Strings of ``skillTags``, or of ``skills`` where the former is absent or empty in any way."""
    empty = lambda v: v.isNull() | F.to_json(v).isin("null", '""', "0", "0.0", "false", "[]", "{}")
    chosen = F.when(empty(_at("skillTags")), _list("skills")).otherwise(_list("skillTags"))
    return F.array_compact(F.transform(chosen, _string))


def full_name() -> Column:
    parts = F.concat_ws(" ", first_string("givenName", "firstName"), first_string("surname", "lastName", "familyName"))
    return F.coalesce(first_string("fullName", "name"), F.nullif(parts, F.lit("")))


#: Fields that are one string: field, members in order, confidence, how it is read.
PLAIN = (
    ("phones", ("phoneNumber", "phone", "mobile"), 0.9, "phone"),
    ("location.city", ("city", "locationCity"), 0.9, "text"),
    ("location.region", ("state", "region", "province"), 0.9, "text"),
    ("location.country", ("country", "countryCode"), 0.9, "country"),
    ("links.linkedin", ("linkedin", "linkedInUrl", "linkedIn"), 0.9, "text"),
)
TITLE, COMPANY = ("currentTitle", "title", "jobTitle"), ("currentEmployer", "currentCompany", "company", "employer")
IDENTITY = ("candidate_id", "candidateId", "id")

"""Shapes, trust and vocabulary of claims and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How far each source is trusted, of 100; any llm:* source has 10, an unknown one 0.
TRUST = {"ats_json": 100, "csv_recruiter": 90, "github": 70, "resume": 50, "notes": 30, "llm": 10}

# How a value was obtained.
METHODS = (
    "csv_column", "ats_field_map", "github_api", "regex_extraction", "heuristic_extraction", "phone_normalize",
    "date_parse", "country_normalize", "skill_canonicalize", "merge_winner", "derived_id", "llm_extraction",
)

SCALARS = (
    "candidate_id", "full_name", "location.city", "location.region", "location.country", "links.linkedin",
    "links.github", "links.portfolio", "headline", "years_experience",
)
LISTS = ("emails", "phones", "links.other")

# Weights of fields in the overall confidence; all others weigh 1.
WEIGHTS = {"candidate_id": 2, "full_name": 2, "emails": 2, "phones": 2, "experience": 2}

EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:int>"

#: One row per claim; ``seq`` orders the claims of one record as its file gave them.
CLAIMS = (
    "source string, record_key string, seq bigint, field_path string, value_str string, value_num double,"
    f" value_exp {EXPERIENCE}, value_edu {EDUCATION}, raw_confidence decimal(3,2), method string, normalize_method string"
)

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT = T.StringType()
_TEXTS = T.ArrayType(_TEXT)
#: The nested profile of one entity; collections are empty, never null.
PROFILE = _struct(
    candidate_id=_TEXT,
    full_name=_TEXT,
    emails=_TEXTS,
    phones=_TEXTS,
    location=_struct(city=_TEXT, region=_TEXT, country=_TEXT),
    links=_struct(linkedin=_TEXT, github=_TEXT, portfolio=_TEXT, other=_TEXTS),
    headline=_TEXT,
    years_experience=T.DoubleType(),
    skills=T.ArrayType(_struct(name=_TEXT, confidence=T.DoubleType(), sources=_TEXTS)),
    experience=T.ArrayType(_struct(company=_TEXT, title=_TEXT, start=_TEXT, end=_TEXT, summary=_TEXT)),
    education=T.ArrayType(_struct(institution=_TEXT, degree=_TEXT, field=_TEXT, end_year=T.IntegerType())),
    provenance=T.ArrayType(_struct(field=_TEXT, source=_TEXT, method=_TEXT)),
    overall_confidence=T.DoubleType(),
)


def trust(source: Column) -> Column:
    """Trust of a source, 0 to 100."""
    out = F.when(source.startswith("llm:"), TRUST["llm"])
    for name, value in TRUST.items():
        out = out.when(source == name, value)
    return out.otherwise(0)


def trust_for(source: str) -> int:
    """The same for one name, without Spark."""
    return TRUST.get("llm" if source.startswith("llm:") else source, 0)


def weight(field: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, value in WEIGHTS.items():
        out = out.when(field == name, value)
    return out.otherwise(1)


def json_schema(kind: T.DataType = PROFILE) -> dict:
    """The JSON Schema of a Spark type; of the profile by default."""
    if isinstance(kind, T.StructType):
        return {
            "type": "object",
            "properties": {f.name: json_schema(f.dataType) for f in kind.fields},
            "additionalProperties": False,
        }
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    name = {T.StringType: "string", T.DoubleType: "number", T.IntegerType: "integer", T.LongType: "integer"}[type(kind)]
    return {"type": [name, "null"]}

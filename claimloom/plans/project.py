"""The path language and the projection: a configuration compiles to one ``select``.

A path is dotted keys, each with an optional ``[N]`` (element) or ``[]`` (all elements).  Whether a key exists is decided
while compiling; what depends on a row (an index out of range, a null) becomes part of the expression.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.config import ConfigError, FieldSpec, OutputConfig
from claimloom.functions.dates import year_month
from claimloom.functions.phones import normalize_phone
from claimloom.functions.skills import canonical_each, canonical_skill
from claimloom.functions.text import strip
from claimloom.schema import PROFILE

_SEGMENT = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)(?:\[(\d+|)\])?")


def segments(path: str) -> list[tuple[str, str | None]]:
    """(key, None, index digits or "" for all) of each part of a path."""
    out = []
    for part in path.split("."):
        m = _SEGMENT.fullmatch(part)
        if not m:
            raise ConfigError(f"invalid path segment {part!r} in {path!r}")
        out.append((m.group(1), m.group(2)))
    return out


@dataclass
class Value:
    """A compiled path: its expression, its type, and when it is there (None: always)."""

    column: Column
    kind: T.DataType
    present: Column | None = None


def _both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def _walk(value: Value, rest: list[tuple[str, str | None]]) -> Value | None:
    if not rest:
        return value
    (key, bracket), rest = rest[0], rest[1:]
    if not isinstance(value.kind, T.StructType) or key not in value.kind.names:
        return None
    inner = Value(value.column[key], value.kind[key].dataType, value.present)
    if bracket is None:
        return _walk(inner, rest)
    if not isinstance(inner.kind, T.ArrayType):
        return None
    element = inner.kind.elementType
    if bracket:
        n = int(bracket)
        return _walk(Value(F.get(inner.column, F.lit(n)), element, _both(inner.present, F.size(inner.column) > n)), rest)
    probe = _walk(Value(F.lit(None), element), rest)
    if probe is None:  # no element has the rest of the path: all are left out
        return Value(F.array().cast("array<string>"), T.ArrayType(T.StringType()), inner.present)
    items = inner.column
    if probe.present is not None:
        items = F.filter(items, lambda x: _walk(Value(x, element), rest).present)
    return Value(F.transform(items, lambda x: _walk(Value(x, element), rest).column), T.ArrayType(probe.kind), inner.present)


def resolve(path: str, schema: T.StructType = PROFILE) -> Value | None:
    """The compiled path over the columns of ``schema``; None if it cannot exist there."""
    if not path:
        raise ConfigError("empty path")
    parts = segments(path)
    name = parts[0][0]
    if name not in schema.names:
        return None
    root = Value(F.struct(F.col(name)), T.StructType([schema[name]]))
    return _walk(root, parts)


def _plain(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return column
    return F.to_json(column) if isinstance(kind, (T.StructType, T.ArrayType)) else column.cast("string")


def normalized(value: Value, how: str) -> Value:
    """Normalised scalar, or list without the elements that fail."""
    one = {
        "E164": normalize_phone,
        "YYYY-MM": year_month,
        "lower": F.lower,
        "upper": F.upper,
        "trim": strip,
        "canonical": lambda c: F.nullif(canonical_skill(c)["name"], F.lit("")),
    }[how]
    if not isinstance(value.kind, T.ArrayType):
        return Value(one(_plain(value.column, value.kind)), T.StringType(), value.present)
    items = F.transform(value.column, lambda x: _plain(x, value.kind.elementType))
    done = canonical_each(items) if how == "canonical" else F.transform(items, one)
    return Value(F.filter(done, lambda x: x.isNotNull()), T.ArrayType(T.StringType()), value.present)


def kind_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"{kind_name(kind.elementType)}[]"
    if isinstance(kind, T.StructType):
        return "object"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
        return "integer"
    return "number" if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) else "string"


def fits(declared: str, kind: str) -> bool:
    return declared in ("any", kind) or (declared == "number" and kind == "integer")


@dataclass
class Compiled:
    spec: FieldSpec
    value: Value | None
    omit: bool
    errors: list[Column]

    @property
    def column(self) -> Column:
        if self.value is None:
            return F.lit(None).cast("string")
        return self.value.column if self.value.present is None else F.when(self.value.present, self.value.column)


def compile_config(config: OutputConfig, schema: T.StructType = PROFILE) -> list[Compiled]:
    """Fields in order; of a name given twice the last one stands at the first one's place."""
    out: dict[str, Compiled] = {}
    for spec in config.fields:
        value = resolve(spec.source_path, schema)
        if value is not None and spec.normalize:
            value = normalized(value, spec.normalize)
        missing = spec.on_missing or config.on_missing
        made = Compiled(spec, value, missing == "omit", [])
        null = made.column.isNull()
        if missing == "error":
            made.errors.append(F.when(null, F.lit(f"field {spec.path!r} (from {spec.source_path!r}) is missing and on_missing='error'")))
        if spec.required:
            made.errors.append(F.when(null, F.lit(f"required field {spec.path!r} is missing or null")))
        if value is not None:
            kind = kind_name(value.kind)
            said = F.lit(f"field {spec.path!r} expected type {spec.type!r} but got {kind!r}")
            if not fits(spec.type, kind):
                made.errors.append(F.when(~null, said))
            elif spec.type.endswith("[]"):
                made.errors.append(F.when(~F.forall(value.column, lambda x: x.isNotNull()), said))
        out[spec.path] = made
    return list(out.values())


def _extras(config: OutputConfig) -> list[str]:
    return ["overall_confidence"] * config.include_confidence + ["provenance"] * config.include_provenance


def roots(config: OutputConfig) -> set[str] | None:
    """Parts of profiles that a configuration reads; None if these rest on all claims, as confidences and traces do."""
    read = {segments(spec.source_path)[0][0] for spec in config.fields} | set(_extras(config))
    return None if read & {"overall_confidence", "provenance"} else read


def project(profiles: DataFrame, config: OutputConfig, mode: str = "strict") -> DataFrame:
    """The configured columns of every profile.

    ``strict`` fails the query on the first row with an error; ``permissive`` keeps all rows and adds ``_errors``.
    A field that is omitted where missing is null here and absent in :func:`to_json`.
    """
    fields = compile_config(config)
    extras = _extras(config)
    columns = [f.column.alias(f.spec.path) for f in fields if f.spec.path not in extras] + [F.col(e) for e in extras]
    said = F.array_compact(F.array(*(e for f in fields for e in f.errors)).cast("array<string>"))
    if mode == "permissive":
        return profiles.select(*columns, said.alias("_errors"))
    if any(f.errors for f in fields):
        first = F.get(said, F.lit(0))
        profiles = profiles.where(F.when(first.isNotNull(), F.raise_error(first).cast("boolean")).otherwise(True))
    return profiles.select(*columns)


def to_json(profiles: DataFrame, config: OutputConfig, sort_keys: bool = False) -> DataFrame:
    """(candidate_id, json): one object per profile; nulls are kept, but for fields that are omitted where missing."""
    extras = _extras(config)
    pieces = [(f.spec.path, f.column, f.omit) for f in compile_config(config) if f.spec.path not in extras]
    pieces += [(e, F.col(e), False) for e in extras]
    if sort_keys:
        pieces.sort(key=lambda p: p[0])

    def piece(name: str, column: Column, omit: bool) -> Column:
        whole = F.struct(column.alias(name))
        text = F.to_json(F.to_variant_object(whole)) if sort_keys else F.to_json(whole, {"ignoreNullFields": "false"})
        inside = F.substr(text, F.lit(2), F.length(text) - 2)
        return F.when(column.isNotNull(), inside) if omit else inside

    body = F.concat_ws(",", *(piece(*p) for p in pieces)) if pieces else F.lit("")
    return profiles.select("candidate_id", F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


@dataclass(frozen=True, order=True)
class Issue:
    severity: str
    path: str
    source_path: str
    message: str


def _below(kind: T.DataType | None, part: tuple[str, str | None]) -> T.DataType | None:
    """The type that one part of a path leads to; None if there is nothing."""
    key, bracket = part
    inner = kind[key].dataType if isinstance(kind, T.StructType) and key in kind.names else None
    if bracket is None or inner is None:
        return inner
    return inner.elementType if isinstance(inner, T.ArrayType) else None


def lint(config: OutputConfig, schema: T.StructType = PROFILE) -> list[Issue]:
    """Paths that lead nowhere (errors) and types that cannot fit (warnings), sorted; needs neither data nor a session."""
    found = []
    for spec in config.fields:
        issue = lambda severity, message, s=spec: found.append(Issue(severity, s.path, s.source_path, message))
        try:
            parts = segments(spec.source_path)
        except ConfigError as e:
            issue("error", str(e))
            continue
        kinds = list(accumulate(parts, _below, initial=schema))
        if None in kinds:
            steps = spec.source_path.split(".")[: kinds.index(None)]
            issue("error", f"nothing at {'.'.join(steps)!r}: {steps[-1]!r} asked of {kind_name(kinds[len(steps) - 1])}")
            continue
        name = kind_name(kinds[-1])
        if any(bracket == "" for _, bracket in parts):
            name = f"{name.removesuffix('[]')}[]"
        if not fits(spec.type, name):
            issue("warning", f"{spec.type!r} declared for what is {name!r}")
    return sorted(found)


def python_json(line: str) -> str:
    """A line of :func:`to_json` with blanks after commas and colons."""
    return json.dumps(json.loads(line), ensure_ascii=False)

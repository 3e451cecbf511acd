"""Files of all kinds -> claims.

Files are listed by their literal names, routed to the first kind whose rule fits, and taken apart: tables, applicant systems' JSON
and résumés by column expressions (long tables in byte ranges, long envelopes as one row a member), other kinds by a small parser
each inside an Arrow function that isolates failures.  A broken file gives no claims and never stops a run.  Parsers only find
strings; normalising them is left to column expressions over all claims at once.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.dates import date_range
from claimloom.functions.phones import normalize_phone, phones_in
from claimloom.functions.places import normalize_country, split_location
from claimloom.functions.skills import canonical_skill, skills_in
from claimloom.functions.text import BLANKS, EMAIL, blank_to_null, clean_email, emails_in
from claimloom.schema import EDUCATION, EXPERIENCE
from claimloom.sources import ats, listing, resume, tables
from claimloom.storage import stored

# Strings that mark an applicant system's JSON.
ATS_MARKS = ("givenName", "surname", "skillTags", "currentTitle", "phoneNumber", "candidates")
_EMAIL = re.compile(EMAIL)
_NAME_LINE = re.compile(r"^\s*(?:candidate|name)\s*[:\-]\s*(?P<name>.+?)\s*$", re.I | re.M)
_PLACE = re.compile(r"\b(?:based in|located in|lives in)\s+(?P<place>[A-Za-z .,'-]+)", re.I)

RAW = "path string, text string, content binary, error string"
#: Names of tables, which are read in byte ranges.
_TABLES = r"(?i)\.csv$"
#: Parser output: a raw string per claim and how it is to be read; ``lower`` is the confidence of a name that is no known skill.
PARSED = (
    "source string, record_key string, file_seq string, seq bigint, field_path string, raw string, num double,"
    f" exp {EXPERIENCE}, edu {EDUCATION},"
    " how string, confidence double, lower double, method string, error string"
)
_COLUMNS = [c.split()[0] for c in re.sub(r"struct<[^>]*>", "struct", PARSED).split(",")]


def read_files(spark: SparkSession, paths: list[str], never: str | None = None) -> DataFrame:
    """(path, text, content, error) of files and of all files below folders, each once; text is null unless it is UTF-8.

    Names are taken literally, hidden ones too.  Paths that do not exist are left out with a warning; a file that cannot be read is a row
    with an error.  A path that is given twice or lies below another one is read once; this is settled by names, so no content is
    shuffled.  ``never`` is a pattern of names to leave out.
    """
    near, far = listing.present([p for p in paths if listing.known(p)]), [p for p in paths if not listing.known(p)]
    raw = listing.pieces_of(spark, near, never=never)
    if far:
        others = listing.through_spark(spark, far)
        raw = raw.union(others.where(~F.col("path").rlike(never)) if never else others)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.select("path", text.alias("text"), "content", "error")


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, part, content, error) of files below ``paths`` that are named as tables, long ones in byte ranges."""
    near, far = [p for p in paths if listing.known(p)], [p for p in paths if not listing.known(p)]
    rows = listing.pieces_of(spark, near, only=_TABLES, range_bytes=listing.RANGE_BYTES)
    if far:
        rows = rows.union(listing.through_spark(spark, far).where(F.col("path").rlike(_TABLES)))
    return rows.select("path", "part", "content", "error")


@dataclass(frozen=True)
class File:
    """What rules of detection see of a file: its lower-case suffix and its text, as columns."""

    suffix: Column
    text: Column

    @property
    def body(self) -> Column:
        return F.ltrim(self.text, F.lit(BLANKS))

    def has(self, *marks: str) -> Column:
        """Whether the text holds any of the quoted marks."""
        return reduce(Column.__or__, (F.contains(self.text, F.lit(f'"{mark}"')) for mark in marks))


def _table(f: File) -> Column:
    first_line = F.get(F.split(f.body, r"\R", 2), F.lit(0))
    return (f.suffix == ".csv") | (~f.body.rlike(r"\A[\[{]") & first_line.contains(","))


#: Rules of detection by kind, in the order in which they are tried; see :func:`register`.
RULES: dict[str, Callable[[File], Column]] = {
    "csv_recruiter": _table,
    "ats_json": lambda f: (f.suffix == ".json") & f.has(*ATS_MARKS),
    "github": lambda f: (f.suffix == ".json") & f.has("user") & f.has("repos"),
    "resume": lambda f: f.suffix.isin(".pdf", ".docx", ".doc"),
    "notes": lambda f: f.suffix.isin(".txt", ".text", ".md"),
}


def kind_of(path: Column, text: Column) -> Column:
    """The first kind whose rule fits a file; null if none does."""
    file = File(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(rule(file), kind) for kind, rule in RULES.items()))


def register(kind: str, rule: Callable[[File], Column], parser: Callable[[str, str], list[dict]], first: bool = False) -> None:
    """Read another kind of files: a rule over columns, and a parser (stem, text) -> claims that the executors can import."""
    PARSERS[kind] = parser
    COLUMNS.pop(kind, None)
    others = {k: r for k, r in RULES.items() if k != kind}
    RULES.clear()
    RULES.update({kind: rule, **others} if first else {**others, kind: rule})


class _Claims:
    """Collects the claims of one record."""

    def __init__(self, out: list[dict], source: str, key: str, method: str):
        self.out, self.source, self.key, self.method = out, source, key, method

    def add(self, field: str, raw: str | None, confidence: float, how: str = "text", lower: float | None = None, **more: object) -> None:
        if raw is not None or more:
            self.out.append(
                {"source": self.source, "record_key": self.key, "seq": len(self.out), "field_path": field, "raw": raw, "how": how,
                 "confidence": confidence, "lower": lower, "method": self.method} | more
            )


def _job(company: str | None, title: str | None) -> dict:
    return {"company": company, "title": title, "start": None, "end": None, "summary": None}


def _address(raw: str | None) -> str | None:
    low = (raw or "").strip().lower()
    return low if _EMAIL.fullmatch(low) else None


def parse_csv(stem: str, text: str) -> list[dict]:
    """Tables that ``tables.read`` leaves to the standard library's reader."""
    out: list[dict] = []
    table = csv.DictReader(io.StringIO(text.lstrip("\ufeff")))
    roles = {h: tables.HEADERS[h.strip().lower()] for h in table.fieldnames or () if h and h.strip().lower() in tables.HEADERS}
    for k, row in enumerate(table):
        v = {role: row[header].strip() for header, role in roles.items() if row.get(header)}
        claims = _Claims(out, "csv_recruiter", v.get("candidate_id") or _address(v.get("email")) or f"{stem}#row{k}", "csv_column")
        claims.add("candidate_id", v.get("candidate_id") or None, 1.0)
        claims.add("full_name", v.get("name") or None, 0.95)
        claims.add("emails", v.get("email"), 0.95, "email")
        claims.add("phones", v.get("phone"), 0.9, "phone")
        if v.get("company") or v.get("title"):
            claims.add("experience", None, 0.9, exp=_job(v.get("company") or None, v.get("title") or None))
    return out


def parse_github(stem: str, text: str) -> list[dict]:
    doc = json.loads(text)
    user, repos, languages = (doc.get(k) for k in ("user", "repos", "languages")) if isinstance(doc, dict) else (None,) * 3
    user = user if isinstance(user, dict) else {}
    text_of = lambda k: v.strip() or None if isinstance(v := user.get(k), str) else None
    out: list[dict] = []
    if not isinstance(doc, dict):
        return out
    login = user.get("login") if isinstance(user.get("login"), str) else None
    claims = _Claims(out, "github", login or stem, "github_api")
    claims.add("full_name", text_of("name"), 0.8)
    claims.add("emails", text_of("email"), 0.8, "email")
    claims.add("links.github", text_of("html_url"), 0.95)
    claims.add("links.portfolio", text_of("blog"), 0.7)
    claims.add("location", text_of("location"), 0.7, "place", 0.75)
    if company := text_of("company"):
        claims.add("experience", None, 0.5, exp=_job(company.lstrip("@"), None))
    names = set(languages) if isinstance(languages, dict) else set()
    names |= {r["language"] for r in repos if isinstance(r, dict) and isinstance(r.get("language"), str)} if isinstance(repos, list) else set()
    for name in sorted(names):
        claims.add("skills", name, 0.75, "skill", 0.5)
    return out


def parse_notes(stem: str, text: str) -> list[dict]:
    out: list[dict] = []
    claims = _Claims(out, "notes", stem, "heuristic_extraction")
    if not text.strip():
        return out
    if m := _NAME_LINE.search(text):
        claims.add("full_name", m.group("name").strip(), 0.5)
    claims.add("emails", text, 0.5, "emails")
    claims.add("phones", text, 0.45, "phones")
    if m := _PLACE.search(text):
        claims.add("location", m.group("place"), 0.4, "place", 0.45)
    claims.add("skills", text, 0.45, "skills")
    return out


def resume_text(path: str, content: bytes) -> str:
    """Lines of a document; pages of a PDF only where a reader is installed; anything unreadable is empty."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".docx" or suffix == ".doc" and zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    if suffix == ".pdf":
        import pdfplumber  # noqa: PLC0415  optional: without it the file gives no claims

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return "\n".join(page.extract_text() or "" for page in pdf.pages)
    return ""


#: Parsers by kind: (stem, text) -> claims; see :func:`register`.
PARSERS: dict[str, Callable[[str, str], list[dict]]] = {"csv_recruiter": parse_csv, "github": parse_github, "notes": parse_notes}


def _parser(parsers: dict[str, Callable[[str, str], list[dict]]]):
    """The parsers travel with the plan, as those that were registered are not known where it runs."""
    return lambda frames: _parse(frames, parsers)


def _parse(frames: Iterator[pd.DataFrame], parsers: dict[str, Callable[[str, str], list[dict]]]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out: list[dict] = []
        for path, text, kind in frame[["path", "text", "kind"]].itertuples(index=False):
            stem = PurePosixPath(path).stem
            try:
                got = parsers[kind](stem, text) if kind in parsers and text else []
            except Exception as e:  # one bad file must not stop the others; the reason is kept
                got = [{"error": f"{type(e).__name__}: {e}", "source": kind}]
            out += [g | {"file_seq": path} for g in got]
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"num": float, "confidence": float, "lower": float}).astype(object).where(lambda d: d.notna(), None)


def _claim(field: str, confidence: float, raw: Column | None = None, how: str = "text", lower: float | None = None, exp: Column | None = None, num: Column | None = None) -> Column:
    """A claim of a record taken apart by columns; null where it has no value."""
    null = lambda kind: F.lit(None).cast(kind)
    value = next(v for v in (raw, exp, num) if v is not None)
    return F.when(
        value.isNotNull(),
        F.struct(
            F.lit(field).alias("field_path"), (null("string") if raw is None else raw).alias("raw"), (null("double") if num is None else num).alias("num"),
            (null(EXPERIENCE) if exp is None else exp.cast(EXPERIENCE)).alias("exp"), F.lit(how).alias("how"), F.lit(confidence).alias("confidence"),
            F.lit(lower).cast("double").alias("lower"),
        ),
    )


def _current(company: Column, title: Column) -> Column:
    none = F.lit(None).cast("string")
    job = F.struct(company.alias("company"), title.alias("title"), none.alias("start"), none.alias("end"), none.alias("summary"))
    return F.when(company.isNotNull() | title.isNotNull(), job)


def _rows(records: DataFrame, source: str, key: Column, method: str, claims: Column, error: Column | None = None) -> DataFrame:
    """Parser rows of records (``path``, ``k``, ...): their claims in order; a record with an error is one row without claims."""
    failed = F.lit(None).cast("string") if error is None else error
    told = records.select("path", "k", key.alias("key"), failed.alias("failed"), F.posexplode_outer(F.when(failed.isNull(), F.array_compact(claims))).alias("at", "c"))
    own = {
        "source": F.lit(source), "record_key": F.col("key"), "file_seq": F.col("path"), "seq": (F.col("k").cast("bigint") * (1 << 24) + F.col("at")),
        "edu": F.lit(None).cast(EDUCATION), "method": F.lit(method), "error": F.col("failed"),
    }
    return told.where("c is not null or failed is not null").select(*((own[n] if n in own else F.col(f"c.{n}")).alias(n) for n in _COLUMNS))


def table_rows(ranges: DataFrame) -> DataFrame:
    """Parser rows of recruiters' tables in ranges (``path``, ``part``, ``content``)."""
    found, odd = tables.read(ranges)
    some = lambda role: F.nullif(F.col(role), F.lit(""))
    claims = F.array(
        _claim("candidate_id", 1.0, some("candidate_id")),
        _claim("full_name", 0.95, some("name")),
        _claim("emails", 0.95, F.col("email"), "email"),
        _claim("phones", 0.9, F.col("phone"), "phone"),
        _claim("experience", 0.9, exp=_current(some("company"), some("title"))),
    )
    rows = _rows(found, "csv_recruiter", tables.key_of(F.col("path"), F.col("k")), "csv_column", claims)
    whole = ranges.join(odd, "path").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", F.decode("content", "ISO-8859-1").alias("s")))).alias("all"))
    content = F.encode(F.array_join(F.transform("all", lambda p: p["s"]), ""), "ISO-8859-1").cast("string")
    left = whole.select("path", F.when(F.is_valid_utf8(content), content).alias("text"), F.lit("csv_recruiter").alias("kind"))
    return rows.unionByName(left.mapInPandas(_parser({"csv_recruiter": parse_csv}), PARSED))


def ats_rows(files: DataFrame) -> DataFrame:
    """Parser rows of applicant systems' JSON (``path``, ``text``)."""
    records = ats.members(files).withColumns({"identity": ats.first_string(*ats.IDENTITY), "found": ats.addresses()})
    claims = F.concat(
        F.array(_claim("candidate_id", 1.0, F.col("identity")), _claim("full_name", 0.95, ats.full_name())),
        F.transform("found", lambda e: _claim("emails", 0.95, e)),
        F.array(
            _claim("experience", 0.92, exp=_current(ats.first_string(*ats.COMPANY), ats.first_string(*ats.TITLE))),
            *(_claim(field, confidence, ats.first_string(*keys), how) for field, keys, confidence, how in ats.PLAIN),
            _claim("years_experience", 0.9, num=ats.years()),
        ),
        F.transform(ats.tags(), lambda t: _claim("skills", 0.9, t, "skill", 0.6)),
    )
    key = F.coalesce(F.col("identity"), F.get("found", F.lit(0)), F.concat(tables.stem(F.col("path")), F.lit("#"), F.col("k").cast("string")))
    return _rows(records, "ats_json", key, "ats_field_map", claims, F.col("error"))


def _whole(files: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Tables that were read whole as their only range, and those in ``ranges``."""
    own = files.where("text is not null").select("path", F.lit(0).cast("bigint").alias("part"), F.col("text").cast("binary").alias("content"))
    return table_rows(own if ranges is None else own.union(ranges.select("path", "part", "content")))


#: Kinds that are taken apart by columns: files (path, text, content) -> parser rows.
COLUMNS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "csv_recruiter": _whole, "ats_json": ats_rows, "resume": lambda files: resume_rows(files.where("error is null")),
}


def parsed(raw: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Raw strings of all files, of tables in ``ranges`` too; rows with ``error`` tell which file could not be read and why."""
    raw = raw if "error" in raw.columns else raw.withColumn("error", F.lit(None).cast("string"))
    routed = raw.withColumn("kind", kind_of(F.col("path"), F.col("text")))
    others = routed.where(F.col("kind").isNotNull() & ~F.col("kind").isin(*COLUMNS)).drop("content", "error")
    out = others.mapInPandas(_parser(dict(PARSERS)), PARSED).unionByName(unread(routed))
    for kind, rows in COLUMNS.items():
        files = routed.where(F.col("kind") == kind)
        out = out.unionByName(rows(files) if ranges is None or kind != "csv_recruiter" else rows(files, ranges))
    return out if ranges is None else out.unionByName(unread(ranges))


def unread(files: DataFrame) -> DataFrame:
    """Parser rows of files that could not be opened."""
    names = {"file_seq": F.col("path"), "error": F.col("error")}
    kinds = dict(re.findall(r"(\w+) (string|bigint|double)", PARSED)) | {"exp": EXPERIENCE, "edu": EDUCATION}
    return files.where("error is not null").select(*(names.get(n, F.lit(None).cast(kinds[n])).alias(n) for n in _COLUMNS))


def _read_resumes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, content in frame[["path", "content"]].itertuples(index=False):
            try:
                out.append((path, PurePosixPath(path).stem, resume_text(path, bytes(content)), None))
            except Exception as e:  # noqa: BLE001  one bad file must not stop the others; the reason is kept
                out.append((path, PurePosixPath(path).stem, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=["path", "stem", "text", "error"])


def resume_rows(raw: DataFrame) -> DataFrame:
    """Parser rows of résumés: Python only opens the files, their text is taken apart by columns."""
    read = raw.select("path", "content").mapInPandas(_read_resumes, "path string, stem string, text string, error string")
    found = resume.take_apart(read)
    nothing = {name: F.lit(None).cast(kind) for name, kind in (("exp", EXPERIENCE), ("edu", EDUCATION), ("raw", "string"), ("lower", "double"))}

    def claim(turn: int, field: Column, confidence: float, how: str = "text", **more: Column) -> Column:
        # kinds of claims in a fixed order, then their order in the text
        own = nothing | more
        at = own.pop("at", F.lit(0))
        return F.struct(
            (F.lit(turn << 28) + at).cast("bigint").alias("seq"),
            field.alias("field_path"),
            own["raw"].alias("raw"),
            own["exp"].cast(EXPERIENCE).alias("exp"),
            own["edu"].cast(EDUCATION).alias("edu"),
            F.lit(how).alias("how"),
            F.lit(confidence).alias("confidence"),
            own["lower"].alias("lower"),
        )

    text, none = F.col("text"), F.lit(None).cast("string")
    each = lambda items, one: F.transform(F.col(f"found.{items}"), one)
    job = lambda j: F.struct(j["company"].alias("company"), j["title"].alias("title"), *(none.alias(n) for n in ("start", "end", "summary")))
    name = F.array(claim(0, F.lit("full_name"), 0.7, raw=F.col("found.name")))
    whole = F.array(claim(1, F.lit("emails"), 0.8, "emails", raw=text), claim(2, F.lit("phones"), 0.8, "phones", raw=text))
    some = F.concat(
        F.when(F.col("found.name").isNotNull(), name).otherwise(F.slice(name, 1, 0)),
        whole,
        each("links", lambda u, k: claim(3, u["field"], 0.75, raw=u["url"], at=k)),
        each("jobs", lambda j, k: claim(4, F.lit("experience"), 0.7, "dates", raw=j["dates"], exp=job(j), at=k)),
        each("schools", lambda e, k: claim(5, F.lit("education"), 0.7, edu=e, at=k)),
        each("skills", lambda s, k: claim(6, F.lit("skills"), 0.7, "skill", raw=s, lower=F.lit(0.5), at=k)),
    )
    told = found.where("error is not null or trim(text) != ''")
    rows = told.select("path", "stem", "error", F.explode_outer(F.when(F.col("error").isNull(), some)).alias("c"))
    own = {"source": F.lit("resume"), "record_key": F.col("stem"), "file_seq": F.col("path"), "num": F.lit(None).cast("double"),
           "method": F.lit("regex_extraction"), "error": F.col("error")}
    return rows.select(*((own[n] if n in own else F.col(f"c.{n}")).alias(n) for n in _COLUMNS))


def _prose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, text, content, kind in frame[["path", "text", "content", "kind"]].itertuples(index=False):
            key = PurePosixPath(path).stem
            try:
                if kind == "resume":
                    text = resume_text(path, bytes(content))
                elif kind == "github":
                    user = json.loads(text)["user"]
                    key = user["login"] if isinstance(user.get("login"), str) and user["login"] else key
                    text = user.get("bio")
            except Exception:  # noqa: BLE001, S112  a broken file has no prose; its reason is kept with its claims
                continue
            if isinstance(text, str) and text.strip():
                out.append((kind, key, path, text))
        yield pd.DataFrame(out, columns=["source", "record_key", "seq", "text"])


def prose_of(raw: DataFrame) -> DataFrame:
    """(source, record_key, seq, text): the prose of notes, of résumés and of the bios of code-hosting users."""
    notes = F.lower("path").rlike(r"\.(txt|text|md)$")
    kind = F.when(notes, "notes").otherwise(kind_of(F.col("path"), F.col("text")))
    routed = raw.withColumn("kind", kind).where(F.col("kind").isin("notes", "resume", "github"))
    return routed.mapInPandas(_prose, "source string, record_key string, seq string, text string")


def normalized(rows: DataFrame) -> DataFrame:
    """Parser rows -> claims: every raw string through the column expression that ``how`` names; what fails is no claim."""
    rows = rows.where("error is null")
    raw, how = F.col("raw"), F.col("how")
    skill = canonical_skill(F.when(how == "skill", raw))
    place = split_location(F.when(how == "place", raw))
    country = normalize_country(F.when(how == "country", raw))
    held = rows.withColumns({"_skill": skill, "_place": place, "_country": country})
    item = lambda field, value, conf, norm=None: F.struct(
        field.alias("field"), value.alias("value"), conf.alias("confidence"), F.lit(norm).cast("string").alias("norm")
    )
    conf, path = F.col("confidence"), F.col("field_path")
    each = lambda values, norm=None: F.transform(values, lambda v: item(path, v, conf, norm))
    items = (
        F.when(how == "email", F.array(item(path, clean_email(raw), conf)))
        .when(how == "emails", each(emails_in(raw)))
        .when(how == "phone", F.array(item(path, normalize_phone(raw), conf, "phone_normalize")))
        .when(how == "phones", each(phones_in(raw), "phone_normalize"))
        .when(how == "country", F.array(item(path, F.col("_country"), conf, "country_normalize")))
        .when(
            how == "place",
            F.array(
                item(F.lit("location.city"), F.col("_place.city"), conf),
                item(F.lit("location.region"), F.col("_place.region"), conf),
                item(F.lit("location.country"), F.col("_place.country"), F.col("lower"), "country_normalize"),
            ),
        )
        .when(
            how == "skill",
            F.array(item(path, F.nullif("_skill.name", F.lit("")), F.when(F.col("_skill.canonical"), conf).otherwise(F.col("lower")), "skill_canonicalize")),
        )
        .when(how == "skills", each(skills_in(raw), "skill_canonicalize"))
        .when(how == "dates", F.array(item(path, F.lit(None).cast("string"), conf, "date_parse")))
        .otherwise(F.array(item(path, blank_to_null(raw), conf)))
    )
    span = date_range(F.when(how == "dates", raw))
    exp = F.when(how == "dates", F.col("exp").withField("start", span["start"]).withField("end", span["end"])).otherwise(F.col("exp"))
    out = held.withColumn("_exp", exp).select("*", F.posexplode(items).alias("_pos", "_item"))
    out = out.where("_item.value is not null or num is not null or _exp is not null or edu is not null")
    return out.select(
        "source",
        "record_key",
        F.row_number().over(_in_order()).cast("bigint").alias("seq"),
        F.col("_item.field").alias("field_path"),
        F.col("_item.value").alias("value_str"),
        F.col("num").alias("value_num"),
        F.col("_exp").alias("value_exp"),
        F.col("edu").alias("value_edu"),
        F.col("_item.confidence").cast("decimal(3,2)").alias("raw_confidence"),
        "method",
        F.col("_item.norm").alias("normalize_method"),
    )


def _in_order():
    """Claims of one record in order of the file, then of the claim in it, then of the value in the claim."""
    from pyspark.sql import Window

    return Window.partitionBy("source", "record_key").orderBy("file_seq", "seq", "_pos")


def claims_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Claims of all files below ``paths``; strings are stored as parsed, which keeps plans small, and as claims, which are read often."""
    split = "csv_recruiter" in COLUMNS
    rows = parsed(read_files(spark, paths, never=_TABLES if split else None), read_tables(spark, paths) if split else None)
    return stored(normalized(stored(rows, "parsed")), "claims")

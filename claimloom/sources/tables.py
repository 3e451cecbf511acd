"""Recruiters' tables as columns: a file of any length in byte ranges, its records found by the parity of quotes.

A line end is real where an even number of quotes stands before it.  Each range counts its quotes, and its line ends
for either parity at its start; sums over a file's earlier ranges (one small row a range) then tell the parity and the
number of the first record of each.  Ranges are cut at real line ends; only the pieces at their edges are put together
by record number.  Bytes are held as one character each until a field is taken out, so a range may begin inside one.

Quotes that do not enclose a whole field, lone carriage returns and bytes that are no UTF-8 send the whole file to the
standard library's reader, which settles them in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import clean_email, once, strip
from claimloom.storage import stored

# Headers of recruiters' tables and what they mean.
HEADERS = {
    "candidate_id": "candidate_id", "candidateid": "candidate_id", "candidate id": "candidate_id", "id": "candidate_id",
    "name": "name", "full_name": "name", "full name": "name", "fullname": "name", "candidate": "name", "candidate name": "name",
    "email": "email", "e-mail": "email", "email address": "email",
    "phone": "phone", "phone number": "phone", "phonenumber": "phone", "mobile": "phone", "cell": "phone", "telephone": "phone",
    "current_company": "company", "company": "company", "current company": "company", "employer": "company",
    "title": "title", "job title": "title", "current title": "title", "role": "title", "position": "title",
}
ROLES = ("candidate_id", "name", "email", "phone", "company", "title")

#: Characters that no byte stands for: a line end and a comma between quotes.
_LINE, _COMMA = "\ue000", "\ue001"
_MARK = "ï»¿"  # a byte order mark, a character a byte


def _bytes(text: Column) -> Column:
    return F.decode(text, "ISO-8859-1")


def _text(plain: Column) -> Column:
    return F.encode(plain, "ISO-8859-1").cast("string")


def _lines_in(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def records(ranges: DataFrame) -> DataFrame:
    """``path``, ``part`` (range where it begins), ``number`` from 0, ``record`` of all lines of files in ranges (``path``, ``part``, ``content``).

    Blank lines are records too; a file that ends with a line end has a last, empty one.
    """
    cut = ranges.where("content is not null").select("path", "part", F.split(_bytes(F.col("content")), '"', -1).alias("pieces"))
    ends = F.transform("pieces", lambda s, i: F.when(i % 2 == 0, _lines_in(s)).otherwise(0))
    counted = cut.select(
        "path", "part", (F.size("pieces") - 1).alias("quotes"),
        F.aggregate(ends, F.lit(0), lambda a, n: a + n).alias("even"),
        F.aggregate(F.transform("pieces", _lines_in), F.lit(0), lambda a, n: a + n).alias("all"),
    )
    earlier = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parity = counted.withColumn("odd", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    real = F.when(F.col("odd") == 0, F.col("even")).otherwise(F.col("all") - F.col("even"))
    known = parity.withColumn("first", F.coalesce(F.sum(real).over(earlier), F.lit(0))).select("path", "part", "odd", "first")

    masked = F.array_join(
        F.transform("pieces", lambda s, i: F.when((i + F.col("odd").cast("int")) % 2 == 1, F.translate(s, "\n", _LINE)).otherwise(s)), '"'
    )
    lines = cut.join(known, ["path", "part"]).select("path", "part", "first", F.split(masked, "\n", -1).alias("lines"))
    each = lines.select("path", "part", "first", F.size("lines").alias("n"), F.posexplode("lines").alias("at", "record"))
    each = each.select("path", "part", (F.col("first") + F.col("at")).alias("number"), "record", ((F.col("at") > 0) & (F.col("at") < F.col("n") - 1)).alias("whole"))
    edges = each.where("not whole").groupBy("path", "number").agg(F.array_sort(F.collect_list(F.struct("part", "record"))).alias("all"))
    joined = edges.select("path", F.col("all")[0]["part"].alias("part"), "number", F.array_join(F.transform("all", lambda p: p["record"]), "").alias("record"))
    return each.where("whole").select("path", "part", "number", "record").union(joined)


def fields(record: Column) -> Column:
    """struct(fields, sound): fields of a record, and whether quotes enclose whole fields only and nothing else is amiss."""

    def fits(pieces: Column, last: Column) -> Column:
        fine = lambda s, i: (i % 2 == 1) | (
            ((s == "") | (((i == 0) | s.startswith(",")) & ((i == last) | s.endswith(",")))) & ~F.contains(s, F.lit("\r"))
        )
        return (last % 2 == 0) & F.forall(F.transform(pieces, fine), lambda x: x)

    def taken(pieces: Column) -> Column:
        masked = F.array_join(F.transform(pieces, lambda s, i: F.when(i % 2 == 1, F.translate(s, ",", _COMMA)).otherwise(s)), '"')
        bare = lambda f: F.when(f.startswith('"'), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
        return F.transform(F.split(masked, ",", -1), lambda f: _text(F.translate(bare(f), _LINE + _COMMA, "\n,")))

    def both(pieces: Column) -> Column:
        regular = once(F.size(pieces) - 1, lambda last: fits(pieces, last))
        return once(taken(pieces), lambda all: F.struct(all.alias("fields"), (regular & F.forall(all, F.is_valid_utf8)).alias("sound")))

    return once(F.split(F.regexp_replace(record, "\r$", ""), '"', -1), both)


def _places(header: Column, role: str) -> Column:
    """Columns of a role, in order of their headers; of headers that are the same the last one counts."""
    means = [h for h, r in HEADERS.items() if r == role]
    named = F.filter(F.array_distinct(header), lambda h: F.lower(strip(h)).isin(means))
    return F.transform(named, lambda h: F.size(header) - F.array_position(F.reverse(header), h).cast("int"))


def read(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``path``, ``k``, one column a role) of all data rows, and (``path``) of files that only the whole-file reader settles.

    ``k`` counts a file's data rows from 0, blank lines apart.  A file without a header has no rows; a header without
    rows gives none.
    """
    record = F.when(F.col("number") == 0, F.regexp_replace("record", f"^(?:{_MARK})+", "")).otherwise(F.col("record"))
    kept = stored(records(ranges).select("path", "part", "number", F.inline(F.array(fields(record))), (F.regexp_replace(record, "\r$", "") != "").alias("filled")), "table-records")
    data = F.col("filled") & (F.col("number") > 0)
    earlier = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    small = kept.groupBy("path", "part").agg(
        F.count_if(data).alias("n"), F.bool_and("sound").alias("sound"), F.max(F.when((F.col("number") == 0) & F.col("filled"), F.col("fields"))).alias("header")
    )
    whole = Window.partitionBy("path")
    ruled = small.select(
        "path", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.bool_and("sound").over(whole).alias("regular"), F.max("header").over(whole).alias("header")
    )
    rows = kept.where(data).drop("sound", "filled").join(ruled.where("regular and header is not null").drop("regular"), ["path", "part"])
    order = Window.partitionBy("path", "part").orderBy("number")
    held = rows.select("path", (F.col("before") + F.row_number().over(order) - 1).alias("k"), "fields", *(_places(F.col("header"), r).alias(f"_{r}") for r in ROLES))
    value = lambda r: strip(F.element_at(F.filter(F.transform(F.col(f"_{r}"), lambda i: F.get("fields", i)), lambda v: v != ""), -1))
    found = held.select("path", "k", *(F.when(F.exists(F.col(f"_{r}"), lambda i: F.coalesce(F.get("fields", i), F.lit("")) != ""), value(r)).alias(r) for r in ROLES))
    return found, ruled.where("not regular").select("path").distinct()


def key_of(path: Column, k: Column) -> Column:
    """Key of a row: its id, else its address, else file and number."""
    return F.coalesce(F.nullif(F.col("candidate_id"), F.lit("")), clean_email(F.col("email")), F.concat(stem(path), F.lit("#row"), k.cast("string")))


def stem(path: Column) -> Column:
    """The name of a file without its suffix; a name that only begins with a dot has none."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")

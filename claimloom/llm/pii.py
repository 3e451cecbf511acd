"""Personal data: fixed patterns as seeds, and bootstrapped contextual patterns that find further identifiers.

Four fixed rules (e-mail, address of a machine, payment card, telephone) give the base spans.  They seed a graph of patterns
(the words around an entity with what it is made of; and its form, digit by digit, between what kind of character stands
on either side) and instances (identifier-shaped strings in those contexts: single tokens of any length, and runs of digits
with blanks, brackets, dots and dashes).  Spark scores the graph in rounds until no score changes: a pattern is as good as the
share of its instances that are known, weighed by how many distinct ones back it; an instance is as good as its patterns make it.
Patterns that end with high confidence add spans for the unseen identifiers they hold.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import stored, text_segments

KINDS = ("email", "ip", "card", "phone")
#: The four base rules.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Shorter strings are no candidates.
LEAST_CHARS = 5
#: A pattern needs so many distinct known instances and such a score to add spans.
LEAST_BACKING, LEAST_SCORE = 5, 0.8
#: The rule for ips from the first digit on and without going back, which finds the same and takes linear time.
_COMPILED = {k: re.compile(r) for k, r in RULES.items()} | {"ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")}
#: Mail names in front of an @, found from the @ on so that long runs of letters are not tried again and again.
_MAIL_END = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SHAPED = re.compile(r"[^\s\"'<>|,;]+")
_SIGN = re.compile("[0-9@]")
#: Digits with marks and blanks, from the first digit of a word on; what precedes it is looked at afterwards.
_RUN = re.compile(r"(?<![\w@])[0-9][0-9\x20\u00a0().+-]*")
#: Words of a run that are identifiers by themselves: addresses of machines and numbers as long as a card's.
_ALONE = re.compile(r"[0-9]+(?:\.[0-9]+){3}|[0-9](?:[().+-]*[0-9]){12,}")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
#: Longer values are kept as their digests.
VALUE_CHARS = 64


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _passes(kind: str, value: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in value.split("."))
    digits = [c for c in value if c.isdigit()]
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn("".join(digits))
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed rules, leftmost and without overlap in each kind, by kind as listed and start."""
    out = []
    at = text.find("@")
    last = 0
    while at >= 0:
        m = _MAIL_END.match(text, at)
        start = at
        while start > last and text[start - 1] in _MAIL_NAME:
            start -= 1
        if m and start < at:
            out.append(("email", start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    for kind in ("ip", "card", "phone"):
        for m in _COMPILED[kind].finditer(text):
            if _passes(kind, m.group()):
                out.append((kind, m.start(), m.end()))
    return out


def joined_spans(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (order[s[0]], s[1], s[2])))


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    """The word before (two if they are short) and the word after, without digits; both lower case."""
    before = re.sub(r"\d+", "#", text[max(0, start - 48) : start].lower()).split()[-2:]
    after = re.sub(r"\d+", "#", text[end : end + 24].lower()).split()[:1]
    return " ".join(before)[-24:], "".join(after)[:16]


def _beside(text: str, at: int, step: int) -> str:
    """What stands next to a span: a line's end (^), a letter (a), a digit (9) or a mark itself; a blank before it if blanks lie between."""
    k = at
    while 0 <= k < len(text) and text[k] in " \t\u00a0":
        k += step
    c = text[k] if 0 <= k < len(text) else "\n"
    kind = "^" if c in "\r\n" else "a" if c.isalpha() else "9" if c.isdecimal() else c
    return (" " if k != at else "") + kind


def form(value: str) -> str:
    """A value with 9 for digits and a for letters, runs as one where it has letters; ! if it is an address or a card that fails its check."""
    if any(map(str.isalpha, value)):
        return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", value))
    failed = any(_COMPILED[k].fullmatch(value) and not _passes(k, value) for k in ("ip", "card"))
    return re.sub(r"\d", "9", value) + ("!" if failed else "")


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Strings without blanks that hold a digit or an @, without the marks at their edges."""
    for m in _SHAPED.finditer(text):
        a, b = m.span()
        if not _SIGN.search(text, a, b):
            continue
        while a < b and not (text[a].isalnum() or text[a] in "_@+"):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] in "_@+"):
            b -= 1
        yield a, b


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A part of a run from its first to its last digit, with pluses and brackets right before it."""
    first = a
    while first < b and not text[first].isdecimal():
        first += 1
    while b > first and not text[b - 1].isdecimal():
        b -= 1
    while first > a and text[first - 1] in "+(":
        first -= 1
    return (first, b) if first < b else (b, b)


def _runs(text: str, busy: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Maximal runs of digits with blanks and marks between base spans, and their parts between words that stand alone."""
    k = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while a > 0 and text[a - 1] in "+(":
            a -= 1
        if b < len(text) and (text[b].isalnum() or text[b] in "_@"):
            # the last digits belong to a word
            while b > a and text[b - 1].isdecimal():
                b -= 1
        while k < len(busy) and busy[k][1] <= a:
            k += 1
        at, j = a, k
        free = []
        while j < len(busy) and busy[j][0] < b:
            free.append((at, busy[j][0]))
            at = max(at, busy[j][1])
            j += 1
        for x, y in [*free, (at, b)]:
            x, y = _trimmed(text, x, y)
            if x >= y:
                continue
            yield x, y
            bounds = [x]
            for w in re.finditer(r"[^\x20\u00a0]+", text[x:y]):
                if _ALONE.fullmatch(w.group()):
                    bounds += [x + w.start(), x + w.end()]
            bounds.append(y)
            for c, d in zip(bounds[::2], bounds[1::2]) if len(bounds) > 2 else ():
                c, d = _trimmed(text, c, d)
                if c < d:
                    yield c, d


def occurrences(text: str) -> list[tuple[str | None, int, int, str, str, str, str, str]]:
    """(kind or None, start, end, value, words left and right, characters left and right) of base spans and of identifier-shaped strings beside them.

    Identifier-shaped are single tokens and runs of several words; these may overlap one another, but no base span.
    """
    spans = base_spans(text)
    busy: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if busy and a < busy[-1][1]:
            busy[-1] = (busy[-1][0], max(b, busy[-1][1]))
        else:
            busy.append((a, b))
    out = []
    around = lambda a, b: (*_context(text, a, b), _beside(text, a - 1, -1), _beside(text, b, 1))
    for kind, a, b in spans:
        out.append((kind, a, b, text[a:b], *around(a, b)))
    if not ("@" in text or any(c.isdigit() for c in text)):
        return out
    ends = [b for _, b in busy]
    for a, b in sorted({*_tokens(text), *_runs(text, busy)}):
        k = bisect_right(ends, a)
        if b - a >= LEAST_CHARS and not (k < len(busy) and busy[k][0] < b):
            out.append((None, a, b, text[a:b], *around(a, b)))
    return out


def shape(value: str) -> str:
    """What an identifier is made of: an @, letters and digits, four dotted numbers, or digits as of a telephone or a card."""
    if "@" in value:
        return "@"
    if any(map(str.isalpha, value)):
        return "a9"
    if _QUAD.fullmatch(value):
        return "9.9.9.9"
    return "+9" if any(c in value for c in "+()") or sum(map(str.isnumeric, value)) < 13 else "9"


def _short(value: str) -> str:
    return value if len(value) <= VALUE_CHARS else hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()


_FOUND = "array<struct<kind:string,start:int,stop:int,value:string,left:string,right:string,near:string,next:string,shape:string,form:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ("kind", "start", "stop", "value", "left", "right", "near", "next", "shape", "form")
    kind = pa.list_(pa.struct([(f, pa.int32() if f in ("start", "stop") else pa.string()) for f in fields]))
    for ids, raw in text_segments(batches):
        found = [
            [dict(zip(fields, (*o[:3], _short(o[3]), *o[4:], shape(o[3]), _short(form(o[3]))))) for o in occurrences(t.decode("utf-8", "replace"))] if t else []
            for t in raw
        ]
        yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind)], names=["id", "found"])


def patterns(o: Column) -> Column:
    """Patterns of an occurrence: words on a side with its shape; its form with the character on a side, or on both."""
    tab = F.lit("\t")
    return F.array(
        F.concat(F.lit("<"), o["left"], tab, o["shape"]),
        F.concat(F.lit(">"), o["right"], tab, o["shape"]),
        F.concat(F.lit("["), o["near"], tab, o["form"]),
        F.concat(F.lit("]"), o["next"], tab, o["form"]),
        F.concat(F.lit("="), o["near"], tab, o["next"], tab, o["form"]),
    )


def learn(occurring: DataFrame, rounds: int | None = None) -> DataFrame:
    """(kind, pattern, score) of confident patterns from rows (kind or null, value, pattern).

    A pattern is scored for each kind that backs it: the mean belief in its distinct instances, times n / (n + 1)
    for n known ones of that kind.  An instance that a base rule knows has belief 1 in its own kind and 0 in the
    others, any other the belief 1 - prod(1 - score) over its patterns that reached the threshold for the kind.
    Beliefs are whole millionths that only rise, so the rounds end by themselves; ``rounds`` ends them before.
    """
    edges = occurring.groupBy("pattern", "value").agg(F.collect_set("kind").alias("kinds"))
    backed = edges.select("pattern", F.explode("kinds").alias("kind")).groupBy("pattern", "kind").agg(F.count("*").alias("backing"))
    graph = stored(edges.join(backed.where(F.col("backing") >= LEAST_BACKING), "pattern"), "pii-graph")
    seeded = F.array_contains("kinds", F.col("kind")).cast("bigint") * 1000000
    known, total, done = None, -1, 0
    while True:
        rows = graph if known is None else graph.join(known, ["value", "kind"], "left")
        now = seeded if known is None else F.when(F.size("kinds") > 0, seeded).otherwise(F.coalesce("known", F.lit(0)))
        scored = rows.groupBy("pattern", "kind", "backing").agg(F.sum(now).alias("sum"), F.count("*").alias("n"))
        scored = scored.withColumn("score", F.col("sum") / 1e6 / F.col("n") * F.col("backing") / (F.col("backing") + 1))
        sure = stored(scored.where(F.col("score") >= LEAST_SCORE).select("kind", "pattern", "score"), "pii-patterns")
        done += 1
        if done == rounds:
            return sure
        known = (
            graph.where("size(kinds) = 0")
            .join(sure, ["pattern", "kind"])
            .groupBy("value", "kind")
            .agg(F.floor((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))) * 1e6).alias("known"))
        )
        known = stored(known, "pii-beliefs")
        before, total = total, known.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
        if total <= max(before, 0):
            return sure


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (kind, start, stop) in code points, end exclusive; ``spans`` has base ones and learnt ones.

    A null text counts as empty and has none.  Repeated rows and null ids are returned as they come; other
    columns are ignored; an empty table gives an empty table.  Long texts are read in whole segments.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = rows.mapInArrow(_scan, f"id {kind}, found {_FOUND}").withColumn("row", F.monotonically_increasing_id())
    keyed = stored(scanned, "pii-found")
    flat = keyed.where("size(found) > 0").select(F.explode("found").alias("o"))
    sure = learn(flat.select(F.col("o.kind").alias("kind"), F.col("o.value").alias("value"), F.explode(patterns(F.col("o"))).alias("pattern")))
    span = lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["stop"].alias("stop"))
    candidates = (
        keyed.where("exists(found, o -> o.kind is null)")
        .select("row", F.explode(F.filter("found", lambda o: o["kind"].isNull())).alias("o"))
        .select("row", "o", F.explode(patterns(F.col("o"))).alias("pattern"))
        .join(sure, "pattern")
        .groupBy("row", F.col("o.start").alias("start"), F.col("o.stop").alias("stop"))
        .agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        # a part of a longer find of its kind is the same identifier
        .withColumn("reach", F.max("stop").over(Window.partitionBy("row", "kind").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)))
        .where("reach is null or reach < stop")
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "stop")).alias("more"))
    )
    base = F.transform(F.filter("found", lambda o: o["kind"].isNotNull()), span)
    return keyed.join(candidates, "row", "left").select(
        "id",
        base.alias("base"),
        F.concat(base, F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,stop:int>>"))).alias("spans"),
    )


def _order(spans):
    """Spans sorted by kind as listed, then start."""
    ranked = F.transform(
        spans,
        lambda s: F.struct(
            F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")
        ),
    )
    return F.array_sort(F.array_distinct(ranked))


def text_of_spans(spans):
    """Column: ``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(
        F.transform(_order(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])

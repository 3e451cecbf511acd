"""Text functions as column expressions: trimming, e-mail, keys for matching, digests."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"

# Words of companies' legal forms, ignored when companies are matched.
LEGAL_FORMS = ("inc", "corp", "corporation", "llc", "ltd", "co", "gmbh", "plc", "company", "limited")


#: White space of any kind.
BLANKS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def clean_email(c: Column) -> Column:
    """Trimmed and lower case; null unless the whole string is an address."""
    e = F.lower(strip(c))
    return F.when(e.rlike(rf"\A{EMAIL}\z"), e)


def emails_in(text: Column) -> Column:
    """Distinct addresses of a text in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def _tokens(c: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(c), "[.,]", " "), r"(?U)\s+")


def name_key(name: Column) -> Column:
    """Lower case, dots and commas as blanks, one-letter words dropped."""
    return F.array_join(F.filter(_tokens(name), lambda t: F.length(t) > 1), " ")


#: Words without dots and commas, one blank between two; and a legal form among them.
_WORDS, _FORM = r"\A[!-+\-/-~]+( [!-+\-/-~]+)*\z", rf"(\A| )({'|'.join(LEGAL_FORMS)})( |\z)"


def company_key(company: Column) -> Column:
    """Lower case without dots, commas and legal forms; if nothing is left, with the legal forms."""
    low = F.lower(company)
    kept = F.filter(_tokens(company), lambda t: (t != "") & ~t.isin(*LEGAL_FORMS))
    plain = strip(F.regexp_replace(low, "[.,]", " "))
    # most names are plain words that stay as they are, which two patterns tell; a list of tokens takes many times as long
    return F.when(low.rlike(_WORDS) & ~low.rlike(_FORM), low).otherwise(F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), plain))


def content_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each closed by a zero character."""
    whole = reduce(lambda a, b: F.concat(a, b, F.lit("\0")), parts, F.lit(""))
    return F.sha2(whole.cast("binary"), 256)

"""Telephone numbers in E.164 as column expressions.

Numbers of the plans below are checked by leading digits and length, those of the North American plan by area and
exchange; of other calling codes only the length is known.  All plans are one pattern that reads code and number at once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import once, strip

# Calling codes of one and two digits; every other code has three.
_SHORT_CODES = (
    "7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|"
    "90|91|92|93|94|95|98"
)
# National numbers by calling code: leading digits and lengths of the public numbering plans.
PLANS = {
    "1": r"[2-9](?:[02-8]\d|1[02-9])[2-9](?:[02-9]\d|1[02-9])\d{4}",
    "7": r"[3-9]\d{9}", "20": r"1[0125]\d{8}|2\d{8}|[3-9]\d{7,8}", "27": r"[1-8]\d{8}", "30": r"[26]\d{9}", "31": r"[1-9]\d{8}", "32": r"4\d{8}|[1-9]\d{7}",
    "33": r"[1-79]\d{8}", "34": r"[6-9]\d{8}", "36": r"(?:20|30|31|50|70)\d{7}|[1-9]\d{7}", "39": r"3\d{8,9}|0\d{5,10}", "40": r"[237]\d{8}", "41": r"[2-9]\d{8}",
    "43": r"[1-9]\d{3,12}", "44": r"1\d{8,9}|2[03489]\d{8}|3[0347]\d{8}|5[56]\d{8}|7[1-57-9]\d{8}|800\d{6,7}|8[047]\d{8}|9[018]\d{8}", "45": r"[2-9]\d{7}",
    "46": r"[1-9]\d{6,9}", "47": r"[2-9]\d{7}", "48": r"[1-9]\d{8}", "49": r"1[5-7]\d{8,9}|[2-9]\d{5,11}", "51": r"9\d{8}|[1-8]\d{7}", "52": r"[1-9]\d{9}",
    "54": r"9?[1-36-8]\d{9}", "55": r"[1-9][1-9](?:9\d{8}|[2-5]\d{7})", "56": r"[2-9]\d{8}", "57": r"3\d{9}|60[1-8]\d{7}", "58": r"[24]\d{9}",
    "60": r"1\d{8,9}|[3-9]\d{7,8}", "61": r"[23478]\d{8}", "62": r"8\d{8,11}|[2-7]\d{6,10}", "63": r"9\d{9}|[2-8]\d{8}", "64": r"2\d{7,9}|[34679]\d{7}",
    "65": r"[3689]\d{7}", "66": r"[689]\d{8}|[2-57]\d{7}", "81": r"[7-9]0\d{8}|[1-9]\d{8}", "82": r"1\d{8,9}|2\d{7,8}|[3-6][1-5]\d{7,8}|70\d{8}",
    "84": r"[35789]\d{8}|2\d{9}", "86": r"1[3-9]\d{9}|10\d{8}|[2-9]\d{9}", "90": r"[2-58]\d{9}", "91": r"[1-9]\d{9}", "92": r"3\d{9}|[2-9]\d{7,9}", "94": r"[1-9]\d{8}",
    "98": r"[1-9]\d{9}", "212": r"[5-8]\d{8}", "213": r"[5-7]\d{8}|[1-4]\d{7}", "216": r"[2-57-9]\d{7}", "234": r"[789][01]\d{8}|[1-9]\d{6,7}", "254": r"[17]\d{8}|[2-6]\d{6,8}",
    "351": r"[23689]\d{8}", "353": r"8[3-9]\d{7}|[1-9]\d{6,8}", "354": r"[4-9]\d{6}", "358": r"[1-9]\d{4,10}", "370": r"[3-6]\d{7}", "371": r"[268]\d{7}", "372": r"[3-7]\d{6,7}",
    "380": r"[3-9]\d{8}", "386": r"[1-7]\d{7}", "420": r"[2-9]\d{8}", "421": r"[2-9]\d{8}", "852": r"[2-9]\d{7}", "886": r"9\d{8}|[2-8]\d{7,8}", "966": r"[15]\d{8}",
    "971": r"5[024-68]\d{7}|[2-4679]\d{7}", "972": r"5\d{8}|[2-489]\d{7}",
}


def _all_plans() -> str:
    """One pattern of all plans; codes that have none are read by the length of their numbers."""
    known = "|".join(PLANS)
    told = "|".join(f"{code}(?:{plan})" for code, plan in PLANS.items())
    return rf"\A(?:{told}|(?!{known})(?:(?:{_SHORT_CODES})\d{{7,11}}|(?!{_SHORT_CODES})[2-9]\d{{2}}\d{{6,10}}))\z"


#: Calling code and national prefix of regions that numbers without + can be read in.
REGIONS = {"US": ("1", ""), "CA": ("1", ""), "GB": ("44", "0"), "DE": ("49", "0"), "FR": ("33", "0"), "IN": ("91", "0"), "AU": ("61", "0")}
CANDIDATE = r"(?<![\w+.])(?:\+\d|\(?\d)[\d\s().\-/]{6,48}\d(?![\w])"
#: Dates, which look like numbers in parts.
_DATE = r"\A(?:\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})|\d{4}[-/.]\d{2}[-/.]\d{2})(?:\s|\z)"
#: Where a candidate that is no number as a whole may hold several.
_BETWEEN = r"/+|\s+-\s*|\s+(?=[+(])"


def _international(digits: Column) -> Column:
    return F.when(digits.rlike(_all_plans()), F.concat(F.lit("+"), digits))


def normalize_phone(c: Column, region: str = "US") -> Column:
    """E.164 of a valid number, else null; without a leading + it is read as a number of ``region``."""
    t = strip(c)
    digits = F.regexp_replace(F.regexp_replace(t, r"(?i)\s*(?:ext\.?|x)\s*\d{1,6}\z", ""), "[^0-9]", "")
    code, prefix = REGIONS[region]
    if code == "1":
        home = F.when(F.length(digits) == 11, F.when(digits.startswith("1"), _international(digits))).otherwise(_international(F.concat(F.lit("1"), digits)))
    else:
        home = _international(F.concat(F.lit(code), F.regexp_replace(digits, rf"\A{prefix}", "")))
    plain = ~t.rlike(r"(?i)[a-wyz]") | t.rlike(r"(?i)\A[^a-z]*(?:ext\.?|x)\s*\d{1,6}\z")
    return F.when(plain & (F.length(digits) > 0), F.when(t.startswith("+"), _international(digits)).otherwise(home))


def phones_in(text: Column, region: str = "US") -> Column:
    """Valid numbers of a text, distinct and sorted; a stretch that is none as a whole is tried in its parts, dates are left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CANDIDATE), F.lit(0))
    undated = F.filter(found, lambda p: ~p.rlike(_DATE))

    def told(p: Column, parts: Column) -> Column:
        return once(normalize_phone(p, region), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(parts))

    words = lambda p: F.array_compact(F.transform(F.split(p, r"\s+"), lambda q: normalize_phone(q, region)))
    parts = lambda p: F.flatten(F.transform(F.split(p, _BETWEEN), lambda q: told(q, words(q))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(undated, lambda p: told(p, parts(p))))))

import pytest
from pyspark.sql import functions as F

from claimloom.functions import dates, phones, places, skills, text


def values(spark, function, inputs):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r["o"] for r in rows.select("k", function(F.col("v")).alias("o")).orderBy("k").collect()]


def test_year_month(spark):
    good = {"Jan 2021": "2021-01", "2019": "2019-01", "03/2021": "2021-03", "2021-03": "2021-03", "March 2020": "2020-03", "Sept 2020": "2020-09"}
    assert values(spark, dates.year_month, list(good)) == list(good.values())
    bad = ["Present", "now", "Summer 2019", "Q1 2020", "May", "5pm", "12:30", "", None, "1850", "13/2020"]
    assert values(spark, dates.year_month, bad) == [None] * len(bad)


def test_free_dates(spark):
    good = {
        "2020 Jan 5": "2020-01", "31/12/2020": "2020-12", "12/31/2020": "2020-12", "20200115": "2020-01", "Mon 5 Jan 2020": "2020-01", "1 2020": "2020-01",
        "2020-01-15T10:30:00+02:00": "2020-01", "2020-03-15 10:30:15.5Z": "2020-03", "10:30 PM EST, 5th of March 2020": "2020-03", "20200115T1030": "2020-01",
        "Feb 29 2020": "2020-02", "31.12.2020": "2020-12", "5/4/2020": "2020-05", "13/4/2020": "2020-04", "10:30 JAN 2020": "2020-01", "Sep. 1999": "1999-09",
    }
    assert values(spark, dates.year_month, list(good)) == list(good.values())
    bad = ["Feb 29 2021", "Jan-Mar 2020", "2019 2020", "25:00 Jan 2020", "Jan 2020 EST", "12.2020", "5/2020/10", "2020-13", "Jan 32 2020", "5/4/20", "Jan 15,2020", "2020-Mon", "01/02/03/2020"]
    assert values(spark, dates.year_month, bad) == [None] * len(bad)


def test_date_range(spark):
    cases = {
        "Jan 2021 - Present": ("2021-01", None), "2019-2021": ("2019-01", "2021-01"), "2019 to 2021": ("2019-01", "2021-01"),
        "2021-03": ("2021-03", None), "Jan 2019 – Jan 2021": ("2019-01", "2021-01"), "garbage": (None, None), None: (None, None),
        # two months without blanks around the dash are not split: neither is read
        "Jan 2021–Mar 2022": (None, None),
    }
    assert [tuple(v) for v in values(spark, dates.date_range, list(cases))] == list(cases.values())


def test_phones(spark):
    good = {"(415) 555-0132": "+14155550132", "+44 20 7946 0958": "+442079460958", "+1-415-555-0144": "+14155550144"}
    assert values(spark, phones.normalize_phone, list(good)) == list(good.values())
    bad = ["N/A", "12345", "(999) 999-9999", "+1 (152) 555-8590", "", None]
    assert values(spark, phones.normalize_phone, bad) == [None] * len(bad)
    assert values(spark, lambda c: phones.normalize_phone(c, "GB"), ["020 7946 0958"]) == ["+442079460958"]
    assert values(spark, phones.phones_in, ["call 415-555-0177 or 415-555-0177 today", None]) == [["+14155550177"], []]


def test_phones_of_other_plans(spark):
    good = {"+33 1 42 68 53 00": "+33142685300", "+49 (0)30 901820": None, "+49 30 901820": "+4930901820", "+91 98765 43210": "+919876543210", "+353 87 123 4567": "+353871234567",
            "+33 0 42 68 53 00": None, "+34 512 345 678": None, "+44 6 1234 5678": None, "+65 6123 4567": "+6561234567"}
    assert values(spark, phones.normalize_phone, list(good)) == list(good.values())
    assert values(spark, lambda c: phones.normalize_phone(c, "FR"), ["01 42 68 53 00"]) == ["+33142685300"]
    texts = ["415-555-0177 / 415-555-0178", "on 12/31/2020 5550177", "2020-12-31 10", "415-555-0177 (212) 555-0144"]
    assert values(spark, phones.phones_in, texts) == [["+14155550177", "+14155550178"], [], [], ["+12125550144", "+14155550177"]]


def test_countries_and_locations(spark):
    good = {"U.S.A.": "US", "England": "GB", "DEU": "DE", "SF, CA, USA": "US", " united states ": "US"}
    assert values(spark, places.normalize_country, list(good)) == list(good.values())
    formal = {
        "Republic of Korea": "KR", "Korea, Republic of": "KR", "Democratic People's Republic of Korea": "KP", "Cote d'Ivoire": "CI", "Côte d’Ivoire": "CI", "CÔTE D'IVOIRE": "CI",
        "Federal Republic of Germany": "DE", "Islamic Republic of Iran": "IR", "Tanzania, United Republic of": "TZ", "Kingdom of Spain": "ES", "the Republic of the Union of Myanmar": "MM",
        "Hong Kong": "HK", "Congo": "CG", "Saint Lucia": "LC", "Trinidad and Tobago": "TT", "Curacao": "CW", "Republic of China": None, "Republic of": None, "Republic of Nowhere": None,
        "Plurinational State of Bolivia": "BO", "Viet Nam": "VN", "Seoul, Republic of Korea": "KR", "Turkiye": "TR", "Dominican Republic": "DO", "French Republic": "FR",
    }
    assert values(spark, places.normalize_country, list(formal)) == list(formal.values())
    assert values(spark, places.normalize_country, ["Nowhere", "XYZ", "12345", "", None]) == [None] * 5
    cases = {
        "SF, CA, USA": ("SF", "CA", "US"), "London, UK": ("London", None, "GB"), "San Francisco, CA": ("San Francisco", "CA", None),
        "San Francisco, CA.": ("San Francisco", "CA", None), "Remote": ("Remote", None, None), "USA": (None, None, "US"), " ": (None,) * 3, None: (None,) * 3,
    }
    assert [tuple(v) for v in values(spark, places.split_location, list(cases))] == list(cases.values())


def test_skills(spark):
    got = values(spark, skills.canonical_skill, ["js", "ReactJS", "K8S", "C#", "kubernets", "pythonn", "basket weaving", " ", None])
    assert [g["name"] for g in got] == ["JavaScript", "React", "Kubernetes", "C#", "Kubernetes", "Python", "basket weaving", "", ""]
    assert [g["method"] for g in got] == ["exact_alias"] * 4 + ["fuzzy_match"] * 2 + ["passthrough", "empty", "empty"]
    assert round(got[4]["score"], 1) == 94.7
    assert values(spark, skills.skills_in, ["Mentorship; java script on redis. Go!", None]) == [["Java", "JavaScript", "Mentoring", "Redis"], []]


def test_near_misses_by_brute_force(spark):
    import random

    rng, known = random.Random(8), skills.aliases()
    made = ["a b", "é" * 3, "Spring  Boot", "boot spring", "C", "x" * 80, "  js "]
    for alias in rng.choices(sorted(known), k=60):
        at = rng.randrange(len(alias))
        made.append(rng.choice([alias[:at] + alias[at + 1 :], alias[:at] + "q" + alias[at:], alias.upper(), alias[::-1]]))
    expected = []
    for raw in made:
        clean = raw.strip()
        score, name = min(((-skills.likeness(clean.lower(), a), known[a]) for a in known), default=None)
        if not clean:
            expected.append(("", "empty", 0.0))
        elif clean.lower() in known:
            expected.append((known[clean.lower()], "exact_alias", 100.0))
        else:
            expected.append((name, "fuzzy_match", -score) if -score >= 90 else (clean, "passthrough", -score))
    assert [(g["name"], g["method"], g["score"]) for g in values(spark, skills.canonical_skill, made)] == expected


def test_common_subsequence_is_exact():
    import random

    rng = random.Random(3)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert skills.common_length(a, b) == plain(a, b)


def test_keys(spark):
    assert values(spark, text.name_key, ["John A. Smith", "J. Smith", "X", None]) == ["john smith", "smith", "", None]
    assert values(spark, text.company_key, ["Acme Corp.", "Acme", "Inc", "Globex, Ltd"]) == ["acme", "acme", "inc", "globex"]
    assert values(spark, text.clean_email, [" A@B.Co ", "a@b", None]) == ["a@b.co", None, None]
    assert values(spark, text.strip, ["  a b\t"]) == ["a b"]


@pytest.mark.parametrize("function", [dates.year_month, phones.normalize_phone, places.normalize_country, text.clean_email])
def test_normalisers_never_raise_and_are_stable(spark, function):
    odd = ["\x00", "𝟙𝟚", "+", "+" * 50, "9" * 40, "日本", "a@", "-", "()", "\n", "x" * 5000, "2021-99", "00/0000", "٣/٢٠٢١"]
    once = values(spark, function, odd)
    again = values(spark, function, [o for o in once if o is not None])
    assert again == [o for o in once if o is not None] or function is places.normalize_country

"""Skill names: exact aliases, near misses, and a careful scan of prose."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import once, strip

# Canonical skills and their other spellings; the canonical name is a spelling too.
TAXONOMY = {
    "JavaScript": ("js", "javascript", "ecmascript", "java script"),
    "TypeScript": ("ts", "typescript"),
    "React": ("react", "reactjs", "react.js"),
    "Node.js": ("node", "nodejs", "node.js"),
    "Python": ("py", "python", "python3"),
    "Java": ("java",),
    "Go": ("go", "golang"),
    "Rust": ("rust",),
    "C++": ("c++", "cpp", "cplusplus"),
    "C#": ("c#", "csharp", "c sharp"),
    "C": ("c lang", "c language"),
    "Ruby": ("ruby",),
    "PHP": ("php",),
    "Swift": ("swift",),
    "Kotlin": ("kotlin",),
    "Scala": ("scala",),
    "Kubernetes": ("k8s", "kubernetes", "kube"),
    "Docker": ("docker", "dockerfile"),
    "AWS": ("aws", "amazon web services"),
    "GCP": ("gcp", "google cloud", "google cloud platform"),
    "Azure": ("azure", "microsoft azure"),
    "Terraform": ("terraform",),
    "PostgreSQL": ("postgres", "postgresql", "psql"),
    "MySQL": ("mysql",),
    "MongoDB": ("mongodb", "mongo"),
    "Redis": ("redis",),
    "SQL": ("sql",),
    "GraphQL": ("graphql",),
    "REST APIs": ("rest", "rest api", "rest apis", "restful"),
    "HTML": ("html", "html5"),
    "CSS": ("css", "css3"),
    "Django": ("django",),
    "Flask": ("flask",),
    "FastAPI": ("fastapi",),
    "Spring": ("spring", "spring boot"),
    "Git": ("git",),
    "Shell": ("shell", "bash", "shell scripting"),
    "Machine Learning": ("ml", "machine learning"),
    "Data Analysis": ("data analysis", "data analytics"),
    "Leadership": ("leadership",),
    "Communication": ("communication",),
    "Mentoring": ("mentoring", "mentorship"),
    "Teamwork": ("teamwork", "collaboration"),
}

#: Likeness, of 100, from which a near miss counts as a spelling.
THRESHOLD = 90.0
#: Shorter spellings are not looked for in prose.
LEAST_IN_PROSE = 3


@lru_cache(maxsize=1)
def aliases() -> dict[str, str]:
    """Lower-case spelling -> canonical name; of a clash the alphabetically first name."""
    out: dict[str, str] = {}
    for name in sorted(TAXONOMY):
        for alias in (name.lower(), *TAXONOMY[name]):
            out.setdefault(alias, name)
    return out


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one integer of bits per row."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """Likeness, 0 to 100, of two strings' sorted words: twice the common subsequence over both lengths."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def _sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(strip(c), r"(?U)\s+")), " ")


@lru_cache(maxsize=1)
def _spellings() -> str:
    """All spellings as JSON: sorted words, their length, a bit for each place, the name, and for each letter a number with a bit for each of its places."""
    rows = []
    for alias, name in sorted(aliases().items()):
        words = " ".join(sorted(alias.split()))
        letters = "".join(dict.fromkeys(words))
        rows.append({"n": len(words), "full": (1 << len(words)) - 1, "name": name, "letters": letters, "places": [sum(1 << i for i, c in enumerate(words) if c == x) for x in letters]})
    return json.dumps(rows)


_SPELLINGS = "array<struct<n:int,full:bigint,name:string,letters:string,places:array<bigint>>>"


def _common(spelling: Column, letters: Column) -> Column:
    """Length of the longest common subsequence: bits of a row that end as zeros, by one sum and difference a letter."""
    full = spelling["full"]

    def step(row: Column, c: Column) -> Column:
        hit = row.bitwiseAND(F.coalesce(F.get(spelling["places"], F.instr(spelling["letters"], c) - 1), F.lit(0).cast("bigint")))
        return once(hit, lambda h: (row + h).bitwiseOR(row - h).bitwiseAND(full))

    return spelling["n"] - F.bit_count(F.aggregate(letters, full, step))


def _nearest(key: Column) -> Column:
    """struct(score, name) of the most alike spelling; of equal ones the first name.  Spellings whose length alone rules them out aren't compared."""
    words = _sorted_words(key)

    def search(w: Column) -> Column:
        letters, length = F.split(w, ""), F.length(w)

        def better(best: Column, spelling: Column) -> Column:
            total = length + spelling["n"]
            compared = once(
                200.0 * _common(spelling, letters) / total,
                lambda score: F.when(
                    (score > best["score"]) | ((score == best["score"]) & (spelling["name"] < best["name"])), F.struct(score.alias("score"), spelling["name"].alias("name"))
                ).otherwise(best),
            )
            return F.when(200.0 * F.least(length, spelling["n"]) / total < best["score"], best).otherwise(compared)

        return F.aggregate(F.from_json(F.lit(_spellings()), _SPELLINGS), F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("name")), better)

    return once(words, search)


def canonical_skill(raw: Column) -> Column:
    """struct(name, canonical, method, score): exact spelling, near miss, or the trimmed string as it is."""

    def told(clean: Column) -> Column:
        judged = lambda name, canonical, method, score: F.struct(
            name.alias("name"), F.lit(canonical).alias("canonical"), F.lit(method).alias("method"), score.cast("double").alias("score")
        )
        near = once(
            _nearest(F.lower(clean)),
            lambda best: F.when(best["score"] >= THRESHOLD, judged(best["name"], True, "fuzzy_match", best["score"])).otherwise(
                judged(clean, False, "passthrough", best["score"])
            ),
        )
        known = once(exact_skill(clean), lambda name: F.when(name.isNotNull(), judged(name, True, "exact_alias", F.lit(100.0))).otherwise(near))
        return F.when(clean == "", judged(F.lit(""), False, "empty", F.lit(0.0))).otherwise(known)

    return once(F.coalesce(strip(raw), F.lit("")), told)


def exact_skill(raw: Column) -> Column:
    """Canonical name of an exact spelling, else null; without Python."""
    table = F.create_map(*(F.lit(x) for pair in sorted(aliases().items()) for x in pair))
    return F.try_element_at(table, F.lower(strip(raw)))


def prose_aliases() -> list[str]:
    """Spellings that are looked for in prose: long enough, letters, digits and blanks only."""
    return [a for a in sorted(aliases()) if len(a) >= LEAST_IN_PROSE and all(c.isalnum() or c.isspace() for c in a)]


def _told_by(alias: str) -> list[str]:
    """Names that a spelling in prose stands for: its own and those of shorter spellings that it starts with."""
    return sorted({aliases()[a] for a in prose_aliases() if alias == a or alias.startswith(f"{a} ")})


def skills_in(text: Column) -> Column:
    """Canonical skills that a text names as whole words, sorted.

    One pass: at each word the longest spelling that starts there is taken without moving on, so spellings inside
    it are seen at their own words and those that it starts with are listed with it.
    """
    by_first: dict[str, list[str]] = {}
    for alias in sorted(prose_aliases(), key=lambda a: (-len(a), a)):
        by_first.setdefault(alias[0], []).append(alias[1:])
    words = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items()))
    table = F.create_map(*(x for a in prose_aliases() for x in (F.lit(a), F.array(*map(F.lit, _told_by(a))))))
    seen = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?U)\b(?=({words})\b)"), F.lit(1)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(seen, lambda a: F.try_element_at(table, a)))))


def canonical_each(lists: Column) -> Column:
    """Canonical names of the elements of arrays; blank elements become null."""
    return F.transform(lists, lambda i: F.nullif(canonical_skill(i)["name"], F.lit("")))

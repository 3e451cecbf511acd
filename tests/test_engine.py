"""Linking, fusion, projection and files, with the cases that results must keep."""

import hashlib
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimloom import engine, render
from claimloom.config import ConfigError, FieldSpec, OutputConfig, default_config
from claimloom.operators import enrich, fuse, link
from claimloom.plans import project
from claimloom.schema import CLAIMS, PROFILE, json_schema
from claimloom.sources import files, resume


def claims(spark, *rows):
    """(source, key, field, value, confidence[, method]) in order."""
    out = []
    for k, (source, key, field, value, conf, *more) in enumerate(rows):
        exp = value if field == "experience" else None
        edu = value if field == "education" else None
        plain = value if isinstance(value, str) else None
        num = value if isinstance(value, float) else None
        out.append((source, key, k, field, plain, num, exp, edu, Decimal(str(conf)), more[0] if more else "m", None))
    return spark.createDataFrame(out, CLAIMS)


def fused(spark, *rows):
    return {r["candidate_id"]: r for r in engine.build_profiles(claims(spark, *rows)).collect()}


def clusters(spark, *rows, compat="default"):
    found = link.link(claims(spark, *rows), compat).collect()
    out = {}
    for r in found:
        out.setdefault(r["cluster"], set()).add(r["record_key"])
    return sorted(map(sorted, out.values()))


def job(company, title=None, start=None, end=None):
    return (company, title, start, end, None)


def test_winner_by_trust_then_source_then_order(spark):
    got = fused(spark, ("csv_recruiter", "a", "candidate_id", "c", 1.0), ("ats_json", "b", "candidate_id", "c", 1.0),
                ("csv_recruiter", "a", "full_name", "Low", 0.95), ("ats_json", "b", "full_name", "High", 0.95))["c"]
    assert got["full_name"] == "High"
    assert {tuple(p) for p in got["provenance"]} >= {("full_name", "ats_json", "m"), ("full_name", "ats_json", "merge_winner")}
    assert ("full_name", "csv_recruiter", "m") not in {tuple(p) for p in got["provenance"]}
    same = fused(spark, ("notes", "a", "candidate_id", "c", 1.0), ("notes", "a", "headline", "first", 0.5), ("notes", "a", "headline", "second", 0.5))["c"]
    assert same["headline"] == "first"


def test_confidence_arithmetic(spark):
    rows = [("ats_json", "a", "candidate_id", "c", 1.0), ("github", "g", "candidate_id", "c", 1.0), ("csv_recruiter", "r", "candidate_id", "c", 1.0),
            ("ats_json", "a", "full_name", "X Y", 0.95), ("github", "g", "full_name", "X Y", 0.8), ("csv_recruiter", "r", "full_name", "Z Y", 0.95)]
    parts = fuse.Parts(fuse.clustered(claims(spark, *rows), link.link(claims(spark, *rows))))
    got = {r["field_path"]: r["units"] for r in parts.scalars.collect()}
    assert got == {"candidate_id": 9900, "full_name": 6930}
    one = fused(spark, *rows)["c"]
    assert one["overall_confidence"] == round((2 * 0.99 + 2 * 0.693) / 4, 4)


def test_lists_skills_and_dates(spark):
    got = fused(spark, ("ats_json", "a", "candidate_id", "c", 1.0), ("resume", "r", "candidate_id", "c", 1.0),
                ("ats_json", "a", "skills", "Go", 0.9), ("resume", "r", "skills", "Go", 0.7), ("resume", "r", "skills", "C", 0.5),
                ("ats_json", "a", "experience", job("Acme Corp", "T1", None, None), 0.92), ("resume", "r", "experience", job("acme", "T2", "2020-01", "2021-01"), 0.7),
                ("resume", "r", "experience", job("Beta", "T3", "2022-01", None), 0.7), ("resume", "r", "experience", job(None, "T4"), 0.7))["c"]
    assert [(s["name"], s["confidence"], s["sources"]) for s in got["skills"]] == [("C", 0.25, ["resume"]), ("Go", 0.95, ["ats_json", "resume"])]
    # a present job cannot win over an end that a less trusted source gives; two stints at one employer are one
    assert [(e["company"], e["title"], e["start"], e["end"]) for e in got["experience"]] == [
        ("Beta", "T3", "2022-01", None), ("Acme Corp", "T1", "2020-01", "2021-01"), (None, "T4", None, None)
    ]
    assert ("experience.title", "ats_json", "merge_winner") in {tuple(p) for p in got["provenance"]}


def test_derived_ids(spark):
    got = fused(spark, ("notes", "k1", "emails", "b@x.io", 0.5), ("notes", "k2", "full_name", "Ann B. Lee", 0.5), ("notes", "k3", "skills", "Go", 0.45))
    assert set(got) == {"b@x.io", "ann_lee", "k3"}
    assert ("candidate_id", "merge", "derived_id") in {tuple(p) for p in got["k3"]["provenance"]}
    assert got["k3"]["emails"] == [] and got["k3"]["links"]["other"] == []


def test_linking(spark):
    assert clusters(spark, ("notes", "a", "emails", "e", 0.5), ("github", "b", "emails", "e", 0.5), ("github", "b", "phones", "p", 0.5), ("resume", "c", "phones", "p", 0.5), ("resume", "d", "emails", "p", 0.5)) == [["a", "b", "c"], ["d"]]
    assert clusters(spark, ("notes", "a", "full_name", "Ann Lee", 0.5), ("github", "b", "full_name", "Ann Q. Lee", 0.5)) == [["a", "b"]]
    two = [("ats_json", "a", "candidate_id", "1", 1.0), ("ats_json", "a", "full_name", "Ann Lee", 0.9), ("ats_json", "b", "candidate_id", "2", 1.0), ("ats_json", "b", "full_name", "Ann Lee", 0.9)]
    assert clusters(spark, *two) == [["a"], ["b"]]
    # an empty name key links nothing, but in the compatible mode
    empty = [("notes", "a", "full_name", "X", 0.5), ("notes", "b", "full_name", "Y", 0.5)]
    assert clusters(spark, *empty) == [["a"], ["b"]]
    assert clusters(spark, *empty, compat="reference") == [["a", "b"]]


def test_a_bridge_does_not_join_two_ids(spark):
    rows = [("s1", "a", "candidate_id", "c1", 1.0), ("s1", "a", "full_name", "Aa Aa", 0.9), ("s2", "b", "emails", "e", 0.9), ("s2", "b", "full_name", "Aa Aa", 0.9),
            ("s3", "c", "emails", "e", 0.9), ("s3", "c", "full_name", "Bb Bb", 0.9), ("s4", "d", "candidate_id", "c2", 1.0), ("s4", "d", "full_name", "Bb Bb", 0.9)]
    assert clusters(spark, *rows) == [["a", "b", "c"], ["d"]]
    assert clusters(spark, *rows, compat="reference") == [["a", "b", "c", "d"]]


def test_over_merge_and_unknown_sources(spark):
    c = claims(spark, ("x", "a", "candidate_id", "1", 1.0), ("x", "a", "emails", "e", 1.0), ("ats_json", "b", "candidate_id", "2", 1.0), ("ats_json", "b", "emails", "e", 1.0))
    assert [r["candidate_ids"] for r in link.over_merged(c, link.link(c)).collect()] == [["1", "2"]]
    assert [r["source"] for r in link.unknown_sources(c).collect()] == ["x"]


def test_results_do_not_depend_on_partitions(spark):
    rows = [("ats_json", "a", "candidate_id", "c", 1.0), ("notes", "n", "full_name", "Ann Lee", 0.5), ("ats_json", "a", "full_name", "Ann Lee", 0.9), ("notes", "n", "skills", "Go", 0.45)]
    c = claims(spark, *rows)
    once = sorted(map(str, engine.build_profiles(c).collect()))
    assert once == sorted(map(str, engine.build_profiles(c.repartition(7).orderBy(F.desc("seq"))).collect()))


def test_no_claims(spark):
    assert engine.build_profiles(claims(spark).limit(0)).count() == 0


def profile(spark):
    row = ("c1", "Ann Lee", ["a@x.io", "b@x.io"], [], ("SF", None, "US"), (None, None, None, []), None, 8.0,
           [("Go", 0.9, ["ats_json"]), ("py", 0.5, ["notes", "resume"])], [("Acme", "T", "2020-01", None, None)], [], [("f", "s", "m")], 0.5)
    return spark.createDataFrame([row], PROFILE)


def projected(spark, *specs, **more):
    mode = more.pop("mode", "strict")
    return project.project(profile(spark), OutputConfig(specs, **more), mode).first().asDict(recursive=True)


def test_paths(spark):
    specs = [FieldSpec("mail", "emails[1]"), FieldSpec("none", "emails[5]"), FieldSpec("city", "location.city"), FieldSpec("names", "skills[].name"),
             FieldSpec("nested", "skills[].sources[]"), FieldSpec("second", "skills[].sources[1]"), FieldSpec("sums", "experience[].summary"), FieldSpec("odd", "no.such")]
    assert projected(spark, *specs) == {
        "mail": "b@x.io", "none": None, "city": "SF", "names": ["Go", "py"], "nested": [["ats_json"], ["notes", "resume"]],
        "second": ["resume"], "sums": [None], "odd": None,
    }
    assert projected(spark, FieldSpec("s", "skills[].name", normalize="canonical"), FieldSpec("u", "full_name", normalize="upper")) == {"s": ["Go", "Python"], "u": "ANN LEE"}
    for bad in ("", "a[", "a..b", "a[-1]", "a b"):
        with pytest.raises(ConfigError):
            project.resolve(bad)


def test_missing_required_and_types(spark):
    said = lambda *s, **m: projected(spark, *s, mode="permissive", **m)["_errors"]
    assert said(FieldSpec("phones", required=True)) == []  # an empty list is there
    assert "required field 'headline'" in said(FieldSpec("headline", required=True))[0]
    assert "on_missing='error'" in said(FieldSpec("h", "headline"), on_missing="error")[0]
    assert said(FieldSpec("h", "headline", on_missing="null"), on_missing="error") == []
    assert "expected type 'string'" in said(FieldSpec("y", "years_experience", "string"))[0]
    assert said(FieldSpec("y", "years_experience", "number")) == []
    assert "expected type 'string[]'" in said(FieldSpec("s", "experience[].summary", "string[]"))[0]
    with pytest.raises(Exception, match="required field 'headline'"):
        projected(spark, FieldSpec("headline", required=True))
    config = OutputConfig((FieldSpec("h", "headline", on_missing="omit"), FieldSpec("x", "headline"), FieldSpec("x", "full_name")), include_confidence=True)
    assert json.loads(project.to_json(profile(spark), config).first()["json"]) == {"x": "Ann Lee", "overall_confidence": 0.5}


def test_lint():
    config = OutputConfig((FieldSpec("a", "location.citi"), FieldSpec("b", "phones", "string"), FieldSpec("c", "full_name[0]"), FieldSpec("d", "skills[].name", "string[]"), FieldSpec("e", "full_name.x"), FieldSpec("f", "education[0].end_year", "number")))
    assert [(i.severity, i.path) for i in project.lint(config)] == [("error", "a"), ("error", "c"), ("error", "e"), ("warning", "b")]
    assert project.lint(default_config()) == []


@pytest.mark.parametrize("bad", [[], {}, {"fields": [{}]}, {"fields": [{"path": "a", "type": "x"}]}, {"fields": [], "more": 1}, {"fields": [{"path": "a", "on_missing": "drop"}]}])
def test_bad_configs(bad):
    with pytest.raises(ConfigError):
        OutputConfig.from_obj(bad)


LINES = ["Ann B. Lee", "Data Engineer", "ann@x.io | (415) 555-0132", "github.com/annlee", "", "EXPERIENCE", "Engineer, Acme Corp (Jan 2021 - Present)", "- did things 2019-2020",
         "", "EDUCATION", "B.S. in Physics, MIT, 2018", "Class XII 2014", "GPA: 9", "City School, Town", "SKILLS", "Languages: Python, Golang (2y)"]


def test_resume_structure(spark):
    rows = spark.createDataFrame([("\n".join(LINES),), (None,), ("",)], "text string")
    got, nothing, empty = (r["found"] for r in resume.take_apart(rows).collect())
    assert got["name"] == "Ann B. Lee"
    assert [tuple(u) for u in got["links"]] == [("links.github", "https://github.com/annlee")]
    assert [(e["title"], e["company"], e["dates"]) for e in got["jobs"]] == [("Engineer", "Acme Corp", "Jan 2021 - Present")]
    assert [(e["institution"], e["degree"], e["field"], e["end_year"]) for e in got["schools"]] == [("MIT", "B.S.", "Physics", 2018), ("City School", "Class XII", None, 2014)]
    assert got["skills"] == ["Python", "Golang"]
    assert nothing == empty == (None, [], [], [], [])


def test_resume_of_another_layout(spark):
    text = """Ann Lee — Data Lead
ann@x.io · https://linkedin.com/in/ann-lee/ · https://ann.example.org, https://b.example.org).
SUMMARY:
Builds things
Work Experience
Senior Engineer – Acme  Jan 2020 – Present
• Led 2019 - 2020
Analyst at Beta (2015 to 2017)
2011 - 2012
Education
B.Tech in Physics 2014 – 2018
CGPA 9.1
Town University, City
MBA 2020
Class XII 2013
skills
Tools: Git, Docker (2y) / k8s | c++;
- Java •  Spring
a very long line of prose that is certainly not the name of any skill at all"""
    got = resume.take_apart(spark.createDataFrame([(text,)], "text string")).first()["found"]
    assert got["name"] == "Ann Lee"
    assert [tuple(u) for u in got["links"]] == [("links.linkedin", "https://linkedin.com/in/ann-lee"), ("links.portfolio", "https://ann.example.org"), ("links.other", "https://b.example.org")]
    assert [tuple(j) for j in got["jobs"]] == [("Senior Engineer", "Acme", "Jan 2020 – Present"), ("Analyst", "Beta", "2015 to 2017")]
    assert [tuple(e) for e in got["schools"]] == [("Town University", "B.Tech", "Physics", 2018), (None, "MBA", None, 2020), (None, "Class XII", None, 2013)]
    assert got["skills"] == ["Git", "Docker", "k8s", "c++", "Java", "Spring"]


def test_files_to_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = tmp_path / "in"
    (at / "r.csv").write_text("﻿Candidate ID,Full Name,E-mail,Mobile,Other\nc-1,Ann Lee,ANN@x.io,(415) 555-0132,z\n,,bad,123,\n", encoding="utf-8")
    (at / "a.json").write_text(json.dumps({"candidates": [{"id": "c-1", "givenName": "Ann", "surname": "Lee", "skillTags": ["k8s", "Odd Thing"], "country": "England", "yearsExperience": 3}, 5]}))
    (at / "broken.json").write_text('{"skillTags": [,,')
    (at / "g.json").write_text(json.dumps({"user": {"login": "ann", "name": "Ann Lee", "location": "London, UK", "company": "@Acme"}, "repos": [{"language": "Go"}, None]}))
    (at / "n.txt").write_text("Candidate: Ann Lee\nbased in Paris; great mentorship\n")
    (at / "bin.txt").write_bytes(b"\xff\xfe\x00")
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in LINES)
    with zipfile.ZipFile(at / "cv.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    errors = files.parsed(files.read_files(spark, [str(at)])).where("error is not null").collect()
    assert [e["file_seq"].rsplit("/", 1)[-1] for e in errors] == ["broken.json"]
    profiles = engine.profiles_of_files(spark, [str(at), str(tmp_path / "absent")])
    text = json.loads(render.render_json(profiles.where("candidate_id = 'c-1'"), default_config()))
    assert text["full_name"] == "Ann Lee" and text["phones"] == ["+14155550132"] and text["years_experience"] == 3.0
    assert text["location"] == {"city": "London", "region": None, "country": "GB"}
    assert [s["name"] for s in text["skills"]] == ["Go", "Kubernetes", "Mentoring", "Odd Thing", "Python"]
    assert {"field": "experience", "source": "resume", "method": "date_parse"} in text["provenance"]
    lines = render.render_ndjson(profiles, default_config()).splitlines()
    assert len(lines) == profiles.count() and all(list(json.loads(x)) == sorted(json.loads(x)) for x in lines)


def test_enrichment_fills_only_gaps(spark):
    p = profile(spark)
    c = claims(spark, ("notes", "n", "emails", "a@x.io", 0.5))
    prose = spark.createDataFrame([("notes", "n", "1", " Ann works. ")], "source string, record_key string, seq string, text string")
    context = enrich.contexts(p, c, prose)
    assert context.first()["context"] == "[source: notes]\nAnn works."
    cache = context.select(enrich.cache_key(F.col("context"), "m").alias("key"), F.lit('{"headline":"H","experience":[{"company":"ACME inc","summary":"S"}]}').alias("answer"))
    fields = ("headline", "summary")
    assert enrich.misses(p, context, cache, "m", fields).count() == 0
    assert enrich.misses(p, context, cache.limit(0), "m", fields).count() == 1
    after = enrich.fill(p, enrich.answers(context, cache, "m"), "m")
    row = after.first()
    assert (row["headline"], row["experience"][0]["summary"], row["overall_confidence"]) == ("H", "S", 0.5)
    assert {tuple(x) for x in row["provenance"]} >= {("headline", "llm:m", "llm_extraction"), ("experience.summary", "llm:m", "llm_extraction")}
    assert {(r["field"], r["value"]) for r in enrich.report(p, after, "m").collect()} == {("headline", "H"), ("experience.summary", "S")}
    again = enrich.fill(after, enrich.answers(context, cache, "m"), "m").first()
    assert again["headline"] == "H"

    def failing(_):
        raise ValueError

    assert enrich.complete(enrich.misses(p, context, cache.limit(0), "m", fields), failing).count() == 0


def test_schema_and_commands(capsys, tmp_path):
    from claimloom import cli

    assert json_schema()["properties"]["emails"]["type"] == "array"
    assert cli.main(["schema"]) == 0
    assert json.loads(capsys.readouterr().out)["type"] == "object"
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text('{"fields": [{"path": "emails", "type": "string"}]}')
    bad.write_text('{"fields": [{"path": "mails"}]}')
    assert (cli.main(["lint", str(good)]), cli.main(["lint", str(bad)]), cli.main(["lint", str(tmp_path / "none.json")])) == (0, 1, 1)


def test_command_run(spark, capsys, tmp_path):
    from claimloom import cli

    (tmp_path / "a.csv").write_text("id,name\nc-1,Ann Lee\nc-2,Bob Roy\n")
    assert cli.main(["run", "-i", str(tmp_path / "a.csv"), "-f", "ndjson"]) == 0
    assert [json.loads(x)["candidate_id"] for x in capsys.readouterr().out.splitlines()] == ["c-1", "c-2"]
    assert cli.main(["run", "-i", str(tmp_path / "a.csv"), "-f", "xml"]) == 1
    config = tmp_path / "c.json"
    config.write_text('{"fields": [{"path": "headline", "required": true}]}')
    assert cli.main(["run", "-i", str(tmp_path / "a.csv"), "-c", str(config)]) == 1


def test_arriving_files(spark, tmp_path):
    from claimloom.streaming.files import follow

    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    for name, key in (("a", "c-1"), ("b", "c-2")):
        (folder / f"{name}.csv").write_text(f"id,name\n{key},Ann {name}\n")
        follow(spark, str(folder), str(tmp_path / "claims"), str(tmp_path / "ck"), lambda p, _: seen.append(p.count())).awaitTermination()
    assert seen == [1, 2]


RESUME_TEXTS = ["First College, Town\nmore about it\nSkills\na, b", "\n\nSummary:\n MBA 2001\nlast line", "GPA 1\nGPA 2\nFar College", None, "  Experience  \nx"]


@pytest.fixture
def resume_folder(spark, tmp_path):
    rows = [(k, t, "en") for k, t in enumerate(RESUME_TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def resume_lines(text):
    entry = "B.S. in en, 2014 - 2018"
    whole = text or ""
    body = "\n".join([whole, "Education:", entry, "GPA 3.9", whole, " SUMMARY ", whole, "education", entry, whole])
    return [line.strip() for line in body.splitlines()]


def brute_sections(lines):
    headings = {"education": "education", "summary": "summary", "skills": "skills", "experience": "experience"}
    opened = [headings.get(line.lower().rstrip(":")) for line in lines]
    at = [next((o for o in opened[k::-1] if o), "header") for k in range(len(lines))]
    return {s: [x for x, o, a in zip(lines, opened, at) if a == s and not o] for s in {"header", *filter(None, opened)}}


def test_registered_sections_against_brute_force(spark, resume_folder):
    from claimloom.plans.queries import QUERIES

    got = {(r["doc_id"], r["section"]): (r["n_lines"], r["lines_sha256"]) for r in QUERIES["resume_sections"](spark, resume_folder).collect()}
    want = {}
    for k, t in enumerate(RESUME_TEXTS):
        for s, lines in brute_sections(resume_lines(t)).items():
            want[k, s] = (len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert got == want


def test_registered_schools_look_two_lines_ahead(spark, resume_folder):
    from claimloom.plans.queries import QUERIES

    got = {}
    for r in QUERIES["resume_schools"](spark, resume_folder).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["institution"], r["degree"], r["field"], r["end_year"]))
    for k, t in enumerate(RESUME_TEXTS):
        lines, want = brute_sections(resume_lines(t))["education"], []
        for n, line in enumerate(lines):
            if line.startswith("B.S."):
                ahead = [x for x in lines[n + 1 : n + 3] if x and "GPA" not in x]
                # the next entry is no institution
                found = ahead[0].split(",")[0] if ahead and not ahead[0].startswith("B.S.") else None
                want.append((found, "B.S.", "en", 2018))
        assert got[k] == want, t
    assert got[0][0][0] == "First College" and got[2][0][0] is None


def test_answers_that_differ_late_stay_apart(spark, tmp_path):
    from claimloom.plans.queries import QUERIES

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "x" * 600 + "a"), (2, 0, "user", "q"), (2, 1, "user", "r"), (2, 2, "assistant", "x" * 600 + "b")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["conv_id"], r["turn"]): r["answer"] for r in QUERIES["lookahead_whole_texts"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): rows[1][3], (1, 1): None, (2, 0): rows[4][3], (2, 1): rows[4][3], (2, 2): None}


def test_context_holds_prose_of_notes_resumes_and_bios(spark, tmp_path):
    words = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "cv.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{words}"><w:body><w:p><w:r><w:t>Ann Lee</w:t></w:r></w:p><w:p><w:r><w:t>ann@x.io builds</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "hub.json").write_text(json.dumps({"user": {"login": "annlee", "name": "Ann Lee", "email": "ann@x.io", "bio": "Likes trees"}, "repos": [], "languages": {}}))
    (tmp_path / "n.txt").write_text("Name: Ann Lee\nann@x.io called")
    (tmp_path / "bad.docx").write_text("no archive")
    (tmp_path / "bad.json").write_text('{"user" "repos"')
    c = files.claims_of(spark, [str(tmp_path)])
    prose = files.prose_of(files.read_files(spark, [str(tmp_path)]))
    context = enrich.contexts(engine.build_profiles(c), c, prose).collect()
    assert [r["context"] for r in context] == ["[source: resume]\nAnn Lee\nann@x.io builds\n\n[source: github]\nLikes trees\n\n[source: notes]\nName: Ann Lee\nann@x.io called"]

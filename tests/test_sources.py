"""Listing by literal names, tables in byte ranges and JSON envelopes, against the standard library."""

import csv
import io
import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from claimloom.sources import ats, files, listing, tables


def test_names_are_literal(spark, tmp_path):
    names = ["a.txt", "_b.txt", ".c.txt", "cv[1].txt", "two words.txt", "x{1,2}*.txt", ".h/_d/e.txt", "ü%20.txt"]
    for name in names:
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(f"Name: {name}")
    os.symlink(tmp_path / "in" / "a.txt", tmp_path / "in" / "link.txt")
    (tmp_path / "in" / "broken.txt").symlink_to(tmp_path / "nowhere")
    inputs = [str(tmp_path / "in"), str(tmp_path / "in" / "cv[1].txt"), f"file://{tmp_path}/in/_b.txt"]
    with pytest.warns(UserWarning, match="no such input"):
        raw = files.read_files(spark, [*inputs, str(tmp_path / "none[1].txt")]).collect()
    assert sorted(r["text"] for r in raw if r["text"]) == sorted(f"Name: {n}" for n in names)


def test_a_file_that_goes_or_is_locked_leaves_a_reason(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("Name: Ann Lee")
    raw = listing.pieces_of(spark, [str(tmp_path)])
    reader = listing._Reader({"inputs": json.dumps([str(tmp_path)])})
    part = reader.partitions()[0]
    (tmp_path / "a.txt").unlink()
    got = {b.column(0)[0].as_py(): b.column(4)[0].as_py() for b in reader.read(part)}
    assert [v is None for _, v in sorted(got.items())] == [False, True]
    gone = raw.limit(0).sparkSession.createDataFrame([("x/a.txt", None, None, "OSError: gone")], files.RAW)
    assert [r["error"] for r in files.parsed(gone).collect()] == ["OSError: gone"]


def test_ranges_cover_long_files(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(bytes(range(256)) * 40)
    rows = listing.pieces_of(spark, [str(tmp_path)], only=r"\.csv$", range_bytes=1000).orderBy("part").collect()
    assert [r["part"] for r in rows] == list(range(11)) and b"".join(r["content"] for r in rows) == bytes(range(256)) * 40


def _by_reader(text):
    table = csv.DictReader(io.StringIO(text.lstrip("﻿")))
    roles = {h: tables.HEADERS[h.strip().lower()] for h in table.fieldnames or () if h.strip().lower() in tables.HEADERS}
    return [(k, *({roles[h]: row[h].strip() for h in roles if row.get(h)}.get(r) for r in tables.ROLES)) for k, row in enumerate(table)]


CELL = st.text(alphabet='a,é"\n ', max_size=4)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.permutations(["Name", "full name", "ID", "Email", "note", "Email"]), st.lists(st.lists(CELL, max_size=7), max_size=6)), min_size=4, max_size=4), st.integers(1, 9))
def test_tables_in_ranges_are_those_of_the_standard_reader(spark, made, size):
    texts = []
    for n, (header, rows) in enumerate(made):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\r\n" if n % 2 else "\n")
        writer.writerows([header, *rows])
        texts.append((f"f{n}.csv", ("﻿" if n == 1 else "") + out.getvalue()))
    pieces = [(p, i // size, bytearray(t.encode()[i : i + size])) for p, t in texts for i in range(0, len(t.encode()), size)]
    found, odd = tables.read(spark.createDataFrame(pieces, "path string, part bigint, content binary"))
    got = {p: [] for p, _ in texts}
    for r in found.orderBy("path", "k").collect():
        got[r[0]].append(tuple(r[1:]))
    assert odd.isEmpty() and got == {p: _by_reader(t) for p, t in texts}


def test_odd_tables_go_to_the_standard_reader_whole(spark):
    texts = {"q.csv": 'name,id\n5" pipe,1\n6" pipe,2\n', "r.csv": "name\na\rb\n", "u.csv": b"name\n\xff\n", "e.csv": "", "h.csv": "name,id", "ok.csv": "name\nAnn"}
    rows = [(p, 0, bytearray(t if isinstance(t, bytes) else t.encode())) for p, t in texts.items()]
    got = files.table_rows(spark.createDataFrame(rows, "path string, part bigint, content binary")).collect()
    assert sorted(r["raw"] for r in got if r["field_path"] == "full_name") == ['5" pipe', '6" pipe', "Ann"]
    assert [r["file_seq"] for r in got if r["error"]] == ["r.csv"]


def test_two_thousand_rows_in_many_ranges(spark, tmp_path):
    lines = ["candidate_id,name,email"] + [f'cand-{i:05d},"Person\n{i}",p{i}@example.com' for i in range(2000)]
    (tmp_path / "all.csv").write_text("\n".join(lines) + "\n")
    ranges = listing.pieces_of(spark, [str(tmp_path)], range_bytes=4096)
    assert ranges.count() > 20
    found = files.table_rows(ranges.select("path", "part", "content")).where("field_path = 'full_name'").collect()
    assert {(r["record_key"], r["raw"]) for r in found} == {(f"cand-{i:05d}", f"Person\n{i}") for i in range(2000)}


def test_envelopes(spark):
    rows = [
        ("a.json", '[{"name":" A B ","emails":["x@y.com",5,"X@Y.com"],"yearsExperience":7,"skillTags":[],"skills":["py",3]}, 5, {"candidateId":"7","yearsExperience":true}]'),
        ("b.json", '{"candidates":[{"id":"1","years_experience":2.5}]}'), ("c.json", '{"candidates":"x","givenName":"G","surname":"S"}'),
        ("d.json", '{"surname": '), ("e.json", '{"surname":1} x'), ("f.json", '{"surname":"Z","yearsExperience":null,"years_experience":4}'), ("g.json", "[]"), ("h.json", None),
    ]
    read = ats.members(spark.createDataFrame(rows, "path string, text string"))
    got = read.select("path", "k", ats.first_string(*ats.IDENTITY).alias("id"), ats.full_name().alias("name"), ats.addresses().alias("mail"), ats.years().alias("years"), ats.tags().alias("tags"), "error")
    found = {(r["path"], r["k"]): tuple(r)[2:7] for r in got.collect() if not r["error"]}
    assert found == {
        ("a.json", 0): (None, "A B", ["x@y.com"], 7.0, ["py"]), ("a.json", 2): ("7", None, [], None, []), ("b.json", 0): ("1", None, [], 2.5, []),
        ("c.json", 0): (None, "G S", [], None, []), ("f.json", 0): (None, "Z", [], None, []),
    }
    assert sorted(r["path"] for r in got.collect() if r["error"]) == ["d.json", "e.json", "h.json"]

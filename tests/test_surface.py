"""Exports, HTTP, recordings, the registry of kinds, inputs, enrichment from a cache that grows."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

import claimloom
from claimloom import engine, render
from claimloom.config import OutputConfig, default_config
from claimloom.operators import enrich
from claimloom.service import Service, form, serve
from claimloom.sources import files, hub


def test_exports():
    assert set(claimloom.__all__) <= set(dir(claimloom))
    assert [claimloom.trust_for(s) for s in ("ats_json", "notes", "llm:x", "who")] == [100, 30, 10, 0]
    assert OutputConfig.from_obj(default_config().to_obj()) == OutputConfig.from_obj(json.loads(json.dumps(default_config().to_obj())))


def multipart(files_, **fields):
    edge = "edge1"
    parts = [f'--{edge}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
    for name, content in files_:
        parts.append(f'--{edge}\r\nContent-Disposition: form-data; name="files"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode() + content + b"\r\n")
    return f"multipart/form-data; boundary={edge}", b"".join(parts) + f"--{edge}--\r\n".encode()


@pytest.fixture
def server(spark, tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "short.json").write_text('{"fields": [{"path": "id", "from": "candidate_id"}]}')
    (tmp_path / "configs" / "broken.json").write_text("{")
    running = serve(Service(spark, str(tmp_path / "configs"), str(tmp_path / "samples")), port=0)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_address[1]}", tmp_path
    running.shutdown()
    running.server_close()


def ask(url, kind=None, body=None):
    request = urllib.request.Request(url, data=body, headers={"Content-Type": kind} if kind else {})
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_http(server):
    base, folder = server
    assert ask(f"{base}/api/health") == (200, {"status": "ok"})
    assert [c["name"] for c in ask(f"{base}/api/configs")[1]["configs"]] == ["default", "short"]
    table = [("../../r.csv", b"id,name\nc-1,Ann Lee\nc-2,Bob Roy\n")]
    status, got = ask(f"{base}/api/transform", *multipart(table, config="short"))
    assert (status, got["count"], got["candidates"], got["enriched"]) == (200, 2, [{"id": "c-1"}, {"id": "c-2"}], False)
    inline = '{"fields": [{"path": "headline", "required": true}]}'
    assert ask(f"{base}/api/transform", *multipart(table, config=inline))[0] == 400
    assert ask(f"{base}/api/transform", *multipart(table, config="{no"))[0] == 400
    assert ask(f"{base}/api/transform", *multipart(table, config="../short"))[0] == 400
    assert ask(f"{base}/api/transform", *multipart([]))[0] == 400
    assert ask(f"{base}/api/transform/samples", *multipart([]))[0] == 404 == ask(f"{base}/api/none")[0]
    (folder / "samples").mkdir()
    (folder / "samples" / "a.csv").write_bytes(table[0][1])
    status, got = ask(f"{base}/api/transform/samples", *multipart([], config="short", enrich="true"))
    assert (status, got["count"], got["enriched"]) == (200, 2, False) and "no cache" in got["enrichment_status"]


def test_forms():
    assert form(*multipart([("a.txt", b"x\r\ny\x00")], config="c")) == ([("a.txt", b"x\r\ny\x00")], {"config": "c"})
    assert form("text/plain", b"x") == ([], {})


def test_recorded_users_are_read_like_files(spark, tmp_path):
    pages = {1: [{"name": f"r{k}", "language": "Go" if k % 2 else None, "fork": False, "stargazers_count": k} for k in range(100)], 2: [{"name": "z", "language": "Rust"}]}

    def get(address):
        return pages[int(address.rsplit("=", 1)[1])] if "repos" in address else {"login": "ann", "name": "Ann Lee", "location": "Berlin, Germany", "id": 5}

    path = hub.record("ann", get, str(tmp_path))
    assert json.loads(path.read_text())["languages"] == {"Go": 50, "Rust": 1}
    got = engine.profiles_of_files(spark, [str(path)]).first()
    assert got["full_name"] == "Ann Lee" and got["location"]["country"] == "DE" and [s["name"] for s in got["skills"]] == ["Go", "Rust"]


def test_inputs_are_read_once(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "n.txt").write_text("Name: Ann Lee")
    (tmp_path / "in2.txt").write_text("Name: Bob Roy")
    with pytest.warns(UserWarning, match="no such input"):
        raw = files.read_files(spark, [str(tmp_path / "in"), str(tmp_path / "in" / "deep"), f"{tmp_path}/in/", str(tmp_path / "in2.txt"), str(tmp_path / "none")])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in raw.collect()) == ["in2.txt", "n.txt"]
    assert "Exchange" not in raw._jdf.queryExecution().executedPlan().toString()


def test_another_kind_of_files(spark, tmp_path):
    def parse_card(stem, text):
        out = []
        files._Claims(out, "cards", stem, "regex_extraction").add("full_name", text.split(":")[1].strip(), 0.6)
        return out

    (tmp_path / "a.vcf").write_text("FN: Ann Lee")
    rules, parsers = dict(files.RULES), dict(files.PARSERS)
    try:
        files.register("cards", lambda f: f.suffix == ".vcf", parse_card, first=True)
        assert engine.profiles_of_files(spark, [str(tmp_path)]).first()["full_name"] == "Ann Lee"
    finally:
        files.RULES.clear()
        files.RULES.update(rules)
        files.PARSERS.clear()
        files.PARSERS.update(parsers)


def test_routing(spark):
    rows = [("a.csv", "x"), ("b.txt", "one, two\nx"), ("c.json", '{"skillTags"'), ("d.json", ' {"user": 1, "repos"'), ("e.PDF", None), ("f.md", "[x, y"), ("g.bin", "x"), ("h.json", '{"a": 1}')]
    got = spark.createDataFrame(rows, "path string, text string").select("path", files.kind_of(F.col("path"), F.col("text")).alias("k")).collect()
    assert {r["path"]: r["k"] for r in got} == {
        "a.csv": "csv_recruiter", "b.txt": "csv_recruiter", "c.json": None, "d.json": "github", "e.PDF": "resume", "f.md": "notes", "g.bin": None, "h.json": None,
    } | {"c.json": "ats_json"}


def test_answers_of_a_client_are_kept(spark, tmp_path):
    (tmp_path / "n.txt").write_text("Name: Ann Lee\nann@x.io leads things")
    claims = files.claims_of(spark, [str(tmp_path / "n.txt")])
    profiles = engine.build_profiles(claims)
    context = enrich.contexts(profiles, claims, files.prose_of(files.read_files(spark, [str(tmp_path / "n.txt")])))
    cache = str(tmp_path / "cache")
    assert enrich.run(profiles, context, cache, "m").first()["headline"] is None
    client = lambda prompt: '{"headline": "Lead", "experience": []}' if "leads" in prompt else "no"
    assert enrich.run(profiles, context, cache, "m", client=client).first()["headline"] == "Lead"
    # later runs need no client, other models have other answers
    assert enrich.run(profiles, context, cache, "m").first()["headline"] == "Lead"
    assert enrich.run(profiles, context, cache, "other").first()["headline"] is None


def test_the_first_answer_to_a_key_holds(spark, tmp_path):
    cache = str(tmp_path / "cache")
    row = lambda *pairs: spark.createDataFrame(list(pairs), "key string, answer string")
    row(("a", "old")).write.parquet(cache)  # as written before runs were told apart
    enrich.put(row(("a", "x"), ("b", "first"), (None, "z")), cache)
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda n: enrich.put(row(("b", f"later{n}"), ("c", f"both{n}")), cache), range(2)))
    first = sorted(tuple(r) for r in enrich.read_cache(spark, cache).collect())
    assert [k for k, _ in first] == ["a", "b", "c"] and first[:2] == [("a", "old"), ("b", "first")]
    enrich.put(row(("c", "latest")), cache)
    assert sorted(tuple(r) for r in enrich.read_cache(spark, cache).collect()) == first


def test_clients_have_names():
    assert enrich.client_named("json:dumps") is json.dumps
    with pytest.raises(ValueError, match="module:function"):
        enrich.client_named("json")


def test_lines_are_written_one_by_one(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\nc-2,Bob Roy\nc-1,Ann Lee\n")
    profiles = engine.profiles_of_files(spark, [str(tmp_path / "a.csv")])
    render.write_lines(profiles, default_config(), str(tmp_path / "out" / "p.ndjson"))
    assert (tmp_path / "out" / "p.ndjson").read_text() == render.render_ndjson(profiles, default_config())

"""Names in order against their sequence by brute force; attribution by hot identifiers."""

import random

import pytest

from claimloom.operators import link
from claimloom.operators.reserve import in_order
from tests.test_engine import claims


def sequence(ties, ids, stale):
    root = {c: c for c, _ in ties}
    held = {c: {i for k, i in ids if k == c and i is not None} for c in root}

    def find(c):
        return c if root[c] == c else find(root[c])

    by_name = {}
    for c, n in ties:
        by_name.setdefault(n, set()).add(c)
    for name in sorted(by_name):
        roots = {find(c) for c in by_name[name]}
        met = set().union(*(held[r] for r in (roots & by_name[name] if stale else roots)))
        if len(roots) > 1 and len(met) < 2:
            least = min(roots)
            for r in roots - {least}:
                root[r] = least
                held[least] |= held.pop(r)
    return {c: find(c) for c in root}


@pytest.mark.parametrize("stale", [False, True])
@pytest.mark.parametrize("most", [2, 4])
def test_reservations_equal_the_sequence(spark, stale, most):
    draw = random.Random(most * 2 + stale)
    ties, ids = [], []
    for g in range(60):
        own = [f"g{g:02}c{draw.randrange(10**6):06}" for _ in range(draw.randrange(2, 9))]
        for k in range(draw.randrange(1, 9)):
            name = f"{draw.choice('abcdef')}-{g}-{k}"
            ties += [(c, name) for c in draw.sample(own, min(len(own), draw.randrange(1, most + 1)))]
        ids += [(c, draw.choice("xyz")) for c in own for _ in range(draw.choice((0, 0, 1, 1, 2) if stale else (0, 0, 0, 1)))]
    ids += [(ties[0][0], None), *ids[:3]]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    found = in_order(frame(ties + ties[:5], "cluster string, name string"), frame(ids, "cluster string, id string"), stale).collect()
    assert {r["cluster"]: r["merged"] for r in found} == sequence(ties, ids, stale)
    assert len(found) == len({c for c, _ in ties})


def test_chain_needs_few_rounds_and_no_names_give_nothing(spark, monkeypatch):
    from claimloom.operators import reserve

    rounds = []
    decided = reserve._decided
    monkeypatch.setattr(reserve, "_decided", lambda *a: rounds.append(1) or decided(*a))
    n = 64
    ties = [(f"c{k:03}", f"n{e:03}") for k in range(n) for e in (k, k + 1)]
    ids = [(f"c{k:03}", f"i{k}") for k in range(0, n, 16)]
    found = in_order(spark.createDataFrame(ties, "cluster string, name string"), spark.createDataFrame(ids, "cluster string, id string")).collect()
    assert {r["cluster"]: r["merged"] for r in found} == sequence(ties, ids, False)
    assert len(rounds) <= 7
    none = spark.createDataFrame([], "cluster string, name string")
    assert in_order(none, spark.createDataFrame([], "cluster string, id string")).collect() == []


def test_groups_are_told_apart_only_where_three_clusters_share_a_name(spark, monkeypatch):
    calls = []
    found = link.components
    monkeypatch.setattr(link, "components", lambda *a: calls.append(1) or found(*a))
    draw = random.Random(3)
    recs = []
    for g in range(12):
        order = draw.sample(range(100), 11)
        for k in range(10):
            recs.append((f"g{g:02}c{draw.randrange(100):02}-{k}", [f"n{g:02} {order[k]:02}", f"n{g:02} {order[k + 1]:02}"], [f"i{g}-{k}"] if g % 3 and k % (g + 1) == 0 else []))
    for more, times in (([], 0), ([(f"z{k}", ["of three"], []) for k in range(3)], 1)):
        rows = recs + more
        table = spark.createDataFrame(rows, "rid string, names array<string>, candidate_ids array<string>")
        got = link.attach_by_name(table, table.selectExpr("rid", "rid AS cluster")).collect()
        ids = [(rid, i) for rid, _, own in rows for i in own]
        want = sequence([(rid, name) for rid, names, _ in rows for name in names], ids, False)
        assert {r["rid"]: r["cluster"] for r in got} == want
        assert len(calls) == times


def test_hot_identifiers_are_joined_in_cells(spark):
    rows = []
    for k in range(40):
        rows.append(("csv_recruiter", f"r{k}", "full_name", "Sam Lee" if k % 4 else f"Own {k}", 0.9))
        rows.append(("notes", f"r{k}", "emails", f"a{k % 7}@x.org", 0.9))
    profiles = spark.createDataFrame(
        [(f"p{k}", [f"a{k % 9}@x.org"], ["+1", None] if k else None, "sam  lee" if k % 3 else None) for k in range(30)],
        "candidate_id string, emails array<string>, phones array<string>, full_name string",
    ).fillna({}).selectExpr("candidate_id", "emails", "coalesce(phones, array()) AS phones", "full_name")
    whole = {tuple(r) for r in link.attribute_sources(profiles, claims(spark, *rows)).collect()}
    cells = [tuple(r) for r in link.attribute_sources(profiles, claims(spark, *rows), cell_rows=4).collect()]
    assert len(cells) == len(set(cells))
    assert set(cells) == whole
    assert ("p1", "csv_recruiter", "r1") in whole and ("p8", "notes", "r8") not in whole
    assert link.attribute_sources(profiles.where("false"), claims(spark, *rows)).collect() == []

import random

from leadloom.functions import tables
from leadloom.operators import leads as L
from leadloom.operators import tuning as U
from pyspark.sql import functions as F


def in_turn(rows, target):
    out, seen = [], {}
    for g, at, ok in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if seen.get(g, 0) < target:
            out.append((g, at, ok))
        seen[g] = seen.get(g, 0) + bool(ok)
    return sorted(out, key=repr)


def test_a_batch_of_most_rows_spreads_and_stops_at_its_target(spark, monkeypatch):
    """Two thirds of the rows are one batch; the rest of it beyond the target is left out by ranges."""
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 1, 2, None]), k, rnd.choice([True, False, None])) for k in range(3000)]
    parts = []
    monkeypatch.setattr(tables, "cut", lambda df, name="part", cut=tables.cut: parts.append(t := cut(df, name)) or t)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small ranges become one
    for target in (0, 1, 40, 700, 5000):
        parts.clear()
        got = L.until_target(spark.createDataFrame(rows, "g int, at int, ok boolean").repartition(3), "g", ["at"], "ok", target)
        assert sorted(map(tuple, got.collect()), key=repr) == in_turn(rows, target)
        most = parts[0].where("g = 1").groupBy("__range").count().agg(F.max("count")).first()[0]
        assert most <= 0.6 * sum(r[0] == 1 for r in rows)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_configuration(versions, events):
    out = {}
    for v in versions:
        last = {}
        for f, kind, event, i, n, everywhere, at, k in events:
            if everywhere or (i, n) == v:
                last[f] = max(last.get(f, (-1, -1)), (at, k, kind, event))
        out[v] = sorted((t[2], f) for f, t in last.items() if t[3] == "APPLIED")
    return out


def test_configurations_are_shared_rows_and_departures(spark, monkeypatch):
    """Kinds that change, ties, versions without events, pages smaller than what is shared; no product in the plan."""
    monkeypatch.setattr(U, "PAGE", 3)
    rnd = random.Random(7)
    events = [(f"f{rnd.randrange(25)}", rnd.choice(U.KINDS), rnd.choice(["APPLIED", "APPLIED", "ROLLED_BACK"]), rnd.randrange(4), rnd.randrange(3), rnd.choice([True, False, False, None]), rnd.randrange(20), k) for k in range(300)]
    versions = [(i, n) for i in range(5) for n in range(3)]
    e = spark.createDataFrame(events, "fingerprint string, kind string, event string, icp_id int, icp_version int, is_global boolean, at int, id int")
    v = spark.createDataFrame([*versions, versions[0]], "icp_id int, icp_version int")
    want = plain_configuration(versions, events)
    got = U.effective_configuration(v, e)
    rows = got.collect()
    assert len(rows) == len(versions)
    for r in rows:
        assert sorted((k, f) for k in U.KINDS for f in r[k.lower()]) == want[r.icp_id, r.icp_version] and r.is_default == (not want[r.icp_id, r.icp_version])
    state = U.configuration_state(v, e).collect()
    shared = {(r.kind, r.fingerprint) for r in state if r.effect == "SHARED"}
    for x in versions:
        own = {r.effect: set() for r in state} | {"ADDED": set(), "REMOVED": set()}
        for r in state:
            if (r.icp_id, r.icp_version) == x:
                own[r.effect].add((r.kind, r.fingerprint))
        assert own["REMOVED"] <= shared and sorted((shared - own["REMOVED"]) | own["ADDED"]) == want[x]
    for df in (got, U.configuration_state(v, e)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = U.effective_configuration(v, e.limit(0)).collect()
    assert len(none) == len(versions) and all(r.is_default for r in none)


def test_histories_shuffle_once_and_the_latest_row_decides(spark):
    from leadloom.operators import assembly as Y

    rnd = random.Random(4)
    rows = [(rnd.choice(["i", "j"]), rnd.randrange(4), rnd.choice([1, None]), rnd.randrange(5), k, f"v{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "icp_id string, company_id int, person_id int, at int, id int, value string")
    made = Y.tagged({"one": (df.where("id % 2 = 0"), ["icp_id", "company_id", "person_id"], {"value": "a", "id": "one_id"}), "two": (df.where("id % 2 = 1"), ["icp_id", "company_id", "person_id"], {"value": "b"}), "three": (df, ["company_id"], {"value": "c"})})
    assert made._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") + made._jdf.queryExecution().sparkPlan().toString().count("ObjectHashAggregate") + made._jdf.queryExecution().sparkPlan().toString().count("SortAggregate") >= 1
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {}
    for i, company, p, at, k, v in rows:
        for name, key in (("one" if k % 2 == 0 else "two", ("icp_id,company_id,person_id", i, str(company), p if p is None else str(p))), ("three", ("company_id", str(company), None, None))):
            want[name, key] = max(want.get((name, key), (-1, -1, "")), (at, k, v))
    got = {}
    for r in made.collect():
        for name, value in (("one", r.one and r.one.a), ("two", r.two and r.two.b), ("three", r.three and r.three.c)):
            if value is not None:
                got[name, (r.scope, r.k0, r.k1, r.k2)] = value
    assert got == {k: v[2] for k, v in want.items()}

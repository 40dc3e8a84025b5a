import itertools
import json
import random

from folioscope.operators import schema_drift as D


def test_manifest_shapes():
    shapes = [
        '{"a":"STRING","t":{"type":"Array","columns":{"Qty":"qty"}}}',
        '[{"name":"a","type":"string"},{"name":"t","type":"array","columns":{"Qty":"qty"}}]',
        '{"fields":[{"name":"a","type":"String"},{"name":"t","type":"array","columns":[{"label":"Qty","key":"qty"}]}]}',
    ]
    for s in shapes:
        assert D.manifest_fields(s) == [("a", "string", ""), ("t", "array", ""), ("t.qty", "", "Qty")]
    assert D.manifest_fields('{"a":"str') is None and D.manifest_fields("3") is None and D.manifest_fields(None) is None


def test_assignment_is_best():
    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        gain = [[rng.choice([0.0, rng.random() * 3]) for _ in range(m)] for _ in range(n)]
        got = sum(gain[i][j] for i, j in D.assign(gain))
        k = max(n, m)
        best = max(sum(gain[i][p[i]] for i in range(n) if p[i] < m) for p in itertools.permutations(range(k), n))
        assert abs(got - best) < 1e-9
    assert D.assign([]) == []


def test_names():
    assert D.name_similarity("account_number", "accountNumber") == 1.0
    assert D.name_similarity("items.amount", "items.amt") > 0.6 > D.name_similarity("revenue", "turnover")
    assert D.name_similarity("currency", "curr") > D.name_similarity("currency", "cost_center")


def frames(spark, manifests, records):
    m = spark.createDataFrame(manifests, "manifest_id long, layout_id string, manifest_no int, schema_json string")
    r = spark.createDataFrame(records, "record_id long, layout_id string, file_no int, fields_json string, kind string")
    return m, r


def test_changes(spark):
    rng = random.Random(1)
    person = lambda: rng.choice(["Ann Lee", "Bo Ray", "Cy Fox"])
    recs, i = [], 0
    for layout in range(6):
        for no in (1, 2, 4):
            for _ in range(6):
                i += 1
                rec = {"total" if no == 1 else "grand_total": round(rng.random() * 900, 2), "name": person(), "items": [{"qty" if no < 4 else "units": rng.randint(1, 9), "note": None}]}
                if no == 4:
                    rec["paid"] = True
                    rec["name"] = [rec["name"]]
                recs.append((i, f"L{layout}", no, json.dumps(rec), "x"))
    recs += [recs[0], (900, "L0", 1, '{"cut', None), (901, "L0", None, "{}", None), (902, None, 1, "{}", None), (903, "L0", 2, None, None)]
    mans = [(1, "A", 1, '{"a":"string","date":"date"}'), (2, "A", 3, '{"a":"NUMBER","dated":"date","t":{"type":"array","columns":{"Q":"q"}}}'), (2, "A", 3, '{"a":"NUMBER","dated":"date","t":{"type":"array","columns":{"Q":"q"}}}'),
            (3, "A", 4, '[{"name":"a","type":"number"},{"name":"dated","type":"date"},{"name":"t","type":"array","columns":{"Q":"qq"}}]'), (4, "B", 1, '{"z":"string"}'), (5, "B", 2, "oops"), (6, None, 1, "{}")]
    out = D.changes(*frames(spark, mans, recs)).collect()
    got = sorted((r.src, r.layout_id, r.seq_no, r.field_name, r.was_name, r.change_kind) for r in out)
    want = [("manifest", "A", 3, "a", "", "retyped"), ("manifest", "A", 3, "dated", "date", "renamed"), ("manifest", "A", 3, "t", "", "added"), ("manifest", "A", 3, "t.q", "", "added"), ("manifest", "A", 4, "t.qq", "t.q", "renamed")]
    for layout in range(6):
        want += [("record", f"L{layout}", 2, "grand_total", "total", "renamed"), ("record", f"L{layout}", 4, "items.units", "items.qty", "renamed"), ("record", f"L{layout}", 4, "name", "", "retyped"), ("record", f"L{layout}", 4, "paid", "", "added")]
    assert got == sorted(want)
    m, r = frames(spark, mans, recs)
    unified = {u.record_id: u.fields for u in D.unify(r, D.changes(m, r)).collect()}
    assert "grand_total" in unified[1] and "total" not in unified[1] and unified[900] is None and len(unified) == 112


def test_empty(spark):
    m, r = frames(spark, [], [])
    assert D.changes(m, r).count() == 0
    assert D.unify(r, D.changes(m, r)).count() == 0


def test_odd_values(spark):
    recs = [(1, "L", 1, '{"a":1e999,"b":"\\ud800","c":true,"d":[[{"e":1}],2],"f":{}}', None), (2, "L", 2, '{"a":' + "9" * 500 + ',"b":"","g":{"h":{"i":0}}}', None)]
    m, r = frames(spark, [], recs)
    got = sorted((x.field_name, x.change_kind) for x in D.changes(m, r).collect())
    assert ("d.e", "removed") in got and ("g.h.i", "added") in got and ("f", "removed") in got


def test_unify_renames_at_every_depth_and_by_file(spark):
    steps = [("record", "L", 2, "grand", "total", "renamed"), ("record", "L", 3, "items.amt", "items.amount", "renamed"), ("record", "L", 4, "lines", "items", "renamed"),
             ("record", "L", 4, "lines.tax.pct", "items.tax.rate", "renamed"), ("record", "L", 5, "lines.tax.percent", "lines.tax.pct", "renamed"),
             ("record", "L", 6, "rows", "lines", "renamed"), ("record", "L", 3, "total", "", "added")]
    texts = [(1, 1, '{"total":1.50,"items":[{"amount":1.25,"tax":[{"rate":7}]},[{"amount":2}]],"x":{"amount":1}}'), (2, 2, '{"total":"again","grand":2,"items":{"amount":3}}'),
             (3, 1, '{"total":1,"grand":2}'), (4, 1, '{"total":1,"grand":null,"items":[{"amount":1,"amt":2},{"amount":null,"amt":3}]}'), (5, 4, '{"items":[{"amount":1}],"total":1}')]
    records = spark.createDataFrame([(i, "L", no, text) for i, no, text in texts], "record_id long, layout_id string, file_no int, fields_json string")
    found = spark.createDataFrame(steps, "src string, layout_id string, seq_no int, field_name string, was_name string, change_kind string")
    got = {r.record_id: r.fields for r in D.unify(records, found).collect()}
    assert got[1] == {"grand": got[1]["grand"], "rows": '[{"amt":1.25,"tax":[{"percent":7}]},[{"amt":2}]]', "x": '{"amount":1}'}
    assert got[2] == {"total": "again", "grand": "2", "rows": '{"amt":3}'}
    assert got[3] == {"total": "1", "grand": "2"}
    assert got[4] == {"grand": "1", "rows": '[{"amount":1,"amt":2},{"amt":3}]'}
    assert got[5] == {"items": '[{"amount":1}]', "total": "1"}


def books(spark, rows, steps):
    records = spark.createDataFrame(rows, "record_id long, layout_id string, file_no int, fields_json string")
    found = spark.createDataFrame(steps, "src string, layout_id string, seq_no int, field_name string, was_name string, change_kind string")
    unified = D.unify(records, found)
    return {r.record_id: r.fields for r in unified.collect()}, {r.record_id: (r.n_in, r.n_out, r.same) for r in D.account(records, unified).collect()}


def test_name_that_comes_back(spark):
    """A became B in file 2, and file 5 has a new A: both keep their values."""
    rows = [(1, "L", 1, '{"A":"1"}'), (2, "L", 2, '{"B":"2"}'), (3, "L", 5, '{"A":"new thing","B":"2"}'), (4, "L", 1, '{"A":"1","B":"x","t":[{"q":1.25}]}'), (5, "L", 1, '{"cut'), (6, "L", None, "{}")]
    fields, book = books(spark, rows, [("record", "L", 2, "B", "A", "renamed"), ("record", "L", 5, "A", "", "added")])
    assert fields[1] == {"B": "1"} and fields[3] == {"A": "new thing", "B": "2"} and fields[4] == {"A": "1", "B": "x", "t": '[{"q":1.25}]'} and fields[5] is None
    assert book == {1: (1, 1, True), 2: (1, 1, True), 3: (2, 2, True), 4: (3, 3, True), 6: (0, 0, True)}


def test_files_in_parts(spark, monkeypatch):
    rows = [(i, "L", 1 + i // 50, '{"a":%d,"b":[{"c":"x%d"}]%s}' % (i, i, ',"d":true' if i >= 50 else ""), None) for i in range(100)]
    _, r = frames(spark, [], rows + rows[:20])

    def told(df):
        return sorted((x.seq_no, x.field, sorted(map(tuple, x.kinds)), sorted(map(tuple, x.sketch))) for x in df.collect())

    whole = told(D.profile_records(r))
    monkeypatch.setattr(D, "RECORDS_A_TASK", 7)
    assert told(D.profile_records(r)) == whole
    assert [(no, f, k) for no, f, k, _ in whole] == [(1, "a", [("number", 50)]), (1, "b", [("array", 50)]), (1, "b.c", [("string", 50)]), (2, "a", [("number", 50)]), (2, "b", [("array", 50)]), (2, "b.c", [("string", 50)]), (2, "d", [("boolean", 50)])]


def test_one_schema(spark):
    fields = spark.createDataFrame(
        [("record", "L", 1, "total", "string"), ("record", "L", 1, "items", "array"), ("record", "L", 1, "items.qty", "number"), ("record", "L", 3, "grand", "number"), ("record", "L", 3, "items", "array"), ("record", "L", 3, "items.units", "number"),
         ("manifest", "L", 1, "total", "number"), ("record", "L", 1, "x", "array"), ("record", "L", 3, "x", "string")],
        "src string, layout_id string, seq_no int, field string, kind string",
    )
    steps = [("record", "L", 3, "grand", "total", "renamed"), ("record", "L", 3, "items.units", "items.qty", "renamed")]
    found = spark.createDataFrame(steps, "src string, layout_id string, seq_no int, field_name string, was_name string, change_kind string")
    got = {(r.src, r.field_name): (r.kind, r.first_no, r.last_no, r.is_current) for r in D.unified_schema(fields, found).collect()}
    assert got == {("record", "grand"): ("string", 1, 3, True), ("record", "items"): ("array", 1, 3, True), ("record", "items.units"): ("number", 1, 3, True), ("record", "x"): ("variant", 1, 3, True), ("manifest", "total"): ("number", 1, 1, True)}

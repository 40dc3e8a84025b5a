import json

from pyspark.sql import functions as F

from folioscope.operators import nested
from folioscope.plans import records as records_plan
from folioscope.session import table


def read(spark, rows, values=False):
    df = spark.createDataFrame(rows, "src string, ref_id long, fields_json string, state string")
    return nested.read_objects(df, values)


def paths(objects):
    return sorted((r.src, r.ref_id, r.node_path) for r in nested.elements(objects).collect())


def expected(records):
    """The definition, written out plainly: two passes over parsed records."""
    loaded, fields = [], set()

    def as_array(v):
        if isinstance(v, str) and v.lstrip()[:1] == "[":
            try:
                x = json.loads(v)
                return x if isinstance(x, list) else None
            except ValueError:
                return None
        return v if isinstance(v, list) else None

    def note(src, v, field):
        a = as_array(v)
        if a is not None:
            fields.add((src, field))
            for x in a:
                note(src, x, field)
        elif isinstance(v, dict):
            for k, x in v.items():
                note(src, x, f"{field}.{k}" if field else k)

    for src, ref, text in {(s, r): (s, r, t) for s, r, t in records}.values():
        try:
            v = json.loads(text)
        except (ValueError, TypeError):
            continue
        loaded.append((src, ref, v))
        note(src, v, "")
    out = []

    def walk(src, ref, v, path, field):
        a = as_array(v)
        if a is not None:
            for i, x in enumerate(a):
                if isinstance(x, dict):
                    out.append((src, ref, f"{path}[{i}]"))
                walk(src, ref, x, f"{path}[{i}]", field)
        elif isinstance(v, dict):
            for k, x in v.items():
                sub, sub_field = (f"{path}.{k}" if path else k), (f"{field}.{k}" if field else k)
                if isinstance(x, dict) and (src, sub_field) in fields:
                    sub += "[0]"
                    out.append((src, ref, sub))
                walk(src, ref, x, sub, sub_field)

    for src, ref, v in loaded:
        walk(src, ref, v, "", "")
    return sorted(out)


def test_forms(spark):
    rows = [
        ("r", 1, '{"a":[{"b":[{}, null, {"c":1}]}, [ {"d":[[{"e":0}]]} ]], "t":{"n":1}}', "x"),
        ("r", 2, '{"a":{"b":{"c":2}}, "s":"[{\\"q\\":[{}]}]", "u.v":[{"w":{}}]}', "x"),
        ("r", 2, '{"a":{"b":{"c":2}}, "s":"[{\\"q\\":[{}]}]", "u.v":[{"w":{}}]}', "x"),
        ("r", 3, '{"s":{"q":{}}, "t":{"a":[{}]}, "x":"[not json"}', None),
        ("e", 4, '{"a":{"b":1}}', None), ("r", 5, '{"cut":[{"a":1', None), ("r", 6, None, None), ("r", None, "{}", None), ("r", 7, '[{"z":{}}]', None),
    ]
    got = paths(read(spark, rows))
    assert got == expected([r[:3] for r in rows if r[1] is not None])
    assert ("r", 2, "a[0].b[0]") in got and ("r", 3, "s[0].q[0]") in got and ("e", 4, "a[0]") not in got and ("r", 7, "[0]") in got


def test_whole_tables(spark, sf):
    records = nested.json_records(table(spark, sf, "extracted_records"), table(spark, sf, "batch_entries"))
    plain = [(r.src, r.ref_id, r.fields_json) for r in records.collect()]
    assert paths(nested.read_objects(records, False)) == expected(plain)


def test_odd_json(spark):
    deep = '{"a":' * 600 + "[{}]" + "}" * 600
    rows = [("r", 1, deep, None), ("r", 2, '{"k\\ud800":[{"v":"\\ud800"}]}', None), ("r", 3, '{"n":[{"x":1e999,"y":123456789012345678901234567890}]}', None), ("r", 4, "[" * 100_000, None)]
    got = paths(read(spark, rows, values=True))
    assert len(got) == 3 and {r[1] for r in got} == {1, 2, 3}


def test_nothing_lost(spark):
    rows = [("r", 1, '{"items":[{"q":1,"p":"x","tags":["a","b"],"sub":[{"z":true}]},{"q":"many","n":null,"more":2.5}],"total":{"net":1}}', None)]
    objects = read(spark, rows, values=True)
    flat = nested.flat_table(objects, "r", "items", {"q": "bigint", "p": "string"}).orderBy("node_path").collect()
    assert [(r.q, r.p, r.parent_path) for r in flat] == [(1, "x", ""), (None, None, "")]
    assert flat[0].rest == {"tags": '["a", "b"]'} and flat[1].rest == {"q": '"many"', "more": "2.5"}
    up = {r.field: r for r in nested.supertypes(objects).collect()}
    assert up["items"].common_keys == ["q"] and up["items"].n_variants == 2
    links = {r.node_path: r.parent_path for r in objects.collect()}
    assert links == {"": None, "items[0]": "", "items[1]": "", "items[0].sub[0]": "items[0]", "total": ""}
    one = nested.variants(objects).where("field = 'items'").orderBy("state").first()
    assert nested.flat_table(objects, "r", "items", {"q": "string"}, one.state).count() == one.n


def test_empty(spark):
    assert read(spark, []).count() == 0
    assert nested.supertypes(read(spark, [], True)).count() == 0


def test_states_follow_shape(spark):
    rows = [("r", i, t, None) for i, t in enumerate(['{"a":1,"b":"x"}', '{"b":"y","a":2.5}', '{"a":"1","b":"x"}', '{"a":1}'])]
    s = {r.ref_id: r.state for r in read(spark, rows).where(F.col("node_path") == "").collect()}
    assert s[0] == s[1] and len(set(s.values())) == 3


def test_states_follow_children(spark):
    """Same keys on top, another shape two levels down, behind objects and arrays."""
    texts = ['{"a":{"b":{"c":1}},"i":[{"t":[{"x":1}]}]}', '{"a":{"b":{"c":"1"}},"i":[{"t":[{"x":1}]}]}', '{"a":{"b":{"c":2}},"i":[{"t":[{"y":1}]}]}', '{"a":{"b":{"c":3}},"i":[{"t":[{"x":2}]},{"t":[{"x":3},{"x":4}]}]}']
    objects = read(spark, [("r", i, t, None) for i, t in enumerate(texts)], values=True)
    s = {r.ref_id: r.state for r in objects.where("node_path = ''").collect()}
    assert s[0] == s[3] and len(set(s.values())) == 3
    v = {(r.field, tuple(r.keys)): r.n for r in nested.variants(objects).where("field = ''").collect()}
    assert set(v) == {("", ("a", "i"))}
    up = {r.field: r for r in nested.supertypes(objects).collect()}
    assert up[""].n == 4 and up[""].n_variants == 3 and up[""].common_keys == up[""].all_keys == ["a", "i"]
    assert up["i.t"].common_keys == [] and up["i.t"].all_keys == ["x", "y"]


def test_flat_tables_hold_all_values(spark):
    text = '{"a":[1,{"b":null},[{"c":"x"},2]],"g":[[1,2],[]],"e":[],"o":[[{"k":true}]],"t":{"u":{"v":0.5}}}'
    objects = read(spark, [("r", 1, text, None)], values=True)
    got = {r.node_path: {k: json.loads(v) for k, v in r.vals.items()} for r in nested.flat_tables(objects).collect()}
    assert got == {
        "": {"a": [1, {}, [{}, 2]], "g": [[1, 2], []], "e": []}, "a[1]": {"b": None}, "a[2][0]": {"c": "x"},
        "o[0][0]": {"k": True}, "t": {}, "t.u": {"v": 0.5},
    }


def test_flat_tables_of_whole_tables(spark, sf):
    """As many scalars of every field come out as there are in the JSON of both sources."""
    def scalars(v, field, out):
        if isinstance(v, str) and v.lstrip()[:1] == "[":
            try:
                v = json.loads(v)
            except ValueError:
                pass
        if isinstance(v, dict):
            for k, x in v.items():
                scalars(x, f"{field}.{k}" if field else k, out)
        elif isinstance(v, list):
            for x in v:
                scalars(x, field, out)
        else:
            out[field] = out.get(field, 0) + 1

    want, got = {}, {}
    records = nested.json_records(table(spark, sf, "extracted_records"), table(spark, sf, "batch_entries"))
    for text in {(r.src, r.ref_id): r.fields_json for r in records.collect()}.values():
        try:
            v = json.loads(text)
        except (ValueError, TypeError):
            continue
        scalars(v, "", want)
    for r in records_plan.p4_tables(spark, sf).collect():
        for k, v in r.vals.items():
            scalars(json.loads(v), f"{r.field}.{k}" if r.field else k, got)
    assert got == want and len(got) > 50


def test_rebuilt_records(spark):
    texts = [
        '{"rows":[[1,2],[3,4]],"m":[7,{"a":1},"x"]}', '{"a":[{"b":[{},null,{"c":1}]},[{"d":[[{"e":0}]]}]],"t":{"n":1}}', '{"s":"[{\\"q\\":[{}]}]","u.v":[{"w":{}}],"k[0]":{"z":[]}}',
        '{"a":{"b":{"c":2}},"x":"[not json","n":null,"e":[],"f":[[],[{}]],"big":123456789012345678901234567890,"small":1e-400}', '[{"z":{}},5,"[1]"]', '[{"z":1}]', "7", '"text"', "{}", "null",
        '{"a":["[{\\"q\\":1}]",2]}', '{"a":{"":[{"":1}]}}',
    ]
    rows = [("r", i, t, None) for i, t in enumerate(texts)] + [("r", 90, '{"cut', None), ("r", 91, None, None), ("r", None, "{}", None), ("r", 0, texts[0], None)]
    df = spark.createDataFrame(rows, "src string, ref_id long, fields_json string, state string")
    got = {r.ref_id: r.same for r in nested.compare_rebuilt(df, nested.read_objects(df)).collect()}
    assert got == dict.fromkeys(range(len(texts)), True)
    assert nested.compare_rebuilt(df.limit(0), nested.read_objects(df.limit(0))).count() == 0


def test_array_fields_too_many_to_broadcast(spark, monkeypatch):
    rows = [("r", i, '{"a":{"b":{"c":2}}}' if i % 2 else '{"a":[{"b":1},{"b":[{}]}]}', None) for i in range(40)]
    small = paths(read(spark, rows))
    monkeypatch.setattr(nested, "BROADCAST_FIELDS", 0)
    assert paths(read(spark, rows)) == small == expected([r[:3] for r in rows])


def test_typed_values(spark):
    objects = read(spark, [("r", 1, '{"a":"x\\n","b":1.5,"c":true,"d":null,"e":[1,{"f":"y"}],"g":1e999}', None)], values=True)
    got = {(r.node_path, r.key): (r.kind, r.text, r.number, r.flag) for r in nested.typed_values(objects).collect()}
    assert got[("", "a")] == ("string", "x\n", None, None) and got[("", "b")] == ("number", None, 1.5, None) and got[("", "c")] == ("boolean", None, None, True)
    assert got[("", "d")][0] == "null" and got[("", "e")] == ("array", "[1, {}]", None, None) and got[("e[1]", "f")] == ("string", "y", None, None)

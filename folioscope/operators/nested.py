"""Problem 4: deeply nested records as related flat tables.

A bottom-up tree automaton reads every JSON value: scalars have a leaf state, an array the set of
its elements' states, an object the state of its sorted ``key:child state`` pairs. Objects of one
field path and state form a structural variant. Each variant is routed to a typed subtype table;
the keys that all variants of a path share make up its supertype table. Every object keeps its own
path and that of its parent, so nothing is lost and rows can be joined back. States follow the JSON as
written: an object alone in a field has another state than an array that holds it.

An object alone in a field that elsewhere holds an array is that array's element 0. Which fields
do is known only after all rows were read, so paths leave the one pass over the JSON with an open
mark for each such object, and the marks are resolved against the set of array fields.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import materialize

OPEN = "\x01"
#: Array fields of all sources up to which they are broadcast, and tasks that marked objects are spread over beyond it.
BROADCAST_FIELDS, SALTS = 200_000, 64
#: Frames for the walk; JSON nested deeper than the parser allows is unreadable anyway.
DEEPEST = 100_000
#: Objects gathered before a batch goes out.
OBJECTS = 50_000
_LEAF = {str: "s", int: "n", float: "n", bool: "b", type(None): "0"}


class Walker:
    """Reads records and gathers their objects: lists of columns, flushed by the caller."""

    def __init__(self, values: bool, keys: bool):
        self.values, self.with_keys = values, keys
        self.states: dict[tuple, str] = {}
        self.keys_of: dict[str, list[str]] = {}
        self.arrays: set[tuple[str, str]] = set()
        self.src = ""
        self.reset()

    def reset(self) -> None:
        self.path, self.parent, self.field, self.state, self.lone, self.deps = [], [], [], [], [], []
        self.keys, self.vals, self.at = [], [], []

    def name_of(self, shape: tuple) -> str:
        name = self.states.get(shape)
        if name is None:
            name = self.states[shape] = hashlib.md5(repr(shape).encode()).hexdigest()[:16]
        return name

    def record(self, at: int, text: str) -> None:
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return
        if type(value) is dict:
            self.object(at, value, "", None, "", False, None)
        else:
            self.other(at, value)

    def other(self, at: int, value) -> None:
        """A record that is no object has a row all the same, with its value under a key that no object has."""
        slot = len(self.path)
        for column, x in zip((self.at, self.path, self.parent, self.field, self.lone, self.deps, self.state), (at, "", None, "", False, None, None)):
            column.append(x)
        self.keys.append([OPEN] if self.with_keys else None)
        whole = type(value) is list and value and _only_objects(value)
        self.vals.append([] if whole else [(OPEN, json.dumps(_hollow(value)))])
        kind = self.array(at, value, "", "", "", None) if type(value) is list else _LEAF[type(value)]
        self.state[slot] = self.name_of((OPEN, kind))
        if not self.values:
            self.vals[slot] = None

    def object(self, at: int, obj: dict, path: str, parent: str | None, field: str, lone: bool, deps: list | None) -> str:
        slot = len(self.path)
        self.at.append(at)
        self.path.append(path)
        self.parent.append(parent)
        self.field.append(field)
        self.lone.append(lone)
        self.deps.append(deps)
        self.state.append(None)
        kept = {} if self.values else None
        self.keys.append(None)
        self.vals.append(None)
        shape = []
        for key, v in obj.items():
            if not key.isascii() or OPEN in key:
                key = _clean(key)
            kind = _LEAF.get(type(v))
            if kind == "s" and v[:1] in "[ \n\t" and v:
                inner = _array_in(v)
                if inner is not None:
                    v, kind = inner, None
            if kind is not None:
                shape.append((key, kind))
                if kept is not None:
                    kept[key] = json.dumps(v)
                continue
            sub, sub_field = (f"{path}.{key}", f"{field}.{key}") if path else (key, f"{field}.{key}" if field else key)
            if type(v) is list:
                shape.append((key, self.array(at, v, sub, path, sub_field, deps)))
                if kept is not None and not (v and _only_objects(v)):
                    kept[key] = json.dumps(_hollow(v))
            else:
                shape.append((key, self.object(at, v, sub + OPEN, path, sub_field, True, [*(deps or ()), sub_field])))
        shape.sort()
        state = self.state[slot] = self.name_of(tuple(shape))
        if kept is not None:
            self.vals[slot] = list(kept.items())
        if self.with_keys:
            keys = self.keys_of.get(state)
            if keys is None:
                keys = self.keys_of[state] = sorted({key for key, _ in shape})
            self.keys[slot] = keys
        return state

    def array(self, at: int, items: list, path: str, parent: str, field: str, deps: list | None) -> str:
        self.arrays.add((self.src, field))
        states = set()
        for i, v in enumerate(items):
            if type(v) is dict:
                states.add(self.object(at, v, f"{path}[{i}]", parent, field, False, deps))
                continue
            if type(v) is str and v[:1] in "[ \n\t" and v:
                v = _array_in(v) or v
            if type(v) is list:
                states.add(self.array(at, v, f"{path}[{i}]", parent, field, deps))
            else:
                states.add(_LEAF[type(v)])
        return self.name_of(("[", *sorted(states)))


def _only_objects(items: list) -> bool:
    """Whether the array can be built again from the paths of its objects."""
    return all(type(x) is dict or (type(x) is list and x and _only_objects(x)) for x in items)


def _hollow(v):
    """Objects have rows of their own and leave an empty one in their place."""
    return {} if type(v) is dict else [_hollow(x) for x in v] if type(v) is list else v


def _clean(key: str) -> str:
    """Half surrogates can't be written as UTF-8, and the mark is ours."""
    return key.encode("utf-8", "replace").decode().replace(OPEN, "?")


def _array_in(text: str) -> list | None:
    """The array kept as JSON text, if it is one."""
    if text.lstrip()[:1] != "[":
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if type(value) is list else None


def _reader(values: bool, keys: bool):
    schema = pa.schema(
        [("src", pa.string()), ("ref_id", pa.int64()), ("path", pa.string()), ("parent", pa.string()), ("field", pa.string()),
         ("state", pa.string()), ("lone", pa.bool_()), ("deps", pa.list_(pa.string())), ("keys", pa.list_(pa.string())), ("vals", pa.map_(pa.string(), pa.string()))]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEEPEST)
        w, told = Walker(values, keys), set()

        def gathered(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = pa.array(w.at, pa.int32())
            out = pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(w.path, pa.string()), pa.array(w.parent, pa.string()),
                 pa.array(w.field, pa.string()), pa.array(w.state, pa.string()), pa.array(w.lone, pa.bool_()),
                 pa.array(w.deps, pa.list_(pa.string())), pa.array(w.keys, pa.list_(pa.string())), pa.array(w.vals, pa.map_(pa.string(), pa.string()))],
                schema=schema,
            )
            w.reset()
            return out

        for batch in batches:
            for at, (src, text) in enumerate(zip(batch.column(0), batch.column(2))):
                w.src = src.as_py()
                w.record(at, text.as_py())
                if len(w.path) >= OBJECTS:
                    yield gathered(batch)
            yield gathered(batch)
            # fields that hold arrays, told once a task: rows without ref_id
            new = sorted(w.arrays - told)
            told.update(new)
            if new:
                n = len(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in new], pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
                     pa.array([f for _, f in new], pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.list_(pa.string())),
                     pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.map_(pa.string(), pa.string()))],
                    schema=schema,
                )

    return read


_READ = "src string, ref_id long, path string, parent string, field string, state string, lone boolean, deps array<string>, keys array<string>, vals map<string,string>"


def _resolved(path: Column, deps: Column, arrays: Column) -> Column:
    parts = F.split(path, OPEN)
    return F.array_join(
        F.transform(
            parts,
            lambda s, i: F.concat(s, F.when((i < F.size(parts) - 1) & F.array_contains(arrays, F.get(deps, i)), "[0]").otherwise("")),
        ),
        "",
    )


def read_objects(records: DataFrame, values: bool = True, keys: bool = True) -> DataFrame:
    """All objects of records(src, ref_id, fields_json): (src, ref_id, node_path, parent_path, field,
    state, is_element, keys, vals).

    ``node_path`` is '' for the record itself; ``parent_path`` is that of the enclosing object and
    null for the record; ``field`` is the path without positions; ``is_element`` tells elements of
    arrays from objects that stand alone everywhere; ``keys`` has all keys of the object (null without ``keys``); ``vals`` has the JSON text of each scalar and of
    each array that holds anything but objects, ``{}`` standing for those (null without ``values``). Null and unreadable JSON gives nothing; a key that occurs twice counts
    with its last value; the same src and ref_id delivered twice counts once.
    """
    one = records.select("src", F.col("ref_id").cast("long").alias("ref_id"), "fields_json").where("fields_json IS NOT NULL AND ref_id IS NOT NULL")
    one = one.dropDuplicates(["src", "ref_id"])
    read = one.mapInArrow(_reader(values, keys), _READ)
    read = materialize(read, "p4-objects")
    told = materialize(read.where("ref_id IS NULL").select("src", "field").distinct(), "p4-arrays")
    arrays = told.groupBy("src").agg(F.collect_set("field").alias("arrays"))  # as wide as the schemas are
    objects = read.where("ref_id IS NOT NULL")
    plain = objects.where("deps IS NULL").select(
        "src", "ref_id", F.col("path").alias("node_path"), F.col("parent").alias("parent_path"), "field", "state",
        ((~F.col("lone")) & (F.col("path") != "")).alias("is_element"), "keys", "vals",
    )
    marked = objects.where("deps IS NOT NULL")
    if told.count() <= BROADCAST_FIELDS:
        marked = marked.join(F.broadcast(arrays), "src", "left")
    else:
        # there are few sources: spread each over many tasks
        spread = arrays.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        marked = marked.withColumn("salt", F.pmod(F.xxhash64("ref_id"), F.lit(SALTS))).join(spread, ["src", "salt"], "left")
    known = F.coalesce("arrays", F.array().cast("array<string>"))
    marked = marked.select(
        "src", "ref_id", _resolved(F.col("path"), F.col("deps"), known).alias("node_path"),
        _resolved(F.col("parent"), F.col("deps"), known).alias("parent_path"), "field", "state",
        (~F.col("lone") | F.array_contains(known, F.col("field"))).alias("is_element"), "keys", "vals",
    )
    return plain.unionByName(marked)


def elements(objects: DataFrame) -> DataFrame:
    return objects.where("is_element").select("src", "ref_id", "node_path")


def variants(objects: DataFrame) -> DataFrame:
    """(src, field, state, n, keys): the structural variants of each field path and their keys."""
    return objects.groupBy("src", "field", "state").agg(F.count("*").alias("n"), F.first("keys").alias("keys"))


def supertypes(objects: DataFrame) -> DataFrame:
    """(src, field, n, n_variants, common_keys, all_keys): what the variants of a field share."""
    # counted by key, the null key for the variant itself: no field's variants are gathered in one row
    none = F.array(F.lit(None).cast("string"))
    each = variants(objects).select("src", "field", "n", F.explode(F.concat(none, "keys")).alias("key"))
    each = each.groupBy("src", "field", "key").agg(F.sum("n").alias("n"), F.count("*").alias("n_variants"))
    own = F.col("key").isNull()
    per = each.groupBy("src", "field").agg(
        F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.col("n_variants"))).alias("n_variants"),
        F.sort_array(F.collect_list(F.when(~own, F.struct("key", F.col("n_variants").alias("held"))))).alias("per"),
    )
    common = F.filter("per", lambda p: p["held"] == F.col("n_variants"))
    return per.select("src", "field", "n", "n_variants", common["key"].alias("common_keys"), F.col("per")["key"].alias("all_keys"))


def flat_tables(objects: DataFrame) -> DataFrame:
    """The flat tables of every field and variant, one below the other: (src, field, state, ref_id,
    node_path, parent_path, is_element, vals). ``vals`` holds nulls and empty arrays too, so with the
    paths all values of the records' objects are here."""
    return objects.select("src", "field", "state", "ref_id", "node_path", "parent_path", "is_element", "vals")


def typed_values(objects: DataFrame) -> DataFrame:
    """The values of every variant's table by type, a row a value: (src, field, state, ref_id, node_path, key,
    kind, text, number, flag). ``kind``: string, number, boolean, null or array (of anything but objects alone,
    as JSON in ``text``); a number beyond the range of a double keeps its digits in ``text``."""
    v = objects.select("src", "field", "state", "ref_id", "node_path", F.explode("vals").alias("key", "v"))
    first = F.substring("v", 1, 1)
    kind = (
        F.when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(first == "[", "array").otherwise("number")
    )
    v = v.withColumn("kind", kind)
    number = F.when(F.col("kind") == "number", F.col("v").try_cast("double"))
    plain = F.get_json_object(F.concat(F.lit('{"v":'), F.col("v"), F.lit("}")), "$.v")
    text = F.when(F.col("kind") == "string", F.coalesce(plain, F.col("v"))).when((F.col("kind") == "array") | ((F.col("kind") == "number") & number.isNull()), F.col("v"))
    return v.select("src", "field", "state", "ref_id", "node_path", "key", "kind", text.alias("text"), number.alias("number"), (F.when(F.col("kind") == "boolean", F.col("v") == "true")).alias("flag"))


# ---------------------------------------------------------------- the way back


def _same_form(v):
    """A value as nested records count it: arrays kept as text are arrays, and an array of one object is
    that object."""
    if type(v) is str:
        inner = _array_in(v)
        return v if inner is None else _same_form(inner)
    if type(v) is list:
        items = [_same_form(x) for x in v]
        return items[0] if len(items) == 1 and type(items[0]) is dict else items
    if type(v) is dict:
        return {_clean(k): _same_form(x) for k, x in v.items()}
    return v


def _put(place, positions: list[int], child):
    """``place`` with ``child`` at the given positions of its arrays."""
    if not positions:
        return child
    if type(place) is str:
        place = json.loads(place)
    place = place if type(place) is list else []
    at = positions[0]
    place.extend([None] * (at + 1 - len(place)))
    place[at] = _put(place[at], positions[1:], child)
    return place


def _put_together(rows: list[dict]):
    """The record whose objects are ``rows``(node_path, parent_path, field, vals). An object under an empty key of
    the record itself shares the record's path and can't be told from it."""
    made = {r["node_path"]: {k: json.loads(v) for k, v in r["vals"]} for r in rows}
    fields = {r["node_path"]: r["field"] for r in rows}
    for r in rows:
        if r["parent_path"] is None:
            continue
        over, field = r["parent_path"], r["field"]
        key = field[len(fields[over]) + 1 :] if over else field
        name = f"{over}.{key}" if over else key
        if not over and not key:
            key = OPEN  # an element of a record that is an array
        positions = [int(x) for x in r["node_path"][len(name) :].strip("[]").split("][") if x]
        made[over][key] = _put(made[over].get(key), positions, made[r["node_path"]])
    return made[""].get(OPEN, made[""])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(DEEPEST)
    key, rows = None, []

    def out(records: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*records)) if records else [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["src", "ref_id", "n_objects", "record_json"])

    def whole() -> tuple:
        return (*key, len(rows), json.dumps(_same_form(_put_together(rows)), sort_keys=True))

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if (r["src"], r["ref_id"]) != key:
                if rows:
                    done.append(whole())
                key, rows = (r["src"], r["ref_id"]), []
            rows.append(r)
        yield out(done)
    if rows:
        yield out([whole()])


def rebuilt(objects: DataFrame) -> DataFrame:
    """(src, ref_id, n_objects, record_json): every record put together again from its flat tables. Keys are in
    order of the alphabet, arrays of one object are that object and arrays kept as text are arrays."""
    flat = flat_tables(objects).select("src", "ref_id", "node_path", "parent_path", "field", "vals")
    # the objects of one record lie together
    return flat.repartition("src", "ref_id").sortWithinPartitions("src", "ref_id").mapInArrow(_rebuild, "src string, ref_id long, n_objects long, record_json string")


def _as_written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(DEEPEST)
    for batch in batches:
        forms = []
        for text in batch.column("fields_json").to_pylist():
            try:
                forms.append(json.dumps(_same_form(json.loads(text)), sort_keys=True))
            except (ValueError, RecursionError):
                forms.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("ref_id"), pa.array(forms, pa.string())], names=["src", "ref_id", "written"])


def compare_rebuilt(records: DataFrame, objects: DataFrame) -> DataFrame:
    """(src, ref_id, n_objects, same): whether each readable record comes out of its flat tables as it was written."""
    one = records.select("src", F.col("ref_id").cast("long").alias("ref_id"), "fields_json").where("fields_json IS NOT NULL AND ref_id IS NOT NULL").dropDuplicates(["src", "ref_id"])
    written = one.mapInArrow(_as_written, "src string, ref_id long, written string").where("written IS NOT NULL")
    both = written.join(rebuilt(objects), ["src", "ref_id"], "left")
    return both.select("src", "ref_id", F.coalesce("n_objects", F.lit(0)).cast("long").alias("n_objects"), F.coalesce(F.col("written") == F.col("record_json"), F.lit(False)).alias("same"))


def flat_table(objects: DataFrame, src: str, field: str, columns: dict[str, str], state: str | None = None) -> DataFrame:
    """The table of one field (or of one variant of it): (ref_id, node_path, parent_path, columns...).
    ``columns`` maps keys to SQL types; values that don't fit the type are null here and stay in
    ``rest``, as do keys without column, so nothing is lost."""
    rows = objects.where((F.col("src") == src) & (F.col("field") == field))
    if state is not None:
        rows = rows.where(F.col("state") == state)
    picked = {}
    for key, kind in columns.items():
        text = F.get_json_object(F.concat(F.lit('{"v":'), F.col("vals")[key], F.lit("}")), "$.v")
        picked[key] = text if kind == "string" else text.try_cast(kind)
    typed = rows.select("ref_id", "node_path", "parent_path", "vals", *(c.alias(f"c{i}") for i, c in enumerate(picked.values())))
    left = F.map_filter(
        "vals",
        lambda k, v: (v != "null")
        & ~F.coalesce(_any([(k == key) & F.col(f"c{i}").isNotNull() for i, key in enumerate(picked)]), F.lit(False)),
    )
    return typed.select(
        "ref_id", "node_path", "parent_path", *(F.col(f"c{i}").alias(key) for i, key in enumerate(picked)), left.alias("rest")
    )


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def json_records(extracted: DataFrame, entries: DataFrame) -> DataFrame:
    a = extracted.select(F.lit("record").alias("src"), F.col("record_id").alias("ref_id"), "fields_json")
    b = entries.select(F.lit("entry").alias("src"), F.col("entry_id").alias("ref_id"), "fields_json")
    return a.unionByName(b)

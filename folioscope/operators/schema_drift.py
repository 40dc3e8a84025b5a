"""Problem 2: schemas that drift between versions.

Every version (a manifest, or the records of one file) is profiled: its fields, their types and,
for record fields, sketches of their values. Fields that go and fields that come in the same step
are matched by a minimum-cost bipartite assignment over name similarity, value sketches and how
often the two names occur side by side elsewhere. Matched fields are renames; the rest were added
or removed. The renames then give each layout one consistent set of field names.
"""

from __future__ import annotations

import json
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import broadcast_if_small, materialize

VALUE_BUCKETS = 64
#: Records of a file that one task profiles; rows up to which large files and names of fields are broadcast.
RECORDS_A_TASK, BROADCAST_FILES = 50_000, 200_000
#: Least score of a match, and what speaks for and against it; see ``score``.
ACCEPT = 0.95
#: Sketches below this likeness rule out a match of names that aren't alike either.
UNLIKE = 0.42
#: The same where the two names take turns in many layouts.
UNLIKE_AT_ALL = 0.2
#: Taken off when a number is written as text on one side: sketches say nothing then.
RETYPED = 0.3
#: Share of the expected versions with both names from which the names count as different things.
LIFT = 0.15
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[_\-\s]+")
_RUNS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d")
_KINDS = {str: "string", int: "number", float: "number", bool: "boolean", list: "array", dict: "object"}


# ---------------------------------------------------------------- profiles


def manifest_fields(schema_json: str) -> list[tuple[str, str, str]] | None:
    """(name, type, label) of a declared schema in any of its JSON shapes; columns of arrays are
    ``array.key`` without type and carry their label. None when unreadable."""
    try:
        schema = json.loads(schema_json)
    except (ValueError, TypeError, RecursionError):
        return None
    if isinstance(schema, dict):
        for wrapper in ("fields", "properties"):
            if isinstance(schema.get(wrapper), (dict, list)) and len(schema) <= 2 and "type" not in (schema[wrapper] if isinstance(schema[wrapper], dict) else {}):
                schema = schema[wrapper]
                break
    if isinstance(schema, list):
        pairs = [(x.get("name"), x) for x in schema if isinstance(x, dict)]
    elif isinstance(schema, dict):
        pairs = list(schema.items())
    else:
        return None
    out = {}
    for name, spec in pairs:
        if not isinstance(name, str):
            continue
        kind = spec if isinstance(spec, str) else spec.get("type") if isinstance(spec, dict) else None
        out[name] = (name, str(kind or "").strip().lower(), "")
        columns = spec.get("columns") if isinstance(spec, dict) else None
        if isinstance(columns, dict):
            cells = [(label, key) for label, key in columns.items()]
        elif isinstance(columns, list):
            cells = [(c.get("label") or c.get("name"), c.get("key")) for c in columns if isinstance(c, dict)]
        else:
            cells = []
        for label, key in cells:
            if isinstance(key, str):
                out[f"{name}.{key}"] = (f"{name}.{key}", "", str(label or ""))
    return list(out.values())


@lru_cache(maxsize=1 << 16, typed=True)
def _features(v) -> tuple[str, ...]:
    """Sketch of one scalar: bounded in number over all values."""
    if isinstance(v, bool):
        return (f"b{v}",)
    if isinstance(v, (int, float)):
        try:
            a = abs(float(v))
        except OverflowError:
            a = math.inf
        if not math.isfinite(a):
            return ("ninf",)
        whole = float(v).is_integer()
        decimals = 0 if whole else min(6, len(repr(v).rpartition(".")[2]))
        return (f"g{min(18, int(math.log10(a + 1) * 2))}", f"d{decimals}{'-' if v < 0 else ''}", f"i{isinstance(v, int)}")
    text = v.strip() if v.isascii() else v.strip().encode("utf-8", "replace").decode()
    mask = _RUNS.sub("a", _DIGITS.sub("9", text))[:24]
    return (f"m{mask if len(set(mask)) < 9 else len(mask)}", f"v{zlib.crc32(text.encode("utf-8", "replace")) % VALUE_BUCKETS}", f"w{min(12, text.count(' '))}")


def _walk(value, prefix: str, kinds: Counter, sketch: Counter) -> None:
    for key, v in value.items():
        if v is None:
            continue
        path = f"{prefix}{key if key.isascii() else key.encode('utf-8', 'replace').decode()}"
        kinds[path, _KINDS[type(v)]] += 1
        if isinstance(v, dict):
            _walk(v, path + ".", kinds, sketch)
        elif isinstance(v, list):
            _into(v, path + ".", kinds, sketch)
        else:
            for f in _features(v):
                sketch[path, f] += 1


def _into(items: list, prefix: str, kinds: Counter, sketch: Counter) -> None:
    for x in items:
        if isinstance(x, dict):
            _walk(x, prefix, kinds, sketch)
        elif isinstance(x, list):
            _into(x, prefix, kinds, sketch)


def _profile_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Profiles of files whose records come one after the other, repeated ones side by side."""
    sys.setrecursionlimit(100_000)
    file, last, kinds, sketch = None, None, Counter(), Counter()
    out = _Profiles()

    for batch in batches:
        for layout, no, part, record_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (layout, no, part) != last:
                if kinds:
                    out.add(file, kinds, sketch)
                last, file, kinds, sketch, before = (layout, no, part), (layout, no), Counter(), Counter(), None
            elif record_id is not None and record_id == before:
                continue
            before = record_id
            try:
                record = json.loads(text)
            except (ValueError, TypeError, RecursionError):
                continue
            if isinstance(record, dict):
                _walk(record, "", kinds, sketch)
        yield out.taken()
    if kinds:
        out.add(file, kinds, sketch)
        yield out.taken()


class _Profiles:
    """Rows of (layout_id, seq_no, field, kinds, sketch), gathered column by column."""

    def __init__(self):
        self.layouts, self.numbers, self.fields = [], [], []
        self.counted = [([0], [], []), ([0], [], [])]

    def add(self, file: tuple, kinds: Counter, sketch: Counter) -> None:
        by_field: dict[str, tuple[list, list]] = {}
        for side, counts in enumerate((kinds, sketch)):
            for (field, item), n in counts.items():
                by_field.setdefault(field, ([], []))[side].append((item, n))
        for field, sides in by_field.items():
            self.layouts.append(file[0])
            self.numbers.append(file[1])
            self.fields.append(field)
            for (ends, items, ns), pairs in zip(self.counted, sides):
                items += [i for i, _ in pairs]
                ns += [n for _, n in pairs]
                ends.append(len(items))

    def taken(self) -> pa.RecordBatch:
        lists = [
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(items, pa.string()), pa.array(ns, pa.int64())], names=["item", "n"]))
            for ends, items, ns in self.counted
        ]
        columns = [pa.array(self.layouts, pa.string()), pa.array(self.numbers, pa.int32()), pa.array(self.fields, pa.string()), *lists]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, names=["layout_id", "seq_no", "field", "kinds", "sketch"])


def profile_records(records: DataFrame) -> DataFrame:
    """(layout_id, seq_no, field, kinds, sketch) of records(record_id, layout_id, file_no, fields_json): how many
    values of each JSON type a field has in a file, and the sketch features of its values, as arrays of
    struct(item, n). A record delivered twice in a file counts once; null or unreadable JSON and rows
    without layout or file count nowhere. The records of a file go to one task, those of a very large file to several."""
    one = records.where("fields_json IS NOT NULL AND layout_id IS NOT NULL AND file_no IS NOT NULL")
    at = ["layout_id", "file_no"]
    large = one.groupBy(*at).agg(F.ceil(F.count("*") / RECORDS_A_TASK).alias("parts")).where("parts > 1")
    large = materialize(large, "p2-large-files")
    n_large = large.count()
    part = F.lit(0).cast("long")
    if n_large:
        one = one.join(broadcast_if_small(large, BROADCAST_FILES, n_large), at, "left")
        part = F.pmod(F.xxhash64("record_id"), F.coalesce("parts", F.lit(1)))
    one = one.select("layout_id", F.col("file_no").cast("int").alias("file_no"), part.alias("part"), "record_id", "fields_json")
    one = one.repartition("layout_id", "file_no", "part").sortWithinPartitions("layout_id", "file_no", "part", "record_id")
    counted = "array<struct<item:string,n:bigint>>"
    raw = one.mapInArrow(_profile_records, f"layout_id string, seq_no int, field string, kinds {counted}, sketch {counted}")
    return _merged(raw) if n_large else raw


def _merged(parts: DataFrame) -> DataFrame:
    """One row a field of profiles that came in parts."""
    at = ["layout_id", "seq_no", "field"]
    parts = materialize(parts, "p2-parts")

    def whole(column: str) -> DataFrame:
        each = parts.select(*at, F.explode(column).alias("e")).groupBy(*at, "e.item").agg(F.sum("e.n").alias("n"))
        return each.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("item", "n"))).alias(column))

    return whole("kinds").join(whole("sketch"), at, "left").withColumn("sketch", F.coalesce("sketch", F.array().cast("array<struct<item:string,n:bigint>>")))


def _profile_manifests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            (layout, seq, *f)
            for layout, seq, text in zip(pdf.layout_id, pdf.manifest_no, pdf.schema_json)
            for f in manifest_fields(text) or ()
        ]
        yield pd.DataFrame(rows, columns=["layout_id", "seq_no", "field", "kind", "label"])


def profile_manifests(manifests: DataFrame) -> DataFrame:
    """(layout_id, seq_no, field, kind, label) of the declared schemas, each manifest once."""
    one = manifests.where("layout_id IS NOT NULL AND manifest_no IS NOT NULL").dropDuplicates(["layout_id", "manifest_no"])
    return one.select("layout_id", "manifest_no", "schema_json").mapInPandas(
        _profile_manifests, "layout_id string, seq_no int, field string, kind string, label string"
    )


# ---------------------------------------------------------------- matching


def _tokens(name: str) -> list[str]:
    return [t.lower() for t in _CAMEL.split(name) if t]


def _near(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short, long_ = sorted((a, b), key=len)
    if len(short) >= 2 and long_.startswith(short):
        return 0.85
    at = iter(long_)
    if len(short) >= 2 and short[0] == long_[0] and all(c in at for c in short):
        return 0.75
    return 0.0


def name_similarity(a: str, b: str) -> float:
    """0 to 1 for the last parts of two field names, by words, prefixes and abbreviations."""
    x, y = _tokens(a.rpartition(".")[2]), _tokens(b.rpartition(".")[2])
    if "".join(x) == "".join(y):
        return 1.0
    if not x or not y:
        return 0.0
    short, long_ = sorted((x, y), key=len)
    rest, total = list(long_), 0.0
    for t in short:
        best = max(rest, key=lambda r: _near(t, r), default=None)
        if best is not None and _near(t, best) > 0:
            total += _near(t, best)
            rest.remove(best)
    return min(0.95, 2 * total / (len(x) + len(y)))


def sketch_similarity(a: dict[str, int] | None, b: dict[str, int] | None) -> float | None:
    """Mean cosine over the kinds of features that either sketch has; None without values."""
    if not a or not b:
        return None
    out = []
    for kind in {f[0] for f in a} | {f[0] for f in b}:
        x = {f: n for f, n in a.items() if f[0] == kind}
        y = {f: n for f, n in b.items() if f[0] == kind}
        dot = sum(n * y.get(f, 0) for f, n in x.items())
        size = math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
        out.append(dot / size if size else 0.0)
    return sum(out) / len(out)


def score(name: float, values: float | None, together: int, expected: float, layouts: int, shared: int) -> float:
    """Gain of matching two names. Names that stand side by side in versions of a layout are
    different things; names of which a layout has now the one, now the other speak for one thing.
    ``expected``: versions with both if the names fell on a layout's versions at random; ``layouts``:
    those with the rarer name, ``shared``: those that have either name at some time."""
    lift = together / expected if expected > 0 else 0.0
    if lift >= LIFT:
        side = -2.0 * min(1.0, lift / 0.5)
    else:
        side = 0.2 + 0.5 * min(1.0, expected / 4) + (0.6 * (shared / layouts - 0.5) if layouts >= 3 else 0.0)
    certain = lift < LIFT and expected >= 3 and shared >= 0.8 * layouts
    if values is not None and values < (UNLIKE_AT_ALL if certain else UNLIKE) and name < 0.3:
        return 0.0
    return name * 0.9 + (0.35 if values is None else values * 0.7) + side


def assign(gain: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the largest total gain (Hungarian method with
    potentials); rows and columns without positive gain stay free."""
    rows, cols = len(gain), len(gain[0]) if gain else 0
    n = max(rows, cols)
    cost = [[-max(0.0, gain[i][j]) if i < rows and j < cols else 0.0 for j in range(n)] for i in range(n)]
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [math.inf] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], math.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, n + 1) if match[j] - 1 < rows and j - 1 < cols and gain[match[j] - 1][j - 1] > 0]


def match_step(gone: list[dict], come: list[dict], beside: dict[tuple[str, str], tuple]) -> list[tuple[str, str]]:
    """Renames (old, new) of one step. Fields match only below the same or a renamed parent and with
    the same type (or as number and text); each is a dict with field, kind, label and sketch."""
    renamed: dict[str, str] = {}
    levels = sorted({f["field"].count(".") for f in gone} & {f["field"].count(".") for f in come})
    for level in levels:
        old = [f for f in gone if f["field"].count(".") == level]
        new = [f for f in come if f["field"].count(".") == level]
        gain = []
        for a in old:
            parent = a["field"].rpartition(".")[0]
            row = []
            for b in new:
                g = 0.0
                same = a["kind"] == b["kind"]
                if renamed.get(parent, parent) == b["field"].rpartition(".")[0] and (same or {a["kind"], b["kind"]} == {"string", "number"}):
                    name = name_similarity(a["field"], b["field"])
                    if a["label"] and b["label"]:
                        g = 3.0 + name if a["label"] == b["label"] else 0.0
                    elif name == 1.0:
                        g = 3.0
                    else:
                        side = beside.get((a["field"], b["field"]), (0, 0.0, 0, 0))
                        values = sketch_similarity(a["sketch"], b["sketch"]) if same else None
                        s = score(name, values, *side) - (0.0 if same else RETYPED)
                        g = s if s >= ACCEPT else 0.0
                row.append(g)
            gain.append(row)
        for i, j in assign(gain):
            renamed[old[i]["field"]] = new[j]["field"]
    return list(renamed.items())


# ---------------------------------------------------------------- changes


def versions(manifest_profile: DataFrame, record_profile: DataFrame) -> DataFrame:
    """(src, layout_id, seq_no, field, kind, label): fields of every version with their type; for
    records the type of most values (ties: the first in the alphabet)."""
    m = manifest_profile.select(F.lit("manifest").alias("src"), "layout_id", "seq_no", "field", "kind", "label")
    ranked = F.transform("kinds", lambda k: F.struct(k["n"].alias("n"), F.translate(k["item"], "abnos", "zyxwv").alias("turned"), k["item"].alias("item")))
    r = record_profile.select("layout_id", "seq_no", "field", F.array_max(ranked)["item"].alias("kind"))
    return m.unionByName(r.select(F.lit("record").alias("src"), "layout_id", "seq_no", "field", "kind", F.lit("").alias("label")))


def _renames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["src", "layout_id", "seq_no", "field_name", "was_name"]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
    for batch in batches:
        out = []
        for step in batch.to_pylist():
            beside, fields = {}, []
            for f in step["fields"]:
                for p in f["side_by_side"]:
                    beside[f["field"], p["b"]] = (p["together"], p["expected"], p["layouts"], p["shared"])
                fields.append(f | {"sketch": {e["item"]: e["n"] for e in f["sketch"]} if f["sketch"] is not None else None})
            found = match_step([f for f in fields if f["side"] == "gone"], [f for f in fields if f["side"] == "come"], beside)
            out += [(step["src"], step["layout_id"], step["seq_no"], new, old) for old, new in found]
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def changes(manifests: DataFrame, records: DataFrame) -> DataFrame:
    """(src, layout_id, seq_no, field_name, was_name, change_kind) against the version before.

    The first version of a layout has no changes. Numbers of versions may have holes. Late and
    repeated rows make no difference; unreadable versions are skipped."""
    return changes_between(*profiles(manifests, records))


def profiles(manifests: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fields of all versions and the profile of the records, as written tables."""
    record_profile = materialize(profile_records(records), "p2-records")
    return materialize(versions(profile_manifests(manifests), record_profile), "p2-versions"), record_profile


def changes_between(fields: DataFrame, record_profile: DataFrame) -> DataFrame:
    """The changes of ``changes`` from the fields of all versions and the profile of the records."""
    steps = fields.select("src", "layout_id", "seq_no").distinct()
    steps = steps.withColumn("prev_no", F.lag("seq_no").over(Window.partitionBy("src", "layout_id").orderBy("seq_no")))
    steps = steps.where("prev_no IS NOT NULL")
    at = ["src", "layout_id", "seq_no"]
    now = fields.join(steps.drop("prev_no"), at).select(*at, "field", F.struct("kind", "label").alias("now"))
    then = fields.withColumnRenamed("seq_no", "prev_no").join(steps, ["src", "layout_id", "prev_no"])
    then = then.select(*at, "field", F.struct("kind", "label").alias("then"))
    both = materialize(
        now.join(then, [*at, "field"], "full").where("now IS NULL OR then IS NULL OR now.kind != then.kind"), "p2-differences"
    )
    retyped = both.where("now IS NOT NULL AND then IS NOT NULL").select(
        *at, F.col("field").alias("field_name"), F.lit("").alias("was_name"), F.lit("retyped").alias("change_kind")
    )
    moved = both.where("now IS NULL OR then IS NULL").select(
        *at, "field", F.when(F.col("now").isNull(), "gone").otherwise("come").alias("side"),
        F.coalesce("now.kind", "then.kind").alias("kind"), F.coalesce("now.label", "then.label").alias("label"),
    )
    sides = Window.partitionBy(*at)
    open_ = moved.withColumn("n_sides", F.size(F.collect_set("side").over(sides))).where("n_sides = 2").drop("n_sides")
    open_ = materialize(open_, "p2-open")

    # how often two names stand side by side, for names that go and come in one step below one parent
    parent = F.regexp_replace("field", r"\.?[^.]*$", "")
    gone = open_.where("side = 'gone'").select(*at, F.col("field").alias("a"), parent.alias("parent"), "kind")
    come = open_.where("side = 'come'").select(*at, F.col("field").alias("b"), parent.alias("parent"), "kind")
    pairs = gone.join(come.drop("kind"), [*at, "parent"]).select("a", "b").distinct()
    line = ["src", "layout_id"]
    pairs = materialize(pairs, "p2-pairs")
    asked = pairs.select(F.col("a").alias("field")).unionByName(pairs.select(F.col("b").alias("field"))).distinct()
    asked = fields.join(broadcast_if_small(asked, BROADCAST_FILES, 2 * pairs.count()), "field", "left_semi")
    sets = asked.groupBy(*at).agg(F.collect_set("field").alias("fields"))
    sizes = fields.select(*at).distinct().groupBy(*line).agg(F.count("*").alias("n_l"))
    per_line = materialize(asked.groupBy(*line, "field").agg(F.countDistinct("seq_no").alias("n")), "p2-lines")
    na = per_line.withColumnsRenamed({"field": "a", "n": "na"})
    nb = per_line.withColumnsRenamed({"field": "b", "n": "nb"})
    chance = (
        pairs.join(na, "a").join(nb, ["b", *line]).join(sizes, line)
        .groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb") / F.col("n_l")).alias("expected"), F.count("*").alias("shared"))
    )
    seen = sets.select("fields", F.explode("fields").alias("a")).join(pairs, "a")
    together = seen.groupBy("a", "b").agg(F.count_if(F.array_contains("fields", F.col("b"))).alias("together"))
    lines_a = na.groupBy("a").agg(F.count("*").alias("lines_a"))
    lines_b = nb.groupBy("b").agg(F.count("*").alias("lines_b"))
    rated = chance.join(together, ["a", "b"]).join(lines_a, "a").join(lines_b, "b")
    rated = rated.withColumn("layouts", F.least("lines_a", "lines_b"))
    per_name = rated.groupBy(F.col("a").alias("field")).agg(
        F.collect_list(F.struct("b", "together", "expected", "layouts", "shared")).alias("side_by_side")
    )

    # sketches: of the file itself for records, of the name in all files for manifests
    declared = open_.where("src = 'manifest'")
    names = materialize(declared.select("field").distinct(), "p2-declared")
    local = record_profile.select("layout_id", "seq_no", "field", F.when(F.size("sketch") > 0, F.col("sketch")).alias("sketch"))
    asked = record_profile.join(broadcast_if_small(names, BROADCAST_FILES), "field", "left_semi").select("field", F.explode("sketch").alias("e"))
    overall = asked.groupBy("field", "e.item").agg(F.sum("e.n").alias("n")).groupBy("field").agg(F.sort_array(F.collect_list(F.struct("item", "n"))).alias("sketch"))
    here = open_.where("src = 'record'").join(steps, at)
    here = here.withColumn("from_no", F.when(F.col("side") == "come", F.col("seq_no")).otherwise(F.col("prev_no")))
    here = here.join(local.withColumnRenamed("seq_no", "from_no"), ["layout_id", "from_no", "field"], "left").drop("from_no", "prev_no")
    declared = declared.join(overall, "field", "left")
    described = here.unionByName(declared).join(per_name, "field", "left")
    pair = "array<struct<b:string,together:bigint,expected:double,layouts:bigint,shared:bigint>>"
    described = described.select(
        *at, "field", "side", "kind", "label", "sketch", F.coalesce("side_by_side", F.array().cast(pair)).alias("side_by_side")
    )
    # a step's fields are as many as a schema has; the match is made in the order of their names
    one = F.struct("field", "side", "kind", "label", "sketch", "side_by_side")
    per_step = described.groupBy(*at).agg(F.sort_array(F.collect_list(one)).alias("fields"))
    renamed = per_step.mapInArrow(_renames, "src string, layout_id string, seq_no int, field_name string, was_name string")
    renamed = materialize(renamed, "p2-renames")
    gone_names = renamed.select(*at, F.col("was_name").alias("field"), F.lit("gone").alias("side"))
    come_names = renamed.select(*at, F.col("field_name").alias("field"), F.lit("come").alias("side"))
    rest = moved.join(gone_names.unionByName(come_names), [*at, "field", "side"], "left_anti").select(
        *at, F.col("field").alias("field_name"), F.lit("").alias("was_name"),
        F.when(F.col("side") == "gone", "removed").otherwise("added").alias("change_kind"),
    )
    return rest.unionByName(retyped).unionByName(renamed.withColumn("change_kind", F.lit("renamed")))


class _Number(str):
    """A number as written."""


def _text(v) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{_text(k)}:{_text(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_text, v)) + "]"
    if isinstance(v, _Number):
        return str(v)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=any("\ud800" <= c <= "\udfff" for c in v))
    return json.dumps(v)


class Renamer:
    """The renames of one layout from one file on: ``steps`` maps old to new paths, step by step."""

    def __init__(self, steps: list[dict[str, str]]):
        self.steps = steps
        self.latest: dict[str, str] = {}
        self.leads: set[str] = set()
        # paths that lead to a renamed one
        self.inner = {name.rsplit(".", n)[0] for step in steps for name in [*step, *step.values()] for n in range(1, name.count(".") + 1)}

    def latest_of(self, path: str) -> str:
        """The path after all steps: its own renames and, where there is none, those of what it lies in."""
        now = self.latest.get(path)
        if now is None:
            now = path
            for step in self.steps:
                if now in self.inner:
                    self.leads.add(path)
                head, tail = now, ""
                while head not in step and "." in head:
                    head = head.rpartition(".")[0]
                    tail = now[len(head) :]
                now = step.get(head, head) + tail if head in step else now
            self.latest[path] = now
        return now

    def leads_on(self, path: str) -> bool:
        """Whether anything below is renamed while the path has one of its names."""
        self.latest_of(path)
        return path in self.leads

    def fields(self, pairs: list[tuple[str, object]], path: str) -> list[tuple[str, object]]:
        """An object's fields under their latest names. Of an old and a new name that are both there
        the filled one has the name; if both are, the old one keeps its own."""
        prefix = f"{path}." if path else ""
        ahead = f"{self.latest_of(path)}." if path else ""
        own: dict[str, object] = {}
        for key, v in pairs:
            if own.get(key) is None:
                own[key] = v
        new = {}
        for key in own:
            name = self.latest_of(prefix + key)
            new[key] = name[len(ahead) :] if name.startswith(ahead) else key
        while True:
            taken: dict[str, str] = {}
            back = []
            for key in sorted(own, key=lambda k: (own[k] is None, new[k] != k)):
                holder = taken.setdefault(new[key], key)
                if holder != key and own[key] is not None:
                    back.append(key)
            if not back:
                break
            for key in back:
                new[key] = key
        return [(new[key], v) for key, v in own.items() if taken[new[key]] == key]

    def value(self, v, path: str):
        """A parsed value whose objects have their latest names, at any depth."""
        if not self.leads_on(path):
            return v
        if isinstance(v, list):
            return [self.value(x, path) for x in v]
        if isinstance(v, dict):
            return dict(self.fields([(k, self.value(x, f"{path}.{k}")) for k, x in v.items()], path))
        return v

    def top(self, pairs: list[tuple[str, str | None]]) -> list[tuple[str, str | None]]:
        out = []
        for key, text in pairs:
            if text is not None and text[:1] in ("{", "[") and self.leads_on(key):
                try:
                    text = _text(self.value(json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_Number), key))
                except (ValueError, RecursionError):
                    pass
            out.append((key, text))
        return self.fields(out, "")


def _rename_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(100_000)
    known: dict[tuple, Renamer] = {}
    for batch in batches:
        out = []
        for layout, no, steps, raw in zip(*(batch.column(c) for c in ("layout_id", "file_no", "steps", "raw"))):
            pairs = raw.as_py()
            if pairs is not None:
                at = (layout.as_py(), no.as_py())
                if at not in known:
                    by_no: dict[int, dict[str, str]] = defaultdict(dict)
                    for s in steps.as_py() or ():
                        if at[1] is None or s["seq_no"] > at[1]:
                            by_no[s["seq_no"]][s["was_name"]] = s["field_name"]
                    known[at] = Renamer([by_no[k] for k in sorted(by_no)])
                pairs = known[at].top(pairs)
            out.append(pairs)
        names = ["record_id", "layout_id", "file_no", "fields"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(out, pa.map_(pa.string(), pa.string()))], names=names)


def unify(records: DataFrame, all_changes: DataFrame) -> DataFrame:
    """One consistent table: (record_id, layout_id, file_no, fields), each record once, ``fields``
    a map from the latest name of each top-level field to its value as JSON text or plain string;
    fields inside objects and arrays have their latest names in that text. A rename holds for the
    files before its step; records without file_no count as before all of them. Unreadable records
    keep a null map."""
    renames = all_changes.where("src = 'record' AND change_kind = 'renamed'")
    steps = F.sort_array(F.collect_list(F.struct("seq_no", "was_name", "field_name"))).alias("steps")
    per_layout = renames.groupBy("layout_id").agg(steps)
    raw = F.when(F.try_parse_json("fields_json").isNotNull(), F.from_json("fields_json", "map<string,string>"))
    one = records.dropDuplicates(["record_id"]).select("record_id", "layout_id", "file_no", raw.alias("raw"))
    kinds = dict(one.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("record_id", "layout_id", "file_no")) + ", fields map<string,string>"
    return one.join(per_layout, "layout_id", "left").select("record_id", "layout_id", "file_no", "raw", "steps").mapInArrow(_rename_records, schema)


# ---------------------------------------------------------------- one schema, and the books


def _latest_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, Renamer] = {}
    for batch in batches:
        out = []
        for src, layout, no, field, steps in zip(*(batch.column(c).to_pylist() for c in ("src", "layout_id", "seq_no", "field", "steps"))):
            at = (src, layout, no)
            if at not in known:
                by_no: dict[int, dict[str, str]] = defaultdict(dict)
                for s in steps or ():
                    if s["seq_no"] > no:
                        by_no[s["seq_no"]][s["was_name"]] = s["field_name"]
                known[at] = Renamer([by_no[k] for k in sorted(by_no)])
            out.append(known[at].latest_of(field))
        kept = ["src", "layout_id", "seq_no", "kind"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, "field_name"])


def unified_schema(fields: DataFrame, all_changes: DataFrame) -> DataFrame:
    """(src, layout_id, field_name, kind, kinds, first_no, last_no, is_current): one schema per layout over all its
    versions, for manifests and records alike. Fields are under their latest names; ``kinds`` are all types a
    field had and ``kind`` the one that holds them: the type itself, 'string' for several scalar ones, 'variant'
    where arrays or objects are among several, '' where none is declared. ``is_current`` tells fields of the last version."""
    renames = all_changes.where("change_kind = 'renamed'")
    steps = renames.groupBy("src", "layout_id").agg(F.sort_array(F.collect_list(F.struct("seq_no", "was_name", "field_name"))).alias("steps"))
    named = fields.join(steps, ["src", "layout_id"], "left").select("src", "layout_id", "seq_no", "field", "kind", "steps").mapInArrow(
        _latest_names, "src string, layout_id string, seq_no int, kind string, field_name string"
    )
    last = fields.groupBy("src", "layout_id").agg(F.max("seq_no").alias("newest"))
    g = named.groupBy("src", "layout_id", "field_name").agg(
        F.sort_array(F.collect_set("kind")).alias("kinds"), F.min("seq_no").alias("first_no"), F.max("seq_no").alias("last_no")
    )
    several = F.size("kinds") > 1
    nested_ = F.exists("kinds", lambda k: k.isin("array", "object"))
    kind = F.when(~several, F.element_at("kinds", 1)).when(nested_, "variant").otherwise("string")
    return g.join(last, ["src", "layout_id"]).select(
        "src", "layout_id", "field_name", kind.alias("kind"), F.array_join("kinds", " ").alias("kinds"), "first_no", "last_no", (F.col("last_no") == F.col("newest")).alias("is_current")
    )


def _leaves(fields: list[tuple[str, str | None]] | None) -> Counter:
    """The values below a record's fields, each as text, without their names."""
    out: Counter = Counter()

    def walk(v) -> None:
        if isinstance(v, dict):
            for x in v.values():
                walk(x)
        elif isinstance(v, list):
            for x in v:
                walk(x)
        elif v is not None:
            out[str(v)] += 1

    for _, text in fields or ():
        if text is not None and text[:1] in ("{", "["):
            try:
                walk(json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_Number))
                continue
            except (ValueError, RecursionError):
                pass
        walk(text)
    return out


def _book(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(100_000)
    for batch in batches:
        rows = []
        for raw, fields in zip(batch.column("raw"), batch.column("fields")):
            a, b = _leaves(raw.as_py()), _leaves(fields.as_py())
            rows.append((sum(a.values()), sum(b.values()), a == b))
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("record_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_())))], names=["record_id", "n_in", "n_out", "same"]
        )


def account(records: DataFrame, unified: DataFrame) -> DataFrame:
    """(record_id, n_in, n_out, same): values of each readable record before and after ``unify``, and whether they
    are the same ones."""
    raw = F.from_json("fields_json", "map<string,string>")
    one = records.where(F.try_parse_json("fields_json").isNotNull()).dropDuplicates(["record_id"]).select("record_id", raw.alias("raw"))
    both = one.join(unified.select("record_id", "fields"), "record_id")
    return both.mapInArrow(_book, f"record_id {dict(both.dtypes)['record_id']}, n_in long, n_out long, same boolean")

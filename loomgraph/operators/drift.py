"""Schemas that drift between files: change report and one consistent table, by similarity flooding.

Files of one lineage (series and file name) are compared run by run. A range shuffle by (series, file name, run)
and a sort put each run next to its predecessor, so one streaming pass compares neighbours whatever the length
of a series; a lineage may span many tasks, and the two files at each task border are compared in a second pass, by
lineage, over two files per task. For each neighbouring pair two schema graphs are built (kinds, fields, value types,
nesting), match scores start from name likeness and shared values and are propagated through the pairwise
connectivity graph to a fixpoint, and the correspondences among vanished and new fields are then selected by falling
converged score, each field used once; a pair of which the values say otherwise (fewer than half of them equal) is none.

Defined results
 * A file that isn't valid JSON (cut off, null) is skipped: its successor is compared with its predecessor.
 * Repeats of a file id count once. A null run number comes before all others. Null series form one series.
 * The outer form (list, object by id, list under one key) is no change. An empty file has no objects, and a
   kind without objects in either file is not compared.
 * Of several new fields that hold a vanished field's values the one most alike in name, type and nesting is its new
   name; equal scores go in order of the names.
 * Nulls and empty lists have no type. Two runs with one number are both compared with the run before.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .nested import parse

#: file name -> kinds from the outermost inwards, and the keys under which the list may be wrapped.
FILE_KINDS = {
    "final-domains.json": (("domain", "flow", "step"), ("domains",)),
    "final-tours.json": (("tour", "stop"), ("tours",)),
    "risk-scores.json": (("node", "warning"), ("scores", "nodes")),
}
#: Kinds whose objects have an id of their own; the others match by place within their owner.
BY_ID = {"domain", "flow", "step", "tour", "node"}
_EPSILON = 1e-3


def value_type(value) -> list[str]:
    """The types a value adds to its field: none for null and empty lists."""
    if value is None:
        return []
    if isinstance(value, bool):
        return ["boolean"]
    if isinstance(value, (int, float)):
        return ["number"]
    if isinstance(value, str):
        return ["string"]
    if isinstance(value, dict):
        return ["object"]
    return [f"list of {t}" for x in value for t in value_type(x)]


def canonical(value) -> str:
    """Text that is equal for equal JSON values: key order and 1 against 1.0 do not matter."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        value = int(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value)


@dataclass
class Schema:
    """What one file holds: per kind its objects by key, and per field its types and the kind nested in it."""

    objects: dict[str, dict[str, dict]] = field(default_factory=lambda: defaultdict(dict))
    owners: dict[tuple[str, str], str] = field(default_factory=dict)
    types: dict[str, dict[str, set]] = field(default_factory=lambda: defaultdict(lambda: defaultdict(set)))
    nested: dict[tuple[str, str], str] = field(default_factory=dict)


def _object_list(value) -> list[tuple[str | None, dict]]:
    """(key in its container or None, object) of a list of objects or an object of objects."""
    if isinstance(value, list):
        return [(None, x) for x in value if isinstance(x, dict)]
    if isinstance(value, dict) and value and all(isinstance(x, dict) for x in value.values() if x is not None):
        return [(k, x) for k, x in value.items() if x is not None]
    return []


def read_schema(value, file_name: str) -> Schema:
    """The schema of a parsed file. File names not in FILE_KINDS have no objects."""
    kinds, wrappers = FILE_KINDS.get(file_name, ((), ()))
    out = Schema()
    if not kinds:
        return out
    if isinstance(value, dict) and len(value) == 1 and next(iter(value)) in wrappers:
        value = next(iter(value.values()))
    if isinstance(value, dict) and not _object_list(value) and value:
        roots = [(None, value)]
    else:
        roots = _object_list(value)
    stack = [(kinds, "", i, key, x) for i, (key, x) in reversed(list(enumerate(roots)))]
    while stack:
        (kind, *inner), owner, place, key, x = stack.pop()
        if kind in BY_ID:
            own = x.get("id", x.get("node_id", key) if kind == "node" else key)
            name = own if isinstance(own, str) else f"{owner}#{place}" if own is None else canonical(own)
        else:
            name = f"{owner}#{place}"
        while name in out.objects[kind]:  # an id used twice: later objects keep their own row
            name += "'"
        out.objects[kind][name] = x
        out.owners[kind, name] = owner
        for k, v in x.items():
            out.types[kind][k].update(value_type(v))
            if inner and (held := _object_list(v)):
                out.nested[kind, k] = inner[0]
                stack += [(tuple(inner), name, i, c, y) for i, (c, y) in reversed(list(enumerate(held)))]
    return out


def _grams(name: str) -> set[str]:
    padded = f"^{name.lower()}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


def name_likeness(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs."""
    x, y = _grams(a), _grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def agreement(kind: str, old: str, new: str, before: Schema, after: Schema) -> tuple[int, int]:
    """(objects in both files with a value in the old field, those whose new field holds an equal value)."""
    held = equal = 0
    later = after.objects[kind]
    for key, x in before.objects[kind].items():
        if x.get(old) is None or key not in later:
            continue
        held += 1
        equal += new in later[key] and later[key][new] is not None and canonical(later[key][new]) == canonical(x[old])
    return held, equal


def flood(before: Schema, after: Schema, values: dict[tuple[str, str, str], float]) -> dict[tuple[str, str, str], float]:
    """Similarity flooding of two schema graphs. values: share of equal values of (kind, old, new) pairs, which
    together with the names makes the starting scores. Returns the converged score of each field pair of a kind."""
    start: dict[tuple, float] = {}
    edges: dict[tuple, list[tuple]] = defaultdict(list)  # label-wise neighbours in the pairwise connectivity graph

    def link(label: str, a: tuple, b: tuple) -> None:
        edges[a].append((label, b))
        edges[b].append((f"{label}-", a))

    for kind in before.types.keys() & after.types.keys():
        whole = ("kind", kind, kind)
        start[whole] = 1.0
        for f, ft in before.types[kind].items():
            for g, gt in after.types[kind].items():
                pair = ("field", f"{kind}.{f}", f"{kind}.{g}")
                start[pair] = 1e-3 + 0.5 * name_likeness(f, g) + 0.5 * values.get((kind, f, g), float(f == g))
                link("has", whole, pair)
                for t in ft:
                    for u in gt:
                        types = ("type", t, u)
                        start.setdefault(types, 1.0 if t == u else 0.1)
                        link("type", pair, types)
                if (n := before.nested.get((kind, f))) and n == after.nested.get((kind, g)):
                    start.setdefault(("kind", n, n), 1.0)
                    link("holds", pair, ("kind", n, n))
    weights = {}  # the flow along one label is shared among the neighbours of that label
    for a, found in edges.items():
        count = defaultdict(int)
        for label, _ in found:
            count[label] += 1
        weights[a] = [(b, 1 / count[label]) for label, b in found]
    score = dict(start)
    moved = 1.0 if score else 0.0
    while moved >= _EPSILON:  # all weights are positive and every pair keeps its own share, so this converges
        fed = {a: start[a] + score[a] for a in start}
        new = dict(fed)
        for a, found in weights.items():
            for b, w in found:
                new[b] += w * fed[a]
        top = max(new.values(), default=1.0)
        new = {a: s / top for a, s in new.items()}
        moved = sum((new[a] - score[a]) ** 2 for a in new) ** 0.5
        score = new
    return {(a[1].split(".", 1)[0], a[1].split(".", 1)[1], a[2].split(".", 1)[1]): s for a, s in score.items() if a[0] == "field"}


def compare(before: Schema, after: Schema) -> list[tuple[str, str, str, str, float | None]]:
    """(object_kind, change_kind, field, new_field, flooded score of a rename)."""
    changes: list[tuple[str, str, str, str, float | None]] = []
    kinds = [k for k in before.objects if before.objects[k] and after.objects.get(k)]
    open_fields = {}
    for kind in kinds:
        gone = sorted(before.types[kind].keys() - after.types[kind].keys())
        come = sorted(after.types[kind].keys() - before.types[kind].keys())
        open_fields[kind] = gone, come
    held_equal = {(k, f, g): agreement(k, f, g, before, after) for k, (gone, come) in open_fields.items() for f in gone for g in come}
    scores = flood(before, after, {p: e / h if h else 0.0 for p, (h, e) in held_equal.items()}) if held_equal else {}
    for kind in kinds:
        gone, come = open_fields[kind]
        used: dict[str, str] = {}
        taken: set[str] = set()
        for f, g in sorted(((f, g) for f in gone for g in come), key=lambda p: (-round(scores[kind, *p], 6), p)):
            held, equal = held_equal[kind, f, g]
            if held and 2 * equal >= held and f not in used and g not in taken:
                used[f] = g
                taken.add(g)
        changes += [(kind, "renamed", f, g, scores[kind, f, g]) for f, g in used.items()]
        changes += [(kind, "removed", f, "", None) for f in gone if f not in used]
        changes += [(kind, "added", g, "", None) for g in come if g not in taken]
        for f in sorted(before.types[kind].keys() & after.types[kind].keys()):
            a, b = before.types[kind][f], after.types[kind][f]
            if a and b and a != b:
                changes.append((kind, "retyped", f, "", None))
    return changes


_CHANGES = pa.schema([("role", pa.string()), ("series_id", pa.int64()), ("run_no", pa.int64()), ("file_name", pa.string()), ("file_id", pa.int64()), ("content", pa.string()), ("object_kind", pa.string()), ("change_kind", pa.string()), ("field", pa.string()), ("new_field", pa.string()), ("score", pa.float64())])
_CHANGES_DDL = "role string, series_id long, run_no long, file_name string, file_id long, content string, object_kind string, change_kind string, field string, new_field string, score double"
_INPUT = ["role", "series_id", "file_name", "run_no", "file_id", "content"]


def _neighbours():
    """The pass over files in order. Input role '' : compare within the task and hand its first and last run on
    as 'head' and 'tail'; input roles 'head' and 'tail': compare each head with the tail before it."""

    def run(batches):
        out: list[tuple] = []

        def batch():
            cols = list(zip(*out))
            made = pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _CHANGES)], schema=_CHANGES)
            out.clear()
            return made

        lineage = first_run = last_id = now = before = held = None  # now, before: (run, schema); held: the file that may end the task
        for b in batches:
            for role, series, name, number, file_id, content in zip(*(b.column(i).to_pylist() for i in range(6))):
                border = role != ""
                if not border and lineage == (series, name) and file_id is not None and last_id == (number, file_id):
                    continue
                value = parse(content)
                if value is None and (content or "").strip() != "null":
                    continue
                if value is None:
                    continue
                last_id = (number, file_id)
                schema = read_schema(value, name)
                if border:
                    if role == "head" and now is not None and lineage == (series, name):
                        out += [("change", series, number, name, file_id, None, *c) for c in compare(now[1], schema)]
                    elif role == "tail":
                        lineage, now = (series, name), (number, schema)
                else:
                    if first_run is None:
                        first_run = (series, name, number)
                    if (series, name, number) == first_run:
                        out.append(("head", series, number, name, file_id, content, None, None, None, None, None))
                    if lineage != (series, name):
                        lineage, before, now = (series, name), None, None
                    elif now is not None and now[0] != number:
                        before = now
                    if before is not None:
                        out += [("change", series, number, name, file_id, None, *c) for c in compare(before[1], schema)]
                    now, held = (number, schema), (series, number, name, file_id, content)
                if len(out) > 2000:
                    yield batch()
        if held is not None:
            out.append(("tail", *held, None, None, None, None, None))
        if out:
            yield batch()

    return run


def changes(files: DataFrame) -> DataFrame:
    """Every change of each file against the latest earlier valid run of its series and file name:
    series_id, run_no, file_name, object_kind, change_kind, field, new_field, score."""
    spark = files.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = files.select(
        F.lit("").alias("role"), F.col("series_id").cast("long"), F.col("file_name"), F.col("run_no").cast("long"), F.col("file_id").cast("long"), "content"
    ).repartitionByRange(n, "series_id", "file_name", "run_no").sortWithinPartitions("series_id", "file_name", "run_no", "file_id")
    found = cut(ordered.mapInArrow(_neighbours(), _CHANGES_DDL))
    # two runs for each task a lineage spans
    borders = found.where(F.col("role") != "change").repartition("series_id", "file_name").sortWithinPartitions("series_id", "file_name", "run_no", "role", "file_id")
    across = borders.select(*_INPUT).mapInArrow(_neighbours(), _CHANGES_DDL)
    keep = ["series_id", "run_no", "file_name", "object_kind", "change_kind", "field", "new_field", "score"]
    return found.where(F.col("role") == "change").select(*keep).unionByName(across.where(F.col("role") == "change").select(*keep))


_OBJECTS_DDL = "series_id long, run_no long, file_name string, file_id long, object_kind string, object_key string, owner_key string, field string, value string, value_types string"


def fields(files: DataFrame) -> DataFrame:
    """One row per field of each object of each valid file, as written. Repeats of a file count once."""
    schema = pa.schema([("series_id", pa.int64()), ("run_no", pa.int64()), ("file_name", pa.string()), ("file_id", pa.int64()), ("object_kind", pa.string()), ("object_key", pa.string()), ("owner_key", pa.string()), ("field", pa.string()), ("value", pa.string()), ("value_types", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for series, name, number, file_id, content in zip(*(b.column(i).to_pylist() for i in range(5))):
                value = parse(content)
                if value is None:
                    continue
                read = read_schema(value, name)
                for kind, objects in read.objects.items():
                    for key, x in objects.items():
                        for f, v in x.items():
                            text = v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
                            out.append((series, number, name, file_id, kind, key, read.owners[kind, key], f, text, "|".join(sorted(set(value_type(v))))))
            if out:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    picked = files.select(F.col("series_id").cast("long"), "file_name", F.col("run_no").cast("long"), F.col("file_id").cast("long"), "content").dropDuplicates(["series_id", "file_name", "run_no", "file_id", "content"])
    return picked.mapInArrow(run, _OBJECTS_DDL)


def canonical_names(found: DataFrame, known: DataFrame) -> DataFrame:
    """(object_kind, field, canonical, depth): a field that some file's rename leads back to a known field, through
    renames of renames, however many. found: changes(); known: (object_kind, field) in use for that kind. Field names are
    a vocabulary, not data rows, and the rename table has one row per pair of names."""
    step = cut(found.where(F.col("change_kind") == "renamed").groupBy("object_kind", "field", "new_field").agg(F.count(F.lit(1)).alias("n")))
    reached = cut(known.select("object_kind", "field", F.col("field").alias("canonical"), F.lit(0).alias("depth")))
    latest = reached
    while not latest.isEmpty():
        ahead = latest.join(step, ["object_kind", "field"]).groupBy("object_kind", F.col("new_field").alias("to")).agg(
            F.min_by("canonical", F.struct("depth", -F.col("n"), "canonical")).alias("canonical"), (F.min("depth") + 1).alias("depth")
        )
        latest = cut(ahead.withColumnRenamed("to", "field").join(reached.select("object_kind", "field"), ["object_kind", "field"], "left_anti").select("object_kind", "field", "canonical", "depth"))
        reached = cut(reached.unionByName(latest))
    return reached


#: The fields of each kind and the type each is cast to in the consistent table.
UNIFIED = {
    "domain": {"label": "string", "summary": "string", "entities": "list", "flows": "list"},
    "flow": {"label": "string", "steps": "list"},
    "step": {"label": "string", "node_ids": "list", "weight": "double"},
    "tour": {"title": "string", "description": "string", "entry_point": "string", "steps": "list"},
    "stop": {"node_id": "string", "step_title": "string", "explanation": "string", "highlight": "boolean"},
    "node": {"risk_score": "double", "risk_factors": "list", "structural_warnings": "list"},
    "warning": {"category": "string", "severity": "string", "description": "string", "related_node_ids": "list", "heuristic": "string"},
}


def unified(files: DataFrame, kind: str, found: DataFrame | None = None) -> DataFrame:
    """One consistent table of a kind over all files: series_id, run_no, file_name, object_key, owner_key and the
    fields of UNIFIED, renamed and cast; 'others' maps the remaining fields to their text. Lists come as the JSON
    text of a list whatever they were; text objects of one 'text' member count as that text. Where an object holds several
    fields of one canonical name, the one renamed least often is taken and the rest stay among the others."""
    wanted = UNIFIED[kind]
    spark = files.sparkSession
    known = spark.createDataFrame([(kind, f) for f in wanted], "object_kind string, field string")
    names = canonical_names((changes(files) if found is None else found).where(F.col("object_kind") == kind), known)
    long = fields(files).where(F.col("object_kind") == kind).join(names, ["object_kind", "field"], "left")
    key = ["series_id", "run_no", "file_name", "object_key"]

    each = long.groupBy(*key).agg(F.max("owner_key").alias("owner_key"), F.collect_list(F.struct("canonical", "depth", "field", "value")).alias("held"))

    def first(name: str):
        named = F.filter("held", lambda x: x.canonical == name)
        return F.array_min(F.transform(named, lambda x: F.struct(x.depth.alias("depth"), x.field.alias("field"), x.value.alias("value"))))

    each = each.withColumns({f"_{f}": first(f) for f in wanted})

    def cast(name: str, to: str):
        text = F.col(f"_{name}")["value"]
        if to == "list":
            return F.when(text.isNull(), None).when(F.ltrim(text).rlike(r"^[\[{]"), text).otherwise(F.to_json(F.array(text)))
        if to == "boolean":
            return F.when(F.lower(text).isin("true", "yes", "1"), True).when(F.lower(text).isin("false", "no", "0"), False)
        return F.coalesce(F.get_json_object(text, "$.text"), text) if to == "string" else text.try_cast(to)

    taken = F.array(*[F.coalesce(F.col(f"_{f}")["field"], F.lit("")) for f in wanted])
    rest = F.filter("held", lambda x: ~F.array_contains(taken, x.field))
    others = F.map_from_entries(F.array_sort(F.transform(rest, lambda x: F.struct(x.field.alias("field"), x.value.alias("value")))))
    return each.select(*key, "owner_key", *[cast(f, t).alias(f) for f, t in wanted.items()], others.alias("others"))

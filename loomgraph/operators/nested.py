"""Deeply nested records to related flat tables, by Dewey labelling.

Each JSON payload is walked once. Every element of a list gets the ordinal path of its position in each list
from the outermost inwards (``2/0/1``); its parent is the path without the last number, so parent-child links
need no join and no shuffle; elements are grouped into tables by their schema path (the names of the lists
passed through). The walk is a ``mapInArrow`` stage: one record at a time, nothing is grouped, and the cost is
linear in the text.

Defined results
 * An invalid payload (cut off, not JSON, null, or not an object at the top) gives no rows.
 * A list counts in any form: a JSON list, an object with the elements as values, a single object or scalar
   in place of a list, or any of these written as a JSON string. Nulls are no elements and take no position.
 * An element that isn't of the expected kind still counts, with child_id ''.
 * Records repeated with the same key and payload count once. Extra columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class ListOf:
    """A list in the record. field: its key on the parent; within: keys of plain objects passed on the way;
    id_key: the key of an element's own id, None when elements are scalars."""

    kind: str
    field: str
    id_key: str | None = None
    within: tuple[str, ...] = ()
    children: tuple["ListOf", ...] = field(default=())


#: The lists of a knowledge-graph payload.
KNOWLEDGE_GRAPH = (
    ListOf("node", "nodes", "id", (), (
        ListOf("commit", "commits", "sha", ("decision_context",)),
        ListOf("author", "primary_authors", None, ("decision_context",)),
        ListOf("warning", "structural_warnings", "category", (), (ListOf("related", "related_node_ids"),)),
    )),
    ListOf("domain", "domains", "id", (), (
        ListOf("flow", "flows", "id", (), (
            ListOf("step", "steps", "id", (), (ListOf("step_node", "node_ids"),)),
        )),
    )),
)

SHREDDED = "record_id long, kind string, schema_path string, path string, parent_path string, position int, child_id string, fields map<string,string>"
_BATCH = 20_000


def _refuse(name: str):
    raise ValueError(name)


def parse(text: str | None):
    """The value of strict JSON text, or None."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


def _opened(value):
    """The value behind JSON written as a string, however often."""
    while isinstance(value, str) and value.lstrip()[:1] in ("[", "{", '"'):
        inner = parse(value)
        if inner is None:
            break
        value = inner
    return value


def _known(spec: ListOf) -> set[str]:
    return {spec.id_key} | {c.field for c in spec.children} | {w for c in spec.children for w in c.within[:1]}


def elements(value, spec: ListOf) -> list:
    """The elements of a list in any of its forms, in written order, without nulls."""
    value = _opened(value)
    if value is None:
        return []
    if isinstance(value, list):
        found = value
    elif isinstance(value, dict):
        if not value:
            return []
        single = spec.id_key is not None and (
            not _known(spec).isdisjoint(value) or any(x is not None and not isinstance(_opened(x), dict) for x in value.values())
        )
        found = [value] if single else list(value.values())
    else:
        found = [value]
    found = [x for x in found if x is not None]
    return [_opened(x) for x in found] if spec.id_key is not None else found


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def walk(payload, specs: tuple[ListOf, ...], with_fields: bool = True) -> Iterator[tuple]:
    """(kind, schema_path, path, parent_path, position, child_id, fields) of each element, parents first."""
    stack = [(payload, specs, "", "")]
    while stack:
        owner, lists, path, names = stack.pop()
        for spec in lists:
            held = owner
            for key in spec.within:
                held = _opened(held.get(key)) if isinstance(held, dict) else None
            if not isinstance(held, dict) or spec.field not in held:
                continue
            schema = f"{names}.{spec.field}" if names else spec.field
            for i, x in enumerate(elements(held[spec.field], spec)):
                at = f"{path}/{i}" if path else str(i)
                is_object = isinstance(x, dict)
                child = (_text(x.get(spec.id_key)) if is_object else "") if spec.id_key is not None else _text(x)
                fields = None
                if with_fields:
                    inner = {c.field for c in spec.children if not c.within} | {c.within[0] for c in spec.children if c.within}
                    fields = [(k, None if v is None else _text(v)) for k, v in x.items() if k not in inner] if is_object else []
                    if is_object:  # plain objects passed through lend their scalars
                        for w in sorted({c.within[0] for c in spec.children if c.within}):
                            via = _opened(x.get(w))
                            lists_in = {c.field for c in spec.children if c.within[:1] == (w,)}
                            if isinstance(via, dict):
                                fields += [(f"{w}.{k}", None if v is None else _text(v)) for k, v in via.items() if k not in lists_in]
                yield spec.kind, schema, at, path, i, child, fields
                if is_object and spec.children:
                    stack.append((x, spec.children, at, schema))


def shred(df: DataFrame, key: str = "record_id", payload: str = "payload", specs: tuple[ListOf, ...] = KNOWLEDGE_GRAPH, with_fields: bool = True) -> DataFrame:
    """All elements of all records in one long table (SHREDDED). key must be of a long type."""

    def run(batches):
        rows: list[tuple] = []
        schema = pa.schema([("record_id", pa.int64()), ("kind", pa.string()), ("schema_path", pa.string()), ("path", pa.string()), ("parent_path", pa.string()), ("position", pa.int32()), ("child_id", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])

        def flush():
            cols = list(zip(*rows)) if rows else [[]] * len(schema)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            for key_value, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = _opened(parse(text))
                if not isinstance(value, dict):
                    continue
                for row in walk(value, specs, with_fields):
                    rows.append((key_value, *row))
                    if len(rows) >= _BATCH:
                        yield flush()
                        rows.clear()
        if rows:
            yield flush()

    records = df.select(F.col(key).cast("long").alias("record_id"), F.col(payload).alias("payload")).dropDuplicates(["record_id", "payload"])
    return records.mapInArrow(run, SHREDDED)


def flat_table(shredded: DataFrame, kind: str, columns: dict[str, str] | list[str] = ()) -> DataFrame:
    """The flat table of one kind: key, path, parent_path, position, id and the named scalar fields as columns.
    columns: names, or name -> Spark type; a value that can't be cast is null."""
    typed = columns if isinstance(columns, dict) else {c: "string" for c in columns}
    return shredded.where(F.col("kind") == kind).select(
        "record_id", "path", "parent_path", "position", F.col("child_id").alias("id"),
        *[F.col("fields").getItem(c).try_cast(t).alias(c.replace(".", "_")) for c, t in typed.items()],
    )


#: Fields of each table of a knowledge-graph payload; lists of plain values come as their JSON text.
TABLES = {
    "node": {"type": "string", "label": "string", "summary": "string", "decision_context.last_changed": "string", "decision_context.change_frequency": "int", "decision_context.rationale_snippets": "string", "decision_context.pr_references": "string", "decision_context.changelog_entries": "string"},
    "commit": {"date": "string", "message": "string", "author": "string"},
    "author": {},
    "warning": {"severity": "string", "description": "string", "heuristic": "string"},
    "related": {},
    "domain": {"label": "string", "summary": "string", "entities": "string"},
    "flow": {"label": "string"},
    "step": {"label": "string", "weight": "double"},
    "step_node": {},
}


def flat_tables(df: DataFrame, **kwargs) -> dict[str, DataFrame]:
    """kind -> flat table, all from one shredding, which is written to the checkpoint folder so that payloads are read once."""
    shredded = cut(shred(df, **kwargs))
    return {kind: flat_table(shredded, kind, columns) for kind, columns in TABLES.items()}

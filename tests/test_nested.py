import json

import pytest

from loomgraph.operators import nested


def made(spark, payloads):
    return spark.createDataFrame([(i, p, "x") for i, p in payloads], "record_id long, payload string, kind string")


def found(spark, payloads):
    df = nested.shred(made(spark, payloads))
    return sorted((r.record_id, r.kind, r.path, r.child_id) for r in df.collect())


def test_every_list_form_gives_the_same_elements(spark):
    node = {"id": "n", "decision_context": {"commits": [{"sha": "a"}, None, {"sha": "b"}], "primary_authors": ["x", None, "y"]}}
    forms = [
        {"nodes": [node]}, {"nodes": node}, {"nodes": {"k0": node}}, {"nodes": json.dumps([node])}, {"nodes": [None, node, None]},
        {"nodes": [{**node, "decision_context": json.dumps(node["decision_context"])}]},
        {"nodes": [{"id": "n", "decision_context": {"commits": {"z0": {"sha": "a"}, "a1": {"sha": "b"}}, "primary_authors": {"1": "x", "0": "y"}}}]},
    ]
    want = [("author", "0/0", "x"), ("author", "0/1", "y"), ("commit", "0/0", "a"), ("commit", "0/1", "b"), ("node", "0", "n")]
    for form in forms:
        assert [r[1:] for r in found(spark, [(1, json.dumps(form))])] == want, form


def test_whole_tree_and_parents(spark):
    payload = {
        "nodes": [{"id": 7, "structural_warnings": [{"related_node_ids": ["p", "q"]}, {"category": "c", "related_node_ids": "r"}]}],
        "domains": [{"id": "d", "flows": [{"steps": [{"id": "s", "node_ids": []}, {"node_ids": ["u"]}]}]}],
    }
    df = nested.shred(made(spark, [(1, json.dumps(payload))]))
    got = {(r.kind, r.path): (r.child_id, r.parent_path) for r in df.collect()}
    assert got == {
        ("node", "0"): ("7", ""), ("warning", "0/0"): ("", "0"), ("warning", "0/1"): ("c", "0"), ("related", "0/0/0"): ("p", "0/0"),
        ("related", "0/0/1"): ("q", "0/0"), ("related", "0/1/0"): ("r", "0/1"), ("domain", "0"): ("d", ""), ("flow", "0/0"): ("", "0"),
        ("step", "0/0/0"): ("s", "0/0"), ("step", "0/0/1"): ("", "0/0"), ("step_node", "0/0/1/0"): ("u", "0/0/1"),
    }


@pytest.mark.parametrize("payload", [None, "", "{", '{"nodes": [{"id": "a"}', "[1]", "7", "null", '{"nodes": NaN}', "{}", '{"nodes": {}}', '{"nodes": []}'])
def test_payloads_without_elements(spark, payload):
    assert found(spark, [(1, payload)]) == []


def test_repeats_nulls_empty_and_long(spark):
    big = json.dumps({"nodes": [{"id": f"n{i}"} for i in range(30_000)]})
    assert len(found(spark, [(1, big), (1, big)])) == 30_000
    assert found(spark, [(None, '{"nodes": ["x"]}')]) == [(None, "node", "0", "")]
    assert found(spark, []) == []


def test_flat_table_casts(spark):
    payload = json.dumps({"domains": [{"id": "d", "flows": [{"id": "f", "steps": [{"id": "s", "weight": "0.5", "label": "l"}, {"id": "t", "weight": "x"}]}]}]})
    table = nested.flat_tables(made(spark, [(1, payload)]))["step"]
    assert [(r.id, r.parent_path, r.label, r.weight) for r in table.orderBy("path").collect()] == [("s", "0/0", "l", 0.5), ("t", "0/0", None, None)]

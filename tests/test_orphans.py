from datetime import datetime as dt

from loomgraph.operators import orphans

NODES = "project string, id string, recorded_at timestamp, removed_at timestamp, value string"
EDGES = "edge_id long, project string, source string, target string, recorded_at timestamp, key string"
LAYERS = "id string, project string, node_ids array<string>, recorded_at timestamp"


def run(spark, nodes, edges, layers, hot=None):
    n, e, y = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(layers, LAYERS)
    df = orphans.orphans(orphans.graph_references(e, y), orphans.validity(n, "project", orphans.canonical_id("id"), "recorded_at", "removed_at"), hot)
    return sorted(tuple(r) for r in df.collect())


def t(month):
    return dt(2024, month, 1)


def test_missing_late_deleted_and_doubled_prefix(spark):
    nodes = [("p", "file:file:a", t(3), None, ""), ("p", "file:a", t(2), None, ""), ("p", "file:gone", t(1), t(5), ""), ("q", "file:b", t(1), None, ""), (None, None, None, None, None)]
    edges = [(1, "p", "file:a", "file:gone", t(5), "k"), (1, "p", "file:a", "file:gone", t(5), "k"), (2, "p", "file:file:a", "file:b", t(1), "k"), (3, "p", None, "", t(1), "k"), (4, "p", "file:gone", "file:a", t(4), "k")]
    layers = [("l", "p", ["file:a", "x", "x", None, ""], t(4)), ("m", "q", None, t(4)), ("n", "q", [], None)]
    want = [
        ("edges", "p", "1", "target", "file:gone", "deleted", "2024-05"), ("edges", "p", "2", "source", "file:file:a", "late", "2024-01"),
        ("edges", "p", "2", "target", "file:b", "missing", "2024-01"), ("layers", "p", "l", "node_ids", "x", "missing", "2024-04"),
    ]
    assert run(spark, nodes, edges, layers) == want
    assert run(spark, nodes, edges, layers, hot=2) == want  # every repeated key salted


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [], [(1, "p", "a", "b", None, "k")], []) == [("edges", "p", "1", "source", "a", "missing", None), ("edges", "p", "1", "target", "b", "missing", None)]

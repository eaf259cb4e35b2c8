from loomgraph.operators.components import connected_components


def run(spark, edges, schema="a long, b long"):
    return {r.node: r.component for r in connected_components(spark.createDataFrame(edges, schema)).collect()}


def test_paths_stars_cycles_and_loops(spark):
    assert run(spark, [(i, i + 1) for i in range(12)] + [(20, 21), (21, 20), (30, 30), (None, 5)]) == {**{i: 0 for i in range(13)}, 20: 20, 21: 20, 30: 30}
    assert run(spark, [(9, i) for i in range(5)]) == {i: 0 for i in (*range(5), 9)}
    assert run(spark, []) == {}


def test_string_nodes(spark):
    assert run(spark, [("b", "a"), ("c", "b")], "a string, b string") == {"a": "a", "b": "a", "c": "a"}

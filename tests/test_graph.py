import pytest

from loomgraph.operators import graph, merge, risk, smells, traversal

NODES = "project string, id string, node_type string, label string, file string, layer string, complexity string, risk_score double, summary string, metadata map<string,string>, structural_warnings array<string>, end_line int, ord long"
EDGES = "edge_id long, project string, source string, target string, edge_type string, weight double, ord long"


def made(spark, ids, pairs, kind="imports", **over):
    nodes = [("p", i, over.get("node_type", "file"), i.split(":")[-1], i.split(":")[-1], None, "simple", None, None, None, None, 10, k) for k, i in enumerate(ids)]
    edges = [(k, "p", a, b, t[0] if t else kind, None, k) for k, (a, b, *t) in enumerate(pairs)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect())


def test_normalize(spark):
    v, e = made(spark, ["file:a", "file:file:a", "file:a.test.ts", "file:b"], [("file:a", "file:b"), ("file:file:a", "file:b"), ("file:a", "file:gone"), (None, "file:a"), ("", "file:a"), ("file:a", "file:a.test.ts", "tested_by")])
    n, m = graph.normalize(v, e)
    assert ids(n, "id", "ord") == [("file:a", 1), ("file:a.test.ts", 2), ("file:b", 3)]
    assert ids(m, "source", "target", "edge_type", "ord") == [("file:a", "file:b", "imports", 0), ("file:a.test.ts", "file:a", "tested_by", 5)]
    r = graph.normalization_report(v, e).first()
    assert (r.double_prefix, r.deduped_nodes, r.deduped_edges, r.dangling_edges, r.tested_by_fixed) == (1, 1, 1, 1, 1)
    again = graph.normalize(n.select(*v.columns), m.select(*e.columns))[1]
    assert ids(again, "source", "target") == ids(m, "source", "target")


def test_degrees_neighbors_and_loops(spark):
    v, e = made(spark, ["a", "b", "c"], [("a", "b"), ("a", "a"), ("b", "a", "calls")])
    assert ids(graph.degrees(v, e), "id", "in_degree", "out_degree", "degree") == [("a", 2, 2, 4), ("b", 1, 1, 2), ("c", 0, 0, 0)]
    assert ids(graph.neighbors(e, v.where("id = 'a'")), "neighbor", "direction") == [("a", "out"), ("b", "in"), ("b", "out")]
    assert ids(graph.orphan_nodes(v, e), "id") == ["c"]
    assert graph.incident_edges(e, v.where("id = 'a'")).count() == 3


def test_resolution_tiers(spark):
    v, _ = made(spark, ["file:src/a.ts", "file:lib/a.ts", "x"], [])
    asked = spark.createDataFrame([("p", x) for x in ("file:src/a.ts", "src/a.ts", "a.ts", "file:x", "zz")], "project string, asked string")
    assert ids(graph.resolve_ids(v, asked), "asked", "id") == [("a.ts", "file:src/a.ts"), ("file:src/a.ts", "file:src/a.ts"), ("file:x", "x"), ("src/a.ts", "file:src/a.ts")]


def test_reach_impact_and_paths(spark):
    v, e = made(spark, list("abcdef"), [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "e")])
    assert ids(traversal.reachable(e, v.where("id = 'a'")), "id", "depth") == [("b", 1), ("c", 2)]
    hit = traversal.diff_impact(v, e, v.where("id = 'c'"))
    assert ids(hit, "id", "depth", "path") == [("a", 2, "c > b > a"), ("b", 1, "c > b"), ("d", 1, "c > d")]
    pairs = spark.createDataFrame([("p", "d", "a"), ("p", "d", "d"), ("p", "d", "e")], "project string, start string, goal string")
    assert ids(traversal.shortest_paths(e, pairs), "start", "goal", "n_edges", "path") == [("d", "a", 2, "d > c > a"), ("d", "d", 0, "d")]
    assert traversal.shortest_paths(e, pairs, max_depth=1).where("goal = 'a'").count() == 0


def test_blast_counts_itself_on_a_cycle(spark):
    v, e = made(spark, list("abcd"), [("a", "b"), ("b", "a"), ("c", "a"), ("c", "a")])
    exact = ids(traversal.blast_radius(v, e), "id", "n_dependents", "blast")
    assert exact == [("a", 3, 0.75), ("b", 3, 0.75), ("c", 0, 0.0), ("d", 0, 0.0)]
    assert ids(traversal.blast_radius_approx(v, e), "id", "n_dependents", "blast") == exact


def test_cycles(spark):
    _, e = made(spark, [], [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "a")])
    assert ids(traversal.simple_cycles(e), "n", "cycle") == [(2, ["a", "b"]), (3, ["a", "b", "c"])]
    assert traversal.simple_cycles(e, longest=2).count() == 1
    found = smells.circular_dependencies(e)
    assert ids(found.where("node_id = 'a'"), "heuristic", "severity") == [("cycle_length = 2", "high"), ("cycle_length = 3", "high")]


def test_topological_levels(spark):
    _, e = made(spark, [], [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")])
    assert ids(traversal.topological_levels(e), "id", "level") == [("a", 0), ("b", 1), ("c", 2)]
    assert traversal.topological_levels(e.limit(0)).count() == 0


def test_fan_in_is_risky_and_tested_leaf_is_not(spark):
    names = ["hub", *[f"n{i}" for i in range(30)]]
    v, e = made(spark, names, [(f"n{i}", "hub") for i in range(30)])
    scores = {r.id: r for r in risk.risk_scores(v, e, traversal.blast_radius(v, e)).collect()}
    assert scores["hub"].risk > 0.7 and "no_test_coverage" in scores["hub"].factors and scores["n1"].risk < 0.2
    v, e = made(spark, ["leaf", "leaf.test.ts"], [("leaf.test.ts", "leaf", "tested_by")])
    leaf = risk.risk_scores(v, e, traversal.blast_radius(v, e)).collect()
    assert [r.id for r in leaf] == ["leaf"] and leaf[0].test_gap == 0 and leaf[0].risk < 0.3


def test_smells(spark):
    many = [f"t{i}" for i in range(32)]
    v, e = made(spark, ["god", "main.ts", "lone", *many], [("god", t) for t in many])
    assert ids(smells.god_nodes(v, e), "node_id") == ["god"] and ids(smells.over_connected(v, e), "node_id") == ["god"]
    assert ids(smells.orphan_files(v, e), "node_id") == ["lone"]
    v, e = made(spark, ["a", "b", "x", "y", "z", "w"], [(s, t) for s in "ab" for t in "xyzw"])
    assert ids(smells.unclear_coupling(v, e), "node_id", "related_node_ids") == [("a", ["b"])]
    v, e = made(spark, ["f", "g", "c1", "c2"], [(c, f, "calls") for c in ("c1", "c2") for f in "fg"], node_type="function")
    assert ids(smells.duplicate_logic(v, e), "node_id", "severity") == [("f", "medium"), ("g", "medium")]


@pytest.mark.parametrize("n,orphans,circular,god,security,score,letter", [(10, 0, 0, 0, 0, 100, "A"), (10, 1, 0, 0, 0, 90, "A"), (10, 2, 1, 0, 0, 75, "C"), (10, 10, 9, 9, 9, 25, "F"), (0, 0, 0, 0, 0, 100, "A"), (100, 0, 2, 1, 0, 87, "B")])
def test_health(spark, n, orphans, circular, god, security, score, letter):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[c.alias(k) for k, c in risk.health_score(*[F.lit(x) for x in (n, orphans, circular, god, security)]).items()]).first()
    assert (row.score, row.grade) == (score, letter)


def test_layers_and_integrity(spark):
    v, e = made(spark, ["file:config/x.ts", "file:views/page.ts"], [("file:config/x.ts", "file:views/page.ts"), ("file:config/x.ts", "file:gone"), ("file:config/x.ts", "file:config/x.ts", "odd")])
    assert ids(smells.path_layers(v), "layer") == ["config", "ui"]
    assert ids(smells.layer_violations(e, smells.path_layers(v)), "node_id", "severity") == [("file:config/x.ts", "high")]
    layers = spark.createDataFrame([("l", "L", ["file:views/page.ts", "nope", None], "p"), ("m", None, None, "p")], "id string, layer_name string, node_ids array<string>, project string")
    rules = {(r.rule, r.subject): r.n for r in risk.integrity_issues(v, e, layers).collect()}
    assert rules == {("unknown_edge_type", "odd"): 1, ("missing_endpoint", "file:gone"): 1, ("self_edge", "file:config/x.ts"): 1, ("file_without_summary", "all"): 2, ("layer_missing_node", "l"): 1}
    kept, mended = risk.repaired(v, e, layers)
    assert kept.count() == 1 and ids(mended, "layer_id", "node_ids") == [("l", ["file:views/page.ts"]), ("m", [])]


def test_merging(spark):
    v, e = made(spark, ["a", "b"], [("a", "b")])
    nodes, edges = merge.merge_packages({"x": (v, e), "y": (v, e)}, "all")
    assert ids(nodes, "id") == ["x:a", "x:b", "y:a", "y:b"] and edges.count() == 2
    newer = v.withColumn("label", v.id.substr(1, 0))
    assert ids(merge.merge_passes(v, newer.where("id = 'a'"), ["project", "id"]), "label") == ["", "b"]
    assert ids(merge.keep_enrichment(v, v.selectExpr("project", "id", "'kept' as summary").where("id = 'a'"), ["summary"]).fillna("new", ["summary"]), "summary") == ["kept", "new"]


def test_empty_graph(spark):
    v, e = made(spark, [], [])
    n, m = graph.normalize(v, e)
    assert n.count() == m.count() == 0
    assert traversal.reachable(e, v).count() == traversal.blast_radius(v, e).count() == traversal.simple_cycles(e).count() == 0
    assert graph.treemap(v).count() == graph.path_tree(v).count() == 0


def test_blast_radius_approx_follows_long_paths(spark):
    v = spark.range(71).selectExpr("'p' as project", "cast(id as string) as id")
    e = spark.range(70).selectExpr("'p' as project", "cast(id as string) as source", "cast(id + 1 as string) as target", "'imports' as edge_type")
    got = {r.id: r.n_dependents for r in traversal.blast_radius_approx(v, e).collect()}
    assert got["0"] == 0 and got["1"] == 1 and 68 <= got["70"] <= 72


def test_blast_radius_lists_no_pairs(spark, monkeypatch):
    """A cycle of 3,000 nodes with a tail of 1,000: 13 million pairs, 4,000 rounds of joins."""

    def written(df):
        raise AssertionError("pairs are written")

    monkeypatch.setattr(traversal, "cut", written)
    v = spark.range(4000).selectExpr("'p' as project", "cast(id as string) as id")
    e = spark.range(4000).selectExpr("'p' as project", "cast(id as string) as source", "cast(if(id = 2999, 0, id + 1) as string) as target", "'imports' as edge_type").where("source <> '3999'")
    got = {int(r.id): r.n_dependents for r in traversal.blast_radius(v, e.unionByName(e.where("source = '5'").selectExpr("project", "source", "'3000' as target", "edge_type"))).collect()}
    assert got == {i: 3000 if i < 3001 else i for i in range(4000)}


def test_blast_radius_of_large_projects_is_the_same(spark, monkeypatch):
    ids_ = [f"n{i}" for i in range(40)]
    pairs = [(f"n{i}", f"n{(7 * i + k) % 40}") for i in range(0, 40, 3) for k in (1, 5)] + [("n3", "n3"), ("n0", "n1"), ("n0", "n1")]
    v, e = made(spark, ids_, pairs)
    v, e = v.unionByName(v.where("id < 'n2'").selectExpr("'q' as project", *v.columns[1:])), e.unionByName(e.where("source < 'n2'").selectExpr("edge_id", "'q' as project", *e.columns[2:]))
    columns = ("project", "id", "n_dependents", "blast")
    whole = ids(traversal.blast_radius(v, e), *columns)
    monkeypatch.setattr(traversal, "WHOLE_EDGES", 20)
    assert whole == ids(traversal.blast_radius(v, e), *columns) and len({r[2] for r in whole}) > 5


@pytest.mark.parametrize("bits", [1, 2**20])
def test_dependents_counted_in_blocks(bits):
    import random

    pick = random.Random(3)
    for n in (1, 2, 30, 200):
        pairs = [(pick.randrange(n), pick.randrange(n)) for _ in range(n + n // 4)]
        reach = {i: {d for u, d in pairs if u == i} for i in range(n)}
        for _ in range(n):
            reach = {i: r.union(*(reach[d] for d in r)) for i, r in reach.items()}
        assert traversal.dependent_counts(n, *zip(*pairs), bits) == [sum(i in r for r in reach.values()) for i in range(n)]


@pytest.mark.parametrize("hot_rows", [200_000, 3])
def test_plain_edges_are_the_normalised_ones(spark, hot_rows):
    pairs = [("file:a", "file:b"), ("file:file:a", "file:b"), ("file:a", "file:gone"), (None, "file:a"), ("", "file:a"), ("file:a", "file:a.test.ts", "tested_by"), ("file:a.test.ts", "file:a", "tested_by")]
    v, e = made(spark, ["file:a", "file:file:a", "file:a.test.ts", "file:b"], [*pairs, *[(f"file:{x}", "file:b", "calls") for x in ("a", "b", "a")]])
    n, m = graph.normalize(v, e)
    columns = ("project", "source", "target", "edge_type")
    assert ids(graph.plain_edges(e, n, None, hot_rows), *columns) == ids(m, *columns)
    assert ids(graph.plain_edges(e, n, ("calls",), hot_rows), *columns) == ids(m.where("edge_type = 'calls'"), *columns)


def test_short_cycles_are_met_without_a_list(spark, monkeypatch):
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    pairs = [*ring, ("a", "b"), ("b", "a"), ("b", "r0"), ("d", "d"), ("r2", "x"), ("x", "r0"), *[(f"s{i}", f"s{(i + 1) % 6}") for i in range(6)], ("s0", "t"), ("u", "s0")]
    _, e = made(spark, [], [*pairs, ("r6", "r5", "calls"), ("d", "a", "depends_on"), ("a", "d", "depends_on")])
    listed = {i for c in ids(traversal.simple_cycles(e), "cycle") for i in c}
    with monkeypatch.context() as m:
        m.setattr(traversal, "WHOLE_EDGES", 1)
        assert ids(traversal.on_short_cycles(e), "id") == sorted(listed)

    def written(df):
        raise AssertionError("cycles are written")

    monkeypatch.setattr(traversal, "cut", written)
    assert ids(traversal.on_short_cycles(e), "id") == sorted(listed) == sorted(["a", "b", "d", "r0", "r1", "r2", "x", *[f"s{i}" for i in range(6)]])


@pytest.mark.parametrize("bits", [1, 2**20])
def test_short_cycles_in_blocks(bits):
    import random

    pick = random.Random(5)
    for n, longest in ((2, 2), (40, 3), (300, 6)):
        pairs = [(pick.randrange(n), pick.randrange(n)) for _ in range(n + n // 2)]
        after = {i: {d for u, d in pairs if u == i != d} for i in range(n)}
        want = set()
        for v in range(n):
            at = {v}
            for _ in range(longest):
                at = {d for u in at for d in after[u]}
                want |= at & {v}
        got = traversal.short_cycle_nodes(n, *zip(*pairs), longest, bits)
        assert sorted(got) == sorted(want)

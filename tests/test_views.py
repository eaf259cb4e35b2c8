"""Views of the graph against hand-made tables."""

from loomgraph.operators import extract, smells, views

V = "project string, id string, label string, node_type string, complexity string, metadata map<string,string>, ord long, risk_score double"
E = "project string, source string, target string, edge_type string, ord long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges(spark, pairs, kind):
    return spark.createDataFrame([("p", a, b, kind, i) for i, (a, b) in enumerate(pairs)], E)


def test_calls_over_imports(spark):
    """Internal first, else the exported function of the imported file that is first; unused is neither called nor exported."""
    calls = spark.createDataFrame([("p", "a.ts", "run", "load", 2), ("p", "a.ts", "run", "save", 3), ("p", "a.ts", "run", "hide", 1), ("p", "a.ts", "run", "run", 9), ("p", "b.ts", "load", "load", 1)], "project string, path string, caller string, callee string, n long")
    symbols = spark.createDataFrame(
        [("p", "a.ts", "function", "run", False), ("p", "a.ts", "function", "load", False), ("p", "b.ts", "function", "save", True), ("p", "c.ts", "function", "save", True), ("p", "b.ts", "function", "hide", False), ("p", "b.ts", "function", "load", True)],
        "project string, path string, kind string, name string, exported boolean",
    )
    targets = spark.createDataFrame([("p", "a.ts", "./b", "b.ts"), ("p", "a.ts", "./c", "c.ts")], "project string, path string, raw string, target string")
    resolved = extract.resolve_calls(calls, symbols, targets)
    assert {(r.callee, r.to_path, r.internal) for r in resolved.where("path = 'a.ts'").collect()} == {("load", "a.ts", True), ("save", "b.ts", False), ("run", "a.ts", True)}
    got = rows(views.call_metadata(resolved, symbols.select("project", "path", "name", "exported")))
    assert got == [("p", "a.ts", "load", 0, 0, 1, False), ("p", "a.ts", "run", 2, 3, 0, True), ("p", "b.ts", "save", 0, 0, 1, False)]


def test_tours(spark):
    steps = spark.createDataFrame([("p", "t", 0, ["file:a"]), ("p", "t", 1, ["file:file:b", "file:a"]), ("p", "t", 2, ["gone"]), ("p", "u", 0, ["file:a"]), ("p", "u", 1, ["gone"]), ("p", "w", 0, None)], "project string, tour_id string, pos int, node_ids array<string>")
    nodes = spark.createDataFrame([("p", "file:a"), ("p", "file:b")], "project string, id string")
    assert rows(views.tour_issues(steps, nodes)) == [("p", "t", "gone"), ("p", "u", "gone")]
    assert [(r[0], r[1], r[2]) for r in rows(views.repaired_tours(steps, nodes))] == [("p", "t", 0), ("p", "t", 1)]
    assert ("p", "file:a", 2) in rows(views.tour_counts(steps)) and views.tour_counts(steps.limit(0)).count() == 0


def test_sizes_scales_and_lists(spark):
    nodes = spark.createDataFrame([("p", x) for x in "abc"] + [("q", "z")], "project string, id string")
    e = edges(spark, [("a", "b"), ("c", "b"), ("a", "c")], "imports")
    assert rows(views.node_sizes(nodes, e)) == [("p", "a", 5.0), ("p", "b", 20.0), ("p", "c", 12.5), ("q", "z", 8.0)]
    df = spark.createDataFrame([("p", 1.0), ("p", 3.0), ("p", 2.0), ("q", 7.0), ("q", 7.0), ("q", None)], "g string, v double")
    assert [tuple(r) for r in views.scaled(df, ["g"], "v").orderBy("g", "v").collect()] == [("p", 1.0, 0.0), ("p", 2.0, 0.5), ("p", 3.0, 1.0), ("q", None, None), ("q", 7.0, 0.0), ("q", 7.0, 0.0)]
    many = edges(spark, [("hub", f"n{i:02d}") for i in range(30)], "calls")
    shown = views.link_lists(many, spark.createDataFrame([("p", "hub")], "project string, id string")).collect()
    assert sorted(r.other for r in shown) == [f"n{i:02d}" for i in range(12)]


def test_shapes_and_search(spark):
    issues = spark.createDataFrame([("p", "nodes.3.id", "Required"), ("p", "nodes.14.id", "Required"), ("p", "", "Bad"), ("p", "x.1", "A"), ("p", "y", "B")], "project string, path string, message string")
    assert [tuple(r) for r in views.issue_shapes(issues).orderBy("rank").collect()] == [("p", "nodes.[].id: Required", 2, 1), ("p", "<root>: Bad", 1, 2), ("p", "x.[]: A", 1, 3)]
    nodes = spark.createDataFrame([("p", "1", "src/Main.ts"), ("p", "2", None)], "project string, id string, file string")
    assert rows(views.file_search(nodes, "MAIN")) == [("p", "1", "src/Main.ts")] and views.file_search(nodes, "").count() == 1
    n, e = views.domain_graph(spark.createDataFrame([("p", "core", "f1"), ("p", "core", "f2"), ("p", "ui", None)], "project string, domain string, flow_id string"))
    assert n.count() == 4 and rows(e) == [("p", "domain:core", "flow:f1"), ("p", "domain:core", "flow:f2")]


def test_planted_smells(spark):
    """Rows for the smells of which the test tables hold none."""
    f = lambda i, kind="function", complexity=None: ("p", i, i, kind, complexity, {"param_count": "2"}, 1, None)
    nodes = spark.createDataFrame([f("x", complexity="simple"), f("y"), f("z", complexity="complex"), f("c1"), f("c2"), f("big", "file")] + [f(f"m{k}") for k in range(26)] + [f(f"d{k}", "file") for k in range(21)], V)
    calls = edges(spark, [("c1", "x"), ("c1", "y"), ("c2", "x"), ("c2", "y"), ("c1", "z"), ("c2", "z")], "calls")
    assert {(r.node_id, tuple(r.related_node_ids)) for r in smells.duplicate_logic(nodes, calls).collect()} == {("x", ("y",)), ("y", ("x",))}  # null counts as simple
    held = edges(spark, [("big", f"m{k}") for k in range(26)], "contains").unionByName(edges(spark, [("big", f"d{k}") for k in range(21)], "imports"))
    assert sorted(r.heuristic for r in smells.god_nodes(nodes, held).collect()) == ["function_count > 25", "out_degree > 20"]
    shared = [(a, t) for a in ("d0", "d1") for t in ("d2", "d3", "d4", "d5")] + [("d6", t) for t in ("d2", "d7", "d8", "d9")]
    assert {(r.node_id, r.related_node_ids[0]) for r in smells.unclear_coupling(nodes, edges(spark, shared, "imports")).collect()} == {("d0", "d1")}
    same = spark.createDataFrame([("p", f"function:{k}", "Parse ", "function", f"f{k}") for k in range(3)], "project string, id string, label string, node_type string, file string")
    assert smells.name_duplicates(same).count() == 3
    spread = edges(spark, [("big", f"m{k}") for k in range(6)], "contains")
    domain = spark.createDataFrame([("p", f"m{k}", f"dom{k % 3}") for k in range(6)], "project string, id string, domain string")
    assert [r.node_id for r in smells.low_cohesion(spread, domain).collect()] == ["big"]


def test_closings_against_a_scan():
    import random

    def scan(text, start):
        depth, opened = 0, False
        for i, line in enumerate(text.split("\n")[start - 1 :], start):
            for c in line:
                depth += (c == "{") - (c == "}")
                opened |= c == "{"
                if c == "}" and opened and depth == 0:
                    return i
        return None

    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choice("{}a\n") for _ in range(r.randrange(40)))
        n, ends = extract.closings(text)
        assert n == text.count("\n") + 1 and [ends(k) for k in range(1, n + 1)] == [scan(text, k) for k in range(1, n + 1)]


def test_overlaps_against_all_pairs(spark):
    """Prefixes lose no pair, though one item is held by all."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(2)
    sets = {i: {"all", *(f"t{r.randrange(30)}" for _ in range(r.randrange(3, 12)))} for i in range(60)}
    df = spark.createDataFrame([("p", f"n{i:02d}", t) for i, s in sets.items() for t in s], "project string, id string, item string")
    got = {(r.a, r.b): r.k for r in smells.overlapping(df, ["project"], F.floor(F.col("n") * F.lit(0.4)) + 1).where("k / greatest(na, nb) > 0.4").collect()}
    want = {(f"n{a:02d}", f"n{b:02d}"): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > 0.4 * max(len(sets[a]), len(sets[b])) + 1e-9}
    assert got == want and want


def test_lessons_have_confidence(spark):
    df = spark.createDataFrame([("p", "a.ts", "typescript", "await a\nawait b\n"), ("p", "b.ts", "typescript", "await a\n" * 4), ("p", "c.py", "python", "x = 1")], "project string, path string, lang_name string, content string")
    assert {(r.path, r.lesson, r.confidence) for r in extract.language_lessons(df).collect()} == {("a.ts", "async_await", "medium"), ("b.ts", "async_await", "high")}

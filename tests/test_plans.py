import pytest

from loomgraph.plans import build, tools
from loomgraph.session import table

FILES = "project string, path string, lang_name string, content string, size_lines int"


@pytest.fixture(scope="module")
def built(spark):
    rows = [("p", "src/core/index.ts", None, "import { b } from './b';\nexport function main() {\n  b();\n}\n", 4), ("p", "src/core/b.ts", None, "import c from './c';\nexport function b() { return 1; }\n", 2), ("p", "src/core/c.ts", None, "import i from './index';\nexport class C {\n}\n", 3), ("p", "src/core/b.test.ts", None, "import { b } from './b';", 1), ("p", "conf.yaml", None, "a: 1", 1)]
    v, e = build.skeleton(spark.createDataFrame(rows, FILES))
    commits = spark.createDataFrame([(i, "p", "src/core/b.ts", "s", f"2024-01-{i:02d}T00:00:00Z", "m", "A", i) for i in range(1, 9)], "commit_id long, project string, file string, sha string, commit_date string, message string, author string, ord long")
    return build.analyse(v, e, commits)


def test_build_end_to_end(built):
    assert not built.problems
    assert {r.id for r in built.nodes.collect()} >= {"file:src/core/index.ts", "function:src/core/index.ts:main", "class:src/core/c.ts:C", "file:conf.yaml"}
    kinds = {(r.source.split("/")[-1], r.target.split("/")[-1]) for r in built.edges.where("edge_type = 'imports'").collect()}
    assert kinds == {("index.ts", "b.ts"), ("b.ts", "c.ts"), ("c.ts", "index.ts"), ("b.test.ts", "b.ts")}
    assert [r.n for r in built.tables["cycles"].collect()] == [3]
    scores = {r.id: r for r in built.tables["risk"].collect()}
    assert all(0 <= r.risk <= 1 for r in scores.values()) and "file:conf.yaml" not in scores and "file:src/core/b.test.ts" not in scores
    assert {"single_author", "recent_churn"} <= set(scores["file:src/core/b.ts"].factors)
    assert [r.pos for r in built.tables["tours"].orderBy("pos").collect()] == [1, 2, 3]
    flow = build.domains(built.nodes, built.edges).orderBy("step_no").collect()
    assert len(flow) == 4 and flow[0].weight == 0 and flow[-1].weight == 1


def test_calls_domains_and_security(spark):
    index = "import { b } from './b';\nexport function main() {\n  b(); b(); own('" + "x" * 20_000 + "'); main();\n}\nfunction own() {\n  eval(a);\n}\n"
    rows = [("p", "src/core/index.ts", None, index, 7), ("p", "src/core/b.ts", None, "export function b() { return hidden(); }\nfunction own() { return 1; }\n", 2), ("p", "src/core/c.ts", None, "function hidden() { return b(); }\n", 1), ("p", "a.yaml", None, "eval(x)", 1)]
    files = spark.createDataFrame(rows, FILES)
    v, e = build.skeleton(files)
    calls = {(r.source, r.target, r.weight) for r in e.where("edge_type = 'calls'").collect()}
    main = "function:src/core/index.ts:main"
    assert calls == {(main, "function:src/core/b.ts:b", 2.0), (main, "function:src/core/index.ts:own", 1.0)}
    place = [("p", r.id, "d" + r.label) for r in v.where("node_type = 'function'").collect()]
    extra = spark.createDataFrame([("p", "function:src/core/index.ts:third", "dz")] + place, "project string, id string, domain string")
    e = e.unionByName(spark.createDataFrame([("p", "file:src/core/index.ts", "function:src/core/index.ts:third", "contains")], "project string, source string, target string, edge_type string"), allowMissingColumns=True)
    got = build.analyse(v, e, files=files, domain_of=extra)
    assert not got.problems
    assert [(r.id, r.category, r.line) for r in got.tables["security"].collect()] == [("file:src/core/index.ts", "unsafe_eval", 6)]
    assert got.tables["domains"].count() == 3
    # main, own and third lie in three domains
    place = {r.node_id for r in got.tables["smells"].where("category = 'low_cohesion'").collect()}
    assert place == {"file:src/core/index.ts"}


def test_duplicate_logic_of_called_functions(spark):
    callers = "".join(f"export function c{i}() {{\n  a();\n  b();\n}}\n" for i in range(6))
    v, e = build.skeleton(spark.createDataFrame([("p", "src/x.ts", None, callers + "function a() {\n}\nfunction b() {\n}\n", 28)], FILES))
    found = build.analyse(v, e).tables["smells"].where("category = 'duplicate_logic'").collect()
    assert {r.node_id.split(":")[-1] for r in found} == {"a", "b"}


def test_tools(spark, built, tmp_path):
    v = built.nodes.selectExpr("*", "cast(null as double) as risk_score", "cast(null as string) as summary")
    layers_of = v.selectExpr("project", "id", "'core' as layer")
    detail = tools.node(v, built.edges, layers_of, "p", "b.ts")
    assert detail["neighbors"].count() == 4 and detail["layer_mates"].count() == v.count() - 1
    assert {r.label for r in tools.diff_impact(v, built.edges, "p", ["core/c.ts"]).collect()} == {"b.ts", "index.ts", "b.test.ts"}
    assert tools.query(v, "main").first().label == "main"
    steps = built.tables["tours"].selectExpr("project", "'t' as tour_id", "pos", "id")
    assert tools.tour(steps, v, "p", persona="senior").count() == 2
    for call, code in ((lambda: tools.node(v, built.edges, layers_of, "p", "zzz"), "NODE_NOT_FOUND"), (lambda: tools.diff_impact(v, built.edges, "p", []), "INVALID_INPUT"), (lambda: tools.query(v, " "), "INVALID_INPUT"), (lambda: tools.tour(steps, v, "p", "x"), "TOUR_NOT_FOUND"), (lambda: tools.tour(steps, v, "q"), "NO_TOURS"), (lambda: tools.respond(spark, str(tmp_path), ""), "MISSING_RESPONSE")):
        with pytest.raises(tools.ToolError) as e:
            call()
        assert e.value.code == code
    note = tools.annotate(spark, str(tmp_path / "n"), v, "p", "b.ts", "because")
    why = tools.why(v, built.tables["decision_context"], note, "p", "b.ts").first()
    assert why.annotation == "because" and why.primary_authors == ["A"] and why.change_frequency == 8


def test_oracle_names_are_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 90


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_queries_run_on_the_smallest_tables(spark, sf):
    import __spark_entry__ as e

    for name in ("p1_table_counts", "p5_counts", "degree_topk", "layer_edge_matrix", "source_imports", "scan_summary", "author_frequency", "tumbling_counts"):
        assert e.queries()[name](spark, sf).count() > 0, name
    assert table(spark, sf, "nodes").count() > 0

import json
import os
from datetime import datetime as dt

import pytest

from loomgraph.sources import files as tree
from loomgraph.sources import render, stores
from loomgraph.streaming import changes


def test_scan_tree(spark, tmp_path):
    for name, text in {"src/a.ts": "import x from './b';\n", "src/b.ts": "x", "node_modules/m/i.js": "no", "package.json": '{"name": "demo", "dependencies": {"react": "1"}}', ".hidden.py": "x = 1", "big.txt": "y" * 200}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "bin.dat").write_bytes(b"\xff\xfe\x00")
    df = tree.scan_tree(spark, str(tmp_path), "p", max_bytes=100)
    found = {r.path: r for r in df.collect()}
    assert set(found) >= {"src/a.ts", "src/b.ts", "package.json"} and not set(found) & {"node_modules/m/i.js", "big.txt", "bin.dat"}
    assert found["src/a.ts"].lang_name == "typescript" and found["package.json"].file_category == "config"
    assert tree.project_names(df).first()["name"] == "demo"
    assert {r.framework for r in tree.frameworks(df).collect()} == {"node", "react"}
    assert tree.scan_summary(df).first().size_class == "small" and tree.file_nodes(df).count() == df.count()


def test_globs_and_workspaces(tmp_path):
    import re

    assert re.match(tree.glob_regex("**/dist/**"), "a/dist/b/c") and not re.match(tree.glob_regex("**/*.pyc"), "a.py")
    assert tree.ignore_lines("# c\n\n/abs\n../up\nlogs/\n*.tmp") == ["**/logs/**", "**/*.tmp", "**/*.tmp/**"]
    os.makedirs(tmp_path / "packages/one")
    (tmp_path / "pnpm-workspace.yaml").write_text("packages:\n  - 'packages/*'\nother: 1\n")
    assert tree.workspaces(str(tmp_path)) == ["packages/one"]


def test_graph_store(spark, tmp_path):
    path = tmp_path / "g.json"
    loader = stores.GraphLoader(spark, str(path))
    assert loader.get() is None and loader.problem == "GRAPH_NOT_FOUND"
    path.write_text(json.dumps({"project_name": "p", "nodes": [{"id": "a", "type": "file", "label": "a"}], "edges": [], "layers": []}))
    g = loader.get()
    assert g["nodes"].count() == 1 and loader.get() is g
    path.write_text("{")
    os.utime(path, (1, 1))
    assert loader.get() is None and loader.problem == "GRAPH_INVALID"


def test_stores(spark, tmp_path):
    snap = spark.createDataFrame([("p", dt(2024, 1, d), d) for d in range(1, 8)], "project string, at timestamp, n int")
    assert sorted(r.n for r in stores.append_history(snap, str(tmp_path / "h"), kept=3).collect()) == [5, 6, 7]
    note = stores.annotate(spark, str(tmp_path / "a"), "p", "file:x/y", " hello ", ["t"], dt(2024, 1, 1))
    assert note.first().file_name == "file-x-y.md" and "hello" in stores.annotation_markdown(note).first().text
    newer = spark.createDataFrame([("p", "file:x/y", dt(2024, 2, 1))], "project string, node_id string, last_changed timestamp")
    assert stores.stale_annotations(note, newer).count() == 1
    assert stores.respond(spark, str(tmp_path / "r"), " yes ").first().response == "yes"
    log = tmp_path / "log"
    log.write_text("0123456789|a@x|2024-01-01|one | two\nbad\n")
    assert stores.git_log(spark, str(log), "p").collect()[0].message == "one | two"
    log.write_text("COMMIT_START|0123456789|a|2024|s\nbody\ndiff --git a b\n+x\nCOMMIT_START|1123456789|b|2024|t\n")
    rows = {r.sha: r for r in stores.git_log_with_diffs(spark, str(log), "p").collect()}
    assert rows["0123456"].body == "body" and "diff --git" in rows["0123456"].diff and rows["1123456"].diff == ""
    assert stores.is_stale("abcdef1", "1234567") and not stores.is_stale("abcdef1", "abcdef1")


def test_render(spark):
    v = spark.createDataFrame([("p", "a", "file", "A", 0.9), ("p", "b", "file", "B", 0.1)], "project string, id string, node_type string, label string, risk_score double")
    e = spark.createDataFrame([("p", "a", "b", "imports")], "project string, source string, target string, edge_type string")
    layers = spark.createDataFrame([("p", "a", "ui"), ("p", "b", "data")], "project string, id string, layer string")
    assert "ui -->|1| data" in render.mermaid_layers(e, layers, "p") and "n0 --> n1" in render.mermaid_files(v, e, "p")
    assert "- a (0.90)" in render.markdown_report(v, e, layers, "p")


def events(spark, rows):
    return spark.createDataFrame([("p", path, op, h, dt(2024, 1, 1, 0, 0, s)) for path, op, h, s in rows], changes.EVENTS)


def test_debounce_and_filter(spark):
    df = events(spark, [("a", "change", "1", 0), ("b", "change", "1", 1), ("a", "change", "2", 2), ("c", "add", None, 10)])
    assert [(r["items"], r.n_events) for r in changes.debounce(df).orderBy("start").collect()] == [(["a", "b"], 3), (["c"], 1)]
    known = spark.createDataFrame([("p", "a", "2"), ("p", "d", "9")], "project string, path string, content_hash string")
    real = changes.real_changes(df.union(events(spark, [("d", "unlink", None, 3)])), known)
    assert sorted(r.path for r in real.collect()) == ["b", "c", "d"]
    assert sorted((r.path, r.content_hash) for r in changes.update_hashes(known, real).collect()) == [("a", "2"), ("b", "1")]


def test_watch_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate([[("a", "add", "1")], [("a", "change", "1"), ("b", "add", "2")], [("b", "unlink", None)]]):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"project": "p", "path": p, "op": o, "content_hash": h, "ts": f"2024-01-01T00:00:0{i}"}) for p, o, h in rows))
        os.utime(tmp_path / "in" / f"{i}.json", (1000 + i, 1000 + i))
    q = changes.watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(*[str(tmp_path / "out" / f"batch={i}") for i in range(3)])
    assert sorted((r.batch, r.path, r.op) for r in got.collect()) == [(0, "a", "add"), (1, "b", "add"), (2, "b", "unlink")]


def test_streamed_windows_equal_batch(spark, tmp_path):
    df = events(spark, [("a", "change", "1", s) for s in (0, 1, 30, 31)])
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(changes.EVENTS).parquet(str(tmp_path / "e"))
    q = changes.windowed_counts(stream, "path", width="10 seconds", late="0 seconds").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = sorted((r.start, r.n) for r in changes.windowed_counts(df, "path", width="10 seconds").collect())
    assert sorted((r.start, r.n) for r in spark.sql("select * from windows").collect()) == want


def test_patch_equals_rebuild(spark):
    v = spark.createDataFrame([("p", "a", "fa"), ("p", "a1", "fa"), ("p", "b", "fb")], "project string, id string, file string")
    e = spark.createDataFrame([("p", "a", "b", "imports"), ("p", "b", "a1", "calls"), ("p", "b", "a", "imports")], "project string, source string, target string, edge_type string")
    new_v = spark.createDataFrame([("p", "a", "fa"), ("p", "a2", "fa")], v.schema)
    new_e = spark.createDataFrame([("p", "a", "a2", "contains")], e.schema)
    changed = spark.createDataFrame([("p", "fa")], "project string, path string")
    after, live = changes.patch_graph(v, e, changed, new_v, new_e)
    assert sorted(r.id for r in after.collect()) == ["a", "a2", "b"]
    assert sorted((r.source, r.target) for r in live.collect()) == [("a", "a2"), ("b", "a")]
    assert [r.id for r in changes.importers(e, v.where("id = 'a'")).collect()] == ["b"]


def test_saved_tables_are_replaced_whole(spark, tmp_path):
    from loomgraph.sources import stores

    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        stores.saved(spark, path)
    stores.save(spark.range(3).toDF("n"), path)
    old = stores.saved(spark, path)
    stores.save(old.selectExpr("n + 10 AS n"), path)  # from itself
    assert sorted(r.n for r in stores.saved(spark, path).collect()) == [10, 11, 12]
    assert sorted(r.n for r in old.collect()) == [0, 1, 2]  # a reader that had begun goes on
    stores.save(spark.range(1).toDF("n"), path)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 2


def test_reports_say_what_they_leave_out(spark):
    from loomgraph.sources import render

    nodes = spark.createDataFrame([("p", f"n{i}", "file", 0.9) for i in range(5)], "project string, id string, node_type string, risk_score double")
    edges = spark.createDataFrame([], "project string, source string, target string, edge_type string")
    layers = nodes.selectExpr("project", "id", "'ui' AS layer")
    text = render.markdown_report(nodes, edges, layers, "p", rows=3)
    assert "5 nodes, 0 edges" in text and "- and 2 more" in text and "more" not in render.markdown_report(nodes, edges, layers, "p")

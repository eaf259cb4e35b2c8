import pytest
from pyspark.sql import functions as F

from loomgraph.functions import predicates as P
from loomgraph.functions import text as T
from loomgraph.operators import extract, history, search

FILES = "file_id long, project string, path string, lang_name string, content string, size_lines int, raw string"


def files(spark, *rows):
    return spark.createDataFrame([(i, "p", path, lang, content, 1, "x") for i, (path, lang, content) in enumerate(rows)], FILES)


@pytest.mark.parametrize("lang,content,want", [
    ("typescript", "import { a } from './a';\nimport b, { c } from \"b\";\nconst d = require('d');\nawait import('./e');\nexport * from './no';", ["./a", "./e", "b", "d"]),
    ("python", "from .x import y\nimport os, sys as s\n  import not_this\nfrom a.b import c", [".x", "a.b", "os", "sys"]),
    ("go", 'import "fmt"\nimport (\n  "a/b"\n  c "d/e"\n)', ["a/b", "d/e", "fmt"]),
    ("rust", "use crate::a::b;\nmod inner;\nuse std::io;", ["crate::a::b", "mod:inner"]),
    ("java", "import a.b.C;\nimport static d.E;", ["a.b.C", "d.E"]), ("kotlin", "import a.b.C", ["a.b.C"]), ("ruby", "require_relative 'x'\nrequire 'json'", ["./x", "json"]),
    ("php", "<?php\nrequire_once('a.php');\nuse B\\C;", ["B\\C", "a.php"]), ("c", '#include "x.h"\n#include <y.h>', ["x.h"]), ("csharp", "using A.B;\nusing static C;", ["A.B", "C"]), ("swift", "import X", []),
])
def test_imports(spark, lang, content, want):
    assert sorted(r.raw for r in extract.imports(files(spark, ("f", lang, content))).collect()) == want


def test_import_resolution(spark):
    df = files(spark, ("src/index.ts", "typescript", "import a from './utils';\nimport b from '../lib/b.js';\nimport x from 'x';"), ("src/utils/index.ts", "typescript", ""), ("lib/b.ts", "typescript", ""), ("pkg/a.py", "python", "from .b import c\nfrom pkg.d import e\nimport os"),
               ("pkg/b.py", "python", ""), ("pkg/d/__init__.py", "python", ""), ("m/x/x.go", "go", ""), ("main.go", "go", 'import "example.com/m/x"'), ("r/a.rb", "ruby", "require_relative 'b'"), ("r/b.rb", "ruby", ""))
    got = {(r.path, r.target) for r in extract.import_targets(extract.imports(df), df).collect()}
    assert got == {("src/index.ts", "src/utils/index.ts"), ("src/index.ts", "lib/b.ts"), ("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/d/__init__.py"), ("main.go", "m/x/x.go"), ("r/a.rb", "r/b.rb")}
    assert extract.import_edges(extract.import_targets(extract.imports(df), df)).count() == 6


@pytest.mark.parametrize("lang,content,want", [
    ("typescript", "export async function f(a) {\n}\nconst g = async (x) => 1;\nexport class C {}\nfunction f() {}", [("C", "class", True, False), ("f", "function", True, True), ("g", "function", False, True)]),
    ("python", "def a():\n  def _b(): pass\nclass C:\n  async def m(self): pass", [("C", "class", True, False), ("_b", "function", False, False), ("a", "function", True, False), ("m", "function", False, True)]),
    ("go", "func (r T) Name(a int) {}\nfunc init() {}\ntype S struct {", [("Name", "function", True, False), ("S", "class", True, False)]),
    ("rust", "pub async fn f() {}\nstruct S;", [("S", "class", False, False), ("f", "function", True, True)]),
    ("java", "public class A {\n  private int f(int x) {\n    if (x) {}\n  }\n}", [("A", "class", True, False), ("f", "function", False, False)]),
    ("kotlin", "private fun f() {}\ndata class D(val x: Int)", [("D", "class", True, False), ("f", "function", False, False)]),
    ("ruby", "class A\n  def self.b\nend", [("A", "class", True, False), ("b", "function", False, False)]),
    ("php", "class A {\n public function __construct() {}\n private function g() {}\n}", [("A", "class", True, False), ("g", "function", False, False)]),
    ("c", "static int add(int a, int b) {\nint x;\n#define f(x)", [("add", "function", True, False)]),
    ("csharp", "public class A {\n  public async Task<int> Go(int x) {", [("A", "class", True, False), ("Go", "function", True, True)]),
])
def test_symbols(spark, lang, content, want):
    got = sorted((r.name, r.kind, r.exported, r.is_async) for r in extract.symbols(files(spark, ("f", lang, content))).collect())
    assert got == want


def test_symbol_ends_and_calls(spark):
    df = files(spark, ("a.ts", "typescript", "function f() {\n  if (x) { y(); }\n}\nfunction g() { return f(1); }\nfunction h()\n"))
    ends = {r.name: r.end_line for r in extract.symbol_ends(extract.symbols(df), df).collect()}
    assert ends == {"f": 3, "g": 4, "h": 6}
    fns = spark.createDataFrame([(1, "foo(a); b.bar(c); // no(x)\n'qux(1)'; if (x) foo(2);"), (2, None), (3, "")], "fn_id long, body string")
    assert sorted((r.fn_id, r.callee, r.n) for r in extract.call_sites(fns).collect()) == [(1, "bar", 1), (1, "foo", 2)]


def test_security_first_line_per_rule(spark):
    df = files(spark, ("a", "x", "// eval(1)\neval(x)\neval(y)\nel.innerHTML = z;\nel.innerHTML=\"s\";\nel.innerHTML = \"s\";\nyaml.load(f, Loader=L)\nmd5(x) // password: 'abcdef'"))
    got = sorted((r.rule, r.line) for r in extract.security_findings(df).collect())
    assert got == [(0, 8), (6, 4), (9, 2), (16, 7), (18, 8)]
    assert extract.security_findings(df, all_matches=True).where("rule = 9").count() == 2
    summary = {(r.severity, r.category): r.n for r in extract.security_summary(extract.security_findings(df)).collect()}
    assert summary[None, None] == 5 and summary["high", None] == 3


def test_patterns_lessons_fingerprints(spark):
    df = files(spark, ("a.ts", "typescript", "class A {\n private static instance: A;\n}\nemitter.on('x', f);"), ("g.py", "python", "def f():\n    yield 1\n"), ("t.ts", "typescript", "await a();\nawait b();"))
    assert {(r.path, r.pattern) for r in extract.design_patterns(df).collect()} == {("a.ts", "singleton"), ("a.ts", "observer")}
    assert {(r.path, r.lesson, r.first_line) for r in extract.language_lessons(df).collect()} == {("g.py", "generators", 2), ("t.ts", "async_await", 1)}
    edited = df.withColumn("content", F.when(F.col("path") == "g.py", F.concat("content", F.lit("# note\n"))).when(F.col("path") == "t.ts", "function n() {}").otherwise(F.col("content")))
    change = {r.path: r.change for r in extract.classify_changes(extract.fingerprints(df), extract.fingerprints(edited)).collect()}
    assert change == {"a.ts": "SKIP", "g.py": "COSMETIC", "t.ts": "STRUCTURAL"}


def test_search_ranks(spark):
    v = spark.createDataFrame([("p", "file:merge", "Merge timer", None, 0.1, 1), ("p", "x", "The merge timer step", "", 0.2, 2), ("p", "y", "Timer", "", None, 3), ("p", "z", "other", "about merge", 0.9, 4), ("p", "w", None, None, 0.5, 5)], "project string, id string, label string, summary string, risk_score double, ord long")
    assert [(r.id, r.score) for r in search.keyword_search(v, "merge timer").collect()] == [("file:merge", 5.0), ("x", 4.0), ("y", 1.5), ("z", 0.5)]
    assert [(r.id, r.score) for r in search.question_search(v, "merge timer").collect()] == [("file:merge", 4.0), ("x", 3.0), ("y", 2.0), ("z", 1.0)]
    assert [r.id for r in search.substring_search(v, "MERGE").collect()] == ["file:merge", "x", "z"]
    assert search.fuzzy_search(v.withColumn("tags", F.lit(None).cast("array<string>")), "mrge").count() >= 1


def test_text_functions(spark):
    df = spark.createDataFrame([("a/./b/../c", "My Fancy_Name!", "git@host.example:own/rep.git", [1.0, 0.0], [1.0, 0.0], "abcd", "acbd", None)], "p string, s string, u string, x array<double>, y array<double>, a string, b string, n string")
    r = df.select(T.normal_path("p").alias("p"), T.slug("s").alias("s"), T.repository("u").alias("u"), T.cosine("x", "y").alias("c"), T.lcs_similarity("a", "b").alias("l"), T.shortened("s", 8).alias("t"), T.unit("n").alias("n"), T.to_int("a", 7).alias("i"), T.initials("s").alias("in"), T.safe_file_name("p").alias("f"), P.layer_of_path("p").alias("la"), P.risk_tier(F.lit(0.7)).alias("r")).first()
    assert (r.p, r.s, r.u.owner, r.u.repo, r.c, r.l, r.t, r.n, r.i, r["in"], r.f, r.la, r.r) == ("a/c", "my-fancy-name", "own", "rep", 1.0, 0.75, "My Fa...", 0.5, 7, "MF", "a-.-b---c", "general", "high")
    assert T.lcs_length("", "abc") == 0 and T.lcs_length("AGGTAB", "GXTXAYB") == 4


def test_history(spark):
    c = spark.createDataFrame([(1, "p", "f", "s1", "2024-01-01T00:00:00Z", "fix #12 #12 and #3", "A", 1), (1, "p", "f", "s1", "2024-01-01T00:00:00Z", "fix #12 #12 and #3", "A", 2), (2, "p", "f", "s2", "2024-03-01 02:00:00 +0200", None, "B", 3), (3, "p", "f", "s3", "rubbish", "", "", 4), (4, "p", "f", "s4", None, "x", None, 5)], "commit_id long, project string, file string, sha string, commit_date string, message string, author string, ord long")
    t = history.commit_times(c)
    assert t.count() == 4 and str(t.where("commit_id = 2").first().at) == "2024-03-01 00:00:00"
    assert [(r.author, r.n) for r in history.author_frequency(t).orderBy("pos").collect()] == [("A", 1), ("B", 1)]
    assert history.latest_commit(t).first().sha == "s2"
    assert {(r.reference, r.n) for r in history.pr_references(t).collect()} == {("#12", 1), ("#3", 1)}
    d = spark.createDataFrame([("p", "f", "s1", "@@ -1,2 +3,4 @@ x\n@@ -9 +20 @@")], "project string, file string, sha string, diff string")
    h = history.hunks(d)
    assert sorted((r.start, r.end) for r in h.collect()) == [(3, 7), (20, 21)]
    s = spark.createDataFrame([("p", "f", "in", 5, 6), ("p", "f", "out", 9, 12), ("p", "f", "none", None, None)], "project string, file string, name string, start_line int, end_line int")
    assert sorted((r.name, r.sha) for r in history.symbol_commits(s, t, h).collect()) == [("in", "s1"), ("in", "s2"), ("in", "s3"), ("in", "s4"), ("out", "s2"), ("out", "s3"), ("out", "s4")]
    log = spark.createDataFrame([("d", 1, "## [1.2.0]"), ("d", 2, "- thing (abcdef1)"), ("d", 3, "## 1.1.0"), ("d", 4, "- other abcdef12")], "doc string, line_no int, line string")
    shas = spark.createDataFrame([("abcdef1",)], "sha string")
    assert sorted((r.version, r.entry) for r in history.changelog_entries(log, shas).collect()) == [("1.1.0", "- other abcdef12"), ("1.2.0", "- thing (abcdef1)")]


def test_all_imports_of_files_without_a_language(spark, tmp_path):
    import __spark_entry__ as e

    rows = [(1, "p", "a.ts", None, "import x from './x';", 1), (2, "p", "b.py", "", "import os", 1), (3, "p", "c.py", "Python", "import re", 1), (4, "p", "d.go", None, 'import "fmt"', 1), (5, "p", "e.rb", "Ruby", "require 'set'", 1), (6, "p", "f.rs", None, None, 1)]
    spark.createDataFrame(rows, "file_id long, project string, path string, lang_name string, content string, size_lines int").write.parquet(str(tmp_path / "source_files.parquet"))
    got = {(r.path, r.language, r.raw) for r in e.queries()["all_imports"](spark, str(tmp_path)).collect()}
    assert got == {("a.ts", "typescript", "./x"), ("b.py", "python", "os"), ("c.py", "python", "re"), ("d.go", "go", "fmt"), ("e.rb", "ruby", "set")}


def test_merge_projects_keeps_edges(spark, sf):
    import __spark_entry__ as e
    from loomgraph.operators import merge

    v = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "a", 3)], "project string, id string, ord long")
    x = spark.createDataFrame([("p", "a", "b", "calls", 2.0, 2, 1), ("p", "a", "b", "calls", 1.0, 1, 2), ("q", "a", "a", "calls", 3.0, 1, 3)], "project string, source string, target string, edge_type string, weight double, ord long, edge_id long")
    nodes, edges = merge.merge_projects(v, x, "all")
    assert {(r.project, r.id) for r in nodes.collect()} == {("all", "p:a"), ("all", "p:b"), ("all", "q:a")}
    assert {(r.project, r.source, r.target, r.weight) for r in edges.collect()} == {("all", "p:a", "p:b", 1.0), ("all", "q:a", "q:a", 3.0)}
    ids = {r.id for r in e.queries()["merge_subgraphs"](spark, sf).collect()}
    merged = e.queries()["merge_subgraph_edges"](spark, sf).collect()
    assert merged and {y for r in merged for y in (r.source, r.target)} <= ids


def test_vector_search_answers_every_query(spark):
    queries = spark.range(10_500).selectExpr("id as query", "array(cast(id + 1 as double), 1.0d) as q_vector")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "key long, vec array<double>")
    got = search.vector_search(vectors, "key", "vec", queries)
    assert got.select("query").distinct().count() == 10_500 and got.count() == 21_000
    assert {r.pos for r in got.where("query = 7").collect()} == {1, 2}

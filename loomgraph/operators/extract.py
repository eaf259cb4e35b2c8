"""Facts from source text: imports, symbols, calls, design patterns, lessons, security findings, fingerprints.

Regular expressions run in the JVM over whole texts or exploded lines; only brace matching, which is sequential
within a file, runs in an Arrow stage. files: (project, path, lang_name, content) and further columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import language_of
from ..functions.text import normal_path

# The patterns of imports by language; group 1 is the import.
IMPORT_PATTERNS = {
    ("typescript", "javascript"): (
        r"(?:import|require)\s*(?:type\s+)?(?:\{[^}]*\}|[\w*$]+(?:\s*,\s*(?:\{[^}]*\}|[\w*$]+))?)?\s*from\s*['\"]([^'\"]+)['\"]",
        r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
        r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    ),
    ("python",): (r"(?m)^from\s+(\.+[\w.]*|[\w][\w.]*)\s+import\s+",),
    ("go",): (r"(?m)^\s*import\s+(?:\w+\s+)?[\"']([^\"']+)[\"']",),
    ("rust",): (r"(?m)^\s*use\s+((?:crate|super|self)(?:::\w+)+)",),
    ("java", "kotlin"): (r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?;?",),
    ("ruby",): (r"(?m)^\s*require\s+['\"]([^'\"]+)['\"]",),
    ("php",): (r"(?:require|include)(?:_once)?\s*\(?['\"]([^'\"]+)['\"]\)?", r"(?m)^\s*use\s+([\w\\]+)"),
    ("c", "cpp"): (r"(?m)^\s*#include\s+\"([^\"]+)\"",),
    ("csharp",): (r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;",),
}
_PYTHON_IMPORT = r"(?m)^import\s+([\w][\w., \t]*)"
_GO_BLOCK = r"(?s)import\s*\(([^)]+)\)"
_RUST_MOD = r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;"
_RUBY_RELATIVE = r"(?m)^\s*require_relative\s+['\"]([^'\"]+)['\"]"

# Fixed values: (kind, languages, line pattern, group of the name, exported rule, async pattern).
SYMBOL_RULES = (
    ("function", ("typescript", "javascript"), r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", 1, r"^export\s", r"^(?:export\s+)?async\s"),
    ("function", ("typescript", "javascript"), r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*(?::\s*[^=>{]+?)?\s*=>", 1, r"^export\s", r"=\s*async\s"),
    ("class", ("typescript", "javascript"), r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", 1, r"export\s+(?:default\s+)?(?:abstract\s+)?class\s", None),
    ("function", ("python",), r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", 1, r"^(?:async\s+)?def\s+[^_]", r"^\s*async\s"),
    ("class", ("python",), r"^\s*class\s+(\w+)", 1, r"^class\s+[^_]", None),
    ("function", ("go",), r"^func\s+(?:\([^)]*\)\s+)?(?!init\b)(\w+)\s*[(\[{]", 1, r"^func\s+(?:\([^)]*\)\s+)?[A-Z]", None),
    ("class", ("go",), r"^type\s+(\w+)\s+(?:struct|interface)\s*\{", 1, r"^type\s+[A-Z]", None),
    ("function", ("rust",), r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", 1, r"^pub", r"\basync\s+fn\b"),
    ("class", ("rust",), r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)", 1, r"^pub", None),
    ("class", ("java",), r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+(\w+)", 1, r"\bpublic\b", None),
    ("function", ("java",), r"^\s*(?:(?:public|private|protected|static|final|synchronized|native|abstract|default)\s+)*(?!class\s|interface\s|enum\s)(?:[\w<>\[\],\s.]+\s+)?(?!(?:if|for|while|switch|catch|else|new|return|throw)\b)(\w+)\s*\(", 1, r"\bpublic\b", None),
    ("class", ("kotlin",), r"^\s*(?:(?:public|private|protected|internal|open|abstract|sealed|data|inner|value|companion|enum|annotation|actual|expect)\s+)*(?:class|interface|object)\s+(\w+)", 1, r"^(?!.*\b(?:private|protected)\b)", None),
    ("function", ("kotlin",), r"^\s*(?:(?:public|private|protected|internal|open|override|suspend|inline|operator|infix|tailrec|external|actual|expect)\s+)*fun\s+(?:<[^>]*>\s+)?(\w+)\s*[(<]", 1, r"^(?!.*\b(?:private|protected)\b)", r"\bsuspend\b"),
    ("function", ("ruby",), r"^\s*def\s+(?:self\.)?(\w+)", 1, r"^def\s+(?:self\.)?[^_]", None),
    ("class", ("ruby",), r"^\s*(?:class|module)\s+(\w+)", 1, r"^(?:class|module)", None),
    ("class", ("php",), r"^\s*(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum)\s+(\w+)", 1, r"", None),
    ("function", ("php",), r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?\s*(?!__construct\b)(\w+)\s*\(", 1, r"^(?!.*\b(?:private|protected)\b)", None),
    ("class", ("c", "cpp"), r"^(?:template\s*<[^>]*>\s*)?(?:class|struct|union)\s+(\w+)", 1, r"", None),
    ("function", ("c", "cpp"), r"^(?!#|//|typedef\s)(?:(?:static|inline|extern|const)\s+)*[\w*][\w*\s]*\s(?!(?:if|for|while|switch|do|else|return|sizeof)\b)(\w+)\s*\([^;{)]*\s*\)\s*(?:const\s*)?(?:\{|$)", 1, r"", None),
    ("class", ("csharp",), r"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly)\s+)*(?:class|interface|struct|record|enum)\s+(\w+)", 1, r"\bpublic\b", None),
    ("function", ("csharp",), r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|new|sealed)\s+)+(?!class\s|interface\s|struct\s|record\s|enum\s)(?:[\w<>\[\],\s.?]+\s+)?(?!(?:if|for|foreach|while|switch|do|catch|return|throw|new|typeof|nameof)\b)(\w+)\s*\(", 1, r"\bpublic\b", r"\basync\b"),
)

# Names before a parenthesis that are no calls.
NO_CALLS = (
    "if", "for", "while", "switch", "catch", "return", "function", "super", "typeof", "instanceof", "new", "await", "yield", "void", "delete", "in", "of", "console", "require", "import",
    "parseInt", "parseFloat", "String", "Number", "Boolean", "Array", "Object", "JSON", "Math", "Date", "Promise", "Set", "Map", "Symbol", "RegExp", "Error", "isNaN", "isFinite", "setTimeout", "setInterval",
)

# Fixed values: (category, severity, pattern, description); all ignore case.
SECURITY_RULES = (
    ("hardcoded_secret", "high", r"(?:password|passwd|pwd)\s*[:=]\s*['\"`][^'\"`]{4,}['\"`]", "Hardcoded password literal"),
    ("hardcoded_secret", "high", r"(?:api_key|apikey|api_secret)\s*[:=]\s*['\"`][^'\"`]{8,}['\"`]", "Hardcoded API key"),
    ("hardcoded_secret", "high", r"(?:secret|token|auth_token)\s*[:=]\s*['\"`][^'\"`]{8,}['\"`]", "Hardcoded secret/token"),
    ("hardcoded_secret", "medium", r"(?:private_key|privatekey)\s*[:=]\s*['\"`][^'\"`]{4,}['\"`]", "Hardcoded private key"),
    ("sql_injection", "high", r"[\"'`]\s*\+\s*\w+.*(?:SELECT|INSERT|UPDATE|DELETE|DROP)", "SQL query built with string concatenation"),
    ("sql_injection", "high", r"(?:query|execute|exec)\s*\(\s*['\"`][^'\"`]*['\"`]\s*\+", "SQL string concatenation in query call"),
    ("xss_risk", "high", r"\.innerHTML\s*=\s*(?!['\"`])", "innerHTML assigned from variable (XSS risk)"),
    ("xss_risk", "medium", r"document\.write\s*\(", "document.write() usage"),
    ("xss_risk", "medium", r"\.outerHTML\s*=\s*(?!['\"`])", "outerHTML assigned from variable"),
    ("unsafe_eval", "high", r"\beval\s*\(", "eval() usage"),
    ("unsafe_eval", "high", r"new\s+Function\s*\(", "new Function(): dynamic code execution"),
    ("unsafe_eval", "medium", r"setTimeout\s*\(\s*['\"`]", "setTimeout with string argument"),
    ("unsafe_exec", "high", r"subprocess\s*\.\s*(?:call|run|Popen)\s*\([^)]*shell\s*=\s*True", "subprocess with shell=True"),
    ("unsafe_exec", "high", r"os\s*\.\s*system\s*\(", "os.system() call"),
    ("unsafe_exec", "medium", r"child_process\s*\.\s*exec\s*\(", "child_process.exec(): prefer execFile"),
    ("unsafe_deserialization", "high", r"pickle\s*\.\s*loads?\s*\(", "pickle.load/loads: unsafe deserialization"),
    ("unsafe_deserialization", "medium", r"yaml\s*\.\s*load\s*\([^)]*\)(?!\s*,\s*Loader)", "yaml.load without Loader: use yaml.safe_load"),
    ("path_traversal", "medium", r"(?:readFile|readFileSync|createReadStream)\s*\([^)]*\+", "File read with concatenated path (traversal risk)"),
    ("weak_crypto", "medium", r"(?:md5|sha1)\s*\(", "Weak hash algorithm (md5/sha1)"),
    ("weak_crypto", "low", r"Math\.random\s*\(\)", "Math.random(): not cryptographically secure"),
)

# Design patterns as conditions that must all hold, or any of several groups of them.
DESIGN_PATTERNS = {
    "singleton": ((r"(?i)private\s+(?:static\s+)?(?:readonly\s+)?instance\s*[:=]",), (r"private\s+constructor\s*\(", r"(?i)static\s+\w*instance\w*")),
    "factory": ((r"(?i)(?:function|static)\s+(?:create|make|build)\w*\s*\(",),),
    "observer": ((r"(?i)(?:addEventListener|\.on\(|\.subscribe\(|\.emit\(|EventEmitter)",),),
    "react_hook": ((r"export\s+(?:function|const)\s+use[A-Z]\w+", r"use(?:State|Effect|Ref|Memo|Callback|Context|Reducer)\s*\("),),
    "strategy": ((r"(?i)(?:implements\s+\w+Strategy|interface\s+\w+Strategy)",),),
    "dependency_injection": ((r"constructor\s*\(\s*(?:private|readonly|public)\s+\w+\s*:\s*\w+[^)]*,\s*(?:private|readonly|public)",),),
    "context_provider": ((r"createContext\s*[(<]", r"\.\s*Provider\b"),),
    "decorator": ((r"(?:^|\n)\s*@[A-Z]\w*(?:\([^)]*\))?\s*(?:\n|$)",),),
    "event_emitter": ((r"(?:extends\s+\w*EventEmitter|new\s+\w*EventEmitter\s*\(|extends\s+\w+Emitter\b)",),),
}
_SCRIPT = ("typescript", "javascript")


def with_language(files: DataFrame) -> DataFrame:
    """files with ``language``: lang_name in lower case, else by extension."""
    return files.withColumn("language", F.coalesce(F.nullif(F.lower("lang_name"), F.lit("")), language_of("path")))


def _all(pattern: str, text: str = "content", group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def imports(files: DataFrame) -> DataFrame:
    """project, path, raw: the distinct imports of each file as written ('mod:x' for sibling modules, './x' for relative
    requires)."""
    python = F.filter(F.transform(F.flatten(F.transform(_all(_PYTHON_IMPORT), lambda x: F.split(x, ","))), lambda p: F.split(F.trim(p), r"\s+")[0]), lambda p: p != "")
    go = F.flatten(F.transform(_all(_GO_BLOCK), lambda block: F.regexp_extract_all(block, F.lit("[\"']([^\"']+)[\"']"), F.lit(1))))
    more = {
        "python": python, "go": go, "rust": F.transform(_all(_RUST_MOD), lambda x: F.concat(F.lit("mod:"), x)), "ruby": F.transform(_all(_RUBY_RELATIVE), lambda x: F.concat(F.lit("./"), x)),
    }
    chosen = None
    for languages, patterns in IMPORT_PATTERNS.items():
        parts = [_all(p) for p in patterns] + [more[x] for x in languages if x in more]
        found = F.array_distinct(F.concat(*parts)) if len(parts) > 1 else F.array_distinct(parts[0])
        hit = F.col("language").isin(*languages)
        chosen = F.when(hit, found) if chosen is None else chosen.when(hit, found)
    return with_language(files).select("project", "path", "language", F.explode(chosen).alias("raw")).distinct()


def import_targets(found: DataFrame, files: DataFrame) -> DataFrame:
    """project, path, raw, target: the first candidate path of an import that is a file of the project; imports without
    one are external and left out. Candidates are built as an array and met by an equi join."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    joined = lambda *p: normal_path(F.concat_ws("/", *p))
    relative = F.col("raw").startswith(".")
    base = joined(folder, F.col("raw"))
    script = F.when(relative, F.array(base, F.concat(F.regexp_replace(base, r"\.[jt]sx?$", ""), F.lit(".ts")), F.concat(base, F.lit(".tsx")), F.concat(base, F.lit(".js")), F.concat(base, F.lit("/index.ts")), F.concat(base, F.lit("/index.js"))))
    dots = F.length(F.regexp_extract("raw", r"^(\.+)", 1))
    up = F.when(dots > 0, F.concat(folder, F.repeat(F.lit("/.."), dots - 1))).otherwise(F.lit(""))
    module = F.regexp_replace(F.regexp_replace("raw", r"^\.+", ""), r"\.", "/")
    python_base = joined(up, module)
    python = F.array(F.concat(python_base, F.lit(".py")), F.concat(python_base, F.lit("/__init__.py")), F.concat(F.lit("src/"), python_base, F.lit(".py")))
    dotted = F.regexp_replace("raw", r"\.", "/")
    dotted_parent = F.regexp_replace(dotted, r"/[^/]*$", "")
    java = F.flatten(F.array(*[F.array(F.concat(F.lit(r), p, F.lit(e))) for p in (dotted, dotted_parent) for r in ("", "src/main/java/", "src/main/kotlin/", "src/") for e in (".java", ".kt")]))
    crate = F.regexp_replace(F.regexp_replace("raw", r"^(?:crate|super|self)::", ""), r"::", "/")
    rust = F.when(F.col("raw").startswith("mod:"), F.array(joined(folder, F.concat(F.substring("raw", 5, 1000), F.lit(".rs"))), joined(folder, F.substring("raw", 5, 1000), F.lit("mod.rs")))).otherwise(
        F.array(F.concat(F.lit("src/"), crate, F.lit(".rs")), F.concat(F.lit("src/"), F.regexp_replace(crate, r"/[^/]*$", ""), F.lit(".rs")), F.concat(F.lit("src/"), crate, F.lit("/mod.rs")))
    )
    ruby = F.array(F.when(F.col("raw").endswith(".rb"), base).otherwise(F.concat(base, F.lit(".rb"))), F.concat(F.lit("lib/"), F.col("raw"), F.lit(".rb")))
    plain = F.array(base, F.col("raw"), F.concat(F.lit("include/"), F.col("raw")), F.concat(F.lit("src/"), F.col("raw")))
    php = F.array(base, F.col("raw"), F.concat(F.lit("src/"), F.regexp_replace("raw", r"\\", "/"), F.lit(".php")))
    sharp = F.array(F.concat(dotted, F.lit(".cs")), F.concat(F.substring_index(dotted, "/", -1), F.lit(".cs")))
    lang = F.col("language")
    options = (
        F.when(lang.isin(*_SCRIPT), script).when(lang == "python", python).when(lang.isin("java", "kotlin"), java).when(lang == "rust", rust).when(lang == "ruby", ruby)
        .when(lang.isin("c", "cpp"), plain).when(lang == "php", php).when(lang == "csharp", sharp)
    )
    candidates = found.select("project", "path", "raw", "language", F.posexplode(options).alias("rank", "target"))
    known = files.select("project", F.col("path").alias("target")).distinct()
    direct = candidates.join(known, ["project", "target"])
    # Go names a folder: its last step is the join key, the rest of the suffix is checked, the first file is taken
    go = found.where("language = 'go'").withColumn("tail", F.substring_index("raw", "/", -1))
    folders = files.where(F.col("path").endswith(".go")).groupBy("project", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.min("path").alias("target")).withColumn("tail", F.substring_index("folder", "/", -1))
    suffix = go.join(folders, ["project", "tail"]).where(F.col("raw").endswith(F.col("folder"))).select("project", "target", "path", "raw", "language", F.lit(0).alias("rank"))
    both = direct.select("project", "path", "raw", "rank", "target").unionByName(suffix.select("project", "path", "raw", "rank", "target"))
    return both.where("path <> target").groupBy("project", "path", "raw").agg(F.min_by("target", F.struct("rank", "target")).alias("target"))


def import_edges(targets: DataFrame) -> DataFrame:
    return targets.select("project", F.concat(F.lit("file:"), F.col("path")).alias("source"), F.concat(F.lit("file:"), F.col("target")).alias("target"), F.lit("imports").alias("edge_type")).distinct()


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row a line: keep columns, line_no from 1, line without its carriage return."""
    split = F.posexplode(F.split("content", "\n")).alias("n", "line")
    return files.select(*keep, split).select(*keep, (F.col("n") + 1).alias("line_no"), F.regexp_replace("line", r"\r$", "").alias("line"))


def symbols(files: DataFrame) -> DataFrame:
    """project, path, kind, name, line_no, exported, is_async. Rules look at one line; where several rules of a language
    match, classes come before functions; in the script languages the first use of a name in a file counts."""
    rows = lines(with_language(files), "project", "path", "language")
    rules = sorted(SYMBOL_RULES, key=lambda r: (r[1], r[0] != "class") if r[1][0] in ("java", "kotlin", "php", "c", "csharp") else (r[1], False))
    # which rule matches is found with literal patterns; the parts of that one rule are looked up by its number
    rule = F.coalesce(*[F.when(F.col("language").isin(*r[1]) & F.col("line").rlike(r[2]), F.lit(i)) for i, r in enumerate(rules)])
    of = lambda k: F.array(*[F.lit(r[k]) for r in rules])[F.col("rule")]
    hit = rows.withColumn("rule", rule).where("rule is not null").select("project", "path", "language", "line_no", "line", of(0).alias("kind"), of(2).alias("p"), of(4).alias("e"), of(5).alias("a"))
    found = hit.select(
        "project", "path", "language", "line_no", "kind", F.expr("regexp_extract(line, p, 1)").alias("name"), F.expr("line rlike e").alias("exported"), F.coalesce(F.expr("line rlike a"), F.lit(False)).alias("is_async")
    ).where("name <> ''")
    first = Window.partitionBy("project", "path", "kind", F.when(F.col("language").isin(*_SCRIPT), F.col("name")).otherwise(F.col("line_no").cast("string"))).orderBy("line_no")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("project", "path", "kind", "name", "line_no", "exported", "is_async")


def closings(text: str):
    """(number of lines, line -> the line on which the braces opened from it on are closed again, or None), from one pass
    over the braces of the text; each line is then looked up by bisection."""
    at, depths, opens, closed, depth, line, last = [], [], [], {}, 0, 1, 0
    for k, m in enumerate(re.finditer(r"[{}]", text)):
        line, last = line + text.count("\n", last, m.start()), m.start()
        depth += 1 if m.group() == "{" else -1
        at.append(line)
        depths.append(depth)
        if m.group() == "{":
            opens.append(k)
        else:
            closed.setdefault(depth, []).append(k)

    def ends(start: int) -> int | None:
        first = bisect_left(at, start)
        o = bisect_left(opens, first)
        if o == len(opens):
            return None
        level = closed.get(depths[first - 1] if first else 0, [])
        c = bisect_left(level, opens[o])
        return at[level[c]] if c < len(level) else None

    return text.count("\n") + 1, ends


def symbol_ends(found: DataFrame, files: DataFrame) -> DataFrame:
    """symbols with end_line: where the braces opened from its line on are closed again, else five lines on."""
    starts = found.groupBy("project", "path").agg(F.array_sort(F.collect_set("line_no")).alias("starts"))
    read = starts.join(files.select("project", "path", "content"), ["project", "path"]).select("project", "path", "starts", "content")

    def run(batches):
        for b in batches:
            out = []
            for project, path, begin, content in zip(*(b.column(i).to_pylist() for i in range(4))):
                n_lines, ends = closings(content or "")
                out += [(project, path, s, ends(s) or min(s + 5, n_lines)) for s in begin]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["project", "path", "line_no", "end_line"])

    ends = read.mapInArrow(run, "project string, path string, line_no int, end_line int").distinct()
    return found.join(ends, ["project", "path", "line_no"])


def method_count(body) -> Column:
    """Methods in the text of a class body."""
    return F.regexp_count(body, F.lit(r"(?:^|\n)\s+(?:(?:public|private|protected|static|async|override|readonly)\s+)*(\w+)\s*\([^)]*\)\s*(?::\s*[^{]+)?\s*\{"))


def call_sites(functions: DataFrame, key: str = "fn_id", body: str = "body") -> DataFrame:
    """key, callee, n: names followed by a parenthesis, comments and literals taken out first. Possessive, as else a literal
    of 2,000 characters overflows the stack; nothing given back could end the literal, so the matches are the same."""
    text = F.col(body)
    for pattern, to in ((r"//[^\n]*", ""), (r"/\*[\s\S]*?\*/", ""), (r"`(?:\\.|[^`\\])*+`", "``"), (r"'(?:\\.|[^'\\])*+'", "''"), (r'"(?:\\.|[^"\\])*+"', '""')):
        text = F.regexp_replace(text, pattern, to)
    names = F.explode(F.regexp_extract_all(text, F.lit(r"(?:\.\s*)?\b([A-Za-z_$][\w$]*)\s*\("), F.lit(1))).alias("callee")
    return functions.select(key, names).where(~F.col("callee").isin(*NO_CALLS)).groupBy(key, "callee").agg(F.count(F.lit(1)).alias("n"))


def resolve_calls(calls: DataFrame, symbols_of: DataFrame, targets: DataFrame) -> DataFrame:
    """calls (project, path, caller, callee, n) to internal symbols of the same file, else to an exported function of the
    first directly imported file that has one: project, path, caller, callee, n, to_path, internal."""
    f = symbols_of.where("kind = 'function'").select("project", "path", F.col("name").alias("callee"), "exported")
    own = calls.join(f.select("project", "path", "callee").distinct(), ["project", "path", "callee"]).withColumn("to_path", F.col("path")).withColumn("rank", F.lit("0"))
    there = targets.select("project", "path", "raw", F.col("target").alias("to_path"))
    other = calls.join(there, ["project", "path"]).join(f.where("exported").select("project", F.col("path").alias("to_path"), "callee").distinct(), ["project", "to_path", "callee"]).withColumn("rank", F.concat(F.lit("1"), F.col("raw")))
    columns = ["project", "path", "caller", "callee", "n", "to_path", "rank"]
    both = own.select(*columns).unionByName(other.select(*columns))
    best = both.groupBy("project", "path", "caller", "callee", "n").agg(F.min(F.struct("rank", "to_path")).alias("x"))
    return best.select("project", "path", "caller", "callee", "n", F.col("x.to_path").alias("to_path"), (F.col("x.rank") == "0").alias("internal"))


def design_patterns(files: DataFrame) -> DataFrame:
    """project, path, pattern found in each file."""
    text = F.col("content")
    every = lambda group: reduce(lambda a, b: a & b, [text.rlike(p) for p in group])
    hits = [F.when(reduce(lambda a, b: a | b, [every(g) for g in groups]), name) for name, groups in DESIGN_PATTERNS.items()]
    return files.select("project", "path", F.explode(F.array_compact(F.array(*hits))).alias("pattern")).distinct()


def security_findings(files: DataFrame, key: str = "file_id", all_matches: bool = False) -> DataFrame:
    """key, rule, category, severity, line, snippet: the first matching line of each rule in a text, or all. Lines that
    begin with //, # or * are passed over."""
    rows = lines(files, key).where(~F.ltrim("line").rlike(r"^(?://|#|\*)"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike("(?i)" + p), F.lit(i)) for i, (_, _, p, _) in enumerate(SECURITY_RULES)]))
    found = rows.select(key, "line_no", F.substring(F.trim("line"), 1, 80).alias("snippet"), F.explode(hits).alias("rule"))
    if not all_matches:
        found = found.groupBy(key, "rule").agg(F.min(F.struct("line_no", "snippet")).alias("x")).select(key, "rule", "x.line_no", "x.snippet")
    of = lambda k: F.array(*[F.lit(r[k]) for r in SECURITY_RULES])[F.col("rule")]
    return found.select(key, "rule", of(0).alias("category"), of(1).alias("severity"), F.col("line_no").alias("line"), "snippet", F.substring(of(2), 1, 60).alias("pattern"), of(3).alias("description"))


def security_summary(found: DataFrame) -> DataFrame:
    """Totals, by severity, by category, in one pass: severity and category are null where summed over."""
    return found.groupingSets([[], ["severity"], ["category"]], "severity", "category").agg(F.count(F.lit(1)).alias("n"))


# Lessons in order of priority: (name, languages or None, counted patterns, least matches in all, or patterns one of which is enough).
LESSONS = (
    ("finite_state_machine", None, (), 0, (r"switch\s*\(\s*(?:this\.)?\w*[Ss]tate\w*\s*\)", r"(?s)\bState\.\w+(?:.*?\bState\.\w+){2}")),
    ("generators", (*_SCRIPT, "python"), (), 0, (r"function\s*\*", r"\byield\b")),
    ("observers", _SCRIPT, (), 0, (r"\baddEventListener\b", r"\bsubscribe\s*\(", r"(?s)\bon\s*\(.*\bemit\s*\(|\bemit\s*\(.*\bon\s*\(")),
    ("streams", (*_SCRIPT, "java", "kotlin"), (), 0, (r"\.pipe\(", r"\bObservable\b", r"\bSubject\b", r"\bStream\b")),
    ("dependency_injection", (*_SCRIPT, "java", "kotlin"), (), 0, (r"@(?:Injectable|Inject)\b", r"constructor\s*\(\s*(?:private|protected|public|readonly)\s+\w+\s*:\s*\w+", r"constructor\s*\([^)]*:\s*\w+[^)]*\)")),
    ("decorators", (*_SCRIPT, "python"), (), 0, (r"@\w+(?:\([^)]*\))?\s*\n\s*(?:export\s+)?(?:abstract\s+)?class\s+", r"@\w+(?:\([^)]*\))?\s*\n\s*(?:public|private|protected|static|async|\w+)\s+\w+\s*\(", r"@(?:Injectable|Inject|Component|Directive|Pipe|Module|Controller|Get|Post|Put|Delete|Patch|Body|Param|Query)\b")),
    ("generics", (*_SCRIPT, "java", "kotlin", "go", "rust", "csharp"), (r"<T(?:\s+extends[^>]*)?\s*>", r"<T\s+extends\b", r":\s*Generic\["), 3, ()),
    ("closures", _SCRIPT, (), 0, (r"(?s)function\s+\w+\s*\([^)]*\)\s*\{[^}]*function\s+\w*\s*\(", r"(?s)function\s+\w+\s*\([^)]*\)\s*\{[^}]*(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\([^)]*\)\s*=>", r"function\s+\w+\s*\([^)]*\)\s*\{[\s\S]*?return\s+function", r"function\s+\w+\s*\([^)]*\)\s*\{[\s\S]*?return\s+(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_]\w*)\s*=>")),
    ("immutability", (*_SCRIPT, "java", "kotlin"), (r"\bObject\.freeze\s*\(", r"\bas\s+const\b", r"\breadonly\b", r"\bImmutable\w+"), 3, ()),
    ("middleware", _SCRIPT, (), 0, (r"\(\s*req\s*,\s*res\s*,\s*next\s*\)", r"\bapp\.use\s*\(", r"\brouter\.use\s*\(")),
    ("promises", _SCRIPT, (r"\.then\(", r"\.catch\(", r"new\s+Promise\("), 2, ()),
    ("async_await", (*_SCRIPT, "python", "rust", "csharp"), (r"\bawait\b",), 2, ()),
)


#: What makes a lesson of high confidence: any of the groups, each of (patterns, least matches in all) that must all hold.
_SWITCH, _ENUM, _STATE = r"switch\s*\(\s*(?:this\.)?\w*[Ss]tate\w*\s*\)", r"enum\s+\w*[Ss]tate\w*\s*\{", r"\bState\.\w+"
SURE = {
    "finite_state_machine": (((_SWITCH,), 1, (_ENUM,), 1), ((_SWITCH,), 1, (_STATE,), 3)), "generators": (((r"function\s*\*",), 1, (r"\byield\b",), 2),),
    "observers": (((r"\baddEventListener\b",), 2), ((r"\bsubscribe\s*\(",), 2), ((r"\bon\s*\(",), 1, (r"\bemit\s*\(",), 1)), "streams": (((r"\.pipe\(", r"\bObservable\b", r"\bSubject\b", r"\bStream\b"), 3),),
    "dependency_injection": (((r"@(?:Injectable|Inject)\b",), 1),), "decorators": (((r"@(?:Injectable|Inject|Component|Directive|Pipe|Module|Controller|Get|Post|Put|Delete|Patch|Body|Param|Query)\b",), 1),),
    "generics": (((r"<T(?:\s+extends[^>]*)?\s*>", r"<T\s+extends\b", r":\s*Generic\["), 5),),
    "closures": (((r"function\s+\w+\s*\([^)]*\)\s*\{[\s\S]*?return\s+function",), 1), ((r"function\s+\w+\s*\([^)]*\)\s*\{[\s\S]*?return\s+(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_]\w*)\s*=>",), 1)),
    "immutability": (((r"\bObject\.freeze\s*\(", r"\bas\s+const\b", r"\breadonly\b", r"\bImmutable\w+"), 5),),
    "middleware": (((r"\(\s*req\s*,\s*res\s*,\s*next\s*\)",), 1, (r"\bapp\.use\s*\(", r"\brouter\.use\s*\("), 1),),
    "promises": (((r"\.then\(", r"\.catch\(", r"new\s+Promise\("), 4),), "async_await": (((r"\bawait\b",), 4),),
}


def _sure(name: str) -> Column:
    def group(parts) -> Column:
        pairs = zip(parts[::2], parts[1::2])
        return reduce(lambda a, b: a & b, [sum((F.regexp_count("content", F.lit(p)) for p in patterns), F.lit(0)) >= least for patterns, least in pairs])

    return reduce(lambda a, b: a | b, [group(g) for g in SURE[name]])


def language_lessons(files: DataFrame) -> DataFrame:
    """project, path, lesson, first_line, last_line, confidence (high or medium): the first lesson, in order of priority, that a
    file shows."""
    options = []
    for name, languages, counted, least, enough in LESSONS:
        hit = reduce(lambda a, b: a | b, [F.col("content").rlike(p) for p in enough]) if enough else sum((F.regexp_count("content", F.lit(p)) for p in counted), F.lit(0)) >= least
        if languages:
            hit = hit & F.col("language").isin(*languages)
        at = F.coalesce(*[F.nullif(F.regexp_instr("content", F.lit(p)), F.lit(0)) for p in (enough or counted)])
        options.append(F.when(hit, F.struct(F.lit(name).alias("lesson"), at.alias("at"), F.when(_sure(name), "high").otherwise("medium").alias("confidence"))))
    found = with_language(files).withColumn("x", F.coalesce(*options)).where("x is not null")
    before = F.substring(F.col("content"), F.lit(1), F.coalesce(F.col("x.at"), F.lit(1)))
    first = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return found.select("project", "path", "x.lesson", first.alias("first_line"), F.least(first + 5, F.size(F.split("content", "\n"))).alias("last_line"), "x.confidence")


def fingerprints(files: DataFrame) -> DataFrame:
    """project, path, content_hash, functions, classes, imports (sorted) and total_lines of each file."""
    s = symbols(files).groupBy("project", "path").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(n) for k, n in (("function", "functions"), ("class", "classes"))])
    i = imports(files).groupBy("project", "path").agg(F.array_sort(F.collect_set("raw")).alias("imports"))
    base = files.select("project", "path", F.sha2("content", 256).alias("content_hash"), F.size(F.split("content", "\n")).alias("total_lines")).distinct()
    none = F.array().cast("array<string>")
    return base.join(s, ["project", "path"], "left").join(i, ["project", "path"], "left").withColumns({c: F.coalesce(c, none) for c in ("functions", "classes", "imports")})


def classify_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fingerprints before and after -> project, path, change: NEW, REMOVED, SKIP (same text), COSMETIC (same symbols and
    imports) or STRUCTURAL."""
    symbols_ = F.struct("functions", "classes", "imports")
    a = old.select("project", "path", F.col("content_hash").alias("h0"), symbols_.alias("s0"))
    b = new.select("project", "path", F.col("content_hash").alias("h1"), symbols_.alias("s1"))
    change = (
        F.when(F.col("h0").isNull(), "NEW").when(F.col("h1").isNull(), "REMOVED").when(F.col("h0") == F.col("h1"), "SKIP").when(F.col("s0") == F.col("s1"), "COSMETIC").otherwise("STRUCTURAL")
    )
    return a.join(b, ["project", "path"], "full").select("project", "path", change.alias("change"))

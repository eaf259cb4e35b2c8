"""Source trees as tables: scan, filters, language, project name, frameworks, workspaces, summary."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import predicates as P


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ** spans folders, * stays within one."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def ignore_lines(text: str) -> list[str]:
    """Patterns of an ignore file: blank lines, comments, absolute paths and parent steps are dropped."""
    found = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith(("#", "/")) or ".." in line:
            continue
        found += [f"**/{line.rstrip('/')}/**"] if line.endswith("/") else [line if "/" in line else f"**/{line}", f"**/{line}/**"]
    return found


def exclude(files: DataFrame, patterns=model.EXCLUDED, path: str = "path") -> DataFrame:
    """Files whose path matches none of the globs; one combined expression."""
    if not patterns:
        return files
    return files.where(~F.col(path).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)))


def scan_tree(spark: SparkSession, root: str, project: str | None = None, patterns=model.EXCLUDED, max_bytes: int = model.MAX_FILE_BYTES) -> DataFrame:
    """All readable files below a folder, as project, path, lang_name, file_category, size_lines, content, mtime. Hidden
    files come too; files over max_bytes, excluded, empty or not valid text are left out."""
    root = root.rstrip("/")
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(root)
        .where(F.col("length") <= max_bytes)
    )
    path = F.expr(f"substring(path, locate('{root}/', path) + {len(root) + 1})")
    text = F.expr("try_validate_utf8(cast(content as string))")
    rows = raw.select(F.lit(project or os.path.basename(root)).alias("project"), path.alias("path"), text.alias("content"), F.col("modificationTime").alias("mtime")).where("content is not null")
    kept = exclude(rows, patterns)
    return kept.withColumn("lang_name", P.language_of("path")).withColumn("file_category", P.file_category(F.col("lang_name"))).withColumn("size_lines", F.size(F.split("content", "\n")))


def file_nodes(files: DataFrame) -> DataFrame:
    """A node for each file."""
    return files.select("project", F.concat(F.lit("file:"), F.col("path")).alias("id"), F.lit("file").alias("node_type"), F.substring_index("path", "/", -1).alias("label"), F.col("path").alias("file"), P.file_complexity("size_lines").alias("complexity"))


def project_names(files: DataFrame) -> DataFrame:
    """project, name: the name in package.json, Cargo.toml or go.mod at the root, in this order, else the project."""
    at = lambda name, value: F.max(F.when(F.col("path") == name, value))
    return files.where(F.col("path").isin("package.json", "Cargo.toml", "go.mod")).groupBy("project").agg(
        F.coalesce(
            F.nullif(at("package.json", F.get_json_object("content", "$.name")), F.lit("")), F.nullif(at("Cargo.toml", F.regexp_extract("content", r'(?m)^\s*name\s*=\s*"([^"]+)"', 1)), F.lit("")),
            F.nullif(at("go.mod", F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1)), F.lit("")), F.col("project"),
        ).alias("name")
    )


def frameworks(files: DataFrame, packages: dict[str, str] | None = None) -> DataFrame:
    """project, framework: by marker files at the root and by the dependencies named in package.json."""
    table = F.create_map(*[F.lit(x) for pair in model.FRAMEWORK_FILES.items() for x in pair])
    marked = files.select("project", table[F.col("path")].alias("framework")).where("framework is not null")
    packages = packages or {"react": "react", "vue": "vue", "next": "nextjs", "express": "express", "@angular/core": "angular", "svelte": "svelte"}
    known = F.create_map(*[F.lit(x) for pair in packages.items() for x in pair])
    keys = F.concat(*[F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", f"$.{k}"), "map<string,string>")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])
    named = files.where("path = 'package.json'").select("project", F.explode(keys).alias("k")).select("project", known[F.col("k")].alias("framework")).where("framework is not null")
    return marked.unionByName(named).distinct()


def scan_summary(files: DataFrame) -> DataFrame:
    """One row a project: languages, files, lines, size class."""
    return files.groupBy("project").agg(F.array_sort(F.collect_set("lang_name")).alias("languages"), F.count(F.lit(1)).alias("n_files"), F.sum("size_lines").alias("n_lines")).withColumn("size_class", P.size_class("n_files"))


def workspaces(root: str) -> list[str]:
    """Folders of the packages of a workspace: the 'packages' list of pnpm-workspace.yaml, else package.json workspaces;
    'prefix/*' stands for its subfolders. A driver step on a few small files."""
    patterns: list[str] = []
    listed = os.path.join(root, "pnpm-workspace.yaml")
    package = os.path.join(root, "package.json")
    if os.path.exists(listed):
        inside = False
        for line in open(listed, encoding="utf-8"):
            if re.match(r"packages\s*:", line):
                inside = True
            elif inside and (m := re.match(r"\s*-\s*['\"]?([^'\"#\s]+)", line)):
                patterns.append(m.group(1))
            elif line.strip() and not line.startswith((" ", "-", "#")):
                inside = False
    elif os.path.exists(package):
        with open(package, encoding="utf-8") as f:
            found = json.load(f).get("workspaces", [])
        patterns = found.get("packages", []) if isinstance(found, dict) else found
    out: list[str] = []
    for p in patterns:
        if p.startswith("!"):
            continue
        if p.endswith("/*"):
            base = os.path.join(root, p[:-2])
            out += sorted(os.path.join(p[:-2], x) for x in (os.listdir(base) if os.path.isdir(base) else []) if os.path.isdir(os.path.join(base, x)))
        elif os.path.isdir(os.path.join(root, p)):
            out.append(p)
    return list(dict.fromkeys(out))

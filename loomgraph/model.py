"""Vocabularies, thresholds and table schemas of the property graph."""

from __future__ import annotations

# The type names, levels, patterns and numbers below are part of the data model.
NODE_TYPES = (
    "file", "function", "class", "module", "concept",
    "config", "document", "service", "table", "endpoint", "pipeline", "schema", "resource",
    "domain", "flow", "step",
    "article", "entity", "topic", "claim", "source",
)
EDGE_CATEGORIES = {
    "structural": ("imports", "exports", "contains", "inherits", "implements"),
    "behavioral": ("calls", "subscribes", "publishes", "middleware"),
    "data_flow": ("reads_from", "writes_to", "transforms", "validates"),
    "dependencies": ("depends_on", "tested_by", "configures"),
    "semantic": ("related", "similar_to"),
    "infrastructure": ("deploys", "serves", "provisions", "triggers", "migrates", "documents", "routes", "defines_schema"),
    "domain": ("contains_flow", "flow_step", "cross_domain"),
    "knowledge": ("cites", "contradicts", "builds_on", "exemplifies", "categorized_under", "authored_by"),
}
EDGE_TYPES = tuple(t for types in EDGE_CATEGORIES.values() for t in types)
SMELLS = (
    "duplicate_logic", "unclear_coupling", "low_cohesion", "god_node", "unstable_interface", "orphan_node", "circular_dependency", "over_connected", "name_duplicate", "layer_violation",
)
RISK_FACTORS = ("high_coupling", "no_test_coverage", "frequent_changes", "large_blast_radius", "critical_path", "single_author", "recent_churn", "has_structural_warnings")
SECURITY_CATEGORIES = ("hardcoded_secret", "sql_injection", "xss_risk", "unsafe_eval", "unsafe_exec", "unsafe_deserialization", "path_traversal", "weak_crypto")
SEVERITIES = ("low", "medium", "high")
COMPLEXITIES = ("simple", "moderate", "complex")
LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp",
    ".swift": "swift", ".kt": "kotlin", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown",
    ".mdx": "markdown", ".sql": "sql", ".graphql": "graphql", ".gql": "graphql", ".proto": "protobuf", ".tf": "terraform", ".dockerfile": "docker", ".css": "css", ".scss": "scss",
    ".sass": "sass", ".html": "html",
}
SOURCE_LANGUAGES = ("typescript", "javascript", "python", "go", "rust", "java", "kotlin", "ruby", "php", "c", "cpp", "csharp", "swift", "bash")
CONFIG_LANGUAGES = ("json", "yaml", "toml")
DOCUMENT_LANGUAGES = ("markdown", "html")
FRAMEWORK_FILES = {
    "package.json": "node", "Cargo.toml": "rust", "go.mod": "go", "requirements.txt": "python", "pyproject.toml": "python", "pom.xml": "java", "build.gradle": "java",
    "Gemfile": "ruby", "composer.json": "php",
}
EXCLUDED = (
    "**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/.next/**", "**/.nuxt/**", "**/coverage/**", "**/__pycache__/**", "**/*.pyc", "**/target/**", "**/.cargo/**",
    "**/*.min.js", "**/*.min.css", "**/*.map", "**/test-results/**", "**/playwright-report/**",
)
#: Path patterns of the layers, first match wins; paths that match none are 'general'.
LAYER_PATTERNS = (
    ("infrastructure", r"infra|k8s|docker|terraform|deploy|ci|cd|github|\.github"),
    ("config", r"config|settings|env|\.env"),
    ("schema", r"schema|migration|prisma|model|entity|type"),
    ("data", r"store|repository|repo|db|database|storage|cache|persist"),
    ("domain", r"service|domain|core|business|use.?case|command|query"),
    ("api", r"controller|handler|route|router|endpoint|resolver|api"),
    ("ui", r"component|page|view|screen|widget|layout|ui"),
    ("util", r"util|helper|lib|common|shared|tool"),
    ("test", r"test|spec|__tests__|fixture|mock"),
)
LAYER_RANKS = {"infrastructure": 0, "config": 1, "schema": 2, "data": 3, "domain": 4, "api": 5, "ui": 6}
GOD_OUT_DEGREE, GOD_FUNCTIONS, OVER_CONNECTED = 20, 25, 30
CYCLE_LENGTH, COUPLING_SHARE, COUPLING_IMPORTS = 6, 0.4, 3
COHESION_DOMAINS, COHESION_SHARE = 3, 0.5
UNSTABLE_CHANGES, UNSTABLE_IN_DEGREE = 10, 5
RISK_WEIGHTS = {"blast": 0.35, "coupling": 0.25, "test_gap": 0.25, "churn": 0.15}
COUPLING_CAP, CHURN_CAP = 40, 20
MAX_FILE_BYTES = 10 * 1024 * 1024
HISTORY_KEPT, COMMITS_PER_FILE = 50, 50

NODES = (
    "id string, project string, node_type string, label string, node_name string, file string, start_line int, end_line int, summary string, complexity string, tags array<string>, layer string, "
    "metadata map<string,string>, risk_score double, risk_factors array<string>, detected_patterns array<string>, "
    "structural_warnings array<struct<category:string,severity:string,description:string,related_node_ids:array<string>,heuristic:string>>, "
    "security_warnings array<struct<category:string,severity:string,description:string,line:int,pattern:string,snippet:string>>, "
    "decision_context struct<commits:array<struct<sha:string,date:string,message:string,author:string>>,primary_authors:array<string>,last_changed:string,change_frequency:int,"
    "rationale_snippets:array<string>,pr_references:array<string>,changelog_entries:array<string>>, ord long, recorded_at timestamp, removed_at timestamp"
)
EDGES = "edge_id long, project string, source string, target string, edge_type string, direction string, weight double, ord long, recorded_at timestamp"

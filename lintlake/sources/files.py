"""Sources: code trees, reports, rules, ground truth, manifests; and the path rules that decide what is scanned."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File suffixes and their languages.
LANGUAGES = {"py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "php": "php", "phtml": "php"}
EVIDENCE_LANGUAGES = {**LANGUAGES, "jsx": "javascript", "ts": "javascript", "tsx": "javascript"}
# Folders that are never scanned.
BASELINE_DIRS = ("node_modules", "vendor", "dist", "build", "__pycache__", ".git", ".venv", "venv")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column, unknown: str | None = None, table: dict[str, str] = LANGUAGES) -> Column:
    """Language by suffix; null or `unknown` where the suffix has none."""
    found = F.create_map(*[F.lit(x) for p in table.items() for x in p])[suffix(path)]
    return F.coalesce(found, F.lit(unknown)) if unknown is not None else found


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regex over the whole relative path; * crosses slashes."""
    return fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")


def excluded(rel: Column, dirs: Iterable[str] = (), globs: Iterable[str] = ()) -> Column:
    """Whether a relative path has an excluded directory among its parents (any case) or fits an excluded pattern."""
    parents = F.slice(F.split(F.lower(rel), "/"), F.lit(1), F.size(F.split(rel, "/")) - 1)
    names = sorted({d.lower() for d in dirs})
    out = F.exists(parents, lambda p: p.isin(*names)) if names else F.lit(False)
    for g in globs:
        out = out | rel.rlike(glob_regex(g))
    return out


def code_files(spark: SparkSession, root: str, dirs: Iterable[str] = BASELINE_DIRS, globs: Iterable[str] = ()) -> DataFrame:
    """path, language, content of the supported files under root. Paths are filtered before any content is read: only the columns that are asked for are loaded from a binary file source."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/").removeprefix("file://") + "/", "")
    listed = raw.withColumn("rel", rel).withColumn("language", language_of(F.col("path")))
    kept = listed.filter(F.col("language").isNotNull() & ~excluded(F.col("rel"), dirs, globs))
    return kept.select(F.col("rel").alias("path"), "language", F.decode("content", "UTF-8").alias("content"), "modificationTime")


def line_count(text: Column) -> Column:
    """Lines as text editors count them: a trailing line feed ends the last line, an empty text has none."""
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """kind, category, position, pattern, type, severity, mitigates of a YAML or JSON rule file. An empty file has no rules; an unknown suffix or another shape than a mapping raises ValueError. Rule files are small and are read through Spark's text source, so any store will do."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml

        doc = yaml.safe_load(text) or {}
    elif path.endswith(".json"):
        doc = json.loads(text) if text.strip() else {}
    else:
        raise ValueError(f"neither YAML nor JSON: {path}")
    if not isinstance(doc, dict):
        raise ValueError(f"not a mapping: {path}")
    out = []
    for i, r in enumerate(doc.get("sources") or []):
        out.append(("source", None, i, r.get("pattern"), r.get("type"), r.get("severity"), None))
    for category, items in (doc.get("sinks") or {}).items():
        out += [("sink", category, i, r.get("pattern"), r.get("type"), r.get("severity"), None) for i, r in enumerate(items or [])]
    for i, r in enumerate(doc.get("sanitizers") or []):
        out.append(("sanitizer", None, i, r.get("pattern"), None, None, list(r.get("mitigates") or [])))
    return spark.createDataFrame(out, "kind string, category string, position int, pattern string, type string, severity string, mitigates array<string>")


def scanner_report(spark: SparkSession, path: str) -> DataFrame:
    """Matches of an external scanner's JSON report: check_id, path, line, severity, message, fingerprint (its own, or SHA-256 of check|path|line|message)."""
    schema = "results array<struct<check_id string, path string, start struct<line int, col int>, extra struct<message string, severity string, fingerprint string>>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    flat = r.select("r.check_id", "r.path", F.col("r.start.line").alias("line"), "r.extra.severity", "r.extra.message", F.col("r.extra.fingerprint").alias("_f"))
    return flat.select("check_id", "path", "line", "severity", "message", fingerprint("_f").alias("fingerprint"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """The findings of one JSON report document, with its target: target, finding_id, rule_id, vulnerability_type, severity, triage_status, file_path, line_number. A missing or odd field is null."""
    place = "location struct<file_path string, line_number int, column_number int>"
    schema = f"scan_metadata struct<target string>, findings array<struct<finding_id string, rule_id string, vulnerability_type string, severity string, triage_status string, {place}>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    flat = doc.select("scan_metadata.target", F.explode("findings").alias("f"))
    return flat.select("target", "f.finding_id", "f.rule_id", "f.vulnerability_type", "f.severity", "f.triage_status", "f.location.file_path", "f.location.line_number")


def fingerprint(own: str) -> Column:
    return F.coalesce(F.nullif(F.col(own), F.lit("")), F.sha2(F.concat_ws("|", "check_id", "path", "line", "message"), 256))


# Benchmark categories and their families.
CATEGORY_FAMILY = {"cmdi": "COMMAND_INJECTION", "sqli": "SQL_INJECTION", "pathtraver": "PATH_TRAVERSAL", "xss": "XSS", "codeinj": "CODE_INJECTION", "deserialization": "INSECURE_DESERIALIZATION", "redirect": "OPEN_REDIRECT"}


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """case_id, category, family, vulnerable, cwe of a CSV without header; blank and # lines are skipped; a row of under four fields, or no row at all, raises ValueError."""
    raw = spark.read.schema("case_id string, category string, vulnerable string, cwe string").option("comment", "#").csv(path).filter("case_id IS NOT NULL")
    total, short = raw.agg(F.count("*"), F.count_if(F.col("cwe").isNull())).first()
    if not total or short:
        raise ValueError(f"{path}: {'no rows' if not total else f'{short} rows with under four fields'}")
    family = F.create_map(*[F.lit(x) for p in CATEGORY_FAMILY.items() for x in p])[F.trim("category")]
    return raw.select(F.trim("case_id").alias("case_id"), F.trim("category").alias("category"), family.alias("family"), (F.lower(F.trim("vulnerable")) == "true").alias("vulnerable"), F.trim("cwe").try_cast("int").alias("cwe"))


def manifest(spark: SparkSession, path: str, only: Iterable[str] = ()) -> DataFrame:
    """Cases of a benchmark manifest: exactly one of rules and rule profile each (else ValueError), optionally only some."""
    c = spark.read.schema("cases array<struct<case_id string, family string, target string, reviewed_rules string, reviewed_rule_profile string, goal string>>").option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
    only = tuple(only)
    c = c.filter(F.col("case_id").isin(*only)) if only else c
    if not c.filter(F.col("reviewed_rules").isNull() == F.col("reviewed_rule_profile").isNull()).isEmpty():
        raise ValueError(f"{path}: a case needs exactly one of reviewed_rules and reviewed_rule_profile")
    return c


def repo_profile(files: DataFrame, hints: dict[str, tuple[str, ...]], inspected: int = 24) -> DataFrame:
    """languages, n_files, hints of a tree in one row: hints from the first `inspected` files, configuration files first, then by path (a feature's bound, not a sample of a count)."""
    config = F.col("path").rlike(r"(?i)(^|/)(requirements\.txt|package\.json|pom\.xml|composer\.json|pyproject\.toml)$")
    seen = files.orderBy(config.desc(), "path").limit(inspected)
    found = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(x) for x in words]), lambda w: F.col("content").contains(w)), F.lit(name)) for name, words in hints.items()]))
    hint = seen.select(F.explode(found).alias("h")).agg(F.array_sort(F.collect_set("h")).alias("hints"))
    lang = files.agg(F.array_sort(F.collect_set("language")).alias("languages"), F.count("*").alias("n_files"))
    return lang.unionByName(hint, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("languages", "n_files", "hints")])

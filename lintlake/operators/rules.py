"""Rule algebra: merging rule sets, normalizing and validating rules, exporting the older shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.findings import numbered


def merge(base: DataFrame, overlay: DataFrame, identity: list[str]) -> DataFrame:
    """base and overlay (same columns, with rule_no as place in their file): the base wins where identities are equal, order is kept (position). Identity columns that are lists count in their order."""
    both = base.withColumn("_o", F.lit(0)).unionByName(overlay.withColumn("_o", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*identity).orderBy("_o", "rule_no"))
    kept = both.withColumn("_n", first).filter("_n = 1").drop("_n")
    return numbered(kept, "position", "_o", "rule_no").withColumn("position", F.col("position").cast("int")).drop("_o")


def merge_documents(*sets: DataFrame) -> DataFrame:
    """Union of normalized rules, equal ones (by canonical JSON: sorted keys) once, each with its first source."""
    out = None
    for i, s in enumerate(sets):
        s = s.withColumn("source_no", F.lit(i))
        out = s if out is None else out.unionByName(s)
    names = sorted(c for c in out.columns if c != "source_no")
    canon = F.sha2(F.to_json(F.struct(*names)), 256)
    return out.withColumn("digest", canon).groupBy("digest", *names).agg(F.min("source_no").alias("source_no")).drop("digest")


# The category of the older rule shape that a family exports to.
EXPORT_CATEGORY = {
    "SQL_INJECTION": "sqli", "COMMAND_INJECTION": "rce", "CODE_INJECTION": "rce", "PATH_TRAVERSAL": "path_traversal", "XSS": "xss", "SSRF": "ssrf", "NOSQL_INJECTION": "nosqli", "XXE": "xxe",
    "IDOR": "idor", "SSTI": "ssti", "INSECURE_DESERIALIZATION": "deserialization", "MASS_ASSIGNMENT": "mass_assignment", "OPEN_REDIRECT": "open_redirect",
}


def validate(rules: DataFrame) -> DataFrame:
    """All issues of every rule, none hides another: rule_id, level, code."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    issue = lambda on, level, code: F.when(on, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    issues = F.array(
        issue(empty("rule_id"), "error", "missing-rule-id"), issue(empty("title"), "warning", "missing-title"), issue(empty("language"), "error", "missing-language"),
        issue(~F.coalesce(F.col("severity"), F.lit("")).isin("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"), "error", "bad-severity"),
        issue(F.size("sources") <= 0, "error", "no-sources"), issue(F.size("sinks") <= 0, "error", "no-sinks"), issue(F.size("sanitizers") <= 0, "warning", "no-sanitizers"),
        issue(~F.coalesce(F.col("cwe"), F.lit("")).rlike("^CWE-[0-9]+$"), "warning", "bad-cwe"), issue(F.exists("sinks", lambda s: F.length(s) < 3), "warning", "short-sink-pattern"),
    )
    return rules.select("rule_id", F.explode(F.array_compact(issues)).alias("i")).select("rule_id", "i.level", "i.code")


def skip_reason(raw: DataFrame) -> Column:
    """Why a raw rule is not imported: only taint-mode rules with sources and sinks in a known language are."""
    return (
        F.when(F.coalesce(F.col("mode"), F.lit("search")) != "taint", "not-taint-mode").when(~F.coalesce(F.col("language"), F.lit("")).isin("python", "javascript", "java", "php"), "unsupported-language")
        .when(F.size("sources") <= 0, "no-sources").when(F.size("sinks") <= 0, "no-sinks")
    )


def export_legacy(rules: DataFrame) -> DataFrame:
    """role, category, pattern, family, severity, rule_id of the older rule shape: the sources, sinks and sanitizers of all rules whose family has a category there.

    Equal ones are exported once, with the first rule that has them: sources by pattern (they have no family and MEDIUM
    severity), sinks by category, pattern and family, sanitizers by pattern and the family that they mitigate. Blank
    patterns are skipped. All three roles are exploded from the rule's row at once.
    """
    category = F.create_map(*[F.lit(x) for p in EXPORT_CATEGORY.items() for x in p])[F.col("family")]
    role = lambda name, column, family, cat, severity: F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(name).alias("role"), i.alias("pos"), F.trim(x).alias("pattern"), family.alias("family"), cat.alias("category"), severity.alias("severity")))
    none, kind = F.lit(None).cast("string"), F.col("family")
    every = F.concat(role("source", "sources", none, none, F.lit("MEDIUM")), role("sink", "sinks", kind, F.col("_c"), F.coalesce("severity", F.lit("MEDIUM"))), role("sanitizer", "sanitizers", kind, none, none))
    out = rules.withColumn("_c", category).filter("_c IS NOT NULL").select("rule_id", "rule_no", F.explode(every).alias("x")).select("rule_id", "rule_no", "x.*").filter("pattern <> ''")
    first = F.min_by(F.struct("rule_id", "severity"), F.struct("rule_no", "pos")).alias("_f")
    return out.groupBy("role", "category", "pattern", "family").agg(first).select("role", "category", "pattern", "family", "_f.severity", "_f.rule_id")


def export_skips(rules: DataFrame) -> DataFrame:
    """rule_id, reason of the rules that are not exported."""
    return rules.filter(~F.coalesce(F.col("family"), F.lit("")).isin(*EXPORT_CATEGORY)).select("rule_id", F.concat(F.lit("unsupported legacy family mapping ("), F.coalesce("family", F.lit("None")), F.lit(")")).alias("reason"))


def unique_in_order(values: Column) -> Column:
    """First occurrences in order, without null or empty ones."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def tidy_taxonomy(text: Column) -> Column:
    """CWE ids and OWASP categories of a text: struct(cwe, owasp)."""
    return F.struct(F.nullif(F.upper(F.regexp_extract(text, r"(?i)(CWE-\d+)", 1)), F.lit("")).alias("cwe"), F.nullif(F.upper(F.regexp_extract(text, r"(?i)(A\d{2}:20\d{2})", 1)), F.lit("")).alias("owasp"))

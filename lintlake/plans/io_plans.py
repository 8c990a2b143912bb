"""Queries of loaders and sinks: each writes a file of the kind from the tables to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lintlake.plans.base import TRUTH_SQL, query, truth
from lintlake.plans.rule_plans import _ISSUES, _R, _RULES, _rules
from lintlake.session import shared_dir, table
from lintlake.sources import files, sinks


def _path(spark, name: str, suffix: str = "") -> str:
    return f"{shared_dir(spark)}/io-{name}-{uuid.uuid4().hex}{suffix}"


def _one_file(df, path: str) -> str:
    """A bounded document of one line as a file of its own."""
    df.coalesce(1).write.text(path)
    return path


@query("s7_rule_file", sql="WITH p AS (SELECT DISTINCT p_type, p_brand FROM part) SELECT 'sink' AS kind, lower(p_type) AS category, p_brand AS pattern, p_type AS type, CASE WHEN p_brand LIKE '%1%' THEN 'HIGH' ELSE 'LOW' END AS severity, NULL AS mitigates FROM p UNION ALL SELECT DISTINCT 'source', NULL, p_type, 'HTTP_PARAMETER', 'MEDIUM', NULL FROM p UNION ALL SELECT DISTINCT 'sanitizer', NULL, p_brand, NULL, NULL, 'XSS,' || p_brand FROM p")
def s7(spark, d):
    """A rule file of the parts' types and brands: sinks by category, sources and sanitizers."""
    p = table(spark, d, "part").select("p_type", "p_brand").distinct()
    entry = F.struct(F.col("p_brand").alias("pattern"), F.col("p_type").alias("type"), F.when(F.col("p_brand").contains("1"), "HIGH").otherwise("LOW").alias("severity"))
    sinks_ = p.groupBy("p_type").agg(F.collect_list(entry).alias("x")).agg(F.map_from_entries(F.collect_list(F.struct(F.lower("p_type"), "x"))).alias("sinks"))
    sources = p.select("p_type").distinct().agg(F.collect_list(F.struct(F.col("p_type").alias("pattern"), F.lit("HTTP_PARAMETER").alias("type"), F.lit("MEDIUM").alias("severity"))).alias("sources"))
    cleaners = p.select("p_brand").distinct().agg(F.collect_list(F.struct(F.col("p_brand").alias("pattern"), F.array(F.lit("XSS"), "p_brand").alias("mitigates"))).alias("sanitizers"))
    doc = sinks_.join(sources, F.lit(True)).join(cleaners, F.lit(True)).select(F.to_json(F.struct("sinks", "sources", "sanitizers")).alias("value"))  # one row each
    return files.rules(spark, _one_file(doc, _path(spark, "rules", ".json"))).select("kind", "category", "pattern", "type", "severity", F.array_join("mitigates", ",").alias("mitigates"))


@query("s11_report_load", sql="SELECT 'repo' AS target, p_brand || '-' || p_type AS finding_id, p_brand AS rule_id, p_type AS vulnerability_type, CASE WHEN n > 10 THEN 'HIGH' ELSE 'LOW' END AS severity, 'likely' AS triage_status, 'src/' || p_brand || '.py' AS file_path, CAST(n AS INTEGER) AS line_number FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)")
def s11(spark, d):
    """A report with a finding for each brand and type of parts, as one document."""
    p = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    place = F.struct(F.concat(F.lit("src/"), F.col("p_brand"), F.lit(".py")).alias("file_path"), F.col("n").alias("line_number"), F.lit(1).alias("column_number")).alias("location")
    item = F.struct(F.concat_ws("-", "p_brand", "p_type").alias("finding_id"), F.col("p_brand").alias("rule_id"), F.col("p_type").alias("vulnerability_type"), F.when(F.col("n") > 10, "HIGH").otherwise("LOW").alias("severity"), F.lit("likely").alias("triage_status"), place)
    doc = p.agg(F.to_json(F.struct(F.struct(F.lit("repo").alias("target")).alias("scan_metadata"), F.collect_list(item).alias("findings"))).alias("value"))
    return files.report(spark, _one_file(doc, _path(spark, "report")))


@query("s12_truth_file", sql="SELECT printf('BenchmarkTest%05d', doc_id) AS case_id, CASE doc_id % 3 WHEN 0 THEN 'SQL_INJECTION' WHEN 1 THEN 'XSS' END AS family, quality = 0 AS vulnerable, CAST(doc_id % 100 AS INTEGER) AS cwe FROM labels WHERE doc_id % 10 > 0")
def s12f(spark, d):
    """The truth file itself, with a comment in every tenth row."""
    i = F.col("doc_id")
    line = F.concat_ws(",", F.concat(F.when(i % 10 == 0, "# ").otherwise(""), F.format_string("BenchmarkTest%05d", i)), F.when(i % 3 == 0, " sqli").when(i % 3 == 1, "xss ").otherwise("other"), F.upper((F.col("quality") == 0).cast("string")), (i % 100).cast("string"))
    path = _path(spark, "truth")
    table(spark, d, "labels").select(line.alias("value")).write.text(path)
    return files.ground_truth(spark, path).select("case_id", "family", "vulnerable", "cwe")


@query("s13_manifest_file", sql="SELECT 'case' || n_nationkey AS case_id, n_name AS family FROM nation WHERE n_nationkey IN (3, 5, 8)")
def s13f(spark, d):
    """A manifest of a case for each nation, of which three are asked for."""
    n = F.col("n_nationkey")
    case = F.struct(F.concat(F.lit("case"), n.cast("string")).alias("case_id"), F.col("n_name").alias("family"), F.when(n % 2 == 0, "r.yaml").alias("reviewed_rules"), F.when(n % 2 == 1, "fast").alias("reviewed_rule_profile"))
    doc = table(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list(case).alias("cases"))).alias("value"))
    return files.manifest(spark, _one_file(doc, _path(spark, "manifest")), ("case3", "case5", "case8")).select("case_id", "family")


@query("s9_scanner_report", sql="SELECT 'chk-' || n_regionkey AS check_id, 'src/' || n_nationkey || '.py' AS path, CAST(n_nationkey AS INTEGER) AS line, n_name AS message, CASE WHEN n_nationkey % 2 = 0 THEN 'own' || n_nationkey ELSE sha256('chk-' || n_regionkey || '|src/' || n_nationkey || '.py|' || n_nationkey || '|' || n_name) END AS fingerprint FROM nation")
def s9f(spark, d):
    """A scanner's report of a match for each nation; every other has a fingerprint of its own."""
    n = F.col("n_nationkey")
    extra = F.struct(F.col("n_name").alias("message"), F.lit("ERROR").alias("severity"), F.when(n % 2 == 0, F.concat(F.lit("own"), n.cast("string"))).otherwise("").alias("fingerprint"))
    match = F.struct(F.concat(F.lit("chk-"), F.col("n_regionkey").cast("string")).alias("check_id"), F.concat(F.lit("src/"), n.cast("string"), F.lit(".py")).alias("path"), F.struct(n.cast("int").alias("line"), F.lit(1).alias("col")).alias("start"), extra.alias("extra"))
    doc = table(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list(match).alias("results"))).alias("value"))
    return files.scanner_report(spark, _one_file(doc, _path(spark, "scanner"))).select("check_id", "path", "line", "message", "fingerprint")


@query("k4_score_files", sql=f"WITH {TRUTH_SQL} SELECT family, count(*) AS cases, count(*) FILTER (WHERE vulnerable) AS vulnerable, '| ' || family || ' | ' || count(*) || ' | ' || count(*) FILTER (WHERE vulnerable) || ' |' AS line FROM truth GROUP BY family")
def k4(spark, d):
    """Scores as JSON, and the Markdown row of each, both read back."""
    scores = truth(spark, d).groupBy("family").agg(F.count("*").alias("cases"), F.count_if("vulnerable").alias("vulnerable"))
    path = _path(spark, "scores")
    sinks.write_scores(scores, path)
    read = spark.read.schema("family string, cases long, vulnerable long").json(f"{path}/json")
    line = spark.read.text(f"{path}/markdown").select(F.trim(F.split_part("value", F.lit("|"), F.lit(2))).alias("family"), F.col("value").alias("line"))
    return read.join(line, "family")


@query("k5_progress_lines", sql="SELECT event_id, user_id, event_type FROM events")
def k5(spark, d):
    path = _path(spark, "progress")
    sinks.append_lines(table(spark, d, "events").select("event_id", "user_id", "event_type"), path)
    return spark.read.schema("event_id long, user_id long, event_type string").json(path)


@query("k6_trajectory_append", sql="SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def k6(spark, d):
    """Appended in two runs; neither overwrites the other."""
    e, path = table(spark, d, "events").select("event_id", "event_type"), _path(spark, "trajectory")
    for half in (0, 1):
        sinks.append_lines(e.filter(F.col("event_id") % 2 == half), path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("k7_job_store", sql="SELECT user_id AS scan_id, max(event_id) AS version, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def k7(spark, d):
    """Every event saves its job; of each job the last record is loaded."""
    e, path = table(spark, d, "events").select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("version"), F.col("event_type").alias("state")), _path(spark, "jobs")
    for third in (2, 0, 1):  # not in the order of their versions
        sinks.save_jobs(e.filter(F.col("version") % 3 == third), path)
    return sinks.load_jobs(spark, path, "scan_id long, version long, state string")


@query("k10_rule_document", sql="SELECT DISTINCT p_brand || ':' || p_type AS rule_id, p_type AS pattern, CASE WHEN p_brand LIKE '%2%' THEN 'HIGH' ELSE 'LOW' END AS severity FROM part")
def k10(spark, d):
    """A rule set of the parts' brands and types as one JSON document, written and read back."""
    rules = table(spark, d, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("rule_id"), F.col("p_type").alias("pattern"), F.when(F.col("p_brand").contains("2"), "HIGH").otherwise("LOW").alias("severity")).distinct()
    path = _path(spark, "rule-document")
    spark.range(1).select(F.lit(sinks.rule_document(rules)).alias("value")).coalesce(1).write.text(path)
    doc = spark.read.schema("rules array<struct<rule_id string, pattern string, severity string>>").option("multiLine", True).json(path)
    return doc.select(F.explode("rules").alias("r")).select("r.*")


@query("t16_review_bundle", sql=f"WITH {_R}, {_RULES}, i AS (" + " UNION ALL ".join(f"SELECT '{lv}' AS level FROM x WHERE {on}" for on, lv, _ in _ISSUES) + ") SELECT count(*) FILTER (WHERE level = 'error') = 0 AS valid, (SELECT count(*) FROM x) AS rules_checked, count(*) FILTER (WHERE level = 'error') AS error_count, count(*) FILTER (WHERE level = 'warning') AS warning_count FROM i")
def t16(spark, d):
    return sinks.write_bundle(_rules(spark, d), _path(spark, "bundle"))

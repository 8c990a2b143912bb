"""Queries of reports, diffs, exports and the queue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lintlake.dims import QUEUE_RANK_SQL, STATUS_RANK_SQL
from lintlake.operators import reports as ops
from lintlake.plans.base import findings, query
from lintlake.session import table

_STATUS_DIM = "(SELECT unnest(['confirmed', 'likely', 'needs-review', 'suppressed']) AS triage_status)"


@query("a1_severity_summary", findings_sql="SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")) + " FROM f")
def a1(spark, d):
    return ops.severity_summary(findings(spark, d))


@query("a2_status_counts_filled", findings_sql=f"SELECT triage_status, count(finding_id) AS n FROM {_STATUS_DIM} LEFT JOIN (SELECT * FROM f WHERE triage_status <> 'likely') USING (triage_status) GROUP BY 1")
def a2(spark, d):
    return ops.status_counts(findings(spark, d).filter("triage_status <> 'likely' AND finding_id IS NOT NULL"), True)


@query("a3_status_counts", findings_sql="SELECT triage_status, count(*) AS n FROM f GROUP BY 1")
def a3(spark, d):
    return ops.status_counts(findings(spark, d), False)


@query("a4_route_counts", findings_sql="SELECT coalesce(CASE WHEN k % 7 > 0 THEN CASE WHEN confidence >= 0.85 AND NOT sanitized THEN 'direct-judge' ELSE 'skeptic-review' END END, 'unknown') AS route, count(*) AS n FROM f GROUP BY 1")
def a4(spark, d):
    route = F.when(F.col("k") % 7 > 0, F.when((F.col("confidence") >= 0.85) & ~F.col("sanitized"), "direct-judge").otherwise("skeptic-review"))
    return findings(spark, d).groupBy(F.coalesce(route, F.lit("unknown")).alias("route")).agg(F.count("*").alias("n"))


@query("a5_review_averages", findings_sql="SELECT language, coalesce(round(avg(confidence), 3), 0.0) AS auditor_average, count(*) FILTER (WHERE sanitized) AS executed, count(*) FILTER (WHERE NOT sanitized) AS skipped, count(*) FILTER (WHERE sanitized AND n_sanitizers > 1) AS mitigated FROM f GROUP BY language")
def a5(spark, d):
    return findings(spark, d).groupBy("language").agg(F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("auditor_average"), F.count_if("sanitized").alias("executed"), F.count_if(~F.col("sanitized")).alias("skipped"), F.count_if(F.col("sanitized") & (F.col("n_sanitizers") > 1)).alias("mitigated"))


_DIMS = {"vulnerability_type": "UNKNOWN", "severity": "UNKNOWN", "triage_status": "unknown", "file_path": "UNKNOWN", "sink_function": "UNKNOWN", "variable": "UNKNOWN"}


@query("a6_dimension_summary", findings_sql=" UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce(nullif({c}, ''), '{v}') AS value, count(*) AS n FROM f GROUP BY 2" for c, v in _DIMS.items()))
def a6(spark, d):
    return ops.summary(findings(spark, d), _DIMS)


@query("a7_duplicate_groups", findings_sql="SELECT file_path, vulnerability_type, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1")
def a7(spark, d):
    return ops.duplicate_groups(findings(spark, d), ["file_path", "vulnerability_type"])


@query("a7_duplicate_delta", findings_sql="SELECT count(*) AS n, count(DISTINCT (file_path, vulnerability_type)) AS n_distinct, count(*) - count(DISTINCT (file_path, vulnerability_type)) AS delta FROM f")
def a7d(spark, d):
    return ops.duplicate_delta(findings(spark, d), ["file_path", "vulnerability_type"])


@query("a8_scanner_summary", findings_sql="SELECT 'rule_id' AS dimension, rule_id AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'files_scanned', 'all', count(DISTINCT file_path) FROM f")
def a8(spark, d):
    f = findings(spark, d)
    files = f.agg(F.count_distinct("file_path").alias("n")).select(F.lit("files_scanned").alias("dimension"), F.lit("all").alias("value"), "n")
    return ops.summary(f, {"rule_id": "UNKNOWN", "severity": "UNKNOWN"}).unionByName(files)


@query("a9_case_rollup", findings_sql="SELECT language, severity, count(*) AS n, CAST(sum(steps) AS BIGINT) AS steps FROM f GROUP BY ROLLUP (language, severity)")
def a9(spark, d):
    return findings(spark, d).rollup("language", "severity").agg(F.count("*").alias("n"), F.sum("steps").alias("steps"))


@query("a9_map_sums", findings_sql="SELECT severity, CAST(sum(n) AS BIGINT) AS n FROM (SELECT language, severity, count(*) AS n FROM f GROUP BY ALL) GROUP BY severity")
def a9m(spark, d):
    per = findings(spark, d).groupBy("language", "severity").agg(F.count("*").alias("n")).groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("m"))
    return per.select(F.explode("m").alias("severity", "c")).groupBy("severity").agg(F.sum("c").alias("n"))


@query("a19_overlay_delta", findings_sql="SELECT count(*) AS n, count(*) FILTER (WHERE triage_status <> CASE WHEN ai_vulnerable IS NULL THEN triage_status WHEN ai_vulnerable THEN 'likely' ELSE 'suppressed' END) AS status_changed, count(*) FILTER (WHERE abs(confidence - ai_confidence) > 1e-9) AS confidence_changed, count(*) FILTER (WHERE ai_vulnerable IS NULL) AS fallback FROM f")
def a19(spark, d):
    ai = F.when(F.col("ai_vulnerable").isNull(), F.col("triage_status")).when(F.col("ai_vulnerable"), "likely").otherwise("suppressed")
    return findings(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("triage_status") != ai).alias("status_changed"), F.count_if(F.abs(F.col("confidence") - F.col("ai_confidence")) > 1e-9).alias("confidence_changed"), F.count_if(F.col("ai_vulnerable").isNull()).alias("fallback"))


@query("a24_dashboard_kpis", findings_sql="SELECT vulnerability_type, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, min(ordinal) LIMIT 5")
def a24(spark, d):
    return ops.most_common(findings(spark, d), "vulnerability_type", "ordinal", 5).select("vulnerability_type", "n")


@query("a25_provided_or_recount", findings_sql="SELECT source, CASE WHEN pc > 0 OR ph > 0 THEN pc ELSE c END AS critical, CASE WHEN pc > 0 OR ph > 0 THEN ph ELSE h END AS high FROM (SELECT source, count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'HIGH') AS h, coalesce(max(CASE WHEN k % 5 = 0 THEN 3 END), 0) AS pc, 0 AS ph FROM f GROUP BY source)")
def a25(spark, d):
    g = findings(spark, d).groupBy("source").agg(F.count_if(F.col("severity") == "CRITICAL").alias("c"), F.count_if(F.col("severity") == "HIGH").alias("h"), F.coalesce(F.max(F.when(F.col("k") % 5 == 0, 3)), F.lit(0)).cast("long").alias("pc"), F.lit(0).cast("long").alias("ph"))
    given = (F.col("pc") > 0) | (F.col("ph") > 0)
    return g.select("source", F.when(given, F.col("pc")).otherwise(F.col("c")).alias("critical"), F.when(given, F.col("ph")).otherwise(F.col("h")).alias("high"))


@query("a26_run_metadata", findings_sql="SELECT tool, count(*) AS calls, count(*) FILTER (WHERE ai_vulnerable IS NULL) AS fallbacks, CAST(sum(steps * 10 + 100) AS BIGINT) AS tokens FROM f GROUP BY tool")
def a26(spark, d):
    return findings(spark, d).groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(F.col("ai_vulnerable").isNull()).alias("fallbacks"), F.sum((F.col("steps") * 10 + 100).cast("long")).alias("tokens"))


@query("a28_run_monitor", sql="SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, round(count(*) FILTER (WHERE event_type <> 'error') / greatest(epoch_us(max(ts)) / 1e6::DOUBLE - epoch_us(min(ts)) / 1e6::DOUBLE, 1e-6), 9) AS rate, round(coalesce(avg(value), 0.0), 6) AS avg_seconds FROM events")
def a28(spark, d):
    e = table(spark, d, "events").select(F.to_timestamp("ts").alias("ts"), F.col("value").alias("seconds"), (F.col("event_type") != "error").alias("done"), (F.col("event_type") == "error").alias("failed"))
    return ops.monitor(e)


_ITEM = "to_json({'finding_id': finding_id, 'rule_id': rule_id, 'vulnerability_type': vulnerability_type, 'severity': severity, 'triage_status': triage_status, 'location': {'file_path': file_path, 'line_number': line_number, 'column_number': column_number}})"


@query("k1_json_export", findings_sql=f"""SELECT row_number() OVER (ORDER BY s, key) AS place, line FROM (
    SELECT 0 AS s, '' AS key, '{{"scan_metadata":{{"target":"repo","files_with_findings":' || count(DISTINCT file_path) || '}},"findings":[' AS line FROM f
    UNION ALL SELECT 1, finding_id, CASE WHEN finding_id = (SELECT min(finding_id) FROM f) THEN '' ELSE ',' END || CAST({_ITEM} AS VARCHAR) FROM f
    UNION ALL SELECT 2, '', '],"summary":' || CAST(to_json({{'total': count(*), 'critical': count(*) FILTER (WHERE severity = 'CRITICAL'), 'high': count(*) FILTER (WHERE severity = 'HIGH'), 'medium': count(*) FILTER (WHERE severity = 'MEDIUM'), 'low': count(*) FILTER (WHERE severity = 'LOW')}}) AS VARCHAR) || ',"errors":[]}}' FROM f)""")
def k1(spark, d):
    return ops.json_document(findings(spark, d), "repo")


@query("k2_sarif_rules", findings_sql="""SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS rule_index, rule_id, x.name AS name, x.d AS full_description, x.l AS language, CASE x.s WHEN 'CRITICAL' THEN '9.5' WHEN 'HIGH' THEN '8.0' WHEN 'MEDIUM' THEN '5.5' WHEN 'LOW' THEN '3.0' WHEN 'INFO' THEN '1.0' ELSE '0.0' END AS security_severity
    FROM (SELECT rule_id, min(ordinal) AS o, arg_min({'name': vulnerability_type, 'd': vulnerability_type || ' at ' || sink_function, 'l': language, 's': severity}, ordinal) AS x FROM f GROUP BY rule_id)""")
def k2r(spark, d):
    return ops.sarif_rules(findings(spark, d))


@query("k2_sarif_document")
def k2d(spark, d):
    return ops.sarif_document(findings(spark, d))


@query("k2_sarif_results", findings_sql="SELECT finding_id, f.rule_id, CAST(rule_index AS INTEGER) AS rule_index, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, f.rule_id || ':' || file_path || ':' || line_number AS fingerprint, greatest(column_number, 1) AS start_column FROM f JOIN (SELECT rule_id, row_number() OVER (ORDER BY min(ordinal)) - 1 AS rule_index FROM f GROUP BY rule_id) USING (rule_id)")
def k2(spark, d):
    return ops.sarif_results(findings(spark, d))


@query("k3_markdown", findings_sql="""SELECT row_number() OVER (ORDER BY r, i) AS place, line FROM (SELECT '' AS r, '' AS i, '# Security report' AS line
    UNION ALL SELECT r, '', h || ' (' || count(*) || ')' FROM (SELECT CASE severity WHEN 'CRITICAL' THEN '0' WHEN 'HIGH' THEN '1' WHEN 'MEDIUM' THEN '2' WHEN 'LOW' THEN '3' END AS r, '## ' || upper(severity[1]) || lower(severity[2:]) AS h FROM f) WHERE r IS NOT NULL GROUP BY r, h
    UNION ALL SELECT CASE severity WHEN 'CRITICAL' THEN '0' WHEN 'HIGH' THEN '1' WHEN 'MEDIUM' THEN '2' WHEN 'LOW' THEN '3' END, finding_id, printf('- %s %s:%d', finding_id, file_path, line_number) FROM f WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'))""")
def k3(spark, d):
    return ops.markdown(findings(spark, d))


@query("k8_review_memory", findings_sql="SELECT rule_id, arg_max(triage_status, ordinal) AS disposition, arg_max(finding_id, ordinal) AS note FROM f GROUP BY rule_id")
def k8(spark, d):
    f = findings(spark, d).select("rule_id", F.col("triage_status").alias("disposition"), F.col("finding_id").alias("note"), "ordinal")
    return ops.latest(f, "rule_id", F.col("ordinal"), "disposition", "note")


@query("k9_patch_export", findings_sql="SELECT finding_id, CAST(number AS INTEGER) AS number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS number FROM f) WHERE k % 4 = 0")
def k9(spark, d):
    f = findings(spark, d).withColumn("unified_diff", F.when(F.col("k") % 4 == 0, "--- a\n+++ b"))
    return ops.patches(f, "ordinal").select("finding_id", "number")


@query("k11_retention", sql="SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n > 100")
def k11(spark, d):
    return ops.keep_newest(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 100)


@query("w5_keep_newest", sql="SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n <= 5")
def w5(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    return o.withColumn("_n", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_orderkey")))).filter("_n <= 5").drop("_n")


_MUTED = "k % 10 = 0"


@query("p7_queue_filter", findings_sql="SELECT finding_id FROM f WHERE triage_status = 'likely' AND language = 'en' AND (file_path = 'src' OR starts_with(file_path, 'src/')) AND NOT (k % 10 = 0) AND contains(lower(concat_ws(' ', finding_id, rule_id, vulnerability_type, file_path, snippet, source_type, sink_function, language, severity, triage_status)), 'cursor')")
def p7(spark, d):
    f = findings(spark, d).withColumn("muted", F.expr(_MUTED))
    return ops.queue_filter(f, status="likely", language="en", path="src", needle="CURSOR", muted=False).select("finding_id")


@query("p8_selected_path", findings_sql="SELECT file_path, count(*) AS n FROM f WHERE file_path IN ('app/src0', 'src0') OR starts_with(file_path, 'app/src0/') OR starts_with(file_path, 'src0/') OR contains(file_path, '/src0/') GROUP BY 1")
def p8(spark, d):
    return findings(spark, d).filter(ops.path_selected(F.col("file_path"), "app\\src0/")).groupBy("file_path").agg(F.count("*").alias("n"))


_QUEUE = f"({_MUTED}), {STATUS_RANK_SQL.format('triage_status')}, {QUEUE_RANK_SQL.format('severity')}, coalesce(confidence, -1) DESC, line_number, finding_id"


@query("o1_queue_order", findings_sql=f"SELECT finding_id, row_number() OVER (ORDER BY {_QUEUE}) AS place FROM f QUALIFY place <= 100")
def o1(spark, d):
    return ops.queue_page(findings(spark, d).withColumn("muted", F.expr(_MUTED)), 1, "finding_id", 100).select("finding_id", "place")


@query("o2_rank_dimension", findings_sql="SELECT f.severity, queue_rank, strength, count(*) AS n FROM f JOIN (VALUES ('CRITICAL', 0, 5), ('HIGH', 1, 4), ('MEDIUM', 2, 3), ('LOW', 3, 2), ('INFO', 4, 1), ('UNKNOWN', 5, 0)) AS t(severity, queue_rank, strength) ON t.severity = f.severity GROUP BY ALL")
def o2(spark, d):
    """The findings' severities with their places in the queue and their strengths."""
    from lintlake.dims import queue_rank, strength

    s = F.col("severity")
    return findings(spark, d).groupBy("severity").agg(F.count("*").alias("n")).select("severity", queue_rank(s).alias("queue_rank"), strength(s).alias("strength"), "n")


@query("o3_report_order", findings_sql="SELECT source, n FROM (SELECT source, count(*) AS n, max(CASE WHEN k % 3 > 0 THEN ordinal END) AS ts FROM f GROUP BY source) ORDER BY coalesce(ts, 0) DESC, n DESC, source LIMIT 12")
def o3(spark, d):
    g = findings(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.max(F.when(F.col("k") % 3 > 0, F.col("ordinal"))).alias("ts"))
    return g.orderBy(F.coalesce("ts", F.lit(0)).desc(), F.desc("n"), "source").limit(12).select("source", "n")


@query("o4_pagination", findings_sql=f"SELECT finding_id, row_number() OVER (ORDER BY {_QUEUE}) AS place FROM f QUALIFY place BETWEEN 13 AND 24")
def o4(spark, d):
    return ops.queue_page(findings(spark, d).withColumn("muted", F.expr(_MUTED)), 2, "finding_id").select("finding_id", "place")


@query("o5_most_common", findings_sql="SELECT rule_id, n, first_pos FROM (SELECT rule_id, count(*) AS n, min(ordinal) AS first_pos FROM f GROUP BY 1) ORDER BY n DESC, first_pos LIMIT 5")
def o5(spark, d):
    return ops.most_common(findings(spark, d), "rule_id", "ordinal", 5)


_HALVES = "a AS (SELECT * FROM f WHERE k % 5 > 0), b AS (SELECT * FROM f WHERE k % 5 <> 1)"
_DELTA = "SELECT rule_id, coalesce(y, 0) - coalesce(x, 0) AS delta FROM (SELECT rule_id, count(*) AS x FROM a GROUP BY 1) FULL OUTER JOIN (SELECT rule_id, count(*) AS y FROM b GROUP BY 1) USING (rule_id) WHERE coalesce(y, 0) <> coalesce(x, 0)"


def _halves(spark, d):
    f = findings(spark, d)
    return f.filter("k % 5 > 0"), f.filter("k % 5 <> 1")


def _halved(body):
    from lintlake.plans.base import FINDINGS_SQL

    return f"WITH {FINDINGS_SQL}, {_HALVES} {body}"


@query("o6_top_deltas", sql=_halved(f"SELECT * FROM ({_DELTA}) ORDER BY abs(delta) DESC, rule_id LIMIT 3"))
def o6(spark, d):
    return ops.counter_delta(*_halves(spark, d), "rule_id").orderBy(F.abs("delta").desc(), "rule_id").limit(3)


@query("u3_counter_delta", sql=_halved(_DELTA))
def u3(spark, d):
    return ops.counter_delta(*_halves(spark, d), "rule_id")


_KEY = "concat_ws('|', vulnerability_type, sink_function, file_path, coalesce(variable, '?'))"


@query("u2_report_diff", sql=_halved(f"SELECT 'removed' AS change, key FROM (SELECT {_KEY} AS key FROM a EXCEPT SELECT {_KEY} FROM b) UNION ALL SELECT 'added', key FROM (SELECT {_KEY} AS key FROM b EXCEPT SELECT {_KEY} FROM a)"))
def u2(spark, d):
    return ops.key_diff(*_halves(spark, d), ["vulnerability_type", "sink_function", "file_path", "variable"])


_FULL = "vulnerability_type || '|' || sink_function || '|' || file_path || ':' || line_number || ':' || column_number || '|' || sink_pattern"


@query("u4_bundle_comparison", sql=_halved(f"SELECT count(*) FILTER (WHERE ka IS NOT NULL AND kb IS NULL) AS removed, count(*) FILTER (WHERE ka IS NULL) AS added, count(*) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL) AS same FROM (SELECT DISTINCT {_FULL} AS ka FROM a) FULL OUTER JOIN (SELECT DISTINCT {_FULL} AS kb FROM b) ON ka = kb"))
def u4(spark, d):
    a, b = _halves(spark, d)
    name = F.concat_ws("|", "vulnerability_type", "sink_function", F.concat_ws(":", "file_path", "line_number", "column_number"), "sink_pattern")
    both = a.select(name.alias("key")).distinct().withColumn("x", F.lit(1)).join(b.select(name.alias("key")).distinct().withColumn("y", F.lit(1)), "key", "full_outer")
    return both.agg(F.count_if(F.col("y").isNull()).alias("removed"), F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("same"))


@query("o7_hotspots", sql="SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents ORDER BY n_lines DESC, doc_id LIMIT 12")
def o7(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    return docs.orderBy(F.desc("n_lines"), "doc_id").limit(12)


@query("o8_jobs_by_start", sql="SELECT user_id, min(ts) AS started_at FROM events GROUP BY user_id ORDER BY started_at DESC, user_id LIMIT 20")
def o8(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("started_at")).orderBy(F.desc("started_at"), "user_id").limit(20)


@query("o9_truncated_lists", findings_sql="SELECT rule_id, count(DISTINCT doc_id) AS n, array_to_string(list_slice(list_sort(list(DISTINCT doc_id)), 1, 5), ',') AS first_cases FROM f GROUP BY rule_id")
def o9(spark, d):
    one = findings(spark, d).select("rule_id", "doc_id").distinct()
    w = Window.partitionBy("rule_id").orderBy("doc_id")
    few = one.withColumn("_n", F.row_number().over(w)).filter("_n <= 5").groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("first_cases"))
    return one.groupBy("rule_id").agg(F.count("*").alias("n")).join(few, "rule_id")


@query("o11_dimension_options", findings_sql="SELECT DISTINCT severity AS option FROM f WHERE severity <> 'UNKNOWN'")
def o11(spark, d):
    from lintlake.dims import queue_rank

    return findings(spark, d).filter("severity <> 'UNKNOWN'").select(F.col("severity").alias("option")).distinct().orderBy(queue_rank(F.col("option")))


@query("j18_review_join", findings_sql="SELECT finding_id, coalesce(disposition, 'open') AS disposition FROM f LEFT JOIN (SELECT file_path || '|' || rule_id AS key, max(triage_status) AS disposition FROM f WHERE k % 3 = 0 GROUP BY 1) r ON r.key = f.file_path || '|' || f.rule_id")
def j18(spark, d):
    f = findings(spark, d).withColumn("key", F.concat_ws("|", "file_path", "rule_id"))
    r = f.filter("k % 3 = 0").groupBy("key").agg(F.max("triage_status").alias("disposition"))
    return f.select("finding_id", "key").join(r, "key", "left").select("finding_id", F.coalesce("disposition", F.lit("open")).alias("disposition"))


@query("w7_latest_progress", sql="SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event, max(ts) AS last_ts FROM events GROUP BY user_id")
def w7(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.max("ts").alias("last_ts"))


@query("w8_first_candidate", findings_sql="SELECT finding_id, coalesce(nullif(trim(CASE WHEN k % 3 = 0 THEN '  ' END), ''), nullif(trim(variable), ''), 'none') AS name, coalesce(try_cast(CASE WHEN k % 4 = 0 THEN 'x' ELSE CAST(k AS VARCHAR) END AS DOUBLE), 0.0) AS number FROM f")
def w8(spark, d):
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    number = F.when(F.col("k") % 4 == 0, "x").otherwise(F.col("k").cast("string")).try_cast("double")
    return findings(spark, d).select("finding_id", F.coalesce(text(F.when(F.col("k") % 3 == 0, "  ")), text(F.col("variable")), F.lit("none")).alias("name"), F.coalesce(number, F.lit(0.0)).alias("number"))


@query("w9_evidence_growth", sql="SELECT conv_id, turn, n, n > coalesce(lag(n) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS grew FROM (SELECT conv_id, turn, count(DISTINCT text) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)")
def w9(spark, d):
    """Distinct whole texts of a conversation up to each turn; a missing text is none."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    first = (F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn")) == 1) & F.col("text").isNotNull()
    by = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("_f", first.cast("long")).withColumn("n", F.sum("_f").over(by))
    return c.select("conv_id", "turn", "n", (F.col("n") > F.coalesce(F.lag("n").over(by), F.lit(0))).alias("grew"))

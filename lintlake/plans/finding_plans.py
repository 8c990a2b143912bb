"""Queries of the finding algebra: projections, predicates, matching joins, dedupe and numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import findings as ops
from lintlake.operators import matching
from lintlake.plans.base import FINDINGS_SQL, LINES_SQL, RULES_SQL, findings, lines, query, rules
from lintlake.session import table

_ID = "finding_id"


@query("p1_normalize_findings", findings_sql="""SELECT finding_id, file_path, language, rule_id, vulnerability_type, severity, line_number, coalesce(ai_confidence, 0.5) AS confidence,
    CASE WHEN ai_vulnerable IS NULL THEN 'needs-review' WHEN NOT ai_vulnerable THEN 'suppressed' WHEN ai_confidence >= 0.85 THEN 'confirmed' ELSE 'likely' END AS triage_status,
    printf('%s flows into %s at line %d', source_type, sink_function, line_number) AS message FROM f""")
def p1(spark, d):
    return ops.normalize(findings(spark, d))


@query("p2_initial_status", findings_sql="""SELECT CASE WHEN ai_vulnerable IS NULL THEN 'needs-review' WHEN NOT ai_vulnerable THEN 'suppressed' WHEN ai_confidence >= 0.85 THEN 'confirmed' ELSE 'likely' END AS status, count(*) AS n FROM f GROUP BY 1""")
def p2(spark, d):
    return findings(spark, d).groupBy(ops.initial_status(F.col("ai_vulnerable"), F.col("ai_confidence")).alias("status")).agg(F.count("*").alias("n"))


@query("p3_evidence_summary", findings_sql="""SELECT finding_id, CAST(2 + steps + n_sanitizers AS INTEGER) AS path_length,
    array_to_string(list_concat(['source'], list_transform(generate_series(1, steps), lambda x: 'step' || x), list_transform(generate_series(1, n_sanitizers), lambda x: 'sanitizer' || x), ['sink']), ' > ') AS path_summary FROM f""")
def p3(spark, d):
    numbered = lambda n, what: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: F.concat(F.lit(what), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    steps, sanitizers = numbered("steps", "step"), numbered("n_sanitizers", "sanitizer")
    f = findings(spark, d).withColumn("_s", steps).withColumn("_z", sanitizers)
    return f.select(_ID, ops.path_length(F.col("_s"), F.col("_z")).alias("path_length"), F.array_join(F.concat(F.array(F.lit("source")), "_s", "_z", F.array(F.lit("sink"))), " > ").alias("path_summary"))


@query("p4_triage_input", findings_sql="SELECT CAST(to_json({'schema_version': 'triage-input-v1', 'finding': {'finding_id': finding_id, 'rule_id': rule_id, 'severity': severity, 'confidence': confidence}, 'location': {'file_path': file_path, 'line_number': line_number, 'snippet': snippet}}) AS VARCHAR) AS document FROM f")
def p4(spark, d):
    f = findings(spark, d)
    return f.select(F.to_json(F.struct(F.lit("triage-input-v1").alias("schema_version"), F.struct(_ID, "rule_id", "severity", "confidence").alias("finding"), F.struct("file_path", "line_number", "snippet").alias("location"))).alias("document"))


_MODES = "(SELECT 'all' AS mode UNION ALL SELECT 'visible' UNION ALL SELECT 'high-confidence') AS ms"


@query("p5_mode_filter", findings_sql=f"""SELECT mode, count(*) AS n FROM (SELECT *, CASE WHEN k % 9 > 0 THEN triage_status END AS st FROM f) JOIN {_MODES} ON mode = 'all' OR (mode = 'visible' AND coalesce(st, '') <> 'suppressed') OR (mode = 'high-confidence' AND st IN ('confirmed', 'likely')) GROUP BY mode""")
def p5(spark, d):
    f = findings(spark, d).withColumn("triage_status", F.when(F.col("k") % 9 > 0, F.col("triage_status")))
    return matching.by_mode(f).groupBy("mode").agg(F.count("*").alias("n"))


@query("p6_mode_filter_lowercase", findings_sql=f"""SELECT replace(mode, '-', '_') AS mode, count(*) AS n FROM (SELECT *, lower(upper(triage_status)) AS st FROM f) JOIN {_MODES} ON mode = 'all' OR (mode = 'visible' AND coalesce(st, '') <> 'suppressed') OR (mode = 'high-confidence' AND st IN ('confirmed', 'likely')) GROUP BY mode""")
def p6(spark, d):
    f = findings(spark, d).withColumn("triage_status", F.lower(F.upper("triage_status")))
    return matching.by_mode(f).groupBy(F.replace("mode", F.lit("-"), F.lit("_")).alias("mode")).agg(F.count("*").alias("n"))


_SINK_RULES = """s AS (SELECT pattern, rule_no, CASE rule_no % 4 WHEN 0 THEN NULL WHEN 1 THEN lower(severity) ELSE severity END AS severity FROM rules UNION ALL SELECT pattern, rule_no + 100, 'LOW' FROM rules)"""


@query("p9_rule_severity", sql=f"""WITH {FINDINGS_SQL}, {_SINK_RULES}, r AS (SELECT pattern, arg_min(upper(coalesce(severity, 'MEDIUM')), rule_no) AS sev FROM s WHERE upper(coalesce(severity, 'MEDIUM')) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO') GROUP BY pattern)
    SELECT finding_id, CASE WHEN sanitized THEN 'MEDIUM' WHEN n_sanitizers > 0 THEN 'HIGH' WHEN sev IS NOT NULL THEN sev WHEN vulnerability_type IN ('SQL_INJECTION', 'COMMAND_INJECTION', 'CODE_INJECTION', 'NOSQL_INJECTION', 'SSTI', 'INSECURE_DESERIALIZATION') THEN 'CRITICAL' WHEN vulnerability_type IN ('XSS', 'SSRF', 'XXE', 'PATH_TRAVERSAL') THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM f LEFT JOIN r ON r.pattern = sink_pattern""")
def p9(spark, d):
    """Rules of which some have no severity, some a lower-case one, and some one that is not known; a later rule repeats each pattern."""
    n = F.col("rule_no")
    own = rules(spark).select(F.col("pattern").alias("sink_pattern"), F.when(n % 4 == 1, F.lower("severity")).when(n % 4 > 0, F.col("severity")).alias("rule_severity"), n.alias("position"))
    later = rules(spark).select(F.col("pattern").alias("sink_pattern"), F.lit("LOW").alias("rule_severity"), (n + 100).alias("position"))
    return ops.rule_severity(findings(spark, d).drop("severity"), own.unionByName(later)).select(_ID, "severity")


@query("p10_effective_sanitizer", findings_sql="""SELECT finding_id, CASE k % 4 WHEN 0 THEN false WHEN 1 THEN list_contains(['XSS', 'SQL_INJECTION'], vulnerability_type) WHEN 2 THEN false ELSE list_contains(['PATH_TRAVERSAL'], vulnerability_type) OR list_contains(['HARDCODED_SECRET', 'XSS'], vulnerability_type) END AS sanitized FROM f""")
def p10(spark, d):
    k = F.col("k") % 4
    lists = lambda *xs: F.array(*[F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>") for x in xs])
    mitigates = F.when(k == 0, F.array().cast("array<array<string>>")).when(k == 1, lists(("XSS", "SQL_INJECTION"))).when(k == 2, lists(())).otherwise(lists(("PATH_TRAVERSAL",), ("HARDCODED_SECRET", "XSS")))
    return findings(spark, d).select(_ID, ops.effectively_sanitized(mitigates, F.col("vulnerability_type")).alias("sanitized"))


@query("p11_bound_parameters", findings_sql="""SELECT finding_id FROM f WHERE NOT (sink_function = 'cursor.execute' AND (k % 4 = 1 OR k % 4 = 2))""")
def p11(spark, d):
    k = F.col("k") % 4
    args = F.when(k == 1, F.array(F.lit("sql"), F.lit("x"))).when(k == 2, F.array(F.lit("params = x"))).otherwise(F.array(F.lit("sql")))
    f = findings(spark, d).withColumn("function_name", F.col("sink_function")).withColumn("arguments", args)
    return ops.without_bound_parameters(f).select(_ID)


@query("p12_case_id", findings_sql="""SELECT finding_id, CASE WHEN length(n) < 5 THEN lpad(n, 5, '0') ELSE n END AS case_id FROM (SELECT finding_id, coalesce(nullif(regexp_extract(a, '(?i)test(?:case)?[_-]?0*(\\d+)', 1), ''), nullif(regexp_extract(b, '(?i)test(?:case)?[_-]?0*(\\d+)', 1), '')) AS n
    FROM (SELECT finding_id, CASE WHEN k % 2 = 0 THEN 'BenchmarkTest' || doc_id END AS a, 'x/testcase_' || (doc_id * 1000) || '.py' AS b FROM f))""")
def p12(spark, d):
    a = F.when(F.col("k") % 2 == 0, F.concat(F.lit("BenchmarkTest"), F.col("doc_id").cast("string")))
    b = F.concat(F.lit("x/testcase_"), (F.col("doc_id") * 1000).cast("string"), F.lit(".py"))
    return findings(spark, d).select(_ID, ops.case_id(a, b).alias("case_id"))


_TEXT13 = "concat_ws(' ', CASE k % 6 WHEN 0 THEN 'CWE-943' WHEN 1 THEN 'CWE-798' WHEN 2 THEN 'python.lang.security' WHEN 3 THEN 'CWE-22' WHEN 4 THEN 'sql-command' ELSE 'open-redirect' END, rule_id)"


@query("p13_type_cascade", findings_sql=f"SELECT * FROM (SELECT finding_id, {ops.cascade_sql(_TEXT13, ops.TYPE_CASCADE)} AS vuln_type FROM f) WHERE vuln_type IS NOT NULL")
def p13(spark, d):
    k = F.col("k") % 6
    text = F.when(k == 0, "CWE-943").when(k == 1, "CWE-798").when(k == 2, "python.lang.security").when(k == 3, "CWE-22").when(k == 4, "sql-command").otherwise("open-redirect")
    return findings(spark, d).select(_ID, ops.type_of(F.concat_ws(" ", text, "rule_id")).alias("vuln_type")).filter("vuln_type IS NOT NULL")


@query("p14_first_family", sql="""WITH fam(cwe, family) AS (VALUES ('CWE-89', 'sqli'), ('CWE-79', 'xss'), ('CWE-22', 'pathtraver')), l AS (SELECT doc_id, ['CWE-' || (doc_id % 7 + 85), 'CWE-' || (doc_id % 3 + 78), 'CWE-22'] AS cwes FROM documents),
    e AS (SELECT doc_id, unnest(cwes) AS cwe, generate_subscripts(cwes, 1) AS pos FROM l) SELECT doc_id AS label_id, arg_min(family, pos) FILTER (WHERE family IS NOT NULL) AS family FROM e LEFT JOIN fam USING (cwe) GROUP BY doc_id""")
def p14(spark, d):
    docs = table(spark, d, "documents")
    cwe = lambda m, b: F.concat(F.lit("CWE-"), (F.col("doc_id") % m + b).cast("string"))
    labels = docs.select(F.col("doc_id").alias("label_id"), cwe(7, 85).alias("primary_cwe"), F.array(cwe(3, 78), F.lit("CWE-22")).alias("acceptable_cwes"))
    families = spark.sql("SELECT * FROM VALUES ('CWE-89', 'sqli'), ('CWE-79', 'xss'), ('CWE-22', 'pathtraver') AS t(cwe, family)")
    return ops.first_family(labels, families)


_CVSS = "CAST(round(CASE severity WHEN 'CRITICAL' THEN 9.0::DOUBLE + confidence * 0.8 WHEN 'HIGH' THEN 7.2::DOUBLE + confidence * 1.5 WHEN 'MEDIUM' THEN 4.5::DOUBLE + confidence * 2.0 WHEN 'LOW' THEN 2.0::DOUBLE + confidence * 1.5 WHEN 'INFO' THEN 1.0 ELSE 5.0 END, 1) AS DOUBLE)"


@query("p15_taxonomy", findings_sql=f"SELECT finding_id, {ops.cascade_sql('vulnerability_type', ops.CWE_CASCADE, 'CWE-Generic')} AS cwe_id, {ops.cascade_sql('vulnerability_type', ops.OWASP_CASCADE, 'A04:2021-Insecure Design')} AS owasp, {_CVSS} AS cvss FROM f")
def p15(spark, d):
    return ops.taxonomy(findings(spark, d)).select(_ID, "cwe_id", "owasp", "cvss")


@query("p16_scanner_levels", findings_sql="""SELECT level, CASE WHEN level IN ('ERROR', 'critical') THEN 'HIGH' WHEN level = 'warning' THEN 'MEDIUM' WHEN level = 'Info' THEN 'LOW' ELSE 'UNKNOWN' END AS severity, CASE WHEN level IN ('ERROR', 'critical') THEN 'HIGH' WHEN level = 'warning' THEN 'MEDIUM' WHEN level = 'Info' THEN 'LOW' ELSE 'MEDIUM' END AS rule_severity, count(*) AS n
    FROM (SELECT CASE k % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'warning' WHEN 2 THEN 'Info' WHEN 3 THEN 'critical' ELSE 'odd' END AS level FROM f) GROUP BY level""")
def p16(spark, d):
    level = F.element_at(F.array(*[F.lit(x) for x in ("ERROR", "warning", "Info", "critical", "odd")]), (F.col("k") % 5 + 1).cast("int"))
    f = findings(spark, d).select(level.alias("level"))
    return f.groupBy("level", ops.scanner_severity(F.col("level")).alias("severity"), ops.scanner_severity(F.col("level"), "MEDIUM").alias("rule_severity")).agg(F.count("*").alias("n"))


@query("p17_tidy_status", findings_sql="""SELECT finding_id, CASE k % 6 WHEN 0 THEN 'needs-review' WHEN 1 THEN 'suppressed' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'needs-review' WHEN 4 THEN 'unknown' ELSE 'likely' END AS status, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN v > 1 AND v <= 100 THEN v / 100 ELSE v END)) AS confidence FROM (SELECT *, CAST(k % 240 AS DOUBLE) / 2 - 5 AS v FROM f)""")
def p17(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Manual  Review", "FALSE_POSITIVE", "Confirmed", "needs review", "odd", "likely")]), (F.col("k") % 6 + 1).cast("int"))
    return findings(spark, d).select(_ID, ops.tidy_status(raw).alias("status"), ops.clamp_confidence((F.col("k") % 240) / 2 - 5).alias("confidence"))


@query("p18_exit_code", findings_sql="SELECT CASE WHEN count(*) FILTER (WHERE severity = 'CRITICAL') > 0 THEN 2 WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_code FROM f")
def p18(spark, d):
    return ops.exit_code(findings(spark, d))


@query("w1_dedupe_sinks", findings_sql="""SELECT finding_id, first_ordinal FROM (SELECT *, min(ordinal) OVER w AS first_ordinal, row_number() OVER (PARTITION BY file_path, l2, vulnerability_type ORDER BY sanitized, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END, coalesce(length(variable) > 0, false) DESC, steps, n_sanitizers, ordinal) AS n
    FROM (SELECT *, line_number // 3 AS l2 FROM f) WINDOW w AS (PARTITION BY file_path, l2, vulnerability_type)) WHERE n = 1""")
def w1(spark, d):
    f = findings(spark, d)  # coarser keys than a scan's, so that groups have several rows
    coarse = f.withColumn("line_number", F.floor(F.col("line_number") / 3)).withColumn("column_number", F.lit(1)).withColumn("sink_function", F.lit("s")).withColumn("sink_pattern", F.lit("p"))
    return ops.dedupe_sinks(coarse).select(_ID, "first_ordinal")


@query("w2_renumber", findings_sql="SELECT rule_id, doc_id, line_number, printf('VULN-%03d', row_number() OVER (ORDER BY ordinal)) AS finding_id FROM f")
def w2(spark, d):
    return ops.renumber(findings(spark, d), "ordinal").select("rule_id", "doc_id", "line_number", _ID)


@query("w3_dedupe_bridge", findings_sql="""SELECT file_path, line_number, vulnerability_type, arg_max(rule_id, (confidence, steps, tool = 'bridge', -ordinal)) AS rule_id, arg_max(confidence, (confidence, steps, tool = 'bridge', -ordinal)) AS confidence, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS aliases, count(*) AS n FROM f GROUP BY file_path, line_number, vulnerability_type""")
def w3(spark, d):
    return ops.dedupe_bridge(findings(spark, d))


@query("w4_dedupe_first", findings_sql="SELECT arg_min(finding_id, ordinal) AS finding_id, file_path, vulnerability_type FROM f GROUP BY file_path, vulnerability_type")
def w4(spark, d):
    return ops.dedupe_first(findings(spark, d), ["file_path", "vulnerability_type"]).select(_ID, "file_path", "vulnerability_type")


@query("a27_aliases", findings_sql="SELECT file_path, vulnerability_type, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS aliases FROM f GROUP BY ALL HAVING count(DISTINCT rule_id) > 1")
def a27(spark, d):
    g = findings(spark, d).groupBy("file_path", "vulnerability_type").agg(F.array_sort(F.collect_set("rule_id")).alias("_a"))
    return g.filter(F.size("_a") > 1).select("file_path", "vulnerability_type", F.array_join("_a", ",").alias("aliases"))


@query("snippet_mentions_pattern", findings_sql="""SELECT finding_id, len(w) = 0 OR len(list_filter(w, lambda x: contains(lower(snippet), x))) > 0 AS mentions FROM (SELECT *, list_filter(regexp_extract_all(lower(sink_pattern), '([A-Za-z0-9_]{3,})', 1), lambda x: x <> 'request') AS w FROM f)""")
def mentions(spark, d):
    return findings(spark, d).select(_ID, ops.mentions(F.col("snippet"), F.col("sink_pattern")).alias("mentions"))


# --- matching joins


@query("j1_call_match", sql=f"""WITH calls AS (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_.]+)\\(', 1)) AS call_name FROM pages), r(rule_id, pattern) AS (VALUES ('track', 'track'), ('any-log', '.log'), ('push', 'dataLayer.push'))
    SELECT page_id, call_name, rule_id, count(*) AS n FROM calls JOIN r ON call_name = pattern OR (starts_with(pattern, '.') AND ends_with(call_name, pattern)) OR (NOT contains(pattern, '.') AND ends_with(call_name, '.' || pattern)) GROUP BY ALL""")
def j1(spark, d):
    calls = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"([A-Za-z_.]+)\("), 1)).alias("call_name"))
    r = spark.sql("SELECT * FROM VALUES ('track', 'track'), ('any-log', '.log'), ('push', 'dataLayer.push') AS t(rule_id, pattern)")
    return matching.match_calls(calls, r).groupBy("page_id", "call_name", "rule_id").agg(F.count("*").alias("n"))


@query("j2_contains_match", sql=f"WITH {RULES_SQL}, {LINES_SQL} SELECT doc_id, line_number, rule_id FROM lines JOIN rules ON contains(line, pattern)")
def j2(spark, d):
    return ops.match_lines(lines(spark, d), rules(spark)).select("doc_id", "line_number", "rule_id")


@query("j3_category_match", sql=f"WITH {RULES_SQL}, {LINES_SQL} SELECT lang, rule_id, count(*) AS n FROM lines JOIN rules ON contains(line, pattern) WHERE (lang = 'de' AND vulnerability_type IN ('CODE_INJECTION', 'HARDCODED_SECRET')) OR (lang <> 'de' AND vulnerability_type <> 'XSS') GROUP BY ALL")
def j3(spark, d):
    allowed = {"de": ("CODE_INJECTION", "HARDCODED_SECRET")}
    return matching.match_by_language(lines(spark, d), rules(spark), allowed, without=("XSS",)).groupBy("lang", "rule_id").agg(F.count("*").alias("n"))


@query("j5_interval_containment", findings_sql="""SELECT n.doc_id, n.start_line, f.finding_id FROM (SELECT doc_id, line_number AS start_line, line_number + 2 AS end_line, line AS label FROM lines WHERE line_number % 3 = 1) n JOIN f ON n.doc_id = f.doc_id AND f.line_number BETWEEN n.start_line AND n.end_line AND contains(n.label, f.sink_pattern)""")
def j5(spark, d):
    nodes = lines(spark, d).filter("line_number % 3 = 1").select("doc_id", F.col("line_number").alias("start_line"), (F.col("line_number") + 2).alias("end_line"), F.col("line").alias("label"))
    return matching.nodes_with_sinks(nodes, findings(spark, d)).select("doc_id", "start_line", _ID)


@query("j6_line_sanitizers", findings_sql="""SELECT finding_id, s.name AS sanitizer FROM f JOIN (SELECT doc_id, line_number, CASE WHEN line_number % 2 = 0 THEN 'escape' ELSE 'int' END AS name FROM lines WHERE line_number % 5 < 2) s USING (doc_id, line_number)""")
def j6(spark, d):
    s = lines(spark, d).filter("line_number % 5 < 2").select("doc_id", "line_number", F.when(F.col("line_number") % 2 == 0, "escape").otherwise("int").alias("sanitizer"))
    return findings(spark, d).join(s, ["doc_id", "line_number"]).select(_ID, "sanitizer")


@query("s17_source_window", findings_sql="""SELECT finding_id, count(*) AS n_lines, string_agg(l.line_number || ': ' || l.line, chr(10) ORDER BY l.line_number) AS context FROM f JOIN lines l ON l.doc_id = f.doc_id AND l.line_number BETWEEN f.line_number - 2 AND f.line_number + 2 GROUP BY finding_id""")
def s17(spark, d):
    return matching.source_windows(findings(spark, d), table(spark, d, "documents"), 2)

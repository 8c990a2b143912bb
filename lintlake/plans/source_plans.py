"""Queries of sources, path rules and progress streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.plans.base import findings, query
from lintlake.session import table
from lintlake.sources import files as ops
from lintlake.streaming import fold, jobs

_PATHS = "p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'src/Vendor/a' WHEN 1 THEN 'lib/x' WHEN 2 THEN 'tests/unit/t' WHEN 3 THEN 'build' ELSE 'app/main' END || '/f' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.JS' WHEN 2 THEN '.java' WHEN 3 THEN '.phtml' WHEN 4 THEN '.tsx' WHEN 5 THEN '.txt' ELSE '' END AS path, text FROM documents)"


def _paths(spark, d):
    i = F.col("doc_id")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n + 1).cast("int"))
    path = F.concat(pick(i % 5, "src/Vendor/a", "lib/x", "tests/unit/t", "build", "app/main"), F.lit("/f"), i.cast("string"), pick(i % 7, ".py", ".JS", ".java", ".phtml", ".tsx", ".txt", ""))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), "text")


_LANG = "CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'java' THEN 'java' WHEN 'phtml' THEN 'php' {} END"


@query("s1_supported_files", sql=f"WITH {_PATHS} SELECT path, {_LANG.format('')} AS language FROM p WHERE {_LANG.format('')} IS NOT NULL AND doc_id % 5 NOT IN (0, 3)")
def s1(spark, d):
    p = _paths(spark, d).withColumn("language", ops.language_of(F.col("path")))
    return p.filter(F.col("language").isNotNull() & ~ops.excluded(F.col("path"), ops.BASELINE_DIRS)).select("path", "language")


@query("s2_skip_path", sql=f"WITH {_PATHS} SELECT path, doc_id % 5 IN (0, 3) OR path LIKE 'tests/%' OR path LIKE '%1.py' AS skipped FROM p")
def s2(spark, d):
    return _paths(spark, d).select("path", ops.excluded(F.col("path"), ("vendor", "BUILD"), ("tests/*", "*1.py")).alias("skipped"))


@query("s3_exclusion_profiles", sql=f"WITH {_PATHS} SELECT split_part(path, '/', 1) AS top, count(*) AS n FROM p WHERE NOT (doc_id % 5 IN (0, 3) OR path LIKE '%/unit/%') GROUP BY 1")
def s3(spark, d):
    """Profiles are merged in order, without repeats, into one filter."""
    profiles = (ops.BASELINE_DIRS, ("unit", "vendor"))
    merged = tuple(dict.fromkeys(x for p in profiles for x in p))
    return _paths(spark, d).filter(~ops.excluded(F.col("path"), merged)).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("top")).agg(F.count("*").alias("n"))


@query("s4_cross_file_list", sql=f"WITH {_PATHS} SELECT path FROM p WHERE path LIKE '%.py' AND doc_id % 5 NOT IN (0, 3)")
def s4(spark, d):
    return _paths(spark, d).filter(F.col("path").endswith(".py") & ~ops.excluded(F.col("path"), ops.BASELINE_DIRS)).select("path")


@query("s5_plugin_dispatch", sql=f"WITH {_PATHS} SELECT {_LANG.format('')} AS plugin, count(*) AS n FROM p GROUP BY 1")
def s5(spark, d):
    return _paths(spark, d).groupBy(ops.language_of(F.col("path")).alias("plugin")).agg(F.count("*").alias("n"))


@query("s6_infer_language", sql=f"WITH {_PATHS} SELECT path, coalesce({_LANG.format(chr(87) + 'HEN ' + chr(39) + 'tsx' + chr(39) + ' THEN ' + chr(39) + 'javascript' + chr(39))}, 'unknown') AS language FROM p")
def s6(spark, d):
    return _paths(spark, d).select("path", ops.language_of(F.col("path"), "unknown", ops.EVIDENCE_LANGUAGES).alias("language"))


@query("s9_fingerprints", findings_sql="SELECT finding_id, coalesce(nullif(CASE WHEN k % 3 = 0 THEN 'own' || k WHEN k % 3 = 1 THEN '' END, ''), sha256(concat_ws('|', rule_id, file_path, line_number, snippet))) AS fingerprint FROM f")
def s9(spark, d):
    own = F.when(F.col("k") % 3 == 0, F.concat(F.lit("own"), F.col("k").cast("string"))).when(F.col("k") % 3 == 1, "")
    f = findings(spark, d).select("finding_id", F.col("rule_id").alias("check_id"), F.col("file_path").alias("path"), F.col("line_number").alias("line"), F.col("snippet").alias("message"), own.alias("own"))
    return f.select("finding_id", ops.fingerprint("own").alias("fingerprint"))


@query("s10_import_coercion", sql="SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) AS line, 0.5::DOUBLE AS confidence, 'UNKNOWN' AS severity FROM events")
def s10(spark, d):
    """Tolerant import: missing or odd fields get defaults, never an error."""
    e = table(spark, d, "events")
    got = lambda p, t: F.get_json_object("props", p).try_cast(t)
    return e.select("event_id", F.coalesce(got("$.k", "int"), F.lit(0)).alias("line"), F.coalesce(got("$.confidence", "double"), F.lit(0.5)).alias("confidence"), F.coalesce(F.upper(F.get_json_object("props", "$.severity")), F.lit("UNKNOWN")).alias("severity"))


@query("s12_ground_truth_rows", sql="SELECT printf('BenchmarkTest%05d', doc_id) AS case_id, CASE doc_id % 3 WHEN 0 THEN 'SQL_INJECTION' WHEN 1 THEN 'XSS' END AS family, quality = 0 AS vulnerable, CAST(doc_id % 100 AS INTEGER) AS cwe FROM labels WHERE doc_id % 10 > 0")
def s12(spark, d):
    """Rows as the truth file has them, then parsed: comments go, categories map to families (unknown ones to null)."""
    i = F.col("doc_id")
    line = F.concat_ws(",", F.concat(F.when(i % 10 == 0, "# ").otherwise(""), F.format_string("BenchmarkTest%05d", i)), F.when(i % 3 == 0, "sqli").when(i % 3 == 1, "xss").otherwise("other"), (F.col("quality") == 0).cast("string"), (i % 100).cast("string"))
    p = F.split("line", ",")
    family = F.create_map(*[F.lit(x) for q in ops.CATEGORY_FAMILY.items() for x in q])[p[1]]
    rows = table(spark, d, "labels").select(line.alias("line")).filter("NOT startswith(line, '#')")
    return rows.select(p[0].alias("case_id"), family.alias("family"), (p[2] == "true").alias("vulnerable"), p[3].cast("int").alias("cwe"))


@query("s13_manifest_filter", sql="SELECT p_partkey AS case_id, p_brand AS family FROM part WHERE (p_partkey % 2 = 0) <> (p_partkey % 3 = 0) AND p_brand IN ('Brand#1', 'Brand#11', 'Brand#12')")
def s13(spark, d):
    """Cases with exactly one of rules (even keys) and profile (multiples of three), and only the families asked for."""
    p = table(spark, d, "part")
    rules, profile = F.when(F.col("p_partkey") % 2 == 0, "r"), F.when(F.col("p_partkey") % 3 == 0, "p")
    return p.filter((rules.isNull() != profile.isNull()) & F.col("p_brand").isin("Brand#1", "Brand#11", "Brand#12")).select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("family"))


@query("s15_workspace_index", findings_sql="SELECT source AS report, count(*) AS n, count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS severe FROM f GROUP BY source HAVING count(*) > 0")
def s15(spark, d):
    return findings(spark, d).groupBy(F.col("source").alias("report")).agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("severe"))


@query("s16_latest_runs", sql="SELECT 'run_' || o_orderkey AS run, o_orderdate AS modified FROM orders WHERE regexp_matches('run_' || o_orderkey, '^run_[0-9]+$') ORDER BY o_orderdate DESC, run DESC LIMIT 20")
def s16(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("run"), F.col("o_orderdate").alias("modified"))
    return o.filter(F.col("run").rlike("^run_[0-9]+$")).orderBy(F.desc("modified"), F.desc("run")).limit(20)


@query("s18_line_counts", sql="SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS n_lines FROM documents")
def s18(spark, d):
    return table(spark, d, "documents").select("doc_id", ops.line_count(F.col("text")).cast("long").alias("n_lines"))


@query("s19_repo_intake", sql=f"WITH {_PATHS}, x AS (SELECT path, text, {_LANG.format('')} AS language FROM p), s AS (SELECT * FROM x ORDER BY path LIMIT 24) SELECT (SELECT array_to_string(list_sort(list(DISTINCT language)), ',') FROM x WHERE language IS NOT NULL) AS languages, (SELECT count(*) FROM x) AS n_files, (SELECT string_agg(h, ',' ORDER BY h) FROM (SELECT 'english' AS h WHERE EXISTS (SELECT 1 FROM s WHERE contains(text, ' the ')) UNION ALL SELECT 'french' WHERE EXISTS (SELECT 1 FROM s WHERE contains(text, ' de la ')))) AS hints")
def s19(spark, d):
    p = _paths(spark, d).select("path", F.col("text").alias("content"), ops.language_of(F.col("path")).alias("language"))
    r = ops.repo_profile(p, {"english": (" the ",), "french": (" de la ",)})
    return r.select(F.array_join("languages", ",").alias("languages"), "n_files", F.array_join("hints", ",").alias("hints"))


@query("a23_detected_languages", sql=f"WITH {_PATHS}, x AS (SELECT {_LANG.format('')} AS language FROM p) SELECT array_to_string(list_sort(list(DISTINCT language)), ',') AS languages, CASE WHEN count(DISTINCT language) = 1 THEN 'single' WHEN count(DISTINCT language) > 1 THEN 'polyglot' ELSE 'none' END AS scan_profile FROM x")
def a23(spark, d):
    g = _paths(spark, d).agg(F.array_sort(F.collect_set(ops.language_of(F.col("path")))).alias("l"))
    return g.select(F.array_join("l", ",").alias("languages"), F.when(F.size("l") == 1, "single").when(F.size("l") > 1, "polyglot").otherwise("none").alias("scan_profile"))


# --- streams, over the batch table


@query("st_job_states", sql="SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS state, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors FROM events GROUP BY user_id")
def st_states(spark, d):
    return jobs.job_states(table(spark, d, "events"))


_TO = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"


@query("st_job_fold", sql=f"""WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS t, event_id, {_TO} AS too FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
    w AS (SELECT user_id, 0::BIGINT AS n, '' AS state, NULL::BIGINT AS last, 0::BIGINT AS n_steps, 0::BIGINT AS n_illegal FROM (SELECT DISTINCT user_id FROM o) UNION ALL
        SELECT user_id, n, CASE WHEN ok THEN too ELSE now END, CASE WHEN ok THEN t WHEN NOT gone THEN last END, CASE WHEN gone THEN 0 ELSE n_steps END + CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN gone THEN 0 ELSE n_illegal END + CASE WHEN NOT ok AND now <> '' THEN 1 ELSE 0 END
        FROM (SELECT *, (now = '' AND too = 'queued') OR (now = 'queued' AND too IN ('running', 'failed')) OR (now = 'running' AND too IN ('running', 'completed', 'failed')) AS ok FROM (SELECT *, CASE WHEN gone THEN '' ELSE state END AS now FROM
            (SELECT o.user_id, o.n, o.t, o.too, w.state, w.last, w.n_steps, w.n_illegal, coalesce(o.t - w.last > 172800000, false) AS gone FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1))))
    SELECT user_id AS job, arg_max(state, n) AS state, arg_max(CAST(coalesce(last, -1) AS BIGINT), n) AS last, arg_max(n_steps, n) AS n_steps, arg_max(n_illegal, n) AS n_illegal FROM w GROUP BY user_id""")
def st_fold(spark, d):
    """Jobs by their events in order: illegal steps told apart, jobs that nothing touched for two days forgotten."""
    return fold.fold_jobs(table(spark, d, "events")).withColumn("last", F.coalesce("last", F.lit(-1).cast("long")))


@query("st_progress_windows", sql="SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_progress(spark, d):
    return jobs.progress(table(spark, d, "events"))


@query("st_resume", sql="SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def st_resume(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return jobs.resume(e, e.filter("event_type = 'purchase'"), "event_id").select("event_id")


@query("st_ttl_cache", sql="SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def st_ttl(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    return jobs.fresh(e, F.lit(now), 7).select("event_id")

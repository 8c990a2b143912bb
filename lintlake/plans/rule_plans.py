"""Queries of the rule algebra. Rules are made of parts: a part's type is its pattern, its brand its family."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import documents as json_documents
from lintlake.operators import rule_documents as documents
from lintlake.operators import rules as ops
from lintlake.plans.base import findings, query
from lintlake.session import spread, table

_R = "r AS (SELECT p_partkey AS rule_no, p_type AS pattern, p_brand AS type, p_size FROM part)"


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("rule_no"), F.col("p_type").alias("pattern"), F.col("p_brand").alias("type"), "p_size")


@query("u1_merge_rules", sql=f"WITH {_R}, b AS (SELECT *, CASE WHEN rule_no % 2 = 0 THEN 0 ELSE 1 END AS o FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY pattern, type ORDER BY o, rule_no) AS n FROM b) SELECT rule_no, pattern, type, CAST(row_number() OVER (ORDER BY o, rule_no) AS INTEGER) AS position FROM k WHERE n = 1")
def u1(spark, d):
    r = _parts(spark, d).drop("p_size")
    return ops.merge(r.filter("rule_no % 2 = 0"), r.filter("rule_no % 2 = 1"), ["pattern", "type"])


@query("j20_seen_sets", sql="SELECT arg_min(p_name, p_partkey) AS p_name, p_type FROM part GROUP BY p_type")
def j20(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.min_by("p_name", "p_partkey").alias("p_name"))


@query("u6_merge_documents", sql=f"WITH {_R} SELECT pattern, type, min(CASE WHEN rule_no % 3 = 0 THEN 0 ELSE 1 END) AS source_no FROM r GROUP BY pattern, type")
def u6(spark, d):
    r = _parts(spark, d)
    return ops.merge_documents(r.filter("rule_no % 3 = 0").select("pattern", "type"), r.filter("rule_no % 3 > 0").select("pattern", "type"))


@query("u7_union_with_ordinal", findings_sql="SELECT file_path, arg_min(finding_id, (o, ordinal)) AS finding_id FROM (SELECT *, CASE WHEN tool = 'bridge' THEN 1 ELSE 0 END AS o FROM f) GROUP BY file_path")
def u7(spark, d):
    f = findings(spark, d)
    both = f.filter("tool <> 'bridge'").withColumn("o", F.lit(0)).unionByName(f.filter("tool = 'bridge'").withColumn("o", F.lit(1)))
    return both.groupBy("file_path").agg(F.min_by("finding_id", F.struct("o", "ordinal")).alias("finding_id"))


@query("u8_merge_environments", findings_sql="SELECT file_path, variable, array_to_string(list_sort(list(DISTINCT line_number)), ',') AS defs FROM f WHERE variable IS NOT NULL GROUP BY ALL")
def u8(spark, d):
    """Reaching definitions of each name, united over branches."""
    f = findings(spark, d).filter("variable IS NOT NULL")
    return f.groupBy("file_path", "variable").agg(F.array_join(F.array_sort(F.collect_set("line_number")), ",").alias("defs"))


@query("u9_unique_in_order", findings_sql="SELECT finding_id, array_to_string(CASE k % 3 WHEN 0 THEN ['b', 'a'] WHEN 1 THEN ['x'] ELSE [rule_id, 'a'] END, ',') AS reasons FROM f")
def u9(spark, d):
    k = F.col("k") % 3
    raw = F.when(k == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).when(k == 1, F.array(F.lit(""), F.lit("x"), F.lit(None))).otherwise(F.array("rule_id", F.lit("a"), F.col("rule_id")))
    return findings(spark, d).select("finding_id", F.array_join(ops.unique_in_order(raw), ",").alias("reasons"))


_FAMILIES = ("SQL_INJECTION", "COMMAND_INJECTION", "XSS", "PATH_TRAVERSAL", "OPEN_REDIRECT", "LDAP_INJECTION", "XXE", "CODE_INJECTION")


def _rules(spark, d):
    k = F.col("rule_no")
    take = lambda n, *xs: F.slice(F.array(*[F.lit(x) for x in xs]), F.lit(1), n.cast("int"))
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n + 1).cast("int"))
    return _parts(spark, d).select(
        "rule_no", F.when(k % 17 > 0, F.concat(F.lit("R"), k.cast("string"))).alias("rule_id"), F.when(k % 5 > 0, F.col("pattern")).otherwise(" ").alias("title"), pick(k % 5, "python", "java", "php", "go", "javascript").alias("language"),
        pick(k % 4, "HIGH", "LOW", "odd", "CRITICAL").alias("severity"), take(k % 3, "request", "argv").alias("sources"), take(k % 4, "eval", "os", "exec(").alias("sinks"), take(k % 2, "escape").alias("sanitizers"),
        F.when(k % 6 > 0, F.concat(F.lit("CWE-"), k.cast("string"))).otherwise("cwe 7").alias("cwe"), pick(k % 8, *_FAMILIES).alias("family"), F.when(k % 3 > 0, "taint").otherwise("search").alias("mode"),
    )


_RULES = """x AS (SELECT rule_no, CASE WHEN rule_no % 17 > 0 THEN 'R' || rule_no END AS rule_id, CASE WHEN rule_no % 5 > 0 THEN pattern ELSE ' ' END AS title, ['python', 'java', 'php', 'go', 'javascript'][rule_no % 5 + 1] AS language, ['HIGH', 'LOW', 'odd', 'CRITICAL'][rule_no % 4 + 1] AS severity, list_slice(['request', 'argv'], 1, rule_no % 3) AS sources, list_slice(['eval', 'os', 'exec('], 1, rule_no % 4) AS sinks,
    list_slice(['escape'], 1, rule_no % 2) AS sanitizers, CASE WHEN rule_no % 6 > 0 THEN 'CWE-' || rule_no ELSE 'cwe 7' END AS cwe, ['SQL_INJECTION', 'COMMAND_INJECTION', 'XSS', 'PATH_TRAVERSAL', 'OPEN_REDIRECT', 'LDAP_INJECTION', 'XXE', 'CODE_INJECTION'][rule_no % 8 + 1] AS family, CASE WHEN rule_no % 3 > 0 THEN 'taint' ELSE 'search' END AS mode FROM r)"""
_ISSUES = [("rule_id IS NULL", "error", "missing-rule-id"), ("trim(title) = ''", "warning", "missing-title"), ("language IS NULL", "error", "missing-language"), ("severity = 'odd'", "error", "bad-severity"), ("len(sources) = 0", "error", "no-sources"), ("len(sinks) = 0", "error", "no-sinks"), ("len(sanitizers) = 0", "warning", "no-sanitizers"), ("NOT starts_with(cwe, 'CWE-')", "warning", "bad-cwe"), ("list_contains(sinks, 'os')", "warning", "short-sink-pattern")]


@query("t14_validate_rules", sql=f"WITH {_R}, {_RULES} " + " UNION ALL ".join(f"SELECT rule_id, '{lv}' AS level, '{c}' AS code FROM x WHERE {on}" for on, lv, c in _ISSUES))
def t14(spark, d):
    return ops.validate(_rules(spark, d))


@query("t13_import_skips", sql=f"WITH {_R}, {_RULES} SELECT CASE WHEN mode <> 'taint' THEN 'not-taint-mode' WHEN language = 'go' THEN 'unsupported-language' WHEN len(sources) = 0 THEN 'no-sources' WHEN len(sinks) = 0 THEN 'no-sinks' ELSE 'imported' END AS outcome, count(*) AS n FROM x GROUP BY 1")
def t13(spark, d):
    r = _rules(spark, d)
    return r.groupBy(F.coalesce(ops.skip_reason(r), F.lit("imported")).alias("outcome")).agg(F.count("*").alias("n"))


@query("t13_taxonomy_extract", sql="SELECT doc_id, nullif(upper(regexp_extract(t, '(?i)(CWE-\\d+)', 1)), '') AS cwe, nullif(upper(regexp_extract(t, '(?i)(A\\d{2}:20\\d{2})', 1)), '') AS owasp FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'see cwe-' || doc_id WHEN 1 THEN 'a0' || (doc_id % 9) || ':2021 and CWE-1' ELSE 'none' END AS t FROM documents)")
def t13x(spark, d):
    i = F.col("doc_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("see cwe-"), i.cast("string"))).when(i % 3 == 1, F.concat(F.lit("a0"), (i % 9).cast("string"), F.lit(":2021 and CWE-1"))).otherwise("none")
    return table(spark, d, "documents").select("doc_id", ops.tidy_taxonomy(text).alias("x")).select("doc_id", "x.*")


# the exported category of each family, and what each role's entries are told apart by, as the older rule shape has them
_CATEGORY = "CASE family WHEN 'SQL_INJECTION' THEN 'sqli' WHEN 'COMMAND_INJECTION' THEN 'rce' WHEN 'CODE_INJECTION' THEN 'rce' WHEN 'PATH_TRAVERSAL' THEN 'path_traversal' WHEN 'XSS' THEN 'xss' WHEN 'XXE' THEN 'xxe' WHEN 'OPEN_REDIRECT' THEN 'open_redirect' END"


@query("t15_export_legacy", sql=f"""WITH {_R}, {_RULES}, c AS (SELECT *, {_CATEGORY} AS cat FROM x), e AS (
    SELECT 'source' AS role, NULL AS category, unnest(sources) AS pattern, NULL AS family, 'MEDIUM' AS severity, rule_id, rule_no FROM c WHERE cat IS NOT NULL
    UNION ALL SELECT 'sink', cat, unnest(sinks), family, severity, rule_id, rule_no FROM c WHERE cat IS NOT NULL
    UNION ALL SELECT 'sanitizer', NULL, unnest(sanitizers), family, NULL, rule_id, rule_no FROM c WHERE cat IS NOT NULL)
    SELECT role, category, pattern, family, first(severity ORDER BY rule_no) AS severity, first(rule_id ORDER BY rule_no) AS rule_id FROM e GROUP BY role, category, pattern, family""")
def t15(spark, d):
    return ops.export_legacy(_rules(spark, d))


@query("t15_export_skips", sql=f"WITH {_R}, {_RULES} SELECT rule_id, 'unsupported legacy family mapping (' || family || ')' AS reason FROM x WHERE family = 'LDAP_INJECTION'")
def t15s(spark, d):
    return ops.export_skips(_rules(spark, d))


@query("s14_cards_first_wins", sql="SELECT 'card' || (p_size % 30) AS card_id, min(p_name || '.json') AS path FROM part GROUP BY 1")
def s14(spark, d):
    """Knowledge cards: of one card id the first file in path order."""
    return table(spark, d, "part").groupBy(F.concat(F.lit("card"), (F.col("p_size") % 30).cast("string")).alias("card_id")).agg(F.min(F.concat("p_name", F.lit(".json"))).alias("path"))


@query("s8_rules_by_language", sql="WITH b(lang, pattern) AS (VALUES ('de', 'und der'), ('fr', ' de la '), ('py', 'token')) SELECT doc_id, pattern FROM documents JOIN b ON b.lang = CASE WHEN documents.lang IN ('de', 'fr') THEN documents.lang ELSE 'py' END WHERE contains(text, pattern)")
def s8(spark, d):
    """Built-in rules of the file's language, the default's where it has none."""
    b = spark.sql("SELECT * FROM VALUES ('de', 'und der'), ('fr', ' de la '), ('py', 'token') AS t(_lang, pattern)")
    docs = table(spark, d, "documents").withColumn("_l", F.when(F.col("lang").isin("de", "fr"), F.col("lang")).otherwise("py"))
    return docs.join(F.broadcast(b), (F.col("_l") == F.col("_lang")) & F.col("text").contains(F.col("pattern"))).select("doc_id", "pattern")


# --- rule documents: a nested taint rule for each part, as VARIANT; its shape and names follow from the part

_SOURCES = ('["req_K"]', '[{"pattern": "get_K(", "focus-metavariable": "$X"}, {"pattern": "get_K(", "focus-metavariable": "$X"}]', '[{"pattern-either": [{"pattern": "a_K"}, {"patterns": [{"pattern-inside": "f_K"}, {"focus-metavariable": "$Y"}, {"pattern-regex": "r_K", "by-side-effect": true}]}]}]', '[5, {"pattern-not": "x"}, {"odd": 1}, {"patterns": "p"}]')
_LANGS = ('["python"]', '["go"]', '"Java"')
_WEAK = ('{"cwe": "CWE-89"}', '{"cwe": ["CWE-1: x", "cwe-22"], "owasp": ["A01:2021"]}', "{}")
_SHAPE = "k % 4 AS shape, k % 3 AS lang, k % 5 AS mode, k // 4 % 3 AS weak"


def _rule_documents(spark, d):
    k = F.col("p_partkey")
    at = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    j = F.concat(
        F.lit('{"id": "'), k.cast("string"), F.lit('", "message": "'), F.col("p_type"), F.lit('", "severity": "'), at(("ERROR", "warning", "odd"), k % 3), F.lit('", "mode": "'), F.when(k % 5 == 0, "search").otherwise("taint"), F.lit('", "languages": '), at(_LANGS, k % 3),
        F.lit(', "metadata": '), at(_WEAK, F.floor(k / 4) % 3), F.lit(', "pattern-sinks": ["t_K("], "pattern-sources": '), at(_SOURCES, k % 4), F.lit("}"),
    )
    return spread(table(spark, d, "part")).select(k.cast("string").alias("rule_id"), F.parse_json(F.replace(j, F.lit("_K"), F.concat(F.lit("_"), k.cast("string")))).alias("rule"))


_K = f"x AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS rule_id, p_type, {_SHAPE} FROM (SELECT p_partkey, p_partkey AS k, p_type FROM part))"


@query("t13_pattern_entries", sql=f"""WITH {_K}, p AS (SELECT rule_id, 'sink' AS role, 1 AS position, 't_' || rule_id || '(' AS pattern, 'literal' AS pattern_mode, false AS exact, false AS by_side_effect, NULL AS focus_metavariable FROM x
    UNION ALL SELECT rule_id, 'source', 1, 'req_' || rule_id, 'literal', false, false, NULL FROM x WHERE shape = 0 UNION ALL SELECT rule_id, 'source', 1, 'get_' || rule_id || '(', 'pattern', true, false, '$X' FROM x WHERE shape = 1
    UNION ALL SELECT rule_id, 'source', 1, 'a_' || rule_id, 'pattern', false, false, NULL FROM x WHERE shape = 2 UNION ALL SELECT rule_id, 'source', 2, 'f_' || rule_id, 'pattern', false, false, '$Y' FROM x WHERE shape = 2
    UNION ALL SELECT rule_id, 'source', 3, 'r_' || rule_id, 'pattern-regex', false, true, '$Y' FROM x WHERE shape = 2) SELECT * FROM p""")
def t13p(spark, d):
    return documents.pattern_entries(_rule_documents(spark, d))[0]


@query("t13_pattern_notes", sql=f"WITH {_K} SELECT rule_id, 'source' AS role, n AS position, note FROM x, (VALUES (1, 'Skipped source entry with unsupported type: int'), (2, 'Skipped source entry without reviewable pattern fields: odd'), (3, 'Skipped source nested group ''patterns'' because it is not a list')) AS v(n, note) WHERE shape = 3")
def t13n(spark, d):
    return documents.pattern_entries(_rule_documents(spark, d))[1]


@query("t13_normalized_rules", sql=f"""WITH {_K}, y AS (SELECT *, CASE weak WHEN 0 THEN 'SQL_INJECTION' WHEN 1 THEN 'PATH_TRAVERSAL' END AS family FROM x)
    SELECT rule_id, rule_id AS source_rule_id, p_type AS title, CASE lang WHEN 0 THEN 'python' WHEN 2 THEN 'java' END AS language, family, CASE lang WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    CASE weak WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-1,CWE-22' ELSE '' END AS cwe, CASE weak WHEN 1 THEN 'A01:2021' ELSE '' END AS owasp, CASE shape WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE 1 END AS n_sources, 1 AS n_sinks, 0 AS n_sanitizers,
    CASE WHEN mode = 0 THEN 'only taint-mode rules are supported' WHEN lang = 1 THEN 'rule language is unsupported or filtered out' WHEN family IS NULL THEN 'could not infer family and no override was supplied' WHEN shape = 3 THEN 'rule does not expose a reviewable taint source/sink subset' END AS skip_reason FROM y""")
def t13d(spark, d):
    return documents.normalize_rules(_rule_documents(spark, d)).withColumn("cwe", F.array_join("cwe", ",")).withColumn("owasp", F.array_join("owasp", ","))


@query("t14_document_issues", sql=f"""WITH {_K}, i AS (SELECT rule_id, k, shape, lang, weak FROM x)
    SELECT CASE WHEN k % 5 > 0 THEN rule_id ELSE '<missing-rule-id>' END AS rule_id, level, path, code FROM i, (VALUES ('error', 'rule_id', 'missing_required_field', 0), ('error', 'language', 'unsupported_language', 1), ('error', 'taxonomy.cwe', 'invalid_taxonomy_list', 2), ('warning', 'taxonomy.cwe[1]', 'suspicious_cwe_format', 3), ('error', 'detection.source_patterns[0]', 'invalid_pattern_entry', 4),
    ('error', 'detection.source_patterns', 'empty_pattern_list', 5), ('warning', 'detection.sink_patterns[0].exact', 'call_pattern_without_exact', 6), ('warning', 'notes[0]', 'invalid_note_value', 7), ('warning', 'provenance.source_path', 'missing_source_path', 8)) AS v(level, path, code, n)
    WHERE n = 0 AND k % 5 = 0 OR n = 1 AND lang = 1 OR n = 2 AND weak = 0 OR n = 3 AND weak = 1 OR n = 4 AND shape = 0 OR n = 5 AND shape = 3 OR n = 6 AND k % 7 = 0 OR n = 7 AND k % 6 = 0 OR n = 8 AND k % 8 = 0""")
def t14d(spark, d):
    """Issues of a normalized document for each part."""
    k = F.col("p_partkey")
    at = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    entry = '{"pattern": "p", "pattern_mode": "literal", "exact": false, "by_side_effect": false}'
    j = F.concat(
        F.lit('{"rule_id": "'), F.when(k % 5 > 0, k.cast("string")).otherwise(" "), F.lit('", "title": "t", "family": "SSRF", "severity": "LOW", "language": "'), at(("python", "go", "java"), k % 3), F.lit('", "taxonomy": {"owasp": [], "cwe": '), at(('"CWE-1"', '["CWE-1", "x"]', "[]"), F.floor(k / 4) % 3),
        F.lit('}, "detection": {"match_mode": "m", "sanitizers": [], "source_patterns": '), at(('["s"]', f"[{entry}]", f"[{entry}]", "[]"), k % 4), F.lit(', "sink_patterns": [{"pattern": "f(", "pattern_mode": "pattern", "by_side_effect": true, "exact": '), (k % 7 > 0).cast("string"),
        F.lit('}]}, "triage": {"knowledge_refs": [], "fp_hints": [], "remediation_notes": ["a"]}, "provenance": {"source": "s", "source_rule_id": "i", "importer": "m", "snapshot_version": "1"'), F.when(k % 8 > 0, ', "source_path": "p"').otherwise(""), F.lit('}, "notes": ['), F.when(k % 6 == 0, "7").otherwise(""), F.lit("]}"),
    )
    return documents.validate_rules(spread(table(spark, d, "part")).select(F.parse_json(j).alias("rule")))


@query("sf_deep_merge", sql="""SELECT p_partkey AS doc, '{"a":' || CASE WHEN p_partkey % 3 = 0 THEN '7' WHEN p_partkey % 3 = 1 THEN '{"name":"' || p_name || '","size":' || p_size || ',"tags":[2]}' ELSE '{"name":"' || p_name || '","size":0,"tags":[1,' || p_size || ']}' END || ',"b":{"c":{"d":' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ',"e":null' ELSE '' END || '}}}' AS merged FROM part""")
def deep(spark, d):
    """A base, a second and a third layer of settings for each part: maps merge, lists and numbers are replaced."""
    p = spread(table(spark, d, "part"))
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    base = F.concat(F.lit('{"a": {"tags": [1, '), size, F.lit('], "name": "'), name, F.lit('", "size": 0}, "b": {"c": {"d": 0}}}'))
    second = F.when(k % 3 == 0, F.lit('{"a": 7, "b": {}}')).when(k % 3 == 1, F.concat(F.lit('{"a": {"size": '), size, F.lit(', "tags": [2]}}'))).otherwise(F.lit('{"a": {}}'))
    third = F.concat(F.lit('{"b": {"c": {"d": '), size, F.when(k % 2 == 0, ', "e": null').otherwise(""), F.lit("}}}"))
    layers = p.select(k.alias("doc"), F.posexplode(F.array(base, second, third)).alias("layer", "j"))
    return json_documents.deep_merge(layers.select("doc", "layer", F.parse_json("j").alias("body")))

"""Where the operators get rows from the driver's tables: documents are files, lines are statements, rules are literals.

Each relation exists twice: as a DataFrame, and as the body of a CTE for the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators import findings as ops
from lintlake.session import spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, findings_sql: str | None = None):
    """Registers a query under its name with its SQL; findings_sql may use the CTEs rules, lines, m and f."""

    def add(f):
        QUERIES[name] = f
        if findings_sql is not None:
            ORACLE_SQL[name] = with_findings(findings_sql)
        elif sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add

#: rule_id, pattern, type, severity: literals over what the tables hold.
RULES = (
    ("SEC-1", 'token = "', "HARDCODED_SECRET", "CRITICAL"),
    ("SEC-2", "token", "HARDCODED_SECRET", "HIGH"),
    ("RED-1", "@mail", "OPEN_REDIRECT", "LOW"),
    ("LIC-1", "Licensed under", "PATH_TRAVERSAL", "MEDIUM"),
    ("LIC-2", "License", "PATH_TRAVERSAL", "LOW"),
    ("SQL-1", " the of", "SQL_INJECTION", "HIGH"),
    ("CMD-1", " de la ", "COMMAND_INJECTION", "CRITICAL"),
    ("COD-1", "und der", "CODE_INJECTION", "HIGH"),
    ("XSS-1", "%%%", "XSS", "INFO"),
    ("DES-1", "tion el", "INSECURE_DESERIALIZATION", "UNKNOWN"),
)


def rules(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(r).alias("rule_id"), F.lit(p).alias("pattern"), F.lit(t).alias("vulnerability_type"), F.lit(s).alias("severity"), F.lit(i + 1).alias("rule_no")) for i, (r, p, t, s) in enumerate(RULES)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{p}', '{t}', '{s}', {i + 1})" for i, (r, p, t, s) in enumerate(RULES)) + ") AS v(rule_id, pattern, vulnerability_type, severity, rule_no))"

EXT = {"de": "py", "en": "js", "es": "java", "fr": "php"}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return ops.lines(docs, keep=("lang", "source"))


LINES_SQL = "lines AS (SELECT doc_id, lang, source, CAST(i AS INTEGER) AS line_number, l[i] AS line FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the rules on lines, with the attributes a scan would give them, as functions of the row."""
    m = ops.match_lines(lines(spark, sf_dir), rules(spark))
    k = F.col("doc_id") * 7 + F.col("line_number") * 13 + F.col("rule_no") * 5
    m = m.withColumn("k", k).withColumn("file_path", F.concat_ws("", F.lit("src/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.create_map(*[F.lit(x) for p in EXT.items() for x in p]), F.col("lang"))))
    return m.select(
        F.concat("rule_id", F.lit("-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("line_number").cast("string")).alias("finding_id"),
        "doc_id", "file_path", F.col("lang").alias("language"), "source", "rule_id", "vulnerability_type", "severity", "line_number",
        F.col("pattern").alias("sink_pattern"), F.instr("line", F.col("pattern")).alias("column_number"), F.col("line").alias("snippet"),
        F.when(k % 4 == 0, "COMMAND_LINE_ARGS").when(k % 4 == 1, "ENVIRONMENT_VAR").when(k % 4 == 2, "HTTP_PARAMETER").otherwise("FILE_READ").alias("source_type"),
        F.when(k % 3 == 0, "subprocess.run").when(k % 3 == 1, "cursor.execute").otherwise("open").alias("sink_function"),
        F.when(k % 5 > 0, F.concat(F.lit("v"), (k % 7).cast("string"))).alias("variable"),
        (k % 4).cast("int").alias("steps"), (k % 3).cast("int").alias("n_sanitizers"), ((k % 3 > 0) & (k % 2 == 0)).alias("sanitized"),
        F.when(k % 6 > 0, k % 2 == 0).alias("ai_vulnerable"), F.when(k % 6 > 0, (k % 100) / 100.0).alias("ai_confidence"),
        F.round((k % 101) / 101.0, 3).alias("confidence"),
        F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "likely").when(k % 4 == 2, "needs-review").otherwise("suppressed").alias("triage_status"),
        F.when(k % 2 == 0, "bridge").otherwise("scanner").alias("tool"), (F.col("doc_id") * 100000 + F.col("line_number") * 100 + F.col("rule_no")).alias("ordinal"), "k",
    )


FINDINGS_SQL = f"""{RULES_SQL}, {LINES_SQL},
    m AS (SELECT *, doc_id * 7 + line_number * 13 + rule_no * 5 AS k FROM lines JOIN rules ON contains(line, pattern)),
    f AS (SELECT rule_id || '-' || doc_id || '-' || line_number AS finding_id, doc_id,
        'src/' || source || '/f' || doc_id || '.' || CASE lang WHEN 'de' THEN 'py' WHEN 'en' THEN 'js' WHEN 'es' THEN 'java' WHEN 'fr' THEN 'php' END AS file_path,
        lang AS language, source, rule_id, vulnerability_type, severity, line_number, pattern AS sink_pattern, CAST(instr(line, pattern) AS INTEGER) AS column_number, line AS snippet,
        CASE k % 4 WHEN 0 THEN 'COMMAND_LINE_ARGS' WHEN 1 THEN 'ENVIRONMENT_VAR' WHEN 2 THEN 'HTTP_PARAMETER' ELSE 'FILE_READ' END AS source_type,
        CASE k % 3 WHEN 0 THEN 'subprocess.run' WHEN 1 THEN 'cursor.execute' ELSE 'open' END AS sink_function,
        CASE WHEN k % 5 > 0 THEN 'v' || (k % 7) END AS variable, CAST(k % 4 AS INTEGER) AS steps, CAST(k % 3 AS INTEGER) AS n_sanitizers, (k % 3 > 0 AND k % 2 = 0) AS sanitized,
        CASE WHEN k % 6 > 0 THEN k % 2 = 0 END AS ai_vulnerable, CASE WHEN k % 6 > 0 THEN CAST(k % 100 AS DOUBLE) / 100 END AS ai_confidence,
        round(CAST(k % 101 AS DOUBLE) / 101, 3) AS confidence,
        CASE k % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'likely' WHEN 2 THEN 'needs-review' ELSE 'suppressed' END AS triage_status,
        CASE WHEN k % 2 = 0 THEN 'bridge' ELSE 'scanner' END AS tool, doc_id * 100000 + line_number * 100 + rule_no AS ordinal, k FROM m)"""
#: Truth: a labelled document is vulnerable when it is of low quality or toxic; its family is its language.
TRUTH_SQL = "truth AS (SELECT doc_id AS case_id, lang AS family, (quality = 0 OR toxic = 1) AS vulnerable FROM labels JOIN documents USING (doc_id))"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    both = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return both.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("family"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("vulnerable"))


def with_findings(body: str) -> str:
    return f"WITH {FINDINGS_SQL} {body}"

"""Queries of the code operators over Python programs that the documents' own lines spell.

Every line of a document is one line of a program: how long the line, its first word and its row of words are decides
which statement it is and which of five variables it reads and writes. So programs are as long, as many and as different
as the documents, and what flows where follows from the text alone: the SQL derives statements from the same lines and
follows definitions by recursive joins, without any program.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.graph import context, crossfile, filters, flow, plugins, scripts
from lintlake.operators import reports
from lintlake.plans.base import query
from lintlake.session import spread, table

#: Statements by number; {a} is written, {b} and {c} are read.
STATEMENTS = (
    "v{a} = request.args", "v{a} = request.args", "v{a} = request.args", "v{a} = v{b}", "v{a} = v{b}", "v{a} = f'{v{b}} x'", "v{a} = escape(v{b})", "os.system(v{b})", "os.system(v{b})", "v{a} = 'x'", "v{a} = ''", "if v{b}: v{a} = v{c}",
    "if v{b}: v{a} = v{c}", "v{a} += v{b}", "v{a}.append(v{b})", "os.system(v{c} + escape(v{b}))", "for v{a} in v{b}: pass", "v{a} = pick(v{b}, v{c})", "v{a} = pick(v{b}, v{c})", "run(v{b})", "with v{b} as v{a}: pass", "v{a}, v{b} = v{b}, v{a}", "return v{b}", "pass",
)
RETURN = STATEMENTS.index("return v{b}")
#: What stands above the lines of every program, the document's number in its last function's name; a document's line i is line i + HEAD.
TOP = "import os\ndef pick(a, b):\n    return a\ndef run(c):\n    os.system(c)\ndef main{i}(request):\n    v0 = v1 = v2 = v3 = v4 = ''\n"
HEAD, RUN_SINK = TOP.count("\n"), 5
SOURCES, SINKS, CLEAN = ("request.",), ("os.system",), ("escape",)


def measures(text: Column) -> Column:
    """n (length), first (length of the first word) and count (words) of each line of a text: worked out once a line, as what a function of an array's elements repeats is worked out again each time."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda x: F.struct(F.length(x).alias("n"), F.length(F.substring_index(x, " ", 1)).alias("first"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("count")))


def statement(line: Column, statements: tuple[str, ...] = STATEMENTS, doc: Column | None = None) -> Column:
    """The program line that a text line's measures spell. {t} is a document near by."""
    n, first, count = line["n"], line["first"], line["count"]
    # returns are rare, so that most of a document is live
    last = statements.index("return v{b}")
    k = (n + count * 3 + first) % len(statements)
    k = F.when((k == last) & (n % 4 > 0), F.lit(last + 1)).otherwise(k)
    out = F.element_at(F.array(*[F.lit("    " + s) for s in statements]), k + 1)
    for name, v in (("{a}", n % 5), ("{b}", first % 5), ("{c}", count % 5)):
        out = F.replace(out, F.lit("v" + name), F.concat(F.lit("v"), v.cast("string")))
    if any("{n}" in s for s in statements):
        out = F.replace(out, F.lit("{n}"), n.cast("string"))
    return out if doc is None else F.replace(out, F.lit("{t}"), F.greatest(doc - 3 + n % 7, F.lit(0)).cast("string"))


def programs(spark, d):
    """path, content: a Python file for each document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    i = F.col("doc_id").cast("string")
    body = F.array_join(F.transform(measures(F.col("text")), lambda x: statement(x)), "\n")
    return docs.select(F.concat(F.lit("f"), i, F.lit(".py")).alias("path"), F.concat(F.replace(F.lit(TOP), F.lit("{i}"), i), body, F.lit("\n")).alias("content"))


#: Statements of the live lines: doc_id, i (line), k (statement), a, b, c (variables).
_S = f"""lines AS (SELECT doc_id, CAST(i AS BIGINT) AS i, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
    raw AS (SELECT doc_id, i, length(line) AS n, length(string_split(line, ' ')[1]) AS f, len(string_split(line, ' ')) AS w FROM lines),
    every AS (SELECT doc_id, i, CASE WHEN (n + w * 3 + f) % {len(STATEMENTS)} = {RETURN} AND n % 4 > 0 THEN {RETURN + 1} ELSE (n + w * 3 + f) % {len(STATEMENTS)} END AS k, n % 5 AS a, f % 5 AS b, w % 5 AS c FROM raw),
    ends AS (SELECT doc_id, min(i) AS last FROM every WHERE k = {RETURN} GROUP BY doc_id),
    s AS (SELECT every.* FROM every LEFT JOIN ends ON every.doc_id = ends.doc_id WHERE last IS NULL OR i <= last)"""
#: Definitions: line, variable, whether it replaces what was held, whether that is read. Moves: line, variable read, variable written (null: a sink), whether a sanitizer is between, whether the sink is the function's.
_D = f"""{_S},
    defs AS (SELECT doc_id, i, a AS v, k NOT IN (11, 12, 14, 16) AS kills, k IN (14, 16) AS keeps FROM s WHERE k NOT IN (7, 8, 15, 19, 22, 23) UNION ALL SELECT doc_id, i, b, true, false FROM s WHERE k = 21 AND a <> b),
    moves AS (SELECT doc_id, i, b AS v, a AS dst, CASE WHEN k = 6 THEN 1 ELSE 0 END AS clean, 0 AS sink FROM s WHERE k IN (3, 4, 5, 6, 13, 14, 16, 17, 18, 20, 21)
        UNION ALL SELECT doc_id, i, c, a, 0, 0 FROM s WHERE k IN (11, 12) UNION ALL SELECT doc_id, i, a, a, 0, 0 FROM s WHERE k = 13 UNION ALL SELECT doc_id, i, a, b, 0, 0 FROM s WHERE k = 21 AND a <> b
        UNION ALL SELECT doc_id, i, b, NULL, 0, i + {HEAD} FROM s WHERE k IN (7, 8) UNION ALL SELECT doc_id, i, c, NULL, 0, i + {HEAD} FROM s WHERE k = 15 UNION ALL SELECT doc_id, i, b, NULL, 1, i + {HEAD} FROM s WHERE k = 15
        UNION ALL SELECT doc_id, i, b, NULL, 0, {RUN_SINK} FROM s WHERE k = 19 UNION ALL SELECT doc_id, i, b, NULL, 0, -1 FROM s WHERE k = {RETURN}),
    since AS (SELECT m.doc_id, m.i, m.v, m.dst, m.clean, m.sink, coalesce(max(d.i), 0) AS first FROM moves m LEFT JOIN defs d ON d.doc_id = m.doc_id AND d.v = m.v AND d.i < m.i AND d.kills GROUP BY ALL),
    e AS (SELECT m.doc_id, d.i AS src, m.v, m.i, m.dst, m.clean, m.sink FROM since m JOIN defs d ON d.doc_id = m.doc_id AND d.v = m.v AND d.i < m.i AND d.i >= m.first),
    t AS (SELECT doc_id, i, a AS v, i AS origin, 0 AS clean FROM s WHERE k < 3 UNION SELECT e.doc_id, e.i, e.dst, t.origin, greatest(t.clean, e.clean) FROM t JOIN e ON e.doc_id = t.doc_id AND e.src = t.i AND e.v = t.v WHERE e.dst IS NOT NULL),
    hits AS (SELECT e.doc_id, t.origin + {HEAD} AS source_line, e.sink AS sink_line, greatest(t.clean, e.clean) AS clean FROM t JOIN e ON e.doc_id = t.doc_id AND e.src = t.i AND e.v = t.v WHERE e.dst IS NULL)"""
_FLOWS = f"{_D}, flows AS (SELECT doc_id, source_line, sink_line, min(clean) = 1 AS sanitized FROM hits WHERE sink_line > 0 GROUP BY ALL)"
_WITH = "WITH RECURSIVE "
_PATH = "'f' || doc_id || '.py' AS path"


def _traces(spark, d):
    return flow.traces(programs(spark, d), SOURCES, SINKS, CLEAN)


@query("g6_trace_paths", sql=f"{_WITH}{_FLOWS} SELECT {_PATH}, source_line, CAST(sink_line AS BIGINT) AS sink_line, sanitized FROM flows")
def g6(spark, d):
    return _traces(spark, d).drop("steps")


@query("g7_transfer", sql=f"{_WITH}{_FLOWS} SELECT k AS statement, sanitized, count(*) AS n_flows FROM flows JOIN s ON s.doc_id = flows.doc_id AND s.i = source_line - {HEAD} GROUP BY ALL")
def g7(spark, d):
    """Flows by the statement that the source's line is: values overwritten, unreachable or of other variables carry none."""
    t = _traces(spark, d)
    docs = table(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("_p", "line"))
    words = F.split("line", " ", -1)
    kind = docs.select("path", (F.col("_p") + 1 + HEAD).cast("long").alias("source_line"), ((F.length("line") + F.size(words) * 3 + F.length(words[0])) % len(STATEMENTS)).cast("long").alias("statement"))
    return t.join(kind, ["path", "source_line"]).groupBy("statement", "sanitized").agg(F.count("*").alias("n_flows"))


@query("j4_source_sink_pairs", sql=f"{_WITH}{_FLOWS} SELECT source_line, CAST(sink_line AS BIGINT) AS sink_line, count(*) AS n FROM flows GROUP BY ALL")
def j4(spark, d):
    return _traces(spark, d).groupBy("source_line", "sink_line").agg(F.count("*").alias("n"))


@query("g14_function_index", sql=f"{_WITH}{_D}, p AS (SELECT min('f' || doc_id || '.py') AS path FROM documents WHERE doc_id IS NOT NULL), r AS (SELECT DISTINCT doc_id FROM hits WHERE sink_line = -1) SELECT name, path, line, params, depends FROM p, (VALUES ('pick', 2::BIGINT, 'a,b', 'a'), ('run', 4::BIGINT, 'c', '')) AS v(name, line, params, depends) WHERE path IS NOT NULL UNION ALL SELECT 'main' || d.doc_id, 'f' || d.doc_id || '.py', 6::BIGINT, 'request', CASE WHEN r.doc_id IS NULL THEN '' ELSE 'request' END FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN r ON r.doc_id = d.doc_id")
def g14(spark, d):
    return flow.function_index(programs(spark, d).filter("path IS NOT NULL"))


@query("g16_returning_sources", sql=f"{_WITH}{_D} SELECT DISTINCT {_PATH}, 'main' || doc_id AS name FROM hits WHERE sink_line = -1")
def g16(spark, d):
    return flow.returns_source(programs(spark, d), SOURCES)


#: Uses by the nearest definitions: a write that keeps what was held reads it and hands it on.
_USES = f"""{_D},
    reads AS (SELECT doc_id, i, b AS v FROM s WHERE k IN (3, 4, 5, 6, 7, 8, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, {RETURN}) UNION SELECT doc_id, i, c FROM s WHERE k IN (15, 17, 18) UNION SELECT doc_id, i, a FROM s WHERE k IN (13, 14, 16, 21)),
    inner_reads AS (SELECT doc_id, i, c AS v FROM s WHERE k IN (11, 12)),
    every_read AS (SELECT doc_id, i, v, 0 AS part FROM reads UNION ALL SELECT doc_id, i, v, 1 FROM inner_reads),
    near AS (SELECT r.doc_id, r.i, r.v, r.part, coalesce(max(d.i), 0) AS first FROM every_read r LEFT JOIN defs d ON d.doc_id = r.doc_id AND d.v = r.v AND d.i < r.i AND (d.kills OR d.keeps) GROUP BY ALL),
    all_defs AS (SELECT doc_id, i, v FROM defs UNION ALL SELECT DISTINCT doc_id, 0, v FROM documents, (VALUES (0), (1), (2), (3), (4)) AS t(v)),
    uses AS (SELECT n.doc_id, n.v, n.i, n.part, d.i AS src FROM near n JOIN all_defs d ON d.doc_id = n.doc_id AND d.v = n.v AND d.i < n.i AND d.i >= n.first UNION ALL SELECT doc_id, a, i, 0, i FROM s WHERE k = 16)"""


@query("g2_data_edges", sql=f"{_WITH}{_USES} SELECT {_PATH}, 'v' || v AS name, count(*) AS n_uses FROM uses GROUP BY ALL")
def g2(spark, d):
    """Uses of a name by the definitions that reach them: a new definition kills the old one, one side of a branch does not, unreachable code uses nothing."""
    return flow.graph(programs(spark, d), ("dfg",)).filter("kind = 'dfg' AND label LIKE 'v_'").groupBy("path", F.col("label").alias("name")).agg(F.count("*").alias("n_uses"))


@query("g3_dead_code", sql=f"{_WITH}{_S} SELECT 'f' || d.doc_id || '.py' AS path, count(s.i) + 1 AS n_calls FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id AND k IN (7, 8, 14, 15, 19) GROUP BY d.doc_id")
def g3(spark, d):
    """Call statements that control can reach."""
    return flow.graph(programs(spark, d), ("node",)).groupBy("path").agg(F.count_if((F.col("kind") == "node") & (F.col("label") == "call")).alias("n_calls"))


@query("g4_loop_edges", sql=f"{_WITH}{_S} SELECT 'f' || d.doc_id || '.py' AS path, count(s.i) AS n_back FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id AND k = 16 GROUP BY d.doc_id")
def g4(spark, d):
    return flow.graph(programs(spark, d)).groupBy("path").agg(F.count_if((F.col("kind") == "cfg") & (F.col("label") == "back")).alias("n_back"))


_KIND = "CASE WHEN k IN (7, 8, 14, 15, 19) THEN 'call' WHEN k IN (11, 12) THEN 'if' WHEN k = 13 THEN 'augassign' WHEN k = 16 THEN 'for' WHEN k = 20 THEN 'with' WHEN k = 22 THEN 'return' WHEN k = 23 THEN 'statement' ELSE 'assign' END"


@query("g1_flow_graph", sql=f"""{_WITH}{_USES}, docs AS (SELECT count(*) AS n FROM documents), p AS (SELECT count(*) AS n, count(*) FILTER (WHERE k IN (11, 12)) AS n_if, count(*) FILTER (WHERE k = 16) AS n_for, count(*) FILTER (WHERE k = 20) AS n_with FROM s),
    after_if AS (SELECT count(*) AS n FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.i + 1 = y.i WHERE x.k IN (11, 12)),
    n AS (SELECT 'node' AS kind, {_KIND} AS label, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'node', 'assign', n_if FROM p UNION ALL SELECT 'node', 'statement', n_for + n_with FROM p UNION ALL SELECT 'node', l, n * c FROM docs, (VALUES ('entry', 1), ('statement', 1), ('parameters', 3), ('function', 3), ('return', 1), ('call', 1), ('assign', 1)) AS v(l, c)
        UNION ALL SELECT 'cfg', 'closure', n * 6 FROM docs UNION ALL SELECT 'cfg', 'back', n_for FROM p UNION ALL SELECT 'cfg', 'next', p.n + after_if.n + n_if + n_for + n_with + docs.n * 7 FROM p, after_if, docs UNION ALL SELECT 'dfg', 'v' || v, count(*) FROM uses GROUP BY v)
    SELECT kind, label, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY ALL HAVING sum(n) > 0""")
def g1(spark, d):
    """Nodes and edges of all programs by kind and label, data edges of the five variables."""
    return flow.graph(programs(spark, d)).filter("kind <> 'dfg' OR label LIKE 'v_'").groupBy("kind", "label").agg(F.count("*").alias("n"))


def _constants() -> str:
    """An interpreter in SQL: a row walks a document's lines, each variable a text or null (anything)."""
    pick = lambda x: "CASE " + " ".join(f"WHEN {x} = {j} THEN v{j}" for j in range(5)) + " END"
    new = f"""CASE WHEN k IN (3, 4) THEN vb WHEN k = 5 THEN vb || ' x' WHEN k = 9 THEN 'x' WHEN k = 10 THEN '' WHEN k IN (11, 12) THEN CASE WHEN vb IS NULL THEN CASE WHEN va = vc THEN va END WHEN vb <> '' THEN vc ELSE va END WHEN k = 13 THEN va || vb WHEN k = 21 THEN vb WHEN k IN (7, 8, 14, 15, 19, 22, 23) THEN va END"""
    sets = ", ".join(f"CASE WHEN a = {j} THEN na WHEN k = 21 AND b = {j} THEN va ELSE v{j} END" for j in range(5))
    return f"""{_S}, walk AS (SELECT doc_id, 0::BIGINT AS i, {', '.join(f"''::VARCHAR AS v{j}" for j in range(5))}, NULL::BIGINT AS sink, false AS keep FROM (SELECT DISTINCT doc_id FROM s) UNION ALL
        SELECT doc_id, i, {sets}, CASE WHEN k IN (7, 8, 15) THEN i + {HEAD} END, k = 15 OR vb IS NULL FROM (SELECT *, CASE WHEN length(n0) <= 4096 THEN n0 END AS na FROM (SELECT *, {new} AS n0 FROM
        (SELECT s.doc_id, s.i, k, a, b, c, v0, v1, v2, v3, v4, {pick('a')} AS va, {pick('b')} AS vb, {pick('c')} AS vc FROM walk JOIN s ON s.doc_id = walk.doc_id AND s.i = walk.i + 1))))
        SELECT {_PATH}, sink AS line, keep FROM walk WHERE sink IS NOT NULL UNION ALL SELECT {_PATH}, {RUN_SINK}::BIGINT, true FROM documents"""


@query("g23_constant_filter", sql=_WITH + _constants())
def g23(spark, d):
    return flow.safe_values(programs(spark, d), sinks=SINKS)


# --- across files: a module for each document, whose lines call the modules of documents near by

CALLS = (
    "v{a} = request.args.get('k')", "v{a} = request.args.get('k')", "v{a} = v{b}", "v{a} = v{b}", "v{a} = shlex.quote(v{b})", "v{a} = int(v{b})", "os.system(v{b})", "os.system(v{b})", "cursor.execute(v{b})", "v{a} = 'x'",
    "from m{t} import f{t}; v{a} = f{t}(v{b}, v{c})", "from m{t} import f{t}; v{a} = f{t}(v{b}, v{c})", "from m{t} import f{t}; v{a} = f{t}(v{b}, v{c})", "from m{t} import f{t}; f{t}(q=v{b})", "if v{b}: v{a} = v{c}", "return v{b}", "pass",
)
MODULE = "def f{i}(p, q):\n    v0 = p\n    v1 = q\n    v2 = v3 = v4 = ''\n"
MODULE_HEAD = MODULE.count("\n")


def modules(spark, d):
    """path, content: a Python module for each document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).filter("doc_id IS NOT NULL")
    i = F.col("doc_id").cast("string")
    body = F.array_join(F.transform(measures(F.col("text")), lambda x: statement(x, CALLS, F.col("doc_id"))), "\n")
    return docs.select(F.concat(F.lit("m"), i, F.lit(".py")).alias("path"), F.concat(F.replace(F.lit(MODULE), F.lit("{i}"), i), body, F.lit("\n")).alias("content"))


#: Ports of each module's function, from the lines: start (p: parameter 0 or 1, s: source line, c: line of a call to t), end (s: sink, a: argument to t's parameter, r: result).
_PORTS = f"""lines AS (SELECT doc_id, CAST(i AS BIGINT) AS i, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents WHERE doc_id IS NOT NULL)),
    raw AS (SELECT doc_id, i, length(line) AS n, length(string_split(line, ' ')[1]) AS f, len(string_split(line, ' ')) AS w FROM lines),
    every AS (SELECT doc_id, i, CASE WHEN (n + w * 3 + f) % {len(CALLS)} = 15 AND n % 4 > 0 THEN 16 ELSE (n + w * 3 + f) % {len(CALLS)} END AS k, n % 5 AS a, f % 5 AS b, w % 5 AS c, greatest(doc_id - 3 + n % 7, 0) AS t FROM raw),
    ends AS (SELECT doc_id, min(i) AS last FROM every WHERE k = 15 GROUP BY doc_id),
    s AS (SELECT every.* FROM every LEFT JOIN ends ON every.doc_id = ends.doc_id WHERE last IS NULL OR i <= last),
    defs AS (SELECT doc_id, i, a AS v, k <> 14 AS kills FROM s WHERE k NOT IN (6, 7, 8, 13, 15, 16) UNION ALL SELECT doc_id, 0, x, true FROM (SELECT DISTINCT doc_id FROM s), (VALUES (0), (1), (2), (3), (4)) AS t(x)),
    moves AS (SELECT doc_id, i, b AS v, a AS dst, CASE k WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS clean, NULL AS e, NULL AS t, NULL AS place FROM s WHERE k IN (2, 3, 4, 5, 10, 11, 12) UNION ALL SELECT doc_id, i, c, a, 0, NULL, NULL, NULL FROM s WHERE k IN (10, 11, 12, 14)
        UNION ALL SELECT doc_id, i, b, NULL, 0, CASE WHEN k = 8 THEN 'execute' ELSE 'os.system' END, NULL, NULL FROM s WHERE k IN (6, 7, 8) UNION ALL SELECT doc_id, i, b, NULL, 0, 'r', NULL, NULL FROM s WHERE k = 15
        UNION ALL SELECT doc_id, i, b, NULL, 0, 'a', t, CASE WHEN k = 13 THEN 1 ELSE 0 END FROM s WHERE k IN (10, 11, 12, 13) UNION ALL SELECT doc_id, i, c, NULL, 0, 'a', t, 1 FROM s WHERE k IN (10, 11, 12)),
    since AS (SELECT m.doc_id, m.i, m.v, m.dst, m.clean, m.e, m.t, m.place, max(d.i) AS first FROM moves m JOIN defs d ON d.doc_id = m.doc_id AND d.v = m.v AND d.i < m.i AND d.kills GROUP BY ALL),
    edge AS (SELECT m.doc_id, d.i AS src, m.v, m.i, m.dst, m.clean, m.e, m.t, m.place FROM since m JOIN defs d ON d.doc_id = m.doc_id AND d.v = m.v AND d.i < m.i AND d.i >= m.first),
    fact AS (SELECT doc_id, 0::BIGINT AS i, x AS v, 'p' AS kind, x::BIGINT AS origin, -1::BIGINT AS called, 0 AS clean FROM (SELECT DISTINCT doc_id FROM s), (VALUES (0), (1)) AS t(x) UNION ALL SELECT doc_id, i, a, CASE WHEN k < 2 THEN 's' ELSE 'c' END, i, CASE WHEN k < 2 THEN -1 ELSE t END, 0 FROM s WHERE k IN (0, 1, 10, 11, 12)
        UNION SELECT edge.doc_id, edge.i, edge.dst, fact.kind, fact.origin, fact.called, fact.clean | edge.clean FROM fact JOIN edge ON edge.doc_id = fact.doc_id AND edge.src = fact.i AND edge.v = fact.v WHERE edge.dst IS NOT NULL),
    port AS (SELECT DISTINCT edge.doc_id, fact.kind, fact.origin, fact.called, edge.e, edge.i, edge.t, edge.place, fact.clean | edge.clean AS clean FROM fact JOIN edge ON edge.doc_id = fact.doc_id AND edge.src = fact.i AND edge.v = fact.v WHERE edge.dst IS NULL)"""
_CROSS = f"""WITH RECURSIVE {_PORTS},
    summary AS (SELECT doc_id, origin AS param, doc_id AS sunk, i AS line, e, clean, 0 AS hops FROM port WHERE kind = 'p' AND e IN ('os.system', 'execute')
        UNION SELECT port.doc_id, port.origin, summary.sunk, summary.line, summary.e, port.clean | summary.clean, hops + 1 FROM summary JOIN port ON port.t = summary.doc_id AND port.place = summary.param WHERE port.kind = 'p' AND port.e = 'a' AND hops < {{depth}}),
    gives AS (SELECT doc_id, doc_id AS sunk, origin AS line, clean, 0 AS hops FROM port WHERE kind = 's' AND e = 'r' UNION SELECT port.doc_id, gives.sunk, gives.line, port.clean | gives.clean, hops + 1 FROM gives JOIN port ON port.called = gives.doc_id WHERE port.kind = 'c' AND port.e = 'r' AND hops < {{depth}}),
    begun AS (SELECT doc_id, e, i, t, place, clean, doc_id AS source, origin AS line, 0 AS hops FROM port WHERE kind = 's' UNION ALL SELECT port.doc_id, port.e, port.i, port.t, port.place, port.clean | gives.clean, gives.sunk, gives.line, 1 FROM port JOIN gives ON port.called = gives.doc_id WHERE port.kind = 'c'),
    found AS (SELECT source, line, doc_id AS sunk, i, e, clean, hops FROM begun WHERE e IN ('os.system', 'execute') UNION ALL SELECT source, begun.line, summary.sunk, summary.line, summary.e, begun.clean | summary.clean, begun.hops + 1 + summary.hops FROM begun JOIN summary ON summary.doc_id = begun.t AND summary.param = begun.place WHERE begun.e = 'a'),
    best AS (SELECT source, line, sunk, i, e, min(CASE WHEN e = 'os.system' THEN clean & 1 ELSE 0 END * 100 + hops) AS x FROM found GROUP BY ALL)"""


@query("g17_cross_file_taint", sql=_CROSS.format(depth=5) + f" SELECT 'm' || source || '.py' AS source_path, line + {MODULE_HEAD} AS source_line, 'm' || sunk || '.py' AS sink_path, i + {MODULE_HEAD} AS sink_line, CASE e WHEN 'execute' THEN 'SQL_INJECTION' ELSE 'COMMAND_INJECTION' END AS vulnerability_type, CASE WHEN x >= 100 THEN 'SUPPRESSED' ELSE 'CONFIRMED' END AS triage_status, CAST(x % 100 AS INTEGER) AS hops FROM best")
def g17(spark, d):
    """Sources of one module that reach sinks of others through the calls between them, to a depth of five."""
    return crossfile.cross_file(modules(spark, d)).select("source_path", "source_line", "sink_path", "sink_line", "vulnerability_type", "triage_status", "hops")


_CALL = "calls AS (SELECT DISTINCT doc_id, i, t FROM s WHERE k IN (10, 11, 12, 13))"


@query("j7_import_calls", sql=f"WITH RECURSIVE {_PORTS}, {_CALL} SELECT DISTINCT 'm' || c.doc_id || '.py' AS path, 'f' || t AS callee, 'm' || t || '.py' AS to_path FROM calls c JOIN (SELECT DISTINCT doc_id FROM s) x ON x.doc_id = t")
def j7c(spark, d):
    """Call sites with the files that their imports name, where there is such a function."""
    known, calls, _ = crossfile.outlines(modules(spark, d))
    return crossfile.resolve(calls, known).select("path", "callee", "to_path").distinct()


@query("j8_bound_arguments", sql=f"WITH RECURSIVE {_PORTS} SELECT DISTINCT 'm' || port.doc_id || '.py' AS path, 'f' || t AS callee, CASE WHEN place = 0 THEN 'p' ELSE 'q' END AS param FROM port JOIN (SELECT DISTINCT doc_id FROM s) x ON x.doc_id = t WHERE e = 'a'")
def j8c(spark, d):
    """Parameters that arguments go to, by position or keyword, of arguments that a parameter, a source or a result reaches."""
    _, cleaning = crossfile.bits(crossfile.SINKS, crossfile.SANITIZERS)
    known, calls, edges = crossfile.outlines(modules(spark, d), crossfile.SOURCES, crossfile.SINKS, cleaning)
    places = edges.filter("end = 'argument'").select("path", F.col("end_name").alias("callee"), "place")
    return crossfile.bind(crossfile.resolve(calls, known), places, known).select("path", "callee", "param").distinct()


@query("j17_call_graph", sql=f"WITH RECURSIVE {_PORTS}, {_CALL} SELECT 'm' || c.doc_id || '.py' AS caller_path, 'f' || c.doc_id AS caller, 'm' || t || '.py' AS callee_path, 'f' || t AS callee, count(*) AS n_calls, min(i) + {MODULE_HEAD} AS first_line FROM calls c JOIN (SELECT DISTINCT doc_id FROM s) x ON x.doc_id = t GROUP BY c.doc_id, t")
def j17c(spark, d):
    """Who calls whom, and where first."""
    known, calls, _ = crossfile.outlines(modules(spark, d))
    return crossfile.callees(calls, crossfile.resolve(calls, known))


@query("g15_returned_sources", sql=_CROSS.format(depth=5) + f" SELECT DISTINCT 'm' || doc_id || '.py' AS path, 'f' || doc_id AS function, 'm' || sunk || '.py' AS origin_path, line + {MODULE_HEAD} AS origin_line FROM gives")
def g15r(spark, d):
    """Functions whose result carries a source, their own or that of a function they call, also through cycles of calls."""
    _, cleaning = crossfile.bits(crossfile.SINKS, crossfile.SANITIZERS)
    known, calls, edges = crossfile.outlines(modules(spark, d), crossfile.SOURCES, crossfile.SINKS, cleaning)
    found = crossfile.returned(edges, crossfile.resolve(calls, known))
    return found.select("path", "function", "origin_path", "origin_line").distinct()


# --- guards, constants and dead branches: functions whose lines leave early, enclose sinks, or test numbers of their own

GUARDS = (
    "v{a} = request.args", "v{a} = request.args", "v{a} = v{b}", "v{a} = v{b}", "v{a} = 'x'", "v{a} = escape(v{b})", "os.system(v{b})", "os.system(v{b})", "if bad(v{b}): return v{c}", "if ok(v{b}): os.system(v{c})", "v{a} += v{b}",
    "if {n} > 60: v{a} = v{c}", "if {n} > 60: v{a} = v{c}", "return v{b}", "pass",
)
GUARDED = "def main{i}(request, q):\n    v0 = v1 = v2 = q\n    v3 = v4 = ''\n"
GUARD_HEAD = GUARDED.count("\n")


def guarded(spark, d):
    """path, content: a function with guards for each document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    i = F.col("doc_id").cast("string")
    body = F.array_join(F.transform(measures(F.col("text")), lambda x: statement(x, GUARDS)), "\n")
    return docs.select(F.concat(F.lit("f"), i, F.lit(".py")).alias("path"), F.concat(F.replace(F.lit(GUARDED), F.lit("{i}"), i), body, F.lit("\n")).alias("content"))


_G = f"""lines AS (SELECT doc_id, CAST(i AS BIGINT) AS i, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
    raw AS (SELECT doc_id, i, length(line) AS n, length(string_split(line, ' ')[1]) AS f, len(string_split(line, ' ')) AS w FROM lines),
    every AS (SELECT doc_id, i, n, CASE WHEN (n + w * 3 + f) % {len(GUARDS)} = 13 AND n % 4 > 0 THEN 14 ELSE (n + w * 3 + f) % {len(GUARDS)} END AS k, n % 5 AS a, f % 5 AS b, w % 5 AS c FROM raw),
    ends AS (SELECT doc_id, min(i) AS last FROM every WHERE k = 13 GROUP BY doc_id),
    s AS (SELECT every.* FROM every LEFT JOIN ends ON every.doc_id = ends.doc_id WHERE last IS NULL OR i <= last),
    sinks AS (SELECT doc_id, i, CASE k WHEN 9 THEN c ELSE b END AS v FROM s WHERE k IN (6, 7, 9)),
    guards AS (SELECT x.doc_id, x.i, g.i AS j, 'false' AS side, false AS enclosing, CASE WHEN g.b = x.v THEN 'v' || x.v ELSE '' END AS checked FROM sinks x JOIN s g ON g.doc_id = x.doc_id AND g.i < x.i AND g.k = 8
        UNION ALL SELECT doc_id, i, i, 'true', true, CASE WHEN b = c THEN 'v' || c ELSE '' END FROM s WHERE k = 9)"""


def _flow_sql(name: str, pruned: bool) -> str:
    """Flows (doc_id, line, sink line, whether one is not cleaned); pruned: with tests of numbers decided."""
    live = "(k NOT IN (11, 12) OR n > 60)" if pruned else "true"
    kills = "true" if pruned else "k NOT IN (11, 12)"
    return f"""d_{name} AS (SELECT doc_id, i, a AS v, {kills} AS kills FROM s WHERE k IN (0, 1, 2, 3, 4, 5, 10, 11, 12) AND {live}),
    m_{name} AS (SELECT doc_id, i, b AS v, a AS dst, CASE k WHEN 5 THEN 1 ELSE 0 END AS clean FROM s WHERE k IN (2, 3, 5, 10) UNION ALL SELECT doc_id, i, a, a, 0 FROM s WHERE k = 10 UNION ALL SELECT doc_id, i, c, a, 0 FROM s WHERE k IN (11, 12) AND {live} UNION ALL SELECT doc_id, i, v, NULL, 0 FROM sinks),
    n_{name} AS (SELECT m.doc_id, m.i, m.v, m.dst, m.clean, coalesce(max(d.i), 0) AS first FROM m_{name} m LEFT JOIN d_{name} d ON d.doc_id = m.doc_id AND d.v = m.v AND d.i < m.i AND d.kills GROUP BY ALL),
    e_{name} AS (SELECT m.doc_id, d.i AS src, m.v, m.i, m.dst, m.clean FROM n_{name} m JOIN d_{name} d ON d.doc_id = m.doc_id AND d.v = m.v AND d.i < m.i AND d.i >= m.first),
    t_{name} AS (SELECT doc_id, i, a AS v, i AS origin, 0 AS clean FROM s WHERE k < 2 UNION SELECT e.doc_id, e.i, e.dst, t.origin, greatest(t.clean, e.clean) FROM t_{name} t JOIN e_{name} e ON e.doc_id = t.doc_id AND e.src = t.i AND e.v = t.v WHERE e.dst IS NOT NULL),
    {name} AS (SELECT e.doc_id, t.origin AS line, e.i AS sink, min(greatest(t.clean, e.clean)) AS clean FROM t_{name} t JOIN e_{name} e ON e.doc_id = t.doc_id AND e.src = t.i AND e.v = t.v WHERE e.dst IS NULL GROUP BY ALL)"""


@query("g13_control_context", sql=f"WITH {_G} SELECT {_PATH}, i + {GUARD_HEAD} AS sink_line, j + {GUARD_HEAD} AS guard_line, side, enclosing, checked FROM guards")
def g13x(spark, d):
    """Branches that each sink depends on: those that enclose it, and those that left early."""
    return context.control_context(guarded(spark, d), SINKS).select("path", "sink_line", "guard_line", "side", "enclosing", "checked")


#: Sinks that something other than a literal reaches: its definitions backward, through copies; line 0 gives the first three variables the parameter.
_CONST = """reads AS (SELECT doc_id, i, v, -1 AS dst FROM sinks UNION ALL SELECT doc_id, i, v, dst FROM m_flows WHERE dst IS NOT NULL),
    first AS (SELECT r.doc_id, r.i, r.v, coalesce(max(d.i), 0) AS first FROM (SELECT DISTINCT doc_id, i, v FROM reads) r LEFT JOIN d_flows d ON d.doc_id = r.doc_id AND d.v = r.v AND d.i < r.i AND d.kills GROUP BY ALL),
    defs AS (SELECT doc_id, i, v FROM d_flows UNION ALL SELECT doc_id, 0, x FROM (SELECT DISTINCT doc_id FROM s), (VALUES (0), (1), (2), (3), (4)) AS t(x)),
    reach AS (SELECT f.doc_id, f.i, f.v, d.i AS at FROM first f JOIN defs d ON d.doc_id = f.doc_id AND d.v = f.v AND d.i < f.i AND d.i >= f.first),
    back AS (SELECT doc_id, i AS sink, i, v FROM sinks UNION SELECT back.doc_id, back.sink, reads.i, reads.v FROM back JOIN reach ON reach.doc_id = back.doc_id AND reach.i = back.i AND reach.v = back.v JOIN reads ON reads.doc_id = reach.doc_id AND reads.i = reach.at AND reads.dst = back.v),
    bad AS (SELECT DISTINCT back.doc_id, back.sink FROM back JOIN reach ON reach.doc_id = back.doc_id AND reach.i = back.i AND reach.v = back.v LEFT JOIN s ON s.doc_id = reach.doc_id AND s.i = reach.at WHERE reach.at = 0 AND back.v < 3 OR s.k IN (0, 1, 5))"""


@query("t10_validator", sql=f"""WITH RECURSIVE {_G}, {_flow_sql("flows", False)}, {_CONST},
    f AS (SELECT doc_id, sink, bool_and(clean = 1) AS clean FROM flows GROUP BY ALL), g AS (SELECT doc_id, i, bool_or(NOT enclosing AND checked <> '') AS early FROM guards GROUP BY ALL),
    v AS (SELECT x.doc_id, x.i, f.doc_id IS NOT NULL AS flows, coalesce(f.clean, false) AS clean, bad.doc_id IS NULL AS bound, g.doc_id IS NOT NULL AS guarded, coalesce(g.early, false) AS early FROM sinks x LEFT JOIN f ON f.doc_id = x.doc_id AND f.sink = x.i LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i LEFT JOIN bad ON bad.doc_id = x.doc_id AND bad.sink = x.i)
    SELECT {_PATH}, i + {GUARD_HEAD} AS line, flows AS dataflow_confirmed, flows AND NOT bound AS sink_reachable, clean AS sanitizer_confirmed, bound AS constant_bound, guarded, early AS guarded_by_early_return, bound OR clean OR early AS proved_safe FROM v""")
def t10(spark, d):
    """What the programs' own branches, constants and sanitizers prove about their sinks."""
    return context.validate(guarded(spark, d), SOURCES, SINKS, CLEAN)


@query("t4_branch_proofs", sql=f"WITH RECURSIVE {_G}, {_flow_sql('flows', False)}, {_flow_sql('decided', True)} SELECT DISTINCT 'f' || a.doc_id || '.py' AS path, a.line + {GUARD_HEAD} AS source_line, a.sink + {GUARD_HEAD} AS sink_line FROM flows a LEFT JOIN decided b ON b.doc_id = a.doc_id AND b.line = a.line AND b.sink = a.sink WHERE b.doc_id IS NULL")
def t4b(spark, d):
    """Flows that only a side that is never taken makes."""
    return context.branch_proofs(guarded(spark, d), SOURCES, SINKS, CLEAN).select("path", "source_line", "sink_line").distinct()


@query("g13_literal_sinks", sql=f"WITH RECURSIVE {_G}, {_flow_sql('flows', False)}, {_CONST} SELECT 'f' || x.doc_id || '.py' AS path, x.i + {GUARD_HEAD} AS line, bad.doc_id IS NULL AS constant_bound FROM sinks x LEFT JOIN bad ON bad.doc_id = x.doc_id AND bad.sink = x.i")
def g13l(spark, d):
    """Sinks that only literals reach, by all definitions and copies."""
    return context.sink_facts(guarded(spark, d), SOURCES, SINKS, CLEAN).select("path", "line", "constant_bound")


@query("g13_resolve_symbol", sql=f"SELECT 'f' || doc_id AS name, 1::BIGINT AS n_definitions, false AS ambiguous, 'm' || doc_id || '.py:1' AS places FROM documents WHERE doc_id IS NOT NULL")
def g13r(spark, d):
    return context.symbols(crossfile.functions(modules(spark, d)))


# --- filters of false positives: names and the places of a dict, constant, checked for a family of sinks, or anything

CHECKS = (
    "v{a} = q", "v{a} = q + v{b}", "v{a} = 'x'", "d['a'] = v{b}", "d['b'] = v{b}", "v{a} = d['a']", "v{a} = d['b']", "v{a} = d.get('b', q)", "v{a} = shlex.quote(v{b})", "v{a} = os.path.basename(v{b})", "if q: v{a} = v{c}", "v{a} = v{b} + v{c}",
    "open(v{b})", "open(v{b})", "os.system('ls ' + v{b})", "subprocess.run(['ls', v{b}])", "pickle.loads(d['a'])", "return v{b}", "pass",
)
CHECKED = "def main{i}(q):\n    v0 = v1 = v2 = q\n    v3 = v4 = 'k'\n    d = {'a': 'x', 'b': q}\n"
CHECK_HEAD = CHECKED.count("\n")


def checked(spark, d):
    """path, content: a function of sinks and checks for each document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    i = F.col("doc_id").cast("string")
    body = F.array_join(F.transform(measures(F.col("text")), lambda x: statement(x, CHECKS)), "\n")
    return docs.select(F.concat(F.lit("f"), i, F.lit(".py")).alias("path"), F.concat(F.replace(F.lit(CHECKED), F.lit("{i}"), i), body, F.lit("\n")).alias("content"))


def _checks() -> str:
    """An interpreter in SQL: of each variable and place the families it may be given to, as bits (7: a constant)."""
    pick = lambda x: "CASE " + " ".join(f"WHEN {x} = {j} THEN v{j}" for j in range(5)) + " END"
    n = len(CHECKS)
    new = "CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 7 WHEN 5 THEN da WHEN 6 THEN db WHEN 7 THEN db WHEN 8 THEN vb | 2 WHEN 9 THEN vb | 1 WHEN 10 THEN va & vc WHEN 11 THEN vb & vc ELSE va END"
    sets = ", ".join(f"CASE WHEN a = {j} THEN na ELSE v{j} END" for j in range(5))
    return f"""WITH RECURSIVE lines AS (SELECT doc_id, CAST(i AS BIGINT) AS i, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
        raw AS (SELECT doc_id, i, length(line) AS n, length(string_split(line, ' ')[1]) AS f, len(string_split(line, ' ')) AS w FROM lines),
        every AS (SELECT doc_id, i, CASE WHEN (n + w * 3 + f) % {n} = {n - 2} AND n % 4 > 0 THEN {n - 1} ELSE (n + w * 3 + f) % {n} END AS k, n % 5 AS a, f % 5 AS b, w % 5 AS c FROM raw),
        ends AS (SELECT doc_id, min(i) AS last FROM every WHERE k = {n - 2} GROUP BY doc_id),
        s AS (SELECT every.* FROM every LEFT JOIN ends ON every.doc_id = ends.doc_id WHERE last IS NULL OR i <= last),
        walk AS (SELECT doc_id, 0::BIGINT AS i, 0 AS v0, 0 AS v1, 0 AS v2, 7 AS v3, 7 AS v4, 7 AS da, 0 AS db, -1 AS k, 0 AS given FROM (SELECT DISTINCT doc_id FROM s) UNION ALL
            SELECT doc_id, i, {sets}, CASE WHEN k = 3 THEN vb ELSE da END, CASE WHEN k = 4 THEN vb ELSE db END, k, CASE WHEN k = 16 THEN da ELSE vb END FROM (SELECT *, {new} AS na FROM
            (SELECT s.doc_id, s.i, s.k, a, b, c, v0, v1, v2, v3, v4, da, db, {pick('a')} AS va, {pick('b')} AS vb, {pick('c')} AS vc FROM walk JOIN s ON s.doc_id = walk.doc_id AND s.i = walk.i + 1)))
        SELECT {_PATH}, CASE WHEN k < 14 THEN 'path' WHEN k < 16 THEN 'command' ELSE 'deserialization' END AS family, i + {CHECK_HEAD} AS line, given & CASE WHEN k < 14 THEN 1 WHEN k < 16 THEN 2 ELSE 4 END = 0 AS keep FROM walk WHERE k BETWEEN 12 AND 16"""


@query("g23_false_positives", sql=_checks())
def g23f(spark, d):
    """Path, command and deserialization sinks that may be given something harmful, by values of names and places."""
    return filters.false_positives(checked(spark, d))


# --- script files: JavaScript, Java or PHP by the document's language, each line of it a statement over two lines

SCRIPT = (
    "{a} =\n  SRC;", "{a} =\n  SRC;", "{a} =\n  {b};", "{a} =\n  {b};", "{a} = escape(\n  {b});", "SINK(\n  {b});", "SINK(\n  {b});", "{a} =\n  'x';", "if (ok({b})) {\n  {a} = {c}; }", "{a} ADD\n  {b};", "if (bad({b})) {\n  return; }", "SINK({c} +\n  escape({b}));", "/* SINK({b});\n */",
)
#: By language: suffix, first line, what marks a variable, source, sink, append and join.
KINDS = {"en": ("js", "// a", "v", "req.query.a", "db.run", "+=", "+"), "de": ("js", "// a", "v", "req.query.a", "db.run", "+=", "+"), "es": ("java", "// a", "v", 'request.getParameter("a")', "executeQuery", "+=", "+"), "fr": ("php", "<?php", "$v", "$_GET['a']", "system", ".=", ".")}


def script_files(spark, d):
    """path, content: a script for each document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang")).filter(F.col("lang").isin(*KINDS))
    of = lambda n: F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[n])]), F.col("lang"))

    def line(x: Column) -> Column:
        n, first, count = x["n"], x["first"], x["count"]
        out = F.element_at(F.array(*[F.lit(t) for t in SCRIPT]), (n + count * 3 + first) % len(SCRIPT) + 1)
        out = F.replace(F.replace(F.replace(F.replace(out, F.lit("SRC"), of(3)), F.lit("SINK"), of(4)), F.lit("ADD"), of(5)), F.lit(" +\n"), F.concat(F.lit(" "), of(6), F.lit("\n")))
        for name, v in (("{a}", n % 5), ("{b}", first % 5), ("{c}", count % 5)):
            out = F.replace(out, F.lit(name), F.concat(of(2), v.cast("string")))
        return out

    body = F.array_join(F.transform(measures(F.col("text")), lambda x: line(x)), "\n")
    return docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), of(0)).alias("path"), F.concat_ws("\n", of(1), body).alias("content"))


@query("g20_script_taint", sql=f"""WITH RECURSIVE lines AS (SELECT doc_id, lang, CAST(i AS BIGINT) AS i, l[i] AS line FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS l, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents WHERE lang IN ('en', 'de', 'es', 'fr'))),
    raw AS (SELECT doc_id, i, length(line) AS n, length(string_split(line, ' ')[1]) AS f, len(string_split(line, ' ')) AS w FROM lines),
    s AS (SELECT doc_id, i, (n + w * 3 + f) % {len(SCRIPT)} AS k, n % 5 AS a, f % 5 AS b, w % 5 AS c FROM raw),
    defs AS (SELECT doc_id, i, a AS v, k NOT IN (8, 9) AS kills FROM s WHERE k IN (0, 1, 2, 3, 4, 7, 8, 9)),
    moves AS (SELECT doc_id, i, b AS v, a AS dst, CASE k WHEN 4 THEN 1 ELSE 0 END AS clean FROM s WHERE k IN (2, 3, 4, 9) UNION ALL SELECT doc_id, i, c, a, 0 FROM s WHERE k = 8 UNION ALL SELECT doc_id, i, b, NULL, 0 FROM s WHERE k IN (5, 6) UNION ALL SELECT doc_id, i, c, NULL, 0 FROM s WHERE k = 11 UNION ALL SELECT doc_id, i, b, NULL, 1 FROM s WHERE k = 11),
    since AS (SELECT m.doc_id, m.i, m.v, m.dst, m.clean, coalesce(max(d.i), 0) AS first FROM moves m LEFT JOIN defs d ON d.doc_id = m.doc_id AND d.v = m.v AND d.i < m.i AND d.kills GROUP BY ALL),
    e AS (SELECT m.doc_id, d.i AS src, m.v, m.i, m.dst, m.clean FROM since m JOIN defs d ON d.doc_id = m.doc_id AND d.v = m.v AND d.i < m.i AND d.i >= m.first),
    t AS (SELECT doc_id, i, a AS v, i AS origin, 0 AS clean FROM s WHERE k < 2 UNION SELECT e.doc_id, e.i, e.dst, t.origin, greatest(t.clean, e.clean) FROM t JOIN e ON e.doc_id = t.doc_id AND e.src = t.i AND e.v = t.v WHERE e.dst IS NOT NULL),
    hits AS (SELECT e.doc_id, t.origin, e.i, e.v, greatest(t.clean, e.clean) AS clean FROM t JOIN e ON e.doc_id = t.doc_id AND e.src = t.i AND e.v = t.v WHERE e.dst IS NULL),
    used AS (SELECT DISTINCT doc_id, i, v FROM hits),
    kept AS (SELECT u.doc_id, u.i, u.v, coalesce(max(g.i), 0) AS g FROM used u LEFT JOIN s g ON g.doc_id = u.doc_id AND g.k = 10 AND g.b = u.v AND g.i < u.i GROUP BY ALL),
    wrote AS (SELECT u.doc_id, u.i, u.v, coalesce(max(d.i), 0) AS w FROM used u LEFT JOIN defs d ON d.doc_id = u.doc_id AND d.v = u.v AND d.i < u.i GROUP BY ALL),
    guard AS (SELECT kept.doc_id, kept.i, bool_and(g > w) AS guarded FROM kept JOIN wrote ON wrote.doc_id = kept.doc_id AND wrote.i = kept.i AND wrote.v = kept.v GROUP BY ALL)
    SELECT 'f' || h.doc_id || CASE d.lang WHEN 'es' THEN '.java' WHEN 'fr' THEN '.php' ELSE '.js' END AS path, 2 * origin + 1 AS source_line, 2 * h.i AS sink_line, min(clean) = 1 AS sanitized, guarded FROM hits h JOIN guard g ON g.doc_id = h.doc_id AND g.i = h.i JOIN documents d ON d.doc_id = h.doc_id GROUP BY ALL""")
def g20(spark, d):
    """Flows of scripts whose statements run over two lines, cleaned, and guarded by tests that left."""
    return scripts.script_taint(script_files(spark, d), ("req.query", "request.getParameter", "$_GET"), ("db.run", "executeQuery", "system"), ("escape",))


@query("sf_code_rows", sql=f"""WITH RECURSIVE {_PORTS}, py AS (SELECT 'm' || doc_id || '.py' AS path, 'python' AS language, count(*) AS n_calls FROM s WHERE k NOT IN (2, 3, 9, 14, 15, 16) GROUP BY doc_id),
    n AS (SELECT d.doc_id, lang, (x.n + x.w * 3 + x.f) % {len(SCRIPT)} AS k FROM raw x JOIN documents d ON d.doc_id = x.doc_id WHERE lang IN ('en', 'de', 'es', 'fr')),
    js AS (SELECT 'f' || doc_id || CASE lang WHEN 'es' THEN '.java' WHEN 'fr' THEN '.php' ELSE '.js' END AS path, CASE lang WHEN 'es' THEN 'java' WHEN 'fr' THEN 'php' ELSE 'javascript' END AS language, CAST(sum(CASE WHEN k IN (0, 1) THEN CASE lang WHEN 'es' THEN 1 ELSE 0 END WHEN k IN (4, 5, 6, 8, 10) THEN 1 WHEN k = 11 THEN 2 ELSE 0 END) AS BIGINT) AS n_calls FROM n GROUP BY doc_id, lang)
    SELECT * FROM py UNION ALL SELECT * FROM js WHERE n_calls > 0""")
def code_rows(spark, d):
    """Calls in files of four languages, by one table function."""
    plugins.register(spark)
    modules(spark, d).unionByName(script_files(spark, d)).createOrReplaceTempView("code_files")
    return spark.sql("SELECT path, language, count(*) AS n_calls FROM code_rows(TABLE(code_files), 'calls') GROUP BY path, language")


@query("k2_thread_flows", sql=_CROSS.format(depth=5) + f" SELECT 'm' || source || '.py' AS source_path, line + {MODULE_HEAD} AS source_line, 'm' || sunk || '.py' AS sink_path, i + {MODULE_HEAD} AS sink_line, x % 100 + 2 AS n_locations, 'm' || source || '.py' || ':' || (line + {MODULE_HEAD}) AS first, 'sink ' || e AS last FROM best")
def k2t(spark, d):
    """Code flows of the report: from the source through the calls to the sink."""
    found = reports.thread_flows(crossfile.cross_file(modules(spark, d)))
    at = lambda path: F.get_json_object("code_flow", "$.threadFlows[0].locations" + path)
    first = F.concat_ws(":", at("[0].location.physicalLocation.artifactLocation.uri"), at("[0].location.physicalLocation.region.startLine"))
    last = F.call_function("get_json_object", F.col("code_flow"), F.concat(F.lit("$.threadFlows[0].locations["), (F.col("n_locations") - 1).cast("string"), F.lit("].location.message.text")))
    return found.select("source_path", "source_line", "sink_path", "sink_line", "n_locations", first.alias("first"), last.alias("last"))

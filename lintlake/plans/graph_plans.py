"""Queries of the graph operators. Pages link to pages, turns follow turns, parts occur together in orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import graphs as ops
from lintlake.plans.base import findings, query
from lintlake.session import spread, table

#: A graph on all orders, of the same shape at any size: each calls two with smaller keys; the smallest call themselves.
_EDGES = "e AS (SELECT o_orderkey AS src, o_orderkey // 7 AS dst FROM orders UNION SELECT o_orderkey, o_orderkey // 5 + 1 FROM orders)"


def _edges(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"))
    return o.select("src", F.explode(F.array(F.floor(F.col("src") / 7), F.floor(F.col("src") / 5) + 1)).alias("dst")).distinct()


def _levels(depth: int, start: str, edge: str = "e", a: str = "src", b: str = "dst") -> str:
    """Depth-bounded closure with each node at its first level."""
    return f"r AS (SELECT node, 0 AS level FROM ({start}) UNION ALL SELECT {edge}.{b}, level + 1 FROM r JOIN {edge} ON {edge}.{a} = r.node WHERE level < {depth})"


@query("g9_backward_slice", sql=f"WITH RECURSIVE {_EDGES}, {_levels(5, 'SELECT 42::BIGINT AS node UNION ALL SELECT 77::BIGINT', a='dst', b='src')} SELECT node, min(level) AS level FROM r GROUP BY node")
def g9(spark, d):
    start = spark.sql("SELECT CAST(x AS BIGINT) AS node FROM VALUES (42), (77) AS t(x)")
    return ops.closure(start, ops.reverse(_edges(spark, d)), 5)


@query("g10_path_to_node", sql=f"WITH RECURSIVE {_EDGES}, {_levels(12, 'SELECT 5::BIGINT AS node', a='dst', b='src')} SELECT node, min(level) AS level FROM r GROUP BY node")
def g10(spark, d):
    start = spark.sql("SELECT CAST(5 AS BIGINT) AS node")
    return ops.closure(start, ops.reverse(_edges(spark, d)), 12)


@query("g17_reach_of_orders", sql=f"WITH RECURSIVE {_EDGES}, {_levels(5, 'SELECT o_orderkey AS node FROM orders WHERE o_orderpriority LIKE \'1-%\'')} SELECT node, min(level) AS level, CASE WHEN node % 4 = 0 THEN 'SUPPRESSED' ELSE 'CONFIRMED' END AS status FROM r GROUP BY node")
def g17(spark, d):
    """What tainted functions (urgent orders) reach along calls in at most five hops; a sanitizer there (every fourth) suppresses."""
    start = table(spark, d, "orders").filter("o_orderpriority LIKE '1-%'").select(F.col("o_orderkey").alias("node"))
    return ops.closure(start, _edges(spark, d), 5).withColumn("status", F.when(F.col("node") % 4 == 0, "SUPPRESSED").otherwise("CONFIRMED"))


@query("g5_function_summaries", sql="WITH RECURSIVE dfg AS (SELECT conv_id AS function, turn AS src, turn + 1 AS dst FROM conversations WHERE turn % 4 <> 2), r AS (SELECT conv_id AS function, max(turn) AS node, 0 AS level FROM conversations GROUP BY conv_id UNION ALL SELECT r.function, dfg.src, level + 1 FROM r JOIN dfg ON dfg.function = r.function AND dfg.dst = r.node WHERE level < 12) SELECT DISTINCT p.conv_id AS function, 'p' || p.turn AS param FROM conversations p JOIN r ON r.function = p.conv_id AND r.node = p.turn WHERE p.role = 'user'")
def g5(spark, d):
    c = table(spark, d, "conversations")
    dfg = c.filter("turn % 4 <> 2").select(F.col("conv_id").alias("function"), F.col("turn").alias("src"), (F.col("turn") + 1).alias("dst"))
    params = c.filter("role = 'user'").select(F.col("conv_id").alias("function"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("param"), F.col("turn").alias("node"))
    returns = c.groupBy(F.col("conv_id").alias("function")).agg(F.max("turn").alias("node"))
    return ops.summaries(params, returns, dfg, 12)


@query("a21_import_hubs", sql="WITH e AS (SELECT DISTINCT page_id AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS dst FROM pages), n AS (SELECT CAST(src AS VARCHAR) AS node, NULL AS i, dst AS o FROM e UNION ALL SELECT dst, CAST(src AS VARCHAR), NULL FROM e) SELECT node, count(DISTINCT i) AS n_in, count(DISTINCT o) AS n_out FROM n GROUP BY node ORDER BY n_in DESC, n_out DESC, node LIMIT 50")
def a21(spark, d):
    e = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("dst"))
    return ops.degrees(e).orderBy(F.desc("n_in"), F.desc("n_out"), "node").limit(50)


@query("j7_resolve_calls", sql="WITH c AS (SELECT l_orderkey AS file, 'fn' || (l_partkey % 50) AS callee, count(*) AS n FROM lineitem GROUP BY ALL), i AS (SELECT DISTINCT o_orderkey AS file, 'fn' || (o_custkey % 50) AS name, 'imp' || (o_orderkey % 9) AS target_file FROM orders), g AS (SELECT 'fn' || (p_partkey % 40) AS name, arg_min('f' || p_partkey, p_partkey) AS first FROM part GROUP BY 1) SELECT c.file, c.callee, n, coalesce(target_file, first) AS target FROM c LEFT JOIN i ON i.file = c.file AND i.name = c.callee LEFT JOIN g ON g.name = c.callee")
def j7(spark, d):
    fn = lambda c, m: F.concat(F.lit("fn"), (F.col(c) % m).cast("string"))
    calls = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), fn("l_partkey", 50).alias("callee")).agg(F.count("*").alias("n"))
    imports = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), fn("o_custkey", 50).alias("name"), F.concat(F.lit("imp"), (F.col("o_orderkey") % 9).cast("string")).alias("target_file")).distinct()
    functions = table(spark, d, "part").select(fn("p_partkey", 40).alias("name"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_partkey").alias("ordinal"))
    return ops.resolve_calls(calls, imports, functions)


@query("j8_bind_arguments", sql="WITH c AS (SELECT o_orderkey AS call_id, 'fn' || (o_custkey % 5) AS callee, list_slice(['a', 'b', 'c', 'd'], 1, 1 + o_orderkey % 4) AS args FROM orders), f AS (SELECT 'fn' || i AS callee, list_slice(['p', 'q', 'r'], 1, 1 + i % 3) AS params FROM range(4) t(i)), a AS (SELECT call_id, callee, unnest(args) AS argument, generate_subscripts(args, 1) AS pos FROM c) SELECT call_id, argument, unnest(CASE WHEN pos <= len(params) THEN [params[pos]] ELSE params END) AS param FROM a JOIN f USING (callee)")
def j8(spark, d):
    o = table(spark, d, "orders")
    calls = o.select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("fn"), (F.col("o_custkey") % 5).cast("string")).alias("callee"), F.slice(F.array(*[F.lit(x) for x in "abcd"]), F.lit(1), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("arguments"))
    functions = spark.range(4).select(F.concat(F.lit("fn"), F.col("id").cast("string")).alias("callee"), F.slice(F.array(*[F.lit(x) for x in "pqr"]), F.lit(1), (F.col("id") % 3 + 1).cast("int")).alias("params"))
    return ops.bind_arguments(calls, functions)


@query("j9_import_resolution", sql="WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/?([A-Za-z0-9_/-]+)', 1)) AS module FROM pages), f AS (SELECT 'p' || page_id || '.py' AS path FROM pages) SELECT page_id, module, CASE WHEN EXISTS (SELECT 1 FROM f WHERE path = module || '.py') THEN module || '.py' WHEN EXISTS (SELECT 1 FROM f WHERE path = module || '/__init__.py') THEN module || '/__init__.py' END AS target, count(*) AS n FROM i GROUP BY ALL")
def j9(spark, d):
    """Imports to files: `X.py`, else `X/__init__.py`, by two left joins on candidate paths."""
    pages = table(spark, d, "pages")
    i = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/?([A-Za-z0-9_/-]+)'), 1)).alias("module")).groupBy("page_id", "module").agg(F.count("*").alias("n"))
    f = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".py")).alias("path")).distinct()
    a, b = f.withColumnRenamed("path", "_a"), f.withColumnRenamed("path", "_b")
    out = i.join(a, F.concat("module", F.lit(".py")) == F.col("_a"), "left").join(b, F.concat("module", F.lit("/__init__.py")) == F.col("_b"), "left")
    return out.select("page_id", "module", F.coalesce("_a", "_b").alias("target"), "n")


@query("j17_callers_of", sql="SELECT 'fn' || (l_partkey % 20) AS callee, 'c' || (l_suppkey % 30) AS caller, min(l_orderkey) AS first_site FROM lineitem GROUP BY ALL")
def j17(spark, d):
    l = table(spark, d, "lineitem")
    return l.groupBy(F.concat(F.lit("fn"), (F.col("l_partkey") % 20).cast("string")).alias("callee"), F.concat(F.lit("c"), (F.col("l_suppkey") % 30).cast("string")).alias("caller")).agg(F.min("l_orderkey").alias("first_site"))


@query("g12_enclosing_node", findings_sql="SELECT doc_id AS file, line_number AS line, arg_min(node, (prio, node)) AS node FROM (SELECT DISTINCT doc_id, line_number FROM f) JOIN (VALUES (0, 0), (1, -1), (2, -2), (3, -3), (4, 1)) AS o(prio, off) ON true JOIN (SELECT doc_id, line_number AS at, 'n' || line_number AS node FROM lines WHERE line_number % 4 = 1) n USING (doc_id) WHERE n.at = line_number + off GROUP BY ALL")
def g12(spark, d):
    from lintlake.plans.base import lines

    nodes = lines(spark, d).filter("line_number % 4 = 1").select(F.col("doc_id").alias("file"), F.col("line_number").alias("line"), F.concat(F.lit("n"), F.col("line_number").cast("string")).alias("node"))
    want = findings(spark, d).select(F.col("doc_id").alias("file"), F.col("line_number").alias("line")).distinct()
    return ops.enclosing(want, nodes)


@query("g13_early_return_guards", findings_sql="SELECT finding_id FROM f WHERE EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = f.doc_id AND l.line_number < f.line_number AND l.line_number % 3 = 0 AND ('v' || (l.line_number % 7)) = f.variable)")
def g13(spark, d):
    from lintlake.plans.base import lines

    sinks = findings(spark, d).select("finding_id", F.col("doc_id").alias("scope"), F.col("line_number").alias("line"), F.array_compact(F.array("variable")).alias("vars"))
    guards = lines(spark, d).filter("line_number % 3 = 0").select(F.col("doc_id").alias("scope"), F.col("line_number").alias("guard_line"), F.array(F.concat(F.lit("v"), (F.col("line_number") % 7).cast("string"))).alias("tested"))
    return ops.guarded(sinks, guards).select("finding_id")


@query("g13_constant_symbols", findings_sql="SELECT file_path, variable, bool_and(k % 3 > 0) AS is_constant FROM f WHERE variable IS NOT NULL GROUP BY ALL")
def g13c(spark, d):
    """A symbol is constant only if every assignment of it is literal."""
    return findings(spark, d).filter("variable IS NOT NULL").groupBy("file_path", "variable").agg(F.bool_and(F.col("k") % 3 > 0).alias("is_constant"))


@query("g15_callee_return_taint", findings_sql="SELECT finding_id FROM f JOIN (VALUES ('subprocess.run', ['v0', 'v1']), ('cursor.execute', ['v2', 'v3', 'v4'])) AS s(callee, deps) ON callee = sink_function WHERE list_contains(deps, variable)")
def g15(spark, d):
    s = spark.sql("SELECT * FROM VALUES ('subprocess.run', array('v0', 'v1')), ('cursor.execute', array('v2', 'v3', 'v4')) AS s(callee, deps)")
    f = findings(spark, d)
    return f.join(F.broadcast(s), (F.col("callee") == F.col("sink_function")) & F.array_contains("deps", F.col("variable"))).select("finding_id")


@query("g19_scope_sanitizers", findings_sql="SELECT finding_id FROM f WHERE EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = f.doc_id AND (contains(l.line, 'License') OR contains(l.line, ' | ')))")
def g19(spark, d):
    """Findings whose scope has a sanitizer anywhere: the scope test is made once for each file, then semi-joined."""
    docs = table(spark, d, "documents").filter(F.col("text").contains("License") | F.col("text").contains(" | ")).select("doc_id")
    return findings(spark, d).join(docs, "doc_id", "left_semi").select("finding_id")


@query("g21_lines_between", findings_sql="SELECT a.finding_id AS source_id, b.finding_id AS sink_id, EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = a.doc_id AND l.line_number > a.line_number AND l.line_number < b.line_number AND l.line_number % 5 = 0) AS sanitized FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.line_number < b.line_number AND a.rule_id = 'SEC-2' AND b.rule_id <> 'SEC-2'")
def g21(spark, d):
    f = findings(spark, d).select("finding_id", "doc_id", "line_number", "rule_id")
    a = f.filter("rule_id = 'SEC-2'").select(F.col("finding_id").alias("source_id"), "doc_id", F.col("line_number").alias("la"))
    b = f.filter("rule_id <> 'SEC-2'").select(F.col("finding_id").alias("sink_id"), "doc_id", F.col("line_number").alias("lb"))
    # the first sanitizer line after la is the next multiple of five: no join with the lines is needed
    return a.join(b, "doc_id").filter("la < lb").select("source_id", "sink_id", ((F.floor(F.col("la") / 5) + 1) * 5 < F.col("lb")).alias("sanitized"))


@query("g8_sink_arguments", findings_sql="SELECT finding_id, CASE sink_function WHEN 'subprocess.run' THEN 'a0' WHEN 'open' THEN 'a0' ELSE 'a0,a1' END AS relevant FROM f")
def g8(spark, d):
    args = F.array(F.lit("a0"), F.lit("a1"))
    one = F.col("sink_function").startswith("subprocess.") | F.col("sink_function").isin("os.system", "eval", "exec", "open")
    return findings(spark, d).select("finding_id", F.when(one, F.element_at(args, 1)).otherwise(F.array_join(args, ",")).alias("relevant"))


@query("g11_variable_slice", sql="SELECT conv_id, count(*) AS n FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE contains(lower(text), 'the')) WHERE n <= 25 GROUP BY conv_id")
def g11(spark, d):
    """Lines of a scope that mention a variable, the first 25 in order."""
    from pyspark.sql import Window

    c = table(spark, d, "conversations").filter(F.lower("text").contains("the"))
    return c.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("_n <= 25").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("g11_growing_slice")
def g11s(spark, d):
    """The slices of 'the' in both directions over whole conversations, a turn writing its first word: the slice that g11_variable_slice has no names for."""
    words = F.split(F.lower("text"), " ")
    c = table(spark, d, "conversations").select("conv_id", "turn", words.alias("reads"), F.array(F.element_at(words, 1)).alias("writes"))
    both = [ops.variable_slice(c, "conv_id", "turn", "the", forward).withColumn("forward", F.lit(forward)) for forward in (False, True)]
    return both[0].unionByName(both[1])


@query("g22_linear_taint")
def g22(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("reads"), F.element_at(F.split(F.lower("text"), " "), 1).alias("writes"), (F.col("turn") == 0).alias("is_source"), (F.col("role") == "assistant").alias("sink"))
    return ops.taint_fold(c, "conv_id", "turn", "is_source")


@query("a20_module_summary", sql="WITH d AS (SELECT source AS module, doc_id AS path, lang AS language, len(string_split(text, chr(10))) AS n_lines FROM documents), l AS (SELECT module, string_agg(language, ',' ORDER BY c DESC, language) AS languages FROM (SELECT module, language, count(*) AS c FROM d GROUP BY ALL) GROUP BY module) SELECT module, count(*) AS n_files, CAST(sum(n_lines) AS BIGINT) AS n_lines, any_value(languages) AS languages, arg_max(path, (n_lines, path)) AS largest FROM d JOIN l USING (module) GROUP BY module")
def a20(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("module"), F.col("doc_id").alias("path"), F.col("lang").alias("language"), F.size(F.split("text", "\n", -1)).alias("n_lines"))
    return ops.module_summary(docs)


@query("a22_flow_summary", sql="WITH e AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) SELECT role AS kind, count(*) AS n_nodes, count(nxt) AS n_edges, count(*) FILTER (WHERE nxt = role) AS n_same FROM e GROUP BY role")
def a22(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "conversations").withColumn("nxt", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return e.groupBy(F.col("role").alias("kind")).agg(F.count("*").alias("n_nodes"), F.count("nxt").alias("n_edges"), F.count_if(F.col("nxt") == F.col("role")).alias("n_same"))

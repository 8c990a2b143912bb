"""Graph operators on edge tables: bounded closures, slices, degrees, resolution of calls and imports.

Edge tables have file (or group), src, dst. Closures are level by level: each level is one join with the edges and an
anti-join with what is seen, so a node is expanded once however many paths lead to it, and cycles end. Each level is
written to the shared folder, so none is computed twice and lineage stays short however deep the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import written


def closure(start: DataFrame, edges: DataFrame, depth: int, key: tuple[str, ...] = (), stop: Column | None = None) -> DataFrame:
    """Nodes reached from start (key..., node) along edges (key..., src, dst) in at most `depth` steps: key..., node, level (0 for the start). stop: condition on a node, beyond which it is not expanded."""
    on = list(key)
    seen = written(start.select(*on, "node").distinct().withColumn("level", F.lit(0)), "closure")
    front = seen
    for level in range(1, depth + 1):
        grow = front if stop is None else front.filter(~stop)
        step = grow.select(*on, F.col("node").alias("src")).join(edges.select(*on, "src", "dst"), [*on, "src"]).select(*on, F.col("dst").alias("node")).distinct()
        front = written(step.join(seen.select(*on, "node"), [*on, "node"], "left_anti").withColumn("level", F.lit(level)), "closure")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumn("_s", F.col("src")).withColumn("src", F.col("dst")).withColumn("dst", F.col("_s")).drop("_s")


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out: distinct neighbours, nodes without any left out. Both directions are counted in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.col("src").alias("i"), F.lit(None).cast(edges.schema["dst"].dataType).alias("o")), F.struct(F.col("src").alias("node"), F.lit(None).cast(edges.schema["src"].dataType).alias("i"), F.col("dst").alias("o")))).alias("x")).select("x.*").distinct()
    return ends.groupBy("node").agg(F.count("i").alias("n_in"), F.count("o").alias("n_out"))


def summaries(params: DataFrame, returns: DataFrame, dfg: DataFrame, depth: int) -> DataFrame:
    """function, param: parameters that reach a return of their function backward along data-flow edges. params: function, param, node; returns: function, node."""
    back = closure(returns.withColumnRenamed("function", "key"), reverse(dfg).withColumnRenamed("function", "key"), depth, ("key",))
    hit = back.select(F.col("key").alias("function"), "node")
    return params.join(hit, ["function", "node"]).select("function", "param").distinct()


def resolve_calls(calls: DataFrame, imports: DataFrame, functions: DataFrame) -> DataFrame:
    """Target file of each call (file, callee): the file's import of the name wins over the global index; the index has the first definition. Unknown names stay with null."""
    local = imports.select("file", F.col("name").alias("callee"), F.col("target_file").alias("_i"))
    index = functions.groupBy(F.col("name").alias("callee")).agg(F.min_by("file", "ordinal").alias("_g"))
    return calls.join(local, ["file", "callee"], "left").join(index, "callee", "left").withColumn("target", F.coalesce("_i", "_g")).drop("_i", "_g")


def bind_arguments(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Arguments with the parameters they go to, by position; an argument beyond them goes to all. calls: call_id, callee, arguments; functions: callee, params."""
    a = calls.select("call_id", "callee", F.posexplode("arguments").alias("pos", "argument"))
    return a.join(functions, "callee").select("call_id", "argument", F.explode(F.when(F.col("pos") < F.size("params"), F.slice("params", F.col("pos") + 1, F.lit(1))).otherwise(F.col("params"))).alias("param"))


def enclosing(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each line the node that starts on it, else one, two, three lines above, else one below: file, line, node."""
    order = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(o).alias("off")) for i, o in enumerate((0, -1, -2, -3, 1))])
    want = lines.select("file", "line", F.explode(order).alias("x")).select("file", "line", "x.prio", (F.col("line") + F.col("x.off")).alias("at"))
    hit = want.join(nodes.select("file", F.col("line").alias("at"), "node"), ["file", "at"])
    return hit.groupBy("file", "line").agg(F.min_by("node", F.struct("prio", "node")).alias("node"))


def guarded(sinks: DataFrame, guards: DataFrame) -> DataFrame:
    """Sinks with an early-return guard before them in the same scope that tests one of their variables. sinks: scope, line, vars; guards: scope, guard_line, tested."""
    g = guards.withColumnRenamed("scope", "_g")
    on = (sinks["scope"] == g["_g"]) & (g["guard_line"] < sinks["line"]) & F.arrays_overlap(g["tested"], sinks["vars"])
    return sinks.join(g, on, "left_semi")


def taint_fold(statements: DataFrame, group: str, order: str, source: str) -> DataFrame:
    """Linear taint over each group's statements in order: `source` marks where taint starts; it reaches every later statement that reads a tainted word, whose written word becomes tainted; nothing is ever killed. statements: group, order, reads (array), writes, source (boolean), sink (boolean). A fold over the ordered array within a row: groups are files, of bounded size."""
    rows = statements.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "reads", "writes", source, "sink"))).alias("_s"))
    start = F.struct(F.array().cast("array<string>").alias("t"), F.array().cast("array<long>").alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        read = F.arrays_overlap(acc["t"], x["reads"])
        hot = F.coalesce(read, F.lit(False)) | x[source]
        return F.struct(F.when(hot, F.array_union(acc["t"], F.array(x["writes"]))).otherwise(acc["t"]).alias("t"), F.when(F.coalesce(read, F.lit(False)) & x["sink"], F.concat(acc["hits"], F.array(x[order].cast("long")))).otherwise(acc["hits"]).alias("hits"))

    return rows.select(group, F.aggregate("_s", start, step).alias("_r")).select(group, F.size("_r.t").alias("n_tainted"), F.size("_r.hits").alias("n_hits"))


def variable_slice(statements: DataFrame, group: str, order: str, variable: str, forward: bool, listed: int = 25) -> DataFrame:
    """group, variables, slice, statement_count: each group's statements scanned in order from one wanted name. Backward a statement that writes a wanted name joins the slice and its reads become wanted; forward one that reads a wanted name joins and its writes become wanted. statement_count counts them all; slice lists the order values of the last `listed` (forward the first). statements: group, order, reads, writes (arrays). A fold over the ordered array within a row: groups are files, of bounded size."""
    rows = statements.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "reads", "writes"))).alias("_s"))
    meets, grows = ("reads", "writes") if forward else ("writes", "reads")
    start = F.struct(F.array(F.lit(variable)).alias("v"), F.array().cast("array<long>").alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.coalesce(F.arrays_overlap(acc["v"], x[meets]), F.lit(False))
        wanted = F.array_union(acc["v"], F.array_compact(F.coalesce(x[grows], F.array().cast("array<string>"))))
        return F.struct(F.when(hit, wanted).otherwise(acc["v"]).alias("v"), F.when(hit, F.concat(acc["hits"], F.array(x[order].cast("long")))).otherwise(acc["hits"]).alias("hits"))

    n = F.size("_r.hits")
    first = F.lit(1) if forward else F.greatest(n - listed + 1, F.lit(1))
    return rows.select(group, F.aggregate("_s", start, step).alias("_r")).select(group, F.array_sort("_r.v").alias("variables"), F.slice("_r.hits", first, F.lit(listed)).alias("slice"), n.cast("long").alias("statement_count"))


def module_summary(files: DataFrame) -> DataFrame:
    """By module: files, lines, languages by (-count, name), and its largest file (by lines, then path). files: module, path, language, n_lines."""
    per = files.groupBy("module", "language").agg(F.count("*").alias("c"), F.sum("n_lines").alias("l"), F.max(F.struct("n_lines", "path")).alias("m"))
    langs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("n"), "language"))), lambda x: x["language"]), ",")
    return per.groupBy("module").agg(F.sum("c").alias("n_files"), F.sum("l").alias("n_lines"), langs.alias("languages"), F.max("m").alias("_m")).select("module", "n_files", "n_lines", "languages", F.col("_m.path").alias("largest"))


def latest_round(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")

"""Taint across files: what reaches what within functions, joined over calls, imports and arguments.

A file gives its ports in one narrow pass (a value of a parameter, a source or a call's result that gets to a sink, an
argument or the result), its functions, and its calls with the files that their names may be imported from. All else is
joins on these tables: calls to functions, arguments to parameters, and a fixpoint of summaries (a parameter reaches a
sink, cleaned by what) that grows backward from the sinks, level by level, each level joined with the new summaries only.
Sources are joined last, so the fixpoint's size does not grow with them.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.graph.flow import B, L, S, _map, _safely
from lintlake.graph.program import Flow, Taint, dotted
from lintlake.session import written

# Sources, sinks with the types they stand for, and sanitizers with the types they mitigate (none: no type alone, all numeric conversions).
SOURCES = (
    "request.args.get", "request.args[", "request.form.get", "request.form[", "request.values.get", "request.values[", "request.GET.get", "request.GET[", "request.POST.get", "request.POST[",
    "request.data", "request.json", "request.get_json", "flask.request.args", "flask.request.form", "sys.argv", "os.environ.get", "os.environ[", "input(",
)
SINKS = {
    "os.system": "COMMAND_INJECTION", "os.popen": "COMMAND_INJECTION", "subprocess.run": "COMMAND_INJECTION", "subprocess.call": "COMMAND_INJECTION", "subprocess.Popen": "COMMAND_INJECTION", "os.exec": "COMMAND_INJECTION",
    "eval": "CODE_INJECTION", "exec": "CODE_INJECTION", "compile": "CODE_INJECTION", "execute": "SQL_INJECTION", "executemany": "SQL_INJECTION", "raw": "SQL_INJECTION", "text": "SQL_INJECTION",
    "open": "PATH_TRAVERSAL", "send_file": "PATH_TRAVERSAL", "os.remove": "PATH_TRAVERSAL", "pickle.loads": "INSECURE_DESERIALIZATION", "pickle.load": "INSECURE_DESERIALIZATION", "yaml.load": "INSECURE_DESERIALIZATION",
    "requests.get": "SSRF", "requests.post": "SSRF", "urllib.request.urlopen": "SSRF",
}
SANITIZERS = {
    "shlex.quote": ("COMMAND_INJECTION",), "quote": ("COMMAND_INJECTION",), "os.path.basename": ("PATH_TRAVERSAL",), "basename": ("PATH_TRAVERSAL",), "os.path.abspath": ("PATH_TRAVERSAL",),
    "int": (), "float": (), "html.escape": ("XSS",), "yaml.safe_load": ("INSECURE_DESERIALIZATION",),
}
SEVERE = ("COMMAND_INJECTION", "CODE_INJECTION", "SQL_INJECTION")
CONFIDENCE = 0.92
DEPTH = 5


def bits(sinks: dict[str, str], sanitizers: dict[str, tuple[str, ...]]) -> tuple[dict[str, int], dict[str, int]]:
    """A bit for each type, and each sanitizer's bits. One that names no type mitigates none (its use is still told apart)."""
    types = sorted({*sinks.values(), *(t for ts in sanitizers.values() for t in ts)})
    bit = {t: 1 << i for i, t in enumerate(types)}
    return bit, {name: sum(bit[t] for t in ts) or 1 << len(types) for name, ts in sanitizers.items()}


def candidates(path: str, full: str) -> list[tuple[str, str]]:
    """Files and names that a full dotted name may mean, seen from the file at path; leading dots go up from its folder. The longest module first, a module's file before its package."""
    dots = len(full) - len(full.lstrip("."))
    base = posixpath.dirname(path)
    for _ in range(dots - 1):
        base = posixpath.dirname(base)
    parts = full[dots:].split(".")
    out = []
    for k in range(len(parts) - 1, 0 if not dots else -1, -1):
        module, name = "/".join(parts[:k]), ".".join(parts[k:])
        roots = [base] if dots else ["", base]
        for root in dict.fromkeys(roots):
            stem = posixpath.join(root, module) if module else root
            out += [(f"{stem}.py", name)] if module else []
            out.append((posixpath.join(stem, "__init__.py"), name))
    return list(dict.fromkeys(out))


FUNCTION = {"path": S, "name": S, "line": L, "id": L, "params": S, "star": S, "stars": S, "method": B}
CALL = {"path": S, "caller": S, "callee": S, "line": L, "bare": B, "rank": L, "to_path": S, "to_name": S}


def _function_rows(p: str, g: Flow) -> list[tuple]:
    return [(p, f.name, f.line, f.id, ",".join(f.params), f.star, f.stars, f.method) for f in g.functions]


def _call_rows(p: str, g: Flow) -> list[tuple]:
    out: dict[tuple, None] = {}
    full: dict[str, list[str]] = {}
    for i, calls in g.calls.items():
        n = g.nodes[i]
        caller = "<module>" if n.function < 0 else g.functions[n.function].name
        for c in calls:
            callee = dotted(c.func)
            if not callee:
                continue
            head = callee.split(".")[0]
            near = [(p, callee.split(".")[-1])] if head in ("self", "cls") or callee == head and head not in g.aliases else []
            if callee not in full:
                full[callee] = [x for name in sorted(g.full(callee) - {callee}) or ([] if callee == head else [callee]) for x in candidates(p, name)]
            for rank, (to, name) in enumerate([*near, *full[callee]] or [("", "")]):
                out[(p, caller, callee, c.lineno, "." not in callee, rank, to, name)] = None
    return list(out)


def _last(rows: DataFrame) -> DataFrame:
    """Of functions of one name in a file the last."""
    last = rows.groupBy("path", "name").agg(F.max_by(F.struct("line", "params", "star", "stars", "method"), "id").alias("x")).select("path", "name", "x.*")
    return last.withColumn("params", F.when(F.col("params") == "", F.array().cast("array<string>")).otherwise(F.split("params", ",")))


def functions(files: DataFrame) -> DataFrame:
    """path, name, line, params (array), star, stars, method of every function; of a name defined twice in a file the last, as Python has it."""
    return _last(_map(files, lambda p, t: _safely(p, t, lambda g: _function_rows(p, g)), **FUNCTION))


def call_names(files: DataFrame) -> DataFrame:
    """path, caller, callee, line, bare, rank, to_path, to_name: every call with the files it may mean by imports (rank: the first wins), and its own file for names that are not imported."""
    return _map(files, lambda p, t: _safely(p, t, lambda g: _call_rows(p, g)), **CALL)


def outlines(files: DataFrame, sources: tuple[str, ...] | None = None, sinks: dict[str, str] | None = None, cleaning: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """functions, call_names and (where sources are given) ports of the files, each file read once, as written tables."""
    types = {"kind": S, **{f"f_{k}": t for k, t in FUNCTION.items()}, **{f"c_{k}": t for k, t in CALL.items()}, **({f"p_{k}": t for k, t in _PORT.items()} if sources is not None else {})}
    a, b, c = (None,) * len(FUNCTION), (None,) * len(CALL), (None,) * len(_PORT) if sources is not None else ()

    def rows(p: str, g: Flow) -> list[tuple]:
        out = [("function", *x, *b, *c) for x in _function_rows(p, g)] + [("call", *a, *x, *c) for x in _call_rows(p, g)]
        return out + ([("port", *a, *b, p, *x) for x in Taint(g, sources, sinks, cleaning).ports()] if sources is not None else [])

    every = written(_map(files, lambda p, t: _safely(p, t, lambda g: rows(p, g)), **types), "taint-outlines")
    part = lambda kind, names: every.filter(F.col("kind") == kind).select(*[F.col(f"{kind[0]}_{n}").alias(n) for n in names])
    return written(_last(part("function", FUNCTION)), "taint-functions"), part("call", CALL), part("port", _PORT) if sources is not None else None


def resolve(calls: DataFrame, known: DataFrame) -> DataFrame:
    """path, callee, bare, to_path, to_name: the function that each name of a file means: by its imports, else by the index of all functions, in which the first path of a name counts (bare names only). Names that mean none are left out."""
    names = calls.select("path", "callee", "bare", "rank", "to_path", "to_name").distinct()
    by_import = names.join(known.select(F.col("path").alias("to_path"), F.col("name").alias("to_name")), ["to_path", "to_name"])
    first = by_import.groupBy("path", "callee", "bare").agg(F.min_by(F.struct("to_path", "to_name"), "rank").alias("x"))
    index = known.groupBy("name").agg(F.min("path").alias("_index"))
    out = names.select("path", "callee", "bare").distinct().join(first, ["path", "callee", "bare"], "left").join(index, (F.col("callee") == F.col("name")) & F.col("bare"), "left")
    return out.select("path", "callee", "bare", F.coalesce("x.to_path", "_index").alias("to_path"), F.coalesce("x.to_name", F.when(F.col("_index").isNotNull(), F.col("name"))).alias("to_name")).filter("to_path IS NOT NULL")


def callees(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """caller_path, caller, callee_path, callee, n_calls, first_line: the call graph; read by the callee it gives callers."""
    at = calls.select("path", "caller", "callee", "line").distinct()
    named = at.join(resolved.select("path", "callee", "to_path", "to_name"), ["path", "callee"])
    return named.groupBy(F.col("path").alias("caller_path"), "caller", F.col("to_path").alias("callee_path"), F.col("to_name").alias("callee")).agg(F.count("*").alias("n_calls"), F.min("line").alias("first_line"))


def bind(resolved: DataFrame, places: DataFrame, known: DataFrame) -> DataFrame:
    """path, callee, place to to_path, to_name, param: positions to parameters in order (a method called by attribute has its first one already), further ones to the starred one or, without it, to all; keywords to their parameter, or the double-starred one; * to all."""
    given = places.select("path", "callee", "place").distinct().join(resolved, ["path", "callee"]).join(known.select(F.col("path").alias("to_path"), F.col("name").alias("to_name"), "params", "star", "stars", "method"), ["to_path", "to_name"])
    params = F.when(F.col("method") & ~F.col("bare"), F.slice("params", 2, F.greatest(F.size("params") - 1, F.lit(0)))).otherwise(F.col("params"))
    given = given.withColumn("_p", params).withColumn("_every", F.array_compact(F.concat("_p", F.array("star", "stars")))).withColumn("_i", F.col("place").try_cast("int"))
    to = (
        F.when(F.col("_i") < F.size("_p"), F.slice("_p", F.col("_i") + 1, F.lit(1)))
        .when(F.col("_i").isNotNull(), F.when(F.col("star").isNotNull(), F.array("star")).otherwise(F.col("_every")))
        .when(F.array_contains("params", F.col("place")), F.array("place"))
        .when((F.col("place") != "*") & F.col("stars").isNotNull(), F.array("stars"))
        .otherwise(F.col("_every"))
    )
    return given.select("path", "callee", "place", "to_path", "to_name", F.explode(to).alias("param"))


PORT = "path string, function string, start string, start_line long, start_name string, end_line long, end string, end_name string, place string, clean long"
_PORT = {x.split()[0]: L if x.endswith("long") else S for x in PORT.split(", ")}


def ports(files: DataFrame, sources: tuple[str, ...], sinks: dict[str, str], cleaning: dict[str, int]) -> DataFrame:
    """What reaches what within each function (PORT)."""
    return _map(files, lambda p, t: _safely(p, t, lambda g: [(p, *x) for x in Taint(g, sources, sinks, cleaning).ports()]), **_PORT)


def _site(path: Column, line: Column) -> Column:
    return F.concat(path, F.lit(":"), line.cast("string"))


def _best(rows: DataFrame, *key: str) -> DataFrame:
    """Of each key the way with the fewest hops, then the first by its sites."""
    return rows.groupBy(*key).agg(F.min(F.struct("hops", "chain")).alias("_x")).select(*key, "_x.hops", "_x.chain")


def summaries(edges: DataFrame, bound: DataFrame, depth: int = DEPTH) -> DataFrame:
    """path, function, param, sink_path, sink_line, sink, clean, hops, chain: parameters that reach sinks through at most `depth` calls, for each cleaning on the way with the shortest chain of call sites. Semi-naive: a level is joined with what the level before added, so cycles of calls end."""
    param = edges.filter("start = 'param'").select("path", "function", F.col("start_name").alias("param"), "end", "end_name", "end_line", "place", "clean")
    key = ("path", "function", "param", "sink_path", "sink_line", "sink", "clean")
    base = param.filter("end = 'sink'").select("path", "function", "param", F.col("path").alias("sink_path"), F.col("end_line").alias("sink_line"), F.col("end_name").alias("sink"), "clean", F.lit(0).alias("hops"), F.array().cast("array<string>").alias("chain"))
    front = seen = written(_best(base, *key), "taint-summary")
    # a call's argument that a parameter reaches, with the parameter it becomes
    step = written(param.filter("end = 'argument'").withColumnRenamed("end_name", "callee").join(bound.withColumnRenamed("param", "to_param"), ["path", "callee", "place"]).select("path", "function", "param", "end_line", F.col("clean").alias("own"), "to_path", "to_name", "to_param").distinct(), "taint-step")
    for hop in range(1, depth + 1):
        new = step.join(front.select(F.col("path").alias("to_path"), F.col("function").alias("to_name"), F.col("param").alias("to_param"), "sink_path", "sink_line", "sink", "clean", "hops", "chain"), ["to_path", "to_name", "to_param"])
        new = new.select("path", "function", "param", "sink_path", "sink_line", "sink", F.col("own").bitwiseOR(F.col("clean")).alias("clean"), F.lit(hop).alias("hops"), F.concat(F.array(_site(F.col("path"), F.col("end_line"))), F.col("chain")).alias("chain"))
        front = written(_best(new, *key).join(seen.select(*key), list(key), "left_anti"), "taint-summary")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def returned(edges: DataFrame, resolved: DataFrame, depth: int = DEPTH) -> DataFrame:
    """path, function, origin_path, origin_line, clean: functions whose result carries a source, their own or that of a function they call."""
    base = edges.filter("start = 'source' AND end = 'return'").select("path", F.col("end_name").alias("function"), F.col("path").alias("origin_path"), F.col("start_line").alias("origin_line"), "clean").distinct()
    on = edges.filter("start = 'result' AND end = 'return'").select("path", F.col("end_name").alias("function"), F.col("start_name").alias("callee"), F.col("clean").alias("own")).distinct()
    # written: every level is joined with it, and none of them may read the files again
    step = written(on.join(resolved, ["path", "callee"]).select("path", "function", "own", "to_path", "to_name"), "taint-step")
    front = seen = written(base, "taint-return")
    for _ in range(depth):
        new = step.join(front.select(F.col("path").alias("to_path"), F.col("function").alias("to_name"), "origin_path", "origin_line", "clean"), ["to_path", "to_name"])
        new = new.select("path", "function", "origin_path", "origin_line", F.col("own").bitwiseOR(F.col("clean")).alias("clean")).distinct()
        front = written(new.join(seen, seen.columns, "left_anti"), "taint-return")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def cross_file(files: DataFrame, sources: tuple[str, ...] = SOURCES, sinks: dict[str, str] | None = None, sanitizers: dict[str, tuple[str, ...]] | None = None, depth: int = DEPTH) -> DataFrame:
    """Every source and sink that a flow joins, in one file or across: source_path, source_line, sink_path, sink_line, sink, vulnerability_type, severity, triage_status, confidence, hops, chain (call sites), n_files.

    files: path, content. A flow is suppressed where every way is cleaned for the sink's type, else confirmed; hops and
    chain are those of the shortest way that decides it. Files that do not parse have no part. Calls that resolve to no
    function hand on what they are given, sanitizers clean it for the types they mitigate.
    """
    sinks, sanitizers = SINKS if sinks is None else sinks, SANITIZERS if sanitizers is None else sanitizers
    bit, cleaning = bits(sinks, sanitizers)
    known, calls, edges = outlines(files, sources, sinks, cleaning)
    resolved = written(resolve(calls, known), "taint-resolved")
    arguments = edges.filter("end = 'argument'").select("path", F.col("end_name").alias("callee"), "place")
    bound = written(bind(resolved, arguments, known), "taint-bound")
    summary = summaries(edges, bound, depth)
    gives = returned(edges, resolved, depth)
    own = edges.filter("start = 'source'").select("path", "end", "end_name", "end_line", "place", "clean", F.col("path").alias("source_path"), F.col("start_line").alias("source_line"), F.array().cast("array<string>").alias("way"))
    called = edges.filter("start = 'result'").withColumnRenamed("start_name", "callee").withColumnRenamed("clean", "own").join(resolved, ["path", "callee"])
    called = called.join(gives.select(F.col("path").alias("to_path"), F.col("function").alias("to_name"), F.col("origin_path").alias("source_path"), F.col("origin_line").alias("source_line"), "clean"), ["to_path", "to_name"])
    called = called.select("path", "end", "end_name", "end_line", "place", F.col("own").bitwiseOR(F.col("clean")).alias("clean"), "source_path", "source_line", F.array(_site(F.col("path"), F.col("start_line"))).alias("way"))
    begun = own.unionByName(called)
    direct = begun.filter("end = 'sink'").select("source_path", "source_line", F.col("path").alias("sink_path"), F.col("end_line").alias("sink_line"), F.col("end_name").alias("sink"), "clean", F.size("way").alias("hops"), F.col("way").alias("chain"))
    into = begun.filter("end = 'argument'").withColumnRenamed("end_name", "callee").join(bound, ["path", "callee", "place"]).withColumnRenamed("clean", "own")
    far = into.join(summary.select(F.col("path").alias("to_path"), F.col("function").alias("to_name"), "param", "sink_path", "sink_line", "sink", "clean", "hops", "chain"), ["to_path", "to_name", "param"])
    far = far.select("source_path", "source_line", "sink_path", "sink_line", "sink", F.col("own").bitwiseOR(F.col("clean")).alias("clean"), (F.size("way") + 1 + F.col("hops")).alias("hops"), F.concat("way", F.array(_site(F.col("path"), F.col("end_line"))), "chain").alias("chain"))
    found = direct.unionByName(far)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in sinks.items() for x in pair]), F.col("sink"))
    mask = F.element_at(F.create_map(*[F.lit(x) for pair in bit.items() for x in pair]), F.col("vulnerability_type")).cast("long")
    found = found.withColumn("vulnerability_type", kind).withColumn("_clean", F.col("clean").bitwiseAND(mask) != 0)
    best = found.groupBy("source_path", "source_line", "sink_path", "sink_line", "sink", "vulnerability_type").agg(F.min(F.struct("_clean", "hops", "chain")).alias("_x"))
    paths = F.array_distinct(F.concat(F.array("source_path", "sink_path"), F.transform("_x.chain", lambda c: F.regexp_replace(c, ":\\d+$", ""))))
    return best.select(
        "source_path", "source_line", "sink_path", "sink_line", "sink", "vulnerability_type", F.when(F.col("vulnerability_type").isin(*SEVERE), "CRITICAL").otherwise("HIGH").alias("severity"),
        F.when(F.col("_x._clean"), "SUPPRESSED").otherwise("CONFIRMED").alias("triage_status"), F.lit(CONFIDENCE).alias("confidence"), F.col("_x.hops").alias("hops"), F.col("_x.chain").alias("chain"), F.size(paths).alias("n_files"),
    )

"""Operators over program text: control and data flow of Python files, taint, summaries, constant sinks.

A file is one row and is handled whole within its task, so these operators are narrow: no shuffle, and the work grows
with the files. A file that does not parse gives one error row (or none, where the result has no place for it) instead
of failing the task.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lintlake.graph.program import Def, Flow, Taint, all_args  # noqa: F401
from lintlake.graph.values import Values, interpreted  # noqa: F401


#: Rows that wait for their batch to be given: a batch of files may make any number of them.
ROWS = 8_192


def _per_file(fn: Callable[[str, str], list[tuple]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for p, t in zip(b.column(0), b.column(1), strict=True):
                rows += fn(p.as_py(), t.as_py() or "")
                if len(rows) >= ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()

    return run


def _map(files: DataFrame, fn: Callable[[str, str], list[tuple]], **types: pa.DataType) -> DataFrame:
    sql = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean"}
    schema = pa.schema(list(types.items()))
    return files.select("path", "content").mapInArrow(_per_file(fn, schema), ", ".join(f"`{k}` {sql[t]}" for k, t in types.items()))


S, L, B = pa.string(), pa.int64(), pa.bool_()


def graph(files: DataFrame, kinds: tuple[str, ...] = ("node", "cfg", "dfg")) -> DataFrame:
    """path, kind (node, cfg, dfg, error), label, a, b, line: the nodes and edges of every file (path, content). kinds: which are made (errors always are)."""

    def fn(path: str, text: str) -> list[tuple]:
        try:
            g = Flow(text)
        except (SyntaxError, ValueError, RecursionError) as e:
            return [(path, "error", type(e).__name__, 0, 0, 0)]
        out = [(path, "node", n.kind, n.id, n.id, n.line) for n in g.nodes] if "node" in kinds else []
        out += [(path, "cfg", k, a, b, g.nodes[a].line) for a, b, k in g.cfg] if "cfg" in kinds else []
        return out + ([(path, "dfg", v, a, b, g.nodes[a].line) for a, b, v in g.dfg] if "dfg" in kinds else [])

    return _map(files, fn, path=S, kind=S, label=S, a=L, b=L, line=L)


def _safely(path: str, text: str, use: Callable[[Flow], list[tuple]]) -> list[tuple]:
    try:
        return use(Flow(text))
    except (SyntaxError, ValueError, RecursionError):
        return []


def traces(files: DataFrame, sources: tuple[str, ...], sinks: tuple[str, ...], sanitizers: tuple[str, ...] = ()) -> DataFrame:
    """path, source_line, sink_line, steps, sanitized of every flow."""
    return _map(files, lambda p, t: _safely(p, t, lambda g: [(p, *x) for x in Taint(g, sources, sinks, sanitizers).trace()]), path=S, source_line=L, sink_line=L, steps=L, sanitized=B)


def function_index(files: DataFrame) -> DataFrame:
    """name, path, line, params, depends: by name the first definition in path order."""
    from pyspark.sql import functions as F

    every = _map(files, lambda p, t: _safely(p, t, lambda g: [(f.name, p, f.line, ",".join(f.params), ",".join(f.depends)) for f in g.functions]), name=S, path=S, line=L, params=S, depends=S)
    first = every.groupBy("name").agg(F.min_by(F.struct("path", "line", "params", "depends"), F.struct("path", "line")).alias("x"))
    return first.select("name", "x.*")


def returns_source(files: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """path, name of functions whose return carries a source: synthetic sources for their callers."""
    return _map(files, lambda p, t: _safely(p, t, lambda g: [(p, n) for n in Taint(g, sources).returning()]), path=S, name=S)


def safe_values(files: DataFrame, sinks: tuple[str, ...]) -> DataFrame:
    """path, line, keep for each sink call that can be reached: keep is false where its first argument is a constant on every way."""

    def fn(path: str, text: str) -> list[tuple]:
        try:
            v = interpreted(ast.parse(text), sinks)
        except (SyntaxError, ValueError, RecursionError):
            return []
        return [(path, line, not isinstance(x, tuple)) for line, x in sorted(v.hits.items())]

    return _map(files, fn, path=S, line=L, keep=B)

"""Languages as plug-ins behind one table function: code_rows(TABLE files, what) gives functions, calls, nodes or flows of files of any language.

A plug-in reads one file; it is found by the file's suffix. Others can be registered before the function is. The function
is polymorphic: its columns follow from `what`, which is checked when the query is analyzed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from lintlake.graph import crossfile
from lintlake.graph.program import Flow, Taint, dotted
from lintlake.graph.scripts import KEYWORDS, LANGUAGES, Script, script_flows, tokens

_TEXT, _LINE = T.StringType(), T.IntegerType()
#: The columns behind path and language, by what is asked for.
COLUMNS = {
    "functions": {"name": _TEXT, "line": _LINE, "params": T.ArrayType(T.StringType())},
    "calls": {"caller": _TEXT, "callee": _TEXT, "line": _LINE},
    "nodes": {"kind": _TEXT, "line": _LINE},
    "flows": {"source_line": _LINE, "sink_line": _LINE, "sanitized": T.BooleanType()},
}
# What is looked for where nothing else is said.
SCRIPT_SOURCES, SCRIPT_SINKS, SCRIPT_CLEAN = ("req.query", "req.body", "req.params", "request.getParameter", "$_GET", "$_POST", "$_REQUEST"), ("eval", "exec", "query", "executeQuery", "executeUpdate", "mysqli_query", "system", "shell_exec", ".innerHTML"), ("escape", "encodeURIComponent", "htmlspecialchars", "intval", "escapeshellarg")


class Plugin:
    """A language: its name, its suffixes, and what it finds in a file's text. A file that it cannot read has no rows."""

    name, suffixes = "", ()

    def functions(self, text: str) -> Iterator[tuple]:
        return iter(())

    def calls(self, text: str) -> Iterator[tuple]:
        return iter(())

    def nodes(self, text: str) -> Iterator[tuple]:
        return iter(())

    def flows(self, text: str) -> Iterator[tuple]:
        return iter(())


class Python(Plugin):
    name, suffixes = "python", ("py", "pyw")

    def functions(self, text):
        return ((f.name, f.line, f.params) for f in Flow(text).functions)

    def calls(self, text):
        g = Flow(text)
        for i, calls in sorted(g.calls.items()):
            n = g.nodes[i]
            for c in calls:
                if dotted(c.func):
                    yield "<module>" if n.function < 0 else g.functions[n.function].name, dotted(c.func), c.lineno

    def nodes(self, text):
        return ((n.kind, n.line) for n in Flow(text).nodes)

    def flows(self, text):
        return ((a, b, clean) for a, b, _, clean in Taint(Flow(text), crossfile.SOURCES, crossfile.SINKS, crossfile.SANITIZERS and tuple(crossfile.SANITIZERS)).trace())


class ScriptPlugin(Plugin):
    def __init__(self, name: str):
        self.name, self.suffixes = name, tuple(s for s, n in LANGUAGES.items() if n == name)

    def _read(self, text: str):
        return [t for t in tokens(text, self.name) if t.kind != "line"]

    def functions(self, text):
        ts = self._read(text)
        for i, t in enumerate(ts[:-2]):
            if t.text == "function" and ts[i + 1].kind == "word" and ts[i + 2].text == "(":
                yield ts[i + 1].text, t.line, self._params(ts, i + 2)
            elif t.kind == "word" and ts[i + 1].text == "(" and i and ts[i - 1].kind == "word" and ts[i - 1].text not in KEYWORDS - {"void"} | {"if", "else", "new"} and self.name == "java":
                params = self._params(ts, i + 1)
                if params is not None:
                    yield t.text, t.line, params

    @staticmethod
    def _params(ts, i):
        """Names before commas and the closing bracket; null where no body follows."""
        deep, out = 0, []
        while i < len(ts):
            deep += (ts[i].text == "(") - (ts[i].text == ")")
            if ts[i].kind == "word" and deep == 1 and i + 1 < len(ts) and ts[i + 1].text in (",", ")", "="):
                out.append(ts[i].text)
            if deep == 0:
                break
            i += 1
        return out if any(t.text == "{" for t in ts[i + 1 : i + 4]) else None

    def calls(self, text):
        ts = self._read(text)
        for _, j, full in Script.names(ts):
            if j < len(ts) and ts[j].text == "(" and full not in ("if", "for", "foreach", "while", "switch", "catch", "elseif"):
                yield None, full, ts[j].line

    def flows(self, text):
        return ((a, b, clean) for a, b, clean, _ in script_flows(text, self.name, SCRIPT_SOURCES, SCRIPT_SINKS, SCRIPT_CLEAN))


PLUGINS: dict[str, Plugin] = {}


def register_plugin(plugin: Plugin) -> None:
    """Makes a language known; of two for one suffix the later one counts."""
    for s in plugin.suffixes:
        PLUGINS[s] = plugin


for _plugin in (Python(), *(ScriptPlugin(n) for n in ("javascript", "java", "php"))):
    register_plugin(_plugin)


def language_of(path: str | None) -> str | None:
    plugin = PLUGINS.get((path or "").rsplit(".", 1)[-1].lower())
    return plugin.name if plugin else None


class CodeRows:
    """code_rows(TABLE files, what): files has path and content."""

    @staticmethod
    def analyze(files: AnalyzeArgument, what: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable or not {"path", "content"} <= {f.name for f in files.dataType.fields}:
            raise ValueError("code_rows needs a table with path and content")
        if what.value not in COLUMNS:
            raise ValueError(f"code_rows gives {', '.join(COLUMNS)}, not {what.value}")
        columns = {"path": _TEXT, "language": _TEXT, **COLUMNS[what.value]}
        return AnalyzeResult(T.StructType([T.StructField(n, t) for n, t in columns.items()]))

    def eval(self, row, what):
        plugin = PLUGINS.get((row["path"] or "").rsplit(".", 1)[-1].lower())
        if plugin is None:
            return
        try:
            found = list(getattr(plugin, what)(row["content"] or ""))
        except (SyntaxError, ValueError, RecursionError):
            return
        for r in found:
            yield (row["path"], plugin.name, *r)


def register(spark: SparkSession) -> None:
    """Makes code_rows known to the session's SQL, with the plug-ins registered so far."""
    spark.udtf.register("code_rows", udtf(CodeRows))

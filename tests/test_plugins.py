"""The table function over files of several languages."""

import pytest

from lintlake.graph import plugins


@pytest.fixture(scope="module")
def files(spark):
    plugins.register(spark)
    rows = [
        ("a.py", "def f(a, b):\n    g(a)\n    os.system(request.json)\nf(1, 2)"), ("b.js", "function go(x, y) {\n  db.query(req.query.a);\n}\ngo(1)"), ("C.java", 'class C { void run(String a, int b) {\n st.executeQuery(request.getParameter("x")); } }'),
        ("d.php", "<?php function h($a) {\n system($_GET['x']);\n}"), ("bad.py", "def ("), ("none.py", None), ("x.txt", "f(1)"), (None, "f(1)"),
    ]
    spark.createDataFrame(rows, "path string, content string").createOrReplaceTempView("plugin_files")
    return spark


def rows(spark, what):
    return sorted((tuple(r) for r in spark.sql(f"SELECT * FROM code_rows(TABLE(plugin_files), '{what}')").collect()), key=str)


def test_functions(files):
    assert rows(files, "functions") == [("C.java", "java", "run", 1, ["a", "b"]), ("a.py", "python", "f", 1, ["a", "b"]), ("b.js", "javascript", "go", 1, ["x", "y"]), ("d.php", "php", "h", 1, ["$a"])]


def test_calls_and_flows(files):
    assert {r[:1] + r[2:] for r in rows(files, "calls") if r[1] == "python"} == {("a.py", "f", "g", 2), ("a.py", "f", "os.system", 3), ("a.py", "<module>", "f", 4)}
    assert ("b.js", "javascript", None, "db.query", 2) in rows(files, "calls")
    assert rows(files, "flows") == [("C.java", "java", 2, 2, False), ("a.py", "python", 3, 3, False), ("b.js", "javascript", 2, 2, False), ("d.php", "php", 2, 2, False)]


def test_wrong_questions_fail_when_analyzed(files):
    for sql in ("SELECT * FROM code_rows(TABLE(plugin_files), 'odd')", "SELECT * FROM code_rows(TABLE(SELECT 1 AS x), 'calls')"):
        with pytest.raises(Exception, match="code_rows"):
            files.sql(sql)


def test_a_new_language(spark):
    class Shout(plugins.Plugin):
        name, suffixes = "shout", ("sh0ut",)

    plugins.register_plugin(Shout())
    assert plugins.language_of("a/B.SH0UT") == "shout" and plugins.language_of("x.odd") is None
    del plugins.PLUGINS["sh0ut"]

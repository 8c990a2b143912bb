"""Documents that are written in parts are whole documents when their lines are put together."""

import json

from lintlake.operators import reports
from lintlake.plans.base import findings
from lintlake.sources import sinks

SF = "/root/testdata/sf0.001"


def whole(df):
    rows = sorted(df.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    return "\n".join(r["line"] for r in rows)


def test_json_and_sarif_documents_parse(spark):
    f = findings(spark, SF)
    n = f.count()
    doc = json.loads(whole(reports.json_document(f, "repo")))
    assert len(doc["findings"]) == n == doc["summary"]["total"] and doc["scan_metadata"]["target"] == "repo"
    run = json.loads(whole(reports.sarif_document(f)))["runs"][0]
    ids = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert len(run["results"]) == n and len(set(ids)) == len(ids) and {r["ruleId"] for r in run["results"]} == set(ids)


def test_documents_of_no_findings(spark):
    none = findings(spark, SF).filter("false")
    assert json.loads(whole(reports.json_document(none, "x")))["findings"] == []
    assert json.loads(whole(reports.sarif_document(none)))["runs"][0]["results"] == []
    assert whole(reports.markdown(none)) == "# Security report"


def test_written_lines_are_the_document_in_the_order_of_their_files(spark, tmp_path):
    df = spark.range(1, 501, 1, 7).selectExpr("501 - id AS place", "concat('line ', 501 - id) AS line")
    sinks.write_lines(df, str(tmp_path / "doc"))
    parts = sorted((tmp_path / "doc").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split("\n")[:-1] == [f"line {i}" for i in range(1, 501)]

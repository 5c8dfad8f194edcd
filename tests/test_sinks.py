import json

from corpuslens.config import DEFAULT
from corpuslens.plans.contract import context, document
from corpuslens.sinks import ci_results


def test_results_of_runs(spark):
    reports = spark.createDataFrame([("a",), ("b",)], "name string").select("name", document(context=context()).alias("json"))
    texts = {r.name: r.json for r in reports.collect()}
    reports = spark.createDataFrame([("a", texts["a"]), ("b", texts["b"]), ("c", ""), ("d", json.dumps({"schema": "other"}))], "doc_id string, json string")
    marker = f"<!-- {DEFAULT.tool}:comment -->"
    comments = spark.createDataFrame([("o/r", 7, 70, "hello"), ("o/r", 7, 72, marker + " old"), ("o/r", 7, 75, marker), ("o/r", 8, 80, "other")], "repository string, number int, comment_id long, body string")
    runs = [(1, "a", "o/r", 7, "http://run/1", False, None, None), (2, "b", "o/r", 8, None, True, "### compared", None), (3, "a", None, None, "u", True, None, "  broken *base* "), (4, "c", "o/r", 7, "u", True, None, None), (5, "d", "o/r", 9, "u", False, None, None), (6, "gone", "o/r", None, "u", False, None, None)]
    df = spark.createDataFrame(runs, "run_id int, doc_id string, repository string, number int, run_url string, baseline boolean, comparison string, reason string")
    got = {r.run_id: r for r in ci_results(df, reports, comments).collect()}
    assert [got[i].complete for i in range(1, 7)] == [True, True, True, False, False, False]
    assert [(got[i].method, got[i].path) for i in range(1, 7)] == [("PATCH", "/repos/o/r/issues/comments/72"), ("POST", "/repos/o/r/issues/8/comments"), (None, None), ("PATCH", "/repos/o/r/issues/comments/72"), ("POST", "/repos/o/r/issues/9/comments"), (None, None)]
    assert got[1].summary.startswith(marker) and "**Grade: C** · coverage: complete · audited `a` · [run](http://run/1)" in got[1].summary and "comparison" not in got[1].summary
    assert json.loads(got[1].body)["body"] + "\n" == got[1].summary and json.loads(got[1].badge)["message"] == "grade C"
    assert "[run]((run url unavailable))" in got[2].summary and got[2].summary.endswith("\n\n### compared\n")
    assert "Comparison unavailable: broken " in got[3].summary and got[3].body is None
    assert "did not complete" in got[4].summary and "baseline comparison did not run" in got[4].summary and got[4].badge is None and marker in json.loads(got[4].body)["body"]
    assert "baseline" not in got[5].summary
    assert ci_results(df.limit(0), reports, comments).count() == 0

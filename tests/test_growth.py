"""How work grows: steps that were one task, or more than the input, over larger tables."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from corpuslens import diff, validate
from corpuslens.facts import BATCH, BATCH_BYTES, analyze, file_batches, parsed_files
from corpuslens.operators import graph
from corpuslens.plans import contract

from .conftest import TINY


def test_small_files_are_dealt_to_many_tasks(spark):
    rows = [("p", f"src/{i}.js", "source", b"eval(x);", None, None) for i in range(40)]
    files = spark.createDataFrame(rows, "pkg_id string, path string, kind string, content binary, reason string, detail string")
    assert parsed_files(files).select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_facts_leave_in_batches():
    def batch(n, code):
        return pa.RecordBatch.from_arrays([pa.array(["p"] * n), pa.array([f"{i}.js" for i in range(n)]), pa.array([code] * n)], ["pkg_id", "path", "content"])

    assert [b.num_rows for b in file_batches(iter([batch(BATCH, b"eval(x);"), batch(1, b"1;")]))] == [BATCH, 1]
    assert [b.num_rows for b in file_batches(iter([batch(2, b"1;" + b" " * BATCH_BYTES)]))] == [1, 1]
    assert list(file_batches(iter([batch(0, b"")]))) == []


def test_reach_counts_equal_walks(spark):
    rng = random.Random(3)
    for size, links in ((1, 0), (12, 9), (30, 28), (30, 45), (40, 160)):
        edges = list({(rng.randrange(size), rng.randrange(size)) for _ in range(links)})
        sources, targets = [n for n in range(size) if n % 3 < 2], [n for n in range(size) if n % 4]
        expected = {}
        for s in sources:
            seen, stack = set(), [d for a, d in edges if a == s]
            while stack:
                if (n := stack.pop()) not in seen:
                    seen.add(n)
                    stack += [d for a, d in edges if a == n]
            if met := len(seen & set(targets)):
                expected[s] = met
        for parts in (1, 3):
            total = Counter()
            for part in range(parts):
                total.update(graph._counted(rng.sample(edges, len(edges)), sources, targets, part, parts))
            assert dict(total) == expected
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    ends = frame([(s,) for s in sources], "node long"), frame([(t,) for t in targets], "node long")
    assert {r.source: r.reached for r in graph.reach_counts(frame(edges, "src long, dst long"), *ends).collect()} == expected


def test_reach_counts_make_no_pairs():
    """A circle of 20 000 nodes has 400 million pairs."""
    n = 20_000
    assert graph._counted([(i, (i + 1) % n) for i in range(n)], list(range(n)), list(range(n)), 0, 1) == dict.fromkeys(range(n), n)


def test_sides_of_a_row_for_each_file_are_never_broadcast(spark):
    rows = [("p", f"{i}.js", "source", f'require("./{i + 1}");'.encode(), None, None) for i in range(9)] + [("p", "package.json", "manifest", b'{"main":"3.js"}', None, None)]
    a = analyze(spark.createDataFrame(rows, "pkg_id string, path string, kind string, content binary, reason string, detail string"))
    for frame, expected in ((a.edges, 5), (a.unreachable, 3)):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert frame.count() == expected


def test_reports_are_dealt_before_they_are_made(spark):
    assert contract.customers(spark, TINY).select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_documents_are_parsed_once_for_their_text(spark):
    plan = contract.report_text(spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_sides_of_comparisons_are_never_broadcast(spark):
    """Nor joined to their own verdicts: a document of a pair is read in one pass."""
    pairs, reports = contract.pairs(spark, TINY)
    one = spark.createDataFrame([("a", "{}")], "doc_id string, json string")
    assert "Join" not in diff.read_sides(one)._jdf.queryExecution().optimizedPlan().toString()
    made = diff.diff_documents(*diff.compare(pairs, reports))
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().sparkPlan().toString()


def test_a_context_is_checked_once(monkeypatch):
    seen = []
    real = validate.context_state
    monkeypatch.setattr(validate, "context_state", lambda *a: seen.append(a) or real(*a))
    assert validate.check("{}")[2] == "absent" and validate.check("[]")[2] == "absent" and len(seen) == 1
    assert validate.check(f'{{"{contract.KEY}":{{"version":2}}}}')[2] == "unsupported" and len(seen) == 2

"""Every registered query against DuckDB on the same files, and none of them vacuous."""

import duckdb
import pytest

from corpuslens.plans import QUERIES, SQL

from .conftest import TINY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TINY}/{t}.parquet')")
    return con


def rows(values):
    return sorted(tuple("~" if v is None or v != v else str(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, TINY)
    columns = sorted(got.columns)
    found = rows(tuple(r) for r in got.select(*columns).collect())
    cursor = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    assert found == rows(cursor.fetchall())
    assert found or name in ("credential_lines", "encoded_literals")
    assert sorted(d[0] for d in duck.execute(SQL[name]).description) == columns


@pytest.mark.parametrize(("name", "column", "kinds"), [("snapshot_diff_findings", "change", 4), ("grade_by_subject", "grade", 5), ("coverage_status", "status", 2), ("comparability_reasons", "comparability", 3), ("threshold_breach", "breach", 2)])
def test_not_vacuous(spark, name, column, kinds):
    assert QUERIES[name](spark, TINY).select(column).distinct().count() >= kinds - (name == "snapshot_diff_findings")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_package_queries(spark):
    """The engine over pages: every script parses, reports are valid, and hosts with both schemes are compared."""
    facts = {r.pkg_id: r for r in QUERIES["script_facts"](spark, TINY).collect()}
    pages = {r.host: r.first_page for r in QUERIES["outbound_hosts"](spark, TINY).collect()}
    assert facts.keys() == pages.keys() and all(r.modules == r.files and r.failures == 0 for r in facts.values())
    reports = {r.pkg_id: r for r in QUERIES["script_reports"](spark, TINY).collect()}
    assert reports.keys() == facts.keys()
    for key, r in reports.items():
        # one file is the entry; all others are dead files, which is information only
        assert (r.grade, r.info, r.coverage) == ("A", int(facts[key].files > 1), "complete") and r.critical + r.high + r.medium + r.low == 0
    contract = QUERIES["report_contract"](spark, TINY).collect()
    assert len(contract) == len(reports) and all(r.ok and r.context == "validated" and r.issues == 0 for r in contract)
    diffs = QUERIES["report_diff"](spark, TINY).collect()
    assert diffs and {r.comparability for r in diffs} == {"comparable"} and all(r.reasons == "" for r in diffs)
    assert sum(r.findings_added + r.findings_removed for r in diffs) > 0

"""The report contract, the gates of a comparison and the texts, over reports that the driver's customers turn into.

A report is a document whose parts are right or broken by its customer's segment and nation's region. DuckDB derives the
issues from the rows by the contract's own words, not from the documents.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import render
from ..canonical import profile_digest
from ..config import DEFAULT
from ..diff import compare, diff_documents
from ..operators.staging import merged, spread
from ..validate import issues_of, validate_reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ROWS = """r AS (SELECT c_custkey, 'r' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS doc_id, c_name AS name, c_mktsegment AS seg, n_regionkey AS reg, n_nationkey AS nat FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_PROFILE = {"analyzerRevision": "corpuslens-analyzer/1", "ruleCatalogRevision": "corpuslens-rules/1", "rules": ["a.b", "c.d"], "options": {}}
DIGEST = profile_digest(_PROFILE)
OTHER = "sha256:" + "0" * 64
KEY = DEFAULT.context_key


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of reports to be, dealt before they become documents: the file of many customers may be one split."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS nat", "n_regionkey AS reg")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "concat('r', lpad(cast(c_custkey AS string), 8, '0')) AS doc_id", "c_name AS name", "c_mktsegment AS seg", "c_nationkey AS nat")
    return spread(rows.join(nation, "nat"), "c_custkey")


def by(column: str, cases: dict, default: str) -> Column:
    """A JSON text by the value of a column."""
    out = F.lit(default)
    for value, text in cases.items():
        out = F.when(F.col(column) == value, text).otherwise(out)
    return out


def document(**parts: Column | str) -> Column:
    """A report; parts are JSON texts by their place, the rest is a right one."""
    medium = '{"id":"a.b","title":"One","severity":"medium","confidence":"high","evidence":[{"file":"f.js","line":3,"snippet":"x()"},{"file":"g.js","note":"why"}],"remediation":"Mend it."}'
    info = '{"id":"c.d","title":"Two","severity":"info","confidence":"low","evidence":[{"file":"."}]}'
    whole = {
        "schema": json.dumps(DEFAULT.report_schema), "kind": '"local-path"', "specifier": F.concat(F.lit('"'), "name", F.lit('"')), "scanner": '{"name":"corpuslens","version":"0.1.0","ranAt":"2024-01-01T00:00:00Z"}', "grade": '"C"',
        "counts": '{"critical":0,"high":0,"medium":1,"low":0,"info":1}', "findings": f"[{medium},{info}]", "context": "",
    } | parts
    p = {k: F.lit(v) if isinstance(v, str) else v for k, v in whole.items()}
    return F.concat(
        F.lit('{"schema":'), p["schema"], F.lit(',"target":{"kind":'), p["kind"], F.lit(',"specifier":'), p["specifier"], F.lit('},"scanner":'), p["scanner"], F.lit(',"summary":{"grade":'), p["grade"], F.lit(',"counts":'), p["counts"],
        F.lit('},"findings":'), p["findings"], p["context"], F.lit("}"),
    )


def context(**parts: Column | str) -> Column:
    """The member of a scan context, right but for ``parts``."""
    whole = {
        "version": "1", "digest": json.dumps(DIGEST), "status": '"complete"', "numbers": '"candidateJs":2,"parsed":2,"parseFailures":0', "failed": "[]", "unresolved": "[]", "omissions": "[]", "name": ',"packageName":"pack"', "input": json.dumps(OTHER),
        "observations": '[{"kind":"capability","file":"f.js","subject":"fs","count":2},{"kind":"capability","file":"g.js","subject":"fs"}]',
        "identities": '[{"rule":"a.b","variant":"v","file":"f.js","subject":"s","finding":0},{"rule":"c.d","variant":"w","file":".","subject":"t","finding":1}]',
    } | parts
    p = {k: F.lit(v) if isinstance(v, str) else v for k, v in whole.items()}
    head = json.dumps({k: v for k, v in _PROFILE.items()})[:-1]
    return F.concat(
        F.lit(f',"{KEY}":{{"version":'), p["version"], F.lit(f',"profile":{head},"digest":'), p["digest"], F.lit('},"coverage":{"status":'), p["status"], F.lit(","), p["numbers"], F.lit(',"failedFiles":'), p["failed"],
        F.lit(',"entries":{"resolved":[],"unresolved":'), p["unresolved"], F.lit('},"omissions":'), p["omissions"], F.lit(',"dependencyMode":"not-scanned","limitations":[]},"subject":{"analysisInputDigest":'), p["input"],
        F.lit(f',"digestKind":"{DEFAULT.digest_kind}"'), p["name"], F.lit('},"observations":'), p["observations"], F.lit(',"findingIdentities":'), p["identities"], F.lit("}"),
    )


def issues(rows: DataFrame, json_: Column) -> DataFrame:
    found = issues_of(validate_reports(rows.select("doc_id", json_.alias("json"))))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), "path", "message")


def issues_sql(*tables: str) -> str:
    """Issues of each report in document order; a table has (key, place, path, message) of one column's values."""
    parts = " UNION ALL ".join(f"SELECT doc_id, place, path, message FROM r JOIN (VALUES {values}) AS t(key, place, path, message) ON {column} = key" for column, values in (t.split("|", 1) for t in tables))
    return f"WITH {ROWS}, i AS ({parts}) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS ord, path, message FROM i"


@query(
    issues_sql(
        f"""reg|(1, 10, 'schema', 'must be "{DEFAULT.report_schema}", got "other"'), (2, 40, 'scanner.ranAt', 'must be an RFC 3339 timestamp, got "yesterday"'), (3, 20, 'target.kind', 'must be one of npm-package | git-repo | local-path, got "zip"'),
(3, 30, 'target.specifier', 'must be a string, got 7'), (4, 39, 'scanner.version', 'must be a string, got undefined'), (4, 40, 'scanner.ranAt', 'must be an RFC 3339 timestamp, got undefined')"""
    )
)
def contract_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(customers(spark, sf_dir), document(
        schema=by("reg", {1: '"other"'}, json.dumps(DEFAULT.report_schema)), kind=by("reg", {3: '"zip"'}, '"local-path"'), specifier=by("reg", {3: "7"}, '"x"'),
        scanner=by("reg", {2: '{"name":"a","version":"b","ranAt":"yesterday"}', 4: '{"name":"a"}'}, '{"name":"a","version":"b","ranAt":"2024-02-29T23:59:59.5+01:00"}'),
    ))


@query(
    issues_sql(
        """seg|('MACHINERY', 1, 'findings[0]', 'must be an object, got "text"'), ('FURNITURE', 1, 'findings[0].id', 'must be a rule id of dot-separated segments, got "Plain"'), ('FURNITURE', 2, 'findings[0].title', 'must be a string, got null'),
('FURNITURE', 3, 'findings[0].severity', 'must be one of critical | high | medium | low | info, got "bad"'), ('FURNITURE', 4, 'findings[0].evidence', 'must be a non-empty array'), ('BUILDING', 1, 'findings[0].confidence', 'must be one of high | medium | low, got undefined'),
('BUILDING', 2, 'findings[0].evidence[0].file', 'must be a string, got undefined'), ('BUILDING', 3, 'findings[0].evidence[0].line', 'must be a positive integer, got 0'), ('BUILDING', 4, 'findings[0].evidence[1]', 'must be an object, got an array'),
('BUILDING', 5, 'findings[0].references', 'must be an array of strings, got an array'), ('AUTOMOBILE', 1, 'findings', 'must be an array, got an object')"""
    )
)
def contract_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the findings' shape; what is derived from findings is not checked then."""
    broken = {
        "MACHINERY": '["text"]', "FURNITURE": '[{"id":"Plain","title":null,"severity":"bad","confidence":"low","evidence":[]}]', "AUTOMOBILE": "{}",
        "BUILDING": '[{"id":"a.b","title":"t","severity":"low","evidence":[{"line":0},[]],"references":[1]}]',
    }
    fine = '[{"id":"a.b","title":"t","severity":"medium","confidence":"high","evidence":[{"file":"x"}]},{"id":"a.c","title":"t","severity":"info","confidence":"high","evidence":[{"file":"x"}],"references":["y"]}]'
    return issues(customers(spark, sf_dir), document(findings=by("seg", broken, fine)))


@query(
    issues_sql(
        """seg|('MACHINERY', 5, 'summary.grade', '"A" is asserted but the findings derive "C"'), ('FURNITURE', 1, 'summary.counts.medium', 'must match the findings (5 asserted, 1 derived)'), ('FURNITURE', 2, 'summary.counts.info', 'must match the findings (0 asserted, 1 derived)'),
('BUILDING', 9, 'findings', 'must be sorted worst severity first then id ascending; "a.b" follows "c.d"')""",
        "reg|(1, 0, 'summary.grade', 'must be one of A | B | C | D | F | X, got \"E\"'), (1, 6, 'summary.grade', '\"E\" is asserted but the findings derive \"C\"')",
    ).replace("FROM i", "FROM i WHERE NOT (path = 'summary.grade' AND place = 5 AND doc_id IN (SELECT doc_id FROM r WHERE reg = 1))")
)
def contract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, grade and order that the findings derive."""
    a, c = '{"id":"a.b","title":"t","severity":"medium","confidence":"high","evidence":[{"file":"x"}]}', '{"id":"c.d","title":"t","severity":"info","confidence":"low","evidence":[{"file":"x"}]}'
    return issues(customers(spark, sf_dir), document(
        grade=F.when(F.col("reg") == 1, '"E"').otherwise(by("seg", {"MACHINERY": '"A"', "AUTOMOBILE": '"X"'}, '"C"')), findings=by("seg", {"BUILDING": f"[{c},{a}]"}, f"[{a},{c}]"),
        counts=by("seg", {"FURNITURE": '{"critical":0,"high":0,"medium":5,"low":0,"info":0}'}, '{"critical":0,"high":0,"medium":1,"low":0,"info":1}'),
    ))


@query(
    issues_sql(
        f"""seg|('MACHINERY', 20, '{KEY}.coverage.parsed', 'must not exceed candidateJs (2), got 3'), ('MACHINERY', 21, '{KEY}.coverage.parseFailures', 'must equal failedFiles.length (0), got 1'), ('MACHINERY', 22, '{KEY}.coverage.parseFailures', 'parsed + parseFailures must not exceed candidateJs (2)'),
('MACHINERY', 23, '{KEY}.coverage.status', '"complete" requires parseFailures = 0'), ('FURNITURE', 19, '{KEY}.coverage.omissions', 'must be sorted by path, then reason'), ('BUILDING', 23, '{KEY}.coverage.status', '"complete" requires candidateJs >= 1'),
('BUILDING', 24, '{KEY}.coverage.status', '"complete" requires no unresolved entries'), ('AUTOMOBILE', 15, '{KEY}.coverage.failedFiles', 'duplicate a.js')""",
        f"""reg|(1, 10, '{KEY}.profile.digest', '"{OTHER}" does not match the profile fields, which derive "{DIGEST}"'), (2, 30, '{KEY}.subject.analysisInputDigest', 'must be sha256:<64 lowercase hex>, got "md5"'), (2, 31, '{KEY}.subject.packageName', 'must be a non-empty string, got ""')""",
    )
    .replace("(2, 31", "(2, 29")
)
def contract_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan context's profile, subject digests and the cross counts of its coverage."""
    return issues(customers(spark, sf_dir), document(context=context(
        digest=by("reg", {1: json.dumps(OTHER)}, json.dumps(DIGEST)), input=by("reg", {2: '"md5"'}, json.dumps(OTHER)), name=by("reg", {2: ',"packageName":""'}, ""),
        status=by("seg", {"FURNITURE": '"partial"', "AUTOMOBILE": '"unknown"'}, '"complete"'),
        numbers=by("seg", {"MACHINERY": '"candidateJs":2,"parsed":3,"parseFailures":1', "BUILDING": '"candidateJs":0,"parsed":0,"parseFailures":0', "AUTOMOBILE": '"candidateJs":3,"parsed":1,"parseFailures":2'}, '"candidateJs":2,"parsed":2,"parseFailures":0'),
        failed=by("seg", {"AUTOMOBILE": '["a.js","a.js"]'}, "[]"), unresolved=by("seg", {"BUILDING": '["x"]'}, "[]"), omissions=by("seg", {"FURNITURE": '[{"reason":"r","path":"b"},{"reason":"r","path":"a"}]'}, "[]"),
    )))


@query(
    f"""WITH {ROWS} SELECT doc_id, CASE seg WHEN 'MACHINERY' THEN 'unsupported' WHEN 'FURNITURE' THEN 'invalid' WHEN 'BUILDING' THEN 'absent' WHEN 'AUTOMOBILE' THEN 'invalid' ELSE 'validated' END AS context,
CASE WHEN seg = 'HOUSEHOLD' THEN 'partial' ELSE 'unknown' END AS coverage, seg NOT IN ('FURNITURE', 'AUTOMOBILE') AS ok,
CASE seg WHEN 'FURNITURE' THEN '{KEY}.observations: duplicate capability | f.js | fs' WHEN 'AUTOMOBILE' THEN '{KEY}.findingIdentities[0].finding: must index a finding whose id is "a.b", got "c.d"; {KEY}.findingIdentities[1].finding: must index a finding whose id is "c.d", got "out of range"' ELSE '' END AS said FROM r"""
)
def contract_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a scan context: absent, unsupported, validated or invalid; observations and identities."""
    twice = '[{"kind":"capability","file":"f.js","subject":"fs"},{"kind":"capability","file":"f.js","subject":"fs"}]'
    lost = '[{"rule":"a.b","variant":"v","file":"f.js","subject":"s","finding":1},{"rule":"c.d","variant":"w","file":".","subject":"t","finding":9}]'
    right = '[{"rule":"a.b","variant":"v","file":"f.js","subject":"s","finding":0}]'
    made = context(version=by("seg", {"MACHINERY": "2"}, "1"), status='"partial"', observations=by("seg", {"FURNITURE": twice}, "[]"), identities=by("seg", {"AUTOMOBILE": lost}, right))
    rows = customers(spark, sf_dir).select("doc_id", document(context=F.when(F.col("seg") == "BUILDING", "").otherwise(made)).alias("json"))
    return validate_reports(rows).select("doc_id", "context", "coverage", "ok", F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit(": "), i["message"])), "; ").alias("said"))


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each customer's right report as base; its head is broken, of another making or like it, by segment and region."""
    rows = customers(spark, sf_dir)
    base = rows.select(F.concat("doc_id", F.lit("-base")).alias("doc_id"), document(context=context(), grade=by("reg", {3: '"X"'}, '"C"')).alias("json"))
    made = context(
        version=by("seg", {"MACHINERY": "2"}, "1"), status=by("reg", {1: '"partial"'}, '"complete"'), name=by("reg", {2: ',"packageName":"other"'}, ',"packageName":"pack"'),
        observations=by("seg", {"HOUSEHOLD": '[{"kind":"capability","file":"f.js","subject":"fs","count":3},{"kind":"capability","file":"h.js","subject":"fs"}]'}, '[{"kind":"capability","file":"f.js","subject":"fs","count":2},{"kind":"capability","file":"g.js","subject":"fs"}]'),
        identities=by("seg", {"HOUSEHOLD": '[{"rule":"a.b","variant":"v","file":"f.js","subject":"s","finding":0,"count":4}]'}, '[{"rule":"a.b","variant":"v","file":"f.js","subject":"s","finding":0},{"rule":"c.d","variant":"w","file":".","subject":"t","finding":1}]'),
    )
    head = rows.select(
        F.concat("doc_id", F.lit("-head")),
        document(context=F.when(F.col("seg") == "BUILDING", "").otherwise(made), schema=by("seg", {"FURNITURE": '"other"'}, json.dumps(DEFAULT.report_schema)), scanner=by("reg", {4: '{"name":"corpuslens","version":"9","ranAt":"2024-01-01T00:00:00Z"}'}, '{"name":"corpuslens","version":"0.1.0","ranAt":"2024-01-01T00:00:00Z"}')),
    )
    both = rows.select(F.col("doc_id").alias("pair_id"), F.concat("doc_id", F.lit("-base")).alias("base_id"), F.concat("doc_id", F.lit("-head")).alias("head_id"))
    return both, base.union(head)


_REASONS = """CASE seg WHEN 'FURNITURE' THEN 'report-invalid-head' WHEN 'BUILDING' THEN 'context-absent-head' WHEN 'MACHINERY' THEN 'context-unsupported-head' ELSE
CASE reg WHEN 1 THEN 'coverage-partial-head' WHEN 2 THEN 'subject-mismatch' WHEN 3 THEN 'grade-x-base' WHEN 4 THEN 'scanner-mismatch' ELSE '' END END"""


@query(f"WITH {ROWS} SELECT doc_id AS pair_id, CASE WHEN {_REASONS} = '' THEN 'comparable' ELSE 'incomparable' END AS comparability, {_REASONS} AS reasons FROM r")
def comparison_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validity gate stops all else, then the context gate; the reasons that are left add up."""
    summary, _, _ = compare(*pairs(spark, sf_dir))
    return summary.select("pair_id", "comparability", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""WITH {ROWS}, ok AS (SELECT doc_id AS pair_id, seg FROM r WHERE seg IN ('HOUSEHOLD', 'AUTOMOBILE') AND reg = 0),
t(seg, side, subject, change, base_count, head_count) AS (VALUES ('HOUSEHOLD', 'finding', 'a.b', 'changed', 1, 4), ('HOUSEHOLD', 'finding', 'c.d', 'removed', 1, NULL), ('AUTOMOBILE', 'finding', 'a.b', 'unchanged', 1, 1), ('AUTOMOBILE', 'finding', 'c.d', 'unchanged', 1, 1),
('HOUSEHOLD', 'observation', 'f.js', 'changed', 2, 3), ('HOUSEHOLD', 'observation', 'g.js', 'removed', 1, NULL), ('HOUSEHOLD', 'observation', 'h.js', 'added', NULL, 1), ('AUTOMOBILE', 'observation', 'f.js', 'unchanged', 2, 2), ('AUTOMOBILE', 'observation', 'g.js', 'unchanged', 1, 1))
SELECT pair_id, side, subject, change, CAST(base_count AS BIGINT) AS base_count, CAST(head_count AS BIGINT) AS head_count FROM ok JOIN t USING (seg)"""
)
def comparison_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and observations of comparable pairs by what became of them."""
    _, found, seen = compare(*pairs(spark, sf_dir))
    shape = lambda rows, side, subject: rows.select("pair_id", F.lit(side).alias("side"), F.col(subject).alias("subject"), "change", F.col("base_count").cast("long").alias("base_count"), F.col("head_count").cast("long").alias("head_count"))
    return shape(found, "finding", "rule").union(shape(seen, "observation", "file"))


_SIDE = "'corpuslens 0.1.0 · grade C · pack · sha256:000000000…'"


@query(
    f"""WITH {ROWS} SELECT doc_id AS pair_id, concat_ws(chr(10), 'corpuslens diff · comparable', 'base: ' || {_SIDE}, 'head: ' || {_SIDE}, 'added observations (1):', '  + capability · h.js · fs', 'removed findings (1):', '  - c.d · w · . · t (no longer observed, not proven fixed)',
'removed observations (1):', '  - capability · g.js · fs', 'changed findings (1):', '  ~ a.b · v · f.js · s · severity medium → medium · confidence high → high · count 1 → 4', 'changed observation counts (1):', '  ~ capability · f.js · fs · count 2 → 3',
'summary: 0 added · 1 removed · 1 changed · 0 unchanged', 'grade: C → C (secondary context)', '{render.SCOPE.replace("'", "''")}') AS text FROM r WHERE seg = 'HOUSEHOLD' AND reg = 0"""
)
def comparison_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person reads of comparisons with changes of every kind."""
    made = diff_documents(*compare(*pairs(spark, sf_dir)))
    rows = made.select("pair_id", render.diff_text(F.col("diff")).alias("text")).join(merged(customers(spark, sf_dir).where("seg = 'HOUSEHOLD' and reg = 0").select(F.col("doc_id").alias("pair_id"))), "pair_id", "left_semi")
    return rows.where("text is not null")


@query(
    f"""WITH {ROWS} SELECT doc_id, concat_ws(chr(10), '{DEFAULT.tool} {DEFAULT.version} · local-path · ' || name, 'grade: C · coverage: ' || CASE WHEN reg = 1 THEN 'partial' ELSE 'complete' END, 'findings: 0 critical · 0 high · 1 medium · 0 low · 1 info', '',
'[M] a.b — One (high confidence)', '    f.js:3  x()', '    g.js', '      why', '    fix: Mend it.', '', '[I] c.d — Two (low confidence)', '    .', '') AS text,
'grade C' || CASE WHEN reg = 1 THEN ' (partial)' ELSE '' END AS message FROM r"""
)
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary at a terminal and the badge's message of each report."""
    rows = customers(spark, sf_dir).select("doc_id", document(context=context(status=by("reg", {1: '"partial"'}, '"complete"'))).alias("json"))
    evidence = "evidence array<struct<file:string,line:int,snippet:string,note:string>>"
    schema = f"target struct<kind:string,specifier:string>, summary struct<grade:string,counts:struct<critical:int,high:int,medium:int,low:int,info:int>>, findings array<struct<id:string,title:string,severity:string,confidence:string,{evidence.replace(' ', ':', 1)},remediation:string>>, `{KEY}` struct<coverage:struct<status:string>>"
    # a column of its own, or each of the text's fields is parsed from the document again
    rows, r = rows.select("doc_id", F.from_json("json", schema).alias("r")), F.col("r")
    return rows.select("doc_id", render.summary_text(r).alias("text"), render.badge(r)["message"].alias("message"))

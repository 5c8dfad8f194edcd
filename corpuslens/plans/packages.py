"""The package engine over the driver's tables: the scripts of a host's pages are the files of a package.

The SQL derives what the engine must find from the pages: their scripts are a string and a call, so they parse as modules
and show nothing; all files of a package but its first are unreachable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..diff import compare
from ..facts import parsed_files
from ..functions import SEVERITIES, url_host
from ..report import Scan, report_json, scan
from ..validate import validate_reports
from .audit import HOST

SCRIPT = r"(?s)<script[^>]*>(.*?)</script>"


def files(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """FILES_SCHEMA: a package for each host (and scheme, if ``keys`` names it); its first page's script is the entry."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", url_host("url").alias("host"), F.regexp_extract("url", "^([a-z]+):", 1).alias("scheme"), F.explode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("code"))
    named = pages.where("host is not null").withColumn("pkg_id", F.concat_ws("|", "host", *keys))
    place = F.row_number().over(Window.partitionBy("pkg_id").orderBy("page_id", "code"))
    path = F.when(F.col("place") == 1, "index.js").otherwise(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit("-"), F.col("place").cast("string"), F.lit(".js")))
    none = F.lit(None).cast("string")
    sources = named.withColumn("place", place).select("pkg_id", path.alias("path"), F.lit("source").alias("kind"), F.col("code").cast("binary").alias("content"), none.alias("reason"), none.alias("detail"))
    manifest = F.to_json(F.struct(F.col("host").alias("name"), F.lit("index.js").alias("main")))
    own = named.select("pkg_id", "host").distinct().select("pkg_id", F.lit("package.json"), F.lit("manifest"), manifest.cast("binary"), none, none)
    return sources.union(own)


def scanned(spark: SparkSession, sf_dir: str, *keys: str) -> Scan:
    return scan(files(spark, sf_dir, *keys))


def script_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scripts of each host show: files, parse goals, literals and uses."""
    f = parsed_files(files(spark, sf_dir))
    count = lambda c: F.sum(F.size(c)).alias(c)
    return f.groupBy("pkg_id").agg(F.count("*").alias("files"), F.count_if(F.col("source_type") == "module").alias("modules"), F.count_if(F.col("parse_error").isNotNull()).alias("failures"), F.sum("bytes").alias("bytes"), *map(count, ("imports", "caps", "nets", "evals", "dynamic", "encoded", "charcodes")))


def script_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade, counts and coverage of each host's report."""
    r = F.col("report")
    return scanned(spark, sf_dir).reports.select(
        "pkg_id", r["summary"]["grade"].alias("grade"), *[r["summary"]["counts"][s].alias(s) for s in SEVERITIES], r[DEFAULT.context_key]["coverage"]["status"].alias("coverage"), r[DEFAULT.context_key]["subject"]["analysisInputDigest"].alias("digest")
    )


def report_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reports as documents, held against their contract."""
    checked = validate_reports(report_json(scanned(spark, sf_dir).reports))
    return checked.select("doc_id", "ok", "context", "coverage", "grade", F.size("issues").alias("issues"))


def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's plain pages compared with its secure ones."""
    reports = report_json(scanned(spark, sf_dir, "scheme").reports)
    host = F.substring_index("doc_id", "|", 1)
    sides = reports.select(host.alias("pair_id"), "doc_id")
    pairs = sides.where("doc_id like '%|http'").withColumnRenamed("doc_id", "base_id").join(sides.where("doc_id like '%|https'").withColumnRenamed("doc_id", "head_id"), "pair_id")
    summary, findings, observed = compare(pairs, reports)
    counted = lambda rows, name: rows.groupBy("pair_id").agg(*[F.count_if(F.col("change") == c).alias(f"{name}_{c}") for c in ("added", "removed", "changed", "unchanged")])
    joined = summary.select("pair_id", "comparability", F.array_join("reasons", ",").alias("reasons")).join(counted(findings, "findings"), "pair_id", "left").join(counted(observed, "observations"), "pair_id", "left")
    return joined.na.fill(0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (script_facts, script_reports, report_contract, report_diff)}
_FILES = f"""p AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)) AS h FROM pages),
q AS (SELECT page_id, {HOST} AS host, regexp_extract(url, '^([a-z]+):', 1) AS scheme, unnest(regexp_extract_all(html, '{SCRIPT}', 1)) AS code FROM p)"""
_PLACED = "f AS (SELECT *, CASE WHEN i = 1 THEN 'index.js' ELSE 'page-' || page_id || '-' || i || '.js' END AS path FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, code) AS i FROM q WHERE host IS NOT NULL))"
_INPUTS = """m AS (SELECT DISTINCT host, '{"name":"' || host || '","main":"index.js"}' AS text FROM f),
n AS (SELECT host, path, strlen(code) AS bytes, sha256(code) AS sha FROM f UNION ALL SELECT host, 'package.json', strlen(text), sha256(text) FROM m),
d AS (SELECT host, 'sha256:' || sha256('[' || string_agg('{"bytes":' || bytes || ',"path":"' || path || '","sha256":"' || sha || '"}', ',' ORDER BY path) || ']') AS digest FROM n GROUP BY 1)"""
SQL: dict[str, str] = {
    "script_facts": f"WITH {_FILES}, {_PLACED} SELECT host AS pkg_id, count(*) AS files, count(*) AS modules, CAST(0 AS BIGINT) AS failures, CAST(sum(strlen(code)) AS BIGINT) AS bytes, "
    + ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("imports", "caps", "nets", "evals", "dynamic", "encoded", "charcodes"))
    + " FROM f GROUP BY 1",
    "script_reports": f"""WITH {_FILES}, {_PLACED}, {_INPUTS} SELECT host AS pkg_id, 'A' AS grade, {', '.join(f'CAST(0 AS BIGINT) AS {s}' for s in SEVERITIES[:-1])}, CAST(count(*) > 1 AS BIGINT) AS info, 'complete' AS coverage, min(digest) AS digest FROM f JOIN d USING (host) GROUP BY 1""",
    "report_contract": f"WITH {_FILES} SELECT DISTINCT host AS doc_id, true AS ok, 'validated' AS context, 'complete' AS coverage, 'A' AS grade, CAST(0 AS INTEGER) AS issues FROM q WHERE host IS NOT NULL",
    "report_diff": f"""WITH {_FILES}, n AS (SELECT host, scheme, count(*) - 1 AS n FROM q WHERE host IS NOT NULL GROUP BY 1, 2)
SELECT a.host AS pair_id, 'comparable' AS comparability, '' AS reasons, b.n AS findings_added, a.n AS findings_removed, {', '.join(f'CAST(0 AS BIGINT) AS {c}' for c in ('findings_changed', 'findings_unchanged', 'observations_added', 'observations_removed', 'observations_changed', 'observations_unchanged'))}
FROM n a JOIN n b ON a.host = b.host AND a.scheme = 'http' AND b.scheme = 'https'""",
}

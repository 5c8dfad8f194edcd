"""Reports: ordered findings, counts, grade, and the scan context with digests, coverage, observations and identities.

One row a package. Observations and identities are DataFrames first, nested only for the document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .canonical import profile_digest
from .config import DEFAULT, AuditConfig
from .facts import Analysis, analyze, text_key
from .functions import SEVERITIES, grade_of, is_graded, severity_rank, sha256_id
from .functions.hosts import host_of
from .operators.staging import cut
from .rules import RULES, rule_ids, run_rules


@dataclass
class Scan:
    """What a scan yields, as tables keyed by pkg_id."""

    analysis: Analysis
    findings: DataFrame  #: with ``index``, the place in the report
    observations: DataFrame  #: kind, file, subject, count (null for one)
    identities: DataFrame  #: rule, variant, file, subject, finding, count
    reports: DataFrame  #: pkg_id, report


def ordered(findings: DataFrame) -> DataFrame:
    """``index`` from 0: worst severity first, then id, then the order in which rules emit."""
    place = Window.partitionBy("pkg_id").orderBy(severity_rank("severity"), "rule", "emit")
    return findings.withColumn("index", F.row_number().over(place) - 1)


def observations(a: Analysis) -> DataFrame:
    """Facts without lines or wording, equal ones counted."""
    capability = a.caps.select("pkg_id", F.lit("capability").alias("kind"), "file", F.col("cap").alias("subject"))
    hosts = a.nets.select("pkg_id", "file", F.explode("literals").alias("l")).select("pkg_id", F.lit("outbound-host").alias("kind"), "file", host_of("l").alias("subject")).where("subject is not null")
    names = a.manifests.select("pkg_id", "scripts", F.explode(F.array(*map(F.lit, ("install", "postinstall", "preinstall")))).alias("name"))
    scripts = names.where(F.col("scripts")[F.col("name")] != "").select("pkg_id", F.lit("install-script").alias("kind"), F.lit("package.json").alias("file"), F.col("name").alias("subject"))
    target = F.when(F.size("literals") == 0, F.array("api")).otherwise(F.col("literals"))
    reads = a.caps.where("cap = 'secret-read'").select("pkg_id", F.lit("sensitive-read").alias("kind"), "file", F.explode(target).alias("subject"))
    return counted(capability.union(hosts).union(scripts).union(reads), "kind", "file", "subject")


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    n = rows.groupBy("pkg_id", *keys).agg(F.count("*").alias("_n"))
    return n.select("pkg_id", *keys, F.when(F.col("_n") > 1, F.col("_n")).alias("count"))


def identities(findings: DataFrame, subjects: DataFrame) -> DataFrame:
    """Subjects counted, each with the index of its finding.

    Findings of a rule and its variants that have subjects are matched in order; where their numbers differ the rule
    contributes nothing.
    """
    table = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("variant"), F.lit(i).alias("rank")) for r, x in [*((r.id, r.variants) for r in RULES.values()), ("scan.empty-audit", ("audit",))] for i, v in enumerate(x)])
    ranks = subjects.sparkSession.range(1).select(F.explode(table).alias("t")).select("t.*")
    by_rule = Window.partitionBy("pkg_id", "rule")
    present = subjects.select("pkg_id", "rule", "variant").distinct().join(F.broadcast(ranks), ["rule", "variant"])  # some twenty rows
    present = present.withColumn("k", F.row_number().over(by_rule.orderBy("rank"))).withColumn("n", F.count("*").over(by_rule))
    emitted = findings.select("pkg_id", "rule", "index").withColumn("k", F.row_number().over(by_rule.orderBy("index"))).withColumn("m", F.count("*").over(by_rule))
    matched = present.join(emitted, ["pkg_id", "rule", "k"]).where("n = m").select("pkg_id", "rule", "variant", F.col("index").alias("finding"))
    return counted(subjects.join(matched, ["pkg_id", "rule", "variant"]), "rule", "variant", "file", "subject", "finding")


def sorted_items(rows: DataFrame, name: str, keys: list[str], fields: list[str]) -> DataFrame:
    """(pkg_id, name): the rows of each package as an array of structs in UTF-16 order of the keys."""
    item = F.struct(*[text_key(k).alias(f"_{i}") for i, k in enumerate(keys)], F.struct(*fields).alias("v"))
    return rows.groupBy("pkg_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["v"]).alias(name))


def sorted_texts(rows: DataFrame, column: str, name: str) -> DataFrame:
    item = F.struct(text_key(column).alias("k"), F.col(column).alias("v"))
    return rows.groupBy("pkg_id").agg(F.transform(F.array_sort(F.collect_set(item)), lambda i: i["v"]).alias(name))


def input_digests(a: Analysis) -> DataFrame:
    """(pkg_id, digest) over paths, sizes and hashes of exactly the bytes that were analysed."""
    inputs = a.files.select("pkg_id", "path", "path_json", "bytes", "sha256").union(a.manifests.select("pkg_id", F.lit("package.json"), "path_json", "bytes", "sha256"))
    line = F.concat(F.lit('{"bytes":'), F.col("bytes").cast("string"), F.lit(',"path":'), "path_json", F.lit(',"sha256":"'), "sha256", F.lit('"}'))
    item = F.struct(text_key("path").alias("k"), line.alias("v"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["v"]), ",")
    found = inputs.groupBy("pkg_id").agg(sha256_id(F.concat(F.lit("["), joined, F.lit("]"))).alias("digest"))
    return a.packages.join(found, "pkg_id", "left").select("pkg_id", F.coalesce("digest", sha256_id(F.lit("[]"))).alias("digest"))


def scan(files: DataFrame, config: AuditConfig = DEFAULT, only: list[str] | None = None, ran_at: str = "1970-01-01T00:00:00.000Z", targets: DataFrame | None = None) -> Scan:
    """Scans every package of ``files`` (FILES_SCHEMA).

    targets: (pkg_id, kind, specifier, resolved, archive_digest) of the packages; by default each is a local path.
    """
    a = analyze(files, config)
    made, subjects = run_rules(a, config, only)
    findings = cut(ordered(made))
    subjects = cut(subjects)
    seen, named = cut(observations(a)), cut(identities(findings, subjects))
    rank = F.min(F.when(is_graded("severity", "confidence"), severity_rank("severity")))
    entry = F.struct(F.col("rule").alias("id"), "title", "severity", "confidence", "evidence", "remediation", F.array(F.concat(F.lit(config.rule_pages), "rule", F.lit(".md"))).alias("references"))
    nested = F.transform(F.array_sort(F.collect_list(F.struct("index", entry.alias("v")))), lambda i: i["v"])
    by_package = findings.groupBy("pkg_id").agg(nested.alias("findings"), rank.alias("worst"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    empty = F.array().cast(by_package.schema["findings"].dataType)
    counts = F.struct(*[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in SEVERITIES]).alias("counts")
    rules = sorted({*(only or rule_ids()), "scan.empty-audit"})
    full = only is None or sorted(set(only)) == rule_ids()
    context = contexts(a, seen, named, config, rules, full, targets)
    target = targets if targets is not None else a.packages.select("pkg_id", F.lit("local-path").alias("kind"), F.col("pkg_id").alias("specifier"))
    fields = ["kind", "specifier", *[c for c in ("resolved",) if c in target.columns]]
    joined = a.packages.join(by_package, "pkg_id", "left").join(context, "pkg_id").join(target.select("pkg_id", F.struct(*fields).alias("target")), "pkg_id")
    scanner = F.struct(F.lit(config.tool).alias("name"), F.lit(config.version).alias("version"), F.lit(ran_at).alias("ranAt"))
    report = F.struct(
        F.lit(config.report_schema).alias("schema"), "target", scanner.alias("scanner"), F.struct(grade_of("worst").alias("grade"), counts).alias("summary"), F.coalesce("findings", empty).alias("findings"), F.col("context").alias(config.context_key)
    )
    return Scan(a, findings, seen, named, joined.select("pkg_id", report.alias("report")))


def contexts(a: Analysis, seen: DataFrame, named: DataFrame, config: AuditConfig, rules: list[str], full: bool, targets: DataFrame | None) -> DataFrame:
    """(pkg_id, context)."""
    profile = {"analyzerRevision": f"{config.tool}-analyzer/{config.version}", "ruleCatalogRevision": f"{config.tool}-rules/{config.version}", "rules": rules, "options": {}}
    files = a.files.groupBy("pkg_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("parse_error").isNotNull()).alias("failures"))
    failed = sorted_texts(a.files.where("parse_error is not null").select("pkg_id", "path"), "path", "failedFiles")
    found, lost = sorted_texts(a.entries, "node", "resolved_entries"), sorted_texts(a.unresolved, "hint", "unresolved_entries")
    omitted = sorted_items(a.omissions, "omissions", ["path", "reason"], ["reason", "path", "detail"])
    archive = a.packages.select("pkg_id", F.lit(None).cast("string").alias("archive_digest")) if targets is None or "archive_digest" not in targets.columns else targets.select("pkg_id", "archive_digest")
    rows = a.packages.join(input_digests(a), "pkg_id").join(a.manifests.select("pkg_id", "name"), "pkg_id", "left").join(archive, "pkg_id", "left")
    for part in (files, failed, found, lost, omitted, sorted_items(seen, "observations", ["kind", "file", "subject"], ["kind", "file", "subject", "count"]), sorted_items(named, "identities", ["rule", "variant", "file", "subject"], ["rule", "variant", "file", "subject", "finding", "count"])):
        rows = rows.join(part, "pkg_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    listed = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    some = F.lit(not full) | (zero("candidates") == 0) | (zero("failures") > 0) | (F.size(listed("unresolved_entries")) > 0) | (F.size(listed("omissions")) > 0)
    coverage = F.struct(
        F.when(some, "partial").otherwise("complete").alias("status"), zero("candidates").alias("candidateJs"), (zero("candidates") - zero("failures")).alias("parsed"), zero("failures").alias("parseFailures"), listed("failedFiles").alias("failedFiles"),
        F.struct(listed("resolved_entries").alias("resolved"), listed("unresolved_entries").alias("unresolved")).alias("entries"), listed("omissions").alias("omissions"), F.lit("not-scanned").alias("dependencyMode"), _texts(sorted(config.limitations)).alias("limitations"),
    )
    head = F.struct(
        F.lit(profile["analyzerRevision"]).alias("analyzerRevision"), F.lit(profile["ruleCatalogRevision"]).alias("ruleCatalogRevision"), _texts(rules).alias("rules"), F.create_map().cast("map<string,string>").alias("options"), F.lit(profile_digest(profile)).alias("digest")
    )
    subject = F.struct(F.col("name").alias("packageName"), F.col("digest").alias("analysisInputDigest"), F.lit(config.digest_kind).alias("digestKind"), F.col("archive_digest").alias("archiveDigest"))
    context = F.struct(F.lit(1).alias("version"), head.alias("profile"), coverage.alias("coverage"), subject.alias("subject"), listed("observations").alias("observations"), listed("identities").alias("findingIdentities"))
    return rows.select("pkg_id", context.alias("context"))


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def report_json(reports: DataFrame, pretty: bool = False) -> DataFrame:
    """(doc_id, json): absent fields are left out."""
    options = {"pretty": "true"} if pretty else {}
    return reports.select(F.col("pkg_id").alias("doc_id"), F.to_json("report", options).alias("json"))

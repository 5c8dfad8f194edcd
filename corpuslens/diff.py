"""Two reports compared: gates first, then full outer joins of identities and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import DEFAULT, AuditConfig
from .facts import text_key
from .operators.joins import full_diff, reasons
from .operators.staging import cut, merged
from .validate import validate_reports

_IDENTITY = ["rule", "variant", "file", "subject"]
_OBSERVATION = ["kind", "file", "subject"]


def _document_schema(config: AuditConfig) -> str:
    context = (
        "struct<profile:struct<digest:string>,coverage:struct<status:string>,subject:struct<packageName:string,analysisInputDigest:string,archiveDigest:string>,"
        "observations:array<struct<kind:string,file:string,subject:string,count:bigint>>,findingIdentities:array<struct<rule:string,variant:string,file:string,subject:string,finding:int,count:bigint>>>"
    )
    return f"scanner struct<name:string,version:string,ranAt:string>, summary struct<grade:string>, findings array<struct<id:string,severity:string,confidence:string>>, `{config.context_key}` {context}"


def read_sides(reports: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """(doc_id, ok, state, broken, r): each report once, checked and typed."""
    checked = validate_reports(reports, config, keep=True)
    base = F.exists("issues", lambda i: ~i["path"].startswith(config.context_key))
    return checked.select("doc_id", "ok", F.col("context").alias("state"), base.alias("broken"), F.from_json("json", _document_schema(config)).alias("r"))


def compare(pairs: DataFrame, reports: DataFrame, config: AuditConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Comparisons (pair_id, base_id, head_id, base, head, comparability, reasons), finding changes and observation changes.

    ``pairs``: pair_id, base_id, head_id, and label if subjects have none of their own. Only comparable pairs have
    changes: the gates are a filter below the joins.
    """
    sides = cut(read_sides(reports, config))
    label = F.col("label") if "label" in pairs.columns else F.lit(None).cast("string")
    side = lambda s: sides.select(F.col("doc_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("ok", "state", "broken", "r")])
    met = pairs.withColumn("_label", label).join(merged(side("base")), "base_id").join(merged(side("head")), "head_id")
    met = cut(met.withColumn("reasons", gates(config)))
    ref = lambda s: _reference(F.col(f"{s}_r"), config, F.when(F.col(f"{s}_ok") & (F.col(f"{s}_state") == "validated"), F.col("_label"))).alias(s)
    verdict = F.when(F.size("reasons") == 0, "comparable").otherwise("incomparable").alias("comparability")
    summary = met.select("pair_id", "base_id", "head_id", ref("base"), ref("head"), verdict, "reasons")
    fair = met.where(F.size("reasons") == 0)
    identities = lambda s: _exploded(fair, s, "findingIdentities", config)
    rows = lambda s: identities(s).select("pair_id", *[F.col(f"i.{k}") for k in _IDENTITY], F.coalesce("i.count", F.lit(1)).alias("count"), F.try_element_at("findings", F.col("i.finding") + 1).alias("f")).select("pair_id", *_IDENTITY, "count", "f.severity", "f.confidence")
    findings = full_diff(rows("base"), rows("head"), ["pair_id", *_IDENTITY], ["count", "severity", "confidence"])
    seen = lambda s: _exploded(fair, s, "observations", config).select("pair_id", *[F.col(f"i.{k}") for k in _OBSERVATION], F.coalesce("i.count", F.lit(1)).alias("count"))
    observed = full_diff(seen("base"), seen("head"), ["pair_id", *_OBSERVATION], ["count"])
    return summary, findings, observed


def gates(config: AuditConfig = DEFAULT) -> Column:
    """Why a pair can't be compared, in order. Invalid reports stop all else, then missing contexts do."""
    both = lambda f: [f("base"), f("head")]
    # the base's reason stands before the head's, of whichever kind
    invalid = F.array_compact(F.array(*[F.when(~F.col(f"{s}_ok"), F.when(F.col(f"{s}_broken"), f"report-invalid-{s}").otherwise(f"context-invalid-{s}")) for s in ("base", "head")]))
    missing = reasons(*[(F.col(f"{s}_state") == kind, f"context-{kind}-{s}") for kind in ("absent", "unsupported", "invalid") for s in ("base", "head")])
    c = lambda s, field: F.col(f"{s}_r")[config.context_key][field]
    differ = lambda path: ~path("base").eqNullSafe(path("head"))
    scanner = differ(lambda s: F.col(f"{s}_r")["scanner"]["name"]) | differ(lambda s: F.col(f"{s}_r")["scanner"]["version"])
    name = lambda s: c(s, "subject")["packageName"]
    unequal = reasons(
        *both(lambda s: (c(s, "findingIdentities").isNull(), f"identities-absent-{s}")), (scanner, "scanner-mismatch"), (differ(lambda s: c(s, "profile")["digest"]), "profile-mismatch"), (differ(name), "subject-mismatch"),
        (name("base").isNull() & name("head").isNull() & F.col("_label").isNull(), "subject-unlabeled"), *both(lambda s: (F.col(f"{s}_r")["summary"]["grade"] == "X", f"grade-x-{s}")),
        *both(lambda s: (c(s, "coverage")["status"] != "complete", f"coverage-partial-{s}")),
    )
    return F.when(F.size(invalid) > 0, invalid).when(F.size(missing) > 0, missing).otherwise(unequal)


def _reference(r: Column, config: AuditConfig, label: Column) -> Column:
    subject = r[config.context_key]["subject"]
    text = lambda v: F.coalesce(v, F.lit(""))
    scanner = F.struct(text(r["scanner"]["name"]).alias("name"), text(r["scanner"]["version"]).alias("version"), text(r["scanner"]["ranAt"]).alias("ranAt"))
    named = F.struct(label.alias("subjectLabel"), subject["packageName"].alias("packageName"), text(subject["analysisInputDigest"]).alias("analysisInputDigest"), subject["archiveDigest"].alias("archiveDigest"))
    return F.struct(scanner.alias("scanner"), F.coalesce(r["summary"]["grade"], F.lit("X")).alias("grade"), named.alias("subject"))


def _exploded(fair: DataFrame, side: str, field: str, config: AuditConfig) -> DataFrame:
    r = F.col(f"{side}_r")
    return fair.select("pair_id", r["findings"].alias("findings"), F.explode(r[config.context_key][field]).alias("i"))


def diff_documents(summary: DataFrame, findings: DataFrame, observed: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """(pair_id, diff): the changes nested, each list in UTF-16 order of its identity."""
    order = lambda keys: F.struct(*[text_key(k).alias(f"_{i}") for i, k in enumerate(keys)])

    def part(rows: DataFrame, keys: list[str], kinds: dict[str, tuple[str, Column]]) -> DataFrame:
        items = [F.transform(F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.struct(order(keys).alias("k"), item.alias("v"))))), lambda i: i["v"]).alias(name) for name, (kind, item) in kinds.items()]
        return rows.groupBy("pair_id").agg(*items)

    many = lambda side: F.when(F.col(f"{side}_count") > 1, F.col(f"{side}_count")).alias("count")
    identity = F.struct(*_IDENTITY)
    step = lambda a: F.struct(F.col(f"base_{a}").alias("base"), F.col(f"head_{a}").alias("head")).alias(a)
    f = part(findings, _IDENTITY, {
        "added": ("added", F.struct(*_IDENTITY, many("head"))), "removed": ("removed", F.struct(*_IDENTITY, many("base"))),
        "changed": ("changed", F.struct(identity.alias("identity"), step("count"), step("severity"), step("confidence"))), "unchanged": ("unchanged", F.struct(*_IDENTITY, many("head"))),
    })
    o = part(observed, _OBSERVATION, {
        "added": ("added", F.struct(*_OBSERVATION, many("head"))), "removed": ("removed", F.struct(*_OBSERVATION, many("base"))),
        "countChanged": ("changed", F.struct(F.struct(*_OBSERVATION, many("base")).alias("base"), F.struct(*_OBSERVATION, many("head")).alias("head"))), "unchanged": ("unchanged", F.struct(*_OBSERVATION, many("head"))),
    })
    full = lambda d, name: F.coalesce(F.col(f"{d}.{name}"), F.array().cast((f if d == "f" else o).schema[name].dataType)).alias(name)
    joined = summary.alias("s").join(merged(f).alias("f"), "pair_id", "left").join(merged(o).alias("o"), "pair_id", "left")
    diff = F.struct(
        F.lit(config.diff_schema).alias("schema"), F.col("s.base").alias("base"), F.col("s.head").alias("head"), "comparability", "reasons",
        F.struct(*[full("f", n) for n in ("added", "removed", "changed", "unchanged")]).alias("findings"), F.struct(*[full("o", n) for n in ("added", "removed", "countChanged", "unchanged")]).alias("observations"),
    )
    return joined.select("pair_id", diff.alias("diff"))

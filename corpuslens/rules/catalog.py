"""The fifteen rules and the automatic check for packages without JavaScript."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig
from ..facts import Analysis, by_locale, text_key
from ..functions import pick, sha256_id
from ..functions.hosts import endpoint_of, host_of
from ..operators.graph import closure
from ..operators.staging import merged
from .base import evidence, finding, subject

Parts = tuple[list[DataFrame], DataFrame]
LIFECYCLE = ("preinstall", "install", "postinstall")
FLOATING = ("", "*", "latest", "x", "X")
# The seam that each capability belongs to, in the order of the report.
SEAMS = {"fs": "fs", "fs-write": "fs", "shell": "shell", "net": "web", "workers": "workers"}
DESTRUCTIVE = [f"fs.{m}{s}" for m in ("rm", "unlink", "rmdir", "truncate") for s in ("", "Sync")] + [f"fs/promises.{m}" for m in ("rm", "unlink", "rmdir", "truncate")]
NET_IMPORT = "^(?:node:)?(?:net|http|https|http2|tls|dgram|dns|undici)$"
SHELL_IMPORT = "^(?:node:)?child_process$"
SECRET_CAPS = ("env", "homedir", "secret-read")


@dataclass(frozen=True)
class Rule:
    id: str
    variants: tuple[str, ...]
    run: Callable[[Analysis, AuditConfig], Parts]


RULES: dict[str, Rule] = {}


def rule(id_: str, *variants: str):
    def put(f: Callable[[Analysis, AuditConfig], Parts]):
        RULES[id_] = Rule(id_, variants, f)
        return f

    return put


def rule_ids() -> list[str]:
    return sorted(RULES)


def run_rules(analysis: Analysis, config: AuditConfig = DEFAULT, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, subjects) of the chosen rules; those not chosen are never planned. Unknown ids are an error.

    Findings have ``emit``: the place of rule and variant among all, which breaks ties of the report's order.
    """
    unknown = sorted(set(only or ()) - set(RULES))
    if unknown:
        raise ValueError(f"unknown rule ids: {', '.join(unknown)}")
    findings, subjects = [], []
    for place, id_ in enumerate(rule_ids()):
        if only is None or id_ in only:
            made, named = RULES[id_].run(analysis, config)
            findings += [f.withColumn("emit", F.lit(place * 10 + k)) for k, f in enumerate(made)]
            subjects.append(named)
    audit = analysis.packages.join(analysis.files.select("pkg_id").distinct(), "pkg_id", "left_anti")
    found, named = empty_audit(audit)
    return reduce(DataFrame.unionByName, [*findings, found.withColumn("emit", F.lit(10_000))]), reduce(DataFrame.unionByName, [*subjects, named])


def empty_audit(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages without JavaScript: silence would look like a clean pass."""
    rows = packages.select("pkg_id", F.lit(1).alias("ord"), evidence(F.lit("."), note=F.concat(F.lit("zero .js/.mjs/.cjs files (or Node-shebang bin scripts) found under "), "pkg_id")))
    found = finding(rows, "scan.empty-audit", "audit", "No analyzable JavaScript found in the target", "medium", "high", "Audit what ships: the published package, or a folder with the built output.")
    return found, subject(packages, "scan.empty-audit", "audit", F.lit("."), F.lit("no-analyzable-javascript"))


# --- dependencies ----------------------------------------------------------------------------------------------------


@rule("dep.install-scripts", "lifecycle")
def install_scripts(a: Analysis, c: AuditConfig) -> Parts:
    names = a.manifests.select("pkg_id", "scripts", F.posexplode(F.array(*map(F.lit, LIFECYCLE))).alias("ord", "name"))
    rows = names.withColumn("script", F.col("scripts")[F.col("name")]).where("script <> ''")
    seen = rows.select("pkg_id", "ord", evidence(F.lit("package.json"), snippet="script", note=F.concat("name", F.lit(" script runs when the package is installed"))))
    found = finding(seen, "dep.install-scripts", "lifecycle", "Runs code at install time", "medium", "high", "Remove the lifecycle script, or move the work to a build step and document why it must run on install.")
    return [found], subject(rows, "dep.install-scripts", "lifecycle", F.lit("package.json"), "name")


def dependencies(a: Analysis) -> DataFrame:
    return a.manifests.select("pkg_id", F.posexplode("dependencies").alias("ord", "d")).select("pkg_id", "ord", "d.name", "d.spec")


@rule("dep.floating-range", "floating")
def floating_range(a: Analysis, c: AuditConfig) -> Parts:
    rows = dependencies(a).where(F.regexp_replace("spec", r"^\s+|\s+$", "").isin(*FLOATING))
    seen = rows.select("pkg_id", "ord", evidence(F.lit("package.json"), note=F.format_string('"%s": "%s" — any future version satisfies this', "name", "spec")))
    found = finding(seen, "dep.floating-range", "floating", "Runtime dependencies resolve to whatever the registry serves", "medium", "high", "Pin to an exact version or a narrow range.")
    return [found], subject(rows, "dep.floating-range", "floating", F.lit("package.json"), "name")


@rule("dep.typosquat-proximity", "proximity")
def typosquat_proximity(a: Analysis, c: AuditConfig) -> Parts:
    popular = F.array(*map(F.lit, c.popular_names))
    near = dependencies(a).where(~F.col("name").isin(*c.popular_names)).select("pkg_id", "ord", "name", F.posexplode(popular).alias("k", "near"))
    distance = F.when(F.abs(F.length("name") - F.length("near")) <= 2, F.levenshtein("name", "near", 2)).otherwise(-1)
    hits = near.withColumn("distance", distance).where("distance >= 0")
    order = Window.partitionBy("pkg_id").orderBy("distance", by_locale("name"), "ord", "k")
    note = F.format_string('"%s" is %d edit%s from "%s"', "name", "distance", F.when(F.col("distance") == 1, "").otherwise("s"), "near")
    seen = hits.select("pkg_id", F.row_number().over(order).alias("ord"), "distance", evidence(F.lit("package.json"), note=note))
    severity = F.when(F.col("least") == 1, "high").otherwise("low")
    found = finding(seen, "dep.typosquat-proximity", "proximity", "Dependency name is one or two edits from a popular package", severity, "medium", "Verify that the dependency is the package you mean: spelling, repository, publisher.", most=10, count_rest=False, flags={"least": F.min("distance")})
    return [found], subject(hits.select("pkg_id", "name").distinct(), "dep.typosquat-proximity", "proximity", F.lit("package.json"), "name")


# --- egress ----------------------------------------------------------------------------------------------------------


@rule("egress.outbound-endpoints", "endpoints")
def outbound_endpoints(a: Analysis, c: AuditConfig) -> Parts:
    targets = a.nets.select("pkg_id", "ord", "file", "line", "snippet", F.posexplode("literals").alias("at", "literal"))
    site = F.struct("ord", "at", "file", "line", "snippet")
    firsts = targets.withColumn("endpoint", endpoint_of("literal")).where("endpoint <> ''").groupBy("pkg_id", "endpoint").agg(F.min(site).alias("s"))
    order = Window.partitionBy("pkg_id").orderBy(text_key("endpoint"))
    seen = firsts.select("pkg_id", F.row_number().over(order).alias("ord"), evidence("s.file", "s.line", "s.snippet", F.concat(F.lit("endpoint "), "endpoint")))
    found = finding(seen, "egress.outbound-endpoints", "endpoints", "Outbound endpoints the code can contact", "info", "high", "Document each endpoint; every host here is a data-flow decision.")
    hosts = targets.withColumn("host", host_of("literal")).where("host is not null").groupBy("pkg_id", "host").agg(F.min_by("file", F.struct("ord", "at")).alias("file"))
    return [found], subject(hosts, "egress.outbound-endpoints", "endpoints", "file", "host")


@rule("egress.secret-adjacent", "secret-adjacent")
def secret_adjacent(a: Analysis, c: AuditConfig) -> Parts:
    reads = a.caps.where(F.col("cap").isin(*SECRET_CAPS)).select("pkg_id", "file", "ord", "cap", "line", "snippet")
    holders = reads.select("pkg_id", F.col("file").alias("node")).distinct()
    reach = closure(a.edges, holders, ("pkg_id",)).select("pkg_id", "source", "node").union(holders.select("pkg_id", F.col("node").alias("source"), "node")).distinct()
    nets = a.nets.select("pkg_id", F.col("file").alias("node"), F.col("ord").alias("net_ord"), F.col("line").alias("net_line"), "api", "literals")
    met = reach.join(merged(nets), ["pkg_id", "node"])
    two = reads.withColumn("k", F.row_number().over(Window.partitionBy("pkg_id", "file").orderBy("ord"))).where("k <= 2").withColumnRenamed("file", "source")
    pairs = met.join(merged(two), ["pkg_id", "source"])
    what = pick(F.col("cap"), {"env": "process.env", "homedir": "the user home directory"}, "a credential-like file")
    note = F.format_string("reads %s; %s in %s:%d is statically reachable from here", what, "api", "node", "net_line")
    order = Window.partitionBy("pkg_id").orderBy(text_key("source"), "net_ord", "k")
    near = (F.col("node") == F.col("source")) & (F.size("literals") > 0)
    seen = pairs.select("pkg_id", F.row_number().over(order).alias("ord"), near.alias("near"), evidence("source", "line", "snippet", note))
    found = finding(
        seen, "egress.secret-adjacent", "secret-adjacent", "Network calls reachable from code that reads secrets", "high", F.when(F.col("same"), "medium").otherwise("low"),
        "Keep secret reads and network clients in separate modules, or document the data flow of each endpoint.", most=6, flags={"same": F.bool_or("near")},
    )
    return [found], subject(met.select("pkg_id", "source").distinct(), "egress.secret-adjacent", "secret-adjacent", "source", F.lit("secret-read-with-reachable-network"))


# --- obfuscation -----------------------------------------------------------------------------------------------------


@rule("obf.eval-detect", "dynamic", "literal")
def eval_detect(a: Analysis, c: AuditConfig) -> Parts:
    rows = lambda note: ["pkg_id", "ord", evidence("file", "line", "snippet", F.concat("kind", F.lit(note)))]
    dynamic, literal = a.evals.where("not literal"), a.evals.where("literal")
    found = [
        finding(dynamic.select(rows(" of a non-literal argument")), "obf.eval-detect", "dynamic", "Evaluates dynamically built code", "medium", "medium", "Replace eval and new Function with direct code; dynamic evaluation defeats static audit.", most=10),
        finding(literal.select(rows(" of a constant string — inert but still eval")), "obf.eval-detect", "literal", "Evaluates a literal string as code", "info", "high", "Move the code out of the string literal."),
    ]
    what = F.when(F.col("literal"), F.concat("kind", F.lit(":"), sha256_id("value"))).otherwise(F.col("kind"))
    return found, subject(a.evals, "obf.eval-detect", F.when(F.col("literal"), "literal").otherwise("dynamic"), "file", what)


@rule("obf.dynamic-require", "recoverable", "opaque")
def dynamic_require(a: Analysis, c: AuditConfig) -> Parts:
    known, opaque = a.dynamic.where("literals is not null"), a.dynamic.where("literals is null")
    value = F.try_element_at("literals", F.lit(1))
    known_note = F.format_string('%s of a concatenation that statically resolves to "%s"', "kind", value)
    opaque_note = F.concat("kind", F.lit(" of a runtime value — the loaded module cannot be determined statically"))
    title = "Loads modules through a computed specifier"
    found = [
        finding(known.select("pkg_id", "ord", evidence("file", "line", "snippet", known_note)), "obf.dynamic-require", "recoverable", title, "medium", "medium", "Use the plain specifier; concatenated module names hide the dependency from review."),
        finding(opaque.select("pkg_id", "ord", evidence("file", "line", "snippet", opaque_note)), "obf.dynamic-require", "opaque", title, "medium", "low", "Use plain specifiers so that the module graph stays auditable.", most=10),
    ]
    named = F.coalesce(value, F.lit("")) != ""
    return found, subject(a.dynamic, "obf.dynamic-require", F.when(named, "recoverable").otherwise("opaque"), "file", F.when(named, value).otherwise("runtime-value"))


@rule("obf.encoded-payload", "encoded")
def encoded_payload(a: Analysis, c: AuditConfig) -> Parts:
    note = F.format_string("%s literal, %d chars", "charset", F.length("value"))
    seen = a.encoded.select("pkg_id", "ord", evidence("file", "line", F.substring("value", 1, 80), note))
    found = finding(seen, "obf.encoded-payload", "encoded", "Long base64/hex string literals in shipped code", "medium", "low", "Decode payloads to plain assets, or ship them as files that a reviewer can open.", most=10)
    return [found], subject(a.encoded, "obf.encoded-payload", "encoded", "file", F.concat("charset", F.lit(":"), sha256_id("value")))


@rule("obf.charcode-chain", "charcode")
def charcode_chain(a: Analysis, c: AuditConfig) -> Parts:
    seen = a.charcodes.select("pkg_id", "ord", evidence("file", "line", None, F.format_string('decodes to "%s…"', "chars")))
    found = finding(seen, "obf.charcode-chain", "charcode", "Builds strings from character codes", "medium", "medium", "Write the string literal directly.")
    return [found], subject(a.charcodes, "obf.charcode-chain", "charcode", "file", sha256_id("chars"))


def in_file_order(files: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("pkg_id").orderBy(text_key("path")))


@rule("obf.unparseable", "unparseable")
def unparseable(a: Analysis, c: AuditConfig) -> Parts:
    broken = a.files.where("parse_error is not null").select("pkg_id", "path", "parse_error")
    seen = broken.select("pkg_id", in_file_order(broken).alias("ord"), evidence("path", note=F.concat(F.lit("parse error: "), F.substring("parse_error", 1, 120))))
    found = finding(seen, "obf.unparseable", "unparseable", "Shipped JS files that no standard parser accepts", "medium", "high", "Ship parseable source, or source maps that let tooling see the real code.", most=10, count_rest=False)
    return [found], subject(broken, "obf.unparseable", "unparseable", "path", F.lit("unparseable"))


# --- permissions -----------------------------------------------------------------------------------------------------


def seams(a: Analysis) -> DataFrame:
    """(pkg_id, declared, lower): only packages that declare seams."""
    return a.manifests.where("seams is not null").select("pkg_id", F.col("seams").alias("declared"), F.transform("seams", F.lower).alias("lower"))


def with_seam(rows: DataFrame, a: Analysis, seam: str) -> DataFrame:
    """``rows`` with ``has_seam``: true, false, or null without a declaration."""
    return rows.join(seams(a).select("pkg_id", F.array_contains("lower", seam).alias("has_seam")), "pkg_id", "left")


@rule("perm.seam-mismatch", "mismatch")
def seam_mismatch(a: Analysis, c: AuditConfig) -> Parts:
    table = F.array(*[F.struct(F.lit(cap).alias("cap"), F.lit(seam).alias("seam")) for cap, seam in SEAMS.items()])
    lacking = seams(a).select("pkg_id", "declared", "lower", F.posexplode(table).alias("rank", "t")).select("pkg_id", "declared", "rank", "t.cap", "t.seam", F.array_contains("lower", F.col("t.seam")).alias("has")).where("not has")
    first = a.caps.groupBy("pkg_id", "cap").agg(F.min_by(F.struct("file", "line", "snippet"), "ord").alias("s"))
    rows = lacking.join(first, ["pkg_id", "cap"])
    note = F.format_string("%s capability used; seam '%s' is not among the declared [%s]", "cap", "seam", F.array_join("declared", ", "))
    seen = rows.select("pkg_id", F.col("rank").alias("ord"), evidence("s.file", "s.line", "s.snippet", note))
    found = finding(seen, "perm.seam-mismatch", "mismatch", "Capability used but not declared in the seams", "medium", "medium", "Declare the seam, or drop the capability if it is not needed.")
    return [found], subject(rows, "perm.seam-mismatch", "mismatch", "s.file", "cap")


@rule("perm.undeclared-fs-write", "out-of-scope", "dynamic")
def undeclared_fs_write(a: Analysis, c: AuditConfig) -> Parts:
    def outside(path: Column) -> Column:
        inside = F.lit(False)
        for root in c.scope_roots:
            inside |= (path == root) | path.startswith(root + "/")
        return path.startswith("/") & ~inside

    writes = a.caps.where("cap = 'fs-write'").withColumn("target", F.try_element_at(F.filter("literals", outside), F.lit(1)))
    out, dynamic = writes.where("target is not null"), writes.where(F.size("literals") == 0)
    title = "Writes or deletes files outside any plausible plugin scope"
    found = [
        finding(
            out.select("pkg_id", "ord", "api", evidence("file", "line", "snippet", F.concat("api", F.lit(" with literal path "), "target"))), "perm.undeclared-fs-write", "out-of-scope",
            F.when(F.col("destructive"), "Destructive filesystem operations outside any plausible plugin scope").otherwise(title), F.when(F.col("destructive"), "critical").otherwise("high"), "high",
            "Keep writes inside the workspace or the plugin's own folder; derive paths from configuration.", most=10, flags={"destructive": F.bool_or(F.col("api").isin(*DESTRUCTIVE))},
        ),
        finding(
            dynamic.select("pkg_id", "ord", evidence("file", "line", "snippet", F.lit("review how the target is derived; the scanner cannot resolve it statically"))), "perm.undeclared-fs-write", "dynamic",
            "Write/delete target is a runtime value — scope not statically verifiable", "low", "low", "Keep the derivation next to the call, test that it stays in a fixed folder, and document the managed scope.", most=5,
        ),
    ]
    named = out.select("pkg_id", "file", F.lit("out-of-scope").alias("v"), "target").union(dynamic.select("pkg_id", "file", F.lit("dynamic"), F.lit("runtime-value")))
    return found, subject(named, "perm.undeclared-fs-write", F.col("v"), "file", "target")


def only_imported(a: Analysis, pattern: str, uses: DataFrame) -> DataFrame:
    """(pkg_id, path, module): files that import such a module and hold no use."""
    files = a.files.select("pkg_id", "path", F.filter("externals", lambda e: e.rlike(pattern)).alias("m")).where(F.size("m") > 0)
    return files.join(merged(uses.select("pkg_id", F.col("file").alias("path")).distinct()), ["pkg_id", "path"], "left_anti").select("pkg_id", "path", F.element_at("m", 1).alias("module"))


@rule("perm.subprocess-spawn", "spawn", "import-only")
def subprocess_spawn(a: Analysis, c: AuditConfig) -> Parts:
    uses = with_seam(a.caps.where("cap = 'shell'"), a, "shell")
    idle = only_imported(a, SHELL_IMPORT, uses)
    note = F.when(F.col("has_seam"), 'seam "shell" is declared').otherwise('no "shell" seam declared')
    found = [
        finding(uses.select("pkg_id", "ord", "has_seam", evidence("file", "line", "snippet", note)), "perm.subprocess-spawn", "spawn", "Spawns subprocesses", F.when(F.col("seam"), "info").otherwise("medium"), "high", "Declare the shell seam, or avoid spawning processes.", most=5, flags={"seam": F.bool_or("has_seam")}),
        finding(idle.select("pkg_id", in_file_order(idle).alias("ord"), evidence("path", note=F.lit("import present, no spawn/exec call site found"))), "perm.subprocess-spawn", "import-only", "Imports child_process without spawning anything", "info", "high", "Remove the unused import.", most=5, count_rest=False),
    ]
    named = uses.select("pkg_id", F.lit("spawn").alias("v"), "file", "api").union(idle.select("pkg_id", F.lit("import-only"), "path", F.lit("child_process")))
    return found, subject(named, "perm.subprocess-spawn", F.col("v"), "file", "api")


@rule("perm.network-client", "client", "import-only")
def network_client(a: Analysis, c: AuditConfig) -> Parts:
    uses = with_seam(a.nets, a, "web")
    idle = only_imported(a, NET_IMPORT, uses)
    target = F.when(F.array_join("literals", ", ") == "", "target not statically known").otherwise(F.array_join("literals", ", "))
    note = F.when(F.col("has_seam"), 'seam "web" is declared').otherwise(F.concat(F.lit('no "web" seam declared ('), target, F.lit(")")))
    found = [
        finding(uses.select("pkg_id", "ord", "has_seam", evidence("file", "line", "snippet", note)), "perm.network-client", "client", "Opens network connections", F.when(F.col("seam"), "info").otherwise("medium"), "high", "Declare the web seam, or drop the network access.", most=5, flags={"seam": F.bool_or("has_seam")}),
        finding(idle.select("pkg_id", in_file_order(idle).alias("ord"), evidence("path", note=F.lit("import present, no client call site"))), "perm.network-client", "import-only", "Imports network modules without an observable client call", "info", "high", "Remove the unused import.", most=5, count_rest=False),
    ]
    host = F.coalesce(host_of(F.try_element_at("literals", F.lit(1))), F.lit("runtime-target"))
    named = uses.select("pkg_id", F.lit("client").alias("v"), "file", host.alias("s")).union(idle.select("pkg_id", F.lit("import-only"), "path", "module"))
    return found, subject(named, "perm.network-client", F.col("v"), "file", "s")


@rule("perm.unreachable-files", "unreachable")
def unreachable_files(a: Analysis, c: AuditConfig) -> Parts:
    seen = a.unreachable.select("pkg_id", in_file_order(a.unreachable).alias("ord"), evidence("path", note=F.lit("no static import path from any entry point reaches this file")))
    found = finding(seen, "perm.unreachable-files", "unreachable", "Shipped files not reachable from any declared entry point", "info", "high", "Dead files still ship and can be required dynamically; delete them or wire them into the graph.", most=10, count_rest=False)
    return [found], subject(a.unreachable, "perm.unreachable-files", "unreachable", "path", F.lit("unreachable"))

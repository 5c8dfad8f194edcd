"""Every rule and fact relation over packages that the driver's tables turn into: a nation is a package, a customer a file.

A customer's segment picks one of a few sources, which are parsed and scanned for real; what they show is known from the
row that made them, so DuckDB derives the same facts and findings from the rows alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..facts import analyze, parsed_files
from ..functions import SEVERITIES
from ..report import scan
from ..rules import RULES, run_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The rows that files and packages come from; both sides begin with them.
ROWS = """
f AS (SELECT n_name AS pkg_id, n_nationkey, n_regionkey, 'src/c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '.js' AS file, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS k,
  c_mktsegment AS seg, c_acctbal AS bal, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT n_name AS pkg_id, n_nationkey, n_regionkey FROM nation)
"""


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def corpus(spark: SparkSession, sf_dir: str, code: dict[str, str] | None = None, manifest: str = "'{}'", other: dict[str, str] | None = None, index: str | None = None) -> DataFrame:
    """FILES_SCHEMA: a source for each customer of a segment in ``code``, a manifest for each nation, and ``other`` files of each package.

    code and manifest are SQL expressions over the rows; ``index`` is a predicate on the files that index.js requires.
    """
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_name AS pkg_id", "n_nationkey", "n_regionkey")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    files = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    files = files.withColumn("k", F.expr("lpad(cast(c_custkey AS string), 8, '0')")).withColumnsRenamed({"c_mktsegment": "seg", "c_acctbal": "bal", "c_name": "name"}).withColumn("file", F.expr("concat('src/c', k, '.js')"))
    none = F.lit(None).cast("string")

    def shaped(rows: DataFrame, path: Column, kind: str, content: Column) -> DataFrame:
        return rows.select("pkg_id", path.alias("path"), F.lit(kind).alias("kind"), content.cast("binary").alias("content"), none.alias("reason"), none.alias("detail"))

    parts = [shaped(nation, F.lit("package.json"), "manifest", F.expr(manifest))]
    if code:
        text = F.expr("CASE seg " + " ".join(f"WHEN '{s}' THEN {c}" for s, c in code.items()) + " END")
        parts.append(shaped(files.withColumn("text", text).where("text is not null"), F.col("file"), "source", F.col("text")))
    for path, text in (other or {}).items():
        parts.append(shaped(nation, F.lit(path), "source", F.expr(text)))
    if index:
        listed = files.where(index).groupBy("pkg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("file")), lambda x: F.concat(F.lit('require("./'), x, F.lit('");'))), "\n").alias("text"))
        parts.append(shaped(listed, F.lit("index.js"), "source", F.col("text")))
    return reduce(DataFrame.union, parts)


# --- rules -----------------------------------------------------------------------------------------------------------


def findings_of(rule: str, files: DataFrame) -> DataFrame:
    """A rule's findings, their evidence by its ends, and how many subjects they name."""
    found, named = RULES[rule].run(analyze(files), DEFAULT)
    return digest_of(reduce(DataFrame.unionByName, found), named)


def digest_of(found: DataFrame, named: DataFrame) -> DataFrame:
    first, last = F.element_at("evidence", 1), F.element_at("evidence", -1)
    rows = found.select(
        "pkg_id", "variant", "severity", "confidence", F.size("evidence").cast("long").alias("evidence"), first["file"].alias("first_file"), first["line"].cast("long").alias("first_line"), first["snippet"].alias("first_snippet"), first["note"].alias("first_note"), last["note"].alias("last_note")
    )
    return rows.join(named.groupBy("pkg_id", "variant").agg(F.count("*").alias("subjects"), F.min("subject").alias("least_subject")), ["pkg_id", "variant"])


def findings_sql(evidence: str, most: int | None = None, rest: bool = True, subjects: str = "SELECT pkg_id, variant, subject FROM e") -> str:
    """The same from evidence rows e(pkg_id, variant, severity, confidence, ord, file, line, snippet, note, subject); rest: the others are counted in a row of their own."""
    kept = f"least(c, {most})" if most else "c"
    size = f"least(c, {most + 1 if rest else most})" if most else "c"
    last = f"CASE WHEN c > {most} THEN '…and ' || (c - {most}) || ' more' END" if most and rest else "NULL"
    return f"""
WITH {ROWS}, e AS ({evidence}),
n AS (SELECT *, row_number() OVER (PARTITION BY pkg_id, variant ORDER BY ord) AS i, count(*) OVER (PARTITION BY pkg_id, variant) AS c FROM e),
s AS (SELECT pkg_id, variant, count(*) AS subjects, min(subject) AS least_subject FROM ({subjects}) GROUP BY 1, 2),
g AS (SELECT pkg_id, variant, min(severity) AS severity, min(confidence) AS confidence, CAST(max({size}) AS BIGINT) AS evidence, min(CASE WHEN i = 1 THEN file END) AS first_file,
  CAST(min(CASE WHEN i = 1 THEN line END) AS BIGINT) AS first_line, min(CASE WHEN i = 1 THEN snippet END) AS first_snippet, min(CASE WHEN i = 1 THEN note END) AS first_note,
  coalesce(min({last}), min(CASE WHEN i = {kept} THEN note END)) AS last_note FROM n GROUP BY 1, 2)
SELECT pkg_id, variant, severity, confidence, evidence, first_file, first_line, first_snippet, first_note, last_note, subjects, least_subject FROM g JOIN s USING (pkg_id, variant)
"""


SCRIPTS = """concat('{"name":"', pkg_id, '","scripts":{"test":"t","postinstall":"', CASE WHEN n_regionkey < 2 THEN concat('node p', n_nationkey, '.js') ELSE '' END, '","install":"', CASE WHEN n_regionkey = 0 THEN 'make' ELSE '' END, '"}}')"""


@query(
    findings_sql(
        """SELECT pkg_id, 'lifecycle' AS variant, 'medium' AS severity, 'high' AS confidence, ord, 'package.json' AS file, NULL AS line, script AS snippet, s || ' script runs when the package is installed' AS note, s AS subject
FROM (SELECT pkg_id, 1 AS ord, 'install' AS s, 'make' AS script FROM p WHERE n_regionkey = 0 UNION ALL SELECT pkg_id, 2, 'postinstall', 'node p' || n_nationkey || '.js' FROM p WHERE n_regionkey < 2)"""
    )
)
def rule_install_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("dep.install-scripts", corpus(spark, sf_dir, manifest=SCRIPTS))


SPECS = """concat('{"dependencies":{"alpha":"', CASE n_regionkey WHEN 0 THEN '*' WHEN 1 THEN ' latest ' WHEN 2 THEN 'X' WHEN 3 THEN '^1.0.0' ELSE '' END, '","beta":"1.2.3","gamma":"', CASE WHEN n_nationkey >= 12 THEN 'latest' ELSE '~2.0.0' END, '"}}')"""


@query(
    findings_sql(
        """SELECT pkg_id, 'floating' AS variant, 'medium' AS severity, 'high' AS confidence, ord, 'package.json' AS file, NULL AS line, NULL AS snippet, '"' || s || '": "' || spec || '" — any future version satisfies this' AS note, s AS subject
FROM (SELECT pkg_id, 0 AS ord, 'alpha' AS s, CASE n_regionkey WHEN 0 THEN '*' WHEN 1 THEN ' latest ' WHEN 2 THEN 'X' ELSE '' END AS spec FROM p WHERE n_regionkey <> 3
UNION ALL SELECT pkg_id, 2, 'gamma', 'latest' FROM p WHERE n_nationkey >= 12)"""
    )
)
def rule_floating_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("dep.floating-range", corpus(spark, sf_dir, manifest=SPECS))


NAMES = """concat('{"dependencies":{"', CASE n_regionkey WHEN 0 THEN 'reakt' WHEN 1 THEN 'lodahs' WHEN 2 THEN 'chalk' WHEN 3 THEN 'expres' ELSE 'axois' END, '":"1.0.0","eslin', CASE WHEN n_nationkey < 10 THEN '' ELSE 't' END, '":"1.0.0"}}')"""


@query(
    findings_sql(
        f"""SELECT pkg_id, 'proximity' AS variant, CASE WHEN min(d) OVER (PARTITION BY pkg_id) = 1 THEN 'high' ELSE 'low' END AS severity, 'medium' AS confidence, d * 1000 + row_number() OVER (PARTITION BY pkg_id, d ORDER BY s, near) AS ord,
  'package.json' AS file, NULL AS line, NULL AS snippet, '"' || s || '" is ' || d || ' edit' || CASE WHEN d = 1 THEN '' ELSE 's' END || ' from "' || near || '"' AS note, s AS subject
FROM (SELECT pkg_id, s, near, levenshtein(s, near) AS d FROM (
    SELECT pkg_id, CASE n_regionkey WHEN 0 THEN 'reakt' WHEN 1 THEN 'lodahs' WHEN 2 THEN 'chalk' WHEN 3 THEN 'expres' ELSE 'axois' END AS s FROM p UNION ALL SELECT pkg_id, 'eslin' || CASE WHEN n_nationkey < 10 THEN '' ELSE 't' END FROM p),
  (SELECT unnest([{', '.join(f"'{x}'" for x in DEFAULT.popular_names)}]) AS near) WHERE s NOT IN ({', '.join(f"'{x}'" for x in DEFAULT.popular_names)})) WHERE d <= 2""",
        most=10,
        rest=False,
        subjects="SELECT DISTINCT pkg_id, variant, subject FROM e",
    )
)
def rule_typosquat_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("dep.typosquat-proximity", corpus(spark, sf_dir, manifest=NAMES))


ENDPOINTS = {
    "MACHINERY": """'new WebSocket("wss://push.example.com:8443/x");'""",
    "HOUSEHOLD": """concat('\\nfetch(`https://HOUSE', n_nationkey, '.example.com/v1`);')""",
    "BUILDING": """'fetch("relative/path", "https://user@second.example.com:443/q?x");'""",
    "FURNITURE": "'fetch(target);'",
    "AUTOMOBILE": "'module.exports = 1;'",
}
TARGETS = """
FROM f JOIN (SELECT 'MACHINERY' AS seg, 'push.example.com:8443' AS e, 'push.example.com:8443' AS h, 1 AS line, 'new WebSocket("wss://push.example.com:8443/x");' AS snippet
UNION ALL SELECT 'HOUSEHOLD', 'house', 'house', 2, 'fetch' UNION ALL SELECT 'BUILDING', 'relative/path', 'relative', 1, 'fetch("relative/path", "https://user@second.example.com:443/q?x");'
UNION ALL SELECT 'BUILDING', 'second.example.com', 'second.example.com', 1, 'fetch("relative/path", "https://user@second.example.com:443/q?x");') t USING (seg)
"""


@query(
    findings_sql(
        f"""SELECT pkg_id, 'endpoints' AS variant, 'info' AS severity, 'high' AS confidence, x AS ord, min(file) AS file, min(line) AS line, min(snippet) AS snippet, 'endpoint ' || x AS note, x AS subject
FROM (SELECT pkg_id, file, line, CASE WHEN e = 'house' THEN 'house' || n_nationkey || '.example.com' ELSE e END AS x, CASE WHEN e = 'house' THEN 'fetch(`https://HOUSE' || n_nationkey || '.example.com/v1`);' ELSE snippet END AS snippet {TARGETS}) GROUP BY pkg_id, x""",
        subjects=f"SELECT DISTINCT pkg_id, 'endpoints' AS variant, CASE WHEN h = 'house' THEN 'house' || n_nationkey || '.example.com' ELSE h END AS subject {TARGETS}",
    )
)
def rule_outbound_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("egress.outbound-endpoints", corpus(spark, sf_dir, ENDPOINTS))


SECRETS = {
    "BUILDING": """'const t = process.env.TOKEN;\\nfetch("https://x.example.com/");'""",
    "AUTOMOBILE": """'const a = process.env.A, b = process.env.B;\\nconst os = require("os"); os.homedir();\\nrequire("../net.js");'""",
    "MACHINERY": "'module.exports = 1;'",
}


@query(
    findings_sql(
        """SELECT pkg_id, 'secret-adjacent' AS variant, 'high' AS severity, CASE WHEN bool_or(seg = 'BUILDING') OVER (PARTITION BY pkg_id) THEN 'medium' ELSE 'low' END AS confidence, file || line AS ord, file, line, snippet, note, 'secret-read-with-reachable-network' AS subject
FROM (SELECT pkg_id, seg, file, 1 AS line, 'const t = process.env.TOKEN;' AS snippet, 'reads process.env; fetch in ' || file || ':2 is statically reachable from here' AS note FROM f WHERE seg = 'BUILDING'
UNION ALL SELECT pkg_id, seg, file, 1, 'const a = process.env.A, b = process.env.B;', 'reads process.env; fetch in net.js:1 is statically reachable from here' FROM f WHERE seg = 'AUTOMOBILE'
UNION ALL SELECT pkg_id, seg, file, 2, 'const os = require("os"); os.homedir();', 'reads the user home directory; fetch in net.js:1 is statically reachable from here' FROM f WHERE seg = 'AUTOMOBILE')""",
        most=6,
        subjects="SELECT DISTINCT pkg_id, variant, file, subject FROM e",
    )
)
def rule_secret_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("egress.secret-adjacent", corpus(spark, sf_dir, SECRETS, other={"net.js": "'fetch(process.argv[2]);'"}, index="seg in ('BUILDING', 'AUTOMOBILE', 'MACHINERY')"))


EVALS = {"HOUSEHOLD": """concat('eval("', k, '");')""", "MACHINERY": "'eval(data);'", "FURNITURE": """'\\nvar f = new Function("return " + x);'""", "BUILDING": "'evaluate(1); Function(x);'"}


@query(
    findings_sql(
        """SELECT pkg_id, 'literal' AS variant, 'info' AS severity, 'high' AS confidence, file AS ord, file, 1 AS line, 'eval("' || k || '");' AS snippet, 'eval of a constant string — inert but still eval' AS note, 'eval:sha256:' || sha256(k) AS subject FROM f WHERE seg = 'HOUSEHOLD'
UNION ALL SELECT pkg_id, 'dynamic', 'medium', 'medium', file, file, CASE WHEN seg = 'MACHINERY' THEN 1 ELSE 2 END, CASE WHEN seg = 'MACHINERY' THEN 'eval(data);' ELSE 'var f = new Function("return " + x);' END,
  CASE WHEN seg = 'MACHINERY' THEN 'eval' ELSE 'Function' END || ' of a non-literal argument', CASE WHEN seg = 'MACHINERY' THEN 'eval' ELSE 'Function' END FROM f WHERE seg IN ('MACHINERY', 'FURNITURE')""",
        most=10,
    ).replace("least(c, 11)", "CASE WHEN variant = 'literal' THEN c ELSE least(c, 11) END").replace("i = least(c, 10)", "i = CASE WHEN variant = 'literal' THEN c ELSE least(c, 10) END").replace("WHEN c > 10", "WHEN variant = 'dynamic' AND c > 10")
)
def rule_eval_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("obf.eval-detect", corpus(spark, sf_dir, EVALS))


LOADS = {"HOUSEHOLD": """'require("lo" + "dash");'""", "MACHINERY": "'require(name);'", "FURNITURE": "concat('import(`./x$', '{y}`);')", "BUILDING": """'require("./plain.js");'"""}


@query(
    findings_sql(
        """SELECT pkg_id, 'recoverable' AS variant, 'medium' AS severity, 'medium' AS confidence, file AS ord, file, 1 AS line, 'require("lo" + "dash");' AS snippet, 'require of a concatenation that statically resolves to "lodash"' AS note, 'lodash' AS subject FROM f WHERE seg = 'HOUSEHOLD'
UNION ALL SELECT pkg_id, 'opaque', 'medium', 'low', file, file, 1, CASE WHEN seg = 'MACHINERY' THEN 'require(name);' ELSE 'import(`./x${y}`);' END,
  CASE WHEN seg = 'MACHINERY' THEN 'require' ELSE 'import' END || ' of a runtime value — the loaded module cannot be determined statically', 'runtime-value' FROM f WHERE seg IN ('MACHINERY', 'FURNITURE')""",
        most=10,
    ).replace("least(c, 11)", "CASE WHEN variant = 'recoverable' THEN c ELSE least(c, 11) END").replace("i = least(c, 10)", "i = CASE WHEN variant = 'recoverable' THEN c ELSE least(c, 10) END").replace("WHEN c > 10", "WHEN variant = 'opaque' AND c > 10")
)
def rule_dynamic_require(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("obf.dynamic-require", corpus(spark, sf_dir, LOADS))


PAYLOADS = {"MACHINERY": """concat('const a = "', upper(sha2(name, 256)), '";')""", "HOUSEHOLD": """concat('\\n\\nconst a = "', sha2(name, 256), '";')""", "BUILDING": """concat('const a = "', substr(sha2(name, 256), 1, 47), '";')""", "FURNITURE": """'const a = "0101010101010101010101010101010101010101010101010101";'"""}


@query(
    findings_sql(
        """SELECT pkg_id, 'encoded' AS variant, 'medium' AS severity, 'low' AS confidence, file AS ord, file, CASE WHEN seg = 'MACHINERY' THEN 1 ELSE 3 END AS line, v AS snippet, kind || ' literal, 64 chars' AS note, kind || ':sha256:' || sha256(v) AS subject
FROM (SELECT *, CASE WHEN seg = 'MACHINERY' THEN upper(sha256(name)) ELSE sha256(name) END AS v, CASE WHEN seg = 'MACHINERY' THEN 'base64' ELSE 'hex' END AS kind FROM f WHERE seg IN ('MACHINERY', 'HOUSEHOLD'))""",
        most=10,
    )
)
def rule_encoded_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("obf.encoded-payload", corpus(spark, sf_dir, PAYLOADS))


CODES = {"HOUSEHOLD": "concat('String.fromCharCode(', array_join(transform(split(k, ''), c -> ascii(c)), ','), ');')", "BUILDING": "'String.fromCharCode(72, 69, 76, 76, 79, 33, 33);'", "MACHINERY": "'String.fromCodePoint(72, 69, 76, 76, 79, 33, 33, 33);'"}


@query(findings_sql("""SELECT pkg_id, 'charcode' AS variant, 'medium' AS severity, 'medium' AS confidence, file AS ord, file, 1 AS line, NULL AS snippet, 'decodes to "' || k || '…"' AS note, 'sha256:' || sha256(k) AS subject FROM f WHERE seg = 'HOUSEHOLD'"""))
def rule_charcode_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("obf.charcode-chain", corpus(spark, sf_dir, CODES))


BROKEN = {"MACHINERY": "'var = 1;'", "HOUSEHOLD": "'return 1;'", "BUILDING": "'import a from \"b\";'"}


@query(
    findings_sql(
        """SELECT pkg_id, 'unparseable' AS variant, 'medium' AS severity, 'high' AS confidence, file AS ord, file, NULL AS line, NULL AS snippet, 'parse error: Unexpected token (1:4)' AS note, 'unparseable' AS subject FROM f WHERE seg = 'MACHINERY'""",
        most=10,
        rest=False,
    )
)
def rule_unparseable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("obf.unparseable", corpus(spark, sf_dir, BROKEN))


SEAM_MANIFEST = """concat('{"plugin":{', CASE n_regionkey WHEN 0 THEN '"seams":["FS"]' WHEN 1 THEN '"seams":["web","Shell"]' WHEN 2 THEN '"seams":[]' WHEN 3 THEN '' ELSE '"seams":"all"' END, '}}')"""
USES = {
    "HOUSEHOLD": """'const fs = require("fs");\\nfs.readFileSync("a.txt");'""",
    "MACHINERY": """'const fs = require("fs");\\nfs.rmSync("/tmp/x");'""",
    "FURNITURE": """'const cp = require("child_process");\\ncp.execSync("ls");'""",
    "BUILDING": """'fetch("https://a.example.com");'""",
    "AUTOMOBILE": """'const { Worker } = require("worker_threads");\\nnew Worker("./x.js");'""",
}
#: Capability uses of these sources: segment, capability, line, api, literal, snippet.
USED = """(SELECT * FROM (VALUES ('HOUSEHOLD', 'fs', 2, 'fs.readFileSync', 'a.txt', 'fs.readFileSync("a.txt");'), ('MACHINERY', 'fs', 2, 'fs.rmSync', '/tmp/x', 'fs.rmSync("/tmp/x");'), ('MACHINERY', 'fs-write', 2, 'fs.rmSync', '/tmp/x', 'fs.rmSync("/tmp/x");'),
  ('FURNITURE', 'shell', 2, 'child_process.execSync', 'ls', 'cp.execSync("ls");'), ('BUILDING', 'net', 1, 'fetch', 'https://a.example.com', 'fetch("https://a.example.com");'), ('AUTOMOBILE', 'workers', 2, 'worker_threads.Worker', './x.js', 'new Worker("./x.js");')) AS u(seg, cap, line, api, literal, snippet))"""


@query(
    findings_sql(
        f"""SELECT pkg_id, 'mismatch' AS variant, 'medium' AS severity, 'medium' AS confidence, rank AS ord, first.file AS file, line, first.snippet AS snippet, cap || ' capability used; seam ''' || seam || ''' is not among the declared [' || declared || ']' AS note, cap AS subject
FROM (SELECT pkg_id, n_regionkey, cap, min(line) AS line, min(struct_pack(file := file, snippet := snippet)) AS first FROM f JOIN {USED} USING (seg) GROUP BY 1, 2, 3)
JOIN (VALUES ('fs', 'fs', 0), ('fs-write', 'fs', 1), ('shell', 'shell', 2), ('net', 'web', 3), ('workers', 'workers', 4)) AS t(cap, seam, rank) USING (cap)
JOIN (VALUES (0, 'FS', ['fs']), (1, 'web, Shell', ['web', 'shell']), (2, '', [])) AS d(n_regionkey, declared, lower) USING (n_regionkey) WHERE NOT list_contains(lower, seam)"""
    )
)
def rule_seam_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("perm.seam-mismatch", corpus(spark, sf_dir, USES, SEAM_MANIFEST))


WRITES = {
    "HOUSEHOLD": """concat('const fs = require("fs");\\nfs.writeFileSync("/opt/', k, '");')""",
    "FURNITURE": """concat('const fs = require("fs");\\nfs.', CASE WHEN bal > 5000 THEN 'rmSync' ELSE 'appendFileSync' END, '("/etc/', k, '");')""",
    "BUILDING": """concat('const fs = require("fs");\\nfs.unlinkSync("/tmp/', k, '");')""",
    "MACHINERY": """'const fs = require("node:fs");\\nfs.writeFile(target, 1);'""",
}
WRITTEN = """SELECT pkg_id, file, 'fs.writeFileSync' AS api, '/opt/' || k AS target FROM f WHERE seg = 'HOUSEHOLD' UNION ALL SELECT pkg_id, file, 'fs.' || CASE WHEN bal > 5000 THEN 'rmSync' ELSE 'appendFileSync' END, '/etc/' || k FROM f WHERE seg = 'FURNITURE'"""


@query(
    findings_sql(
        f"""SELECT pkg_id, 'out-of-scope' AS variant, CASE WHEN bool_or(api = 'fs.rmSync') OVER (PARTITION BY pkg_id) THEN 'critical' ELSE 'high' END AS severity, 'high' AS confidence, file AS ord, file, 2 AS line, api || '("' || target || '");' AS snippet, api || ' with literal path ' || target AS note, target AS subject FROM ({WRITTEN})
UNION ALL SELECT pkg_id, 'dynamic', 'low', 'low', file, file, 2, 'fs.writeFile(target, 1);', 'review how the target is derived; the scanner cannot resolve it statically', 'runtime-value' FROM f WHERE seg = 'MACHINERY'""",
        most=10,
    ).replace("least(c, 11)", "least(c, CASE WHEN variant = 'dynamic' THEN 6 ELSE 11 END)").replace("i = least(c, 10)", "i = least(c, CASE WHEN variant = 'dynamic' THEN 5 ELSE 10 END)").replace("CASE WHEN c > 10 THEN '…and ' || (c - 10)", "CASE WHEN c > CASE WHEN variant = 'dynamic' THEN 5 ELSE 10 END THEN '…and ' || (c - CASE WHEN variant = 'dynamic' THEN 5 ELSE 10 END)")
)
def rule_undeclared_fs_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("perm.undeclared-fs-write", corpus(spark, sf_dir, WRITES))


SPAWNS = {"FURNITURE": USES["FURNITURE"], "MACHINERY": """'const cp = require("node:child_process");'""", "BUILDING": "'exec(1);'"}


@query(
    findings_sql(
        """SELECT pkg_id, 'spawn' AS variant, CASE WHEN n_regionkey = 1 THEN 'info' ELSE 'medium' END AS severity, 'high' AS confidence, file AS ord, file, 2 AS line, 'cp.execSync("ls");' AS snippet, CASE WHEN n_regionkey = 1 THEN 'seam "shell" is declared' ELSE 'no "shell" seam declared' END AS note, 'child_process.execSync' AS subject FROM f WHERE seg = 'FURNITURE'
UNION ALL SELECT pkg_id, 'import-only', 'info', 'high', file, file, NULL, NULL, 'import present, no spawn/exec call site found', 'child_process' FROM f WHERE seg = 'MACHINERY'""",
        most=5,
    ).replace("least(c, 6)", "least(c, CASE WHEN variant = 'spawn' THEN 6 ELSE 5 END)").replace("WHEN c > 5", "WHEN variant = 'spawn' AND c > 5")
)
def rule_subprocess_spawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("perm.subprocess-spawn", corpus(spark, sf_dir, SPAWNS, SEAM_MANIFEST))


CLIENTS = {"BUILDING": """'fetch("https://a.example.com/", "b");'""", "MACHINERY": "'fetch(t);'", "FURNITURE": """'const h = require("http");'""", "HOUSEHOLD": """'const h = require("https");\\nh.get("https://b.example.com/", x);'"""}


@query(
    findings_sql(
        """SELECT pkg_id, 'client' AS variant, CASE WHEN n_regionkey = 1 THEN 'info' ELSE 'medium' END AS severity, 'high' AS confidence, file AS ord, file, line, snippet, CASE WHEN n_regionkey = 1 THEN 'seam "web" is declared' ELSE 'no "web" seam declared (' || target || ')' END AS note, host AS subject
FROM f JOIN (VALUES ('BUILDING', 1, 'fetch("https://a.example.com/", "b");', 'https://a.example.com/, b', 'a.example.com'), ('MACHINERY', 1, 'fetch(t);', 'target not statically known', 'runtime-target'), ('HOUSEHOLD', 2, 'h.get("https://b.example.com/", x);', 'https://b.example.com/', 'b.example.com')) AS u(seg, line, snippet, target, host) USING (seg)
UNION ALL SELECT pkg_id, 'import-only', 'info', 'high', file, file, NULL, NULL, 'import present, no client call site', 'http' FROM f WHERE seg = 'FURNITURE'""",
        most=5,
    ).replace("least(c, 6)", "least(c, CASE WHEN variant = 'client' THEN 6 ELSE 5 END)").replace("WHEN c > 5", "WHEN variant = 'client' AND c > 5")
)
def rule_network_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("perm.network-client", corpus(spark, sf_dir, CLIENTS, SEAM_MANIFEST))


EMPTY = dict.fromkeys(("HOUSEHOLD", "MACHINERY", "BUILDING"), "'module.exports = 1;'")


@query(
    findings_sql(
        """SELECT pkg_id, 'unreachable' AS variant, 'info' AS severity, 'high' AS confidence, file AS ord, file, NULL AS line, NULL AS snippet, 'no static import path from any entry point reaches this file' AS note, 'unreachable' AS subject FROM f WHERE seg = 'MACHINERY'
OR seg IN ('HOUSEHOLD', 'BUILDING') AND NOT EXISTS (SELECT 1 FROM f g WHERE g.pkg_id = f.pkg_id AND g.seg <> 'MACHINERY')""",
        most=10,
        rest=False,
    )
)
def rule_unreachable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of("perm.unreachable-files", corpus(spark, sf_dir, EMPTY, """'{"main":"./index"}'""", index="seg in ('HOUSEHOLD', 'BUILDING')"))


@query(
    findings_sql(
        """SELECT pkg_id, 'audit' AS variant, 'medium' AS severity, 'high' AS confidence, 1 AS ord, '.' AS file, NULL AS line, NULL AS snippet, 'zero .js/.mjs/.cjs files (or Node-shebang bin scripts) found under ' || pkg_id AS note, 'no-analyzable-javascript' AS subject
FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.pkg_id = p.pkg_id AND seg = 'MACHINERY' AND bal > 9000)"""
    )
)
def rule_empty_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, named = run_rules(analyze(corpus(spark, sf_dir, {"MACHINERY": "CASE WHEN bal > 9000 THEN '1;' END"})), only=["obf.unparseable"])
    return digest_of(found.where("rule = 'scan.empty-audit'").drop("emit"), named.where("rule = 'scan.empty-audit'"))


# --- facts -----------------------------------------------------------------------------------------------------------


def relation(files: DataFrame, name: str) -> DataFrame:
    """The rows of one fact list of every parsed file, numbered in the order of the walk."""
    return parsed_files(files).select("pkg_id", F.col("path").alias("file"), F.posexplode(name).alias("place", "x")).select("pkg_id", "file", F.col("place").cast("long").alias("place"), "x.*").withColumn("line", F.col("line").cast("long"))


def facts_sql(columns: str, rows: str) -> str:
    """Facts of each segment's source: (seg, place, line, ...) literals joined with the files."""
    return f"WITH {ROWS}, u(seg, place, line, {columns}) AS (VALUES {rows}) SELECT pkg_id, file, CAST(place AS BIGINT) AS place, CAST(line AS BIGINT) AS line, {columns} FROM f JOIN u USING (seg)"


@query(f"WITH {ROWS} SELECT pkg_id, file, CASE seg WHEN 'HOUSEHOLD' THEN 'script' WHEN 'BUILDING' THEN 'module' END AS goal, CASE WHEN seg = 'MACHINERY' THEN 'Unexpected token (1:4)' END AS parse_error, CAST(CASE seg WHEN 'MACHINERY' THEN 8 WHEN 'HOUSEHOLD' THEN 9 ELSE 18 END AS BIGINT) AS bytes FROM f WHERE seg IN ('MACHINERY', 'HOUSEHOLD', 'BUILDING')")
def fact_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse goals: modules, else scripts with a top-level return, else the first error."""
    return parsed_files(corpus(spark, sf_dir, BROKEN)).select("pkg_id", F.col("path").alias("file"), F.col("source_type").alias("goal"), "parse_error", "bytes")


IMPORTS = {
    "HOUSEHOLD": """'import a, { b as c } from "node:fs";\\nimport * as d from "./util/x";\\nexport { e } from "../up.js";\\nexport * from "#inner";'""",
    "MACHINERY": """'const { f } = require("./" + "g");\\nconst h = require(`scope`);\\nimport("late");\\nrequire("../../out");'""",
    "BUILDING": """'export const i = 1;\\nrequire(j);\\nimport "@scope/side";'""",
}


@query(
    facts_sql(
        "specifier, base",
        """('HOUSEHOLD', 3, 1, 'node:fs', NULL), ('HOUSEHOLD', 2, 2, './util/x', 'src/util/x'), ('HOUSEHOLD', 1, 3, '../up.js', 'up.js'), ('HOUSEHOLD', 0, 4, '#inner', NULL),
('MACHINERY', 1, 1, './g', 'src/g'), ('MACHINERY', 3, 2, 'scope', NULL), ('MACHINERY', 4, 2, 'scope', NULL), ('MACHINERY', 2, 3, 'late', NULL), ('MACHINERY', 0, 4, '../../out', NULL), ('BUILDING', 0, 3, '@scope/side', NULL)""",
    )
)
def fact_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module references of every form, in their order by name, and relative ones as paths of the package; a bound require counts as a declaration and as a call."""
    return relation(corpus(spark, sf_dir, IMPORTS), "imports")


@query(f"WITH {ROWS}, u AS (SELECT * FROM (VALUES ('HOUSEHOLD', 'node:fs'), ('MACHINERY', 'late'), ('MACHINERY', 'scope'), ('BUILDING', '@scope/side')) AS v(seg, module)) SELECT pkg_id, module, count(*) AS files FROM f JOIN u USING (seg) GROUP BY 1, 2")
def fact_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct foreign modules of each package."""
    return parsed_files(corpus(spark, sf_dir, IMPORTS)).select("pkg_id", F.explode("externals").alias("module")).groupBy("pkg_id", "module").agg(F.count("*").alias("files"))


CAPS = {
    "HOUSEHOLD": """'import { readFileSync as r, rmSync } from "fs";\\nr("a"); r("a");\\nrmSync(`b`, "c");\\nprocess.env.X;'""",
    "MACHINERY": """'const os = require("os"), fs = require("node:fs/promises");\\nos.userInfo();\\nfs.readFile("/home/me/.npmrc");\\nfs.readFile("notes/token.txt");\\nfs.watch("x");'""",
    "FURNITURE": """'import http from "https";\\nhttp.request({}, "u");\\nimport { spawn } from "child_process";\\nspawn("ls", ["-l"]);\\nimport * as t from "worker_threads";\\nt(1);'""",
    "BUILDING": """concat('function env() { return process["env"]; }\\nfetch(`https://$', '{h}/`);\\nnew WebSocket("ws://w.example.com");\\nnet.connect(1);')""",
}


@query(
    facts_sql(
        "cap, api, literals, snippet",
        """('HOUSEHOLD', 0, 2, 'fs', 'fs.readFileSync', 'a', 'r("a"); r("a");'), ('HOUSEHOLD', 1, 3, 'fs', 'fs.rmSync', 'b|c', 'rmSync(`b`, "c");'), ('HOUSEHOLD', 2, 3, 'fs-write', 'fs.rmSync', 'b|c', 'rmSync(`b`, "c");'), ('HOUSEHOLD', 3, 4, 'env', 'process.env', '', 'process.env.X;'),
('MACHINERY', 0, 2, 'homedir', 'os.userInfo', '', 'os.userInfo();'), ('MACHINERY', 1, 3, 'fs', 'fs/promises.readFile', '/home/me/.npmrc', 'fs.readFile("/home/me/.npmrc");'), ('MACHINERY', 2, 3, 'secret-read', 'fs/promises.readFile', '/home/me/.npmrc', 'fs.readFile("/home/me/.npmrc");'),
('MACHINERY', 3, 4, 'fs', 'fs/promises.readFile', 'notes/token.txt', 'fs.readFile("notes/token.txt");'),
('FURNITURE', 0, 2, 'net', 'https.request', 'u', 'http.request({}, "u");'), ('FURNITURE', 1, 4, 'shell', 'child_process.spawn', 'ls', 'spawn("ls", ["-l"]);'), ('FURNITURE', 2, 6, 'workers', 'worker_threads', '', 't(1);'),
('BUILDING', 0, 2, 'net', 'fetch', '', 'fetch(`https://${h}/`);'), ('BUILDING', 1, 3, 'net', 'WebSocket', 'ws://w.example.com', 'new WebSocket("ws://w.example.com");'), ('BUILDING', 2, 4, 'net', 'net.connect', '', 'net.connect(1);')""",
    )
)
def fact_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capability uses by bound names, equal uses of a line once, with the literals of the call."""
    return relation(corpus(spark, sf_dir, CAPS), "caps").withColumn("literals", F.array_join("literals", "|"))


@query(
    facts_sql(
        "api, literals",
        "('FURNITURE', 0, 2, 'https.request', 'u'), ('BUILDING', 0, 2, 'fetch', ''), ('BUILDING', 1, 3, 'WebSocket', 'ws://w.example.com'), ('BUILDING', 2, 4, 'net.connect', '')",
    )
)
def fact_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(corpus(spark, sf_dir, CAPS), "nets").withColumn("literals", F.array_join("literals", "|")).drop("snippet")


@query(facts_sql("kind, literal, value", """('HOUSEHOLD', 0, 1, 'eval', true, 'key'), ('MACHINERY', 0, 1, 'eval', false, NULL), ('FURNITURE', 0, 2, 'Function', false, NULL)""").replace(", value FROM", ", CASE WHEN literal THEN k END AS value FROM"))
def fact_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(corpus(spark, sf_dir, EVALS), "evals").drop("snippet")


@query(facts_sql("kind, value, snippet", """('HOUSEHOLD', 0, 1, 'require', 'lodash', 'require("lo" + "dash");'), ('MACHINERY', 0, 1, 'require', NULL, 'require(name);'), ('FURNITURE', 0, 1, 'import', NULL, 'import(`./x${y}`);')"""))
def fact_dynamic_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(corpus(spark, sf_dir, LOADS), "dynamic").select("pkg_id", "file", "place", "line", "kind", F.try_element_at("literals", F.lit(1)).alias("value"), "snippet")


@query(facts_sql("charset, value", "('MACHINERY', 0, 1, 'base64', ''), ('HOUSEHOLD', 0, 3, 'hex', '')").replace(", value FROM", ", CASE WHEN charset = 'hex' THEN sha256(name) ELSE upper(sha256(name)) END AS value FROM"))
def fact_encoded_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(corpus(spark, sf_dir, PAYLOADS), "encoded")


@query(facts_sql("chars", "('HOUSEHOLD', 0, 1, '')").replace(", chars FROM", ", k AS chars FROM"))
def fact_charcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(corpus(spark, sf_dir, CODES), "charcodes")


# --- the module graph and reports ------------------------------------------------------------------------------------

GRAPH = {"HOUSEHOLD": """'require("../lib"); require("../data"); require("#in"); require("./missing"); require("fs");'""", "MACHINERY": """'import "../lib/index.js"; import "./../tool.mjs";'"""}
GRAPH_FILES = {"lib/index.js": "'require(\"../tool\");'", "tool.mjs": "'1;'", "data.cjs": "'1;'", "inner.js": "'require(\"./index\");'", "dead.js": "'require(\"./lib\");'"}
GRAPH_MANIFEST = """concat('{"main":"', CASE WHEN n_regionkey = 4 THEN 'gone.js' ELSE './index.js' END, '","bin":{"x":"tool"},"exports":{".":{"import":"./lib"}},"imports":{"#in":{"node":"./inner.js"}}}')"""
_LINKS = """l AS (SELECT pkg_id, file AS src, unnest(CASE WHEN seg = 'HOUSEHOLD' THEN ['lib/index.js', 'data.cjs', 'inner.js'] ELSE ['lib/index.js', 'tool.mjs'] END) AS dst, n_regionkey <> 4 AS live FROM f WHERE seg IN ('HOUSEHOLD', 'MACHINERY'))"""


def graph(spark: SparkSession, sf_dir: str):
    return analyze(corpus(spark, sf_dir, GRAPH, GRAPH_MANIFEST, GRAPH_FILES, index="seg in ('HOUSEHOLD', 'MACHINERY')"))


@query(
    f"""WITH {ROWS}, {_LINKS} SELECT pkg_id, src, dst FROM l WHERE live UNION SELECT pkg_id, 'lib/index.js', 'tool.mjs' FROM p
UNION SELECT pkg_id, 'index.js', file FROM f WHERE seg IN ('HOUSEHOLD', 'MACHINERY') AND n_regionkey <> 4 UNION SELECT pkg_id, 'inner.js', 'index.js' FROM f WHERE seg = 'HOUSEHOLD' AND n_regionkey <> 4"""
)
def module_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between reachable files: completed specifiers and the manifest's import map."""
    return graph(spark, sf_dir).edges.select("pkg_id", "src", "dst")


@query(
    f"""WITH {ROWS} SELECT pkg_id, 'entry' AS kind, unnest(['lib/index.js', 'tool.mjs']) AS path FROM p UNION ALL SELECT DISTINCT pkg_id, 'entry', 'index.js' FROM f WHERE seg IN ('HOUSEHOLD', 'MACHINERY') AND n_regionkey <> 4
UNION ALL SELECT pkg_id, 'unresolved', 'gone.js' FROM p WHERE n_regionkey = 4 UNION ALL SELECT pkg_id, 'unresolved', './index.js' FROM p WHERE n_regionkey <> 4 AND NOT EXISTS (SELECT 1 FROM f WHERE f.pkg_id = p.pkg_id AND seg IN ('HOUSEHOLD', 'MACHINERY'))"""
)
def module_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry files by the manifest's hints, and hints that lead nowhere."""
    a = graph(spark, sf_dir)
    return a.entries.select("pkg_id", F.lit("entry").alias("kind"), F.col("node").alias("path")).union(a.unresolved.select("pkg_id", F.lit("unresolved"), "hint"))


@query(
    f"""WITH {ROWS}, {_LINKS}, n AS (SELECT pkg_id, unnest(['lib/index.js', 'tool.mjs']) AS node FROM p UNION SELECT pkg_id, 'index.js' FROM l WHERE live UNION SELECT pkg_id, src FROM l WHERE live UNION SELECT pkg_id, dst FROM l WHERE live),
a AS (SELECT pkg_id, unnest(['lib/index.js', 'tool.mjs', 'data.cjs', 'inner.js', 'dead.js']) AS node FROM p UNION SELECT pkg_id, 'index.js' FROM l UNION SELECT pkg_id, src FROM l)
SELECT pkg_id, node, n.node IS NOT NULL AS live FROM a LEFT JOIN n USING (pkg_id, node)"""
)
def module_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source file, and whether an entry reaches it."""
    a = graph(spark, sf_dir)
    seen = a.reachable.select("pkg_id", "node", F.lit(True).alias("live"))
    return seen.union(a.unreachable.select("pkg_id", "path", F.lit(False)))


@query(
    f"""WITH {ROWS}, w AS ({WRITTEN}), c AS (SELECT p.pkg_id, count(file) AS files, count_if(seg = 'MACHINERY') AS dyn, count_if(seg = 'HOUSEHOLD') AS h, count_if(seg = 'FURNITURE') AS u, count_if(seg = 'FURNITURE' AND bal > 5000) AS rm
  FROM p LEFT JOIN (SELECT * FROM f WHERE seg IN ('HOUSEHOLD', 'FURNITURE', 'BUILDING', 'MACHINERY')) f USING (pkg_id) GROUP BY 1),
s AS (SELECT pkg_id, CAST(rm > 0 AS BIGINT) AS critical, CAST(rm = 0 AND h + u > 0 AS BIGINT) AS high, CAST(files = 0 AS BIGINT) AS medium, CAST(dyn > 0 AS BIGINT) AS low, CAST(files > 0 AS BIGINT) AS info, files FROM c)
SELECT pkg_id, CASE WHEN critical > 0 THEN 'F' WHEN high > 0 THEN 'D' WHEN medium > 0 THEN 'C' ELSE 'A' END AS grade, critical, high, medium, low, info, 'partial' AS coverage, CAST(files AS BIGINT) AS parsed FROM s"""
)
def package_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over the packages of the file-write rule: counts by severity, grade and coverage of the reports."""
    report = F.col("report")
    coverage = report[DEFAULT.context_key]["coverage"]
    counts = [report["summary"]["counts"][s].cast("long").alias(s) for s in SEVERITIES]
    return scan(corpus(spark, sf_dir, WRITES)).reports.select("pkg_id", report["summary"]["grade"].alias("grade"), *counts, coverage["status"].alias("coverage"), coverage["parsed"].cast("long").alias("parsed"))


@query(
    f"""WITH {ROWS}, w AS ({WRITTEN} UNION ALL SELECT pkg_id, file, 'fs.unlinkSync', '' FROM f WHERE seg = 'BUILDING' UNION ALL SELECT pkg_id, file, 'fs.writeFile', '' FROM f WHERE seg = 'MACHINERY')
SELECT pkg_id, kind, file, CAST(count(*) AS BIGINT) AS uses FROM (SELECT pkg_id, 'fs' AS kind, file FROM w UNION ALL SELECT pkg_id, 'fs-write', file FROM w) GROUP BY 1, 2, 3"""
)
def package_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations of the same reports."""
    seen = scan(corpus(spark, sf_dir, WRITES)).observations.where("kind = 'capability'")
    return seen.select("pkg_id", F.col("subject").alias("kind"), "file", F.coalesce("count", F.lit(1)).cast("long").alias("uses"))


@query(
    f"""WITH {ROWS}, w AS ({WRITTEN}), e AS (SELECT pkg_id, 'perm.undeclared-fs-write' AS rule, 'out-of-scope' AS variant, 0 AS o, count(*) AS n, 0 AS sev FROM w GROUP BY 1
UNION ALL SELECT pkg_id, 'perm.undeclared-fs-write', 'dynamic', 1, count(*), 3 FROM f WHERE seg = 'MACHINERY' GROUP BY 1
UNION ALL SELECT pkg_id, 'perm.unreachable-files', 'unreachable', 2, count(*), 4 FROM f WHERE seg IN ('HOUSEHOLD', 'FURNITURE', 'BUILDING', 'MACHINERY') GROUP BY 1
UNION ALL SELECT pkg_id, 'scan.empty-audit', 'audit', 3, 1, 2 FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.pkg_id = p.pkg_id AND seg <> 'AUTOMOBILE'))
SELECT pkg_id, rule, variant, CAST(n AS BIGINT) AS subjects, CAST(row_number() OVER (PARTITION BY pkg_id ORDER BY sev, rule, o) - 1 AS BIGINT) AS finding FROM e"""
)
def package_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stable identities of the same reports: how many subjects each finding names, and its place in the report."""
    named = scan(corpus(spark, sf_dir, WRITES)).identities
    return named.groupBy("pkg_id", "rule", "variant", F.col("finding").cast("long").alias("finding")).agg(F.sum(F.coalesce("count", F.lit(1))).cast("long").alias("subjects"))

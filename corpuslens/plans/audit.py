"""The audit operators in their table-generic form.

Events stand for findings (type gives the severity, value the confidence), orders and conversations for reports,
pages and documents for files. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import COLOURS, badge_colour, badge_message, grade_of, is_graded, normalized_host, pick, severity_rank, sha256_id, snippet, url_host
from ..operators import checks, graph, joins, literals, ranking, summary
from ..operators.staging import cut

SEVERITY_OF = {"error": "critical", "purchase": "high", "signup": "medium", "click": "low", "view": "info"}
HALF = "2024-01-16"
FLOATING = ("PROMO", "STANDARD", "*", "latest", "")
POPULAR = ("red bolt", "blue gear", "hot gizmo", "old ring", "small plate")
RUN = 65_536  # ids of one run of a day
SECRETS = r"(?i)(password|passwd|secret|token|api_?key)[\"']?[ ]*[:=]"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "medium").otherwise("high")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "ts", F.to_date("ts").cast("string").alias("day"), pick(F.col("event_type"), SEVERITY_OF, "info").alias("severity"), confidence.alias("confidence")
    )


FINDINGS = """
WITH f AS (
  SELECT event_id, user_id, event_type, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
    CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END AS severity,
    CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS rank,
    CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'medium' ELSE 'high' END AS confidence
  FROM events)
"""
GRADES = "CASE min(CASE WHEN severity <> 'info' AND confidence <> 'low' THEN rank END) WHEN 0 THEN 'F' WHEN 1 THEN 'D' WHEN 2 THEN 'C' WHEN 3 THEN 'B' ELSE 'A' END"


# --- hosts and endpoints ---------------------------------------------------------------------------------------------

HOST = r"""
nullif(CASE WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) = 'http' THEN regexp_replace(h, ':80$', '')
            WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) = 'https' THEN regexp_replace(h, ':443$', '') ELSE h END, '')
"""


@query(
    f"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)) AS h FROM pages),
q AS (SELECT page_id, {HOST} AS host FROM p)
SELECT host, min(page_id) AS first_page, count(*) AS uses FROM q WHERE host IS NOT NULL GROUP BY host
"""
)
def outbound_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select("page_id", url_host("url").alias("host")).where("host is not null")
    return summary.first_use(hosts, ["host"], F.col("page_id"), ["page_id"]).withColumnRenamed("page_id", "first_page")


@query(
    """
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS endpoint FROM pages)
SELECT endpoint, min(page_id) AS first_page, count(*) AS sites, count(DISTINCT page_id) AS page_count FROM h WHERE endpoint <> '' GROUP BY endpoint
"""
)
def endpoint_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("endpoint"))
    # two steps, so that a page counts once without a distinct aggregate over all sites
    by_page = found.where("endpoint <> ''").groupBy("endpoint", "page_id").count()
    return by_page.groupBy("endpoint").agg(F.min("page_id").alias("first_page"), F.sum("count").alias("sites"), F.count("*").alias("page_count"))


@query(
    """
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS l FROM pages)
SELECT nullif(regexp_replace(regexp_extract(l, '^([^/?#]*)', 1), '^[^@]*@', ''), '') AS host, count(*) AS links
FROM h WHERE NOT regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') GROUP BY 1
"""
)
def relative_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("l"))
    return found.where(~F.col("l").rlike("^[A-Za-z][A-Za-z0-9+.-]*://")).groupBy(normalized_host("l").alias("host")).agg(F.count("*").alias("links"))


# --- severity algebra ------------------------------------------------------------------------------------------------


@query(
    FINDINGS
    + "SELECT day, "
    + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))
    + " FROM f GROUP BY day"
)
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.severity_counts(findings(spark, sf_dir), "day")


@query(FINDINGS + f"SELECT user_id, day, {GRADES} AS grade FROM f GROUP BY user_id, day")
def grade_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.grades(findings(spark, sf_dir), "user_id", "day").select("user_id", "day", "grade")


@query(FINDINGS + "SELECT user_id, day, bool_or(severity <> 'info' AND confidence <> 'low' AND rank <= 1) AS breach FROM f GROUP BY user_id, day")
def threshold_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.breaches(findings(spark, sf_dir), "high", "user_id", "day")


@query(FINDINGS + "SELECT user_id, event_id, severity, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank, event_type, event_id) AS INTEGER) AS ord FROM f")
def worst_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worst_first(findings(spark, sf_dir), ["user_id"], "event_type", "event_id").select("user_id", "event_id", "severity", "ord")


@query(FINDINGS + "SELECT severity, confidence, severity <> 'info' AND confidence <> 'low' AS graded, count(*) AS n FROM f GROUP BY 1, 2, 3")
def graded_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return f.groupBy("severity", "confidence", is_graded("severity", "confidence").alias("graded")).agg(F.count("*").alias("n"))


@query(
    """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord FROM orders),
n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, CAST(ord AS INTEGER) AS ord, o_orderkey, CAST(NULL AS VARCHAR) AS note FROM r WHERE ord <= 5
UNION ALL SELECT o_custkey, 6, NULL, '…and ' || (n - 5) || ' more' FROM n WHERE n > 5
"""
)
def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bounded_evidence(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", 5)


@query("SELECT user_id, event_type, arg_min(ts, event_id) AS ts, min(event_id) AS event_id, count(*) AS uses FROM events GROUP BY 1, 2")
def first_use_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.first_use(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("event_id"), ["ts", "event_id"])


@query("SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, nullif(count(*), 1) AS count FROM events GROUP BY 1, 2, 3")
def observation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.observation_counts(findings(spark, sf_dir), "user_id", "event_type", "day")


# --- snapshots -------------------------------------------------------------------------------------------------------

HOURLY = """
WITH k AS (SELECT user_id, event_type, CAST(extract(hour FROM ts) AS INTEGER) AS hour, ts < TIMESTAMP '2024-01-16' AS base, value FROM events),
g AS (SELECT user_id, event_type, hour, base, count(*) AS n, max(CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 ELSE 2 END) AS level FROM k GROUP BY ALL),
b AS (SELECT * FROM g WHERE base), h AS (SELECT * FROM g WHERE NOT base)
"""


def hourly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    level = F.when(F.col("value") < 10, 0).when(F.col("value") < 50, 1).otherwise(2)
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.hour("ts").alias("hour"), (F.col("ts") < F.lit(HALF).cast("timestamp")).alias("base"), level.alias("level"))
    g = e.groupBy("user_id", "event_type", "hour", "base").agg(F.count("*").alias("n"), F.max("level").alias("level"))
    return g.where("base"), g.where("not base")


@query(
    HOURLY
    + """
SELECT coalesce(b.user_id, h.user_id) AS user_id, coalesce(b.event_type, h.event_type) AS event_type, coalesce(b.hour, h.hour) AS hour,
  b.n AS base_n, h.n AS head_n, b.level AS base_level, h.level AS head_level,
  CASE WHEN b.n IS NULL THEN 'added' WHEN h.n IS NULL THEN 'removed' WHEN b.n <> h.n OR b.level <> h.level THEN 'changed' ELSE 'unchanged' END AS change
FROM b FULL JOIN h ON b.user_id = h.user_id AND b.event_type = h.event_type AND b.hour = h.hour
"""
)
def snapshot_diff_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = hourly(spark, sf_dir)
    return joins.full_diff(base, head, ["user_id", "event_type", "hour"], ["n", "level"])


@query(
    """
WITH k AS (SELECT o_custkey, o_orderpriority, o_orderdate < TIMESTAMP '1998-01-01' AS base FROM orders),
g AS (SELECT o_custkey, o_orderpriority, base, count(*) AS n FROM k GROUP BY ALL),
d AS (SELECT coalesce(b.o_orderpriority, h.o_orderpriority) AS o_orderpriority, b.n AS bn, h.n AS hn
  FROM (SELECT * FROM g WHERE base) b FULL JOIN (SELECT * FROM g WHERE NOT base) h ON b.o_custkey = h.o_custkey AND b.o_orderpriority = h.o_orderpriority)
SELECT o_orderpriority, CASE WHEN bn IS NULL THEN 'added' WHEN hn IS NULL THEN 'removed' WHEN bn <> hn THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS identities
FROM d GROUP BY 1, 2
"""
)
def snapshot_diff_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).alias("base"))
    g = o.groupBy("o_custkey", "o_orderpriority", "base").agg(F.count("*").alias("n"))
    diff = joins.full_diff(g.where("base"), g.where("not base"), ["o_custkey", "o_orderpriority"], ["n"])
    return diff.groupBy("o_orderpriority", "change").agg(F.count("*").alias("identities"))


@query(
    """
WITH s AS (SELECT user_id, CAST(extract(hour FROM ts) AS INTEGER) AS hour,
  count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS base_n, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS head_n,
  count(*) FILTER (ts < TIMESTAMP '2024-01-16' AND event_type = 'error') AS base_bad, count(*) FILTER (ts >= TIMESTAMP '2024-01-16' AND event_type = 'error') AS head_bad
  FROM events GROUP BY 1, 2)
SELECT user_id, hour, array_to_string(list_filter([CASE WHEN base_n = 0 THEN 'base-absent' END, CASE WHEN head_n = 0 THEN 'head-absent' END,
  CASE WHEN base_n <> head_n THEN 'subject-mismatch' END, CASE WHEN base_bad > 0 THEN 'base-partial' END, CASE WHEN head_bad > 0 THEN 'head-partial' END], lambda r: r IS NOT NULL), ',') AS reasons,
  CASE WHEN base_n = 0 OR head_n = 0 THEN 'incomparable' WHEN base_bad > 0 OR head_bad > 0 OR base_n <> head_n THEN 'limited' ELSE 'comparable' END AS comparability
FROM s
"""
)
def comparability_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, bad = F.col("ts") < F.lit(HALF).cast("timestamp"), F.col("event_type") == "error"
    s = table(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").alias("hour")).agg(
        F.count_if(base).alias("base_n"), F.count_if(~base).alias("head_n"), F.count_if(base & bad).alias("base_bad"), F.count_if(~base & bad).alias("head_bad")
    )
    why = joins.reasons(
        (F.col("base_n") == 0, "base-absent"), (F.col("head_n") == 0, "head-absent"), (F.col("base_n") != F.col("head_n"), "subject-mismatch"), (F.col("base_bad") > 0, "base-partial"), (F.col("head_bad") > 0, "head-partial")
    )
    verdict = F.when(F.arrays_overlap("r", F.array(F.lit("base-absent"), F.lit("head-absent"))), "incomparable").when(F.size("r") > 0, "limited").otherwise("comparable")
    return s.withColumn("r", why).select("user_id", "hour", F.array_join("r", ",").alias("reasons"), verdict.alias("comparability"))


# --- anti joins, closure ---------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def import_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.without_use(table(spark, sf_dir, "customer"), urgent, ["c_custkey"]).select("c_custkey", "c_nationkey")


@query(
    """
SELECT c_mktsegment, c_nationkey, min(c_custkey) AS first_c_custkey, count(*) AS uses FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_acctbal > 9000) GROUP BY 1, 2
"""
)
def undeclared_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"))
    return joins.undeclared(table(spark, sf_dir, "customer"), declared, ["c_nationkey"], ["c_mktsegment", "c_nationkey"], "c_custkey")


EDGES = """
o AS (SELECT user_id AS src, event_type, value, lead(user_id) OVER w AS dst, lead(event_type) OVER w AS next FROM events WINDOW w AS (PARTITION BY CAST(ts AS DATE) ORDER BY event_id)),
e AS (SELECT DISTINCT src, dst FROM o WHERE event_type = 'error' AND next = 'signup' AND value > 35 AND src <> dst),
s AS (SELECT min(src) AS node FROM e)
"""


def successors(events: DataFrame) -> DataFrame:
    """Each event with the user and type of the next one of its day (null for the last).

    A day is split into runs of ids, so that no task sorts a whole day: the last event of a run is followed by the first
    of the day's next run.
    """
    e = events.select("user_id", "event_type", "value", "event_id", F.to_date("ts").alias("day"), F.expr(f"event_id div {RUN}").alias("run"))
    in_run = Window.partitionBy("day", "run").orderBy("event_id")
    following = F.struct(F.lead("user_id").over(in_run).alias("user_id"), F.lead("event_type").over(in_run).alias("event_type"))
    rows = e.withColumn("next", F.when(F.lead("event_id").over(in_run).isNotNull(), following))
    heads = e.groupBy("day", "run").agg(F.min(F.struct("event_id", "user_id", "event_type")).alias("head"))
    heads = heads.select("day", "run", F.lead("head").over(Window.partitionBy("day").orderBy("run")).alias("head"))
    after = F.when(F.col("next").isNull(), F.struct("head.user_id", "head.event_type")).otherwise(F.col("next"))
    return rows.join(heads, ["day", "run"], "left").withColumn("next", after)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from the user of a strong error to the user of the signup that follows it on the same day; computed once."""
    e = successors(table(spark, sf_dir, "events")).where("event_type = 'error' and next.event_type = 'signup' and value > 35 and user_id <> next.user_id")
    return cut(e.select(F.col("user_id").alias("src"), F.col("next.user_id").alias("dst")).distinct())


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT node FROM s UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    return graph.reachable(edges, edges.agg(F.min("src").alias("node")))


@query(
    f"WITH RECURSIVE {EDGES}, r AS (SELECT node FROM s UNION SELECT e.dst FROM r JOIN e ON e.src = r.node), "
    "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node FROM n WHERE node NOT IN (SELECT node FROM r)"
)
def unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    return nodes(edges).join(graph.reachable(edges, edges.agg(F.min("src").alias("node"))), "node", "left_anti")


@query(
    f"""WITH RECURSIVE {EDGES},
a AS (SELECT user_id AS node, max(value) AS m FROM events GROUP BY 1),
secret AS (SELECT a.node FROM a JOIN (SELECT src AS node FROM e UNION SELECT dst FROM e) n ON a.node = n.node WHERE m > 300),
net AS (SELECT a.node FROM a WHERE m < 200),
r AS (SELECT secret.node AS source, e.dst AS node FROM secret JOIN e ON e.src = secret.node UNION SELECT r.source, e.dst FROM r JOIN e ON e.src = r.node)
SELECT r.source, count(*) AS reached FROM r JOIN net ON net.node = r.node GROUP BY 1
"""
)
def secret_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    peak = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.max("value").alias("m"))
    peak = cut(nodes(edges).join(peak, "node"))
    return graph.reach_counts(edges, peak.where("m > 300"), peak.where("m < 200"))


# --- names, literals, digests ----------------------------------------------------------------------------------------


@query(
    f"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), p AS (SELECT unnest([{', '.join(f"'{x}'" for x in POPULAR)}]) AS near)
SELECT name, near, CAST(levenshtein(name, near) AS INTEGER) AS distance FROM n, p WHERE levenshtein(name, near) <= 2 AND name NOT IN (SELECT near FROM p)
"""
)
def name_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.near_names(table(spark, sf_dir, "part"), "p_name", list(POPULAR), 2)


@query("SELECT p_type, count(*) AS parts, min(p_partkey) AS first_part FROM part WHERE trim(p_type) IN ('PROMO', 'STANDARD', '*', 'latest', '') GROUP BY 1")
def floating_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = table(spark, sf_dir, "part").where(F.trim("p_type").isin(*FLOATING))
    return hit.groupBy("p_type").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"))


@query(
    """
WITH t AS (SELECT 'documents' AS origin, doc_id AS id, unnest(regexp_extract_all(text, '([A-Za-z0-9+/=]{32,})', 1)) AS token FROM documents
  UNION ALL SELECT 'conversations', conv_id, unnest(regexp_extract_all(text, '([A-Za-z0-9+/=]{32,})', 1)) FROM conversations),
c AS (SELECT origin, id, token, CASE WHEN regexp_matches(token, '[0-9]') AND regexp_matches(token, '[A-Z]') THEN 'base64'
  WHEN regexp_matches(token, '^[0-9a-fA-F]+$') AND len(list_distinct(string_split(token, ''))) >= 8 THEN 'hex' END AS charset FROM t)
SELECT origin, id, token, charset FROM c WHERE charset IS NOT NULL
"""
)
def encoded_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), "text")
    return literals.encoded_tokens(docs.union(turns), ["origin", "id"], "text", 32)


@query(
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
SELECT doc_id, CAST(line AS INTEGER) AS line, substr(trim(value), 1, 120) AS snippet FROM l
WHERE regexp_matches(value, '(?i)(password|passwd|secret|token|api_?key)["'']?[ ]*[:=]')
"""
)
def credential_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = literals.matching_lines(table(spark, sf_dir, "documents"), ["doc_id"], "text", SECRETS)
    return found.select("doc_id", "line", snippet("value").alias("snippet"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sha256_id("text").alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT 'sha256:' || sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", sha256_id("text").alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(
    """
WITH b AS (SELECT source, doc_id // 1000 AS bucket, count(*) AS n, sha256(string_agg(doc_id || ' ' || sha256(text), chr(10) ORDER BY doc_id)) AS line FROM documents GROUP BY 1, 2)
SELECT source, 'sha256:' || sha256(string_agg(line, chr(10) ORDER BY bucket)) AS digest, CAST(sum(n) AS BIGINT) AS files FROM b GROUP BY 1
"""
)
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.sha2("text", 256))
    return summary.ordered_digest(table(spark, sf_dir, "documents"), "source", "doc_id", line, F.expr("doc_id div 1000"))


# --- constraints -----------------------------------------------------------------------------------------------------

RULES: dict[str, dict[str, tuple[Column | str, str]]] = {
    "documents": {"length-matches": ("n_chars = length(text)", "n_chars = length(text)"), "language-known": ("lang in ('en', 'de', 'fr', 'es')", "lang in ('en', 'de', 'fr', 'es')"), "no-control": ("not text rlike '[\\\\x00-\\\\x08]'", "NOT regexp_matches(text, '[\\x00-\\x08]')")},
    "labels": {"quality-binary": ("quality in (0, 1)", "quality in (0, 1)"), "not-toxic": ("toxic = 0", "toxic = 0")},
    "conversations": {"role-known": ("role in ('system', 'user', 'assistant')", "role in ('system', 'user', 'assistant')"), "turn-ordinal": ("turn >= 0", "turn >= 0"), "text-present": ("length(text) > 0", "length(text) > 0"), "user-starts": ("turn > 0 or role = 'user'", "turn > 0 or role = 'user'")},
}


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{r}' AS rule, count(*) FILTER (NOT coalesce({sql}, FALSE)) AS broken, count(*) AS checked FROM {t}" for t, rules in RULES.items() for r, (_, sql) in rules.items()
    )
)
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [checks.broken_rules(table(spark, sf_dir, t), t, {r: F.expr(c) for r, (c, _) in rules.items()}) for t, rules in RULES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    """
WITH l AS (SELECT l_orderkey, count(*) AS lines, max(l_linenumber) AS last FROM lineitem GROUP BY 1)
SELECT CASE WHEN l.l_orderkey IS NULL THEN 'no-lines' WHEN o.o_orderkey IS NULL THEN 'no-order' WHEN l.lines <> l.last THEN 'count-mismatch' ELSE 'ok' END AS issue, count(*) AS orders
FROM orders o FULL JOIN l ON o.o_orderkey = l.l_orderkey GROUP BY 1
"""
)
def cross_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("lines"), F.max("l_linenumber").alias("last"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(True).alias("there"))
    issue = F.when(F.col("lines").isNull(), "no-lines").when(F.col("there").isNull(), "no-order").when(F.col("lines") != F.col("last"), "count-mismatch").otherwise("ok")
    return orders.join(lines, "key", "full_outer").groupBy(issue.alias("issue")).agg(F.count("*").alias("orders"))


@query(
    """
WITH t AS (SELECT conv_id, turn, role, length(text) AS n, lag(turn) OVER w AS before, lag(length(text)) OVER w AS n_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, min(turn) AS turn FROM t WHERE turn <> before + 1 OR n <= n_before GROUP BY 1
"""
)
def sorted_unique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    bad = (F.col("turn") != F.col("before") + 1) | (F.col("n") <= F.col("n_before"))
    return ranking.first_violation(turns, "conv_id", "turn", bad, before="turn", n_before="n")


@query(
    """
SELECT source, lang, count(*) AS candidates, count(l.doc_id) AS covered,
  CASE WHEN count(l.doc_id) = 0 THEN 'unknown' WHEN count(l.doc_id) < count(*) THEN 'partial' ELSE 'complete' END AS status
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1, 2
"""
)
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("there", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(labelled, "doc_id", "left")
    return summary.coverage(rows, F.col("there").isNotNull(), "source", "lang")


# --- renderers -------------------------------------------------------------------------------------------------------


@query(
    FINDINGS
    + f""", g AS (SELECT user_id, day, {GRADES} AS grade, count(*) AS n FROM f GROUP BY 1, 2)
SELECT user_id, day, 'grade ' || grade || CASE WHEN n = 1 THEN ' (partial)' ELSE '' END AS message,
  CASE grade {' '.join(f"WHEN '{g}' THEN '{c}'" for g, c in COLOURS.items())} END AS color FROM g
"""
)
def badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    worst = F.min(F.when(is_graded("severity", "confidence"), severity_rank("severity")))
    g = f.groupBy("user_id", "day").agg(worst.alias("worst"), F.count("*").alias("n")).withColumn("grade", grade_of("worst"))
    covered = F.when(F.col("n") == 1, "partial").otherwise("complete")
    return g.select("user_id", "day", badge_message("grade", covered).alias("message"), badge_colour("grade").alias("color"))


@query(
    FINDINGS
    + """, r AS (SELECT day, event_id, severity, event_type, row_number() OVER (PARTITION BY day ORDER BY rank, event_id) AS ord, count(*) OVER (PARTITION BY day) AS n FROM f)
SELECT day, string_agg('- [' || severity || '] ' || event_type || ' at ' || event_id, chr(10) ORDER BY ord) || CASE WHEN max(n) > 4 THEN chr(10) || '- …and ' || (max(n) - 4) || ' more' ELSE '' END AS body
FROM r WHERE ord <= 4 GROUP BY day
"""
)
def bounded_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).withColumn("line", F.concat(F.lit("- ["), "severity", F.lit("] "), "event_type", F.lit(" at "), F.col("event_id").cast("string")))
    rows = ranking.bounded_evidence(f, ["day"], [severity_rank("severity"), "event_id"], "line", 4)
    lines = rows.select("day", F.struct("ord", F.coalesce("line", F.concat(F.lit("- "), "note")).alias("line")).alias("i"))
    return lines.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["line"]), "\n").alias("body"))

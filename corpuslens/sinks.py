"""Results for continuous integration: badges, job summaries and the one comment of a pull request, as rows.

Nothing is sent from here. A row says what a poster has to do: the badge document and the summary to write, and the
request that makes or changes the comment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import render
from .config import DEFAULT, AuditConfig

_FINDING = "struct<id:string,title:string,severity:string,confidence:string,evidence:array<struct<file:string,line:int,snippet:string,note:string>>,remediation:string>"


def report_schema(config: AuditConfig = DEFAULT) -> str:
    """What the texts need of a report."""
    counts = "struct<critical:int,high:int,medium:int,low:int,info:int>"
    return f"`schema` string, target struct<kind:string,specifier:string>, summary struct<grade:string,counts:{counts}>, findings array<{_FINDING}>, `{config.context_key}` struct<coverage:struct<status:string>>"


def ci_results(runs: DataFrame, reports: DataFrame, comments: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """(run_id, complete, badge, summary, method, path, body) of each of ``runs``.

    runs: run_id, doc_id, repository, number (of a pull request, or null), run_url, baseline (whether one was configured),
    comparison (its Markdown, or null) and reason (why there is none, or null). reports: doc_id, json; one that is
    missing, no JSON or of another schema means that the scan did not complete. comments: repository, number, comment_id,
    body; the first that holds the marker is changed in place, else one is made. Without a pull request there is no request.
    """
    marker = f"<!-- {config.tool}:comment -->"
    typed = reports.select("doc_id", F.from_json("json", report_schema(config)).alias("r")).where(F.col("r.schema") == config.report_schema)
    own = comments.where(F.contains("body", F.lit(marker))).groupBy("repository", "number").agg(F.min("comment_id").alias("comment_id"))
    met = runs.join(typed, "doc_id", "left").join(own, ["repository", "number"], "left")
    url = F.coalesce("run_url", F.lit("(run url unavailable)"))
    lost = F.concat(F.lit(f"## {config.tool} report\n\nThe scan did not complete — no valid report was produced. See the [run]("), url, F.lit(") logs for the scanner error."))
    lost = F.concat(lost, F.when(F.col("baseline"), "\n\nThe configured baseline comparison did not run — no report was produced.").otherwise(""))
    why = F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("no comparison result was produced"))
    compared = F.coalesce("comparison", render.unavailable_markdown(why, config))
    whole = F.concat(render.markdown(F.col("r"), url, config), F.when(F.col("baseline"), F.concat(F.lit("\n\n"), compared)).otherwise(""))
    complete = F.col("r").isNotNull()
    # a comment without the marker could not be found again
    text = F.when(complete, whole).otherwise(F.concat(F.lit(marker + "\n"), lost))
    base = F.concat(F.lit("/repos/"), "repository", F.lit("/issues/"))
    path = F.when(F.col("comment_id").isNotNull(), F.concat(base, F.lit("comments/"), F.col("comment_id").cast("string"))).otherwise(F.concat(base, F.col("number").cast("string"), F.lit("/comments")))
    asked = F.col("number").isNotNull() & F.col("repository").isNotNull()
    return met.select(
        "run_id", complete.alias("complete"), F.when(complete, F.to_json(render.badge(F.col("r"), config))).alias("badge"), F.concat(text, F.lit("\n")).alias("summary"),
        F.when(asked, F.when(F.col("comment_id").isNotNull(), "PATCH").otherwise("POST")).alias("method"), F.when(asked, path).alias("path"), F.when(asked, F.to_json(F.struct(text.alias("body")))).alias("body"),
    )

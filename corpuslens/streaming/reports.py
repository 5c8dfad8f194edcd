"""A folder of reports read as it fills: each document is validated once, and compared with the latest of its subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, AuditConfig
from ..diff import compare
from ..validate import validate_reports


def report_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, json, seen): a row a file."""
    lines = spark.readStream.option("wholetext", "true").text(folder)
    return lines.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("json"), F.col("_metadata.file_modification_time").alias("seen"))


def graded_stream(reports: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Reports by grade in windows of event time (X where there is none); a document counts once within the watermark."""
    once = reports.withWatermark("seen", late).dropDuplicatesWithinWatermark(["doc_id"])
    graded = once.select("seen", F.get_json_object("json", "$.summary.grade").alias("grade"))
    return graded.groupBy(F.window("seen", every), F.coalesce("grade", F.lit("X")).alias("grade")).count()


def watch_reports(spark: SparkSession, folder: str, store: str, checkpoint: str, config: AuditConfig = DEFAULT) -> StreamingQuery:
    """Keeps ``store``/reports and ``store``/diffs: every new valid report is compared with the latest one of its package.

    A batch that is run again writes the same folders again, so nothing is counted twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        checked = validate_reports(batch.select("doc_id", "json"), config).where("ok").select("doc_id")
        name = F.get_json_object("json", f"$['{config.context_key}'].subject.packageName")
        fresh = batch.join(checked, "doc_id", "left_semi").select("doc_id", "json", "seen", name.alias("package"), F.lit(number).alias("batch"))
        fresh.write.mode("overwrite").parquet(f"{store}/reports/batch={number}")
        known = session.read.schema("doc_id string, json string, seen timestamp, package string").option("recursiveFileLookup", "true").parquet(f"{store}/reports")
        order = Window.partitionBy("package").orderBy("seen", "doc_id")
        lined = known.where("package is not null").withColumn("base_id", F.lag("doc_id").over(order))
        new = session.read.parquet(f"{store}/reports/batch={number}").select("doc_id")
        pairs = lined.join(new, "doc_id", "left_semi").where("base_id is not null").select(F.col("doc_id").alias("pair_id"), "base_id", F.col("doc_id").alias("head_id"))
        summary, findings, _ = compare(pairs, known.select("doc_id", "json"), config)
        changes = findings.where("change <> 'unchanged'").groupBy("pair_id", "change").count()
        summary.select("pair_id", "base_id", "comparability", "reasons").join(changes, "pair_id", "left").write.mode("overwrite").parquet(f"{store}/diffs/batch={number}")

    return report_stream(spark, folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""``python -m corpuslens``: scan, diff, badge and validate over local files.

scan exits 0 when done, 1 when a graded finding is as bad as --fail-on, 2 on errors; diff 0 comparable, 1 incomparable,
2 for reports that are not valid; badge 0 or 2; validate 0, 1 for broken reports, 2 for unreadable files.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import render
from .config import DEFAULT
from .diff import compare, diff_documents
from .functions import SEVERITIES
from .operators.summary import breaches
from .report import scan
from .sources import archive_files, package_files
from .validate import check, validate_reports


def session() -> SparkSession:
    spark = SparkSession.builder.appName("corpuslens").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scan_command(args: argparse.Namespace) -> int:
    spark = session()
    if not os.path.exists(args.target):
        print(f"no such package: {args.target}", file=sys.stderr)
        return 2
    if os.path.isdir(args.target):
        files = package_files(spark.createDataFrame([(args.target, os.path.abspath(args.target))], "pkg_id string, dir string"))
    else:
        files = archive_files(spark.read.format("binaryFile").load(os.path.abspath(args.target)).select(F.lit(args.target).alias("pkg_id"), "content"))
    now = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    try:
        done = scan(files, DEFAULT, args.rules.split(",") if args.rules else None, ran_at=now)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    shown = F.to_json("report", {"pretty": "true"}) if args.json else render.summary_text(F.col("report"))
    print(done.reports.select(shown).first()[0])
    if args.fail_on:
        hit = breaches(done.findings, args.fail_on).first()
        return int(bool(hit and hit.breach))
    return 0


def diff_command(args: argparse.Namespace) -> int:
    texts = _read([args.base, args.head])
    if texts is None:
        return 2
    for name, text in zip((args.base, args.head), texts, strict=True):
        if issues := check(text)[1]:
            print(f"{name}: {issues[0][0]}: {issues[0][1]}", file=sys.stderr)
            return 2
    spark = session()
    reports = spark.createDataFrame([("base", texts[0]), ("head", texts[1])], "doc_id string, json string")
    pairs = spark.createDataFrame([("pair", "base", "head", args.subject)], "pair_id string, base_id string, head_id string, label string")
    document = diff_documents(*compare(pairs, reports)).select("diff", render.diff_text(F.col("diff")).alias("text"), F.to_json("diff", {"pretty": "true"}).alias("json")).first()
    print(document.json if args.json else document.text)
    return int(document.diff.comparability != "comparable")


def badge_command(args: argparse.Namespace) -> int:
    texts = _read([args.report])
    if texts is None:
        return 2
    document, issues, state = check(texts[0])
    if issues:
        print(f"{issues[0][0]}: {issues[0][1]}", file=sys.stderr)
        return 2
    spark = session()
    coverage = document[DEFAULT.context_key]["coverage"]["status"] if state == "validated" else "unknown"
    schema = f"summary struct<grade:string>, `{DEFAULT.context_key}` struct<coverage:struct<status:string>>"
    row = spark.createDataFrame([(((document["summary"]["grade"],), ((coverage,),)),)], f"r struct<{schema.replace('summary struct', 'summary:struct').replace('` struct', '`:struct')}>")
    print(row.select(F.to_json(render.badge(F.col("r")), {"pretty": "true"})).first()[0])
    return 0


def validate_command(args: argparse.Namespace) -> int:
    texts = _read(args.reports)
    if texts is None:
        return 2
    spark = session()
    rows = validate_reports(spark.createDataFrame(list(zip(args.reports, texts, strict=True)), "doc_id string, json string")).collect()
    for r in rows:
        print(f"{r.doc_id}: " + ("ok" if r.ok else "; ".join(f"{i.path}: {i.message}" for i in r.issues)))
    return int(not all(r.ok for r in rows))


def _read(paths: list[str]) -> list[str] | None:
    out = []
    for path in paths:
        try:
            with open(path, encoding="utf-8") as file:
                out.append(file.read())
            json.loads(out[-1])
        except (OSError, ValueError) as error:
            print(f"{path}: {error}", file=sys.stderr)
            return None
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpuslens", description=__doc__)
    commands = parser.add_subparsers(required=True)
    add = lambda name, run: (c := commands.add_parser(name), c.set_defaults(run=run))[0]
    c = add("scan", scan_command)
    c.add_argument("target")
    c.add_argument("--json", action="store_true")
    c.add_argument("--rules")
    c.add_argument("--fail-on", choices=SEVERITIES[:-1])
    c = add("diff", diff_command)
    c.add_argument("base")
    c.add_argument("head")
    c.add_argument("--json", action="store_true")
    c.add_argument("--subject")
    add("badge", badge_command).add_argument("report")
    add("validate", validate_command).add_argument("reports", nargs="+")
    args = parser.parse_args(argv)
    return args.run(args)

"""Registry metadata and checkouts that lie in folders: documents saved from a package registry, archives, Git work trees.

Nothing is fetched. A mirror's metadata documents (one JSON a package) and archives are tables, and what a resolver does
one package at a time is a join over all that were asked for.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .resolve import npm_name, npm_spec, pick_version, verify_integrity

_DOCUMENT = "name string, `dist-tags` map<string,string>, versions map<string, struct<version:string, dist:struct<tarball:string, integrity:string, shasum:string>>>"


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(name, tags, versions, dists) of every metadata document in ``folder``; versions in the order of the document.

    A document that is no JSON object with a name is left out; one without versions has none.
    """
    text = spark.read.text(folder, wholetext=True)
    d = F.from_json("value", _DOCUMENT)
    own = text.select(d.alias("d")).where("d.name is not null")
    none = F.create_map().cast("map<string, struct<version:string, dist:struct<tarball:string, integrity:string, shasum:string>>>")
    every = F.coalesce("d.versions", none)
    dists = F.transform_values(every, lambda _, v: v["dist"])
    return own.select("d.name", F.coalesce(F.col("d.`dist-tags`"), F.create_map().cast("map<string,string>")).alias("tags"), F.map_keys(every).alias("versions"), dists.alias("dists"))


def resolve_packages(asked: DataFrame, metadata: DataFrame) -> DataFrame:
    """``asked`` (specifier) with name, version, tarball, integrity, shasum and error.

    Of a specifier's version, tag, ``latest`` or the last version that which the metadata has; error says why there is
    none: ``unknown package``, ``no matching version`` or ``no archive``.
    """
    named = asked.select("specifier", npm_name("specifier").alias("name"), npm_spec("specifier").alias("spec")).join(metadata, "name", "left")
    chosen = named.withColumn("version", pick_version("spec", "tags", "versions")).withColumn("dist", F.col("dists")[F.col("version")])
    error = F.when(F.col("versions").isNull(), "unknown package").when(F.col("version").isNull(), "no matching version").when(F.coalesce(F.col("dist.tarball"), F.lit("")) == "", "no archive")
    return chosen.select("specifier", "name", "version", "dist.tarball", "dist.integrity", "dist.shasum", error.alias("error"))


def fetched(resolved: DataFrame, archives: DataFrame) -> DataFrame:
    """(pkg_id, content, archive_digest, version, integrity): archives (tarball, content) of what was resolved; content that doesn't fit its integrity is an error."""
    found = resolved.where("error is null").join(archives, "tarball")
    content = verify_integrity("content", "integrity", "shasum")
    return found.select(F.col("specifier").alias("pkg_id"), content.alias("content"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("archive_digest"), "version", "integrity")


def head_commit(folder: str) -> str | None:
    """The commit that a Git work tree or a bare repository has checked out; None for other folders."""
    git = os.path.join(folder, ".git")
    if os.path.isfile(git):  # a linked work tree names its repository
        with open(git, encoding="utf-8") as f:
            git = os.path.join(folder, f.read().removeprefix("gitdir:").strip())
    elif not os.path.isdir(git):
        git = folder
    try:
        with open(os.path.join(git, "HEAD"), encoding="utf-8") as f:
            head = f.read().strip()
        common = git
        if os.path.exists(os.path.join(git, "commondir")):
            with open(os.path.join(git, "commondir"), encoding="utf-8") as f:
                common = os.path.normpath(os.path.join(git, f.read().strip()))
        if not head.startswith("ref:"):
            return head if re.fullmatch("[0-9a-f]{40,64}", head) else None
        ref = head.removeprefix("ref:").strip()
        loose = os.path.join(common, ref)
        if os.path.exists(loose):
            with open(loose, encoding="utf-8") as f:
                return f.read().strip()
        with open(os.path.join(common, "packed-refs"), encoding="utf-8") as f:
            return next((line.split()[0] for line in f if line.rstrip("\n").endswith(" " + ref)), None)
    except OSError:
        return None

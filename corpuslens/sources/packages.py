"""Package folders: every file once, links never followed.

Spark's binary reader hides names that begin with a dot or an underscore and follows links, so folders are walked here.
Each package is one row of work; a package is read where its task runs.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: kind: source (JavaScript), manifest (package.json of the root), other (path only), omission.
FILES_SCHEMA = "pkg_id string, path string, kind string, content binary, reason string, detail string"
_ARROW = pa.schema([("pkg_id", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("content", pa.binary()), ("reason", pa.string()), ("detail", pa.string())])
_SHEBANG = re.compile(r"#![^\n]*\bnode\b")


def is_source(name: str, head: bytes) -> bool:
    """Whether a file is JavaScript: by its extension, or a node shebang where there is none."""
    if name.endswith((".js", ".mjs", ".cjs")):
        return True
    return "." not in name and _SHEBANG.match(head[:256].decode("utf-8", "replace")[:64]) is not None


def walk(root: str) -> Iterator[tuple[str, str, bytes | None, str | None, str | None]]:
    """(path, kind, content, reason, detail) of a folder, sorted by path."""
    found = []
    stack = [""]
    while stack:
        at = stack.pop()
        with os.scandir(os.path.join(root, at)) as entries:
            for e in entries:
                path = f"{at}/{e.name}" if at else e.name
                if e.name in ("node_modules", ".git") or e.name.startswith(".DS"):
                    continue
                if e.is_symlink():
                    found.append((path, "omission", None, "symlink", None))
                elif e.is_dir():
                    stack.append(path)
                elif e.is_file():
                    found.append(_read(root, path, e.name))
    yield from sorted(found, key=lambda f: f[0])


def _read(root: str, path: str, name: str):
    with open(os.path.join(root, path), "rb") as file:
        head = file.read(256)
        kind = "manifest" if path == "package.json" else "source" if is_source(name, head) else "other"
        return path, kind, None if kind == "other" else head + file.read(), None, None


def _batch(pkg_id: str, root: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, (pkg_id, *f), strict=True)) for f in walk(root)], _ARROW)


def package_files(packages: DataFrame) -> DataFrame:
    """The files of ``packages`` (pkg_id, dir), FILES_SCHEMA. ``dir`` must be reachable from the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pkg_id, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _batch(pkg_id, root)

    return packages.select("pkg_id", "dir").mapInArrow(run, FILES_SCHEMA)


class _Package(InputPartition):
    def __init__(self, pkg_id: str, root: str):
        self.pkg_id, self.root = pkg_id, root


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Package(e.name, e.path) for e in sorted(os.scandir(self.path), key=lambda e: e.name) if e.is_dir() and not e.is_symlink()]

    def read(self, partition):
        yield _batch(partition.pkg_id, partition.root)


class PackageSource(DataSource):
    """``spark.dataSource.register(PackageSource)``, then ``spark.read.format("packages").load(folder)``: each folder in it is a package."""

    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return FILES_SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])


def packages_in(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(PackageSource)
    return spark.read.format("packages").load(folder)

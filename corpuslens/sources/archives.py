"""Package archives (tar, tar.gz) read as rows; nothing is extracted."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packages import _ARROW, FILES_SCHEMA, is_source


def entries(data: bytes) -> Iterator[tuple[str, str, bytes | None, str | None, str | None]]:
    """(path, kind, content, reason, detail) of an archive. Links are omissions, devices are left out.

    A path that leaves the archive's root is an error, as is an archive that is none. It is unpacked as a stream, of any
    size: beside its packed bytes, one entry is held.
    """
    raw = io.BytesIO(data)
    with tarfile.open(fileobj=gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw, mode="r|", errorlevel=1) as archive:
        for member in archive:
            name = member.name.removeprefix("./").removeprefix("package/")
            if member.isdir() or name in ("", ".", "package"):
                continue
            if member.issym() or member.islnk():
                yield name, "omission", None, "archive-link-skipped", f"{'symlink' if member.issym() else 'hardlink'} → {member.linkname}"
            elif member.isfile():
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"archive entry escapes its root: {name}")
                content = archive.extractfile(member).read()
                parts = name.split("/")
                if "node_modules" in parts or ".git" in parts or any(p.startswith(".DS") for p in parts):
                    continue
                kind = "manifest" if name == "package.json" else "source" if is_source(parts[-1], content) else "other"
                yield name, kind, None if kind == "other" else content, None, None


def archive_files(archives: DataFrame) -> DataFrame:
    """The files of ``archives`` (pkg_id, content), FILES_SCHEMA; a later entry of one path replaces an earlier one.

    ``spark.read.format("binaryFile")`` gives such rows from a folder of archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pkg_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last = {e[0]: e for e in entries(content)}
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, (pkg_id, *e), strict=True)) for e in sorted(last.values())], _ARROW)

    return archives.select(F.col("pkg_id").cast("string"), "content").mapInArrow(run, FILES_SCHEMA)

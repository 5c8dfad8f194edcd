"""From file snapshots to fact relations: one parse for each file, then DataFrames keyed by pkg_id."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .config import DEFAULT, AuditConfig
from .js import FileFacts, JsSyntaxError, inspect, parse
from .operators.graph import reachable
from .operators.staging import cut, merged, spread

_USE = [("line", pa.int32()), ("api", pa.string()), ("literals", pa.list_(pa.string())), ("snippet", pa.string())]
_LISTS = {
    "imports": pa.struct([("specifier", pa.string()), ("line", pa.int32()), ("base", pa.string())]),
    "caps": pa.struct([("cap", pa.string()), *_USE]),
    "nets": pa.struct(_USE),
    "evals": pa.struct([("line", pa.int32()), ("kind", pa.string()), ("literal", pa.bool_()), ("value", pa.string()), ("snippet", pa.string())]),
    "dynamic": pa.struct([("line", pa.int32()), ("kind", pa.string()), ("literals", pa.list_(pa.string())), ("snippet", pa.string())]),
    "encoded": pa.struct([("line", pa.int32()), ("value", pa.string()), ("charset", pa.string())]),
    "charcodes": pa.struct([("line", pa.int32()), ("chars", pa.string())]),
}
_FILE = pa.schema(
    [("pkg_id", pa.string()), ("path", pa.string()), ("path_json", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("source_type", pa.string()), ("parse_error", pa.string()), ("externals", pa.list_(pa.string()))]
    + [(k, pa.list_(t)) for k, t in _LISTS.items()]
)
_USE_SQL = "line:int,api:string,literals:array<string>,snippet:string"
FILE_SCHEMA = (
    "pkg_id string, path string, path_json string, bytes bigint, sha256 string, source_type string, parse_error string, externals array<string>, imports array<struct<specifier:string,line:int,base:string>>, "
    f"caps array<struct<cap:string,{_USE_SQL}>>, nets array<struct<{_USE_SQL}>>, evals array<struct<line:int,kind:string,literal:boolean,value:string,snippet:string>>, "
    "dynamic array<struct<line:int,kind:string,literals:array<string>,snippet:string>>, encoded array<struct<line:int,value:string,charset:string>>, charcodes array<struct<line:int,chars:string>>"
)
_MANIFEST = pa.schema(
    [("pkg_id", pa.string()), ("path_json", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("valid", pa.bool_()), ("name", pa.string()), ("version", pa.string())]
    + [("scripts", pa.map_(pa.string(), pa.string())), ("dependencies", pa.list_(pa.struct([("name", pa.string()), ("spec", pa.string())]))), ("seams", pa.list_(pa.string())), ("hints", pa.list_(pa.string())), ("import_map", pa.map_(pa.string(), pa.string()))]
)
MANIFEST_SCHEMA = (
    "pkg_id string, path_json string, bytes bigint, sha256 string, valid boolean, name string, version string, scripts map<string,string>, dependencies array<struct<name:string,spec:string>>, seams array<string>, hints array<string>, import_map map<string,string>"
)
# How a specifier without extension is completed, in this order.
SUFFIXES = ("", ".js", ".cjs", ".mjs", ".json", "/index.js", "/index.cjs", "/index.mjs")
#: Files, and bytes of source, whose facts make one Arrow batch: a batch costs more than the parse of a small file.
BATCH, BATCH_BYTES = 512, 1 << 20


def joined(folder: str, specifier: str) -> str | None:
    """A relative specifier as a path of the package; null if it leaves it."""
    path = posixpath.normpath(posixpath.join("/root", folder, "./" + specifier))
    return path.removeprefix("/root").removeprefix("/") if path == "/root" or path.startswith("/root/") else None


def file_row(pkg_id: str, path: str, content: bytes) -> dict:
    """Everything that one source file shows."""
    code = content.decode("utf-8", "replace").removeprefix("﻿")
    kind, error, facts = None, None, FileFacts()
    try:
        facts, kind = inspect(code, parse(code)), "module"
    except JsSyntaxError as first:
        try:
            facts, kind = inspect(code, parse(code, module=False, loose_return=True)), "script"
        except JsSyntaxError:
            error = str(first)
    row = {"pkg_id": pkg_id, "path": path, "path_json": json.dumps(path, ensure_ascii=False), "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest(), "source_type": kind, "parse_error": error, "externals": facts.externals}
    row["imports"] = [{"specifier": s, "line": n, "base": joined(posixpath.dirname(path), s) if s.startswith(".") else None} for s, n in facts.imports]
    return row | {k: getattr(facts, k) for k in _LISTS if k != "imports"}


def parsed_files(files: DataFrame) -> DataFrame:
    """FILE_SCHEMA for each source file. Large bundles are skewed, so files are dealt anew before they are parsed."""
    sources = files.where("kind = 'source'").select("pkg_id", "path", "content")
    return spread(sources, "pkg_id", "path").mapInArrow(file_batches, FILE_SCHEMA)


def file_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pkg_id, path, content) parsed, in batches of BATCH files or BATCH_BYTES of source."""
    rows, size = [], 0
    for batch in batches:
        for pkg_id, path, content in zip(*batch.columns, strict=True):
            code = content.as_py()
            rows.append(file_row(pkg_id.as_py(), path.as_py(), code))
            size += len(code)
            if len(rows) >= BATCH or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _FILE)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _FILE)


def _strict(text: str) -> dict:
    def refuse(constant: str):
        raise ValueError(constant)

    return json.loads(text, parse_constant=refuse)


def _record(value: object) -> dict:
    if isinstance(value, list):
        return {str(i): v for i, v in enumerate(value)}
    if not isinstance(value, dict):
        return {}
    # keys that are array indexes come first, in their order, as objects have it in JavaScript
    index = [k for k in value if re.fullmatch("0|[1-9][0-9]{0,8}", k)]
    return {k: value[k] for k in [*sorted(index, key=int), *(k for k in value if k not in set(index))]}


def _leaves(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict | list):
        for v in _record(value).values():
            yield from _leaves(v)


def manifest_row(pkg_id: str, content: bytes, section: str) -> dict:
    """The fields of a package.json that rules use. One that is no JSON object is not valid and declares nothing."""
    row = {"pkg_id": pkg_id, "path_json": '"package.json"', "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest(), "valid": False, "name": None, "version": None, "scripts": {}, "dependencies": [], "seams": None, "hints": ["index.js"], "import_map": {}}
    try:
        raw = _strict(content.decode("utf-8", "replace"))
    except ValueError:
        return row
    if not isinstance(raw, dict):
        return row
    strings = lambda value: {k: v for k, v in _record(value).items() if isinstance(v, str)}
    own = raw.get(section)
    seams = own.get("seams") if isinstance(own, dict) else None
    hints = [raw[k] for k in ("main", "module") if isinstance(raw.get(k), str) and raw[k]]
    if isinstance(raw.get("exports"), dict | list):
        hints += _leaves(raw["exports"])
    hints += [raw["bin"]] if isinstance(raw.get("bin"), str) else strings(raw.get("bin")).values()
    mapped = {}
    for key, value in (raw["imports"] if isinstance(raw.get("imports"), dict) else {}).items():
        target = value if isinstance(value, str) else next((value[c] for c in ("node", "default") if isinstance(value.get(c), str)), None) if isinstance(value, dict) else None
        if target is not None:
            mapped[key] = target
    name = lambda key: raw[key] if isinstance(raw.get(key), str) and raw[key] else None
    return row | {
        "valid": True, "name": name("name"), "version": name("version"), "scripts": strings(raw.get("scripts")),
        "dependencies": [{"name": k, "spec": v if isinstance(v, str) else None} for k, v in _record(raw.get("dependencies")).items()],
        "seams": [s for s in seams if isinstance(s, str)] if isinstance(seams, list) else None, "hints": list(dict.fromkeys(hints)) or ["index.js"], "import_map": mapped,
    }


def manifests(files: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [manifest_row(p, c, config.manifest_section) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, _MANIFEST)

    return files.where("kind = 'manifest'").select("pkg_id", "content").mapInArrow(run, MANIFEST_SCHEMA)


def text_key(column: Column | str) -> Column:
    """Sorts by UTF-16 code units."""
    return F.hex(F.encode(F.col(column) if isinstance(column, str) else column, "UTF-16BE"))


def by_locale(column: str) -> Column:
    return F.collate(F.col(column), "UNICODE")


@dataclass
class Analysis:
    """The fact relations of a corpus of packages. ``ord`` is a row's place in its package."""

    packages: DataFrame  #: pkg_id
    files: DataFrame  #: FILE_SCHEMA
    manifests: DataFrame  #: MANIFEST_SCHEMA
    omissions: DataFrame  #: pkg_id, path, reason, detail
    caps: DataFrame
    nets: DataFrame
    evals: DataFrame
    dynamic: DataFrame
    encoded: DataFrame
    charcodes: DataFrame
    entries: DataFrame  #: pkg_id, node
    unresolved: DataFrame  #: pkg_id, hint
    reachable: DataFrame  #: pkg_id, node
    edges: DataFrame  #: pkg_id, src, dst; of reachable files
    unreachable: DataFrame  #: pkg_id, path


def _relation(files: DataFrame, name: str, *then: str) -> DataFrame:
    rows = files.select("pkg_id", F.col("path").alias("file"), F.posexplode(name).alias("at", "x")).select("pkg_id", "file", "at", "x.*")
    order = Window.partitionBy("pkg_id").orderBy(by_locale("file"), "line", *[by_locale(c) for c in then], "file", "at")
    return rows.withColumn("ord", F.row_number().over(order)).drop("at")


def resolved(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """(of wanted, path): the first completion of ``base`` that is a file of the package."""
    keys = wanted.columns
    tries = wanted.where("base is not null").select("*", F.posexplode(F.array(*map(F.lit, SUFFIXES))).alias("_rank", "_suffix"))
    # "x" + "/index.js" is index.js in the root for an empty base
    path = F.regexp_replace(F.concat("base", "_suffix"), "^/", "")
    hit = tries.withColumn("_path", path).join(merged(paths.select("pkg_id", F.col("path").alias("_path")).distinct()), ["pkg_id", "_path"])
    return hit.groupBy(*keys).agg(F.min_by("_path", "_rank").alias("path"))


def analyze(files: DataFrame, config: AuditConfig = DEFAULT) -> Analysis:
    """All facts of ``files`` (FILES_SCHEMA). The parse is materialised once; all else is DataFrame plans over it."""
    parsed = cut(parsed_files(files))
    own = cut(manifests(files, config))
    packages = files.select("pkg_id").distinct()
    paths = files.where("kind <> 'omission'").select("pkg_id", "path")
    sources = parsed.select("pkg_id", "path")
    declared = packages.join(own.select("pkg_id", "hints"), "pkg_id", "left").select("pkg_id", F.explode(F.coalesce("hints", F.array(F.lit("index.js")))).alias("hint"))
    based = _based(declared, "hint")
    landed = cut(resolved(based, paths))
    unresolved = based.join(landed.select("pkg_id", "hint"), ["pkg_id", "hint"], "left_anti").select("pkg_id", "hint").distinct()
    entries = landed.select("pkg_id", "path").join(merged(sources), ["pkg_id", "path"], "left_semi").select("pkg_id", F.col("path").alias("node")).distinct()
    refs = parsed.select("pkg_id", F.col("path").alias("src"), F.explode("imports").alias("i")).select("pkg_id", "src", "i.specifier", "i.base")
    direct = refs.where("specifier like '.%'").select("pkg_id", "src", "base")
    mapped = refs.where("specifier like '#%'").join(own.select("pkg_id", F.explode("import_map").alias("specifier", "target")), ["pkg_id", "specifier"])
    through = _based(mapped.select("pkg_id", "src", "target"), "target").select("pkg_id", "src", "base")
    linked = resolved(direct.union(through).distinct(), paths).select("pkg_id", "src", F.col("path").alias("dst"))
    linked = cut(linked.join(merged(sources.withColumnRenamed("path", "dst")), ["pkg_id", "dst"], "left_semi").select("pkg_id", "src", "dst").distinct())
    seen = reachable(linked, entries, ("pkg_id",))
    return Analysis(
        packages=packages,
        files=parsed,
        manifests=own,
        omissions=files.where("kind = 'omission'").select("pkg_id", "path", "reason", "detail"),
        caps=_relation(parsed, "caps", "api", "cap"),
        nets=_relation(parsed, "nets"),
        evals=_relation(parsed, "evals"),
        dynamic=_relation(parsed, "dynamic"),
        encoded=_relation(parsed, "encoded"),
        charcodes=_relation(parsed, "charcodes"),
        entries=entries,
        unresolved=unresolved,
        reachable=seen,
        edges=linked.join(merged(seen.withColumnRenamed("node", "src")), ["pkg_id", "src"], "left_semi"),
        unreachable=sources.join(merged(seen.withColumnRenamed("node", "path")), ["pkg_id", "path"], "left_anti"),
    )


def _based(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``base``: the column as a path from the package's root."""
    join = F.udf(lambda s: None if s is None else joined("", s), "string")  # one short string a declared entry
    return rows.withColumn("base", join(column))

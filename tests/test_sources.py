import base64
import hashlib
import io
import json
import subprocess
import tarfile

import pytest

from corpuslens.operators import graph
from corpuslens.sources import archive_files, fetched, head_commit, read_metadata, resolve_packages


def packed(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in files.items():
            info = tarfile.TarInfo("package/" + name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.fixture(scope="module")
def mirror(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("mirror")
    one, two = packed({"package.json": b"{}", "index.js": b"1"}), packed({"index.js": b"2"})
    sri = "sha512-" + base64.b64encode(hashlib.sha512(one).digest()).decode()
    documents = [
        {"name": "left", "dist-tags": {"latest": "1.0.0", "next": "2.0.0-a"}, "versions": {"1.0.0": {"version": "1.0.0", "dist": {"tarball": "t/left-1", "integrity": sri}}, "2.0.0-a": {"version": "2.0.0-a", "dist": {"tarball": "t/left-2", "shasum": hashlib.sha1(two).hexdigest()}}}},
        {"name": "@scope/right", "versions": {"0.2.0": {"version": "0.2.0", "dist": {}}, "0.1.0": {"version": "0.1.0", "dist": {"tarball": "t/right"}}}},
        {"name": "bare"},
        ["no", "object"],
    ]
    for i, d in enumerate(documents):
        (folder / f"{i}.json").write_text(json.dumps(d, indent=1))
    archives = spark.createDataFrame([("t/left-1", one), ("t/left-2", two), ("t/right", b"anything")], "tarball string, content binary")
    return read_metadata(spark, str(folder)), archives


def test_packages_are_resolved(spark, mirror):
    asked = ["left", "left@next", "left@1.0.0", "left@9", "@scope/right", "@scope/right@0.2.0", "bare", "gone@1"]
    got = {r.specifier: r for r in resolve_packages(spark.createDataFrame([(s,) for s in asked], "specifier string"), mirror[0]).collect()}
    assert {s: (r.version, r.tarball, r.error) for s, r in got.items()} == {
        "left": ("1.0.0", "t/left-1", None), "left@next": ("2.0.0-a", "t/left-2", None), "left@1.0.0": ("1.0.0", "t/left-1", None), "left@9": (None, None, "no matching version"),
        "@scope/right": ("0.1.0", "t/right", None), "@scope/right@0.2.0": ("0.2.0", None, "no archive"), "bare": (None, None, "no matching version"), "gone@1": (None, None, "unknown package"),
    }


def test_archives_are_verified_and_read(spark, mirror):
    asked = spark.createDataFrame([("left",), ("left@next",)], "specifier string")
    got = fetched(resolve_packages(asked, mirror[0]), mirror[1])
    assert sorted(r.archive_digest for r in got.collect()) == sorted("sha256:" + hashlib.sha256(bytes(r.content)).hexdigest() for r in mirror[1].where("tarball like 't/left%'").collect())
    files = archive_files(got.select("pkg_id", "content"))
    assert {(r.pkg_id, r.path, bytes(r.content)) for r in files.collect()} == {("left", "package.json", b"{}"), ("left", "index.js", b"1"), ("left@next", "index.js", b"2")}
    with pytest.raises(Exception, match="mismatch"):
        fetched(resolve_packages(asked, mirror[0]), mirror[1].withColumn("content", mirror[1].content.substr(1, 20))).collect()


def test_no_metadata(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    assert read_metadata(spark, str(tmp_path)).count() == 0


def test_commit_of_a_checkout(tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-C", str(tmp_path / "w"), *a], check=True, capture_output=True, text=True).stdout.strip()
    (tmp_path / "w").mkdir()
    git("init", "-q")
    assert head_commit(str(tmp_path / "w")) is None and head_commit(str(tmp_path)) is None
    git("commit", "-q", "--allow-empty", "-m", "one")
    head = git("rev-parse", "HEAD")
    assert head_commit(str(tmp_path / "w")) == head
    git("pack-refs", "--all")
    assert head_commit(str(tmp_path / "w")) == head
    git("worktree", "add", "-q", "--detach", str(tmp_path / "v"))
    assert head_commit(str(tmp_path / "v")) == head
    git("clone", "-q", "--bare", ".", str(tmp_path / "bare"))
    assert head_commit(str(tmp_path / "bare")) == head


@pytest.mark.parametrize("local", [0, 10**6])
def test_walks_of_small_and_large_graphs(spark, monkeypatch, local):
    """The same nodes, walked by one task or by frontiers."""
    monkeypatch.setattr(graph, "LOCAL", local)
    edges = spark.createDataFrame([("a", i, i + 1) for i in range(9)] + [("a", 9, 3), ("b", 1, 2), ("b", 2, 1), ("b", 7, 8), ("c", 1, 1)], "k string, src int, dst int")
    starts = spark.createDataFrame([("a", 5), ("b", 1), ("d", 4)], "k string, node int")
    got = {(r.k, r.node) for r in graph.reachable(edges, starts, ("k",)).collect()}
    assert got == {("a", i) for i in range(3, 10)} | {("b", 1), ("b", 2), ("d", 4)}
    loops = {(r.k, r.source, r.node) for r in graph.closure(edges, spark.createDataFrame([("a", 8), ("b", 2), ("b", 7), ("c", 1)], "k string, node int"), ("k",)).collect()}
    assert loops == {("a", 8, i) for i in range(3, 10)} | {("b", 2, 1), ("b", 2, 2), ("b", 7, 8), ("c", 1, 1)}
    one = edges.where("k = 'a'").drop("k")
    assert sorted(r.node for r in graph.reachable(one, spark.createDataFrame([(7,)], "node int")).collect()) == list(range(3, 10))
    assert graph.reachable(one, spark.createDataFrame([], "node int")).count() == 0 and graph.reachable(one.limit(0), spark.createDataFrame([(7,)], "node int")).count() == 1

"""Reachability over edge tables.

The graphs of the audits are many and small: a package's modules. So the edges of a key are first counted; where each
key's walk is at most LOCAL steps, a key is walked whole by one task. Larger graphs are walked by frontier iteration:
each round follows HOPS edges from the frontier alone, drops what was seen, and writes the new frontier once. Rounds are
the longest shortest path by HOPS; a node is expanded in its own round and at most once more.

Where only the number of nodes that a source reaches is asked, the pairs are never made (``reach_counts``): cycles are one
node each, and what is left is counted by sets of bits, a block of targets at a time.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import cut, merged

HOPS = 4
#: Steps of one key's walks (edges, for each source) that one task takes; some 200 bytes of memory each at most.
LOCAL = 1_000_000
#: Edges of a graph that one task holds to count what is reached, bits of all its sets together, and edges to each task.
WHOLE, BITS, SHARE = 4_000_000, 1 << 30, 20_000


def _walk(edges: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """``first`` (keys, node) and all that follows by ``edges`` (a prefix of the keys, src, dst)."""
    on = [k for k in keys if k in edges.columns]
    edges = cut(edges.select(*on, "src", "dst").distinct())
    first = cut(first.select(*keys, "node").distinct())
    own = [k for k in keys if k not in on]
    walks = first.groupBy(*on).agg(F.count_distinct(*own).alias("_walks")) if own else first.select(*on).distinct().withColumn("_walks", F.lit(1))
    sizes = edges.groupBy(*on).agg(F.count("*").alias("_edges"))
    steps = (sizes.join(walks, on) if on else sizes.crossJoin(walks)).agg(F.max(F.col("_edges") * F.col("_walks"))).first()[0]
    if (steps or 0) <= LOCAL:
        return _walk_whole(edges, first, on, keys)
    fronts = [first]
    while not fronts[-1].isEmpty():
        hops = [fronts[-1]]
        for _ in range(HOPS):
            hops.append(hops[-1].withColumnRenamed("node", "src").join(merged(edges), [*on, "src"]).select(*keys, F.col("dst").alias("node")).distinct())
        met = reduce(DataFrame.union, hops[1:]).distinct()
        fronts.append(cut(met.join(merged(reduce(DataFrame.union, fronts)), [*keys, "node"], "left_anti")))
    return reduce(DataFrame.union, fronts)


def _walk_whole(edges: DataFrame, first: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """The same, each key's walks in one task."""
    schema = first.schema
    names = [*keys, "node"]

    def run(links: pa.Table, starts: pa.Table) -> pa.Table:
        follow: dict = {}
        for src, dst in zip(links["src"].to_pylist(), links["dst"].to_pylist(), strict=True):
            follow.setdefault(src, []).append(dst)
        fronts: dict[tuple, list] = {}
        for *key, node in zip(*(starts[c].to_pylist() for c in names), strict=True):
            fronts.setdefault(tuple(key), []).append(node)
        out: list[list] = [[] for _ in names]
        for key, front in fronts.items():
            seen, stack = set(front), list(front)
            while stack:
                for node in follow.get(stack.pop(), ()):
                    if node not in seen:
                        seen.add(node)
                        stack.append(node)
            for column, value in zip(out, key, strict=False):
                column.extend([value] * len(seen))
            out[-1].extend(seen)
        return pa.table({c: pa.array(v, starts.schema.field(c).type) for c, v in zip(names, out, strict=True)})

    by = [F.col(k) for k in on] or [F.lit("all")]
    return edges.groupBy(*by).cogroup(first.groupBy(*by)).applyInArrow(run, schema)


def reachable(edges: DataFrame, starts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node): the starts and all nodes that edges (keys, src, dst) lead to."""
    return _walk(edges, starts, list(keys))


def closure(edges: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, source, node): what each source reaches by one or more edges; itself only by a cycle."""
    key = list(keys)
    tagged = sources.select(*key, F.col("node").alias("source")).distinct()
    first = tagged.join(merged(edges.select(*key, F.col("src").alias("source"), F.col("dst").alias("node"))), [*key, "source"])
    return _walk(edges, first, [*key, "source"])


def reach_counts(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, reached): how many ``targets`` each of ``sources`` reaches by one or more edges; none is no row.

    Each task holds the edges and counts its share of the targets. Graphs of over WHOLE edges are counted by their closure.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    size = edges.count()
    wanted, goals = sources.select("node").distinct(), targets.select("node").distinct()
    if size > WHOLE:
        return closure(edges, wanted).join(goals, "node").groupBy("source").agg(F.count("*").alias("reached"))
    parts = max(1, min(size // SHARE, 16))
    none = F.lit(None).cast(edges.schema["dst"].dataType)
    ends = wanted.select("node", none, F.lit("source")).union(goals.select("node", none, F.lit("target")))
    rows = cut(edges.select("src", "dst", F.lit("edge").alias("kind")).union(ends))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    kind = pa.int64()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        told: dict[str, list] = {"edge": [], "source": [], "target": []}
        for a, b, what in zip(*(table[c].to_pylist() for c in ("src", "dst", "kind")), strict=True):
            told[what].append((a, b) if what == "edge" else a)
        found = _counted(told["edge"], told["source"], told["target"], key[0].as_py(), parts)
        return pa.table({"source": pa.array(list(found), table.schema.field("src").type), "reached": pa.array(list(found.values()), kind)})

    schema = edges.select(F.col("src").alias("source"), F.lit(0).cast("long").alias("reached")).schema
    return each.groupBy("part").applyInArrow(run, schema).groupBy("source").agg(F.sum("reached").alias("reached"))


def _counted(edges: list[tuple], sources: list, targets: list, part: int, parts: int) -> dict:
    """source -> targets reached, of every ``parts``-th block of targets from ``part`` on; the order of the input is of no account."""
    nodes = sorted({n for e in edges for n in e})
    place = {n: i for i, n in enumerate(nodes)}
    follow: list[list[int]] = [[] for _ in nodes]
    for src, dst in sorted(edges):
        follow[place[src]].append(place[dst])
    of = _components(follow)
    many = max(of, default=-1) + 1
    below: list[set[int]] = [set() for _ in range(many)]
    cyclic = [False] * many
    for v, after in enumerate(follow):
        for w in after:
            if of[v] == of[w]:
                cyclic[of[v]] = True
            else:
                below[of[v]].add(of[w])
    held = Counter(of[place[t]] for t in targets if t in place)
    alike: dict[int, list[int]] = {}
    for c in sorted(held):
        alike.setdefault(held[c], []).append(c)
    width = max(64, min(4096, BITS // max(many, 1)))
    blocks = [(weight, cs[i : i + width]) for weight, cs in sorted(alike.items()) for i in range(0, len(cs), width)]
    asked = {of[place[s]] for s in sources if s in place}
    reached = dict.fromkeys(asked, 0)
    for weight, block in blocks[part::parts]:
        bit = {c: 1 << i for i, c in enumerate(block)}
        within = [0] * many  # the block's components that a component is or reaches
        for c in range(block[0], many):  # those before reach none of the block
            far = 0
            for d in below[c]:
                far |= within[d]
            own = bit.get(c, 0)
            within[c] = far | own
            if c in asked:
                reached[c] += weight * (within[c] if cyclic[c] else far).bit_count()
    return {s: n for s in sources if s in place and (n := reached[of[place[s]]])}


def _components(follow: list[list[int]]) -> list[int]:
    """The strongly connected component of each node; edges lead to components of smaller or the same number."""
    met, low, of = [0] * len(follow), [0] * len(follow), [-1] * len(follow)
    open_: list[int] = []
    at = many = 0
    for root in range(len(follow)):
        walk = [] if met[root] else [(root, iter(follow[root]))]
        while walk:
            v, rest = walk[-1]
            if not met[v]:
                at += 1
                met[v] = low[v] = at
                open_.append(v)
            for w in rest:
                if not met[w]:
                    walk.append((w, iter(follow[w])))
                    break
                if of[w] < 0:
                    low[v] = min(low[v], met[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == met[v]:
                    while of[v] < 0:
                        of[open_.pop()] = many
                    many += 1
    return of

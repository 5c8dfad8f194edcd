"""Anti joins, edit-distance joins and snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_use(declared: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``declared`` that nothing uses."""
    return declared.join(used.select(*keys).distinct(), keys, "left_anti")


def undeclared(uses: DataFrame, declared: DataFrame, on: list[str], keys: list[str], site: str) -> DataFrame:
    """Uses of what is not declared, with the first site of each group."""
    return uses.join(declared.select(*on).distinct(), on, "left_anti").groupBy(*keys).agg(F.min(site).alias("first_" + site), F.count("*").alias("uses"))


def near_names(names: DataFrame, column: str, popular: list[str], bound: int = 2) -> DataFrame:
    """(name, near, distance): names within ``bound`` edits of a popular one that are not popular themselves.

    The popular names are a literal array of the plan, so there is no join: each distinct name is compared in place.
    """
    n = F.col("name")
    listed = F.array(*map(F.lit, popular))
    hits = F.filter(
        F.transform(listed, lambda p: F.struct(p.alias("near"), F.when(F.abs(F.length(p) - F.length(n)) > bound, F.lit(-1)).otherwise(F.levenshtein(p, n, bound)).alias("distance"))),
        lambda h: h["distance"] >= 0,
    )
    distinct = names.select(F.col(column).alias("name")).where("name is not null").distinct().where(~n.isin(*popular))
    return distinct.select("name", F.explode(hits).alias("h")).select("name", "h.near", "h.distance")


def full_diff(base: DataFrame, head: DataFrame, keys: list[str], attributes: list[str], change: str = "change") -> DataFrame:
    """Full outer join on the identity: added, removed, changed (an attribute differs) or unchanged.

    Identities must be unique on each side. Null keys match each other.
    """
    b = base.select(*[F.col(k).alias("_b_" + k) for k in keys], *[F.col(a).alias("base_" + a) for a in attributes], F.lit(True).alias("_in_base"))
    h = head.select(*[F.col(k).alias("_h_" + k) for k in keys], *[F.col(a).alias("head_" + a) for a in attributes], F.lit(True).alias("_in_head"))
    same = F.lit(True)
    for k in keys:
        same &= F.col("_b_" + k).eqNullSafe(F.col("_h_" + k))
    differs = F.lit(False)
    for a in attributes:
        differs |= ~F.col("base_" + a).eqNullSafe(F.col("head_" + a))
    kind = F.when(F.col("_in_base").isNull(), "added").when(F.col("_in_head").isNull(), "removed").when(differs, "changed").otherwise("unchanged")
    sides = [f"{s}_{a}" for a in attributes for s in ("base", "head")]
    return b.join(h, same, "full_outer").select(*[F.coalesce("_b_" + k, "_h_" + k).alias(k) for k in keys], *sides, kind.alias(change))


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))

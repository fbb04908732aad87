"""Values of groups given to their rows when a few groups may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: No more groups than this can be larger than a share of 1 / HOT_GROUPS of all rows.
HOT_GROUPS = 16_384
#: Groups up to this size are never hot.
LEAST_HOT = 64


def with_group_values(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row per key and in ``size`` how many ``rows`` share the key.

    Groups above a share of 1 / ``HOT_GROUPS`` of all rows are at most ``HOT_GROUPS`` in number, so they are broadcast; every
    other group is small and its rows may meet in one task of a shuffled join. Null keys are equal to one another. ``groups``
    should be a table, as it is read twice; a left join keeps rows without a group.
    """
    renamed = {k: f"_g{i}" for i, k in enumerate(keys)}
    groups = groups.withColumnsRenamed(renamed)
    total = groups.agg(F.sum(size)).first()[0] or 0
    bound = max(LEAST_HOT, total // HOT_GROUPS)

    def met() -> list:
        return [F.col(k).eqNullSafe(F.col(v)) for k, v in renamed.items()]

    values = [c for c in groups.columns if c not in renamed.values()]
    marked = rows.join(
        F.broadcast(groups.where(F.col(size) > bound).select(
            *renamed.values(), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in values])),
        met(), "left").drop(*renamed.values())
    small = groups.where(F.col(size) <= bound)
    hot = marked.where("_hot").select(*rows.columns, *[F.col(f"_h_{c}").alias(c) for c in values])
    cold = marked.where("_hot is null").select(*rows.columns).join(small, met(), how).drop(*renamed.values())
    return hot.unionByName(cold.select(*hot.columns))

"""Short names of texts and sets that are never shared by different ones."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Bits of a digest that make a name; tests take few, so that names meet.
NAME_BITS = 64
#: Names that others share are told to every task; 64-bit names of 10^11 texts share fewer than 1,000.
MOST_CLASHES = 100_000


def named(digests: bytes, renames: dict[tuple[int, int], int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Name and second name (64 bits each) of digests of 16 bytes end to end."""
    halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
    name = (halves[:, 0] & np.uint64((1 << NAME_BITS) - 1)).view(np.int64).copy()
    second = halves[:, 1].view(np.int64).copy()
    if renames:
        met = np.isin(name, [n for n, _ in renames])
        for at in np.flatnonzero(met).tolist():
            name[at] = renames.get((int(name[at]), int(second[at])), int(name[at]))
    return name, second


def clashes(groups: DataFrame, info: DataFrame) -> dict[tuple[int, int], int]:
    """New names by (name, second name) for what shares its name with something else; nearly always none.

    ``groups`` has a row per name with the least and the largest second name (``low2, high2``), ``info`` every ``name, name2``.
    """
    shared = groups.where("low2 <> high2").select("name")
    if shared.isEmpty():
        return {}
    rows = info.join(F.broadcast(shared.limit(MOST_CLASHES + 1)), "name").select("name", "name2").distinct().limit(MOST_CLASHES + 1).collect()
    if len(rows) > MOST_CLASHES:
        raise ValueError("too many texts share a 64-bit name")
    turn = 0
    while True:
        out = {(r["name"], r["name2"]): int.from_bytes(
            hashlib.blake2b(f"{turn} {r['name']} {r['name2']}".encode(), digest_size=8).digest(), "little", signed=True) for r in rows}
        fresh = list(out.values())
        if len(set(fresh)) == len(fresh) and groups.where(F.col("name").isin(fresh)).isEmpty():
            return out
        turn += 1


def with_new_names(info: DataFrame, renames: dict[tuple[int, int], int]) -> DataFrame:
    """``info`` with the new names in ``name``."""
    if not renames:
        return info
    table = info.sparkSession.createDataFrame(
        [(a, b, new) for (a, b), new in renames.items()], "_name bigint, _name2 bigint, _new bigint")
    met = (F.col("name") == F.col("_name")) & (F.col("name2") == F.col("_name2"))
    return info.join(F.broadcast(table), met, "left").withColumn("name", F.coalesce("_new", "name")).select(*info.columns)

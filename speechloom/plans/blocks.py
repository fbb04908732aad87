"""Ordered work on keys of any size.

A window partitioned by recording puts a whole recording into one task. Here each recording is cut into
bounded blocks along its order; windows run inside ``(keys, block)``, one summary row per block carries the
state over, and only those summary rows are scanned per recording.
"""

from __future__ import annotations

import gc
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

ROWS_PER_BLOCK = 65_536


def index_block(index: Column | str, rows: int = ROWS_PER_BLOCK) -> Column:
    """Block of a dense integer index."""
    index = F.col(index) if isinstance(index, str) else index
    return F.floor(index / rows).cast("bigint")


@dataclass(frozen=True)
class Scan:
    """One running value.

    ``kind``: ``sum`` (inclusive, null counts 0), ``last`` (latest non-null up to the row), ``prev`` (latest
    non-null before the row), ``next`` (earliest non-null after the row), ``ahead`` (earliest non-null from
    the row on), ``max_before`` (maximum before the row) and ``total`` (sum over the whole key).
    """

    name: str
    kind: str
    value: Column


def in_blocks(df: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Rows with their ``_block``, shuffled once on (keys, block).

    Rows without a key or a position belong to no recording. Filtering them here also keeps Spark from
    pushing a null filter into only one of two readers, which would stop it from sharing the shuffle.
    """
    placed = df.withColumn("_block", block)
    for name in (*keys, "_block"):
        placed = placed.filter(F.col(name).isNotNull())
    return placed.repartition(shuffle_width(df), *keys, "_block")


def shuffle_width(df: DataFrame) -> int:
    """The session's number of shuffle partitions.

    Given explicitly, it keeps adaptive coalescing, which weighs bytes only, from packing compute-heavy stages
    into a few tasks.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def whole_rows(base: DataFrame) -> Column:
    """An aggregate that reads every column, so that a summary shares the shuffle of the detail rows."""
    return F.max(F.xxhash64(*base.columns)).alias("_all")


def blocked_scan(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], scans: Iterable[Scan],
) -> DataFrame:
    """Add running values over ``keys`` in ``order`` without a window over whole keys.

    ``block`` must not decrease along ``order``; rows of one block must fit one task. Pass only the columns
    needed later: then both readers of the shuffled rows ask for the same ones and share it.
    """
    scans = list(scans)
    base = in_blocks(df, keys, block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    after = inside.rowsBetween(1, Window.unboundedFollowing)
    onward = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    local_frame = {
        "sum": lambda v: F.sum(v).over(upto),
        "last": lambda v: F.last(v, ignorenulls=True).over(upto),
        "prev": lambda v: F.last(v, ignorenulls=True).over(before),
        "next": lambda v: F.first(v, ignorenulls=True).over(after),
        "ahead": lambda v: F.first(v, ignorenulls=True).over(onward),
        "max_before": lambda v: F.max(v).over(before),
    }
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    summarise = {
        "sum": F.sum, "total": F.sum, "max_before": F.max,
        "last": lambda v: F.max_by(v, F.when(v.isNotNull(), rank)),
        "prev": lambda v: F.max_by(v, F.when(v.isNotNull(), rank)),
        "next": lambda v: F.min_by(v, F.when(v.isNotNull(), rank)),
        "ahead": lambda v: F.min_by(v, F.when(v.isNotNull(), rank)),
    }
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    earlier = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = over_blocks.rowsBetween(1, Window.unboundedFollowing)
    carry = {
        "sum": lambda c: F.sum(c).over(earlier),
        "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
        "prev": lambda c: F.last(c, ignorenulls=True).over(earlier),
        "next": lambda c: F.first(c, ignorenulls=True).over(later),
        "ahead": lambda c: F.first(c, ignorenulls=True).over(later),
        "max_before": lambda c: F.max(c).over(earlier),
        "total": lambda c: F.sum(c).over(Window.partitionBy(*keys)),
    }

    # A block's summary is a couple of values, so scanning all blocks of the largest key stays small.
    summary = base.groupBy(*keys, "_block").agg(
        *[summarise[s.kind](s.value).alias(f"_s_{s.name}") for s in scans],
        whole_rows(base),
    ).filter(F.col("_all").isNotNull())
    carried = summary.select(
        *keys, "_block", *[carry[s.kind](F.col(f"_s_{s.name}")).alias(f"_c_{s.name}") for s in scans]
    )
    local = base.select(
        *base.columns,
        *[local_frame[s.kind](s.value).alias(f"_l_{s.name}") for s in scans if s.kind != "total"],
    )
    joined = local.join(carried, [*keys, "_block"])

    def combine(s: Scan) -> Column:
        got = F.col(f"_c_{s.name}")
        if s.kind == "total":
            return F.coalesce(got, F.lit(0))
        here = F.col(f"_l_{s.name}")
        if s.kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(got, F.lit(0))
        if s.kind == "max_before":
            return F.greatest(here, got)
        return F.coalesce(here, got)

    return joined.select(*df.columns, *[combine(s).alias(s.name) for s in scans])


Fold = Callable[[Any, dict[str, list], bool], tuple[dict[str, list], Any]]


#: Tables written inside the scopes of ``inner_tables`` that are open, the innermost last.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by ``spark.checkpoint.dir``.

    A temporary folder is made only for a local session that names none; on a cluster a missing folder is an error.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="speechloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing a table into the shared folder of the session and reading it back.

    Unlike ``DataFrame.checkpoint`` this computes the rows once and readers take only the columns they need. A table
    written inside ``inner_tables`` is deleted when that scope ends. The shuffle files behind it go as soon as it is written.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    with _shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside remove their shuffle files when they end, without waiting for the driver's garbage collector."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, wherever the file system of that folder is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def let_shuffles_go(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files of plans that nothing refers to any more.

    It learns of them when the driver collects its garbage, which a driver with little to do may not do for an hour; called
    between the heavy steps of an operator, it keeps the files of one step from lying beside those of the next.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def inner_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose ``checkpointed`` tables are deleted at its end, also when it fails.

    It gives a function that writes a result into a table which outlives the scope; what an operator returns must
    read no other table of the scope.
    """
    made: list[str] = []
    outer = _SCOPES[-1] if _SCOPES else None
    _SCOPES.append(made)

    def kept(df: DataFrame) -> DataFrame:
        out = checkpointed(df)
        path = made.pop()
        if outer is not None:
            outer.append(path)
        return out

    try:
        yield kept
    finally:
        _SCOPES.pop()
        for path in made:
            dropped(spark, path)


def chained_fold(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], fold: Fold,
    out_schema: StructType,
) -> DataFrame:
    """A sequential fold along ``order`` of every key, run block by block in parallel.

    ``fold(state, rows, final)`` gets the state left by the rows before (``None`` at the start of a key), the
    next rows as lists per column and whether the key ends with them; it returns output columns and the new state,
    which must be fit for JSON. Rows are sorted by Spark and streamed through the tasks, so neither a key nor a
    block is ever held whole.

    The state each block is entered with is found first (``_settle``); keys of a single block skip that.
    """
    blocked, entries = _entered(df, list(keys), block, list(order), fold)
    schema = StructType([*[blocked.schema[k] for k in keys], *out_schema.fields])
    return _streamed(blocked, entries, list(keys), list(order), fold, schema)


def chained_annotation(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], fold: Fold,
    reads: Sequence[str], added: StructType,
) -> DataFrame:
    """A ``chained_fold`` that gives every row some new columns.

    Only the columns in ``reads`` become Python values; all others pass through as Arrow arrays.
    """
    narrow = df.select(*dict.fromkeys([*keys, *order, *reads]))
    _, entries = _entered(narrow, list(keys), block, list(order), fold)
    blocked = df.withColumn("_block", block)
    schema = StructType([*df.schema.fields, *added.fields])
    return _streamed(blocked, entries, list(keys), list(order), fold, schema,
                     reads=list(reads), added=[f.name for f in added.fields])


def _entered(
    df: DataFrame, keys: list[str], block: Column, order: list[str], fold: Fold,
) -> tuple[DataFrame, DataFrame | None]:
    """The rows with their blocks, and the settled entry states if any key has several blocks."""
    blocked = df.withColumn("_block", block)
    group = [*keys, "_block"]
    # Only keys reaching past their first block need the chain; the narrow count decides it.
    chain = Window.partitionBy(*keys).orderBy("_block")
    blocks = blocked.select(*group).distinct()
    blocks = blocks.select(*group, F.lag("_block").over(chain).alias("_prev"),
                           F.lead("_block").over(chain).isNull().alias("_final"))
    links = blocks.filter(F.col("_prev").isNotNull() | ~F.col("_final"))
    return blocked, None if links.isEmpty() else _settle(blocked, keys, links, order, fold)


#: Rows before a block from each of which its entry state may have come about.
TAIL_ROWS = 64
#: Blocks whose transfer maps one task composes; the composed maps are composed once more per key.
BLOCKS_PER_GROUP = 1024
FRESH = "null"


def _settle(blocked: DataFrame, keys: list[str], links: DataFrame, order: list[str], fold: Fold) -> DataFrame:
    """``keys, _block, _entry, _final`` of all blocks of longer keys, with the state each is entered with.

    Every block is folded once for all states that it may be entered with: those that a fresh start in one of the last rows
    before it leads to. That gives a small map from entry to exit per block; maps are composed over groups of blocks, then
    over the groups of a key, and the states found are handed down again. A state outside of its map is added in a further
    round, which settles at least one more block of every key.
    """
    group = [*keys, "_block"]
    with inner_tables(blocked.sparkSession) as kept:
        links = checkpointed(links)
        guesses = _tails(blocked.join(links.where(~F.col("_final")).select(*group), group, "left_semi"), keys, order, fold)
        linked = links.where(F.col("_prev").isNotNull())
        wanted = linked.join(guesses.withColumnRenamed("_block", "_prev"), [*keys, "_prev"]).select(*group, "_entry").union(
            links.where(F.col("_prev").isNull()).select(*group, F.lit(FRESH).alias("_entry")))
        maps = checkpointed(_transfers(blocked, wanted, keys, order, fold))
        while True:
            walked = checkpointed(_walked(maps, keys))
            missing = walked.where("_missing").select(*group, "_entry")
            if missing.isEmpty():
                return kept(links.select(*group, "_final").join(walked.select(*group, "_entry"), group, "left"))
            maps = checkpointed(maps.union(_transfers(blocked, missing, keys, order, fold)))


def _by_block(batches: Iterable[pa.RecordBatch], group: list[str]) -> Iterator[tuple[tuple, dict[str, list] | None]]:
    """Consecutive rows of a block as lists per column, and None when the block ends."""
    key = None
    for batch in batches:
        data = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        idents = list(zip(*[data[g] for g in group]))
        at = 0
        while at < len(idents):
            if key is not None and idents[at] != key:
                yield key, None
            key, until = idents[at], at + 1
            while until < len(idents) and idents[until] == key:
                until += 1
            yield key, {c: v[at:until] for c, v in data.items() if c not in group}
            at = until
    if key is not None:
        yield key, None


def _state_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _tails(blocked: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """``keys, _block, _entry``: states that a block may leave, from fresh starts at its beginning and in its last rows."""
    group = [*keys, "_block"]
    schema = StructType([*[blocked.schema[g] for g in group], StructField("_entry", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        state, tail, out = None, None, []
        for key, rows in _by_block(batches, group):
            if rows is not None:
                _, state = fold(state, rows, False)
                tail = rows if tail is None else {c: tail[c] + v for c, v in rows.items()}
                tail = {c: v[-TAIL_ROWS:] for c, v in tail.items()}
                continue
            size = len(next(iter(tail.values())))
            found = {json.dumps(state), *(json.dumps(fold(None, {c: v[i:] for c, v in tail.items()}, False)[1]) for i in range(size))}
            out += [(*key, entry) for entry in sorted(found)]
            state, tail = None, None
            if len(out) > 4096:
                yield _state_rows(arrow, out)
                out = []
        yield _state_rows(arrow, out)

    return blocked.repartition(shuffle_width(blocked), *group).sortWithinPartitions(*group, *order).select(
        *group, *[c for c in blocked.columns if c not in group]).mapInArrow(run, schema)


def _transfers(blocked: DataFrame, wanted: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """``keys, _block, _entry, _exit``: the state that each wanted entry leads to. Entries that become one state are folded once from there."""
    group = [*keys, "_block"]
    columns = [c for c in blocked.columns if c not in group]
    wanted = wanted.distinct()
    heads = wanted.select(*group, "_entry", F.lit(0).alias("_mark"), *[F.lit(None).cast(blocked.schema[c].dataType).alias(c) for c in columns])
    rows = blocked.join(wanted.select(*group).distinct(), group, "left_semi").select(
        *group, F.lit(None).cast("string").alias("_entry"), F.lit(1).alias("_mark"), *columns)
    schema = StructType([*[blocked.schema[g] for g in group], StructField("_entry", StringType()), StructField("_exit", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        reached: dict[str, list[str]] = {}  # entries by the state that they have led to
        out = []
        for key, rows in _by_block(batches, group):
            if rows is None:
                out += [(*key, entry, state) for state, entries in reached.items() for entry in entries]
                reached = {}
                if len(out) > 4096:
                    yield _state_rows(arrow, out)
                    out = []
                continue
            marks = rows.pop("_mark")
            entries = rows.pop("_entry")
            first = marks.index(1) if 1 in marks else len(marks)
            for entry in entries[:first]:
                reached[entry] = [entry]
            if first == len(marks):
                continue
            rest, led = {c: v[first:] for c, v in rows.items()}, {}
            for state, came in reached.items():
                led.setdefault(json.dumps(fold(json.loads(state), rest, False)[1]), []).extend(came)
            reached = led
        yield _state_rows(arrow, out)

    return heads.unionByName(rows).repartition(shuffle_width(blocked), *group).sortWithinPartitions(*group, "_mark", *order).select(
        *group, "_entry", "_mark", *columns).mapInArrow(run, schema)


def _walked(maps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _block, _entry, _missing``: the entry of every block as far as the maps lead, and the first that its map lacks."""
    group = [*keys, "_block"]
    kinds = {f.name: f.dataType.simpleString() for f in maps.schema.fields}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    grouped = maps.withColumn("_group", F.floor(F.col("_block") / BLOCKS_PER_GROUP).cast("bigint"))

    def chain(table: pa.Table, place: str) -> list[tuple[int, dict[str, str]]]:
        out: dict[int, dict[str, str]] = {}
        for at, entry, exit_ in zip(*(table.column(c).to_pylist() for c in (place, "_entry", "_exit")), strict=True):
            out.setdefault(at, {})[entry] = exit_
        return sorted(out.items())

    def named(table: pa.Table, columns: dict[str, list]) -> pa.Table:
        size = len(next(iter(columns.values())))
        ident = {k: pa.array([table.column(k)[0].as_py()] * size, table.schema.field(k).type) for k in keys}
        return pa.table({**ident, **columns})

    def compose(table: pa.Table) -> pa.Table:
        steps = chain(table, "_block")
        ends = []
        for state in (starts := list(steps[0][1])):
            for _, step in steps:
                state = step.get(state)
                if state is None:
                    break
            ends.append(state)
        return named(table, {"_group": [table.column("_group")[0].as_py()] * len(starts), "_entry": starts, "_exit": pa.array(ends, pa.string())})

    def enter(table: pa.Table) -> pa.Table:
        state, places, entries = FRESH, [], []
        for place, step in chain(table, "_group"):
            places.append(place)
            entries.append(state)
            state = step.get(state)
            if state is None:
                break
        return named(table, {"_group": pa.array(places, pa.int64()), "_first": pa.array(entries, pa.string())})

    def descend(own: pa.Table, given: pa.Table) -> pa.Table:
        if not own.num_rows or not given.num_rows:
            source = own if own.num_rows else given
            return pa.table({**{k: pa.array([], source.schema.field(k).type) for k in keys}, "_block": pa.array([], pa.int64()),
                             "_entry": pa.array([], pa.string()), "_missing": pa.array([], pa.bool_())})
        state, places, entries, missing = given.column("_first")[0].as_py(), [], [], []
        for place, step in chain(own, "_block"):
            places.append(place)
            entries.append(state)
            missing.append(state not in step)
            if missing[-1]:
                break
            state = step[state]
        return named(own, {"_block": pa.array(places, pa.int64()), "_entry": pa.array(entries, pa.string()), "_missing": pa.array(missing, pa.bool_())})

    composed = grouped.groupBy(*keys, "_group").applyInArrow(compose, f"{head}, _group bigint, _entry string, _exit string")
    entered = composed.groupBy(*keys).applyInArrow(enter, f"{head}, _group bigint, _first string")
    return grouped.groupBy(*keys, "_group").cogroup(entered.groupBy(*keys, "_group")).applyInArrow(
        descend, f"{head}, _block bigint, _entry string, _missing boolean")


def _streamed(
    blocked: DataFrame, entries: DataFrame | None, keys: list[str], order: list[str], fold: Fold,
    schema: StructType, *, reads: list[str] | None = None, added: list[str] | None = None,
) -> DataFrame:
    """Fold the sorted rows of every block. A known entry state travels as an extra row ahead of its block."""
    group = [*keys, "_block"]
    columns = [c for c in blocked.columns if c not in group]
    rows = blocked.withColumns({
        "_mark": F.lit(1), "_entry": F.lit(None).cast("string"), "_final": F.lit(True)})
    if entries is not None:
        heads = entries.select(
            *group, "_entry", "_final", F.lit(0).alias("_mark"),
            *[F.lit(None).cast(blocked.schema[c].dataType).alias(c) for c in columns])
        rows = rows.unionByName(heads)
    ordered = rows.repartition(shuffle_width(blocked), *group).sortWithinPartitions(*group, "_mark", *order)
    names = [f.name for f in schema.fields]
    arrow = to_arrow_schema(schema)

    def run(batches):
        key, state, final, waiting = None, None, True, None
        out = {name: [] for name in names}

        def step(ends):
            nonlocal state
            made, state = fold(state, waiting, ends and final)
            count = len(next(iter(made.values())))
            for name, value in zip(keys, key):
                out[name].extend([value] * count)
            for name, values in made.items():
                out[name].extend(values)

        for batch in batches:
            data = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            idents = list(zip(*[data[g] for g in group]))
            size, at = len(idents), 0
            while at < size:
                if idents[at] != key:
                    if waiting is not None:
                        step(True)
                    key, state, final, waiting = idents[at], None, True, None
                if data["_mark"][at] == 0:
                    final = data["_final"][at]
                    state = None if data["_entry"][at] is None else json.loads(data["_entry"][at])
                    at += 1
                    continue
                until = at + 1
                while until < size and idents[until] == key:
                    until += 1
                if waiting is not None:
                    step(False)
                waiting = {c: data[c][at:until] for c in columns}
                at = until
            yield pa.RecordBatch.from_pydict(out, schema=arrow)
            out = {name: [] for name in names}
        if waiting is not None:
            step(True)
        yield pa.RecordBatch.from_pydict(out, schema=arrow)

    def annotate(batches):
        key, state = None, None
        for batch in batches:
            data = {name: batch.column(name).to_pylist() for name in [*group, *reads, "_mark", "_entry"]}
            idents = list(zip(*[data[g] for g in group]))
            made = {name: [] for name in added}
            size, at = len(idents), 0
            while at < size:
                if idents[at] != key:
                    key, state = idents[at], None
                if data["_mark"][at] == 0:
                    state = None if data["_entry"][at] is None else json.loads(data["_entry"][at])
                    at += 1
                    continue
                until = at + 1
                while until < size and idents[until] == key:
                    until += 1
                values, state = fold(state, {c: data[c][at:until] for c in reads}, False)
                for name in added:
                    made[name].extend(values[name])
                at = until
            kept = pa.array([m == 1 for m in data["_mark"]])
            passed = [batch.column(f.name).filter(kept).cast(f.type) for f in arrow if f.name not in added]
            yield pa.RecordBatch.from_arrays(
                [*passed, *[pa.array(made[f.name], type=f.type) for f in arrow if f.name in added]], schema=arrow)

    ready = ordered.select(*group, "_mark", "_entry", "_final", *columns)
    return ready.mapInArrow(run if reads is None else annotate, schema)

"""Speaker turns against timed items: overlap join, dominant speaker, nearest turn, embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from speechloom.plans.blocks import Scan, blocked_scan

BUCKET_MS = 30_000
MIDPOINT_BUCKET = 600_000


def unpack_turns(tracks: DataFrame) -> DataFrame:
    """Flatten ``(recording_id, turn_idx, segment struct<start,end>, track, speaker)`` rows of a diarizer."""
    return tracks.select(
        "recording_id", "turn_idx", "track", "speaker",
        F.col("segment.start").alias("start_ms"), F.col("segment.end").alias("end_ms"),
    )


def _in_buckets(df: DataFrame, width: int, start: str, end: str) -> DataFrame:
    """One row for every time bucket the half-open interval touches."""
    first = F.floor(F.col(start) / width)
    final = F.floor((F.col(end) - 1) / width)
    return df.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, final))))


def overlap_join(
    items: DataFrame, turns: DataFrame, item_keys: Sequence[str] = ("segment_idx",), bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """All (item, turn) pairs sharing a positive stretch of time, with ``overlap_ms``.

    Equi-join on (recording, time bucket), so a long recording spreads over many tasks and an item meets only
    turns of its own buckets. A pair met in several buckets is kept in the one where its overlap begins.
    """
    item_side = _in_buckets(
        items.select("recording_id", *item_keys, F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
        .filter(F.col("_e") > F.col("_s")), bucket_ms, "_s", "_e")
    turn_side = _in_buckets(
        turns.select("recording_id", "turn_idx", "speaker", F.col("start_ms").alias("turn_start_ms"),
                     F.col("end_ms").alias("turn_end_ms"))
        .filter(F.col("turn_end_ms") > F.col("turn_start_ms")), bucket_ms, "turn_start_ms", "turn_end_ms")
    begin = F.greatest("_s", "turn_start_ms")
    return (
        item_side.join(turn_side, ["recording_id", "_bucket"])
        .filter((F.col("turn_start_ms") < F.col("_e")) & (F.col("turn_end_ms") > F.col("_s"))
                & (F.floor(begin / bucket_ms) == F.col("_bucket")))
        .select("recording_id", *item_keys, "turn_idx", "speaker", "turn_start_ms",
                (F.least("_e", "turn_end_ms") - begin).alias("overlap_ms"))
    )


def known_times(items: DataFrame) -> DataFrame:
    """Items that can be placed: a start is needed, a missing end equals the start."""
    return items.filter(F.col("start_ms").isNotNull()).withColumn("end_ms", F.coalesce("end_ms", "start_ms"))


def defaulted_times(segments: DataFrame) -> DataFrame:
    """Segments always count; missing times are 0."""
    return segments.withColumns({
        "start_ms": F.coalesce("start_ms", F.lit(0).cast("bigint")),
        "end_ms": F.coalesce("end_ms", F.lit(0).cast("bigint")),
    })


def dominant_speaker(
    items: DataFrame, turns: DataFrame, item_keys: Sequence[str] = ("segment_idx",), bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """The speaker with most overlap per item; on a tie the one whose first overlapping turn starts earliest.

    Overlap sums are integers, so partial sums on the map side cannot flip a tie. Both groupings combine
    before they shuffle: an item under many turns sends one row per speaker and task.
    """
    keys = ["recording_id", *item_keys]
    per_speaker = overlap_join(items, turns, item_keys, bucket_ms).groupBy(*keys, "speaker").agg(
        F.sum("overlap_ms").alias("total"),
        F.min(F.struct("turn_start_ms", "turn_idx")).alias("first"),
    )
    best = F.struct(-F.col("total"), "first.turn_start_ms", "first.turn_idx")
    return per_speaker.groupBy(*keys).agg(
        F.min_by(F.struct("speaker", "total"), best).alias("_b")
    ).select(*keys, F.col("_b.speaker").alias("speaker"), F.col("_b.total").alias("overlap_ms"))


def nearest_speaker(
    items: DataFrame, turns: DataFrame, item_keys: Sequence[str] = ("segment_idx",),
    bucket_ms: int = MIDPOINT_BUCKET,
) -> DataFrame:
    """Speaker of the turn whose midpoint is nearest to the item's; on a tie the turn that starts first.

    Midpoints of turns and items are merged on one time axis and every item looks at its neighbours on both
    sides. The look-ups run inside time blocks and cross block borders by carried summaries.
    """
    turn = F.struct(
        (F.col("start_ms") + F.col("end_ms")).alias("mid2"), "start_ms", "turn_idx", "speaker")
    # Turns sharing a midpoint: only the first one can win.
    marks = (
        turns.select("recording_id", turn.alias("t")).groupBy("recording_id", F.col("t.mid2").alias("mid2"))
        .agg(F.min(F.struct(F.col("t.start_ms").alias("start_ms"), F.col("t.turn_idx").alias("turn_idx"),
                            F.col("t.speaker").alias("speaker"))).alias("m"))
        .select("recording_id", "mid2", F.lit(0).alias("kind"),
                F.struct(F.col("mid2").alias("mid2"), "m.start_ms", "m.turn_idx", "m.speaker").alias("mark"),
                *[F.lit(None).cast(items.schema[k].dataType).alias(k) for k in item_keys])
    )
    probes = items.select(
        "recording_id", (F.col("start_ms") + F.col("end_ms")).alias("mid2"), F.lit(1).alias("kind"),
        F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), *item_keys)
    axis = marks.unionByName(probes)
    seen = blocked_scan(
        axis, ["recording_id"], F.floor(F.col("mid2") / (2 * bucket_ms)), ["mid2", "kind"],
        [Scan("_left", "last", F.col("mark")), Scan("_right", "next", F.col("mark"))],
    ).filter(F.col("kind") == 1)

    def rank(side: str) -> Column:
        m = F.col(side)
        return F.when(m.isNotNull(), F.struct(
            F.abs(m["mid2"] - F.col("mid2")).alias("d"), m["start_ms"].alias("s"), m["turn_idx"].alias("i"),
            m["speaker"].alias("speaker")))

    chosen = seen.select("recording_id", *item_keys, F.least(rank("_left"), rank("_right")).alias("n"))
    return chosen.filter(F.coalesce(F.col("n.speaker"), F.lit("")) != "").select(
        "recording_id", *item_keys, F.col("n.speaker").alias("speaker"))


def assign_speakers(
    items: DataFrame, turns: DataFrame, item_keys: Sequence[str] = ("segment_idx",), *,
    fill_nearest: bool = False, bucket_ms: int = BUCKET_MS, whole_segments: bool = False,
) -> DataFrame:
    """Every item with its speaker: by overlap, else (if asked) by nearest turn, else what it already had.

    Adds ``speaker`` and ``speaker_by`` (``overlap``, ``nearest`` or null). Words without a start cannot be placed; ``whole_segments``
    always can, their missing times count as 0.
    """
    keys = ["recording_id", *item_keys]
    placed = (defaulted_times if whole_segments else known_times)(items).select(*keys, "start_ms", "end_ms")
    by_overlap = dominant_speaker(placed, turns, item_keys, bucket_ms).select(
        *keys, F.col("speaker").alias("_o"), F.lit(True).alias("_hit"))
    out = items.join(by_overlap, keys, "left")
    nearest = F.lit(None).cast("string")
    if fill_nearest:
        rest = placed.join(by_overlap, keys, "left_anti")
        by_mid = nearest_speaker(rest, turns, item_keys).withColumnRenamed("speaker", "_n")
        out = out.join(by_mid, keys, "left")
        nearest = F.col("_n")
    had = F.col("speaker") if "speaker" in items.columns else F.lit(None).cast("string")
    found = (F.when(F.col("_hit"), F.col("_o")).otherwise(F.coalesce(nearest, had)))
    by = F.when(F.col("_hit"), "overlap").when(nearest.isNotNull(), "nearest")
    return out.withColumn("speaker_by", by).withColumn("speaker", found).drop("_o", "_n", "_hit")


def attach_embeddings(speakers: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Embedding vector of every (recording, speaker), also where one speaker has most of the rows."""
    return speakers.join(embeddings, ["recording_id", "speaker"], "left")


#: Recordings with more vectors are clustered by the weighted centres of at most so many cells.
MOST_POINTS = 1024
#: A cut below this many times the height of the merge before it is no evidence for a second speaker.
SPLIT_RATIO = 1.5


def ward_merges(points: np.ndarray, weights: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges of weighted points by least growth of the squared error, lowest first, found by chains of nearest neighbours.

    A merge joins the clusters that hold two points; ties go to the lower ones.
    """
    n = len(points)
    size = weights.astype(np.float64)
    square = (points * points).sum(1)
    cost = np.maximum(square[:, None] + square[None] - 2 * points @ points.T, 0.0) * (size[:, None] * size / (size[:, None] + size))
    np.fill_diagonal(cost, np.inf)
    merges, chain, alive = [], [], np.ones(n, bool)
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        b = int(np.argmin(cost[a]))
        if len(chain) > 1 and cost[a, chain[-2]] <= cost[a, b]:
            b = chain[-2]
        if len(chain) < 2 or b != chain[-2]:
            chain.append(b)
            continue
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        merges.append((float(cost[a, b]), a, b))
        grown = ((size[a] + size) * cost[a] + (size[b] + size) * cost[b] - size * cost[a, b]) / (size[a] + size[b] + size)
        grown[~alive] = np.inf
        grown[[a, b]] = np.inf
        cost[a], cost[:, a] = grown, grown
        cost[b], cost[:, b] = np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
    return sorted(merges)


def cut_merges(merges: list[tuple[float, int, int]], n: int, low: int, high: int) -> np.ndarray:
    """Cluster of each point, as many as the steepest step of the merge heights says within ``low`` and ``high``."""
    heights = [h for h, _, _ in merges]
    low, high = max(1, min(low, n)), max(1, min(high, n))

    def steepness(k: int) -> float:
        """Height of the merge that leaves k - 1 clusters, over that of the one before."""
        if k == 1:
            return SPLIT_RATIO
        before = heights[n - k - 1] if k < n else 0.0
        return heights[n - k] / max(before, 1e-12)

    k = max(range(low, high + 1), key=lambda k: (steepness(k), -k))
    head = np.arange(n)
    for _, a, b in merges[: n - k]:
        head[head == head[b]] = head[a]
    return np.unique(head, return_inverse=True)[1]


def cluster_speakers(
    embeddings: DataFrame, *, num: int | None = None, low: int = 2, high: int = 8, id_column: str = "vec_id",
) -> DataFrame:
    """The vectors with the ``speaker`` of their recording, numbered by the speaker's smallest id.

    ``embeddings``: ``recording_id``, ``id_column``, ``embedding`` and, where they are given, ``min_speakers`` and ``max_speakers`` of the
    recording, which go before ``num`` (an exact count) or ``low`` and ``high``. Vectors are clustered within each recording by Ward's
    criterion and cut at the steepest step; every vector then goes to the nearest of its recording's centres. Recordings
    of more than ``MOST_POINTS`` vectors are reduced to weighted centres of cells first, which combine on the map side, so no
    task holds more points of a recording. Rows without a vector have no speaker.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    if num is None and not 1 <= low <= high:
        raise ValueError("speaker bounds must satisfy 1 <= low <= high")
    low, high = (num, num) if num is not None else (low, high)
    bound = lambda name, value: F.coalesce(F.max(name), F.lit(value)) if name in embeddings.columns else F.lit(value)
    vectors = embeddings.filter(F.col("embedding").isNotNull()).withColumn("_v", F.col("embedding").cast("array<double>"))
    facts = vectors.groupBy("recording_id").agg(
        F.count("*").alias("_n"), vector_to_array(Summarizer.mean(array_to_vector("_v"))).alias("_mean"),
        bound("min_speakers", low).cast("int").alias("_low"), bound("max_speakers", high).cast("int").alias("_high"))
    bits = MOST_POINTS.bit_length() - 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_v").to_pylist()
            cells = batch.column(id_column).cast(pa.int64()).to_numpy(zero_copy_only=False).copy()
            large = np.flatnonzero(batch.column("_n").to_numpy() > MOST_POINTS)
            if len(large):
                means = batch.column("_mean").to_pylist()
                shifted = np.array([np.subtract(x[i], means[i]) for i in large.tolist()])
                planes = np.random.default_rng(17).standard_normal((shifted.shape[1], bits))
                cells[large] = (shifted @ planes > 0) @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("recording_id", id_column, "_v", "_low", "_high")), pa.array(cells)],
                names=["recording_id", "_id", "_v", "_low", "_high", "_cell"])

    kind = vectors.schema["recording_id"].dataType.simpleString()
    joined = vectors.select("recording_id", id_column, "_v").join(facts, "recording_id")
    cells = joined.mapInArrow(
        placed, f"recording_id {kind}, _id {vectors.schema[id_column].dataType.simpleString()}, _v array<double>, _low int, _high int, _cell bigint",
    ).groupBy("recording_id", "_cell").agg(
        vector_to_array(Summarizer.mean(array_to_vector("_v"))).alias("_v"), F.count("*").alias("_n"), F.min("_id").alias("_id"),
        F.first("_low").alias("_low"), F.first("_high").alias("_high"))

    def clustered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id").reset_index(drop=True)
        points, weights = np.array(rows["_v"].tolist(), np.float64), rows["_n"].to_numpy(np.float64)
        label = cut_merges(ward_merges(points, weights), len(points), int(rows["_low"][0]), int(rows["_high"][0]))
        order = np.unique(label, return_index=True)[1].argsort()
        centres = [np.average(points[label == k], axis=0, weights=weights[label == k]).tolist() for k in order]
        return pd.DataFrame({"recording_id": rows["recording_id"][:1], "_centres": [centres]})

    centres = cells.groupBy("recording_id").applyInPandas(clustered, f"recording_id {kind}, _centres array<array<double>>")
    gap = lambda c: F.aggregate(F.zip_with(c, F.col("embedding"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    near = F.array_min(F.transform("_centres", lambda c, i: F.struct(gap(c).alias("d"), i.alias("i"))))
    name = F.concat(F.lit("SPEAKER_"), F.lpad(near["i"].cast("string"), 2, "0"))
    return embeddings.join(centres, "recording_id", "left").withColumn(
        "speaker", F.when(F.col("embedding").isNotNull(), name)).drop("_centres")

"""Mixing sources to target weights by Poisson replication.

Each document is repeated as often as a Poisson variable with the mean rate of its source says; the variable inverts a
uniform number taken from a hash of the document's id, so any run, partitioning or retry gives the same copies. One
shuffle by a second hash deals the copies out in random order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from speechloom.plans.blocks import checkpointed

SEED = 20_250
#: Means above this are drawn as sums of independent parts, so that exp(-mean) stays far from underflow.
MAX_MEAN = 256.0
_DIGITS = 13  # hexadecimal digits of a uniform number: 52 bits, exact in a double


def hashed(*parts: Column | str | int) -> Column:
    """Hexadecimal digest of the parts; null takes part as a word of its own."""
    cells = [F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cells))


def uniform(digest: Column) -> Column:
    """A number in [0, 1) from the first digits of a digest."""
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("bigint") / F.lit(float(16**_DIGITS))


def source_rates(docs: DataFrame, targets: Mapping[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """``source_key, rate, parts, cdf``: the mean repetition rate of each source and its Poisson distribution.

    The weight of a source is its entry in ``targets`` (0 if absent), or without targets the square root of its size,
    which lifts small sources. A source's size is its bytes plus one for each document, so it is never 0. ``rate =
    weight share * epochs * total size / source size``.
    """
    sizes = checkpointed(docs.groupBy(_key(F.col("source")).alias("source_key")).agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("size")))
    if targets is None:
        weighed = sizes.withColumn("weight", F.sqrt(F.col("size").cast("double")))
    else:
        given = {_name(k): float(v) for k, v in targets.items()}
        cases = F.create_map(*[F.lit(x) for pair in given.items() for x in pair]) if given else None
        weight = F.coalesce(F.try_element_at(cases, F.col("source_key")), F.lit(0.0)) if given else F.lit(0.0)
        weighed = sizes.withColumn("weight", weight)
    # One row of totals; the sizes behind it stay a table.
    total = weighed.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes")).first()
    weights, size = float(total["weights"] or 0.0), float(total["sizes"] or 0)
    rate = F.col("weight") / F.lit(weights) * F.lit(size * epochs) / F.col("size") if weights else F.lit(0.0)
    rated = weighed.select("source_key", rate.alias("rate"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int")
    rated = rated.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    # Beyond the last k the chance is below the resolution of a uniform number.
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 40).cast("int")
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def further(a: Column, k: Column) -> Column:
        p = a["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + p)).alias("cdf"))

    return rated.select("source_key", "rate", "parts",
                        F.aggregate(F.sequence(F.lit(1), last), first, further, lambda a: a["cdf"]).alias("cdf"))


def _name(source: str | None) -> str:
    return "n" if source is None else "s" + source


def _key(source: Column) -> Column:
    """A null source is a source of its own, apart from any name."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def _drawn(docs: DataFrame, targets: Mapping[str, float] | None, epochs: float, seed: int) -> DataFrame:
    """``_row`` (all columns of a row), ``copy`` and ``shuffle_key`` of every copy, in random order.

    The rates are one row per source, written once; Spark sends them along with the scan if their files are small
    enough, else it joins by shuffle and splits hot sources.
    """
    rates = checkpointed(source_rates(docs, targets, epochs))
    keyed = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_id"), _key(docs["source"]).alias("source_key"))
    drawn = lambda part: uniform(hashed(seed, F.col("_id"), part))
    below = lambda part: F.size(F.filter("cdf", lambda c: c <= drawn(part)))
    count = F.when(F.col("parts") == 1, F.size(F.filter("cdf", lambda c: c <= F.col("_u")))).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, part: n + below(part)))
    copies = (
        keyed.withColumn("_u", drawn(F.lit(1)))
        .join(rates, "source_key")
        .withColumn("_count", count)
        .where("_count > 0")
        .select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("copy"))
        .withColumn("shuffle_key", hashed(seed, "copy", F.col("_id"), F.col("copy")))
    )
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(width, "shuffle_key").sortWithinPartitions("shuffle_key")


def mixed_copies(docs: DataFrame, targets: Mapping[str, float] | None = None, epochs: float = 1.0,
                 seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with ``copy`` (from 1) and ``shuffle_key``, in random order.

    Rows with the same id are drawn alike; a null id has its own draw. Empty and null texts count one byte. Sources with
    weight 0 are left out, as their target says. An empty table gives no rows. ``copy`` and ``shuffle_key`` of the
    input are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    return _drawn(docs, targets, epochs, seed).select(*[F.col("_row")[c].alias(c) for c in docs.columns], "copy", "shuffle_key")


def mixed_rows(docs: DataFrame, targets: Mapping[str, float] | None = None, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """``mixed_copies`` with the columns of ``docs`` and no others, whatever these are called."""
    return _drawn(docs, targets, epochs, seed).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def mixture(docs: DataFrame) -> DataFrame:
    """The registered query: all sources by the square root of their size, one epoch."""
    return mixed_copies(docs.select("doc_id", "source", "text"))


ORACLE = f"""
WITH RECURSIVE sizes AS (
  SELECT CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS source_key,
         sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS size
  FROM documents GROUP BY 1),
rates AS (
  SELECT source_key, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS rate FROM sizes),
cdf AS (
  SELECT source_key, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS total FROM rates
  UNION ALL
  SELECT source_key, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
steps AS (SELECT source_key, list(total) AS totals FROM cdf GROUP BY 1),
drawn AS (
  SELECT doc_id, source, text, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS source_key,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, {_DIGITS}))::BIGINT / {16.0**_DIGITS:.1f} AS u
  FROM documents),
counted AS (
  SELECT doc_id, source, text, len(list_filter(totals, lambda t: t <= u)) AS n FROM drawn JOIN steps USING (source_key)),
copies AS (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy FROM counted)
SELECT doc_id, source, text, copy::INTEGER AS copy,
       md5('{SEED}:copy:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key
FROM copies
"""

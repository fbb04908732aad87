"""Quality rules as a short-circuit cascade of column expressions.

Base facts of a text are counted by array functions on its own row: no shuffle, no Python. The rules behind the base are independent
predicates; their costs and selectivities are measured on a bounded sample, and one ``CASE`` evaluates them in order of
rejections per second, so a rejected document pays for no later rule. The order changes the time taken, never the
verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Bound of the sample on which costs and selectivities are measured.
SAMPLE_ROWS = 400
_SAMPLE_SHARE = 16


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a predicate over the columns of ``counted``; null counts as not rejected."""

    name: str
    rejects: Column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " ", -1), "")


def without(text: Column, signs: str) -> Column:
    """The text without some characters."""
    return F.translate(text, signs, "")


def repeat_words(hashes: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found at least twice, given the hashes of all words."""
    width = F.lit(WINDOW)

    def covered(keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("at"))))
        same = lambda s, k, step, key: F.coalesce(F.get(s, k + step)["key"] == key, F.lit(False))
        starts = let(ranked, lambda s: F.sort_array(F.array_compact(F.transform(
            s, lambda x, k: F.when(same(s, k, -1, x["key"]) | same(s, k, 1, x["key"]), x["at"])))))
        none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        grow = lambda a, at: F.struct(
            at.alias("last"), (a["total"] + F.least(width, at - a["last"])).alias("total"))
        return F.aggregate(starts, none, grow, lambda a: a["total"])

    def counted(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        keys = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(covered(k)))

    return let(hashes, lambda h: F.when(F.size(h) <= width, 0).otherwise(counted(h))).cast("bigint")


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``_words``, ``_lines`` (those that have a word) and the base facts of the text.

    A null text has no words and no symbols.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spaced = docs.withColumn("_words", words(text)).withColumn(
        "_lines", F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    return spaced.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(without(text, BLANKS)).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": repeat_words(F.transform("_words", lambda w: F.xxhash64(w))),
    }).withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                  | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def rules() -> tuple[Rule, ...]:
    """The rules behind the base; any order gives the same verdict."""
    n, share = F.col("n_words"), lambda part, percent, whole: 100 * part > percent * whole
    lines = F.size("_lines")
    tally = lambda array, test: F.size(F.filter(array, test))
    return (
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("symbols", share(F.col("n_symbols"), 10, n)),
        Rule("duplicate_lines", share(F.col("n_dup_lines"), 30, lines)),
        Rule("bullets", share(tally("_lines", lambda x: F.ltrim(x).startswith("-") | F.ltrim(x).startswith("•")), 90, lines)),
        Rule("ellipses", share(tally("_lines", lambda x: x.endswith("...") | x.endswith("…")), 30, lines)),
        Rule("letters", share(tally("_words", lambda w: ~w.rlike(r"\p{L}")), 20, n)),
    )


#: Rows are repeated until a rule takes this long and as long again as an empty one.
LEAST_SECONDS = 0.2
#: Rows of the first and of the last try; what costs nothing over so many is taken for free.
LEAST_ROWS, MOST_ROWS = 4096, 1 << 18


class Stopwatch:
    """What tests cost per row: their time within a task over repeated rows, less the time of the same task without them.

    Planning and scheduling are in both times and cancel out; rows are repeated until they no longer matter.
    """

    def __init__(self, sample: DataFrame, rows: int):
        self.sample, self.rows, self.empty = sample, max(1, rows), {}

    def _spent(self, test: Column, repeats: int) -> float:
        probe = self.sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).agg(F.count_if(test))
        times = []
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            probe.first()
            times.append(time.perf_counter() - began)
        return min(times)

    def seconds(self, test: Column) -> float:
        repeats = max(1, LEAST_ROWS // self.rows)
        while True:
            if repeats not in self.empty:
                self.empty[repeats] = self._spent(F.col("_again") < 0, repeats)
            extra = self._spent(test, repeats) - self.empty[repeats]
            if extra > max(LEAST_SECONDS, self.empty[repeats]) or repeats * self.rows >= MOST_ROWS:
                return max(extra, 1e-6) / repeats / self.rows
            repeats *= 8


def ordered(docs: DataFrame, chosen: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second, measured on a sample of at most ``sample_rows`` rows.

    The sample is taken by row hash from the first rows that have it, is bounded at any size of the input and only decides
    the order. ``take`` reads partition after partition until it has enough, so the table is not scanned for it.
    """
    spark = docs.sparkSession
    rows = docs.where(F.pmod(F.xxhash64("text"), F.lit(_SAMPLE_SHARE)) == 0).select("text")
    taken = [(r["text"],) for r in rows.take(sample_rows)]
    sample = counted(spark.createDataFrame(taken, "text string").coalesce(1)).persist()
    try:
        hits = sample.agg(F.count("*").alias("rows"), *[F.count_if(r.rejects).alias(str(i)) for i, r in enumerate(chosen)]).first()
        if not hits["rows"]:
            return sorted(chosen, key=lambda rule: rule.name)
        watch = Stopwatch(sample, hits["rows"])
        weight = {rule.name: (hits[str(i)] + 0.5) / hits["rows"] / watch.seconds(rule.rejects) for i, rule in enumerate(chosen)}
        return sorted(chosen, key=lambda rule: (-weight[rule.name], rule.name))
    finally:
        sample.unpersist()


def judged(docs: DataFrame, chosen: Sequence[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows with the base facts, ``base_failed`` and ``kept``; all rows stay.

    ``kept`` is false where the base failed or any rule rejects. Null and empty texts have no words and fail the
    base; repeated rows are judged alike, each on its own; an empty table stays empty. Columns of the input
    that clash with a fact are replaced by it.
    """
    facts = ["_words", "_lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    narrow = docs.drop(*[c for c in facts if c != text_col]).withColumnRenamed(text_col, "text")
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in ordered(narrow.select("text"), rules() if chosen is None else chosen):
        verdict = verdict.when(rule.rejects, F.lit(False))
    return (counted(narrow).withColumn("kept", verdict.otherwise(F.lit(True)))
            .drop("_words", "_lines").withColumnRenamed("text", text_col))


def quality_facts(docs: DataFrame) -> DataFrame:
    """One row per document: facts and verdict."""
    return judged(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is to keep them, with their own columns only."""
    columns = docs.columns
    tagged = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias("_row"), F.col("text"))
    return judged(tagged).where("kept").select(*[F.col("_row")[c].alias(c) for c in columns])


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM base WHERE len(words) >= 9)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
facts AS (
  SELECT doc_id, words, lines, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM base LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_symbols > 10 * n_words
            OR 100 * n_dup_lines > 30 * len(lines)
            OR 100 * len(list_filter(lines, lambda l: starts_with(ltrim(l), '-') OR starts_with(ltrim(l), '•'))) > 90 * len(lines)
            OR 100 * len(list_filter(lines, lambda l: suffix(l, '...') OR suffix(l, '…'))) > 30 * len(lines)
            OR 100 * len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{L}'))) > 20 * n_words) AS kept
FROM judged
"""

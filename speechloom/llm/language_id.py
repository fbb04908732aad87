"""Languages of web pages from several kinds of evidence, fused by Bayes' rule.

* Text: a naive Bayes model over hashed character trigrams, fitted on a bounded sample of labelled documents.
* Declared markup language and address suffix: how often each value goes with each language, summed over all pages.
* Host: a prior per host, smoothed towards its site (the last two labels), that towards the whole corpus.

The sums are taken over the pages' text posteriors, so no page needs a label; a page's own share is taken out of every sum before
it is judged. All sums are grouped aggregations with partial sums on the map side; only the text model, whose size is a
parameter, is sent along.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from speechloom.llm.batches import flat, ragged, sliced
from speechloom.plans.blocks import checkpointed

BITS = 15
#: At most so many labelled documents of each language fit the text model.
SAMPLE_ROWS = 600
#: A trigram counts as this part of an independent observation.
TEMPER = 0.1
SMOOTH = 1.0
SITE_WEIGHT, HOST_WEIGHT = 5.0, 5.0
_DROP = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>", re.S | re.I)
# No part gives back what it has taken, so a page of any length is read once.
_MARKUP = re.compile(r"(?:\s++|(?><!--.*?-->)|<!doctype[^>]*+>|<\?[^>]*+>)*+<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", re.S | re.I)


def visible(markup: str | None) -> str:
    """Text of a page without scripts, styles, comments and tags."""
    return html.unescape(_DROP.sub(" ", markup)) if markup else ""


def declared_language(markup: str | None) -> str | None:
    """The language that the opening ``html`` tag declares, however much white space, comments and declarations stand before it."""
    found = _MARKUP.match(markup) if markup else None
    return found[1].lower() if found else None


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of each text, lower-cased in A-Z, and the text of each; none reaches over two texts."""
    data, offsets = flat(texts)
    lower = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint32)
    text, at = ragged(np.maximum(np.diff(offsets) - 2, 0))
    start = offsets[:-1][text] + at
    code = lower[start] << np.uint32(16) | lower[start + 1] << np.uint32(8) | lower[start + 2] if len(start) else start.astype(np.uint32)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), text


class TextModel:
    """Log-probabilities of hashed trigrams by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.log = np.log((counts + SMOOTH) / (total + SMOOTH * counts.shape[1])).astype(np.float32)

    def posteriors(self, texts: pa.Array, temper: float = TEMPER) -> np.ndarray:
        """Chance of each language given the text alone; even where there is no text."""
        code, text = trigrams(texts)
        score = np.stack([np.bincount(text, row[code], len(texts)) for row in self.log], axis=1) * temper
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def fitted(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """A text model from about ``sample_rows`` documents of each value of ``lang``, by the hash of the row.

    A quarter of the texts, by their hash, is fitted on, unless a language has none in it. Texts stay in the workers: the driver gets a table
    of trigram counts of fixed size. A language with fewer documents gives all it has.
    """
    fold = (F.pmod(F.xxhash64("text"), F.lit(4)) == 0)
    rows = labelled.where("lang is not null and text is not null").select(
        "lang", "text", fold.alias("_fold"), F.xxhash64(*labelled.columns).alias("_turn"))
    sizes = rows.groupBy("lang").agg(F.count_if("_fold").alias("inner"), F.count("*").alias("all")).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return TextModel([], np.zeros((0, 1 << BITS)))
    share = {r["lang"]: min(1.0, sample_rows / (r["inner"] or r["all"])) for r in sizes}
    whole = [r["lang"] for r in sizes if not r["inner"]]
    taken = F.lit(False)
    for lang, part in share.items():
        on = (F.pmod("_turn", F.lit(1 << 20)) < F.lit(int(part * (1 << 20)))) & (F.lit(lang in whole) | F.col("_fold"))
        taken = F.when(F.col("lang") == lang, on).otherwise(taken)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BITS), np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in sliced(batches):
            code, text = trigrams(batch.column("text"))
            of = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)[text]
            total += np.bincount(of << BITS | code, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "n"])

    counts = np.zeros(len(languages) << BITS)
    got = rows.where(taken).select("lang", "text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return TextModel(languages, counts.reshape(len(languages), -1))


def text_evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id, host, suffix, site, declared`` and the text posterior ``q`` of every page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    label = lambda n: F.substring_index(F.col("host"), ".", -n)
    known = lambda c: F.when(c != "", c)
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), known(host).alias("host"),
        F.col("html").cast("string").alias("_text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            pages_in = batch.column("_text").to_pylist()
            texts = pa.array([visible(x) for x in pages_in], pa.string())
            declared = pa.array([declared_language(x) for x in pages_in], pa.string())
            q = model.posteriors(texts)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * q.shape[1], pa.int32()), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), declared, cells],
                                             names=["page_id", "host", "declared", "q"])

    found = rows.mapInArrow(weigh, "page_id bigint, host string, declared string, q array<double>")
    return found.withColumns({"suffix": label(1), "site": label(2)})


def fused(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id, lang, chance, text_lang, declared, host`` of every page.

    Pages without text, address or declaration are judged by what they have; with nothing at all, by the corpus prior. Null ids and repeated
    rows are judged row by row. Columns of the input other than ``page_id, url, html`` are not read; an empty table gives no rows.
    """
    names, n = model.languages, len(model.languages)
    if not n:
        return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.lit(None).cast("string").alias("lang"),
                            F.lit(None).cast("double").alias("chance"), F.lit(None).cast("string").alias("text_lang"),
                            F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    evidence = checkpointed(text_evidence(pages, model))
    q = [F.col("q")[i] for i in range(n)]

    def sums(key: str) -> DataFrame:
        return evidence.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_" + key)).agg(
            F.array(*[F.sum(x) for x in q]).alias(f"{key}_sum"), F.count("*").alias(f"{key}_n"))

    rows = evidence
    for key in ("declared", "suffix", "site", "host"):
        rows = rows.join(sums(key), rows[key] == F.col("_" + key), "left").drop("_" + key)
    whole = evidence.agg(*[F.sum(x).alias(str(i)) for i, x in enumerate(q)]).first()
    total = [float(x or 0.0) for x in whole]
    kinds = {k: evidence.select(F.approx_count_distinct(k)).first()[0] + 1 for k in ("declared", "suffix")}

    def others(key: str, i: int) -> Column:
        """A sum over the other pages."""
        return F.greatest(F.lit(0.0), F.coalesce(F.col(f"{key}_sum")[i] - q[i], F.lit(0.0)))

    def likelihood(key: str, i: int) -> Column:
        rest = F.greatest(F.lit(0.0), F.lit(total[i]) - q[i])
        return F.when(F.col(key).isNull(), 1.0).otherwise((others(key, i) + SMOOTH) / (rest + SMOOTH * kinds[key]))

    def prior(i: int) -> Column:
        corpus = (F.greatest(F.lit(0.0), F.lit(total[i]) - q[i]) + SMOOTH) / F.lit(sum(total) + SMOOTH * n)
        count = lambda key: F.greatest(F.lit(0), F.coalesce(F.col(f"{key}_n"), F.lit(1)) - 1)
        site = (others("site", i) + SITE_WEIGHT * corpus) / (count("site") + SITE_WEIGHT)
        return (others("host", i) + HOST_WEIGHT * site) / (count("host") + HOST_WEIGHT)

    weight = [q[i] * likelihood("declared", i) * likelihood("suffix", i) * prior(i) for i in range(n)]
    rows = rows.select("page_id", "declared", "host", "q", F.array(*weight).alias("_w"))
    best = lambda c: F.element_at(F.array(*map(F.lit, names)), F.array_position(c, F.array_max(c)).cast("int"))
    total_weight = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)
    return rows.select("page_id", best(F.col("_w")).alias("lang"), F.round(F.array_max("_w") / total_weight, 6).alias("chance"),
                       best(F.col("q")).alias("text_lang"), "declared", "host")


def page_languages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The registered query: all pages, with a text model fitted on labelled documents."""
    return fused(pages, fitted(documents))

"""Quality rules, source mixing, page languages, URL verdicts and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from speechloom.llm import language_id as li, mixing, quality_rules as qr, url_filter as uf, workload

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def oracle(sql, **tables):
    db = duckdb.connect()
    for name, frame in tables.items():
        db.register(name, frame.toArrow())
    reply = db.execute(sql)
    return [d[0] for d in reply.description], reply.fetchall()


def same_rows(frame, sql, **tables):
    names, want = oracle(sql, **tables)
    got = [tuple(r[n] for n in names) for r in frame.collect()]
    assert sorted(names) == sorted(frame.columns)
    assert collections.Counter(map(repr, got)) == collections.Counter(map(repr, want))


def facts(text):
    text = text or ""
    words = _WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i: i + 8])].append(i)
    hit = {j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_quality_facts(docs, texts, no_docs):
    got = {r.doc_id: r for r in qr.quality_facts(docs).collect()}
    for d, text in texts.items():
        r, want = got[d], facts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert qr.quality_facts(no_docs).collect() == []


def test_quality_equals_sql(docs):
    same_rows(qr.quality_facts(docs), qr.ORACLE, documents=docs)


def test_order_of_rules_does_not_change_the_verdict(docs):
    rules = list(qr.rules())
    want = {r.doc_id: r.kept for r in qr.judged(docs).collect()}
    random.Random(1).shuffle(rules)
    assert {x.name for x in qr.ordered(docs.select("text"), rules)} == {x.name for x in rules}
    assert {r.doc_id: r.kept for r in qr.judged(docs, rules).collect()} == want


def test_quality_runs_no_python(docs):
    plan = qr.quality_facts(docs.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_keep_good_returns_the_columns(docs):
    kept = {r.doc_id for r in qr.quality_facts(docs).where("kept").collect()}
    got = qr.keep_good(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == kept and kept


def test_clean_prose_is_kept(spark, sf_dir):
    """Documents of quality 1 stay, those of quality 0 that are junk go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = qr.quality_facts(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(labels, "doc_id").where("n_words >= 20")
    rate = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert rate[1] > 0.95 and rate[0] < rate[1]


def test_mixture_equals_sql(docs, no_docs):
    same_rows(mixing.mixture(docs), mixing.ORACLE, documents=docs)
    assert mixing.mixture(no_docs).collect() == []


def test_mixture_meets_targets(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"),
                                      F.lit("x" * 9).alias("text"), F.lit(1).alias("copy"))
    got = mixing.mixed_copies(rows, {"a": 3.0, "b": 1.0})
    share = {r.source: r["count"] / 40_000 for r in got.groupBy("source").count().collect()}
    assert got.columns == ["doc_id", "source", "text", "copy", "shuffle_key"]
    assert abs(share["a"] - 0.75) < 0.02 and abs(share["b"] - 0.25) < 0.02
    counts = collections.Counter(r["count"] for r in got.where("source = 'a'").groupBy("doc_id").count().collect())
    for k in range(1, 8):
        p = math.exp(-3) * 3**k / math.factorial(k)
        assert abs(counts[k] / 10_000 - p) < 5 * math.sqrt(p / 10_000)
    dropped = mixing.mixed_copies(rows, {"b": 1.0})
    assert dropped.where("source = 'a'").isEmpty()


def test_large_rates_are_drawn_in_parts(spark):
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    n = mixing.mixed_copies(rows, epochs=1000.0).count()
    assert abs(n - 60_000) < 6 * math.sqrt(60_000)


def test_text_model_on_held_out_documents(spark, sf_dir):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 200")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = li.fitted(rows.where(~held))
    import pyarrow as pa

    test = rows.where(held).select("text", "lang").collect()
    q = model.posteriors(pa.array([r.text for r in test]))
    assert np.mean([model.languages[i] == r.lang for i, r in zip(q.argmax(axis=1), test, strict=True)]) > 0.95


def _page(lang, body):
    return f'<html{f" lang={lang!r}" if lang else ""}><style>p {{}}</style><p>{body}</p><script>the the</script></html>'


def test_page_languages(spark, sf_dir):
    model = li.fitted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    by_lang = {r.lang: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 300").collect()}
    rows = [(i, f"http://{lang}.site.org/x", _page(lang, by_lang[lang])) for i, lang in enumerate(["de"] * 30 + ["fr"] * 30 + ["en"] * 5)]
    rows += [(100, "http://de.site.org/y", None), (101, None, None), (102, "no address", ""), (None, "http://fr.site.org", _page("fr", "x")), (103, None, _page("es", by_lang["es"]))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("q", F.lit(1))
    got = {r.page_id: r for r in li.fused(pages, model).collect()}
    assert len(got) == len(rows) and all(0 < r.chance <= 1 for r in got.values())
    assert {got[i].lang for i in range(30)} == {"de"} and got[30].lang == "fr" and got[60].lang == "en"
    assert got[100].lang == "de" and got[103].lang == "es" and got[None].lang == "fr"
    assert li.fused(pages.limit(0), model).collect() == []
    assert li.fused(pages, li.fitted(pages.select(F.lit(None).cast("string").alias("lang"), F.lit("").alias("text")))).count() == len(rows)


def test_page_languages_against_brute_force(spark, sf_dir):
    """The fusion, computed page by page from the text posteriors."""
    model = li.fitted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = li.text_evidence(pages, model).collect()
    got = {r.page_id: r for r in li.fused(pages, model).collect()}
    q = np.array([r.q for r in rows])
    n = len(model.languages)
    kinds = {k: len({r[k] for r in rows} - {None}) + 1 for k in ("declared", "suffix")}
    for i, r in enumerate(rows):
        rest = np.arange(len(rows)) != i
        total = q[rest].sum(axis=0)
        corpus = (total + li.SMOOTH) / (q.sum() + li.SMOOTH * n)
        alike = {k: rest & np.array([x[k] is not None and x[k] == r[k] for x in rows]) for k in ("declared", "suffix", "site", "host")}
        site = (q[alike["site"]].sum(axis=0) + li.SITE_WEIGHT * corpus) / (alike["site"].sum() + li.SITE_WEIGHT)
        weight = q[i] * (q[alike["host"]].sum(axis=0) + li.HOST_WEIGHT * site) / (alike["host"].sum() + li.HOST_WEIGHT)
        for key in ("declared", "suffix"):
            if r[key] is not None:
                weight = weight * (q[alike[key]].sum(axis=0) + li.SMOOTH) / (total + li.SMOOTH * kinds[key])
        want = weight / weight.sum()
        assert abs(got[r.page_id].chance - want.max()) < 1e-4 and got[r.page_id].lang == model.languages[int(want.argmax())]


@pytest.fixture(scope="module")
def pages(spark):
    urls = [None, "", "no scheme", "http://", "://x", "HTTP://A.Example.ORG/es/1", "http://example.org", "http://example.org?x=/es/", "http://badexample.org/es/",
            "https://example.org/en/1", "https://x.example.org/en/10", "https://x.example.org/en/20", "ftp://com/de/a", "http://a.com/fr/#x", "http://org./x",
            "http://net/ä?b", "http://net/ä#b", "a://b://c/d", "http://a.com/de/a", "http://a.com/de/a"]
    rows = [(i, u, "h", "v") for i, u in enumerate(urls)] + [(None, "http://u.net/x", None, None)]
    r = random.Random(2)
    rows += [(100 + i, f"http://{r.choice(['good', 'fine', 'spam', 'bets'])}{r.randrange(9)}.{r.choice(['com', 'net', 'org'])}/{r.choice(['fr', 'de', 'en'])}/{r.randrange(99)}", "", "")
             for i in range(400)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, verdict string")


def test_url_verdicts_equal_sql(pages):
    same_rows(uf.url_verdicts(pages), uf.ORACLE, pages=pages)


def test_url_parts_and_rules(pages):
    got = {r.page_id: r for r in uf.judged_urls(pages).collect()}
    part = lambda i: (got[i].host, got[i].path, got[i].rule)
    assert part(0) == part(1) == part(2) == part(3) == ("", "", None) and part(4) == ("x", "", None)
    assert part(5) == ("a.example.org", "/es/1", "example.org/es/") and part(6) == ("example.org", "", None) == part(7)
    assert part(8) == ("badexample.org", "/es/", "org/") and part(10)[2] == "example.org/en/1" and part(11)[2] == "org/"
    assert part(12) == ("com", "/de/a", "com/de/") and got[12].verdict == "block" and got[13].verdict == "allow"
    assert part(15) == ("net", "/ä", None) == part(16) and part(17) == ("b:", "//c/d", None)
    assert uf.judged_urls(pages.limit(0)).collect() == []


def test_url_model_separates(spark):
    r = random.Random(5)
    word = lambda letters: "".join(r.choice(letters) for _ in range(12))
    rows = [(i, f"http://{word('abcde')}.com/fr/{word('abcde')}" if i % 2 else f"http://{word('vwxyz')}.com/de/{word('vwxyz')}") for i in range(300)]
    rows += [(1000 + i, f"http://{word('abcde' if i % 2 else 'vwxyz')}.net/it/{word('abcde' if i % 2 else 'vwxyz')}") for i in range(60)]
    got = uf.judged_urls(spark.createDataFrame(rows, "page_id bigint, url string")).where("page_id >= 1000").collect()
    assert np.mean([(r.verdict == "allow") == bool(r.page_id % 2) for r in got]) > 0.95


def test_smoothed_probabilities_sum_to_one(spark):
    grams = spark.createDataFrame([(a + b, True) for a in "xy" for b in "abc" for _ in range(ord(b) - 96)] + [("xa", False)], "gram string, known boolean")
    table = {r.gram: r.accepted for r in uf.gram_table(grams, 1).collect()}
    for context in "xy":
        # What successors never seen would get is the rest of the mass.
        seen = sum(table[context + b] for b in "abc")
        lower = 3 / (12 + 3) * (uf.ALPHABET - 3) / uf.ALPHABET
        assert seen == pytest.approx(1 - 3 / (6 + 3) * lower)


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = [{r.doc_id for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.schema == docs.schema
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    good = {r.doc_id for r in workload.op7_quality_rules(spark, sf_dir).where("kept").collect()}
    assert ids[1] == good and ids[2] < ids[1] and ids[3] == ids[2] and 0 < len(ids[4]) < len(ids[3]) and ids[5] == ids[4]
    mixed = spark.read.parquet(str(tmp_path / "3"))
    assert mixed.count() == spark.read.parquet(str(tmp_path / "4")).where("lossless").count()
    whole = corpus_pipeline.run(spark, sf_dir)
    key = lambda f: sorted((r.doc_id, r.n_pieces, hashlib.md5(str(r.piece_ids).encode()).hexdigest()) for r in f.collect())
    assert key(whole) == key(spark.read.parquet(str(tmp_path / "4")))

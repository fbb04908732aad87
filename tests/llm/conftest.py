from __future__ import annotations

import random

import pytest

import corpus_pipeline  # noqa: F401  (registers the package for Python workers)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    """Texts of the smallest tables and small edge cases, by id."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    r = random.Random(1)
    parts = ["a", "th", "ing", " ", "  ", "\n", "\t", "'s", "'", "don't", "12", "é", "日本", "!", "***", "<|endoftext|>", "▁", "\x0b", " ", "😀"]
    odd = [None, "", " ", "\n\n", "word", "A b", "x" * 70_000, "ab " * 30_000, "one two three four five", "ONE two three four five",
           "日本語" * 40, *("".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(200))]
    top = max(rows) + 1
    return rows | {top + i: x for i, x in enumerate(odd)}


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a documents table with clashing extra columns."""
    rows = [(d, x, "en", f"src{d % 3}" if d % 7 else None, len(x or ""), 5, "z") for d, x in texts.items()]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, name int, copy string").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)

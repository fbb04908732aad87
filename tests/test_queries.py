"""Every registered query runs, and equals its oracle where it has one."""

from __future__ import annotations

import collections
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from compare import TABLES, norm  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    got = collections.Counter(tuple(norm(r[c]) for c in columns) for r in frame.collect())
    assert got
    if name in entry.oracle_sql():
        reply = db.execute(entry.oracle_sql()[name])
        names = [d[0] for d in reply.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == collections.Counter(tuple(norm(r[i]) for i in at) for r in reply.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["recording_id", "speaker", "n_words"]

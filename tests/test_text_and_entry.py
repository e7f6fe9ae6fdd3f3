"""Word count against a Python count; the driver contract on the smoke tables."""

from __future__ import annotations

import re
from collections import Counter

import duckdb

import __spark_entry__ as E
from castlens.operators.text import word_count
from castlens.plans.tables import TABLES, table
from tests.conftest import SF_SMOKE


def test_word_count_whole_texts(spark):
    docs = table(spark, SF_SMOKE, "documents")
    exp = Counter()
    for r in docs.select("text").collect():
        exp.update(w for w in re.split(r"[ \t\n\r\f]+", r.text) if w)
    got = {r.word: r["count"] for r in word_count(docs, "text").collect()}
    assert got == dict(exp)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["person", "distance"]
    assert df.count() > 0


def test_registry_and_oracle_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    for name in set(q) - set(o):      # only what SQL cannot express has no oracle
        assert name == "pipeline" or name.startswith("op"), name


def _norm(v):
    if isinstance(v, list):
        return [_norm(x) for x in v]
    return v


def test_every_query_matches_oracle_on_smoke(spark):
    """Every registered query against its DuckDB SQL on the smallest tables:
    same column names and the same multiset of rows."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    q, o = E.queries(), E.oracle_sql()
    for name, sql in o.items():
        df = q[name](spark, SF_SMOKE)
        cols = sorted(df.columns)
        got = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
        rel = con.sql(sql)
        idx = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        exp = sorted(repr(tuple(_norm(r[i]) for i in idx)) for r in rel.fetchall())
        assert sorted(rel.columns) == cols, name
        assert got == exp, name


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_alphabet = st.sampled_from(list("ab \t\n\r\fé,.x"))


@settings(max_examples=5, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet=_alphabet, max_size=40), min_size=1, max_size=8))
def test_word_count_random_texts(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    exp = Counter(w for t in texts for w in re.split(r"[ \t\n\r\f]+", t) if w)
    got = {r.word: r["count"] for r in word_count(df, "text").collect()}
    assert got == dict(exp)

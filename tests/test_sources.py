"""Readers and writers on hand-written files of the fixture shapes."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from castlens.sources import (read_csv_clean, read_csv_inferred, read_json, read_keyvalue,
                              read_principals, read_text_positional, rows_to_dataframe,
                              stage_to_parquet, write_delimited, write_keyvalue, write_text_rows)
from castlens.sources.readers import PRINCIPALS_SCHEMA, read_delimited
from tests.conftest import write_text
from tests.fixtures import dirty_principals_rows


def test_tsv_nulls_quotes_and_headers(spark, tmp_dir):
    p = read_principals(spark, write_text(os.path.join(tmp_dir, "p.tsv"), dirty_principals_rows()))
    rows = p.collect()
    assert len(rows) == 10                       # the repeated header is gone
    quoted = [r for r in rows if r.job and r.job.startswith('"')]
    assert len(quoted) == 1 and quoted[0].characters is None   # the quote did not swallow the tab
    assert any(r.ordering is None and r.nconst == "nm0000003" for r in rows)   # 'x' → null
    assert any(r.category is None for r in rows)
    assert sum(1 for r in rows if r.job is None) >= 8           # \N → null


def test_text_positional_header_anywhere(spark, tmp_dir):
    path = write_text(os.path.join(tmp_dir, "p.tsv"), dirty_principals_rows())
    df = read_text_positional(spark, path, {"tconst": 0, "nconst": 2, "missing": 9},
                              header_field="tconst", header_value="tconst")
    rows = df.collect()
    assert len(rows) == 10 and all(r.missing is None for r in rows)


def test_csv_clean_dirty_sheet(spark, tmp_dir):
    lines = [",firm,place,zone,id",
             "0,Alpha Works ,Easton, E1,0",
             '1,"Beta, Gamma and Co",Norton, N2,1',
             "2,Öresund Fähre,Malmö, S3,2"]
    path = write_text(os.path.join(tmp_dir, "b.csv"), lines, newline="\r\n")
    df = read_csv_clean(spark, path)
    assert df.columns == ["row_index", "firm", "place", "zone", "id"]
    rows = {r.id: r for r in df.collect()}
    assert rows[0].firm == "Alpha Works" and rows[0].zone == "E1"
    assert rows[1].firm == "Beta, Gamma and Co"
    assert rows[2].place == "Malmö"
    assert dict(df.dtypes)["row_index"] == "int"


def test_csv_inferred(spark, tmp_dir):
    path = write_text(os.path.join(tmp_dir, "a.csv"), ["item,maker,weight", "bolt,acme,50", "nut,zenith,40"])
    df = read_csv_inferred(spark, path)
    assert dict(df.dtypes) == {"item": "string", "maker": "string", "weight": "int"}


def test_json_nested(spark, tmp_dir):
    path = write_text(os.path.join(tmp_dir, "r.json"), [
        '{"body": {"id": "a1", "kind_path": "top - leaf", "measures": [1.5, -2.5]}, "ref": "r1"}',
        '{"body": {"id": "a2", "kind_path": "top", "measures": []}, "ref": "r2"}',
    ])
    from castlens.functions import array_get, split_get
    df = read_json(spark, path).select(
        F.col("body.id").alias("id"), split_get("body.kind_path", " - ", 1).alias("leaf"),
        array_get("body.measures", 0).alias("m0"), array_get("body.measures", 1).alias("m1"))
    rows = {r.id: r for r in df.collect()}
    assert rows["a1"].leaf == "leaf" and rows["a1"].m1 == -2.5
    assert rows["a2"].leaf is None and rows["a2"].m0 is None


def test_rows_to_dataframe(spark):
    df = rows_to_dataframe(spark, [["seed"], ["second"], ["third"]], "name string")
    assert [r.name for r in df.collect()] == ["seed", "second", "third"]


def _lines(path):
    out = []
    for f in sorted(glob.glob(os.path.join(path, "part-*"))):
        with open(f, encoding="utf-8") as fh:
            out.extend(fh.read().splitlines())
    return out


def test_text_rows_sorted_and_tuple(spark, tmp_dir):
    df = spark.createDataFrame([("nm1", 6.9), ("nm2", 7.5), ("nm3", None)], "nconst string, avgRating double")
    out = os.path.join(tmp_dir, "avg")
    write_text_rows(df, out, sort_by=[F.col("avgRating").desc_nulls_last(), F.col("nconst")])
    assert _lines(out) == ["[nm2,7.5]", "[nm1,6.9]", "[nm3,null]"]
    out2 = os.path.join(tmp_dir, "bfs")
    write_text_rows(spark.createDataFrame([("nm1", 3)], "person string, distance int"), out2, style="tuple")
    assert _lines(out2) == ["(nm1,3)"]


def test_keyvalue_overwrite(spark, tmp_dir):
    out = os.path.join(tmp_dir, "kv")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v bigint")
    write_keyvalue(a, out, "k", "v")
    write_keyvalue(a.where("k = 'x'"), out, "k", "v")    # rerun replaces the old output
    got = read_keyvalue(spark, out, "k string, v bigint").collect()
    assert [(r.k, r.v) for r in got] == [("x", 1)]
    write_keyvalue(spark.createDataFrame([("n", 0, [1, 2])], "k string, d int, l array<int>"), out, "k",
                   F.struct("d", "l"), json_value=True)
    assert _lines(out) == ['n\t{"d":0,"l":[1,2]}']


def test_stage_to_parquet(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    df = spark.createDataFrame([("tt1", 1, "nm1", "actor", None, None)], PRINCIPALS_SCHEMA)
    write_delimited(df, raw)
    staged = stage_to_parquet(spark, raw, PRINCIPALS_SCHEMA, os.path.join(tmp_dir, "pq"))
    assert staged.collect() == df.collect()
    again = stage_to_parquet(spark, raw, PRINCIPALS_SCHEMA, os.path.join(tmp_dir, "pq"))   # overwrite
    assert again.count() == 1


def test_line_order_last_line_wins_across_files(spark, tmp_dir):
    from castlens.operators.ratings import latest_per_key
    from castlens.sources import read_ratings, with_line_order
    d = os.path.join(tmp_dir, "ratings")
    os.makedirs(d)
    hdr = "tconst\taverageRating\tnumVotes"
    write_text(os.path.join(d, "part-a.tsv"), [hdr, "tt1\t1.0\t1", "tt2\t2.0\t1", "tt1\t3.0\t1"])
    write_text(os.path.join(d, "part-b.tsv"), [hdr, "tt2\t4.0\t1", "tt3\t5.0\t1"])
    r = with_line_order(read_ratings(spark, d))
    got = {x.tconst: x.averageRating for x in latest_per_key(r, "tconst", "averageRating", "line_order").collect()}
    assert got == {"tt1": 3.0, "tt2": 4.0, "tt3": 5.0}


def test_stage_gzip_dump_into_many_files(spark, tmp_dir):
    import gzip
    raw = os.path.join(tmp_dir, "gz")
    os.makedirs(raw)
    rows = ["tconst\tordering\tnconst\tcategory\tjob\tcharacters"] + \
        [f"tt{i:07d}\t1\tnm{i % 50:07d}\tactor\t\\N\t\\N" for i in range(500)]
    with gzip.open(os.path.join(raw, "p.tsv.gz"), "wt", encoding="utf-8") as f:
        f.write("\n".join(rows) + "\n")
    out = os.path.join(tmp_dir, "staged")
    staged = stage_to_parquet(spark, raw, PRINCIPALS_SCHEMA, out, num_files=4)
    assert staged.count() == 500
    assert len(glob.glob(os.path.join(out, "part-*.parquet"))) == 4


ODD = [None, "", " ", " lead", "trail ", "a\tb", "a\nb", "a\r\nb", "\\", "\\N", "\\\\N", "\\t", "\\e", "\x0bfoo", "foo", '"q"', "a\\", "#c", "\u2028x",
       "\x00", "é\\n\n"]


def test_text_fields_round_trip(spark, tmp_dir):
    """Whatever a string holds, the delimited and the key-value writers give it back, alone in a row or not."""
    import itertools
    rows = [(i, a, b) for i, (a, b) in enumerate(itertools.product(ODD, ODD))]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    path = os.path.join(tmp_dir, "odd")
    write_delimited(df, path)
    back = read_delimited(spark, path, df.schema, escaped=True)
    assert sorted((r.i, r.a, r.b) for r in back.collect() if r.a is not None and r.b is not None) == \
        sorted(r for r in rows if None not in r)
    assert {r.i for r in back.where("a is null").collect()} == {i for i, a, _ in rows if a is None}
    one = spark.createDataFrame([(a,) for a in ODD], "a string")
    write_delimited(one, os.path.join(tmp_dir, "one"))
    got = [r.a for r in read_delimited(spark, os.path.join(tmp_dir, "one"), "a string", escaped=True).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, ODD))
    keys = spark.createDataFrame([(a, i) for i, a in enumerate(ODD)], "k string, v bigint")
    write_keyvalue(keys, os.path.join(tmp_dir, "kv2"), "k", "v")
    assert {r.v: r.k for r in read_keyvalue(spark, os.path.join(tmp_dir, "kv2"), "k string, v bigint").collect()} == dict(enumerate(ODD))


def test_text_positional_strip_and_literal_separator(spark, tmp_dir):
    path = write_text(os.path.join(tmp_dir, "s.txt"), ["\ttt1\t5.0\t", "tt2\t6.0"])
    rows = [(r.t, r.x) for r in read_text_positional(spark, path, {"t": 0, "x": 1}, strip=True).collect()]
    assert rows == [("tt1", "5.0"), ("tt2", "6.0")]
    path = write_text(os.path.join(tmp_dir, "p.txt"), ["a|b", "c.d|e"])
    rows = [(r.t, r.x) for r in read_text_positional(spark, path, {"t": 0, "x": 1}, sep="|").collect()]
    assert rows == [("a", "b"), ("c.d", "e")]


def test_clear_scratch(spark):
    from castlens.session import clear_scratch, scratch_path
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    clear_scratch(spark)
    assert not os.path.exists(path.replace("file:", ""))

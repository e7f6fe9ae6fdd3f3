"""Records of changing shape as VARIANT."""

from __future__ import annotations

from castlens.operators.variants import read_variant_lines, variant_columns, variant_profile, variant_schema
from tests.conftest import write_text

LINES = ['{"id": 1, "name": "ann", "tags": ["x", "y"]}', '{"id": "2", "person": {"name": "bob"}}', '[3, "cy"]',
         '{"id": null, "name": 4.50}', '', '   ', '{"id": 5', 'null', '7', '{"id": 1.5, "name": {"first": "di"}}', '{"id": 99999999999999999999}']


def test_fields_by_path_and_type(spark, tmp_dir):
    write_text(f"{tmp_dir}/a.json", LINES)
    lines = read_variant_lines(spark, tmp_dir)
    got = variant_columns(lines, {"id": ("bigint", ["$.id", "$[0]"]), "name": ("string", ["$.name", "$.person.name", "$[1]"]),
                                  "tag": ("string", "$.tags[1]")})
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("id", "bigint"), ("name", "string"), ("tag", "string")]
    rows = [tuple(r) for r in got.collect()]
    assert rows[:4] == [(1, "ann", "y"), (2, "bob", None), (3, "cy", None), (None, "4.5", None)]
    assert rows[4:6] == [(None, None, None)] * 2                     # a JSON null and a bare number: records without fields
    assert rows[6][0] == 1 and rows[7][0] is None                    # 1.5 is cut to a bigint; one too large has no bigint
    assert [r.bad_line for r in lines.collect() if r.bad_line is not None] == ['{"id": 5']


def test_profile_and_schema(spark, tmp_dir):
    write_text(f"{tmp_dir}/a.json", LINES[:4])
    lines = read_variant_lines(spark, tmp_dir)
    got = {(r.key, r.kind): r.n for r in variant_profile(lines).collect()}
    assert got == {("id", "BIGINT"): 1, ("id", "STRING"): 1, ("id", "VOID"): 1, ("name", "STRING"): 1, ("name", "DECIMAL"): 1,
                   ("tags", "ARRAY"): 1, ("person", "OBJECT"): 1, (None, "BIGINT"): 1, (None, "STRING"): 1}
    some = lines.where("record is not null")
    assert some.agg(variant_schema(some)).first()[0] == "VARIANT"     # objects and arrays have no common schema
    write_text(f"{tmp_dir}/none.txt", ["", "no json"])
    bad = read_variant_lines(spark, f"{tmp_dir}/none.txt")
    assert variant_columns(bad, {"id": ("bigint", "$.id")}).collect() == [] and variant_profile(bad).collect() == []

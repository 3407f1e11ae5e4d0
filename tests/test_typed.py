"""Typed CSV scans: types over all files, one reject for each bad cell, line numbers over splits."""

import os

import pytest

from cohortloom.runtime import fresh_path
from cohortloom.sources.tables import write_csv
from cohortloom.sources.typed import header, infer_types, read_typed_csv


def put(folder, **files):
    os.makedirs(folder)
    for name, text in files.items():
        with open(f"{folder}/{name}.csv", "w") as out:
            out.write(text)
    return folder


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def test_types_widen_over_files(spark):
    a = "i,d,day,at,b,s,none\n1,1,2020-01-02,2020-01-02,true,x,\n-7,2.5,2021-12-31,2020-01-02 03:04:05,False,1,\n"
    b = "i,d,day,at,b,s,none\n+12,1e-3,2020-02-29,2020-01-02T03:04:05,TRUE,2020-01-01,\n,,,,,,\n"
    path = put(fresh_path(spark, "typed"), a=a, b=b)
    rows, rejects = read_typed_csv(spark, path)
    want = {"i": "bigint", "d": "double", "day": "date", "at": "timestamp", "b": "boolean", "s": "string", "none": "string"}
    assert types(rows) == want and rejects.count() == 0
    assert rows.count() == 4 and sorted(r["i"] for r in rows.filter("i IS NOT NULL").collect()) == [-7, 1, 12]
    # a day that doesn't exist and a number too large aren't of their type
    path = put(fresh_path(spark, "typed"), a="day,n\n2021-02-29,99999999999999999999\n")
    assert types(read_typed_csv(spark, path)[0]) == {"day": "string", "n": "double"}


def test_one_bad_cell_gives_one_reject(spark):
    lines = ["id,v,name"] + [f"{i},{i / 2},n{i}" for i in range(40)]
    lines[18] = "17,oops,n17"
    path = put(fresh_path(spark, "typed"), a="\n".join(lines) + "\n", b="id,v,name\n900,1.5,\n")
    for scan in (read_typed_csv(spark, path, "id long, v double, name string"), read_typed_csv(spark, path, bad_share=0.05)):
        rows, rejects = scan
        assert types(rows) == {"id": "bigint", "v": "double", "name": "string"} and rows.count() == 41
        assert rows.filter("id = 17").first()["v"] is None and rows.filter("v IS NULL").count() == 1
        (one,) = rejects.collect()
        assert one["file"].endswith("/a.csv") and (one["line"], one["column"], one["text"]) == (19, "v", "oops")
    # without room for bad cells the column is text, and nothing is rejected
    rows, rejects = read_typed_csv(spark, path)
    assert types(rows)["v"] == "string" and rejects.count() == 0


def test_lines_are_right_over_splits_and_blank_lines(spark):
    lines = ["id,v"] + [f"{i},{'bad' if i % 100 == 0 else i}" for i in range(2000)]
    lines.insert(50, "")
    lines += ["short", "1,2,3"]
    path = put(fresh_path(spark, "typed"), a="\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        got = {(r["line"], r["column"], r["text"]) for r in read_typed_csv(spark, path, "id int, v int")[1].collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(i + 1, "v", "bad") for i, t in enumerate(lines) if t.endswith("bad")}
    assert got == want | {(len(lines) - 1, None, "short"), (len(lines), None, "1,2,3")} and len(want) == 20


def test_names_empty_tables_and_quotes(spark):
    path = put(fresh_path(spark, "typed"), a='file,line,"a,b`c",column\n1,"x,y",2,z\nq,w,2,z\n')
    assert header(spark, path) == ["file", "line", "a,b`c", "column"]
    rows, rejects = read_typed_csv(spark, path, bad_share=0.5)
    assert types(rows) == {"file": "bigint", "line": "string", "a,b`c": "bigint", "column": "string"}
    assert [(r["column"], r["text"], r["line"]) for r in rejects.collect()] == [("file", "q", 3)]
    path = put(fresh_path(spark, "typed"), a="x,y\n")
    rows, rejects = read_typed_csv(spark, path)
    assert types(rows) == {"x": "string", "y": "string"} and rows.count() == rejects.count() == 0


def test_wide_tables(spark):
    names = [f"VA/{i}" for i in range(300)]
    df = spark.range(3).selectExpr("id", *[f"CAST(id + {i} AS DOUBLE) AS `{n}`" for i, n in enumerate(names)])
    path = write_csv(df, fresh_path(spark, "wide"))
    rows, rejects = read_typed_csv(spark, path)
    assert set(list(types(rows).values())[1:]) == {"double"} and rejects.count() == 0
    assert sorted(r["VA/299"] for r in rows.select("`VA/299`").collect()) == pytest.approx([299.0, 300.0, 301.0])
    assert infer_types(df.selectExpr("CAST(id AS STRING) AS id")).simpleString() == "struct<id:bigint>"

import duckdb
import pytest

from wordloom.llm import licences, queries
from wordloom.llm.licence_texts import KNOWN
from tests.llm.conftest import rows

MIT = next(t for n, t in KNOWN if n == "MIT")


def scan(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r["licence_id"], r["notices"]) for r in licences.scan(df).orderBy("doc_id").collect()]


def test_variants_of_a_text_are_the_same_licence(spark):
    got = scan(spark, [
        MIT, MIT.upper(), "Copyright (c) 2019 Jane Doe\n\n" + MIT, "© 2001-2024 A. Person. All rights reserved.\n" + MIT,
        " * " + MIT.strip().replace("\n", "\n * "), MIT.replace('"', "”").replace(",", ""),
        MIT.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "non-infringement"),
        MIT + " And one more clause.", MIT.replace("free of charge", "for a fee")])
    assert [x for x, _ in got] == ["MIT"] * 7 + [None, None]


def test_every_known_text_is_found(spark):
    assert [x for x, _ in scan(spark, [t for _n, t in KNOWN])] == [n for n, _t in KNOWN]


def test_notices_are_found_by_line(spark):
    got = scan(spark, ["Released under the MIT License.\nprose goes here", "prose\nLICENSED UNDER CC BY-NC 4.0\nprose\n"
                       "Released under the MIT Licence.", "it was released under the MIT license. yes"])
    assert got == [(None, ["MIT"]), (None, ["CC-BY-NC-4.0", "MIT"]), (None, [])]


def test_edge_rows_and_empty_table(spark, edge_docs, no_docs):
    out = licences.scan(edge_docs).collect()
    assert len(out) == len(rows()) and all(r["licence_id"] is None and r["notices"] == [] for r in out)
    assert licences.scan(no_docs).count() == 0
    with pytest.raises(ValueError):
        licences.known_digests(spark, [("x", str(i)) for i in range(licences.MAX_KNOWN + 1)])


def test_no_python_in_the_plan(spark):
    plan = queries.op1_licences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.sql(queries.op1_sql()).fetchall(), key=str)
    cols = ["doc_id", "digest", "licence_id", "notices"]
    got = sorted((tuple(r[c] for c in cols) for r in queries.op1_licences(spark, "/root/testdata/sf0.001").collect()),
                 key=str)
    assert got == want


def test_spellings_are_replaced_at_word_beginnings_only(spark):
    df = spark.createDataFrame([("demand organic", "d emanorganic"), ("x and or y", "x or y"), ("sales per centre", "sales per center"),
                                ("ten per cent\nand or", "ten percent\nor"), ("unauthorised", "unauthorized")], "a string, b string")
    from pyspark.sql import functions as F
    got = [tuple(r) for r in df.select(licences.canonical_lines(F.col("a")), licences.canonical_lines(F.col("b"))).collect()]
    assert got[0][0] == "demand organic" and [a == b for a, b in got] == [False, True, True, True, False]


def test_licences_from_a_folder(spark, scratch):
    for name, text in (("MIT.txt", MIT), ("MIT.title.txt", "MIT License\n" + MIT), ("Own-2.0.txt", "You may do as you like.\nTwice.")):
        with open(f"{scratch}/{name}", "w") as f:
            f.write(text)
    known = licences.read_known(spark, scratch)
    assert sorted({n for n, _t in known}) == ["MIT", "Own-2.0"] and len(known) == 3
    df = spark.createDataFrame([(1, "you may do, as you like -- twice"), (2, MIT.lower())], "doc_id long, text string")
    assert [r["licence_id"] for r in licences.scan(df, known=known).orderBy("doc_id").collect()] == ["Own-2.0", "MIT"]

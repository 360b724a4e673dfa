import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(names, table):
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(r[k]) for k in order) for r in table)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in entry.oracle_sql():
        want = db.sql(entry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_text_codecs_meet_documents(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("zstd_roundtrip", "base64_encode", "base64_decode", "pack2bit_codes", "pack2bit_bytes_roundtrip", "reads_block"):
        assert entry.queries()[f"{name}_documents"](spark, SF).count() == n
    assert {"n_positions_documents", "read_batches_documents", "batch_concat_documents"} <= entry.oracle_sql().keys()


def test_attributes_of_all_links(spark, db):
    got = entry.queries()["xml_attrs_of_all_tags"](spark, SF)
    tags = db.sql("SELECT sum(len(regexp_extract_all(html, '<a\\b[^>]*href=')))::BIGINT FROM pages").fetchall()[0][0]
    assert got.filter("name = 'href'").count() == tags and got.filter("place > 0").count() > 0

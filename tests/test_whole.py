"""Registered queries answer for whole tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
WHOLE = {"lookup_topn_per_parent": "customer", "lookup_folded_groups": "customer", "lookup_chain": "customer", "lookup_composite": "orders", "join_comma": "orders", "geo_distance": "events"}


@pytest.mark.parametrize("name", WHOLE)
def test_every_row_is_asked(spark, name):
    got = entry.queries()[name](spark, SF)
    column = "o_orderkey" if name == "join_comma" else "id"
    assert got.agg(F.count_distinct(column)).head()[0] == spark.read.parquet(f"{SF}/{WHOLE[name]}.parquet").count()


def test_orders_see_the_whole_table(spark):
    q = entry.queries()
    got = q["json_order_mixed"](spark, SF)
    assert {(r.id % 3, r.part) for r in got.collect()} == {(0, "first"), (2, "last")} and got.count() == 24
    assert q["lookup_required"](spark, SF).select("id").distinct().count() == 20


def test_all_matches_of_a_prefix(spark, tmp_path):
    docs = spark.range(10_050).selectExpr("id as doc_id", "concat('licence ', id) as text", "if(id % 50 = 0, 'fr', 'en') as lang", "'s' as source", "9L as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert entry.queries()["match_prefix_index"](spark, str(tmp_path)).count() == 9_849
    docs.withColumn("lang", F.lit("en")).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert entry.queries()["match_prefix_index"](spark, str(tmp_path)).count() == 10_050


def test_every_part_has_its_price(spark):
    import duckdb

    want = dict(duckdb.sql(f"select l_partkey, sum(l_extendedprice * l_quantity) / sum(l_quantity) from '{SF}/lineitem.parquet' group by 1").fetchall())
    got = {r.l_partkey: r.vwap for r in entry.queries()["vwap"](spark, SF).collect()}
    assert len(got) > 100 and got == pytest.approx(want, abs=0.0051)

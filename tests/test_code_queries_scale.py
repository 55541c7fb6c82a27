"""How queries over code templates run where the tables are large: in parts, reading files once, with sizes that are told as they are."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codelattice.lineage import cut
from codelattice.plans import code_queries

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


def size(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def readers(df):
    """How often the plan runs Python over files."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_files_come_in_parts_whatever_the_parts_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(code_queries, "FILES_A_PART", 50, raising=False)
    assert code_queries._files(spark, SF, code_queries._CHUNKED).rdd.getNumPartitions() == 3  # of 150 customers


def test_files_look_as_large_as_they_are(spark):
    files = code_queries._files(spark, SF, code_queries._CHUNKED)
    assert size(files) >= files.agg(F.sum(F.length("path") + F.length("text"))).first()[0]


def test_packed_tables_look_as_large_as_they_are(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("a/rather/long/path/"), F.col("id").cast("string")).alias("path"), F.repeat(F.concat(F.lit("x = f("), F.col("id").cast("string"), F.lit(")\n")), 4).alias("code"))
    real = rows.agg(F.sum(F.length("path") + F.length("code"))).first()[0]
    packed = cut(rows, packed=True)
    assert size(packed) >= real > size(cut(rows)) and packed.columns == rows.columns and packed.count() == 20_000


@pytest.mark.parametrize("name, most", [("ch_edges", 0), ("em_skip_unchanged", 0), ("fw_providers", 0), ("fw_prefixes", 0), ("fw_relations", 0), ("fw_fastapi", 1), ("ex_contains", 1), ("rs_stats", 0), ("rs_edges", 0), ("fw_express", 1), ("fw_gin", 1), ("fw_httpclient", 1), ("fw_handlers", 0), ("fw_jshttpclient", 1), ("fw_sqlalchemy", 1), ("fw_django", 1), ("fw_nestjs", 1), ("fw_laravel", 1), ("fw_flask", 1), ("fw_aspnet", 1)])
def test_files_are_read_once(spark, name, most):
    assert readers(QUERIES[name](spark, SF)) <= most


@pytest.mark.parametrize("name", ["lp_rust", "lp_php", "lp_javascript", "lp_go", "lp_typescript", "lp_python", "lp_cpp"])
def test_symbols_come_from_many_parts(spark, monkeypatch, name):
    monkeypatch.setattr(code_queries, "FILES_A_PART", 50, raising=False)
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() == 6  # of 150 customers with two files

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstack.llm import source_mix as m
from quillstack.llm.queries import QUERIES, SQL

from .conftest import SF, rows_of


def docs_of(spark, sizes):
    rows = [(i * 1000 + k, s, " ".join(["w"] * n)) for i, (s, counts) in enumerate(sizes.items()) for k, n in enumerate(counts)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES["op4_temperature_mix"](spark, SF)
    assert sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL['op4_temperature_mix']})").fetchall(), key=repr) == rows_of(df)


def test_repetition_limit_and_budget(spark):
    docs = docs_of(spark, {"big": [100] * 200, "mid": [10] * 400, "small": [50] * 20})
    got = {r.source: r for r in m.mixed(docs, max_epochs=3).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("epoch").alias("e"), F.count_distinct("doc_id").alias("d"), F.first("weight").alias("w")).collect()}
    assert got["big"].t == 20000 and got["big"].e == 1 and got["big"].d == 200
    # the smallest source is at the limit, less than one document short of its budget
    assert 2950 <= got["small"].t <= 3000 and got["small"].d == 20
    total = 20000 / got["big"].w
    for s, most in (("mid", 10), ("small", 50)):
        assert got[s].w * total - most - 2 <= got[s].t <= got[s].w * total + 1
    assert sum(r.w for r in got.values()) == pytest.approx(1, abs=1e-6)


def test_target_entropy_and_given_budget(spark):
    import math

    docs = docs_of(spark, {"a": [10] * 1000, "b": [10] * 100, "c": [10] * 10})
    out = m.mixed(docs, target_entropy=0.8, budget_tokens=6000)
    w = [r.weight for r in out.select("source", "weight").distinct().collect()]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(0.8 * math.log(3), rel=1e-3)
    tokens = {r.source: r.t for r in out.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert 6000 - 30 <= sum(tokens.values()) <= 6000


def test_epochs_are_different_permutations_of_the_same_documents(spark):
    docs = docs_of(spark, {"a": [10] * 400, "b": [10] * 100})
    got = m.mixed(docs, max_epochs=4).where("source = 'b'").collect()
    orders = {}
    for r in sorted(got, key=lambda r: r.place):
        orders.setdefault(r.epoch, []).append(r.doc_id)
    assert len(orders) == 4 and all(sorted(o) == sorted(orders[1]) for o in orders.values())
    assert len({tuple(o) for o in orders.values()}) == 4


def test_odd_rows(spark, odd_docs):
    clash = odd_docs.withColumn("epoch", F.lit("mine")).withColumn("Weight", F.lit(1))
    got = m.mixed(clash)
    assert got.groupBy().agg(F.count_distinct("doc_id")).first()[0] == odd_docs.agg(F.count_distinct("doc_id")).first()[0]
    first = got.where("epoch = 1")
    assert first.count() == odd_docs.count()
    assert m.mixed(odd_docs.limit(0)).count() == 0


def test_blocks_beyond_one(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_TOKENS", 50)
    docs = docs_of(spark, {"a": [7] * 500, "b": [3, 11] * 60})
    got = m.mixed(docs, max_epochs=1.6)
    b = got.where("source = 'b'").collect()
    room = 0.6 * 840
    part = sorted((r for r in b if r.epoch == 2), key=lambda r: r.place)
    used = sum(r.n_tokens for r in part)
    assert room - 12 <= used <= room + 1
    assert max(r.block for r in b) > 5


def test_many_blocks_do_not_overflow(spark):
    many = 1 << 31
    top = spark.range(1).select(F.lit((1 << 52) - 1).alias("order"), F.lit(many).cast("long").alias("__blocks"))
    assert top.select(m._block(F.col("order"))).first()[0] == many - 1


def test_input_columns_with_names_of_steps_survive(spark):
    docs = docs_of(spark, {"a": [7] * 50, "b": [3] * 5}).selectExpr("*", "'mine' AS `left`", "1 AS whole", "2 AS exponent", "3 AS cell", "4 AS `order`")
    got = m.mixed(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert {tuple(r) for r in got.select("left", "whole", "exponent", "cell", "order").distinct().collect()} == {("mine", 1, 2, 3, 4)}


def test_documents_without_an_id_are_taken_one_by_one(spark):
    docs = docs_of(spark, {"a": [10] * 100}).unionByName(spark.createDataFrame([(None, "b", " ".join(["w"] * (5 + i))) for i in range(40)], "doc_id long, source string, text string"))
    last = m.mixed(docs, max_epochs=1.5).where("source = 'b' AND epoch = 2")
    assert 0 < last.count() < 40

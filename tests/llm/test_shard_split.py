import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstack.llm import shard_split as s
from quillstack.llm.queries import QUERIES, SQL

from .conftest import SF, rows_of


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES["op10_sampled_splitters"](spark, SF)
    assert sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL['op10_sampled_splitters']})").fetchall(), key=repr) == rows_of(df)


def sound(rows, n=8):
    sizes, slots = {}, {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    for got in slots.values():
        assert sorted(got) == list(range(len(got)))
    return [sizes.get(i, 0) for i in range(n)]


def equal_texts(spark):
    rows = [(i, "hot text of a third of all rows") for i in range(3000)] + [(3000 + i, f"pair {i // 2} " + "x" * (i // 2 % 50)) for i in range(6000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_hot_group_is_divided_and_small_groups_stay(spark):
    df = equal_texts(spark)
    got = s.shards(df).join(df, "doc_id").collect()
    sizes = sound(got)
    assert max(sizes) - min(sizes) <= sum(sizes) / 8 / 32
    assert len({r["shard"] for r in got if r["doc_id"] < 3000}) > 1
    pairs = {}
    for r in got:
        if r["doc_id"] >= 3000:
            pairs.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in pairs.values())


@pytest.mark.parametrize("draws, within", [(16, 0.01), (1, 0.02), (0.05, 0.05)])
def test_splitters_decide_shards_of_near_equal_size(spark, monkeypatch, draws, within):
    """Fewer draws give coarser splitters; overfull ranges are subdivided, so sizes stay near equal."""
    monkeypatch.setattr(s, "DRAWS", draws)
    sizes = sound(s.shards(equal_texts(spark)).collect())
    assert max(abs(x - sum(sizes) / 8) for x in sizes) <= within * sum(sizes) / 8


def test_splitters_are_weighted_by_size(spark):
    """Nine rows of ten are tiny; the bytes, not the rows, are cut into equal parts."""
    rows = spark.range(20000).selectExpr("id AS doc_id", "md5(CAST(id AS string)) AS key", "CASE WHEN md5(CAST(id AS string)) < '1999' THEN 9000L ELSE 1L END AS size")
    total = rows.selectExpr("sum(size)").first()[0]
    bounds = s.splitters(rows, total, 64)
    assert len(bounds) == 63 and bounds == sorted(bounds)
    assert sum(b < "1999" for b in bounds) >= 61


def test_ranges_grow_with_the_table():
    assert s.n_ranges(1000, 8) == 2048
    assert s.n_ranges(2048 * s.RANGE_BYTES, 8) == 2048
    assert s.n_ranges(2048 * s.RANGE_BYTES + 1, 8) == 4096
    assert s.n_ranges(10**14, 8) == s.MOST


def test_one_text_larger_than_a_shard(spark):
    df = spark.createDataFrame([(i, "y" * (100_000 if i == 7 else 10)) for i in range(200)], "doc_id long, text string")
    got = s.shards(df).collect()
    sizes = sound(got)
    assert len(got) == 200 and max(sizes) >= 100_001 and sum(sizes) == 199 * 11 + 100_001


def test_odd_rows(spark, odd_docs):
    clash = odd_docs.withColumn("size", F.lit(1)).withColumn("Key", F.lit("k"))
    got = s.shards(clash).collect()
    assert len(got) == odd_docs.count()
    sound(got)
    texts = sorted((r.doc_id is not None, r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect() if r.doc_id is not None)
    assert texts == sorted((True, r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None)
    assert s.shards(odd_docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "same")] * 80, "doc_id long, text string")
    assert sound(s.shards(same).collect()) == [50] * 8

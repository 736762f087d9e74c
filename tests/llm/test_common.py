from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from appwatch.llm import common


def test_batches_of_long_texts_are_bounded_by_their_bytes(spark):
    """300 texts of 100 kB in one task: no batch of all 30 MB, and no row is lost."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64()), "size": pa.array([batch.nbytes], pa.int64())})

    texts = spark.range(0, 300, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 100000) as text")
    found = common.map_arrow(texts, run, "rows long, size long").collect()
    assert sum(r["rows"] for r in found) == 300 and max(r["size"] for r in found) < 6_000_000


def test_a_batch_size_set_by_the_user_stays(spark):
    before = spark.conf.get(common.BATCH_BYTES, None)
    spark.conf.set(common.BATCH_BYTES, "1m")
    try:
        common.map_arrow(spark.range(1), lambda batches: batches, "id long")
        assert spark.conf.get(common.BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(common.BATCH_BYTES) if before is None else spark.conf.set(common.BATCH_BYTES, before)


def test_marks_miss_no_key_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("id as a", "if(id % 3 = 0, null, id * 7) as b", "id as key_place")
    keys = rows.where("a % 50 = 0").select("a", "b")
    found = {r.a for r in common.marked(rows, [F.col("a"), F.col("b")], keys, "maybe").where("maybe").collect()}
    assert found >= set(range(0, 20_000, 50)) and len(found) < 400 + 1500
    left = common.marked(rows, [F.col("a"), F.col("b")], keys, "maybe")
    assert left.columns == [*rows.columns, "maybe"] and left.count() == 20_000
    assert not common.marked(rows, [F.col("a"), F.col("b")], keys.where("false"), "maybe").where("maybe").count()

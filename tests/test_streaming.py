"""Best hits that arrive in any order and in any number of runs end in the batch answer."""

import random

import pytest

from kinfold.operators import orthology
from kinfold.streaming import best_hits

HIT = "set_id long, q long, s long, gq long, gs long, pident double, score double"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    random.seed(seed)
    rows = [(k, q, 100 + s, q % 3, s % 3, float(random.randrange(50, 60)), float(random.choice([0, 5, 6, 7, 7]))) for k in range(2) for q in range(8) for s in range(12)]
    random.shuffle(rows)
    arrived = []
    for k in range(4):
        part = rows[k::4]
        spark.createDataFrame(part, HIT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arrived += part
        stream = spark.readStream.schema(HIT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        best_hits.follow(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        want = orthology.best_hits(spark.createDataFrame(arrived, HIT).where("gq <> gs")).select("set_id", "q", "gq", "gs", "s", "pident")
        got = best_hits.current(spark, f"{tmp_path}/out").select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # A batch appends the items and groups that had hits in it, and no others.
    new = [(2, 1, 200, 0, 1, 55.0, 9.0)]
    spark.createDataFrame(new, HIT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    best_hits.follow(spark.readStream.schema(HIT).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect()[-1]
    assert (last.q, last.s) == (1, 200) and spark.read.parquet(f"{tmp_path}/out").where(f"batch = {last.batch}").count() == 1

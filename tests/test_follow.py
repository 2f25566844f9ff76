"""A stream with late and repeated records, followed with a ledger."""

from siltstone.streaming.follow import follow
from siltstone.streaming.ledger import IntervalLedger


def test_stream(spark, tmp_path):
    source, ledger = f"{tmp_path}/in", IntervalLedger(spark, f"file://{tmp_path}/ledger")
    put = lambda *n: spark.createDataFrame([(x, f"v{x}") for x in n], "n bigint, v string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: follow(spark.readStream.schema("n bigint, v string").parquet(source), ledger, "n", lambda d: d, f"{tmp_path}/cp").awaitTermination()
    done = lambda: sorted(r.n for p in ledger.outputs() for r in spark.read.parquet(p).collect())
    put(1, 2, 5)
    run()
    put(3, 5, 9)  # 3 is late, 5 comes again
    put(4)
    run()
    assert done() == [1, 2, 3, 4, 5, 9]
    # After a lost checkpoint everything is read again and nothing is processed twice.
    follow(spark.readStream.schema("n bigint, v string").parquet(source), ledger, "n", lambda d: d, f"{tmp_path}/cp2").awaitTermination()
    assert done() == [1, 2, 3, 4, 5, 9]

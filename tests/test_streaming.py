from conftest import SF_SMALL

from shotloom.sources.tables import load
from shotloom.streaming.incremental import start_stream_retrieval


def test_stream_static_retrieval(spark, tmp_path):
    bench = load(spark, SF_SMALL, "benchmark")
    src = tmp_path / "in"
    bench.write.parquet(str(src))
    stream = spark.readStream.schema(bench.schema).parquet(str(src))
    q = start_stream_retrieval(stream, load(spark, SF_SMALL, "documents"), 3,
                               str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3 * bench.count()
    assert out.groupBy("target_id").count().filter("count <> 3").count() == 0

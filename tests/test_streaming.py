from quillmill.plans import queries
from quillmill.streaming import buffering


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_rules(spark):
    quiet, loud = 0.0, 1.0
    blocks = [("s", k, 100, loud if k < 8 else quiet) for k in range(11)] + [("s", 11 + k, 100, loud) for k in range(55)] + [("t", k, 100, quiet) for k in range(5)]
    df = spark.createDataFrame(blocks, "stream_id string, seq long, ms long, level double")
    got = rows(buffering.silence_segments(df))
    assert got == [("s", 0, 0, 10, 11, 1100, "silence"), ("s", 1, 11, 60, 50, 5000, "full")]
    assert rows(buffering.silence_segments(df.where("stream_id = 'x'"))) == []


def test_streams_equal_batches(spark, sf_dir):
    assert rows(queries.vad_segments_stream(spark, sf_dir)) == rows(queries.vad_segments_batch(spark, sf_dir))
    assert rows(queries.fixed_buffer_stream(spark, sf_dir)) == rows(queries.fixed_buffer_batch(spark, sf_dir))

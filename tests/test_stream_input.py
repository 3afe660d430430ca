"""The input of a stream is stored once."""

import os

from cloakframe.plans import registry
from cloakframe.session import checkpoint_dir


def test_stream_input_is_stored_once(spark):
    df = spark.range(90).selectExpr("id", "concat('text ', id) AS text")
    root = registry._stream_folder(spark)
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    stream = registry._in_batches(df, registry._thirds(df, "id"), 3, root)
    assert set(os.listdir(folder)) - before == {os.path.basename(root)}
    assert stream.isStreaming and spark.read.parquet(f"{root}/in").exceptAll(df).count() == 0 and spark.read.parquet(f"{root}/in").count() == 90

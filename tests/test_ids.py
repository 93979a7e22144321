import pytest
from pyspark.sql import functions as F

from markovmill.functions.ids import from_bytes, nth, successor, to_bytes


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_ids(spark, size):
    most = 256**size - 1
    values = sorted({0, 1, 200, most // 3, most})
    df = spark.createDataFrame([(v,) for v in values if v <= most], "t bigint")
    t = F.col("t")
    for r in df.select("t", to_bytes(t, size).alias("b"), from_bytes(to_bytes(t, size), size).alias("again"), successor(t, size).alias("next"), nth(t, size).alias("nth")).collect():
        assert bytes(r.b) == r.t.to_bytes(size, "little") and r.again == r.t == r.nth and r.next == (r.t + 1) % 256**size

import pytest
from pyspark.sql import functions as F

from pyrogrid.sources.raster import rasterize

ROWS = [("a", 0, 3, 40), ("a", 0, 3, 10), ("a", 0, 0, 5), ("a", 0, 8, 25), ("a", 2, 4, 100), ("a", 2, 5, -7),
        ("a", 6, 1, 9), ("a", -1, 1, 9), ("a", 1, 9, 9), ("a", None, 1, 9), (None, 1, 1, 9),
        ("b", 5, 8, 0), ("c", 0, 9, 1)]


def raster(spark, **more):
    df = spark.createDataFrame(ROWS, "f string, y int, x int, w long")
    return rasterize(df, F.col("f"), F.col("y"), F.col("x"), F.col("w"), 6, 9, **more)


@pytest.mark.parametrize("block", [1024, 9, 4, 1])
def test_every_cell_once(spark, block):
    out = [tuple(r) for r in raster(spark, block=block).select("frame_id", "y", "x", "v", "height", "width").collect()]
    want = {("a", 0, 0): 12, ("a", 0, 3): 127, ("a", 0, 8): 63, ("a", 2, 4): 255}
    assert sorted(out) == [(f, y, x, want.get((f, y, x), 0), 6, 9) for f in "ab" for y in range(6) for x in range(9)]


def test_empty_cells_are_never_shuffled(spark):
    """Cells arise in the last step, so no table, sort or shuffle grows with the empty ones."""
    plan = raster(spark)._jdf.queryExecution().optimizedPlan().toString()
    after = plan[:plan.index("explode(sequence")]
    assert not any(step in after for step in ("Aggregate", "Join", "Repartition", "Window"))

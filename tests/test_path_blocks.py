from pyspark.sql import functions as F

from flightwatch.operators import path
from flightwatch.operators.timeline import chunk_width


def test_narrow_chunks_make_no_small_blocks(spark, monkeypatch):
    """A flight of 3,000 rows in chunks of 10 rows, another of 100: as many blocks as their rows ask for, and the same cuts."""
    rows = [(f, i / 10, (i * 7 % 13) / 100 + i / 10) for f, n in (("a", 3000), ("b", 100)) for i in range(n)]
    df = spark.createDataFrame(rows, "flight_id string, time_s double, path_km double")
    df = df.unionByName(df.limit(3).withColumn("flight_id", F.lit(None).cast("string")))
    seen, blocks = [], path._blocks

    def counting(*args):
        made = blocks(*args)
        seen.append(sorted(map(tuple, made.groupBy("flight_id", "_rank").count().collect())))
        return made

    monkeypatch.setattr(path, "_blocks", counting)
    found = []
    for width in (1.0, 3600.0):
        with chunk_width(width):
            found.append(sorted(map(tuple, path.path_cuts(df, 0.25, block_rows=1000).collect())))
    assert found[0] == found[1] and {f for f, _ in found[0]} == {"a", "b"}
    assert seen[0] == seen[1] == [("a", 0, 1000), ("a", 1, 1000), ("a", 2, 1000), ("b", 0, 100)]

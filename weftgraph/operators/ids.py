"""Dense ids in the order of files and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import small_table, stored

GAPS_A_BUCKET = 8  # missing lines for each bucket up to which they are looked up, row by row
_SHIFT = 33  # monotonically_increasing_id: partition number above, place in the partition below


def assign_ids(rows: DataFrame, order: list[str], base: int = 0, name: str = "id") -> DataFrame:
    """``rows`` with ids base, base + 1, ... in ``order``; ties are told apart by all that sorts them and else arbitrarily.

    Range-partitioned and sorted once; one count per partition comes to the driver and goes back as an offset. No task holds more than its range.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = stored(placed, "ids")
    part = F.shiftright("_at", _SHIFT).alias("_part")
    counts = sorted((r._part, r.n) for r in kept.groupBy(part).agg(F.count("*").alias("n")).collect())
    starts, at = [], base
    for p, n in counts:
        starts.append((p, at))
        at += n
    offsets = small_table(spark, starts, "_part bigint, _start bigint")
    inside = F.col("_at") - F.shiftleft("_part", _SHIFT)
    return kept.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_start", "_at")


def number_by_line(rows: DataFrame, total: int, base: int = 0, name: str = "id", unique: bool = False) -> DataFrame:
    """As ``assign_ids`` over (file_no, line_no), for rows whose line numbers lie in 1 to about ``total`` per file, some of them left out.

    Lines fall into buckets of equal width; one count per bucket comes to the driver. Nothing is sampled or stored; the rows before it are evaluated twice, for
    counting only as far as that needs them. ``unique``: no line number stands twice in a file. Then an id follows from the line number and the lines missing before it
    in its bucket, without a shuffle, as long as there are few of these for a bucket; otherwise ranks are counted inside a bucket, after one hash shuffle.
    """
    spark = rows.sparkSession
    width = min(1 << 20, max(4096, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1))
    bucket = F.floor(F.col("line_no") / width).cast("bigint")
    keys = ["file_no", "_bucket"]
    placed = rows.withColumn("_bucket", bucket)
    counts = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi")).collect()
    starts, at, gaps = [], base, {}
    for r in sorted(counts, key=lambda r: (r.file_no, r._bucket)):
        starts.append((r.file_no, r._bucket, at, r.lo))
        at += r.n
        if r.hi - r.lo + 1 != r.n:
            gaps[r.file_no, r._bucket] = r.hi - r.lo + 1 - r.n
    if not unique or sum(gaps.values()) > GAPS_A_BUCKET * len(counts):
        offsets = small_table(spark, [x[:3] for x in starts], "file_no int, _bucket bigint, _start bigint")
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))
        return placed.withColumn("_place", place).join(offsets, keys).withColumn(name, F.col("_start") + F.col("_place") - 1).drop("_bucket", "_place", "_start")
    runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    if gaps:
        before = F.lag("line_no").over(Window.partitionBy(*keys).orderBy("line_no"))
        near = placed.join(small_table(spark, list(gaps), "file_no int, _bucket bigint"), keys, "left_semi").select(*keys, "line_no", (F.col("line_no") - before - 1).alias("missing"))
        for r in near.where("missing > 0").collect():  # no more rows than there are missing lines
            runs.setdefault((r.file_no, r._bucket), []).append((r.line_no, r.missing))
    known = [(*x, runs.get(x[:2], [])) for x in starts]
    offsets = small_table(spark, known, "file_no int, _bucket bigint, _start bigint, _lo bigint, _runs array<struct<after: bigint, missing: bigint>>")
    passed = F.aggregate(F.col("_runs"), F.lit(0).cast("bigint"), lambda n, x: n + F.when(x["after"] <= F.col("line_no"), x["missing"]).otherwise(0))
    missing = F.when(F.size("_runs") > 0, passed).otherwise(0)
    return placed.join(offsets, keys).withColumn(name, F.col("_start") + F.col("line_no") - F.col("_lo") - missing).drop("_bucket", "_start", "_lo", "_runs")


def next_id(entities: DataFrame) -> int:
    """The id after the largest, 0 for an empty table."""
    top = entities.agg(F.max("id")).first()[0]
    return 0 if top is None else top + 1

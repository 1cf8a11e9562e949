"""Per-key results where a few keys hold most rows: two-stage salted aggregation.

Heavy keys get a salt; partial results per (key, salt) are merged by key. The salt is a hash of the value whose distinct count is
wanted, which is as random as a drawn one but the same when a lost task runs again, and parts the values among the salts, so that
the partial distinct counts add up.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(table: DataFrame, fields: list[str], value: str, order: str) -> DataFrame:
    """(field_name, key_value, value, ord): one row per row and field; null and empty keys are left out."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("key_value")) for f in fields])
    return (
        table.select(F.col(value).alias("value"), F.col(order).alias("ord"), F.explode(pairs).alias("k"))
        .select("k.field_name", "k.key_value", "value", "ord")
        .where("key_value is not null and key_value <> ''")
    )


def heavy_keys(rows: DataFrame, total: int, share: float, sample_rows: int) -> DataFrame:
    """Keys with at least ``share`` of a sample of about ``sample_rows`` rows: (field_name, key_value, salts), at most 2 / share keys a field.

    The sample only chooses which keys are salted and how finely; the results that come of it count all rows.
    """
    fraction = min(1.0, sample_rows / max(total, 1))
    seen = rows.sample(fraction, 17) if fraction < 1 else rows
    least = max(2, math.floor(share * total * fraction))
    salts = F.least(F.lit(4096), F.ceil(F.col("n") / F.lit(least)) + 1).cast("int")
    return seen.groupBy("field_name", "key_value").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("field_name", "key_value", salts.alias("salts"))


def salted_stats(table: DataFrame, fields: list[str], value: str, order: str, distinct: bool = True, share: float = 0.005, sample_rows: int = 200_000) -> DataFrame:
    """Per field and key: n_rows, first_load, last_load and, with ``distinct``, end_names (different values, nulls not counted).

    Null and empty keys have no row; ties and repeated rows count each time. The list of heavy keys has no more than 2 / share entries a
    field and is broadcast. An empty table gives no rows.
    """
    rows = keyed(table, fields, value, order)
    heavy = F.broadcast(heavy_keys(rows.select("field_name", "key_value"), len(fields) * table.count(), share / len(fields), sample_rows))
    salted = rows.join(heavy, ["field_name", "key_value"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("value", "ord" if not distinct else "value"), F.col("salts")), F.lit(0)).cast("int"))
    partial = [F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi")]
    merged = [F.sum("n").alias("n_rows"), F.min("lo").alias("first_load"), F.max("hi").alias("last_load")]
    if distinct:
        partial.append(F.count_distinct("value").alias("values"))
        merged.append(F.sum("values").alias("end_names"))
    first = salted.groupBy("field_name", "key_value", "salt").agg(*partial)
    return first.groupBy("field_name", "key_value").agg(*merged)


def dominant_keys(stats: DataFrame, total: int, share: float = 0.02) -> DataFrame:
    """(field_name, key_value) of keys in at least ``share`` of ``total`` rows."""
    return stats.where(F.col("n_rows") >= math.ceil(share * total - 1e-9)).select("field_name", "key_value")

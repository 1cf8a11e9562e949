"""References to records that don't exist: parents as sorted arrays per key range, references probed by binary search.

Names become a 96-bit fingerprint; parents (an interval from being set up to being deleted) and references are range-partitioned
together by (fingerprint, time, ...), so that even one name with a third of all rows is cut into as many ranges as its rows need. In a
range the parents are sorted arrays with a running maximum of their ends; a batch of references finds its predecessors by binary
search. What a range can't know - parents of its first name in the ranges before it - is settled afterwards from one summary row per range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.cells import is_key
from weftgraph.session import partitions_for, small_table, stored

_NEVER, _NONE = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_PROBED = "kind string, pid int, row_id bigint, side int, t bigint, h bigint, g int, last_h bigint, last_g int, tail_end bigint"
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
ROWS_PER_RANGE = 1_000_000


def _fingerprint(name: str) -> list:
    return [F.xxhash64(name).alias("h"), F.hash(name).alias("g")]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid = TaskContext.get().partitionId()
    first = last = None
    carry = _NONE
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g, t, side, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "t", "side", "x"))
        new = np.empty(len(h), bool)
        new[0] = True
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        group = np.cumsum(new) - 1
        if first is None:
            first = (h[0], g[0])
        goes_on = last == (h[0], g[0])
        if not goes_on:
            carry = _NONE
        parents, refs = np.flatnonzero(side == 0), np.flatnonzero(side)
        owner = group[parents]
        ends = pd.Series(x[parents]).groupby(owner).cummax().to_numpy()
        if goes_on:
            ends = np.where(owner == 0, np.maximum(ends, carry), ends)
        at = np.searchsorted(parents, refs) - 1
        known = (at >= 0) & (owner[at] == group[refs]) if len(parents) else np.zeros(len(refs), bool)
        end = np.where(group[refs] == 0, carry, _NONE)
        end[known] = ends[at[known]]
        missed = refs[end <= t[refs]]
        if len(missed):
            open_ = (h[missed] == first[0]) & (g[missed] == first[1])
            none = np.full(len(missed), None)
            kind = np.where(open_, "open", "miss")
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k, from_pandas=True) for v, k in zip([kind, np.full(len(missed), pid), x[missed], side[missed], t[missed], h[missed], g[missed], none, none, none], _TYPES, strict=True)],
                names=[c.split(" ")[0] for c in _PROBED.split(", ")],
            )
        tail = ends[owner == group[-1]]
        carry = max(int(tail[-1]) if len(tail) else _NONE, carry if group[-1] == 0 else _NONE)
        last = (h[-1], g[-1])
    if first is not None:
        row = ["range", pid, None, None, None, first[0], first[1], last[0], last[1], carry]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _TYPES, strict=True)], names=[c.split(" ")[0] for c in _PROBED.split(", ")])


def _carried(ranges: list) -> list[tuple[int, int]]:
    """(pid, end) for each range whose first name has parents in ranges before it. One row per range came here, no more than there are shuffle partitions."""
    out, key, end = [], None, _NONE
    for r in sorted(ranges, key=lambda r: r.pid):
        if key == (r.h, r.g) and end != _NONE:
            out.append((r.pid, end))
        tail = (r.last_h, r.last_g)
        end = max(r.tail_end, end if tail == key else _NONE)
        key = tail
    return out


def references(rels: DataFrame) -> DataFrame:
    """(row_id, side, name, t) of every endpoint that is a key; ``t`` is the loading time in microseconds, null where unknown."""
    sides = F.array(*[F.struct(F.lit(i + 1).alias("side"), F.col(c).alias("name")) for i, c in enumerate(("c0", "c1"))])
    return (
        rels.select("row_id", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("t"), F.explode(sides).alias("s"))
        .select("row_id", "t", "s.side", "s.name")
        .where(is_key(F.col("name")))
    )


def parents_of(tables: list[DataFrame], name: str) -> DataFrame:
    """(h, g, t, end): when each name was set up and deleted. Rows without name or loading time stand for nothing."""
    every = None
    for table in tables:
        part = table.where(F.col(f"`{name}`").isNotNull() & F.col("loaded_at").isNotNull()).select(
            *_fingerprint(f"`{name}`"),
            F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("t"),
            F.coalesce(F.unix_micros(F.col("deleted_at").cast("timestamp")), F.lit(int(_NEVER))).alias("end"),
        )
        every = part if every is None else every.unionByName(part)
    return every.groupBy("h", "g", "t").agg(F.max("end").alias("end"))


def orphans(rels: DataFrame, tables: list[DataFrame], name: str = "name:string:users", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(row_id, side, t): endpoints for which no parent stood at the time of loading; side is ``c0`` or ``c1``.

    A parent stands from loaded_at (inclusive) to deleted_at (exclusive, null: for ever). Cells that aren't keys are no references. A
    relationship without loading time has no standing parent. Repeated rows come out as often as they stand. Runs one job for
    the ranges' summaries; the rest is lazy.
    """
    spark = rels.sparkSession
    refs = references(rels)
    parents = parents_of(tables, name)
    both = parents.select("h", "g", "t", F.lit(0).alias("side"), F.col("end").alias("x")).unionByName(
        refs.where("t is not null").select(*_fingerprint("name"), "t", "side", F.col("row_id").alias("x"))
    )
    n = partitions_for(spark, 2 * rels.count(), rows_per_range)
    ranged = both.repartitionByRange(n, "h", "g", "t", "side", "x").sortWithinPartitions("h", "g", "t", "side")
    probed = stored(ranged.mapInArrow(_probe, _PROBED), "orphans")
    carried = _carried(probed.where("kind = 'range'").select("pid", "h", "g", "last_h", "last_g", "tail_end").collect())
    ends = small_table(spark, carried, "pid int, carried bigint")  # one row per range at most
    settled = (
        probed.where("kind in ('miss', 'open')")
        .join(ends, "pid", "left")
        .where("kind = 'miss' or carried is null or carried <= t")
        .select("row_id", "side", "t")
    )
    missing = settled.unionByName(references(rels.where("loaded_at is null")).select("row_id", "side", "t"))  # a filter that the scan takes
    return missing.select("row_id", F.when(F.col("side") == 1, "c0").otherwise("c1").alias("side"), "t")


def orphan_report(rels: DataFrame, missing: DataFrame, tbl: str = "rels") -> DataFrame:
    """References and orphans per table, side and month of loading (null: no loading time); months without orphans have 0."""
    month = F.date_format(F.timestamp_micros("t").cast("timestamp_ntz"), "yyyy-MM").alias("month")
    side = F.when(F.col("side") == 1, "c0").otherwise("c1").alias("side")
    total = references(rels).groupBy(side, month).agg(F.count("*").alias("n_refs"))
    missed = missing.groupBy("side", month).agg(F.count("*").alias("n_orphans"))
    joined = total.alias("a").join(missed.alias("b"), (F.col("a.side") == F.col("b.side")) & F.col("a.month").eqNullSafe(F.col("b.month")), "left")
    return joined.select(F.lit(tbl).alias("tbl"), "a.side", "a.month", "a.n_refs", F.coalesce("b.n_orphans", F.lit(0)).alias("n_orphans"))

"""Column profiles: declared checks compiled into one aggregate scan, mergeable states per load, and limits on how metrics move.

A state is a row per (table, field, load) of counts, sums, extremes and a distinct sketch; states of parts of a load, or of loads
scanned at other times, merge by the same aggregates. Where a column's distinct values are to be counted exactly, its states are kept per value, which
merge too. Metrics are computed of states, never of rows; ``History`` keeps states in a folder, so that a new load costs a scan of that load.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.cells import DAY_FORM, NAME_FORM, as_day, as_int, as_long, is_key
from weftgraph.functions.util import apart
from weftgraph.session import stored


@dataclass(frozen=True)
class Check:
    """What is declared of a column: the value of a well-formed cell (null of any other), its range, the number its mean is of, and the measures that are watched with their limits.

    ``value`` is of the cell's text, ``in_range`` and ``number`` are of the value; ``kind`` (whole, real, day, time or text) says what it is.
    """

    field: str
    value: Callable[[Column], Column] = lambda c: c
    in_range: Callable[[Column], Column] = lambda v: F.lit(True)
    number: Callable[[Column], Column] = lambda v: F.char_length(v)
    limits: dict[str, float] = field(default_factory=dict)
    exact_distinct: bool = False
    kind: str = "text"


AGE = Check("age", as_int, lambda v: v.between(0, 120), lambda v: v, {"null_rate": 0.06, "bad_rate": 0.06, "out_rate": 0.04, "mean": 4.0}, kind="whole")
NAME = Check(
    "name:string:users",
    lambda c: F.when(c.rlike(NAME_FORM), c),
    limits={"null_rate": 0.06, "bad_rate": 0.06, "mean": 2.0, "distinct_rate": 0.06},
    exact_distinct=True,
)
SINCE = Check("c3", as_day, lambda v: v.between("1950-01-01", "2025-12-31"), F.year, {"null_rate": 0.06, "bad_rate": 0.06, "out_rate": 0.04, "mean": 3.0}, kind="day")
ENDS = [Check(c, lambda c: F.when(is_key(c), c)) for c in ("c0", "c1")]
COUNTER = Check("c4", as_long, number=lambda v: v, kind="whole")


def check_of(column: T.StructField) -> Check:
    """The check of a column that nothing is declared of: of its type, all cells well-formed and in range, with the mean of its numbers, days since 1970 or text lengths."""
    own, kind = F.col(f"`{column.name}`"), column.dataType
    if isinstance(kind, T.IntegralType):
        return Check(column.name, lambda c: own, number=lambda v: v, kind="whole")
    if isinstance(kind, T.NumericType):
        return Check(column.name, lambda c: own.cast("double"), number=lambda v: v, kind="real")
    if isinstance(kind, T.DateType):
        return Check(column.name, lambda c: own, number=F.unix_date, kind="day")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Check(column.name, lambda c: own, number=lambda v: F.unix_date(v.cast("date")), kind="time")
    return Check(column.name)


# The classes that the form of a cell is counted in, and their patterns.
FORMS = {"whole": r"\A[+-]?[0-9]+\z", "real": r"\A[+-]?[0-9]*[.,][0-9]+\z", "day": DAY_FORM, "name": NAME_FORM, "word": r"\A[\p{L}_]+\z", "spaces": r"\A\s+\z"}
_SUMS = ("n_rows", "n_blank", "n_good", "n_in", "total", "squares")
# How states merge that aren't sums.
_MERGES = {f"{side}_{k}": f for k in ("whole", "real", "day", "time") for side, f in (("low", F.min), ("high", F.max))} | {"lowest": F.min, "highest": F.max, "sketch": F.hll_union_agg}
# The types of the extremes of well-formed values, by kind; texts have those of all filled cells.
EXTREMES = {"whole": "bigint", "real": "double", "day": "date", "time": "timestamp_ntz"}
# Bins of texts (by hash), bins of numbers in a doubling, and the precision of sketches (standard error below 1 percent).
TEXT_BINS, BINS_A_DOUBLING, SKETCH_LOG2 = 64, 4, 14
MEAN_SPREADS = 0.25  # a mean without a limit of its own moves by this part of the deviation


def _bin_of(check: Check, value: Column) -> Column:
    """The bin of a value: fixed before any row is seen, so that counts of bins merge. Null where there is none.

    Whole and real numbers: quarters of a doubling of 1 + its size, with its sign; days: years; times: months (12 * year + month); texts: one of TEXT_BINS by hash.
    """
    if check.kind in ("whole", "real"):
        size = F.least(BINS_A_DOUBLING * F.log2(1 + F.abs(value.cast("double"))), F.lit(1e5))  # also of infinities and NaN
        at = F.ceil(size * F.when(value < 0, -1).otherwise(1))
    elif check.kind == "day":
        at = F.year(value)
    elif check.kind == "time":
        at = 12 * F.year(value) + F.month(value)
    else:
        at = F.pmod(F.xxhash64(value), F.lit(TEXT_BINS))
    return F.when(value.isNotNull(), at.cast("int"))


def _read(table: DataFrame, checks: list[Check], by: str) -> DataFrame:
    """(load, c0, v0, c1, v1, ...): the text of each filled cell and its value, worked out once: what follows reads them many times."""
    once = F.monotonically_increasing_id() >= 0  # true of every row; keeps Catalyst from copying a conversion into each expression that reads it
    columns = []
    for i, check in enumerate(checks):
        cell = F.col(f"`{check.field}`").cast("string")
        columns += [F.when(once & (cell != ""), cell).alias(f"c{i}"), F.when(once & (cell != ""), check.value(cell)).alias(f"v{i}")]
    return table.select(F.col(by).alias("load"), *columns)


def _form_of(cell: Column) -> Column:
    """The place of a cell's form in FORMS, or their number where it has none of them. Its first character parts numbers and days from words, so that few patterns are tried."""
    forms = list(FORMS)
    chain = lambda names: reduce(lambda w, n: w.when(cell.rlike(FORMS[n]), forms.index(n)), names, F.when(F.lit(False), 0)).otherwise(len(forms))
    return F.when(F.substring(cell, 1, 1).isin(*"+-.,0123456789"), chain(("whole", "real", "day"))).otherwise(chain(("name", "word", "spaces")))


def _facts_of(check: Check, sketch: bool, i: int) -> dict[str, Column]:
    """What the aggregates need to know of a cell. ``number`` is null outside the range."""
    cell, value = F.col(f"c{i}"), F.col(f"v{i}")
    within = value.isNotNull() & F.coalesce(check.in_range(value), F.lit(False))
    facts = {"cell": cell, "good": value.isNotNull(), "within": within, "number": F.when(within, check.number(value).cast("double" if sketch else "bigint"))}
    if sketch:
        facts["form"] = F.when(cell.isNotNull(), _form_of(cell))
        if check.kind in EXTREMES:
            facts["value"] = value.cast(EXTREMES[check.kind])
    return facts


def _states_of(check: Check, sketch: bool, at: str) -> dict[str, Column]:
    cell, form = F.col(f"{at}cell"), F.col(f"{at}form")
    aggs = {
        "n_rows": F.count("*"),
        "n_blank": F.count_if(cell.isNull()),
        "n_good": F.count_if(F.col(f"{at}good")),
        "n_in": F.count_if(F.col(f"{at}within")),
        "total": F.sum(f"{at}number"),
    }
    if sketch:
        aggs |= {"lowest": F.min(cell), "highest": F.max(cell)}
        if check.kind in EXTREMES:
            aggs |= {f"low_{check.kind}": F.min(f"{at}value"), f"high_{check.kind}": F.max(f"{at}value")}
        aggs |= {f"form_{f}": F.count_if(form == i) for i, f in enumerate((*FORMS, "other"))}
        aggs["squares"] = F.sum(F.col(f"{at}number") * F.col(f"{at}number"))
        aggs["sketch"] = F.hll_sketch_agg(cell, SKETCH_LOG2)
    return aggs


def wide_states(table: DataFrame, checks: list[Check], by: str = "load_no", sketch: bool = False) -> DataFrame:
    """The states of all ``checks`` in one scan: one row per load (load, value, s0_n_rows, ...), or per load and value of the column that asks for an exact distinct count.

    ``sketch`` adds extremes, form counts and a distinct sketch. At most one column may ask for an exact count: its different values are shuffled, after
    counting in each task. Rows without load have the load null. An empty table has no states.
    """
    exact = [i for i, c in enumerate(checks) if c.exact_distinct]
    if len(exact) > 1:
        raise ValueError("only one column can have an exact distinct count")
    facts, aggs = [], []
    for i, check in enumerate(checks):
        facts += [c.alias(f"f{i}_{n}") for n, c in _facts_of(check, sketch, i).items()]
        aggs += [a.alias(f"s{i}_{n}") for n, a in _states_of(check, sketch, f"f{i}_").items()]
    value = F.col(f"f{exact[0]}_cell") if exact else F.lit(None).cast("string")
    load = apart(F.col("load")).alias("load") if sketch else F.col("load")
    return _read(table, checks, by).select(load, *facts).withColumn("value", value).groupBy("load", "value").agg(*aggs)


def merge_wide(states: DataFrame, *keys: str) -> DataFrame:
    """States of parts into one per load, or per ``keys``; ``values`` counts the different values of all parts."""
    keys = keys or ("load",)
    state = re.compile(r"s\d+_(.+)")
    aggs = [_MERGES.get(state.fullmatch(c).group(1), F.sum)(c).alias(c) for c in states.columns if state.fullmatch(c)]
    return states.groupBy(*keys).agg(*aggs, *([] if "value" in keys else [F.count("value").alias("values")]))


def long_states(merged: DataFrame, tbl: str, checks: list[Check], sketch: bool = False) -> DataFrame:
    """``merge_wide`` as a row per field and load: (load_no, tbl, field_name, n_rows, ...)."""
    exact = any(c.exact_distinct for c in checks)
    packed = []
    for i, check in enumerate(checks):
        cells = {n: F.col(f"s{i}_{n}") for n in _states_of(check, sketch, f"f{i}_")}
        if exact:
            cells["n_distinct"] = F.col("values") if check.exact_distinct else F.lit(None).cast("bigint")
        for kind, ddl in EXTREMES.items() if sketch else ():
            cells.setdefault(f"low_{kind}", F.lit(None).cast(ddl))
            cells.setdefault(f"high_{kind}", F.lit(None).cast(ddl))
        packed.append(F.struct(F.lit(tbl).alias("tbl"), F.lit(check.field).alias("field_name"), *[cells[n].alias(n) for n in sorted(cells)]))
    return merged.select(F.col("load").alias("load_no"), F.explode(F.array(*packed)).alias("s")).select("load_no", "s.*")


def scan_states(table: DataFrame, tbl: str, checks: list[Check], by: str = "load_no", sketch: bool = False) -> DataFrame:
    """``wide_states`` merged, as a row per field and load."""
    return long_states(merge_wide(wide_states(table, checks, by, sketch)), tbl, checks, sketch)


class History:
    """The states of a table's loads, kept in a folder as one Parquet part a scan."""

    def __init__(self, spark: SparkSession, folder: str, tbl: str, checks: list[Check], by: str = "load_no", sketch: bool = False) -> None:
        self.spark, self.path, self.tbl, self.checks, self.by, self.sketch = spark, f"{folder.rstrip('/')}/{tbl}", tbl, checks, by, sketch
        self.parts = 0
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part=*")
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        self.parts = len(found) if found else 0

    def add(self, table: DataFrame) -> History:
        """Scan all rows of ``table``, loads or parts of loads that no scan has seen, and keep their states."""
        wide_states(table, self.checks, self.by, self.sketch).write.parquet(f"{self.path}/part={self.parts}")
        self.parts += 1
        return self

    def refresh(self, table: DataFrame) -> History:
        """Scan the loads of ``table`` that aren't known. Known loads aren't read again where files or row groups tell loads apart; rows that came late to one want ``add``."""
        if not self.parts:
            return self.add(table)
        known = sorted(r.load for r in self._read().select("load").where("load is not null").distinct().collect())  # one row per load
        load = F.col(self.by)
        if known and known[-1] - known[0] + 1 == len(known):
            new = (load < known[0]) | (load > known[-1])  # a range prunes row groups
        else:
            new = ~load.isin(known)
        return self.add(table.where(new))

    def _read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("part")

    def states(self) -> DataFrame:
        """The states of all scans, merged: a row per field and load."""
        kept = self._read()
        if self.parts > 1 and any(c.exact_distinct for c in self.checks):
            kept = merge_wide(kept, "load", "value")
        return long_states(merge_wide(kept), self.tbl, self.checks, self.sketch)


def scan_bins(table: DataFrame, tbl: str, checks: list[Check], by: str = "load_no") -> DataFrame:
    """(tbl, field_name, load_no, bin, n): the histogram of the well-formed values of every check and load, in one scan."""
    bins = F.array(*[_bin_of(c, F.col(f"v{i}")) for i, c in enumerate(checks)])
    counted = _read(table, checks, by).select(F.col("load").alias("load_no"), F.posexplode(bins).alias("at", "bin")).where("bin is not null").groupBy("load_no", "at", "bin").agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(c.field) for c in checks])
    return counted.select(F.lit(tbl).alias("tbl"), F.get(names, F.col("at")).alias("field_name"), "load_no", "bin", "n")


def merge_bins(bins: DataFrame) -> DataFrame:
    """Histograms of parts of loads into one per (tbl, field_name, load_no)."""
    return bins.groupBy("tbl", "field_name", "load_no", "bin").agg(F.sum("n").alias("n"))


def value_shifts(bins: DataFrame) -> DataFrame:
    """(tbl, field_name, load_no, value_shift, chance) of every load with values that load_no - 1 has values too.

    value_shift: half the sum of the differences of the bins' shares; chance: what it comes to on average between two draws of one distribution.
    """
    keys = ["tbl", "field_name", "load_no"]
    known = bins.where("load_no is not null")
    now = known.select(*keys, "bin", F.col("n").alias("now"), F.lit(0).cast("bigint").alias("before"))
    before = known.select("tbl", "field_name", (F.col("load_no") + 1).alias("load_no"), "bin", F.lit(0).cast("bigint").alias("now"), F.col("n").alias("before"))
    both = now.unionByName(before).groupBy(*keys, "bin").agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
    load = Window.partitionBy(*keys)
    shares = both.withColumns({"n1": F.sum("now").over(load), "n0": F.sum("before").over(load)}).where("n1 > 0 and n0 > 0")
    pooled = (F.col("now") + F.col("before")) / (F.col("n1") + F.col("n0"))
    noise = F.sqrt(2 / math.pi * pooled * (1 - pooled) * (1 / F.col("n1") + 1 / F.col("n0")))
    return shares.groupBy(*keys).agg((F.sum(F.abs(F.col("now") / F.col("n1") - F.col("before") / F.col("n0"))) / 2).alias("value_shift"), (F.sum(noise) / 2).alias("chance"))


def merge_states(states: DataFrame) -> DataFrame:
    """States of parts of loads into one per (tbl, field_name, load_no). Exact distinct counts don't merge; sketches do."""
    aggs = [F.sum(c).alias(c) for c in states.columns if c in _SUMS or c.startswith("form_")]
    if "sketch" in states.columns:
        aggs += [f(f"{side}_{k}").alias(f"{side}_{k}") for k in EXTREMES for side, f in (("low", F.min), ("high", F.max))]
        aggs += [F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.hll_union_agg("sketch").alias("sketch")]
    return states.groupBy("tbl", "field_name", "load_no").agg(*aggs)


def metrics(states: DataFrame) -> DataFrame:
    """(tbl, field_name, load_no, measure_name, value): a measure whose denominator is 0 has no row."""
    filled = F.col("n_rows") - F.col("n_blank")
    values = {
        "null_rate": F.try_divide("n_blank", "n_rows"),
        "bad_rate": F.try_divide(filled - F.col("n_good"), filled),
        "out_rate": F.try_divide(F.col("n_good") - F.col("n_in"), "n_good"),
        "mean": F.try_divide("total", "n_in"),
    }
    if "n_distinct" in states.columns:
        values["distinct_rate"] = F.try_divide("n_distinct", filled)
    pairs = F.array(*[F.struct(F.lit(k).alias("measure_name"), v.cast("double").alias("value")) for k, v in values.items()])
    return states.select("tbl", "field_name", "load_no", F.explode(pairs).alias("m")).select("tbl", "field_name", "load_no", "m.*").where("value is not null")


def limits_table(measured: DataFrame, tbl: str, checks: list[Check]) -> DataFrame:
    rows = [(tbl, c.field, m, float(x)) for c in checks for m, x in c.limits.items()]
    return measured.sparkSession.createDataFrame(rows, "tbl string, field_name string, measure_name string, most double")


def changes(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Measures of a load that differ from those of the load before it (load_no - 1, if there is one) by more than their limit. ``limits`` has a row per declared measure."""
    run = Window.partitionBy("tbl", "field_name", "measure_name").orderBy("load_no")  # one row per load
    known = measured.where("load_no is not null").withColumn("before", F.when(F.lag("load_no").over(run) == F.col("load_no") - 1, F.lag("value").over(run)))
    return known.join(F.broadcast(limits), ["tbl", "field_name", "measure_name"]).where(F.abs(F.col("value") - F.col("before")) > F.col("most"))


def _outside(value: str, past: Window, sigmas: float, least: int) -> tuple[Column, Column, Column, Column]:
    """(n_before, centre, deviation, outside) of a measure against its values in the window ``past``; rows without load count for no other."""
    seen = F.when(F.col("load_no").isNotNull(), F.col(value))
    n, centre, deviation = F.count(seen).over(past), F.avg(seen).over(past), F.stddev_samp(seen).over(past)
    return n, centre, deviation, F.coalesce((n >= least) & (F.abs(F.col(value) - centre) > sigmas * deviation + 1e-9), F.lit(False))


def control_limits(measured: DataFrame, sigmas: float = 3.0, least: int = 3) -> DataFrame:
    """Shewhart limits: a measure against mean and deviation of the loads before it; fewer than ``least`` of them give no verdict.

    The history of a measure is one value per load, over which the limits run once.
    """
    past = Window.partitionBy("tbl", "field_name", "measure_name").orderBy("load_no").rowsBetween(Window.unboundedPreceding, -1)
    return measured.withColumns(dict(zip(("n_before", "centre", "deviation", "outside"), _outside("value", past, sigmas, least), strict=True)))


FORM_COLUMNS = [f"form_{f}" for f in (*FORMS, "other")]
DECLARED = {c.field: c for c in (AGE, NAME, SINCE, *ENDS, COUNTER)}
MEASURES = ("null_rate", "bad_rate", "out_rate", "mean", "distinct_rate", "form_shift", "value_shift")


def checks_of(table: DataFrame, skip: tuple[str, ...] = ()) -> list[Check]:
    """The check of every column but ``skip``, arrays, maps and structs: the declared one, else that of its type; distinct values are estimated."""
    columns = [c for c in table.schema.fields if c.name not in skip and not isinstance(c.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return [replace(DECLARED.get(c.name, check_of(c)), exact_distinct=False) for c in columns]


def column_measures(table: DataFrame, tbl: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """The merged states and histograms of every column but ``skip``, one row per column and load, with their measures.

    Arrays, maps and structs have none. form_shift and value_shift are against load_no - 1, null without it.
    """
    checks = checks_of(table, skip)
    states = merge_states(stored(scan_states(table, tbl, checks, sketch=True), "states"))
    bins = stored(merge_bins(scan_bins(table, tbl, checks)), "bins")  # one row per column, load and bin
    keys = ["tbl", "field_name", "load_no"]
    filled = F.col("n_rows") - F.col("n_blank")
    about = F.hll_sketch_estimate("sketch")
    measured = states.withColumns(
        {
            "null_rate": F.try_divide("n_blank", "n_rows"),
            "bad_rate": F.try_divide(filled - F.col("n_good"), filled),
            "out_rate": F.try_divide(F.col("n_good") - F.col("n_in"), "n_good"),
            "mean": F.try_divide("total", "n_in"),
            "about_distinct": about,
            "distinct_rate": F.least(F.try_divide(about, filled), F.lit(1.0)),
        }
    ).withColumn("deviation", F.sqrt(F.greatest(F.try_divide("squares", "n_in") - F.col("mean") * F.col("mean"), F.lit(0.0))))
    run = Window.partitionBy("tbl", "field_name").orderBy("load_no")  # one row per load
    shares = measured.select("*", *[F.try_divide(F.col(f), filled).alias(f"_{f}") for f in FORM_COLUMNS])
    shift = sum((F.abs(F.col(f"_{f}") - F.lag(f"_{f}").over(run)) for f in FORM_COLUMNS), F.lit(0.0)) / 2
    formed = shares.withColumn("form_shift", F.when(F.lag("load_no").over(run) == F.col("load_no") - 1, shift)).drop(*[f"_{f}" for f in FORM_COLUMNS])
    drawn = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("histogram"))
    for more in (drawn, value_shifts(bins)):
        more = more.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in more.columns if c not in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        formed = formed.join(more, same, "left").drop(*[f"_{k}" for k in keys])
    return formed


def long_measures(measured: DataFrame) -> DataFrame:
    """``column_measures`` as (tbl, field_name, load_no, measure_name, value), as those of ``metrics``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure_name"), F.col(m).cast("double").alias("value")) for m in MEASURES])
    return measured.select("tbl", "field_name", "load_no", F.explode(pairs).alias("m")).select("tbl", "field_name", "load_no", "m.*").where("value is not null")


def _moves(run: Window, limit: float) -> dict[str, Column]:
    """For each of MEASURES whether it moved against the row before; null where it can't be told."""

    def declared(measure: str, otherwise: Column) -> Column:
        rows = [(f, c.limits[measure]) for f, c in DECLARED.items() if measure in c.limits]
        return reduce(lambda w, r: w.when(F.col("field_name") == r[0], F.lit(r[1])), rows, F.when(F.lit(False), F.lit(0.0))).otherwise(otherwise)

    by = {m: F.col(m) - F.lag(m).over(run) for m in ("null_rate", "bad_rate", "out_rate", "mean", "distinct_rate")}
    moves = {m: F.abs(x) > declared(m, F.lit(limit)) for m, x in by.items()}
    spread = F.greatest("deviation", F.lag("deviation").over(run))
    error = F.sqrt(1 / F.col("n_in") + 1 / F.lag("n_in").over(run))  # n_in isn't 0 where there is a mean
    moves["mean"] = F.abs(by["mean"]) > declared("mean", spread * (MEAN_SPREADS + 4 * error) + 1e-9)
    # more rows alone give more values at a lower rate: without a limit of its own the rate counts as moved if it goes the way of the values
    both = F.signum(by["distinct_rate"]) == F.signum((F.col("about_distinct") - F.lag("about_distinct").over(run)).cast("double"))
    moves["distinct_rate"] = moves["distinct_rate"] & (both | F.col("field_name").isin(*[f for f, c in DECLARED.items() if "distinct_rate" in c.limits]))
    return moves | {"form_shift": F.col("form_shift") > limit, "value_shift": F.col("value_shift") - F.col("chance") > limit}


def profile(table: DataFrame, tbl: str, skip: tuple[str, ...] = (), limit: float = 0.06) -> DataFrame:
    """``column_measures`` finished for reading: one row per column and load, with the measures that moved since load_no - 1.

    form_shift and value_shift: half the sum of the differences of the shares of forms and of bins from those of the load before (null without it). moved: rates beyond
    the limits of their check, or ``limit``; means beyond theirs, or a quarter of the deviation and four standard errors; shifts beyond ``limit``, that of values besides what chance
    makes. outside: the measures outside the control limits that the loads before set (see ``control_limits``). changed: whether there is any of either. lowest and highest are texts, of ill-formed cells too; low_whole to high_time are the extremes of the
    well-formed values in the type that the column has or is declared to have, null in the columns of the other types.
    """
    run = Window.partitionBy("tbl", "field_name").orderBy("load_no")
    follows = F.lag("load_no").over(run) == F.col("load_no") - 1
    names = F.array(*[F.when(follows & m, F.lit(n)) for n, m in _moves(run, limit).items()])
    past = run.rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.array(*[F.when(_outside(m, past, 3.0, 3)[3], F.lit(m)) for m in MEASURES])
    return column_measures(table, tbl, skip).withColumns({"moved": F.array_compact(names), "outside": F.array_compact(beyond)}).select(
        "tbl",
        "field_name",
        "load_no",
        "n_rows",
        "n_blank",
        "n_good",
        "n_in",
        *[F.round(c, 6).alias(c) for c in ("null_rate", "bad_rate", "out_rate", "mean", "deviation")],
        "lowest",
        "highest",
        *[f"{side}_{k}" for k in EXTREMES for side in ("low", "high")],
        *FORM_COLUMNS,
        "histogram",
        "about_distinct",
        *[F.round(c, 6).alias(c) for c in ("distinct_rate", "form_shift", "value_shift")],
        "moved",
        "outside",
        ((F.size("moved") > 0) | (F.size("outside") > 0)).alias("changed"),
    )

"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled; each copy has a virtual finish time, the source's tokens up to and with it divided by its weight. In
order of virtual time every source has its share at every point; the mixture is what finishes before the time at which the budget is
spent. Running sums of a source are cut into buckets of its random order, so a source with most rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.bpe import VOCABULARIES
from weftgraph.llm.encode import count_tokens
from weftgraph.session import small_table, stored

ROWS_PER_BUCKET = 20_000


def spent_at(capacity: dict[str, int], weight: dict[str, float], budget: float) -> float:
    """The virtual time at which ``budget`` tokens are spent, if source s gives weight[s] tokens per unit until capacity[s] is used up."""
    ends = sorted((capacity[s] / weight[s], s) for s in capacity)
    spent, rate, now = 0.0, sum(weight[s] for s in capacity), 0.0
    for end, s in ends:
        step = (end - now) * rate
        if spent + step >= budget:
            return now + (budget - spent) / rate
        spent, now, rate = spent + step, end, rate - weight[s]
    return now


def sized(docs: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, source, n_tokens) of documents whose source is listed; stored, for it is read several times."""
    listed = docs.join(targets.where("target_share > 0 and max_repeats > 0").select("source"), "source", "left_semi")
    return stored(count_tokens(listed, ["doc_id", "source"], tokenizer, folder), "sizes")


def mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens, finish): the mixture in order of virtual time.

    ``budget``: tokens of the mixture, by default all tokens of the documents of listed sources. A source gives each document at most
    max_repeats times, the copies in rounds (all documents once, then again, each round shuffled anew). Where a source runs out the others
    go on in proportion to their weights. The result falls short of the budget by less than one document per source, or where all sources run out.
    Sources that aren't listed, null sources and those with a share or max_repeats of 0 give nothing; documents without tokens neither. A source that is
    listed twice is an error. Repeated rows are documents of their own. The targets are collected: one row per source, a table that people write.
    """
    spark = sizes.sparkSession
    wanted = {}
    for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect():
        if r.source in wanted:
            raise ValueError(f"source {r.source} is listed twice")
        wanted[r.source] = r
    filled = sizes.select("doc_id", "source", "n_tokens").where((F.col("n_tokens") > 0) & F.col("source").isin(sorted(wanted)))
    totals = {r.source: r for r in filled.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    columns = "doc_id bigint, source string, copy_no int, n_tokens bigint, finish double"
    if not totals:
        return spark.createDataFrame([], columns)
    weight = {s: wanted[s].target_share for s in totals}
    capacity = {s: totals[s].tokens * wanted[s].max_repeats for s in totals}
    until = spent_at(capacity, weight, sum(r.tokens for r in totals.values()) if budget is None else budget)
    plan = small_table(
        spark,
        [(s, weight[s], totals[s].tokens, min(wanted[s].max_repeats, math.ceil(until * weight[s] / totals[s].tokens)), math.ceil(totals[s].docs / ROWS_PER_BUCKET)) for s in totals],
        "source string, weight double, tokens bigint, rounds int, buckets int",
    )
    copies = filled.join(plan, "source").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.greatest("rounds", F.lit(1)))))
    draw = F.xxhash64("doc_id", "copy_no", F.lit(seed))
    placed = copies.withColumn("draw", draw).withColumn("bucket", F.pmod(F.shiftrightunsigned("draw", 33), "buckets").cast("int"))
    keys = ["source", "copy_no", "bucket"]
    # (source, round, bucket) totals: as many rows as there are documents / ROWS_PER_BUCKET
    sums = placed.groupBy(*keys).agg(F.sum("n_tokens").alias("in_bucket"))
    rounds = Window.partitionBy("source", "copy_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("in_bucket").over(rounds), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys).orderBy("draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("running", F.sum("n_tokens").over(inside)).join(starts, keys)
    used = (F.col("copy_no") - 1) * F.col("tokens") + F.col("start") + F.col("running")
    timed = summed.withColumn("finish", used / F.col("weight")).where(F.col("finish") <= until)
    return timed.select("doc_id", "source", "copy_no", "n_tokens", "finish").orderBy("finish", "source", "doc_id", "copy_no")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target_share, tokens, share reached (0 without documents), different documents and the most copies of one."""
    per = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("copy_no") == 1).alias("docs"), F.max("copy_no").alias("most_copies"))
    total = per.agg(F.sum("tokens").alias("all_tokens"))
    joined = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").join(F.broadcast(total), how="left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "docs", "most_copies")]
    return joined.select("source", "target_share", "max_repeats", *zero, F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("share"))

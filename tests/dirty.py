"""Variants of the smallest test data: tables without rows, and tables with a row of nulls, every row twice and surplus columns of clashing names."""

import os

from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = ("nodes", "nodes2", "rels", "raw_files", "raw_lines", "documents", "subjects", "subject_labels", "mix_targets")
CLASHING = ("h", "t", "side", "kind", "pair", "cells", "salt", "value", "weight", "n_tokens", "ids", "load")


def write(spark, folder, kind):
    if not os.path.isdir(folder):
        for name in TABLES:
            df = spark.read.parquet(f"{DATA}/{name}.parquet")
            if kind == "empty":
                df = df.where("false")
            else:
                nulls = spark.range(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
                twice = df if name in ("raw_files", "mix_targets") else df.unionByName(df)  # their keys are unique by definition
                df = twice.unionByName(nulls)
                df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])
            df.write.parquet(f"{folder}/{name}.parquet")
    return folder

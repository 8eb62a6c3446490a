"""Training and test files: hold-out, cross-validation, leave-one-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_folds(files: DataFrame, k: int) -> DataFrame:
    """file_id, fold (from 1 to k) by a hash of the id, which is the same however the files are stored."""
    return files.select("file_id").distinct().withColumn("fold", (F.pmod(F.xxhash64("file_id"), F.lit(k)) + 1).cast("int"))


def holdout(files: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test files; ``test`` has the ids of the test files."""
    ids = test.select("file_id").distinct()
    return files.join(ids, "file_id", "left_anti"), files.join(ids, "file_id", "left_semi")


def fold_pairs(folds: DataFrame) -> DataFrame:
    """fold, file_id, role: every file once per fold, for testing in its own and for training in the others.

    One row a file and fold; with leave-one-out, where folds are as many as files, use ``leave_one_out``.
    """
    each = folds.select(F.col("fold").alias("_f")).distinct()
    return folds.crossJoin(F.broadcast(each)).select(F.col("_f").alias("fold"), "file_id", F.when(F.col("fold") == F.col("_f"), "test").otherwise("train").alias("role"))


def leave_one_out(stats: DataFrame, sums: list[str]) -> DataFrame:
    """Per file the sums over all other files, as the total less its own: one pass, no pairs of files.

    ``stats`` has file_id and additive statistics.
    """
    total = stats.agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    return stats.crossJoin(F.broadcast(total)).select("file_id", *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in sums])


def cross_validate(files: DataFrame, folds: DataFrame, train: Callable[[DataFrame], object], test: Callable[[object, DataFrame], DataFrame]) -> DataFrame:
    """Results of ``test(model, files)`` of all folds with the column fold; each model is trained on the other folds' files.

    The folds are few; their models are trained one after another.
    """
    out = None
    for k in sorted(r.fold for r in folds.select("fold").distinct().collect()):
        learn, hold = holdout(files, folds.where(F.col("fold") == k))
        part = test(train(learn), hold).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no folds")
    return out

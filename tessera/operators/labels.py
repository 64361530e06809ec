"""Labels, splits, feature pruning, models and their scores."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.operators import aggregates as A


def label_abs(shift: int) -> Column:
    """Close ``shift`` rows ahead over the next open."""
    return F.try_divide(W.future(F.col("close"), shift), W.future(F.col("open"), 1))


def label_mean(shift: int) -> Column:
    """Mean of the next ``shift`` closes over the next open."""
    ahead = W.history().rowsBetween(1, shift)
    mean = F.when(F.count("close").over(ahead) == shift, F.avg("close").over(ahead))
    return F.try_divide(mean, W.future(F.col("open"), 1))


def split(df: DataFrame, valid: str, end: str, start: str | None = None, overlapping: bool = False) -> DataFrame:
    """Tag rows as train, valid or pred by date; ``overlapping`` lets the validation rows include
    all training rows, as (row, part) pairs."""
    dt, valid_day, end_day = F.col("dt"), F.lit(valid).cast("date"), F.lit(end).cast("date")
    if start is not None and not overlapping:
        df = df.where(dt >= F.lit(start).cast("date"))
    if overlapping:
        parts = F.array_compact(
            F.array(
                F.when(dt < valid_day, F.lit("train")),
                F.when(dt < end_day, F.lit("valid")),
                F.when(dt >= end_day, F.lit("pred")),
            )
        )
        return df.withColumn("part", F.explode(parts))
    return df.withColumn("part", F.when(dt < valid_day, "train").when(dt < end_day, "valid").otherwise("pred"))


def prune_features(df: DataFrame, factors: Sequence[str], limit: float = 0.7) -> list[str]:
    """Keep a factor when it correlates at most ``limit`` with every kept one.

    Spark computes the matrix; the greedy pass runs over its k(k+1)/2 cells.
    """
    cells = {(x.a, x.b): x.corr for x in A.corr_matrix(df, factors).collect()}
    kept: list[str] = []
    for f in factors:
        if all(abs(cells.get((k, f)) or 0.0) <= limit for k in kept):
            kept.append(f)
    return kept


def train(df: DataFrame, features: Sequence[str], label: str, depth: int = 7, rounds: int = 100, seed: int = 7):
    """Gradient-boosted trees with early stopping on the rows tagged ``valid``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    rows = df.where(F.col(label).isNotNull() & F.col("part").isin("train", "valid"))
    rows = assembler.transform(rows.withColumn("is_valid", F.col("part") == "valid"))
    trees = GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="pred", maxDepth=depth, maxIter=rounds,
        validationIndicatorCol="is_valid", seed=seed, cacheNodeIds=True, maxMemoryInMB=512,
    )
    return assembler, trees.fit(rows)


def predict(assembler, model, df: DataFrame) -> DataFrame:
    return model.transform(assembler.transform(df)).select("code", "dt", "pred")


def linex_loss(y: Column, p: Column, scale: float = 100.0) -> Column:
    d = y - p
    return F.avg(scale * F.exp(-d) + scale * d - scale)


def predict_next_day(pred: DataFrame) -> DataFrame:
    """Predictions known one row earlier, plus a row for the calendar day after the last one."""
    last = pred.agg(F.max("dt")).scalar()
    ahead = pred.where(F.col("dt") == last).withColumn("dt", F.date_add("dt", 1))
    both = pred.unionByName(ahead)
    return both.withColumn("pred", W.delay(F.col("pred"))).where("pred is not null")


def model_score(pred: DataFrame, bars: DataFrame, shift: int) -> DataFrame:
    labelled = bars.select("code", "dt", label_abs(shift).alias("label"))
    both = pred.join(labelled, ["code", "dt"], "left").where("label is not null and pred is not null")
    miss = F.col("label") - F.col("pred")
    return both.agg(
        F.try_divide(F.avg(miss), F.stddev_samp(miss)).alias("score"),
        F.count_if(F.col("pred") > F.col("label")).alias("over"),
        F.count(F.lit(1)).alias("n"),
    )


def param_grid(df: DataFrame, **choices: Sequence) -> DataFrame:
    """Each row once per combination of the listed parameter values (a constant-size grid)."""
    cells = [F.struct(*[F.lit(v).alias(k) for k, v in zip(choices, combo)]) for combo in product(*choices.values())]
    return df.withColumn("_g", F.explode(F.array(*cells))).select(*df.columns, "_g.*")

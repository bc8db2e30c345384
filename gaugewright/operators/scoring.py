"""Classification metrics from predictions (keys, row_id, y_true, y_pred, proba), all from counts of label pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.operators.order import running


def confusion(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Count of each pair of a true and a predicted label, 0 for pairs of seen labels that never met."""
    counts = predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.select(*keys, F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()
    # labels are few; their pairs are the matrix itself
    grid = seen.withColumnRenamed("label", "y_true").join(seen.withColumnRenamed("label", "y_pred"), keys) if keys else seen.withColumnRenamed("label", "y_true").crossJoin(F.broadcast(seen.withColumnRenamed("label", "y_pred")))
    return grid.join(counts, [*keys, "y_true", "y_pred"], "left").select(*keys, "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall, f1 and support of each label; 0 where there is nothing to divide by."""
    label = F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("h")), F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("h")))).alias("e")
    found = matrix.select(*keys, "n", label).groupBy(*keys, F.col("e.label").alias("label")).agg(F.sum(F.col("n") * F.col("e.t")).alias("support"), F.sum(F.col("n") * F.col("e.p")).alias("predicted"), F.sum(F.col("n") * F.col("e.h")).alias("hits"))
    share = lambda c: F.when(F.col(c) > 0, F.col("hits") / F.nullif(F.col(c), F.lit(0)).cast("double")).otherwise(0.0)
    both = F.col("support") + F.col("predicted")
    return found.withColumns({"precision": share("predicted"), "recall": share("support"), "f1": F.when(both > 0, 2.0 * F.col("hits") / F.nullif(both, F.lit(0))).otherwise(0.0)})


def averaged(matrix: DataFrame, keys: list[str], average: str = "weighted") -> DataFrame:
    """accuracy, precision, recall and f1 over labels: weighted by support, their plain mean (macro) or of all counts together (micro)."""
    classes = per_class(matrix, keys)
    total = F.sum("support").cast("double")
    if average == "weighted":
        mean = lambda c: F.sum(F.col(c) * F.col("support")) / total
    elif average == "macro":
        mean = F.avg
    elif average == "micro":
        mean = lambda c: F.sum("hits") / (total if c != "f1" else (F.sum("support") + F.sum("predicted")) / 2.0)
    else:
        raise ValueError(f"average {average!r}")
    return classes.groupBy(*keys).agg((F.sum("hits") / total).alias("accuracy"), *[mean(c).alias(c) for c in ("precision", "recall", "f1")])


def matthews(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Matthews correlation for any number of labels; 0 where labels or predictions are of one class."""
    classes = per_class(matrix, keys)
    s, c = F.sum("support").cast("double"), F.sum("hits").cast("double")
    tp, t2, p2 = (F.sum(F.col(a).cast("double") * F.col(b)) for a, b in (("support", "predicted"), ("support", "support"), ("predicted", "predicted")))
    bottom = F.sqrt((s * s - p2) * (s * s - t2))
    return classes.groupBy(*keys).agg(F.when(bottom > 0, (c * s - tp) / F.nullif(bottom, F.lit(0.0))).otherwise(0.0).alias("mcc"))


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve of (keys, positive 0/1, score), from counts by score; null with one class only, rows without a score left out."""
    counts = scored.where("score is not null").groupBy(*keys, "score").agg(F.sum("positive").cast("double").alias("pos__"), F.sum(1 - F.col("positive")).cast("double").alias("neg__"))
    pos, neg = F.sum("pos__"), F.sum("neg__")
    # pairs in which the positive row scores higher, and half of the ties
    area = F.sum(F.col("pos__") * (F.col("below__") + F.col("neg__") / 2)) / F.nullif(pos * neg, F.lit(0.0))
    return running(counts, keys, "score", "neg__").groupBy(*keys).agg(area.alias("roc_auc"), pos.cast("long").alias("n_positive"))


def auc_one_vs_rest(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Area of each label against the others from (keys, y_true, label, score), weighted by support; null if a label has none."""
    areas = auc(scored.withColumn("positive", (F.col("y_true") == F.col("label")).cast("int")), [*keys, "label"])
    return areas.groupBy(*keys).agg(F.when(F.count("roc_auc") == F.count(F.lit(1)), F.sum(F.col("roc_auc") * F.col("n_positive")) / F.sum("n_positive")).alias("roc_auc"))


def fold_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted metrics, Matthews correlation, sample and class counts of each key."""
    matrix = confusion(predictions, keys)
    sizes = matrix.groupBy(*keys).agg(F.sum("n").alias("n_samples"), F.countDistinct("y_true").alias("n_classes"))
    return averaged(matrix, keys).join(matthews(matrix, keys), keys).join(sizes, keys)


def class_shares(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Count and percentage of each label within a key."""
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    return counts.withColumn("pct", 100.0 * F.col("n") / whole)

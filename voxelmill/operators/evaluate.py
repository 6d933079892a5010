"""Scores of predicted masks against true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import grids
from .elementwise import finite
from .morphology import component_summary, label_components
from .stats import moments


def confusion(pred: DataFrame, truth: DataFrame, case: list[str]) -> DataFrame:
    """tp, fp, fn of sparse masks (case, vid) by a full outer join."""
    p = pred.select(*case, "vid").distinct().withColumn("p", F.lit(1))
    t = truth.select(*case, "vid").distinct().withColumn("t", F.lit(1))
    both = p.join(t, [*case, "vid"], "full_outer")
    has = lambda c: F.col(c).isNotNull()
    return both.groupBy(*case).agg(
        F.count_if(has("p") & has("t")).alias("tp"), F.count_if(has("p") & ~has("t")).alias("fp"), F.count_if(~has("p") & has("t")).alias("fn")
    )


def difference_map(pred: DataFrame, truth: DataFrame, case: list[str]) -> DataFrame:
    """1 where both have a voxel, 2 where only the prediction has it, 3 where only the truth."""
    p = pred.select(*case, "vid").distinct().withColumn("p", F.lit(1))
    t = truth.select(*case, "vid").distinct().withColumn("t", F.lit(1))
    kind = F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1).when(F.col("p").isNotNull(), 2).otherwise(3)
    return p.join(t, [*case, "vid"], "full_outer").select(*case, "vid", kind.alias("kind"))


def scores(counts: DataFrame) -> DataFrame:
    """Dice, Jaccard, precision, recall and volume ratio of tp, fp, fn; two empty masks agree fully, no truth gives an infinite ratio."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    none = (tp + fp + fn) == 0
    part = lambda a, b, empty: F.when(b > 0, a / b).otherwise(F.lit(empty))
    return counts.withColumns(
        {
            "pred_voxels": tp + fp,
            "truth_voxels": tp + fn,
            "dice": F.when(none, 1.0).otherwise(part(2 * tp, 2 * tp + fp + fn, 0.0)),
            "jaccard": F.when(none, 1.0).otherwise(part(tp, tp + fp + fn, 0.0)),
            "precision": part(tp, tp + fp, 0.0),
            "recall": part(tp, tp + fn, 0.0),
            "volume_ratio": part(tp + fp, tp + fn, float("inf")),
        }
    )


def masked_correlation(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pearson r of a and b; null where either is constant."""
    g = pairs.groupBy(*by).agg(F.covar_pop("a", "b").alias("c"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    return g.select(*by, F.try_divide(F.col("c"), F.col("sa") * F.col("sb")).alias("r"))


def finite_mean(c: Column) -> Column:
    return F.coalesce(F.avg(F.when(finite(c), c)), F.lit(float("nan")))


def report(metrics: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *(finite_mean(F.col(c)).alias(f"mean_{c}") for c in columns)).orderBy(*by)


def write_report(metrics: DataFrame, folder: str, by: list[str], columns: list[str], sweep: DataFrame | None = None) -> None:
    """Writes results (and threshold_sweep) as CSV with a header and summary as a Markdown table of the report, each a folder under ``folder``."""
    tables = {"results": metrics} | ({"threshold_sweep": sweep} if sweep is not None else {})
    for name, t in tables.items():
        t.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    summary_lines(report(metrics, by, columns)).coalesce(1).write.mode("overwrite").text(f"{folder}/summary")  # a line for each group


def summary_lines(table: DataFrame) -> DataFrame:
    """One column ``line``: a Markdown table with four decimals for fractions, in the order of its first columns."""
    cell = lambda f: F.format_string("%.4f", F.col(f.name)) if f.dataType.simpleString() in ("double", "float") else F.col(f.name).cast("string")
    rows = table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(cell(f), F.lit("")) for f in table.schema.fields)), F.lit(" |")).alias("line"), *table.columns)
    head = ["| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    top = table.sparkSession.createDataFrame([(k, h) for k, h in enumerate(head)], "k int, line string")
    body = rows.withColumn("k", F.lit(2)).select("k", "line")
    return top.unionByName(body).orderBy("k", "line").select("line")


def threshold_sweep(probability: DataFrame, truth: DataFrame, thresholds: list[float], case: list[str]) -> DataFrame:
    """Scores of each case at each threshold. Cells are counted once by how many thresholds they reach, not once a threshold."""
    t = truth.select(*case, "vid").distinct().withColumn("t", F.lit(1))
    levels = F.array(*map(F.lit, sorted(thresholds)))
    cells = probability.select(*case, "vid", "p").join(t, [*case, "vid"], "full_outer")
    reached = F.size(F.filter(levels, lambda v: v <= F.col("p")))
    counts = cells.groupBy(*case, F.coalesce(reached, F.lit(0)).alias("k"), F.col("t").isNotNull().alias("t")).agg(F.count(F.lit(1)).alias("n"))
    at = counts.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(len(thresholds)))))
    over = F.col("k") >= F.col("i")
    sums = at.groupBy(*case, F.get(levels, F.col("i") - 1).alias("threshold")).agg(
        F.coalesce(F.sum(F.when(over & F.col("t"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(over & ~F.col("t"), F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~over & F.col("t"), F.col("n"))), F.lit(0)).alias("fn"),
    )
    return scores(sums)


def best_threshold(sweep: DataFrame, by: list[str]) -> DataFrame:
    """The threshold of the highest mean Dice; of equal ones the lowest."""
    mean = sweep.groupBy(*by, "threshold").agg(F.avg("dice").alias("mean_dice"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean_dice"), "threshold"))
    return mean.withColumn("r", rank).where("r = 1").drop("r")


def extremes(metrics: DataFrame, by: list[str], order: str) -> DataFrame:
    """Best and worst case of each group; of equal ones the first."""
    w = Window.partitionBy(*by)
    best = F.row_number().over(w.orderBy(F.desc("dice"), order)) == 1
    worst = F.row_number().over(w.orderBy("dice", order)) == 1
    out = metrics.withColumns({"is_best": best, "is_worst": worst})
    return out.where("is_best or is_worst")


def gap_analysis(metrics: DataFrame, case: list[str], reference: str, tolerance: float = 0.01) -> DataFrame:
    """Each mode's Dice against the reference mode of the same case, and whether it is within the tolerance or better."""
    ref = metrics.where(F.col("mode") == reference).select(*case, F.col("dice").alias("reference_dice"))
    out = metrics.where(F.col("mode") != reference).join(ref, case)
    return out.withColumn("gap", F.col("dice") - F.col("reference_dice")).withColumn("reached", F.col("gap") >= -tolerance)


def mean_probability(maps: DataFrame, threshold: float) -> DataFrame:
    """Voxels whose mean over the maps reaches the threshold."""
    return maps.groupBy("volume_id", "vid").agg(F.avg("p").alias("p")).where(F.col("p") >= threshold)


def majority(masks: list[DataFrame], votes: int) -> DataFrame:
    """Rows that at least ``votes`` masks have."""
    stacked = masks[0].distinct()
    for m in masks[1:]:
        stacked = stacked.unionAll(m.distinct())
    return stacked.groupBy(*stacked.columns).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= votes).drop("_n")


def candidate_report(predictions: DataFrame, prediction_meta: DataFrame, truth: DataFrame, truth_meta: DataFrame, reference: str | None = None, tolerance: float = 0.01) -> DataFrame:
    """One row for each case and mode: its scores on the truth's grid with what tells why they differ.

    predictions: case, mode, x, y, z, sparse on grids of their own (prediction_meta: case, mode, nx, ny, nz, affine); truth: case, x, y, z on those of
    truth_meta (case, nx, ny, nz, affine). Predictions are resampled to the truth's grid; then come tp, fp, fn and the scores, the number of components with the largest and the
    five largest sizes, centroid (cx, cy, cz) and box (x0 to z1, ends exclusive) in voxels, the share of the truth's field of view that the prediction's covers with a
    warning, and with a ``reference`` mode the Dice gap to it and whether that is within the tolerance. Modes that predict nothing have null figures and no components.
    """
    name = F.concat_ws("#", F.col("case").cast("string"), F.col("mode")).alias("volume_id")
    candidates = written(prediction_meta.select(name, "case", "mode", *grids.DIMS, "affine"))
    target = written(candidates.select("volume_id", "case").join(truth_meta, "case").select("volume_id", *grids.DIMS, "affine"))
    own = predictions.select(name, "x", "y", "z").distinct()
    found = written(grids.resample_mask(own, candidates.select("volume_id", *grids.DIMS, "affine"), target))
    true = candidates.select("volume_id", "case").join(truth.select("case", "x", "y", "z"), "case").drop("case")
    place = F.struct("x", "y", "z").alias("vid")
    counts = confusion(found.select("volume_id", place), true.select("volume_id", place), ["volume_id"])
    every = candidates.select("volume_id", "case", "mode").join(counts, "volume_id", "left").fillna(0, ["tp", "fp", "fn"])
    comps = component_summary(label_components(found, target))
    middle = moments(found).select("volume_id", "cx", "cy", "cz")
    ends = grids.boxes(found.withColumn("value", F.lit(1)), target).drop("empty")
    views = grids.view_overlap(candidates, target, ["volume_id"]).select("volume_id", F.col("overlap").alias("fov_overlap"), "warning")
    out = scores(every)
    for more in (comps, middle, ends, views):
        out = out.join(more, "volume_id", "left")
    out = out.drop("volume_id").fillna(0, ["components", "largest"])
    if reference is None:
        return out
    gaps = gap_analysis(out.select("case", "mode", "dice"), ["case"], reference, tolerance).select("case", "mode", "gap", "reached")
    return out.join(gaps, ["case", "mode"], "left")

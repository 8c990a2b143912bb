"""Scoring findings against ground truth: confusion counts, ratios, range and pair matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, places: int | None = 4) -> Column:
    """a / b, 0 where b is not positive."""
    r = F.when(b <= 0, F.lit(0.0)).otherwise(a / b)
    return F.round(r, places) if places is not None else r


def with_metrics(counts: DataFrame, places: int | None = 4, accuracy: bool = False) -> DataFrame:
    """Adds precision, recall and f1 (and accuracy) to tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumn("precision", ratio(tp, tp + fp, places)).withColumn("recall", ratio(tp, tp + fn, places)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn, places))
    return out.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn, places)) if accuracy else out


def confusion(found: DataFrame, truth: DataFrame, by: str, values: tuple[str, ...]) -> DataFrame:
    """tp, fp, fn, tn, unexpected by `by` (a mode or tier) and family over sets of distinct cases.

    found: case_id, family and `by`; truth: case_id, family, vulnerable. A detected case that is not in its family's
    truth is unexpected and counts as fp. Found cases are made distinct before they meet the truth (map-side combine);
    the truth is exploded to the given values within its rows.
    """
    hit = found.select(by, "family", "case_id").distinct().withColumn("_hit", F.lit(True))
    cases = truth.select("family", "case_id", "vulnerable", F.explode(F.array(*[F.lit(v) for v in values])).alias(by))
    both = hit.join(cases, [by, "family", "case_id"], "full_outer")
    h, v = F.col("_hit").isNotNull(), F.col("vulnerable")
    return both.groupBy(by, "family").agg(
        F.count_if(h & v).alias("tp"), F.count_if(h & (~F.coalesce(v, F.lit(False)))).alias("fp"), F.count_if(~h & v).alias("fn"), F.count_if(~h & ~v).alias("tn"), F.count_if(h & v.isNull()).alias("unexpected")
    )


def micro(counts: DataFrame, *by: str) -> DataFrame:
    """Sums over families, then ratios."""
    total = counts.groupBy(*by) if by else counts.groupBy()
    return with_metrics(total.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))


def fp_reduction(counts: DataFrame) -> DataFrame:
    """Percent of false positives that a mode saves against mode `all`, by family; 0 where there were none. One pass: the base is a window-free conditional sum joined back as a pivot."""
    wide = counts.groupBy("family").agg(*[F.sum(F.when(F.col("mode") == m, F.col("fp"))).alias(a) for m, a in (("all", "fp_all"), ("visible", "fp_visible"), ("high-confidence", "fp_high"))])
    cut = lambda c: F.round(F.when(F.col("fp_all") <= 0, 0.0).otherwise((F.col("fp_all") - F.coalesce(c, F.lit(0))) * 100.0 / F.col("fp_all")), 2)
    return wide.select("family", "fp_all", cut(F.col("fp_visible")).alias("visible_reduction"), cut(F.col("fp_high")).alias("high_reduction"))


def kept_confusion(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Confusion of several status columns against `vulnerable` in one pass: a row is kept when its status is not suppressed; rows without truth take no part."""
    stacked = rows.filter(F.col("vulnerable").isNotNull()).select("vulnerable", F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(c).alias("st")) for n, c in columns.items()])).alias("x"))
    kept = ~F.col("x.st").eqNullSafe(F.lit("suppressed"))
    counts = stacked.groupBy(F.col("x.what").alias("column_name")).agg(F.count_if(kept & F.col("vulnerable")).alias("tp"), F.count_if(kept & ~F.col("vulnerable")).alias("fp"), F.count_if(~kept & F.col("vulnerable")).alias("fn"), F.count_if(~kept & ~F.col("vulnerable")).alias("tn"))
    return with_metrics(counts)


def pair_scores(found: DataFrame, pairs: DataFrame, official: bool) -> DataFrame:
    """Vulnerable/fixed file pairs by cwe: a hit in the vulnerable file is tp (else fn), one in the fixed file fp (else tn); a pair without fix adds neither. official: the hit's scope must be the pair's."""
    hit = found.select(F.col("file_path").alias("_f"), F.col("cwe").alias("_c"), F.col("scope").alias("_s")).distinct()

    def seen(side: str) -> DataFrame:
        on = (F.col(side) == F.col("_f")) & (F.col("cwe") == F.col("_c"))
        if official:
            on = on & (F.col("scope") == F.col("_s"))
        return pairs.join(hit, on, "left_semi").select("case_id").withColumn(f"_{side}", F.lit(True))

    both = pairs.join(seen("vul_file"), "case_id", "left").join(seen("fix_file"), "case_id", "left")
    v, x, there = F.col("_vul_file").isNotNull(), F.col("_fix_file").isNotNull(), F.col("fix_file").isNotNull()
    return with_metrics(both.groupBy("cwe").agg(F.count_if(v).alias("tp"), F.count_if(there & x).alias("fp"), F.count_if(~v).alias("fn"), F.count_if(there & ~x).alias("tn")))

"""Classification metrics as aggregations (no driver-side loops).

Multi-class metrics come from the 3x3 confusion counts computed in one pass;
threshold metrics from conditional counts; PR/ROC curves, AUC and the best-F1
threshold from per-score counts followed by a distributed running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.functions.columns import r6
from fraudlens.operators.cumulative import running_sum
from fraudlens.schema import FRAUD, LABEL_ORDER
from fraudlens.session import written_once


def _cnt(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _key(a: str, p: str) -> str:
    return f"__c_{LABEL_ORDER.index(a)}_{LABEL_ORDER.index(p)}"


def confusion_counts(df: DataFrame, actual: str = "target", predicted: str = "predicted_status") -> DataFrame:
    """One row holding the 9 cells of the confusion matrix (fixed class domain)."""
    return df.agg(*[_cnt((F.col(actual) == a) & (F.col(predicted) == p)).alias(_key(a, p))
                    for a in LABEL_ORDER for p in LABEL_ORDER])


def confusion_matrix(df: DataFrame, actual: str = "target", predicted: str = "predicted_status") -> DataFrame:
    """(actual, predicted, nombre) for every class pair, zero-filled."""
    cells = [(a, p) for a in LABEL_ORDER for p in LABEL_ORDER]
    stack = ", ".join(f"'{a}', '{p}', `{_key(a, p)}`" for a, p in cells)
    return confusion_counts(df, actual, predicted).selectExpr(
        f"stack({len(cells)}, {stack}) as (reel, predit, nombre)")


def _per_class_exprs():
    """Column expressions over a confusion_counts row."""
    out = {}
    for c in LABEL_ORDER:
        tp = F.col(_key(c, c))
        support = sum((F.col(_key(c, p)) for p in LABEL_ORDER), F.lit(0))
        predicted = sum((F.col(_key(a, c)) for a in LABEL_ORDER), F.lit(0))
        prec = F.coalesce(F.try_divide(tp.cast("double"), predicted.cast("double")), F.lit(0.0))
        rec = F.coalesce(F.try_divide(tp.cast("double"), support.cast("double")), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
        out[c] = (prec, rec, f1, support)
    return out


def classification_report(df: DataFrame, actual: str = "target", predicted: str = "predicted_status") -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted
    averages (zero division -> 0). The accuracy row carries the accuracy in
    f1_score and the total support."""
    cc = confusion_counts(df, actual, predicted)
    pc = _per_class_exprs()
    total = sum((pc[c][3] for c in LABEL_ORDER), F.lit(0))
    correct = sum((F.col(_key(c, c)) for c in LABEL_ORDER), F.lit(0))
    acc = F.coalesce(F.try_divide(correct.cast("double"), total.cast("double")), F.lit(0.0))
    k = len(LABEL_ORDER)
    cols = {}
    for i, c in enumerate(LABEL_ORDER):
        p, r, f, s = pc[c]
        cols.update({f"p{i}": p, f"r{i}": r, f"f{i}": f, f"s{i}": s.cast("double")})
    cols["acc"] = acc
    cols["tot"] = total.cast("double")
    for m, j in (("p", 0), ("r", 1), ("f", 2)):
        cols[f"{m}_macro"] = sum((pc[c][j] for c in LABEL_ORDER), F.lit(0.0)) / k
        cols[f"{m}_w"] = F.coalesce(F.try_divide(sum((pc[c][j] * pc[c][3] for c in LABEL_ORDER), F.lit(0.0)),
                                                 total.cast("double")), F.lit(0.0))
    wide = cc.select(*[v.alias(n) for n, v in cols.items()])
    rows = [f"'{c}', p{i}, r{i}, f{i}, s{i}" for i, c in enumerate(LABEL_ORDER)]
    rows.append("'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, tot")
    rows.append("'macro avg', p_macro, r_macro, f_macro, tot")
    rows.append("'weighted avg', p_w, r_w, f_w, tot")
    out = wide.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) as (label, precision, recall, f1_score, support)")
    return out.select("label", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1_score", "support")])


def _model_metric_columns() -> list[Column]:
    """The five comparison metrics of a confusion_counts row."""
    pc = _per_class_exprs()
    k = len(LABEL_ORDER)
    total = sum((pc[c][3] for c in LABEL_ORDER), F.lit(0))
    correct = sum((F.col(_key(c, c)) for c in LABEL_ORDER), F.lit(0))
    return [
        r6(F.coalesce(F.try_divide(correct.cast("double"), total.cast("double")), F.lit(0.0))).alias("accuracy"),
        r6(sum((pc[c][0] for c in LABEL_ORDER), F.lit(0.0)) / k).alias("precision_macro"),
        r6(sum((pc[c][1] for c in LABEL_ORDER), F.lit(0.0)) / k).alias("recall_macro"),
        r6(sum((pc[c][2] for c in LABEL_ORDER), F.lit(0.0)) / k).alias("f1_macro"),
        r6(pc[FRAUD][1]).alias("recall_fraude")]


def model_metrics(df: DataFrame, actual: str = "target", predicted: str = "predicted_status") -> DataFrame:
    """accuracy, macro precision / recall / F1 and fraud recall, one row."""
    return confusion_counts(df, actual, predicted).select(*_model_metric_columns())


def compare_verdicts(df: DataFrame, candidates: dict[str, Column], actual: str = "target") -> DataFrame:
    """The comparison table (model, fit_order, metrics) of verdict columns over the
    same rows, named in fit order. One scan: a row becomes one small pair per
    candidate, and partial aggregation leaves a row a candidate and task."""
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("fit_order"), c.alias("verdict"))
                      for i, (n, c) in enumerate(candidates.items())])
    each = df.select(F.col(actual).alias("actual"), F.explode(pairs).alias("x")).select("actual", "x.*")
    return confusion_counts(each.groupBy("model", "fit_order"), "actual", "verdict").select(
        "model", "fit_order", *_model_metric_columns())


COMPARISON_METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "recall_fraude"]
#: Metrics are compared at this precision, so near-ties keep the fit order.
RANK_DECIMALS = 4


def comparison_view(table: DataFrame, models: list[str] | None = None) -> DataFrame:
    """A comparison table as it is shown: ranked by fraud recall at four decimals
    (ties keep fit order), metrics also in percent at one decimal (half up), and how
    many models were compared. ``models`` chooses rows (none or empty: all); ranks and
    the number of models are those of the whole table, which has one row a model."""
    w = Window.orderBy(F.round("recall_fraude", RANK_DECIMALS).desc(), F.asc("fit_order"))
    whole = Window.partitionBy(F.lit(0))
    shown = table.withColumn("rang", F.row_number().over(w)) \
        .withColumn("n_modeles", F.count(F.lit(1)).over(whole)) \
        .withColumns({f"{m}_pct": F.round((F.col(m) * 100).cast("decimal(12,4)"), 1).cast("double")
                      for m in COMPARISON_METRICS})
    return shown.where(F.col("model").isin(models)) if models else shown


# --------------------------------------------------------------------------- binary, threshold based
def _binary(df: DataFrame, score: str, threshold: float, label: str = "target") -> tuple[Column, Column]:
    y = F.col(label).eqNullSafe(FRAUD)
    pred = F.coalesce(F.col(score) >= F.lit(float(threshold)), F.lit(False))
    return y, pred


def threshold_metrics(df: DataFrame, threshold: float, score: str = "p_fraud", label: str = "target") -> DataFrame:
    """precision, recall, F1, missed frauds (FN) and false alerts (FP) at p >= t."""
    y, pred = _binary(df, score, threshold, label)
    c = df.agg(F.count_if(y & pred).alias("tp"), F.count_if(~y & pred).alias("fp"),
               F.count_if(y & ~pred).alias("fn"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"),
                                 (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    return c.select(F.lit(float(threshold)).alias("seuil"), r6(prec).alias("precision"), r6(rec).alias("rappel"),
                    r6(f1).alias("f1"), F.col("fn").alias("faux_negatifs"), F.col("fp").alias("faux_positifs"))


def threshold_confusion(df: DataFrame, threshold: float, score: str = "p_fraud", label: str = "target") -> DataFrame:
    """2x2 confusion at p >= t: (reel, predit, nombre) with 0 = not fraud, 1 = fraud."""
    y, pred = _binary(df, score, threshold, label)
    c = df.agg(*[F.count_if((y if a else ~y) & (pred if p else ~pred)).alias(f"c{a}{p}")
                 for a in (0, 1) for p in (0, 1)])
    return c.selectExpr("stack(4, 0, 0, c00, 0, 1, c01, 1, 0, c10, 1, 1, c11) as (reel, predit, nombre)")


def score_counts(df: DataFrame, score: str = "p_fraud", label: str = "target") -> DataFrame:
    """(score, pos, neg) per distinct score: the only table curves need."""
    y = F.col(label).eqNullSafe(FRAUD)
    return (df.where(F.col(score).isNotNull())
            .groupBy(F.col(score).alias("score"))
            .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))


def curve_table(df: DataFrame, score: str = "p_fraud", label: str = "target") -> DataFrame:
    """Per distinct score s: tp / fp = positives / negatives with score >= s,
    plus the totals P and N (scalar subqueries, evaluated once)."""
    # The per-score table (one row per distinct score) feeds the cut points,
    # the bucket totals, the running sums and P / N: written once instead of
    # rescanning the input for each.
    sc = written_once(score_counts(df, score, label), "score_counts")
    cum = running_sum(sc, "score", ["pos", "neg"], descending=True)
    tot_p = sc.select(F.sum("pos")).scalar()
    tot_n = sc.select(F.sum("neg")).scalar()
    return cum.select("score", "pos", "neg", F.col("pos_cum").alias("tp"), F.col("neg_cum").alias("fp"),
                      tot_p.alias("P"), tot_n.alias("N"))


def pr_curve(df: DataFrame, score: str = "p_fraud", label: str = "target") -> DataFrame:
    """precision / recall at every distinct score, plus the end point (recall 0,
    precision 1, no threshold)."""
    ct = curve_table(df, score, label)
    pts = ct.select(F.col("score").alias("seuil"),
                    r6(F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    r6(F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double")),
                                  F.lit(0.0))).alias("rappel"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("seuil"), F.lit(1.0).alias("precision"),
                                          F.lit(0.0).alias("rappel"))
    return pts.unionByName(end)


def roc_curve(df: DataFrame, score: str = "p_fraud", label: str = "target") -> DataFrame:
    """(fpr, tpr) at every distinct score, plus the origin (no threshold)."""
    ct = curve_table(df, score, label)
    pts = ct.select(F.col("score").alias("seuil"),
                    r6(F.try_divide(F.col("fp").cast("double"), F.col("N").cast("double"))).alias("fpr"),
                    r6(F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double"))).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("seuil"), F.lit(0.0).alias("fpr"),
                                            F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def roc_corners(df: DataFrame, score: str = "p_fraud", label: str = "target") -> DataFrame:
    """The ROC curve without the points inside its straight runs: what it bounds, and its AUC, stay the same.

    A point goes if the step to it and the step from it have one direction. The step from the last point of a score
    range is the first step of the next range: one row a range is exchanged, no window spans the table."""
    ct = curve_table(df, score, label).select("score", "pos", "neg", "tp", "fp", "P", "N")
    # the ranges of the running sums again, from the written table of points
    points = written_once(ct.repartitionByRange(F.desc("score")).withColumn("__part", F.spark_partition_id()), "curve")
    inside = Window.partitionBy("__part").orderBy(F.desc("score"))
    firsts = points.groupBy("__part").agg(F.max_by(F.struct("pos", "neg"), "score").alias("__first"))
    after = firsts.select("__part", F.lead("__first").over(Window.orderBy("__part")).alias("__after"))  # a row a range
    step = F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("__after"))
    kept = points.join(F.broadcast(after), "__part").withColumn("__next", step)
    wide = "decimal(19,0)"
    straight = F.col("pos").cast(wide) * F.col("__next.neg").cast(wide) == F.col("neg").cast(wide) * F.col("__next.pos").cast(wide)
    kept = kept.where(F.col("__next").isNull() | ~straight)
    pts = kept.select(F.col("score").alias("seuil"),
                      r6(F.try_divide(F.col("fp").cast("double"), F.col("N").cast("double"))).alias("fpr"),
                      r6(F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double"))).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("seuil"), F.lit(0.0).alias("fpr"),
                                            F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def roc_auc(df: DataFrame, score: str = "p_fraud", label: str = "target") -> DataFrame:
    """Trapezoidal area under the ROC curve (ties form one segment)."""
    ct = curve_table(df, score, label)
    # in doubles: products of counts leave the range of a long from 2e9 positives and negatives on
    seg = F.col("neg").cast("double") * (2.0 * (F.col("tp") - F.col("pos")) + F.col("pos"))
    return ct.agg(r6(F.try_divide(F.sum(seg), 2.0 * F.first("P") * F.first("N"))).alias("auc"))


def best_f1_threshold(df: DataFrame, score: str = "p_fraud", label: str = "target",
                      default: float = 0.5) -> DataFrame:
    """Threshold with the highest F1 among the distinct scores; ties go to the
    lowest threshold. Without positive rows every F1 is 0 and the lowest score is
    returned; only without any score is it the default threshold."""
    ct = curve_table(df, score, label)
    f1 = F.try_divide((2 * F.col("tp")).cast("double"), (F.col("tp") + F.col("fp") + F.col("P")).cast("double"))
    pts = ct.select("score", f1.alias("f1"),
                    F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
                    F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double")).alias("rappel"))
    best = pts.agg(F.min_by(F.struct("score", "f1", "precision", "rappel"),
                            F.struct((-F.col("f1")).alias("k1"), F.col("score").alias("k2"))).alias("b"))
    return best.select(F.coalesce(F.col("b.score"), F.lit(float(default))).alias("seuil"),
                       r6(F.col("b.f1")).alias("f1"), r6(F.col("b.precision")).alias("precision"),
                       r6(F.col("b.rappel")).alias("rappel"))

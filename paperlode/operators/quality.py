"""Classification quality: metrics, confusion, reports, errors and histograms."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions.basic import not_blank, strip
from paperlode.operators.ranks import position_block, row_numbers

IGNORED_LABEL = -100


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _counts(pred: str, gold: str) -> dict[str, Column]:
    p, g = F.col(pred), F.col(gold)
    return {
        "tp": F.count_if((p == 1) & (g == 1)),
        "fp": F.count_if((p == 1) & (g == 0)),
        "fn": F.count_if((p == 0) & (g == 1)),
        "tn": F.count_if((p == 0) & (g == 0)),
    }


def binary_metrics(
    predictions: DataFrame, by: list[str] | None = None, pred: str = "predicted_label", gold: str = "true_label"
) -> DataFrame:
    """Accuracy, precision, recall and F1 in one pass; pairs without a gold label are left out."""
    rows = predictions.filter(F.col(gold) != IGNORED_LABEL)
    counted = rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in _counts(pred, gold).items()]
    )
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.select(
        *(by or []),
        "n",
        F.round(_ratio(F.col("tp") + F.col("tn"), F.col("n")), 6).alias("accuracy"),
        F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"),
        F.round(_ratio(2 * precision * recall, precision + recall), 6).alias("f1"),
    )


def confusion_matrix(predictions: DataFrame, pred: str = "predicted_label", gold: str = "true_label") -> DataFrame:
    """One row per true label, one column per predicted label."""
    counts = [F.count_if(F.col(pred) == v).alias(f"predicted_{v}") for v in (0, 1)]
    return predictions.groupBy(gold).agg(*counts)


def class_report(predictions: DataFrame, pred: str = "predicted_label", gold: str = "true_label") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means."""
    c = predictions.agg(*[v.alias(k) for k, v in _counts(pred, gold).items()])
    one = c.select(F.explode(F.array(
        F.struct(F.lit("0").alias("label"), F.col("tn").alias("hit"), (F.col("tn") + F.col("fn")).alias("said"), (F.col("tn") + F.col("fp")).alias("support")),
        F.struct(F.lit("1").alias("label"), F.col("tp").alias("hit"), (F.col("tp") + F.col("fp")).alias("said"), (F.col("tp") + F.col("fn")).alias("support")),
    )).alias("r")).select("r.*")
    p, r = _ratio(F.col("hit"), F.col("said")), _ratio(F.col("hit"), F.col("support"))
    classes = one.select(
        "label", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), "support"
    )
    names = ["precision", "recall", "f1"]
    means = classes.agg(
        F.sum("support").alias("support"),
        *[F.avg(n).alias("m_" + n) for n in names],
        *[_ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias("w_" + n) for n in names],
    )
    macro = means.select(F.lit("macro avg").alias("label"), *[F.col("m_" + n).alias(n) for n in names], "support")
    weighted = means.select(F.lit("weighted avg").alias("label"), *[F.col("w_" + n).alias(n) for n in names], "support")
    return classes.unionByName(macro).unionByName(weighted).select(
        "label", *[F.round(n, 6).alias(n) for n in names], F.col("support").cast("long").alias("support")
    )


def accuracy_by_paper(
    predictions: DataFrame, key: str = "paper_name", pred: str = "predicted_label", gold: str = "true_label"
) -> DataFrame:
    right = F.count_if(F.col(pred) == F.col(gold))
    return predictions.groupBy(key).agg(
        right.alias("correct"), F.count(F.lit(1)).alias("total"), F.round(right / F.count(F.lit(1)), 6).alias("accuracy")
    )


def rows_by_paper(
    predictions: DataFrame, order: str, columns: list[str], key: str = "paper_name", pred: str = "predicted_label", gold: str = "true_label",
    part_rows: int = 1000,
) -> DataFrame:
    """Per-paper accuracy with the paper's rows nested below it: (key, part, rows, correct, total, accuracy).

    Rows lie in the order of the numeric column ``order``. A paper of more than ``part_rows`` rows takes several parts, so no
    cell grows with the paper; each part carries the figures of the whole paper.
    """
    numbered = row_numbers(predictions.select(key, order, *columns), [key], {"place": position_block(F.col(order))}, [F.col(order)], "__n")
    part = F.floor(F.col("__n") / part_rows).cast("bigint")
    nested = numbered.groupBy(key, part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("__n", order, *columns))).alias("rows"))
    shown = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in [order, *columns]]))
    figures = accuracy_by_paper(predictions, key, pred, gold).withColumnRenamed(key, "__key")
    return nested.withColumn("rows", shown).join(figures, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def prediction_statistics(
    predictions: DataFrame, key: str = "paper_name", pred: str = "predicted_label", gold: str = "true_label"
) -> DataFrame:
    """Size, accuracy and share of positives of a prediction set."""
    n = F.count(F.lit(1))
    right, positive = F.count_if(F.col(pred) == F.col(gold)), F.count_if(F.col(pred) == 1)
    return predictions.agg(
        F.countDistinct(key).alias("papers"),
        n.alias("sentences"),
        right.alias("correct"),
        F.round(_ratio(right, n), 6).alias("accuracy"),
        positive.alias("positives"),
        F.round(_ratio(positive, n), 6).alias("positive_ratio"),
    )


def error_counts(predictions: DataFrame, by: list[str] | None = None, pred: str = "predicted_label", gold: str = "true_label") -> DataFrame:
    c = _counts(pred, gold)
    return predictions.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(pred) == F.col(gold)).alias("correct"),
        c["fp"].alias("false_positives"),
        c["fn"].alias("false_negatives"),
    )


def tag_errors(predictions: DataFrame, pred: str = "predicted_label", gold: str = "true_label") -> DataFrame:
    """Comparison rows: 1-based sentence number, correctness and error type."""
    p, g = F.col(pred), F.col(gold)
    kind = F.when(p == g, F.lit(None).cast("string")).when(p == 1, "False Positive").otherwise("False Negative")
    return predictions.withColumns(
        {"sentence_no": F.col("sentence_index") + 1, "is_correct": p == g, "error_type": kind}
    )


def relabel_differences(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose new label is 0 or 1 and differs from the old one."""
    found = new.filter(F.col("new_label").isin(0, 1)).select(*keys, "new_label")
    return old.withColumn("old_label", F.coalesce(F.col("label"), F.lit(0))).join(found, keys).filter(
        F.col("new_label") != F.col("old_label")
    ).drop("label")


def relabel_totals(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows there are and how many changed."""
    found = new.select(*keys, "new_label")
    changed = F.col("new_label").isin(0, 1) & (F.col("new_label") != F.coalesce(F.col("label"), F.lit(0)))
    return old.join(found, keys, "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(changed).alias("changed")
    )


def flatten_predictions(papers: DataFrame) -> DataFrame:
    """One row per predicted sentence with defaults for missing fields."""
    rows = papers.select("paper_name", F.explode("sentences").alias("s"))
    p0 = F.coalesce("s.probabilities.class_0", F.lit(0.0))
    p1 = F.coalesce("s.probabilities.class_1", F.lit(0.0))
    return rows.select(
        F.coalesce("paper_name", F.lit("")).alias("paper_name"),
        F.coalesce("s.sentence_index", F.lit(-1)).alias("sentence_index"),
        F.coalesce("s.predicted_label", F.lit(0)).alias("predicted_label"),
        F.col("s.true_label").alias("true_label"),
        p0.alias("prob_0"),
        p1.alias("prob_1"),
        F.coalesce("s.confidence", F.greatest(p0, p1)).alias("confidence"),
        F.coalesce("s.sentence_text", F.lit("")).alias("sentence_text"),
    )


def confidence_histogram(
    predictions: DataFrame, bins: int = 20, pred: str = "predicted_label", gold: str = "true_label"
) -> DataFrame:
    """Equal-width histograms of the confidence by true label and by correctness.

    Each subset has its own range; its last bin includes the upper end; a subset of one value gets a
    range of one around it. Every row falls into two subsets, counted after a partial aggregate.
    """
    conf = F.nanvl(F.col("confidence"), F.lit(0.5))
    subsets = F.array(
        F.when(F.col(gold) == 0, "negative").when(F.col(gold) == 1, "positive"),
        F.when(F.col(pred) == F.col(gold), "correct").otherwise("incorrect"),
    )
    rows = predictions.select(conf.alias("conf"), F.explode(F.filter(subsets, lambda s: s.isNotNull())).alias("subset"))
    spread = rows.groupBy("subset").agg(F.min("conf").alias("lo"), F.max("conf").alias("hi"))
    # Four subsets at most, so the ranges are always small enough to broadcast.
    ranged = rows.join(F.broadcast(spread), "subset").withColumns({
        "lo": F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")),
        "hi": F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")),
    })
    place = F.floor((F.col("conf") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return ranged.groupBy("subset", F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def compare_methods(runs: dict[str, DataFrame], metrics: list[str]) -> DataFrame:
    """Metric columns of several runs side by side; each run is a long table (metric, value)."""
    tagged = [df.select(F.lit(name).alias("method"), "metric", "value") for name, df in runs.items()]
    return (
        reduce(lambda a, b: a.unionByName(b), tagged)
        .groupBy("method")
        .pivot("metric", metrics)
        .agg(F.first("value"))
    )


def gate_content(entries: DataFrame, label: str | None = None) -> DataFrame:
    """Classifier input: title and abstract in one text; blank texts, urls and unreadable labels go."""
    rest = [c for c in entries.columns if c not in ("url", "title", "abstract")]
    rows = entries.select(*rest, strip(F.concat("title", F.lit(" "), "abstract")).alias("content"))
    rows = rows.filter(not_blank(F.col("content")))
    if label:
        rows = rows.withColumn(label, F.col(label).try_cast("int")).filter(F.col(label).isNotNull())
    return rows


def training_text(samples: DataFrame, label: str = "label", keep: list[str] | None = None) -> DataFrame:
    """(text, label) of training samples; fails on samples that lack either."""
    have = set(samples.columns)

    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    both = F.when(
        column("title", "string").isNotNull() & column("abstract", "string").isNotNull(),
        F.concat(column("title", "string"), F.lit(" [SEP] "), column("abstract", "string")),
    )
    text = F.coalesce(both, column("text", "string"))
    target = F.coalesce(column(label, "int"), column("has_dataset", "int")).cast("int")
    return samples.select(
        *(keep or []),
        F.when(text.isNull(), F.raise_error(F.lit("sample without text"))).otherwise(text).alias("text"),
        F.when(target.isNull(), F.raise_error(F.lit("sample without label"))).otherwise(target).alias("label"),
    )

"""Reports of scored samples under the official and the clean protocol (A1, A2).

The official protocol counts every sample against its source's answer, the clean one only those that were kept or corrected, against
accepted answers. One report holds both, with columns for choices and answers, boxes, and captions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.text import ascii_tokens

from .aggregate import ratio
from .ngrams import gram_counts, rouge_l
from .scoring import eligible, score_predictions

CAPTIONS = ("caption", "change_caption")


def grouped_bleu(df: DataFrame, by: list[str], tokenizer=ascii_tokens) -> DataFrame:
    """BLEU-1 to 4 of (by, id, prediction, references), each group a corpus of its own: counts clipped by the greatest over references, closest reference length (ties shorter), a zero precision makes a score 0."""
    keys = [*by, "id"]
    cand = df.select(*keys, tokenizer("prediction").alias("t"))
    refs = df.select(*keys, F.posexplode("references").alias("ref", "text")).select(*keys, "ref", tokenizer("text").alias("t"))
    most = gram_counts(refs, [*keys, "ref"], "t").groupBy(*keys, "n", "gram").agg(F.max("count").alias("most"))
    hits = gram_counts(cand, keys, "t").join(most, [*keys, "n", "gram"], "left").groupBy(*by, "n").agg(F.sum(F.least("count", F.coalesce("most", F.lit(0)))).alias("hit"), F.sum("count").alias("total"))
    near = refs.select(*keys, F.size("t").alias("r")).join(cand.select(*keys, F.size("t").alias("c")), keys)
    lengths = near.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("r") - F.col("c")), F.col("r"))).alias("m"), F.first("c").alias("c")).groupBy(*by).agg(F.sum("m.r").alias("r"), F.sum("c").alias("c"))
    logs = [F.max(F.when((F.col("n") == n) & (F.col("hit") > 0), F.ln(F.col("hit") / F.col("total")))).alias(f"l{n}") for n in range(1, 5)]
    whole = lengths.join(hits.groupBy(*by).agg(*logs), by, "left")
    penalty = F.when(F.col("c") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    total = lambda k: sum((F.col(f"l{n}") for n in range(2, k + 1)), F.col("l1")) / k  # noqa: E731  null if one is
    return whole.select(*by, *[F.when(F.col("c") == 0, 0.0).otherwise(F.coalesce(penalty * F.exp(total(k)), F.lit(0.0))).alias(f"bleu_{k}") for k in range(1, 5)])


def _box_columns(iou: Column, counts: Column, prefix: str = "") -> list[Column]:
    """Metrics of the boxes that count and have an IoU."""
    has = counts & iou.isNotNull()
    share = lambda c: F.avg(F.when(has, c.cast("double")))
    n = F.count_if(has)
    metrics = {"boxes": F.when(n > 0, n), "mean_iou": share(iou), "acc_50": share(iou >= 0.5), "acc_70": share(iou >= 0.7), "format_validity": share(F.coalesce("format_valid", F.lit(False)))}
    return [v.alias(prefix + k) for k, v in metrics.items()]


def protocol_report(rows: DataFrame, by: list[str] = ("dataset", "subtask")) -> DataFrame:
    """Two rows a group, `protocol` official and clean (A1).

    rows: samples with prediction, error and generation_truncated (schema.PREDICTION). Columns: samples, scoreable, correct, accuracy; excluded
    (samples the clean protocol leaves out); errors and truncated; boxes with their IoU, shares at .5 and .7 and format validity (the report's own
    boxes are continuous, so the official row has them as reported_*); captions (without errors) with BLEU and ROUGE-L. Samples are scored once: one
    aggregation serves both protocols, and captions, which need no scores, are another.

    Defined cases: accuracy over nothing and box or caption columns of groups without any are null; a null group is a group.
    """
    by = list(by)
    # a key that is null nowhere
    group = F.to_json(F.struct(*[F.struct(F.col(b).alias("v")).alias(f"k{i}") for i, b in enumerate(by)]))
    scored = score_predictions(rows)
    yes, ok = F.lit(True), F.coalesce("clean_eligible", F.lit(False))
    discrete = F.col("official_correct").isNotNull()

    def side(protocol: str, counts: Column) -> Column:
        s, right = discrete & counts, F.coalesce(f"{protocol}_correct", F.lit(False))
        return F.struct(F.lit(protocol).alias("protocol"), F.count_if(s).alias("scoreable"), F.count_if(s & right).alias("correct"), ratio(F.count_if(s & right), F.count_if(s)).alias("accuracy"), *_box_columns(F.col(f"{protocol}_iou"), counts))

    whole = scored.groupBy(*by, group.alias("__g")).agg(
        F.count("*").alias("samples"), F.count_if(~ok).alias("excluded"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.coalesce("generation_truncated", F.lit(False))).alias("truncated"),
        *_box_columns(F.col("clean_iou"), ok, "reported_"), F.array(side("official", yes), side("clean", ok)).alias("sides"),
    )
    table = whole.select("*", F.explode("sides").alias("x")).select(*by, "__g", "x.*", *[c for c in whole.columns if c not in (*by, "__g", "sides")])
    said = rows.where(F.col("task_type").isin(*CAPTIONS) & F.col("error").isNull() & F.col("prediction").isNotNull())
    protocols = F.when(eligible(), F.array(F.lit("official"), F.lit("clean"))).otherwise(F.array(F.lit("official")))
    said = said.select(group.alias("__g"), F.explode(protocols).alias("protocol"), "id", "prediction", "references")
    keys = ["__g", "protocol"]
    # ids may repeat between groups
    rouge = rouge_l(said.withColumn("id", F.struct(*keys, "id"))).groupBy(F.col("id.__g").alias("__g"), F.col("id.protocol").alias("protocol")).agg(F.count("*").alias("captions"), F.avg("score").alias("rouge_l"))
    out = table.join(rouge, keys, "left").join(grouped_bleu(said, keys), keys, "left").drop("__g")
    first = ["protocol", *by, "samples", "scoreable", "correct", "accuracy", "excluded", "errors", "truncated"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def dataset_report(report: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(protocol, dataset): micro accuracy over samples, macro over the groups that have one (A2)."""
    sums = [F.sum(c).alias(c) for c in ("samples", "scoreable", "correct", "errors", "truncated")]
    return report.groupBy("protocol", dataset).agg(*sums, ratio(F.sum("correct"), F.sum("scoreable")).alias("micro_accuracy"), F.avg("accuracy").alias("macro_accuracy"), F.count("accuracy").alias("macro_groups"))


def overall_report(report: DataFrame) -> DataFrame:
    """A row a protocol over all samples (A3)."""
    sums = [F.sum(c).alias(c) for c in ("samples", "scoreable", "correct", "errors", "truncated")]
    return report.groupBy("protocol").agg(*sums, ratio(F.sum("correct"), F.sum("scoreable")).alias("accuracy"))

"""The report under both protocols, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.operators import reports as R

from .registry import query

#: Documents as samples of five tasks; what a sample says and what its answer is follow from its id.
_SAMPLES_SQL = """d AS (SELECT doc_id, coalesce(lang, 'none') AS dataset, doc_id % 5 AS task, ['keep', 'corrected', 'manual_review', 'exclude'][doc_id // 7 % 4 + 1] AS status, doc_id // 5 % 3 AS say, n_chars % 2 AS odd, doc_id % 3 = 0 AS lenient, doc_id % 11 = 0 AS failed, doc_id % 13 = 0 AS cut FROM documents),
    s AS (SELECT *, ['choice', 'choice', 'vqa', 'box', 'caption'][task + 1] AS subtask, status IN ('keep', 'corrected') AS eligible,
      CASE WHEN task < 2 THEN (say = odd) WHEN task IN (2, 3) THEN say = 0 END AS official,
      CASE WHEN task < 2 THEN CASE WHEN lenient THEN say < 2 ELSE say = odd END WHEN task IN (2, 3) THEN say = 0 END AS clean,
      CASE WHEN task = 3 THEN CASE WHEN say = 0 THEN 1.0 ELSE 0.0 END END AS iou, task = 3 AND say < 2 AS valid FROM d),
    p AS (SELECT unnest(['official', 'clean']) AS protocol)"""
_REPORT_SQL = """r AS (SELECT protocol, dataset, subtask, count(*) AS samples, count(official) FILTER (WHERE protocol = 'official' OR eligible) AS scoreable,
      count(*) FILTER (WHERE CASE protocol WHEN 'official' THEN official ELSE eligible AND clean END) AS correct, count(*) FILTER (WHERE NOT eligible) AS excluded, count(*) FILTER (WHERE failed) AS errors, count(*) FILTER (WHERE cut) AS truncated,
      count(iou) FILTER (WHERE protocol = 'official' OR eligible) AS boxes, avg(iou) FILTER (WHERE protocol = 'official' OR eligible) AS iou, avg(CAST(valid AS INTEGER)) FILTER (WHERE task = 3 AND (protocol = 'official' OR eligible)) AS format_validity,
      count(iou) FILTER (WHERE eligible) AS reported_boxes, avg(iou) FILTER (WHERE eligible) AS reported_iou, avg(CAST(valid AS INTEGER)) FILTER (WHERE task = 3 AND eligible) AS reported_format_validity,
      count(*) FILTER (WHERE task = 4 AND NOT failed AND (protocol = 'official' OR eligible)) AS captions, avg(CAST(say = 0 AS INTEGER)) FILTER (WHERE task = 4 AND NOT failed AND (protocol = 'official' OR eligible)) AS same FROM s, p GROUP BY ALL)"""


def _samples(t):
    k, say = F.col("doc_id") % 5, F.floor(F.col("doc_id") / 5) % 3
    text = lambda *c: F.element_at(F.array(*map(F.lit, c)), (say + 1).cast("int"))
    labels = lambda c, *a: F.when(c, F.array(*map(F.lit, a)))
    prediction = F.when(k < 2, text("(A) yes", "The answer is B.", "hard to tell")).when(k == 2, text("Red", "blue", "")).when(k == 3, text("{<10><20><50><60>}", "{<70><70><90><90>}", "nowhere")).otherwise(text("a small red house stands", "nothing like it at all", "one two three four five"))
    return t("documents").select(
        F.col("doc_id").cast("string").alias("id"), F.coalesce("lang", F.lit("none")).alias("dataset"), F.element_at(F.array(*map(F.lit, ["choice", "choice", "vqa", "box", "caption"])), (k + 1).cast("int")).alias("subtask"),
        F.element_at(F.array(*map(F.lit, ["single_choice", "single_choice", "open_vqa", "bbox", "caption"])), (k + 1).cast("int")).alias("task_type"),
        F.when(k == 2, F.array(F.lit("red"))).when(k == 3, F.array(F.lit("{<10><20><50><60>}"))).when(k == 4, F.array(F.lit("a small red house stands"))).alias("references"),
        F.when(k < 2, F.create_map(F.lit("A"), F.lit("yes"), F.lit("B"), F.lit("no"))).alias("choices"),
        F.when(k < 2, F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("B")))).alias("answer_labels"),
        F.coalesce(labels((k < 2) & (F.col("doc_id") % 3 == 0), "A", "B"), F.array().cast("array<string>")).alias("accepted_labels"),
        F.element_at(F.array(*map(F.lit, ["keep", "corrected", "manual_review", "exclude"])), (F.floor(F.col("doc_id") / 7) % 4 + 1).cast("int")).alias("clean_status"),
        prediction.alias("prediction"), F.when(F.col("doc_id") % 11 == 0, F.lit("timeout")).alias("error"), (F.col("doc_id") % 13 == 0).alias("generation_truncated"),
    )


@query(
    "a1_two_protocols",
    f"""WITH {_SAMPLES_SQL}, {_REPORT_SQL} SELECT protocol, dataset, subtask, samples, scoreable, correct, round(CASE WHEN scoreable > 0 THEN correct / scoreable END, 9) AS accuracy, excluded, errors, truncated,
       nullif(boxes, 0) AS boxes, round(iou, 9) AS mean_iou, round(iou, 9) AS acc_50, round(iou, 9) AS acc_70, round(format_validity, 9) AS format_validity,
       nullif(reported_boxes, 0) AS reported_boxes, round(reported_iou, 9) AS reported_mean_iou, round(reported_iou, 9) AS reported_acc_50, round(reported_iou, 9) AS reported_acc_70, round(reported_format_validity, 9) AS reported_format_validity,
       nullif(captions, 0) AS captions, round(same, 9) AS rouge_l, round(same, 9) AS bleu_1, round(same, 9) AS bleu_2, round(same, 9) AS bleu_3, round(same, 9) AS bleu_4 FROM r""",
)
def _(t):
    report = R.protocol_report(_samples(t))
    real = {f.name for f in report.schema.fields if f.dataType.typeName() == "double"}
    return report.select(*[F.round(c, 9).alias(c) if c in real else F.col(c) for c in report.columns])


@query(
    "a2_two_protocols",
    f"""WITH {_SAMPLES_SQL}, {_REPORT_SQL} SELECT protocol, dataset, CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(scoreable) AS BIGINT) AS scoreable, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(truncated) AS BIGINT) AS truncated,
       round(sum(correct) / sum(scoreable), 9) AS micro_accuracy, round(avg(CASE WHEN scoreable > 0 THEN correct / scoreable END), 9) AS macro_accuracy, count(CASE WHEN scoreable > 0 THEN 1 END) AS macro_groups FROM r GROUP BY ALL""",
)
def _(t):
    got = R.dataset_report(R.protocol_report(_samples(t)))
    return got.withColumns({c: F.round(c, 9) for c in ("micro_accuracy", "macro_accuracy")})


@query(
    "u2_task_report",
    f"""WITH {_SAMPLES_SQL}, t AS (SELECT *, say = 0 AS same FROM s)
       SELECT 'open_vqa' AS task_type, 'strict_accuracy' AS metric, 'accuracy' AS name, round(avg(CAST(same AS INTEGER)), 9) AS value FROM t WHERE task = 2
       UNION ALL SELECT 'single_choice', 'letter_accuracy', unnest(['accuracy', 'n']), round(unnest([avg(CASE WHEN say = 2 THEN 0 ELSE CAST(say = odd AS INTEGER) END), count(*)]), 9) FROM t WHERE task < 2
       UNION ALL SELECT 'caption', 'bleu', unnest(['bleu_1', 'bleu_2', 'bleu_3', 'bleu_4']), round(avg(CAST(same AS INTEGER)), 9) FROM t WHERE task = 4
       UNION ALL SELECT 'caption', 'rouge_l', 'rouge_l', round(avg(CAST(same AS INTEGER)), 9) FROM t WHERE task = 4
       UNION ALL SELECT 'bbox', 'referring', unnest(['mean_iou', 'acc_50', 'acc_70']), round(avg(iou), 9) FROM t WHERE task = 3""",
)
def _(t):
    from rowforge.functions import registry as U

    rows = _samples(t)
    answer = F.array(F.element_at("answer_labels", 1))
    rows = rows.withColumn("references", F.when(F.col("task_type") == "single_choice", answer).otherwise(F.col("references")))
    tasks = U.TASK_METRICS | {"caption": ["bleu", "rouge_l"]}
    return U.task_report(rows, tasks).withColumn("value", F.round("value", 9))


@query("t26_by_source", r"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN length(text) % 2 = 0 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN length(text) % 5 = 0 THEN 1.0 ELSE 0.0 END END AS reward FROM conversations")
def _(t):
    """Turns of three sources, each scored by its own reward: a boxed answer, a letter and a number after four marks."""
    from rowforge.functions import registry as U

    n, source = F.char_length("text"), F.element_at(F.array(*map(F.lit, ["math", "choice", "number"])), (F.col("turn") % 3 + 1).cast("int"))
    text = lambda c: c.cast("string")
    said = F.when(source == "math", F.concat(F.lit("\\boxed{"), text(n), F.lit("/7}"))).when(source == "choice", F.when(n % 2 == 0, "(B) it is").otherwise("(C) it is")).otherwise(F.concat(F.lit("so #### "), text(n % 5)))
    right = F.when(source == "math", F.concat(F.lit("\\frac{"), text(n), F.lit("}{7}"))).when(source == "choice", "B").otherwise("0")
    rows = t("conversations").select("conv_id", "turn", source.alias("source"), said.alias("prediction"), right.alias("reference"))
    return U.by_source(rows, "source", {"math": "boxed", "choice": "accuracy", "number": "gsm8k"}).select("conv_id", "turn", "reward")

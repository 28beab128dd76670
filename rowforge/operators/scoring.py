"""Scores of evaluation samples, official and clean, by task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions import boxes
from rowforge.functions.text import choice_labels, labels_by_text, normalize_answer

def _same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def eligible(status: str = "clean_status") -> Column:
    """Clean scores are for samples that were kept or corrected."""
    return F.coalesce(F.col(status).isin("keep", "corrected"), F.lit(False))


def choice_score(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """parsed_labels, official_correct and clean_correct of choice samples.

    Official: the labels equal the answer's. Clean: for several labels the option texts, with aliases, equal those of
    the answer; for one it is among the accepted labels, or the answer's where none are given.
    """
    multiple = F.col("task_type") == "multi_choice"
    said = choice_labels(prediction, F.map_keys("choices"), multiple)
    df = df.withColumn("__said", said).withColumn("parsed_labels", F.when(F.size("__said") > 0, F.col("__said")).otherwise(labels_by_text(prediction, F.col("choices")))).drop("__said")
    parsed, answer = F.col("parsed_labels"), F.coalesce("answer_labels", F.array().cast("array<string>"))
    texts = lambda a: F.transform(a, lambda k: normalize_answer(F.try_element_at(F.col("choices"), k), aliases=True))
    accepted = F.when(F.coalesce(F.size("accepted_labels"), F.lit(0)) > 0, F.col("accepted_labels")).otherwise(answer)
    one = F.coalesce(F.array_contains(accepted, F.try_element_at(parsed, F.lit(1))), F.lit(False))
    clean = F.when(multiple, _same_set(texts(parsed), texts(answer))).otherwise(one)
    return df.withColumns({"official_correct": _same_set(parsed, answer), "clean_correct": F.when(eligible(), clean), "clean_eligible": eligible()})


def vqa_score(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """parsed_text, official_correct and clean_correct of free answers against the first reference; clean uses aliases."""
    first = F.try_element_at("references", F.lit(1))
    clean = normalize_answer(prediction, aliases=True) == normalize_answer(first, aliases=True)
    return df.withColumns({"parsed_text": normalize_answer(prediction), "official_correct": normalize_answer(prediction) == normalize_answer(first), "clean_correct": F.when(eligible(), clean), "clean_eligible": eligible()})


def box_score(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Both IoUs, whether they reach a half, and whether the prediction is a box."""
    df = boxes.with_score(df, prediction, F.try_element_at("references", F.lit(1))).drop("reference_box")
    return df.withColumns({"clean_iou": F.when(eligible(), F.col("clean_iou")), "clean_correct": F.when(eligible(), F.col("clean_correct")), "clean_eligible": eligible()})


#: Columns that scores have, and the type of those that only some tasks fill.
SCORES = {"parsed_labels": "array<string>", "parsed_text": "string", "predicted_box": "array<double>", "official_iou": "double", "clean_iou": "double", "official_correct": "boolean", "clean_correct": "boolean", "clean_eligible": "boolean", "format_valid": "boolean"}


def score_predictions(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Samples with the scores of their task; captions have none of their own, only whether they are eligible."""
    task = F.col("task_type")
    parts = [
        choice_score(df.where(task.isin("single_choice", "multi_choice")), prediction),
        vqa_score(df.where(task == "open_vqa"), prediction),
        box_score(df.where(task == "bbox"), prediction),
        df.where(~F.coalesce(task.isin("single_choice", "multi_choice", "open_vqa", "bbox"), F.lit(False))).withColumn("clean_eligible", eligible()),
    ]
    full = [p.select(*df.columns, *[(F.col(n) if n in p.columns else F.lit(None).cast(t)).alias(n) for n, t in SCORES.items()]) for p in parts]
    out = full[0]
    for p in full[1:]:
        out = out.unionByName(p)
    return out

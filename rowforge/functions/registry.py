"""Registries of metrics, rewards and selectors: named DataFrame or Column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions import boxes, latex, text
from rowforge.operators import aggregate, ngrams

METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {}
REWARDS: dict[str, Callable[[Column, Column], Column]] = {}
#: Which metrics a task is reported with.
TASK_METRICS = {"open_vqa": ["strict_accuracy"], "single_choice": ["letter_accuracy"], "caption": ["bleu", "rouge_l", "cider_d"], "bbox": ["referring"]}


def metric(name: str):
    """Register f(rows of id, prediction, references) -> one row of metrics."""

    def put(f):
        METRICS[name] = f
        return f

    return put


def reward(f):
    """Register a function whose name ends in _reward, under what stands before."""
    if not f.__name__.endswith("_reward"):
        raise ValueError(f"a reward's name ends in _reward: {f.__name__}")
    REWARDS[f.__name__.removesuffix("_reward")] = f
    return f


@metric("strict_accuracy")
def strict_accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(text.same_ignoring_case("prediction", F.element_at("references", 1)).cast("double")).alias("accuracy"))


@metric("letter_accuracy")
def letter_accuracy(df: DataFrame) -> DataFrame:
    """Over all rows, answered or not."""
    hit = F.coalesce(text.mcq_letter("prediction") == text.mcq_letter(F.element_at("references", 1)), F.lit(False))
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("n"))


def _mean_score(scored: DataFrame, name: str) -> DataFrame:
    return scored.agg(F.avg("score").alias(name))


@metric("bleu")
def bleu(df: DataFrame) -> DataFrame:
    return ngrams.corpus_bleu(df)


@metric("rouge_l")
def rouge_l(df: DataFrame) -> DataFrame:
    return _mean_score(ngrams.rouge_l(df), "rouge_l")


@metric("cider_d")
def cider_d(df: DataFrame) -> DataFrame:
    return _mean_score(ngrams.cider_d(df), "cider_d")


@metric("referring")
def referring(df: DataFrame) -> DataFrame:
    """Mean IoU of boxes and shares at .5 and .7; a prediction that is no box has an IoU of 0."""
    iou = F.coalesce(F.col("clean_iou"), F.lit(0.0))
    return boxes.with_score(df, "prediction", F.try_element_at("references", F.lit(1))).agg(F.avg(iou).alias("mean_iou"), F.avg((iou >= 0.5).cast("double")).alias("acc_50"), F.avg((iou >= 0.7).cast("double")).alias("acc_70"))


def task_report(rows: DataFrame, tasks: dict[str, list[str]] | None = None) -> DataFrame:
    """(task_type, metric, name, value): each task's rows (id, task_type, prediction, references) under the metrics that it is reported with.

    tasks: task -> names of registered metrics, TASK_METRICS by default; a task without rows has null values.
    """
    out = []
    for task, names in (TASK_METRICS if tasks is None else tasks).items():
        mine = rows.where(F.col("task_type") == task).select("id", "prediction", "references")
        for m in names:
            found = METRICS[m](mine)
            long = found.select(*[F.col(c).cast("double").alias(c) for c in found.columns]).unpivot([], list(found.columns), "name", "value")
            out.append(long.select(F.lit(task).alias("task_type"), F.lit(m).alias("metric"), "name", "value"))
    return reduce(DataFrame.unionByName, out)


@reward
def accuracy_reward(prediction: Column, reference: Column) -> Column:
    return text.rule_cascade(prediction, reference)["correct"].cast("double")


@reward
def format_reward(prediction: Column, reference: Column) -> Column:
    return text.think_answer_format(prediction)


@reward
def gsm8k_reward(prediction: Column, reference: Column) -> Column:
    return F.coalesce((text.gsm8k_number(prediction, strict=False) == reference).cast("double"), F.lit(0.0))


@reward
def boxed_reward(prediction: Column, reference: Column) -> Column:
    return latex.boxed_reward(prediction, reference)


@reward
def iou_reward(prediction: Column, reference: Column) -> Column:
    return boxes.iou_reward(prediction, reference)


@reward
def iou_format_reward(prediction: Column, reference: Column) -> Column:
    return boxes.box_format_reward(prediction)


def overlong_penalty(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    """min(-(excess into the buffer) / buffer x factor, 0)."""
    return F.least(-(length - F.lit(most - buffer)) / buffer * factor, F.lit(0.0))


def by_source(df: DataFrame, source: str, routes: dict[str, str], prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """df with the reward that its source is scored by; an unknown source is an error."""
    out = F.raise_error(F.concat(F.lit("no reward for "), F.col(source))).cast("double")
    for name, key in routes.items():
        out = F.when(F.col(source) == name, REWARDS[key](F.col(prediction), F.col(reference))).otherwise(out)
    return df.withColumn("reward", out)


# --- advantages and losses (U6), models (U8) ---------------------------------------------------

#: Advantage estimators: f(rows, group columns, score column, ...) -> rows with `advantage`.
ADVANTAGES: dict[str, Callable[..., DataFrame]] = {}
#: Policy losses: f(log-ratio, advantage, ...) -> loss of a token.
POLICY_LOSSES: dict[str, Callable[..., Column]] = {}


def advantage(name: str):
    """Register an estimator; another function under a known name is an error."""

    def put(f):
        if ADVANTAGES.get(name, f) is not f:
            raise ValueError(f"another estimator is known as {name}")
        ADVANTAGES[name] = f
        return f

    return put


def policy_loss(name: str):
    """Register a loss; the last one of a name counts."""

    def put(f):
        POLICY_LOSSES[name] = f
        return f

    return put


def advantage_of(name: str) -> Callable[..., DataFrame]:
    if name not in ADVANTAGES:
        raise ValueError(f"no estimator is known as {name}")
    return ADVANTAGES[name]


def policy_loss_of(name: str) -> Callable[..., Column]:
    if name not in POLICY_LOSSES:
        raise ValueError(f"no loss is known as {name}; there are {sorted(POLICY_LOSSES)}")
    return POLICY_LOSSES[name]


advantage("grpo")(aggregate.group_normalised)
advantage("rloo")(aggregate.rloo)
advantage("opo")(aggregate.opo)
advantage("grpo_passk")(aggregate.pass_at_k)
advantage("gpg")(aggregate.gpg)


@policy_loss("vanilla")
def clipped_loss(log_ratio: Column, adv: Column, low: float = 0.2, high: float = 0.2, least: float = 3.0) -> Column:
    """The greater of the plain and clipped loss; below 0 no more than `least` times the lead (dual clip)."""
    r = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), log_ratio)))
    worse = F.greatest(-adv * r, -adv * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), r)))
    return F.when(adv < 0, F.least(worse, -adv * least)).otherwise(worse)


@policy_loss("gpg")
def plain_loss(log_prob: Column, adv: Column) -> Column:
    return -log_prob * adv


def predictions_of(samples: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Samples with the predictions of a model, which come as a table; one without a prediction is an error (U8)."""
    x = samples.join(answers.select(key, "prediction", F.lit(True).alias("__here")), key, "left")
    error = F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))).cast("boolean")
    return x.where(F.when(F.col("__here").isNull(), error).otherwise(True)).drop("__here")


def load_reward(path: str, name: str, **given) -> Callable[[Column, Column], Column]:
    """The function of that name in a Python file, with keyword arguments bound to it; a missing file or name is an error."""
    import importlib.util
    import os

    if not os.path.isfile(path):
        raise FileNotFoundError(f"no such file of rewards: {path}")
    spec = importlib.util.spec_from_file_location("rewards_of_a_file", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name}")
    return partial(getattr(module, name), **given) if given else getattr(module, name)

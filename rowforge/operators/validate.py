"""Filters and validators. A validator adds `reasons`, an array of what is wrong, empty if nothing is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.functions import boxes
from rowforge.functions.text import all_matches, strip
from rowforge.operators import select

TASKS = ["caption", "open_vqa", "bbox", "single_choice", "multi_choice", "change_caption"]
STATUSES = ["keep", "corrected", "manual_review", "exclude"]


def reasons(**tests: Column) -> Column:
    """Names of the tests that hold; an undecided test doesn't."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests.items()]), lambda x: x.isNotNull())


def first_reason(**tests: Column) -> Column:
    """The first test that holds, null if none (F8)."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests.items()])


def blank(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return x.isNull() | (F.trim(x) == "")


def sample_reasons(version: str = "1.0") -> Column:
    """The invariants of an evaluation sample (F1)."""
    choice = F.col("task_type").isin("single_choice", "multi_choice")
    return reasons(
        version=F.col("schema_version") != version,
        identity=blank("id") | blank("dataset") | blank("subtask"),
        prompt=blank("prompt"),
        task=~F.col("task_type").isin(*TASKS) | F.col("task_type").isNull(),
        status=~F.col("clean_status").isin(*STATUSES) | F.col("clean_status").isNull(),
        images=F.col("images").isNull() | (F.size("images") == 0),
        dimensions=F.exists("images", lambda i: (i["width"] <= 0) | (i["height"] <= 0)),
        change_pair=(F.col("task_type") == "change_caption") & (F.size("images") != 2),
        choices=choice & (F.coalesce(F.size("choices"), F.lit(0)) < 1),
        labels=choice & ((F.coalesce(F.size("answer_labels"), F.lit(0)) < 1) | ~F.forall("answer_labels", lambda a: F.array_contains(F.map_keys("choices"), a))),
        references=~choice & (F.coalesce(F.size("references"), F.lit(0)) < 1),
        kept_exclusion=(F.col("clean_status") == "keep") & F.exists("issues", lambda x: F.startswith(x, F.lit("exclude:"))),
    )


def quarantine(df: DataFrame, why: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without and with reasons (K9)."""
    tagged = df.withColumn("reasons", why)
    return tagged.where(F.size("reasons") == 0).drop("reasons"), tagged.where(F.size("reasons") > 0)


def require(df: DataFrame, why: Column, what: str) -> DataFrame:
    """df, or an error at the first row that has reasons."""
    w = F.array_join(why, ",")
    return df.where(F.when(w == "", True).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), w)).cast("boolean")))


def record_reasons(identity: str = "id") -> Column:
    """A training record: turns alternate from the user, <image> tokens equal images, the weight is positive and finite."""
    turns = F.transform("conversations", lambda t: t["from"])
    tokens = F.aggregate("conversations", F.lit(0), lambda a, t: a + F.size(F.split(t["value"], "<image>", -1)) - 1)
    return reasons(
        duplicate=F.count("*").over(Window.partitionBy(identity)) > 1,
        roles=~F.forall(F.transform(turns, lambda t, i: t == F.when(i % 2 == 0, "human").otherwise("gpt")), lambda ok: ok) | (F.size(turns) % 2 != 0) | (F.size(turns) == 0),
        images=tokens != F.size("image"),
        absolute=F.exists("image", lambda p: F.startswith(p, F.lit("/"))),
        weight=(F.col("loss_weight") <= 0) | F.isnan("loss_weight") | (F.col("loss_weight") == float("inf")),
    )


#: What answers of each form look like.
ANSWER_SCHEMAS = {
    "mcq": "^[A-E]$",
    "vrs_grounding": r"^\{<\d+><\d+><\d+><\d+>\}$",
    "xlrs_grounding": r"^\[\d+\.\d+,\d+\.\d+,\d+\.\d+,\d+\.\d+\]$",
    "caption": r"(?s)^.*\w.*$",
    "vqa": r"(?s)^.{1,200}$",
}


def answer_fits(answer: Column | str, schema: str) -> Column:
    return F.coalesce((F.col(answer) if isinstance(answer, str) else answer).rlike(ANSWER_SCHEMAS[schema]), F.lit(False))


def is_success(error: str = "error", truncated: str = "generation_truncated", dataset: str = "dataset", task: str = "task_type", tokens: str = "max_new_tokens", excepted: tuple[str, str, int] = ("xlrs_caption", "caption", 550)) -> Column:
    """No error and not cut off, but where the cut is the intended length."""
    intended = (F.col(dataset) == excepted[0]) & (F.col(task) == excepted[1]) & (F.col(tokens) == excepted[2])
    return blank(error) & (~F.coalesce(F.col(truncated), F.lit(False)) | F.coalesce(intended, F.lit(False)))


def detection_reason(classes: list[str], least_score: float, least_side: float, most_area: float) -> Column:
    """Why a detection goes, by the first test it fails (F8)."""
    b = F.col("box")
    share = boxes.area(b) / (F.col("width") * F.col("height"))
    return first_reason(
        no_source=blank("source"), no_image=blank("image"), other_class=~F.col("cls").isin(*classes), bad_size=(F.col("width") <= 0) | (F.col("height") <= 0),
        bad_box=~boxes.valid(b, F.col("width"), F.col("height")), low_score=F.col("score") < least_score, too_small=(b[2] - b[0] < least_side) | (b[3] - b[1] < least_side), too_large=share > most_area, no_mask=blank("mask_path"),
    )


#: Groups of relations that a description speaks of.
RELATIONS = [
    r"\b(?:above|below|upper|lower|top|bottom)\b",
    r"\b(?:left|right|west|east)\b",
    r"\b(?:beside|adjacent|near|next to|between|surrounded|immediately)\b",
    r"\b(?:inside|within|along|through|edge|corner|center|centre)\b",
]


def description_reasons(text: Column | str, groups: list[str] | None = None, least: int = 35, most: int = 100) -> Column:
    """Number of words, at least two sentences, at least two groups of relations; the first of them is the one reported."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.size(all_matches(t, r"[A-Za-z0-9]+"))
    sentences = F.size(F.filter(F.split(t, r"[.!?]+"), lambda s: strip(s) != ""))
    related = reduce(lambda a, b: a + b, [t.rlike(f"(?iU){g}").cast("int") for g in (RELATIONS if groups is None else groups)])
    return reasons(words=~words.between(least, most), sentences=sentences < 2, relations=related < 2)


def grounding_reasons(text: Column | str, forbidden: list[str]) -> Column:
    """No metadata words, one <p> pair."""
    t = F.col(text) if isinstance(text, str) else text
    count = lambda s: F.size(F.split(t, s, -1)) - 1
    return reasons(metadata=reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(x)) for x in forbidden]), pair=(count("<p>") != 1) | (count("</p>") != 1))


#: What no prompt may say.
BANNED = ["answer with", "only focus", "option's letter", "cannot determine", "i cannot"]


def prompt_valid(text: Column | str, banned: list[str] | None = None, most: int = 24) -> Column:
    """1 to `most` lower-cased words and no banned phrase."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    said = reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in (BANNED if banned is None else banned)])
    return F.size(all_matches(t, r"[a-z0-9][a-z0-9'-]*")).between(1, most) & ~said


def not_train(path: Column | str) -> Column:
    """The path, or an error for one of a split that isn't train."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(F.lower(p).rlike(r"(^|[/_-])(val|valid|validation|test|eval)([/_.-]|$)"), F.raise_error(F.concat(F.lit("not a train path: "), p)).cast("string")).otherwise(p)


def identity_kept(expected: Column | str, result: Column | str) -> Column:
    """Every expected key has its value in the result (F16)."""
    return F.forall(F.map_entries(expected), lambda e: F.coalesce(F.try_element_at(F.col(result) if isinstance(result, str) else result, e["key"]) == e["value"], F.lit(False)))


def gates_pass(*names: str) -> Column:
    """All review booleans are true."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(n), F.lit(False)) for n in names])


def needs_retry(answer: Column | str) -> Column:
    """Missing, blank, or an error mark at the start."""
    a = strip(answer)
    return a.isNull() | (a == "") | a.rlike(r"^\[(API|FUTURE)_ERROR\]")


def length_filter(df: DataFrame, text: str, most: int) -> DataFrame:
    """Rows whose text is no longer; null counts as an error and goes."""
    return df.where(F.coalesce(F.length(text) <= most, F.lit(False)))


def rejection_mask(ratio: Column | str, options: dict[str, tuple[float, float]]) -> Column:
    """Whether a sequence of log-ratios stays within all bounds.

    options: token_k1 (bounds of ratios, as logs), token_k2, token_k3, seq_sum_k1, seq_mean_k1, seq_max_k2, seq_max_k3.
    """
    r = F.col(ratio) if isinstance(ratio, str) else ratio
    k = {"k1": r, "k2": F.transform(r, lambda x: 0.5 * x * x), "k3": F.transform(r, lambda x: F.exp(x) - 1 - x)}
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    tests = []
    for name, (lo, hi) in options.items():
        how, of, kind = name.split("_")[0], name.split("_")[1], name.split("_")[-1]
        a = k[kind]
        bounds = (F.ln(F.lit(lo)), F.ln(F.lit(hi))) if kind == "k1" else (F.lit(lo), F.lit(hi))
        if how == "token":
            lo_, hi_ = bounds
            tests.append((F.array_min(a) >= lo_) & (F.array_max(a) <= hi_))
        else:
            v = {"sum": total(a), "mean": total(a) / F.size(a), "max": F.array_max(a)}[of]
            tests.append(v.between(*bounds))
    return reduce(lambda x, y: x & y, tests)


def finite_metric(value: Column | str, name: str) -> Column:
    """The value, or an error if it is missing or not finite."""
    v = F.col(value) if isinstance(value, str) else value
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"metric {name} is missing or not finite")).cast("double")).otherwise(v)


def image_decodes(content: Column | str) -> Column:
    """By the file's first and last bytes: PNG, JPEG, GIF, BMP, TIFF, WebP."""
    c = F.hex(F.col(content) if isinstance(content, str) else content)
    head = lambda *h: reduce(lambda a, b: a | b, [F.startswith(c, F.lit(x)) for x in h])
    png = head("89504E470D0A1A0A") & F.endswith(c, F.lit("49454E44AE426082"))
    jpeg = head("FFD8FF") & F.contains(F.right(c, F.lit(64)), F.lit("FFD9"))
    webp = head("52494646") & (F.substring(c, 17, 8) == "57454250")
    return F.coalesce(png | jpeg | webp | head("47494638", "424D", "49492A00", "4D4D002A"), F.lit(False))


# --- manifests (F4-F6, F18) --------------------------------------------------------------------

#: Names of subtasks and the task types they take.
SUBTASKS = {"vqa": "open_vqa", "caption": "caption", "referring": "bbox", "change": "change_caption", "mcq": "single_choice"}
#: The official split of each data set, and how many samples and subtasks there are.
OFFICIAL_SPLITS = {"vrsbench": "eval", "mme_realworld_rs": "test", "xlrs_bench_lite": "test", "levir_cc": "test"}
OFFICIAL_SAMPLES, OFFICIAL_SUBTASKS = 71665, 33


def manifest(samples: DataFrame, subtask: str | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """Samples to be written: choice rows without a label go, then those of other tasks, then those beyond the limit."""
    labelled = ~F.col("task_type").isin("single_choice", "multi_choice") | (F.coalesce(F.size("answer_labels"), F.lit(0)) > 0)
    kept = samples.where(F.coalesce(labelled, F.lit(True)))
    if subtask is not None:
        kept = kept.where(F.col("task_type") == SUBTASKS[subtask]) if subtask in SUBTASKS else kept.where("false")
    return kept if limit is None else kept.orderBy(order).limit(limit)


def subtask_slice(samples: DataFrame, task: str | None) -> DataFrame:
    """Samples of one task type, or all of them."""
    return samples if task is None else samples.where(F.col("task_type") == task)


def official(samples: DataFrame, splits: dict[str, str] | None = None, total: int | None = None, subtasks: int | None = None) -> DataFrame:
    """Samples of the official splits; a repeated id is an error, and so is another number of samples or subtasks where one is given."""
    splits = OFFICIAL_SPLITS if splits is None else splits
    table = F.create_map(*[F.lit(x) for kv in splits.items() for x in kv])
    kept = samples.where(F.try_element_at(table, F.col("dataset")) == F.col("split"))
    if total is not None or subtasks is not None:
        n = kept.agg(F.count("*").alias("n"), F.count_distinct("dataset", "subtask").alias("g")).first()
        if total is not None and n["n"] != total:
            raise ValueError(f"Expected {total} official samples, found {n['n']}")
        if subtasks is not None and n["g"] != subtasks:
            raise ValueError(f"Expected {subtasks} official subtasks, found {n['g']}")
    repeated = F.count("*").over(Window.partitionBy("id")) > 1
    error = F.raise_error(F.concat(F.lit("Duplicate official sample ID: "), F.col("id").cast("string"))).cast("boolean")
    return kept.withColumn("__r", repeated).where(F.when(F.col("__r"), error).otherwise(True)).drop("__r")


def referring_only(records: DataFrame, identity: str, most: int | None = None, held_out: float = 0.0, seed: int = 42) -> DataFrame:
    """Records whose first turn has the referring mark, `most` of them in hash order, with a split: the last share is for validation."""
    kept = records.where(F.contains(F.element_at("conversations", 1)["value"], F.lit("[refer]")))
    if most is not None:
        kept = select.seeded_sample(kept, identity, most, seed)
    if not held_out:
        return kept.withColumn("split", F.lit("train"))
    size = int(kept.count() * (1 - held_out))
    ranked = select.global_rank(kept, select.rank_key(seed + 1, identity), [identity])
    return ranked.withColumn("split", F.when(F.col("rank") <= size, "train").otherwise("val")).drop("rank")


# --- pseudo boxes of trajectories (F9, F10) ----------------------------------------------------


def searched_targets(trajectories: DataFrame) -> DataFrame:
    """A row a target of the trajectories that came to a right answer by tree search."""
    kept = trajectories.where((F.coalesce(F.col("search_mode"), F.lit(3)) == 2) & F.col("answer_correct"))
    return kept.select("sample_id", "width", "height", F.explode("target_traces").alias("target")).select(
        "sample_id", "width", "height", F.coalesce("target.target_index", F.lit(-1)).alias("target_index"), F.trim(F.coalesce("target.target_text", F.lit(""))).alias("target_text"), "target"
    )


def _target_tests() -> dict[str, Column]:
    return {"initial_sam_success": F.coalesce(F.col("target.initial_sam_success"), F.lit(False)), "empty_target_text": F.col("target_text") == ""}


def _share(box: Column) -> Column:
    return boxes.area(box) / (F.col("width") * F.col("height"))


def tree_node_boxes(trajectories: DataFrame, least: float = 0.001, most: float = 0.85) -> DataFrame:
    """Each searched target with its box and the reason why it goes, null if it stays: by its one final node."""
    nodes = F.col("target.final_nodes")
    n = F.coalesce(F.size(nodes), F.lit(0))
    x = searched_targets(trajectories).withColumn("box", F.when(n == 1, boxes.clip_rounded(boxes.xywh_to_xyxy(nodes[0]["bbox_xywh"]), F.col("width"), F.col("height")))).withColumn("share", _share(F.col("box")))
    tests = _target_tests() | {"missing_final_node": n == 0, "ambiguous_multiple_final_nodes": n != 1, "invalid_final_node_bbox": F.col("box").isNull(), "pseudo_bbox_area_out_of_range": ~F.col("share").between(least, most)}
    return x.withColumn("reason", first_reason(**tests)).drop("target")


def recovered_boxes(trajectories: DataFrame, stages: tuple[str, ...] = ("local_retry_1", "local_retry_2"), least: float = 0.001, most: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(targets, instances) by the masks of the first successful attempt, in the order of stages and calls.

    Targets have the reason why they go, and how many instances stay; instances are those the search retained, with
    the reason of each. A mask counts as missing without a path; whether its file is there is for a join with a listing.
    """
    at = F.create_map(*[F.lit(x) for i, s in enumerate(stages) for x in (s, i)])
    fit = F.filter("target.sam_attempts", lambda a: a["stage"].isin(*stages) & F.coalesce(a["sam_success"], F.lit(False)))
    best = F.array_min(F.transform(fit, lambda a: F.struct(F.element_at(at, a["stage"]).alias("o"), F.coalesce(a["call_index"], F.lit(0)).alias("c"), a["stage"].alias("stage"), a["instances"].alias("instances"))))
    x = searched_targets(trajectories).withColumn("__early", first_reason(**_target_tests())).withColumn("recovery", best)
    keys = ["sample_id", "target_index"]
    held = x.where("__early is null and recovery is not null").select(*keys, "target_text", "width", "height", F.col("recovery.stage").alias("stage"), F.explode("recovery.instances").alias("i")).where(F.coalesce(F.col("i.retained_by_cvsearch"), F.lit(False)))
    held = held.withColumn("box", boxes.clip_rounded(F.col("i.pseudo_bbox_xyxy"), F.col("width"), F.col("height"))).withColumn("share", _share(F.col("box")))
    why = first_reason(invalid_mask=~F.coalesce(F.col("i.valid_mask"), F.lit(False)), missing_mask_artifact=blank("i.mask_path"), invalid_mask_bbox=F.col("box").isNull(), pseudo_bbox_area_out_of_range=~F.col("share").between(least, most))
    instances = held.withColumn("reason", why).select(*keys, "target_text", "stage", F.col("i.prediction_index").alias("prediction_index"), "box", "share", "reason")
    good = instances.groupBy(*keys).agg(F.count_if(F.col("reason").isNull()).alias("instances"))
    targets = x.join(good, keys, "left").withColumn("instances", F.coalesce("instances", F.lit(0)))
    reason = F.coalesce("__early", first_reason(missing_local_sam_recovery=F.col("recovery").isNull(), no_valid_recovered_mask=F.col("instances") == 0))
    return targets.withColumn("reason", reason).select(*keys, "target_text", "instances", "reason"), instances

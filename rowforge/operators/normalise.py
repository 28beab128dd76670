"""Projections that turn one record form into another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.boxes import native_text
from rowforge.functions.text import normalize_answer, option_lines, prompt_task, question_stem, replace_first
from rowforge.operators.select import global_rank, ordered_rank


def from_messages(df: DataFrame) -> DataFrame:
    """prompt, images and answer of chat rows."""
    first, last = F.try_element_at("messages", F.lit(1)), F.try_element_at("messages", F.lit(-1))
    text = lambda m: F.array_join(F.transform(F.filter(m["content"], lambda c: c["type"] == "text"), lambda c: c["text"]), "\n")
    images = F.transform(F.filter(first["content"], lambda c: c["type"] == "image"), lambda c: c["image"])
    return df.withColumns({"prompt": text(first), "image_list": images, "answer": F.when(last["role"] == "assistant", text(last))})


def reference_text(raw: Column | str) -> Column:
    """A reference in JSON - text, object or list - as one text."""
    j = F.col(raw) if isinstance(raw, str) else raw
    keys = ["raw", "text", "value", "content"]
    of = lambda x: F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in keys], x)
    items = F.from_json(j, "array<string>")
    return F.when(j.rlike(r"^\s*\["), F.array_join(F.transform(items, of), " ")).when(j.rlike(r"^\s*\{"), of(j)).when(j.rlike(r'^\s*".*"\s*$'), F.get_json_object(F.concat(F.lit("["), j, F.lit("]")), "$[0]")).otherwise(j)


def to_samples(df: DataFrame, dataset: str, subtask: str) -> DataFrame:
    """Chat rows as samples; answer labels from (X) in a reference, else a bare letter, else the text of an option (P5)."""
    x = from_messages(df).withColumn("__t", prompt_task("prompt")).withColumn("choices", option_lines("prompt"))
    refs = F.coalesce("references", F.array("answer"))
    paren = F.flatten(F.transform(refs, lambda r: F.regexp_extract_all(r, F.lit(r"\(([A-D])\)"), F.lit(1))))
    bare = F.transform(F.filter(refs, lambda r: F.trim(r).rlike(r"^[A-D]\.?$")), lambda r: F.substring(F.trim(r), 1, 1))
    by_text = F.map_keys(F.map_filter("choices", lambda _, v: F.exists(refs, lambda r: normalize_answer(r) == normalize_answer(v))))
    labels = F.array_sort(F.array_distinct(F.when(F.size(paren) > 0, paren).when(F.size(bare) > 0, bare).otherwise(by_text)))
    choice = F.col("__t.task") == "single_choice"
    return x.select(
        F.lit(dataset).alias("dataset"), F.lit(subtask).alias("subtask"), F.when(choice & (F.size(labels) > 1), "multi_choice").otherwise(F.col("__t.task")).alias("task_type"),
        F.col("__t.rest").alias("prompt"), "image_list", refs.alias("references"), "choices", F.when(choice, labels).otherwise(F.array().cast("array<string>")).alias("answer_labels"),
    )


def flat_captions(df: DataFrame, prompts: dict[str, str] | None = None) -> DataFrame:
    """image, prompt, references as samples; some datasets have a fixed prompt."""
    fixed = reduce(lambda c, kv: F.when(F.col("dataset") == kv[0], F.lit(kv[1])).otherwise(c), (prompts or {}).items(), F.col("prompt"))
    return df.withColumn("prompt", fixed).withColumn("task_type", F.lit("caption"))


def flat_grounding(df: DataFrame, order: str) -> DataFrame:
    """Dense image numbers by first occurrence, boxes as text with six decimals."""
    first = df.groupBy("image").agg(F.min(order).alias("__f"))
    ids = ordered_rank(first, ["__f", "image"], "image_index").withColumn("image_index", (F.col("image_index") - 1).cast("int")).drop("__f")
    return df.join(ids, "image").withColumn("references", F.array(native_text(F.col("bbox")))).withColumn("task_type", F.lit("bbox"))


def read_versions(one: DataFrame, two: DataFrame) -> DataFrame:
    """Samples of both schema versions; the second's split and source become metadata."""
    meta = F.to_json(F.struct("split", "source"))
    return one.unionByName(two.withColumn("metadata", meta), allowMissingColumns=True)


def stamp(df: DataFrame, root: str, new_root: str, path: str, note: str) -> DataFrame:
    """A path's root is rewritten and the row is marked (P10)."""
    moved = F.when(F.startswith(F.col(path), F.lit(root)), F.concat(F.lit(new_root), F.substr(F.col(path), F.lit(len(root) + 1)))).otherwise(F.col(path))
    return df.withColumn(path, moved).withColumn("note", F.lit(note))


def to_conversations(df: DataFrame) -> DataFrame:
    """Chat rows as conversations, an <image> for each image before the first turn."""
    x = from_messages(df)
    mark = F.repeat(F.lit("<image>\n"), F.size("image_list"))
    turns = F.array(F.struct(F.lit("human").alias("from"), F.concat(mark, "prompt").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("answer").alias("value")))
    return x.select(F.col("image_list").alias("image"), turns.alias("conversations"))


def to_messages(df: DataFrame) -> DataFrame:
    """Conversations as chat rows; images go to the first turn."""
    bare = lambda v: F.when(F.contains(v, F.lit("<image>")), F.regexp_replace(F.replace(v, F.lit("<image>"), F.lit("")), r"(?U)^\s+", "")).otherwise(v)
    text = lambda t: F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), bare(t["value"]).alias("text"))
    pics = F.transform("image", lambda p: F.struct(F.lit("image").alias("type"), p.alias("image"), F.lit(None).cast("string").alias("text")))
    role = lambda t: F.when(t["from"] == "human", "user").when(t["from"] == "gpt", "assistant").otherwise(t["from"])
    return df.withColumn("messages", F.transform("conversations", lambda t, i: F.struct(role(t).alias("role"), F.when(i == 0, F.concat(pics, F.array(text(t)))).otherwise(F.array(text(t))).alias("content"))))


def explode_references(df: DataFrame, references: str = "references") -> DataFrame:
    """A row a reference, for training."""
    return df.select("*", F.posexplode(references).alias("reference_index", "reference")).drop(references)


def option_answer(choices: Column | str, letter: Column | str) -> Column:
    """The first option that starts with (X)."""
    return F.try_element_at(F.filter(choices, lambda c: F.startswith(c, F.concat(F.lit("("), F.col(letter) if isinstance(letter, str) else letter, F.lit(")")))), F.lit(1))


#: Fixed value: the subtask whose entries are used.
REMOTE_SENSING = "Remote Sensing"


def subtask_choices(entries: DataFrame, files: DataFrame, subtask: str = REMOTE_SENSING) -> DataFrame:
    """Entries (Subtask, Image, Text, `Answer choices`, `Ground truth`) of one subtask as chat rows (image, messages); those without a file go.

    files: name (as in Image), path. The answer is the letter and the first option that starts with it in brackets, or the letter alone.
    """
    mine = entries.where(F.col("Subtask") == subtask).join(files.select(F.col("name").alias("Image"), "path"), "Image")
    asked = F.concat(F.lit("[MCQ] "), F.col("Text"), F.lit("\n"), F.array_join("Answer choices", "\n"))
    option = option_answer("Answer choices", "Ground truth")
    answer = F.when(option.isNotNull(), F.concat("Ground truth", F.lit(". "), option)).otherwise(F.col("Ground truth"))
    return mine.select(F.col("Image").alias("image"), chat_row(F.col("path"), asked, answer).alias("messages"))


def mcq_source(df: DataFrame) -> DataFrame:
    """image_path, question, options (four, labels stripped), answer letter; legacy rows hold the options in the question."""
    lines = F.filter(F.split("question", "\n"), lambda s: s.rlike(r"^\s*\(?[A-D][.)]"))
    opts = F.transform(F.when(F.coalesce(F.size("options"), F.lit(0)) > 0, F.col("options")).otherwise(lines), lambda o: F.trim(F.regexp_replace(o, r"^\s*\(?[A-D][.)]\s*", "")))
    checked = F.when(F.size(opts) == 4, opts).otherwise(F.raise_error(F.concat(F.lit("not four options: "), F.col("question"))).cast("array<string>"))
    return df.select("image_path", question_stem("question").alias("question"), checked.alias("options"), F.upper(F.regexp_extract("answer", r"\(?([A-Da-d])", 1)).alias("answer"))


def rl_record(df: DataFrame, systems: dict[str, str]) -> DataFrame:
    """Samples as RL records with a system prompt by dataset; an unknown dataset is an error."""
    table = F.create_map(*[F.lit(x) for kv in systems.items() for x in kv])
    system = F.coalesce(F.try_element_at(table, F.col("dataset")), F.raise_error(F.concat(F.lit("no system prompt for "), F.col("dataset"))).cast("string"))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.select(
        F.col("dataset").alias("data_source"), F.array(turn("system", system), turn("user", F.col("prompt"))).alias("prompt"), F.transform("images", lambda i: F.struct(i["path"].alias("image"))).alias("images"),
        F.col("task_type").alias("ability"), F.struct(F.lit("rule").alias("style"), F.try_element_at("references", F.lit(1)).alias("ground_truth")).alias("reward_model"), F.struct(F.col("id"), F.lit(0).cast("bigint").alias("index"), F.col("split")).alias("extra_info"),
    )


def scrub_paths(json: Column | str) -> Column:
    """Machine paths in JSON text cut to their last part."""
    return F.regexp_replace(json, r'"/(?:home|root|mnt|data|workspace)/(?:[^"/]+/)*([^"/]+)"', '"$1"')


def with_image_size(df: DataFrame, files: DataFrame, image: str) -> DataFrame:
    """Rows with the size of their file; `exists` tells whether there is one."""
    return df.join(files.select(F.col("name").alias(image), F.col("n_bytes")), image, "left").withColumn("exists", F.col("n_bytes").isNotNull())


def long_format(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """(P29)"""
    return df.unpivot(ids, [F.col(v).cast("double").alias(v) for v in values], "metric", "value")


def shard_name(dataset: Column | str, task: Column | str) -> Column:
    return F.concat_ws("_", F.lower(F.regexp_replace(dataset, r"[^A-Za-z0-9]+", "_")), task)


def class_jobs(images: DataFrame, classes: list[str]) -> DataFrame:
    """A prompt row an image and class, with a safe job id."""
    x = images.withColumn("cls", F.explode(F.array(*map(F.lit, classes))))
    return x.withColumn("job_id", F.regexp_replace(F.concat_ws("__", "image", "cls"), r"[^A-Za-z0-9_.-]+", "_")).withColumn("prompt", F.concat(F.lit("Is there a "), "cls", F.lit(" in this image?")))


def folded(text: Column | str) -> Column:
    """Text by which options count as the same: trimmed, lower case, blanks in a row as one."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), " +", " "))


def synthetic_mcq(df: DataFrame, identity: str, question: str, answer: str, seed: int) -> DataFrame:
    """Each row's answer among three other answers of the whole pool, and its letter.

    The pool's answers stand in a circle, in the order of a hash of their folded form, so that forms of one answer are
    neighbours. A row takes three others that are a third of the circle apart, from a place that its id decides, and skips
    its own answer's forms. Places are joined as numbers, so no row meets the pool and none is lost.

    Defined cases: options and label are null where the answer is null or fewer than three other ones are in the pool; repeated rows get the same options.
    """
    pool = df.select(F.col(answer).alias("o")).where("o IS NOT NULL").distinct().withColumn("folded", folded("o"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:pool:"), F.col("folded")), 256)
    ranked = global_rank(pool, digest, ["folded", "o"], "at").withColumn("at", F.col("at") - 1)
    total = ranked.agg(F.count("*").alias("total"))  # one row
    own = ranked.groupBy("folded").agg(F.min("at").alias("first"), F.count("*").alias("forms"))
    rows = df.select(identity, question, F.col(answer).alias("__answer")).withColumn("folded", folded("__answer"))
    asked = rows.join(own, "folded", "left").crossJoin(F.broadcast(total)).withColumn("others", F.col("total") - F.col("forms"))
    start = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:ask:"), F.coalesce(F.col(identity).cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("long")
    place = lambda j: (start + j * F.floor(F.col("others") / 3)) % F.col("others")
    skipped = lambda p: p + F.when(p >= F.col("first"), F.col("forms")).otherwise(0)
    can = F.col("others") >= 3
    drawn = asked.where(can).select(identity, question, "__answer", F.explode(F.array(*[skipped(place(F.lit(j))) for j in range(3)])).alias("at")).join(ranked.select("at", "o"), "at")
    # one row a question again; equal rows were drawn for together
    key = lambda o: F.sha2(F.concat(F.lit(f"{seed + 1}:"), F.coalesce(F.col(identity).cast("string"), F.lit("")), F.lit(":"), o), 256)
    three = drawn.groupBy(identity, question, "__answer").agg(F.collect_set("o").alias("three"))
    shown = F.array_sort(F.transform(F.concat(F.array("__answer"), "three"), lambda o: F.struct(key(o).alias("h"), o.alias("o"))))
    made = three.withColumn("options", F.transform(shown, lambda x: x["o"]))
    label = F.element_at(F.array(*map(F.lit, "ABCD")), F.array_position("options", F.col("__answer")).cast("int"))
    same = F.lit(True)
    for c in (identity, question, "__answer"):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}"))
    out = rows.alias("r").join(made.withColumn("label", label).alias("m"), same, "left")
    return out.select(f"r.{identity}", f"r.{question}", "m.options", "m.label")


def first_word_flip(text: Column | str, word: str, other: str) -> Column:
    """(T22)"""
    return replace_first(text, rf"(?i)\b{word}\b", other)


# --- dataset converters (P13, P16, P17) --------------------------------------------------------


def chat_row(image: Column, prompt: Column, answer: Column) -> Column:
    """messages of one image, one prompt and one answer."""
    part = lambda kind, img, text: F.struct(F.lit(kind).alias("type"), img.cast("string").alias("image"), text.cast("string").alias("text"))
    none = F.lit(None).cast("string")
    user = F.struct(F.lit("user").alias("role"), F.array(part("image", image, none), part("text", none, prompt)).alias("content"))
    return F.array(user, F.struct(F.lit("assistant").alias("role"), F.array(part("text", none, answer)).alias("content")))


#: Marks of the tasks of one data set, and their prefixes.
MARKED_TASKS = {"caption": "[CAP]", "vqa": "[VQA]", "refer": "[REF]"}


def marked_prompt(value: Column | str) -> Column:
    """The first turn without its image line, with the task's mark as a prefix; without a known mark it is a vqa."""
    rest = replace_first(value, "<image>\n", "")
    out = F.concat(F.lit("[VQA] "), rest)
    for task, prefix in MARKED_TASKS.items():
        mark = f"[{task}]"
        out = F.when(F.startswith(rest, F.lit(mark)), F.concat(F.lit(prefix + " "), F.substr(rest, F.lit(len(mark) + 2)))).otherwise(out)
    return out


def marked_conversations(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Training entries (image, conversations) as chat rows; those without a file or an answer go.

    files: name, path.
    """
    answer = F.trim(F.try_element_at("conversations", F.lit(2))["value"])
    rows = entries.withColumn("__a", answer).where(F.col("__a") != "")
    prompt = marked_prompt(F.try_element_at("conversations", F.lit(1))["value"])
    return rows.join(files.withColumnRenamed("name", "image"), "image").select("image", chat_row(F.col("path"), prompt, F.col("__a")).alias("messages"))


def question_entries(entries: DataFrame, files: DataFrame, task: str) -> DataFrame:
    """Evaluation entries (image_id, question, ground_truth) of a task as chat rows; those without a file or a truth go."""
    truth = F.trim(F.coalesce("ground_truth", F.lit("")))
    rows = entries.withColumn("__a", truth).where(F.col("__a") != "")
    prompt = F.concat(F.lit(MARKED_TASKS.get(task, "[VQA]") + " "), F.coalesce("question", F.lit("")))
    return rows.join(files.withColumnRenamed("name", "image_id"), "image_id").select("image_id", chat_row(F.col("path"), prompt, F.col("__a")).alias("messages"))


def mcq_messages(rows: DataFrame, question: str, options: str, answer: str, image: str) -> DataFrame:
    """Questions with option lines as chat rows: the answer is the letter and its option, or the letter alone without one."""
    prompt = F.concat(F.lit("[MCQ] "), F.col(question), F.lit("\n"), F.array_join(options, "\n"))
    truth = F.coalesce(F.concat(F.col(answer), F.lit(". "), option_answer(options, answer)), F.col(answer))
    return rows.withColumn("messages", chat_row(F.col(image), prompt, truth))


def caption_messages(rows: DataFrame, image: str = "image", prompt: str = "prompt", references: str = "references") -> DataFrame:
    """Flat captions as chat rows: [CAP], a prompt where there is none, the first reference."""
    said = F.concat(F.lit("[CAP] "), F.coalesce(prompt, F.lit("Describe the image in detail.")))
    return rows.withColumn("messages", chat_row(F.col(image), said, F.coalesce(F.try_element_at(F.col(references), F.lit(1)), F.lit(""))))


# --- order (W1) --------------------------------------------------------------------------------


def sort_rows(df: DataFrame, *keys: str, ties: str) -> DataFrame:
    """By keys, `-` before one for falling order, ties by name."""
    return df.orderBy(*[F.col(k[1:]).desc() if k.startswith("-") else F.col(k) for k in keys], ties)

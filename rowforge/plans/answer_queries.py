"""Queries of answers, prompts, routes and gates by hand-written cases (T*, P*, F*, B14, B16, H3, H4, H7, H8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.functions import boxes as B
from rowforge.functions import hashing as H
from rowforge.functions import text as X
from rowforge.operators import normalise as N
from rowforge.operators import validate as V

from .cases import cases
from .registry import query

TEXT, TEXTS = "VARCHAR", "VARCHAR[]"

# --- letters (T5, T10, T11, T13, T16, T18) -----------------------------------------------------


@cases(
    "t5_choice_labels",
    [
        ("A", False, ["A"]), (" b. ", False, ["B"]), ("(C) {p}", False, ["C"]), ("A and C", False, []), ("A and C", True, ["A", "C"]), ("AC", False, []), ("ca, b", True, ["B"]), ("C/A", True, ["A", "C"]), ("CA", True, ["A", "C"]),
        ("E", False, []), ("none of these", False, []), ("[d]", False, ["D"]), ("A A A", False, ["A"]), ("answer: b", False, ["B"]), ("{p}", False, []),
    ],
    {"labels": TEXTS},
)
def _(said, multiple):
    return X.choice_labels(said, F.array(*map(F.lit, "ABCD")), multiple)


@cases(
    "t10_mcq_letter",
    [("C.", "C"), ("c) {p}", "C"), ("(e)", "E"), ("B . {p}", "B"), ("E is wrong, b ) holds", "B"), ("the {p} is d", "D"), ("A", "A"), ("{p}", None), ("F.", None), ("écB. {p} a", "A"), ("no_A.", None), ("  D\n", "D")],
    {"letter": TEXT},
)
def _(said):
    return X.mcq_letter(said)


@cases(
    "t11_mcq_steps",
    [("B. (c) {p}", "C"), ("D . {p}", "D"), ("{p}\n b \nx", "B"), ("The answer is d", "D"), ("答案：c", "C"), ("选择 (a", "A"), ("option e, surely", "E"), ("I think A is it", None), ("{p}", None), ("(F) then answer: b", "B"), ("a) or (d)", "D"), ("x B)", "B")],
    {"letter": TEXT},
)
def _(said):
    return X.mcq_letter_steps(said)


@cases(
    "t13_extractors",
    [
        ("Yes, {p}", "yes", "", "Y", ""), ("**No** way", "no", "", "N", ""), ("answer: yes", "yes", "", "", ""), ("I say no.", "no", "", "I", ""), ("{p} (b)", "{p} (b)", "(b)", "", ""), ("a {p}", "a {p}", "(a)", "", ""),
        ("(C) {p}", "(C) {p}", "", "C", "C"), ("B: {p}", "B: {p}", "(b)", "B", "B"), ("[D] {p}", "[D] {p}", "", "D", "D"), ("G. {p}", "G. {p}", "", "G", ""), ("", "", "", "", ""), ("F", "F", "", "F", "F"), ("maybe *yes*", "yes", "", "", ""), ("E-{p}", "E-{p}", "", "E", ""),
    ],
    {"yes_no": TEXT, "pair": TEXT, "first": TEXT, "leading": TEXT},
)
def _(said):
    return [X.pope_answer(said), X.pair_option(said), X.first_option(said), X.leading_option(said)]


@cases(
    "t16_choice_answers",
    [(" b ", 0, "B", "B", "A"), ("Answer: (c)", 1, "C", "C", "B"), ("option is d {p}", 3, "D", "D", "D"), ("B. {p}", 2, None, "B", "C"), ("c) {p}", 4, None, "C", None), ("A -{p}", -1, None, "A", None), ("B.", 0, None, None, "A"), ("{p}", 1, None, None, "B"), ("E", 2, None, None, "C"), ("choice a", 3, "A", "A", "D")],
    {"strict": TEXT, "lenient": TEXT, "of_number": TEXT},
)
def _(said, number):
    return [X.choice_answer(said), X.teacher_choice(said), X.choice_of_index(number)]


@cases(
    "t17_split_options",
    [
        ("<image>What is {p}?\nA. one\nB.  two \n C. three\nD. four", "What is {p}?", ["one", "two", "three", "four"], "<image>\nWhat is {p}?\n\nA. one\nB. two\nC. three\nD. four\n\nRespond with only the correct option letter."),
        ("Which {p}?\n\n\n\nA. x y\nB. B. z\nC. (C) v\nD. w\nAnswer with the option's letter from the given choices.", "Which {p}?", ["x y", "B. z", "(C) v", "w"], "<image>\nWhich {p}?\n\nA. x y\nB. B. z\nC. (C) v\nD. w\n\nRespond with only the correct option letter."),
    ],
    {"stem": TEXT, "options": TEXTS, "prompt": TEXT},
)
def _(said):
    q = X.split_question_options(said)
    return [q["stem"], q["options"], X.letter_prompt(q["stem"], q["options"])]


@cases(
    "t18_native_labels",
    [
        ("{p}? (A) one (B) two", 2, "B. (B) two", ["A", "B"], "B"), ("{p}?\nA. (A) one\nB. (B) two", 2, "AC", ["A", "B"], "AC"), ("{p}?\nA. one\nB. two\nC. three", 3, "ABE. x", ["A", "B", "C"], "ABE"), ("{p} A. one B. two", 3, "D two", ["A", "B"], "D"),
        ("(A) x (C) y\nA. one\nB. two\nC. z", 3, "b", ["A", "B", "C"], None), ("{p}", 4, "F", [], None), ("(A) x (B) y", 4, "A,", ["A", "B"], None),
    ],
    {"labels": TEXTS, "letters": TEXT},
)
def _(said, expected, answer):
    return [X.native_option_labels(said, expected), X.native_answer_letters(answer)]


# --- prompts (T19, T21, T22, P13, P20, P25-P27) ------------------------------------------------


@cases(
    "t19_route",
    [
        ("[REF] {p}", "referring", "grounding"), ("[ref] {p}", "vqa", "general"), ("  [CAP] where?", "caption", "caption"), ("[CD] {p}", "change", "change"), ("[VQA] what changed?", "vqa", "general"), ("", "vqa", "general"),
        ("The description is divided into three parts, after which", "caption", "caption"), ("[MCQ] where is {p}?", "mcq", "general"), ("Is it {p}?\n(A) yes before\n(B) no", "mcq", "general"), ("Identify the bounding box of the difference", "referring", "grounding"),
        ("What is the Difference?", "change", "change"), ("前后 {p}", "change", "change"), ("Where is the {p}?", "referring", "grounding"), ("请定位", "referring", "grounding"), ("Describe the {p}", "caption", "caption"), ("描述 {p}", "caption", "caption"), ("Is there a {p}?", "vqa", "general"),
        ("Is it\n(A) \n(B) x", "vqa", "general"), ("describe where", "referring", "grounding"), ("Compare and describe", "change", "change"),
    ],
    {"task": TEXT, "expert": TEXT},
)
def _(said):
    return [X.route_task(said), X.route(said)]


@query(
    "t19_route_conversations",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(l, 'change|difference|before|after|compare') THEN 'change' WHEN regexp_matches(l, 'where|location|position|find|locate|region') THEN 'grounding' WHEN regexp_matches(l, 'describe|description|caption') THEN 'caption' ELSE 'general' END AS route
       FROM (SELECT *, lower(text) AS l FROM conversations)""",
)
def _(t):
    return t("conversations").select("conv_id", "turn", X.route("text").alias("route"))


@query("t20_token_set", "SELECT item_id, list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: x NOT IN ('a','an','the','of','in','on','at','to','from','with','and','or','is','are','visible','shown','located','near'))) AS tokens FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", F.array_sort(X.token_set("text")).alias("tokens"))


@cases(
    "t21_clean_question",
    [
        ("<image>\nWhat  is\t{p}?\n \nA. one\nB. two", "What is {p}?", "<image> what is {p}? a. one b. two"), ("[VQA] {p}", "[VQA] {p}", "[vqa] {p}"), (" a\nb<image>c \n\n\n d", "a b c", "a b<image>c d"), ('"Target: the {p}."', '"Target: the {p}."', "the {p}"),
        ("PROMPT :  {p} !? ", "PROMPT : {p} !?", "{p}"), ("`phrase:{p}`", "`phrase:{p}`", "{p}"), ("", "", ""), ("x\n\t\ny", "x", "x y"),
    ],
    {"question": TEXT, "target": TEXT},
)
def _(said):
    return [X.clean_question(said), X.normalize_prompt(said)]


@cases(
    "t22_spatial_flips",
    [
        ("The leftmost {p} at the top", ["the rightmost {p} at the top", "the leftmost {p} at the bottom"], "the rightmost {p} at the top"), ("left of left", [], "left of left"), ("upper-left {p}", ["lower-right {p}", "lower-left {p}"], "lower-right {p}"),
        ("Above the {p}, above all", ["below the {p}, above all"], "below the {p}, above all"), ("the LEFT side, below", ["the right side, below", "the left side, above"], "the right side, below"), ("topmost {p}", [], "topmost {p}"),
        ("front and rear inside", ["rear and rear inside", "front and front inside"], "rear and rear inside"), ("east of {p}", [], "east of {p}"),
    ],
    {"two": TEXTS, "one": TEXT},
)
def _(said):
    return [X.spatial_flips(said, 2), X.spatial_flip(said)]


@cases(
    "p13_marked_prompts",
    [("<image>\n[caption] Tell {p}", "[CAP] Tell {p}"), ("<image>\n[vqa] Is {p}?", "[VQA] Is {p}?"), ("[refer] the {p}", "[REF] the {p}"), ("<image>\n{p}", "[VQA] {p}"), ("<image>\n<image>\n{p}", "[VQA] <image>\n{p}"), ("[Caption] {p}", "[VQA] [Caption] {p}")],
    {"prompt": TEXT},
)
def _(said):
    return N.marked_prompt(said)


@cases(
    "p20_clean_problem",
    [("<image>{p}\n\n\n\nx", "{p}\n\nx"), ("{p} Only focus on the objects inside the red bounding box in the image to answer this question.", "{p}"), ("{p}\nanswer with the Option's letter from the given choices", "{p}"), ("a\n\nb", "a\n\nb")],
    {"problem": TEXT},
)
def _(said):
    return X.clean_problem(said)


@cases(
    "p25_infer_class",
    [
        ("A ship beside a car. {p}", "ship"), ("One car over a vessel {p}", "vehicle"), ("Sand! A ship.", "ship"), ("Sand. A ship", None), ("{p}", None), ("the swimming pool", "swimming-pool"), ("car", None), ("a football field", "soccer-field"), ("Green space by a lake", "lawn"),
        ("a rooftop", "building"), ("A square and a town", "park"), ("Carpark: parking lot", "park"), ("a field", "farmland"), ("sports field", "sports-field"), ("warship", "ship"), ("the highway", "road"),
    ],
    {"cls": TEXT},
)
def _(said):
    return X.infer_class(said)


@cases(
    "p26_question_family",
    [("What color is the {p}?", "what color", "what color is"), ("Can it?", "can", "can it"), ("", "other", "unknown"), ("12 7", "other", "12 7"), ("Ships 3 here", "ships", "ships 3 here"), ("Is", "is", "is"), ("How many 5 {p}", "how many", "how many 5"), ("Whose {p}", "whose", "whose {p}")],
    {"family": TEXT, "prefix": TEXT},
)
def _(said):
    return [X.question_family(said), X.question_prefix(said)]


# --- answers and rewards (T8, T25, T28, B14) ---------------------------------------------------


@cases(
    "t8_vqa_score",
    [("Grey {p}!", "gray {p}", False, True), ("The {p}", "the  {p}.", False, False), ("Windmill", "wind turbine", False, True), ("a-b +3", "A-B, +3", True, True), ("greyish", "grayish", False, False), ("{p}?", "{p}", True, True), ("rectangular", "Rectangle!", False, True), ("Aeroplane", "aeroplane", True, True)],
    {"official": "BOOLEAN", "clean": "BOOLEAN"},
)
def _(said, gold):
    return [X.normalize_answer(said) == X.normalize_answer(gold), X.normalize_answer(said, aliases=True) == X.normalize_answer(gold, aliases=True)]


@cases(
    "t25_format_reward",
    [("<think>\nx\n</think>\n<answer>\n{p}\n</answer>", 1.0), ("<think>\nx\n</think>\n<answer>\n{p}\n</answer>\nmore", 1.0), ("<think>x</think>\n<answer>{p}</answer>", 0.0), ("<answer>\n{p}\n</answer>", 0.0), (" <think>\nx\n</think>\n<answer>\n{p}\n</answer>", 0.0), ("<think>\na\nb\n</think>\n<answer>\n\n\n</answer> ", 0.0)],
    {"reward": "DOUBLE"},
)
def _(said):
    return X.think_answer_format(said)


@cases(
    "t28_interleaved",
    [
        ("The {p}, yes!", "the {p} yes", True, "the {p} yes"), ("red/blue", "red blue", True, "red blue"), ("1,000", "1000", True, "1000"), ("'{p}'", "{p}", True, "{p}"), ("Answer: B", "b", True, "answer: b"), ("answer: z", "z", False, "answer: z"), ("3.5 m.", "3.5 m", True, "3.5 m"),
        ("(a)", "a", True, "a"), ("a-b", "ab", False, "a b"), ("a - b", "a  b", True, "a  b"), ("x\ty", "x y", True, "x y"), ("{p}", "x", False, "{p}"),
    ],
    {"correct": "BOOLEAN", "processed": TEXT},
)
def _(said, gold):
    return [X.interleaved_correct(said, gold), X.interleaved_answer(said)]


@cases(
    "b14_iou_rewards",
    [
        ("at {<0><0><10><10>}", "{<0><0><10><20>}", 0.5, 1.0), ("{< 10 ><10><0><0>}", "{<0><0><10><10>}", 1.0, 1.0), ("{<0> <0><10><10>}", "{<0><0><10><10>}", 0.0, 0.0), ("[0,0,10,10]", "{<0><0><10><10>}", 0.0, 0.0), ("{<-5><0><5><10>}", "{<0><0><5><10>}", 0.5, 1.0),
        ("{<1><1><1><1>}", "{<1><1><1><1>}", 0.0, 1.0), ("{p}", "{<0><0><1><1>}", 0.0, 0.0), ("{<0><0><1><1>} {<5><5><6><6>}", "none", 0.0, 1.0),
    ],
    {"iou": "DOUBLE", "format": "DOUBLE"},
)
def _(said, gold):
    return [B.iou_reward(said, gold), B.box_format_reward(said)]


@query(
    "b16_crops_beside",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity * 15 AS x, l_linenumber * 90 AS y, l_tax * 2000 AS w, l_discount * 1500 AS h FROM lineitem),
       g AS (SELECT *, greatest(4, CAST(trunc(0.02 * 800) AS INTEGER)) AS gap FROM b),
       r AS (SELECT l_orderkey, l_linenumber, unnest([{'k': 0, 'b': [0, 0, greatest(0, CAST(trunc(x) AS INTEGER) - gap), 800]}, {'k': 1, 'b': [least(1000, CAST(trunc(x + w) AS INTEGER) + gap), 0, 1000, 800]},
             {'k': 2, 'b': [0, 0, 1000, greatest(0, CAST(trunc(y) AS INTEGER) - gap)]}, {'k': 3, 'b': [0, least(800, CAST(trunc(y + h) AS INTEGER) + gap), 1000, 800]}]) AS s FROM g)
       SELECT l_orderkey, l_linenumber, list(s.b ORDER BY (s.b[3] - s.b[1]) * (s.b[4] - s.b[2]) DESC, s.k) AS crops FROM r
       WHERE s.b[3] - s.b[1] >= 128 AND s.b[4] - s.b[2] >= 128 AND (s.b[3] - s.b[1]) * (s.b[4] - s.b[2]) >= 80000 GROUP BY 1, 2""",
)
def _(t):
    b = F.array(F.col("l_quantity") * 15, (F.col("l_linenumber") * 90).cast("double"), F.col("l_tax") * 2000, F.col("l_discount") * 1500)
    # the table repeats some keys; rows are told apart by the box alone
    rows = t("lineitem").select("l_orderkey", "l_linenumber", B.crops_beside(b, F.lit(1000), F.lit(800)).alias("c"))
    flat = rows.select("l_orderkey", "l_linenumber", F.posexplode("c").alias("k", "c"))
    return flat.groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_list(F.struct((-(F.col("c")[2] - F.col("c")[0]) * (F.col("c")[3] - F.col("c")[1])).alias("a"), F.expr("CASE WHEN c[0] = 0 AND c[1] = 0 AND c[3] = 800 THEN 0 WHEN c[1] = 0 AND c[3] = 800 THEN 1 WHEN c[0] = 0 AND c[1] = 0 THEN 2 ELSE 3 END").alias("s"), "c"))).alias("r")).select("l_orderkey", "l_linenumber", F.transform("r", lambda x: x["c"]).alias("crops"))


# --- gates (F7, F12, F14, F17) -----------------------------------------------------------------


@cases(
    "f7_success",
    [
        (None, False, "a", "caption", 1, True), ("", True, "xlrs_caption", "caption", 550, True), ("", True, "xlrs_caption", "caption", 551, False), ("", True, "levir_cc", "caption", 550, False), ("", True, "xlrs_caption", "bbox", 550, False), ("bad", False, "a", "caption", 1, False),
        ("bad", True, "xlrs_caption", "caption", 550, False), (None, None, "a", "bbox", 64, True),
    ],
    {"ok": "BOOLEAN"},
)
def _(error, cut, dataset, task, tokens):
    return V.is_success("in0", "in1", "in2", "in3", "in4")


_LONG = " ".join(["word"] * 33)


@cases(
    "f12_description_gate",
    [
        (f"{_LONG} left. Above {{p}}.", []), (f"{_LONG}. {{p}} by.", ["relations"]), ("Left of {p}. Above it.", ["words"]), (f"{_LONG} left and above", ["sentences"]), (f"{_LONG} lefty. Abovement {{p}}.", ["relations"]), (f"{_LONG} near! Inside {{p}}?", []), (f"{_LONG} {_LONG} {_LONG} near! Inside {{p}}?", ["words"]),
        ("don't-count it's", ["words", "sentences", "relations"]), (f"{_LONG} next to. The TOP", []),
    ],
    {"reasons": TEXTS},
)
def _(said):
    return V.description_reasons(said)


@cases(
    "f14_prompt_valid",
    [("the {p}", True), ("", False), ("...", False), ("Answer with {p}", False), ("the option's letter", False), ("i cannot", False), (" ".join(["a"] * 24), True), (" ".join(["a"] * 25), False), ("it's a-b 'c", True), ("I CANNOT see", False), (" ".join(["- a"] * 24), True), ("变化", False)],
    {"ok": "BOOLEAN"},
)
def _(said):
    return V.prompt_valid(said)


@cases("f17_needs_retry", [(" ", True), ("x [API_ERROR] y", False), (" [API_ERROR] {p}", True), ("[FUTURE_ERROR]", True), ("{p}", False), ("\n", True), ("[api_error]", False)], {"retry": "BOOLEAN"})
def _(said):
    return V.needs_retry(said)


# --- hashes (H3, H4, H7, H8) -------------------------------------------------------------------


@query(
    "h3_content_id",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'id' || doc_id ELSE sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') END AS id,
       CASE WHEN doc_id % 2 = 0 THEN 'b:uid:u' || doc_id WHEN doc_id % 3 = 0 THEN 'b:id:id' || doc_id END AS uid FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""",
)
def _(t):
    d = t("documents").where("lang is not null and source is not null").select("doc_id", "lang", "source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("id"), "doc_id")).when(F.col("doc_id") % 3 == 1, "").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), "doc_id")).alias("uid"))
    key = H.first_key(F.lit("b"), ["uid", "id"], F.array("lang"), "source")
    return d.select("doc_id", H.content_id("source", "lang", "doc_id", explicit="id").alias("id"), F.when(~F.startswith(key, F.lit("sha1:")), key).alias("uid"))


@query("h3_uid_digest", "SELECT doc_id, 'sha1:' || sha1('{\"benchmark\": \"b\", \"images\": [\"' || lang || '\", \"x\"], \"query\": \"' || source || '\"}') AS uid FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def _(t):
    d = t("documents").where("lang is not null and source is not null").select("doc_id", "lang", "source", F.lit(None).cast("string").alias("id"))
    return d.select("doc_id", H.first_key(F.lit("b"), ["id"], F.array(F.col("lang"), F.lit("x")), "source").alias("uid"))


@query("h4_ordered_digest", """SELECT o_custkey, sha256('[' || string_agg('{"id":' || o_orderkey || ',"prompt":"' || o_orderpriority || '"}', ',' ORDER BY o_orderkey) || ']') AS digest FROM orders GROUP BY o_custkey""")
def _(t):
    return t("orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prompt")).groupBy("o_custkey").agg(H.ordered_digest("id", "id", "prompt").alias("digest"))


@query("h7_relative_delta", "SELECT l_orderkey, l_linenumber, CASE WHEN b = 0 THEN NULL ELSE (l_tax - b) / abs(b) END AS delta FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN -l_discount ELSE l_discount END AS b FROM lineitem)")
def _(t):
    b = F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_discount")).otherwise(F.col("l_discount"))
    return t("lineitem").select("l_orderkey", "l_linenumber", H.relative_delta("l_tax", b).alias("delta"))


@cases(
    "h8_first_budget",
    [("xlrs_caption", "caption", 2, 550, 2200), ("vrsbench", "caption", 1, 384, 768), ("xlrs_caption", "bbox", 0, 64, 64), ("x", "open_vqa", 5, 128, 512), ("x", "multi_choice", 1, 64, 128), ("x", "single_choice", 0, 128, 128), ("x", "change_caption", 3, 128, 512), ("x", "other", 0, None, None)],
    {"first": "INTEGER", "now": "INTEGER"},
)
def _(dataset, task, retries):
    return [H.first_budget(dataset, task), H.token_budget(H.first_budget(dataset, task), retries)]

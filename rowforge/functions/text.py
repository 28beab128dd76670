"""Text and answer columns: normalisers, label and option parsers, token sets, rewards.

All are Column -> Column on built-in expressions, so they stay in the JVM. Word
characters are Unicode-aware where the semantics ask for it ((?U) in patterns).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that count as one another in clean scoring.
ALIASES = {"grey": "gray", "rectangular": "rectangle", "windmill": "wind turbine", "aeroplane": "airplane"}
#: Articles that question-answer normalisation drops, and ASCII punctuation.
ARTICLES = r"\b(a|an|the)\b"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that token sets leave out, and words that a question begins with.
STOP_WORDS = ["a", "an", "the", "of", "in", "on", "at", "to", "from", "with", "and", "or", "is", "are", "visible", "shown", "located", "near"]
QUESTION_WORDS = ["what", "which", "where", "who", "how", "is", "are", "does", "do"]

S = "string"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def first_match(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.when(_c(text).rlike(pattern), F.regexp_extract(_c(text), pattern, group))


def all_matches(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(group))


def last_match(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(all_matches(text, pattern, group), F.lit(-1))


# --- normalisers (T1, T2, T12) -----------------------------------------------------------------


def normalize_answer(text: Column | str, aliases: bool = False) -> Column:
    """Lower case; optional aliases; anything but a-z 0-9 . + - becomes one blank; trimmed."""
    out = F.lower(_c(text))
    if aliases:
        for word, other in ALIASES.items():
            out = F.regexp_replace(out, rf"(?U)\b{word}\b", other)
    return F.trim(F.regexp_replace(out, "[^a-z0-9.+-]+", " "))


def normalize_qa(text: Column | str) -> Column:
    """Lower case, then no punctuation, then no articles, then single blanks."""
    bare = F.translate(F.lower(_c(text)), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, ARTICLES, " "), r"\s+", " "))


def exact_match(prediction: Column | str, golds: Column | str) -> Column:
    p = normalize_qa(prediction)
    return F.exists(_c(golds), lambda g: normalize_qa(g) == p)


def substring_match(prediction: Column | str, golds: Column | str) -> Column:
    p = normalize_qa(prediction)
    return F.exists(_c(golds), lambda g: F.contains(p, normalize_qa(g)))


def same_ignoring_case(prediction: Column | str, reference: Column | str) -> Column:
    return F.lower(F.trim(_c(prediction))) == F.lower(F.trim(_c(reference)))


# --- choices (T5-T7, T10, T11, T13, T16) -------------------------------------------------------


def choice_labels(prediction: Column | str, allowed: Column, multiple: Column | bool) -> Column:
    """Isolated letters A-E of the upper-cased text that are allowed, else a text of such letters only; sorted, distinct.

    A single choice must come to exactly one label.
    """
    upper = F.trim(F.upper(_c(prediction)))
    isolated = F.filter(all_matches(upper, "(?<![A-Z])([A-E])(?![A-Z])", 1), lambda x: F.array_contains(allowed, x))
    compact = F.regexp_replace(F.regexp_replace(upper, r"^[.()\[\]{}]+|[.()\[\]{}]+$", ""), r"[\s,;/|+-]", "")
    letters = F.filter(F.split(compact, ""), lambda x: x != "")
    packed = F.when(compact.rlike("^[A-E]+$") & F.forall(letters, lambda x: F.array_contains(allowed, x)), letters).otherwise(F.array().cast("array<string>"))
    labels = F.array_sort(F.array_distinct(F.when(F.size(isolated) > 0, isolated).otherwise(packed)))
    one = F.when(F.size(labels) == 1, labels).otherwise(F.array().cast("array<string>"))
    return F.when(F.lit(multiple) if isinstance(multiple, bool) else multiple, labels).otherwise(one)


def labels_by_text(prediction: Column | str, choices: Column) -> Column:
    """Labels whose option text equals the prediction after normalisation."""
    p = normalize_answer(prediction)
    return F.array_sort(F.map_keys(F.map_filter(choices, lambda _, v: normalize_answer(v) == p)))


def mcq_letter(text: Column | str, letters: str = "A-E") -> Column:
    """`X.` or `X)` first (blanks may stand before the mark), else a letter that stands alone, in either case; null if neither."""
    t, x = strip(text), f"{letters}{letters.lower()}"
    return F.upper(F.coalesce(first_match(t, rf"(?U)(?<!\w)([{x}])\s*[.)]"), first_match(t, rf"(?U)(?<!\w)([{x}])(?!\w)")))


def mcq_letter_steps(text: Column | str, letters: str = "A-E") -> Column:
    """In this order: (X); X. or X) with blanks before the mark; a letter alone on its line; after answer, option, 答案 or 选择."""
    t, x = strip(text), f"{letters}{letters.lower()}"
    steps = [rf"\(([{x}])\)", rf"(?U)(?<!\w)([{x}])\s*[.)]", rf"(?U)(?:^|\n)\s*([{x}])\s*(?:\n|\z)", rf"(?iU)(?:answer|option|答案|选择)\s*(?:is|:|：)?\s*\(?([{x}])\)?"]
    return F.upper(F.coalesce(*[first_match(t, p) for p in steps]))


def yes_no(text: Column | str) -> Column:
    t = F.lower(F.trim(_c(text)))
    return F.when(t.rlike(r"^\W*yes\b"), "yes").when(t.rlike(r"^\W*no\b"), "no").when(t.rlike(r"\byes\b") & ~t.rlike(r"\bno\b"), "yes").when(t.rlike(r"\bno\b") & ~t.rlike(r"\byes\b"), "no")


def parenthesised_option(text: Column | str) -> Column:
    return F.lower(first_match(text, r"(?i)\(([ab])\)"))


def pope_answer(text: Column | str) -> Column:
    """yes or no at the start (after an `answer` mark), else as the last word, else the trimmed text."""
    t = strip(F.regexp_replace(_c(text), r"^\*+", ""))
    # what follows the first lower-case "answer"; a capital one leaves nothing to cut
    rest = F.when(F.lower(t).rlike("^answer") & F.contains(t, F.lit("answer")), strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?s)^.*?answer", ""), "^:+", ""), r"^\*+", ""))).otherwise(t)
    tail = strip(F.regexp_replace(F.regexp_replace(rest, r"\.+$", ""), r"\*+$", ""))
    last = F.lower(F.regexp_replace(F.regexp_extract(tail, r"(?U)(\S+)$", 1), r"^\*+|\*+$", ""))
    return F.coalesce(F.when(F.lower(rest).startswith("yes"), "yes").when(F.lower(rest).startswith("no"), "no").when(last.isin("yes", "no"), last).otherwise(strip(text)), F.lit(""))


def pair_option(text: Column | str) -> Column:
    """(a) or (b) in brackets, else as a word; empty if neither."""
    t = F.lower(strip(text))
    got = F.coalesce(first_match(t, r"\(([ab])\)"), first_match(t, r"(?U)\b([ab])\b"))
    return F.coalesce(F.concat(F.lit("("), got, F.lit(")")), F.lit(""))


def first_option(text: Column | str) -> Column:
    """(X), then X before a mark or blank, then any capital; empty if none."""
    t = _c(text)
    return F.coalesce(first_match(t, r"\(([A-Z])\)"), first_match(t, r"(?U)([A-Z])[.)\s]"), first_match(t, "([A-Z])"), F.lit(""))


def leading_option(text: Column | str) -> Column:
    """A to F at the start, alone or before a mark; empty if none."""
    return F.coalesce(first_match(strip(text), r"(?U)^[ (\[]*([A-F])(?:\z|[.)\]]|[:\-]\s+)"), F.lit(""))


def choice_answer(text: Column | str) -> Column:
    """A lone letter A to D, or one after ANSWER, OPTION or CHOICE."""
    t = F.upper(strip(F.coalesce(_c(text), F.lit(""))))
    return F.coalesce(first_match(t, r"^([A-D])$"), first_match(t, r"(?U)(?:ANSWER|OPTION|CHOICE)\s*(?:IS|:)?\s*\(?([A-D])\)?"))


def choice_of_index(number: Column | str) -> Column:
    """0 to 3 as A to D, else null."""
    return F.when(_c(number).between(0, 3), F.element_at(F.array(*map(F.lit, "ABCD")), _c(number).cast("int") + 1))


def teacher_choice(text: Column | str) -> Column:
    """choice_answer, else a letter with a mark and more text behind it."""
    t = F.upper(strip(F.coalesce(_c(text), F.lit(""))))
    return F.coalesce(choice_answer(text), first_match(t, r"(?U)^([A-D])\s*[.)\]:\-]\s*\S"))


def native_option_labels(text: Column | str, expected: Column | int | None = None) -> Column:
    """Labels of one of three layouts - (A), A. at line starts, A. anywhere: the one that is A, B, ... of the expected number, else the longest, the first of equals."""
    t = _c(text)
    found = [all_matches(t, p, 1) for p in (r"\(([A-E])\)\s*", r"(?mU)^\s*([A-E])\.\s+", r"(?U)(?<![A-Za-z0-9])([A-E])\.\s+")]
    longest = F.when((F.size(found[0]) >= F.size(found[1])) & (F.size(found[0]) >= F.size(found[2])), found[0]).when(F.size(found[1]) >= F.size(found[2]), found[1]).otherwise(found[2])
    if expected is None:
        return longest
    want = F.slice(F.array(*map(F.lit, "ABCDE")), 1, F.lit(expected) if isinstance(expected, int) else expected)
    return F.coalesce(*[F.when(f == want, f) for f in found], longest)


def native_answer_letters(text: Column | str) -> Column:
    """Leading letters A to E, as far as a full stop, blank or the end; null if there are none."""
    return first_match(strip(text), r"(?U)^([A-E]+)(?:\.|\s|\z)")


def letter_index(letter: Column | str) -> Column:
    """A..D as 0..3, else null."""
    return F.when(F.upper(_c(letter)).isin("A", "B", "C", "D"), F.ascii(F.upper(_c(letter))) - 65)


def strip_option_label(text: Column | str) -> Column:
    return F.regexp_replace(F.trim(_c(text)), r"^\(?[A-Ea-e][.)]\s*", "")


#: Marks that interleaved scoring takes out, in this order.
MARKS = [";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!"]


def interleaved_answer(text: Column | str) -> Column:
    """Line breaks and tabs as blanks; a mark goes if it stands beside a blank anywhere or a comma joins digits, else it becomes a blank; the first 32 full stops that no digit follows go; quotes and brackets at the ends go."""
    src = strip(F.translate(_c(text), "\n\t", "  "))
    joined = src.rlike(r"(?U)(\d)(,)(\d)")
    out = src
    for m in MARKS:
        gone = F.contains(src, F.lit(m + " ")) | F.contains(src, F.lit(" " + m)) | joined
        out = F.replace(out, F.lit(m), F.when(gone, "").otherwise(" "))
    out = F.array_join(F.split(out, r"(?U)\.(?!\d)", 33), "")  # the first 32 only
    for m in ("'", '"', r"\)", r"\("):
        out = F.regexp_replace(out, f"^(?:{m})+|(?:{m})+$", "")
    return F.lower(strip(out))


def interleaved_correct(prediction: Column | str, gold: Column | str) -> Column:
    """Equal once processed; of a prediction with colons the last part that is one letter a to h counts."""
    p = interleaved_answer(prediction)
    lone = F.try_element_at(F.filter(F.transform(F.split(p, ":"), strip), lambda x: x.rlike("^[a-h]$")), F.lit(-1))
    return F.when(F.contains(p, F.lit(":")), F.coalesce(lone, p)).otherwise(p) == interleaved_answer(gold)


# --- envelopes and rewards (T4, T14, T15, T24, T25) --------------------------------------------

_ANSWER = r"(?s)<answer>(.*?)</answer>"


def last_answer_tag(text: Column | str) -> Column:
    return strip(last_match(text, _ANSWER))


def answer_envelope(text: Column | str, keep_prefix: bool = True) -> Column:
    """Inside <answer>, else from `Answer:` on (with or without the prefix), else the whole."""
    t = _c(text)
    after = first_match(t, r"(?s)(Answer:.*)$") if keep_prefix else first_match(t, r"(?s)Answer:(.*)$")
    return strip(F.coalesce(first_match(t, _ANSWER), after, t))


def without_thinking(text: Column | str) -> Column:
    """What follows the last </think>, in its last <answer> tag if it has one."""
    rest = F.element_at(F.split(_c(text), "</think>", -1), -1)
    return strip(F.coalesce(last_match(rest, _ANSWER), rest))


def em_reward(text: Column | str, golds: Column | str) -> Column:
    """1 for an exact match of the last tag; a quarter if there are more than ten tags; 0 without a tag."""
    tags = all_matches(text, _ANSWER, 1)
    hit = exact_match(F.trim(F.try_element_at(tags, F.lit(-1))), golds)
    return F.when(F.size(tags) == 0, 0.0).when(F.coalesce(hit, F.lit(False)), F.when(F.size(tags) > 10, 0.25).otherwise(1.0)).otherwise(0.0)


def numeric_equal(left: Column | str, right: Column | str) -> Column:
    """Equality as decimals; null unless both are numbers."""
    n = lambda x: F.regexp_replace(F.trim(_c(x)), ",", "").try_cast("decimal(38,10)")
    return n(left) == n(right)


def rule_cascade(prediction: Column | str, reference: Column | str) -> Column:
    """(correct, source): by letter if the reference is one, else as numbers, else by normalised text."""
    letter = F.trim(_c(reference)).rlike("^[A-E]$")
    num = numeric_equal(prediction, reference)
    return F.when(letter, F.struct((F.coalesce(mcq_letter(prediction), F.lit("")) == F.trim(_c(reference))).alias("correct"), F.lit("mcq").alias("source"))).when(
        num.isNotNull(), F.struct(num.alias("correct"), F.lit("decimal").alias("source"))
    ).otherwise(F.struct((normalize_qa(prediction) == normalize_qa(reference)).alias("correct"), F.lit("text").alias("source")))


def gsm8k_number(text: Column | str, strict: bool = True, tail: int = 300) -> Column:
    """Of the last `tail` characters: the number after the last `####`, or the last number at all."""
    end = F.right(_c(text), F.lit(tail))
    if strict:
        got = last_match(end, r"#### (\-?[0-9\.\,]+)")
    else:
        got = F.try_element_at(F.filter(all_matches(end, r"(\-?[0-9\.\,]+)", 1), lambda x: ~x.isin("", ".")), F.lit(-1))
    return F.regexp_replace(got, "[,$]", "")


def think_answer_format(text: Column | str) -> Column:
    """1 where the text starts with both envelopes, each on lines of its own, and the last one ends a line."""
    return F.when(_c(text).rlike(r"(?s)\A<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>(?=\n|\z)"), 1.0).otherwise(0.0)


# --- tokens (T20, P25-P27, M1, M2) -------------------------------------------------------------


def ascii_tokens(text: Column | str) -> Column:
    """Lower-case ASCII words and numbers, with inner apostrophes."""
    return all_matches(F.lower(_c(text)), "[a-z0-9]+(?:'[a-z0-9]+)?")


def unicode_tokens(text: Column | str) -> Column:
    """Words of lower-cased text once everything but word characters and blanks is a blank."""
    return F.filter(F.split(F.regexp_replace(F.lower(_c(text)), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda x: x != "")


def token_set(text: Column | str, stop: list[str] | None = None) -> Column:
    """Distinct lower-case runs of a-z and 0-9 without stop words."""
    return F.array_except(F.array_distinct(all_matches(F.lower(_c(text)), "[a-z0-9]+")), F.array(*map(F.lit, STOP_WORDS if stop is None else stop)).cast("array<string>"))


def question_family(text: Column | str) -> Column:
    """The first two words if the first is a question word or auxiliary, else the first; other without words."""
    w = all_matches(F.lower(_c(text)), "[a-z]+")
    return F.when(F.size(w) == 0, "other").when(F.try_element_at(w, F.lit(1)).isin(QUESTION_WORDS), F.array_join(F.slice(w, 1, 2), " ")).otherwise(F.try_element_at(w, F.lit(1)))


def question_prefix(text: Column | str) -> Column:
    """The first three alphanumeric words, unknown without any: another definition, kept under its own name."""
    w = all_matches(F.lower(_c(text)), "[a-z0-9]+")
    return F.when(F.size(w) == 0, "unknown").otherwise(F.array_join(F.slice(w, 1, 3), " "))


#: Classes and the words that tell them; the order decides ties.
CLASS_RULES = [
    ("swimming-pool", ["swimming pool", " pool"]),
    ("tennis-court", ["tennis court"]),
    ("basketball-court", ["basketball court"]),
    ("soccer-field", ["soccer field", "football field"]),
    ("sports-field", ["sports field", "sports area", "sports zone", "playground"]),
    ("parking-lot", ["parking lot", "parking area"]),
    ("ship", [" boat", "ship", "vessel"]),
    ("vehicle", [" car", "vehicle", " truck", " sedan", " van"]),
    ("lake", [" lake", " pond"]),
    ("lawn", [" lawn", "green space", "grassy area", "grass patch"]),
    ("park", [" park", " plaza", "square"]),
    ("settlement", [" town", "village", "settlement"]),
    ("farmland", ["farmland", " field", "grassland"]),
    ("forest", [" forest", "woodland"]),
    ("road", [" road", "intersection", "roundabout", "highway"]),
    ("building", ["building", " house", " roof", "rooftop", "structure"]),
]


def infer_class(text: Column | str, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """The class whose word comes first in what stands before the first full stop; ties in the order of rules, null if none (P25)."""
    sentence = F.substring_index(F.lower(_c(text)), ".", 1)
    hits = [F.struct(F.instr(sentence, k).alias("at"), F.lit(i).alias("rule"), F.lit(name).alias("name")) for i, (name, keys) in enumerate(CLASS_RULES if rules is None else rules) for k in keys]
    return F.array_min(F.filter(F.array(*hits), lambda h: h["at"] > 0))["name"]


def area_bin(ratio: Column | str) -> Column:
    """Log-area bin 0 to 5."""
    raw = F.floor((F.log10(F.greatest(_c(ratio), F.lit(1e-8))) + 5) / 0.8)
    return F.least(F.lit(5), F.greatest(F.lit(0), raw)).cast("int")


def replace_first(text: Column | str, pattern: str, value: str) -> Column:
    """Only the first match is replaced."""
    parts = F.split(_c(text), pattern, 2)
    return F.when(F.size(parts) == 2, F.concat(parts[0], F.lit(value), F.try_element_at(parts, F.lit(2)))).otherwise(_c(text))


#: Opposite spatial words, in the order they are tried.
SPATIAL_FLIPS = [
    ("leftmost", "rightmost"),
    ("rightmost", "leftmost"),
    ("left side", "right side"),
    ("right side", "left side"),
    ("upper-left", "lower-right"),
    ("lower-right", "upper-left"),
    ("upper-right", "lower-left"),
    ("lower-left", "upper-right"),
    ("upper", "lower"),
    ("lower", "upper"),
    ("top", "bottom"),
    ("bottom", "top"),
    ("front", "rear"),
    ("rear", "front"),
    ("inside", "outside"),
    ("outside", "inside"),
    ("above", "below"),
    ("below", "above"),
]


def spatial_flips(text: Column | str, most: int, rules: list[tuple[str, str]] | None = None) -> Column:
    """The lower-cased text with the first match of a rule flipped, for the first `most` rules that match."""
    t = F.lower(_c(text))
    made = [F.when(t.rlike(rf"(?U)\b{w}\b"), replace_first(t, rf"(?U)\b{w}\b", other)) for w, other in (SPATIAL_FLIPS if rules is None else rules)]
    return F.slice(F.filter(F.array(*made), lambda x: x.isNotNull() & (x != t)), 1, most)


def spatial_flip(text: Column | str, rules: list[tuple[str, str]] | None = None) -> Column:
    """The text with the first rule that matches applied once; the lower-cased text if none does."""
    return F.coalesce(F.try_element_at(spatial_flips(text, 1, rules), F.lit(1)), F.lower(_c(text)))


# --- prompts (P3, P4, P9, T17, T19, T21) -------------------------------------------------------

#: Prompt prefixes and their tasks.
PREFIXES = {"VQA": "open_vqa", "CAP": "caption", "REF": "bbox", "CD": "change_caption", "MCQ": "single_choice"}
LONG_PREFIXES = {"caption": "CAP", "vqa": "VQA", "refer": "REF", "change": "CD", "mcq": "MCQ"}


def prompt_task(prompt: Column | str) -> Column:
    """(task, rest): by the bracketed prefix, open_vqa without a known one."""
    tag = F.upper(F.regexp_extract(F.trim(_c(prompt)), r"^\[([A-Za-z]+)\]", 1))
    task = F.element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), tag)
    rest = F.trim(F.regexp_replace(F.trim(_c(prompt)), r"^\[[A-Za-z]+\]\s*", ""))
    return F.struct(F.coalesce(task, F.lit("open_vqa")).alias("task"), F.when(task.isNotNull(), rest).otherwise(F.trim(_c(prompt))).alias("rest"))


def canonical_prefix(prompt: Column | str) -> Column:
    return reduce(lambda c, kv: F.regexp_replace(c, rf"(?i)^\[{kv[0]}\]", f"[{kv[1]}]"), LONG_PREFIXES.items(), _c(prompt))


def option_lines(text: Column | str) -> Column:
    """Lines `(A) text`, A to D, as a map; the last of equal labels counts."""
    rows = F.filter(F.split(_c(text), "\n"), lambda x: x.rlike(r"^\s*\([A-D]\)"))
    entries = F.transform(rows, lambda x: F.struct(F.regexp_extract(x, r"^\s*\(([A-D])\)", 1).alias("k"), F.trim(F.regexp_replace(x, r"^\s*\([A-D]\)", "")).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


def question_stem(text: Column | str) -> Column:
    """What stands before the first option line."""
    return strip(F.element_at(F.split(_c(text), r"(?m)^\s*\(?A[.)]", 2), 1))


#: What a prompt's route is told by, in lower case, and the expert of each task.
CHANGE_WORDS = ["change", "difference", "before", "after", "compare", "changed", "变化", "改变", "差异", "前后", "对比"]
GROUNDING_WORDS = ["where", "location", "position", "find", "locate", "region", "哪里", "位置", "定位", "找到", "区域", "坐标", "框出"]
CAPTION_WORDS = ["describe", "description", "caption", "captioning", "detailed description", "overall description", "partitioned description", "comprehensive inference", "describe the image", "generate a caption", "image caption", "描述", "图像描述", "图片内容", "场景描述"]
CAPTION_MARKERS = ["description is divided into three parts", "partitioned description", "comprehensive inference", "generating a detailed description"]
GROUNDING_MARKERS = ["identify the bounding box", "answer directly with the bounding box", "return the bounding box"]
TASK_EXPERTS = {"vqa": "general", "caption": "caption", "mcq": "general", "referring": "grounding", "change": "change"}


def route_task(prompt: Column | str) -> Column:
    """Which task a prompt sets: by prefix (case counts), caption markers, options, box markers, then words of change, grounding and caption; else vqa."""
    p = strip(F.coalesce(_c(prompt), F.lit("")))
    low = F.lower(p)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    starts = lambda tag: F.startswith(p, F.lit(tag))
    return (
        F.when(starts("[REF]"), "referring").when(starts("[CAP]"), "caption").when(starts("[VQA]"), "vqa").when(starts("[CD]"), "change")
        .when(has(CAPTION_MARKERS), "caption").when(F.contains(p, F.lit("[MCQ]")) | p.rlike(r"\n\(A\) [^\n]+\n\(B\) [^\n]+"), "mcq").when(has(GROUNDING_MARKERS), "referring")
        .when(has(CHANGE_WORDS), "change").when(has(GROUNDING_WORDS), "referring").when(has(CAPTION_WORDS), "caption").otherwise("vqa")
    )


def route(prompt: Column | str) -> Column:
    """Which expert a prompt goes to."""
    table = F.create_map(*[F.lit(x) for kv in TASK_EXPERTS.items() for x in kv])
    return F.element_at(table, route_task(prompt))


def clean_question(text: Column | str) -> Column:
    """Without image tokens, up to the first blank line, single blanks."""
    t = strip(F.replace(_c(text), F.lit("<image>"), F.lit(" ")))
    return F.regexp_replace(strip(F.element_at(F.split(t, r"(?U)\n\s*\n", 2), 1)), r"(?U)\s+", " ")


def normalize_prompt(text: Column | str) -> Column:
    """A target phrase without quotes, its label and end marks, in lower case."""
    t = F.regexp_replace(strip(text), "^[`\"']+|[`\"']+$", "")
    t = F.regexp_replace(t, r"(?iU)^(prompt|target|phrase)\s*:\s*", "")
    return F.regexp_replace(F.lower(strip(F.regexp_replace(t, r"(?U)\s+", " "))), "[.?! ]+$", "")


#: Sentences that are taken out of a problem.
HINT = "Only focus on the objects inside the red bounding box in the image to answer this question."
LETTER_HINT = r"(?i)Answer with the option's letter from the given choices\.?"


def clean_problem(text: Column | str) -> Column:
    """Without image tokens and the two hints, at most one blank line in a row (P20)."""
    t = F.replace(F.replace(F.coalesce(_c(text), F.lit("")), F.lit("<image>"), F.lit("")), F.lit(HINT), F.lit(""))
    return strip(F.regexp_replace(strip(F.regexp_replace(t, "\n{3,}", "\n\n")), LETTER_HINT, ""))


_OPTION_LINE = r"(?mU)^\s*([A-D])\.\s*(.+?)\s*$"


def split_question_options(text: Column | str) -> Column:
    """(stem, options) of a problem with exactly four lines `A. text`; any other number is an error."""
    t = clean_problem(text)
    options = F.transform(all_matches(t, _OPTION_LINE, 2), strip)
    n = F.size(options)
    checked = F.when(n == 4, options).otherwise(F.raise_error(F.concat(F.lit("Expected four A-D choices, found "), n.cast("string"))).cast("array<string>"))
    return F.struct(strip(F.element_at(F.split(t, _OPTION_LINE, 2), 1)).alias("stem"), checked.alias("options"))


def letter_prompt(question: Column | str, options: Column | str) -> Column:
    """A question with its four options as the prompt for a letter."""
    lines = F.zip_with(F.array(*map(F.lit, "ABCD")), F.slice(_c(options), 1, 4), lambda a, o: F.concat(a, F.lit(". "), o))
    return F.concat(F.lit("<image>\n"), _c(question), F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\nRespond with only the correct option letter."))


def portable_path(path: Column | str, roots: dict[str, str]) -> Column:
    """The longest known root is replaced; a path under none of them is an error."""
    p, out = _c(path), None
    for root in sorted(roots, key=len, reverse=True):
        hit = F.when(F.startswith(p, F.lit(root)), F.concat(F.lit(roots[root]), F.substr(p, F.lit(len(root) + 1))))
        out = hit if out is None else F.coalesce(out, hit)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("no known root: "), p)).cast("string"))

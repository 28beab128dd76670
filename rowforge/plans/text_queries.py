"""Queries of text, answer, box and hashing columns (T*, B*, H*, P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.functions import boxes as B
from rowforge.functions import hashing as H
from rowforge.functions import text as X
from rowforge.operators import normalise as N

from .registry import query

_NORM = "trim(regexp_replace({}, '[^a-z0-9.+-]+', ' ', 'g'))"


@query("t1_normalize_answer", f"SELECT doc_id, {_NORM.format('lower(text)')} AS norm FROM documents")
def _(t):
    return t("documents").select("doc_id", X.normalize_answer("text").alias("norm"))


@query("t1_normalize_alias", f"SELECT p_partkey, {_NORM.format(chr(39).join(['regexp_replace(lower(replace(p_name, ', ' ', ', ', ' grey ', ')), ', chr(92) + 'bgrey' + chr(92) + 'b', ', ', 'gray', ', ', 'g', ')']))} AS norm FROM part")
def _(t):
    return t("part").select("p_partkey", X.normalize_answer(F.replace("p_name", F.lit(" "), F.lit(" grey ")), aliases=True).alias("norm"))


@query("t2_normalize_qa", r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(translate(lower('The ' || p_name || ', an ' || p_brand || ' theory'), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM part""")
def _(t):
    return t("part").select("p_partkey", X.normalize_qa(F.concat(F.lit("The "), "p_name", F.lit(", an "), "p_brand", F.lit(" theory"))).alias("norm"))


@query("t3_exact_and_substring", "SELECT o_orderkey, lower(o_orderpriority) IN ('1-urgent', '2-high') AS em, contains(lower(o_orderpriority), 'high') AS sub FROM orders")
def _(t):
    golds = F.array(F.lit("1 URGENT!"), F.lit("The 2-high"))
    p = F.replace("o_orderpriority", F.lit("-"), F.lit(" "))
    return t("orders").select("o_orderkey", X.exact_match(p, F.array(F.lit("1 URGENT!"), F.lit("The 2 high"))).alias("em"), X.substring_match(p, F.array(F.lit("HIGH"))).alias("sub"))


@query("t6_labels_by_text", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN ['A'] WHEN 'MACHINERY' THEN ['B'] ELSE [] END AS labels FROM customer")
def _(t):
    choices = F.create_map(F.lit("A"), F.lit("Building."), F.lit("B"), F.lit(" machinery!"))
    return t("customer").select("c_custkey", F.transform(X.labels_by_text(F.concat("c_mktsegment", F.lit("?")), F.map_from_arrays(F.map_keys(choices), F.transform(F.map_values(choices), lambda v: F.regexp_replace(v, "[.!]", "?")))), lambda x: x).alias("labels"))


@query("t12_strict_accuracy", "SELECT c_mktsegment, avg(CASE WHEN lower(trim(c_name)) = lower('customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')) THEN 1.0 ELSE 0.0 END) AS accuracy FROM customer GROUP BY 1")
def _(t):
    ref = F.concat(F.lit(" CUSTOMER#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return t("customer").groupBy("c_mktsegment").agg(F.avg(X.same_ignoring_case("c_name", ref).cast("double")).alias("accuracy"))


@query("t14_answer_envelope", "SELECT p_partkey, p_name AS inside, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS last_tag FROM part")
def _(t):
    said = F.concat(F.lit("<think>a</think> <answer> "), "p_name", F.lit(" </answer>"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<answer>"), "p_brand", F.lit("</answer>"))).otherwise(""))
    return t("part").select("p_partkey", X.answer_envelope(said).alias("inside"), X.last_answer_tag(said).alias("last_tag"))


@query("t4_em_reward", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 0.0 WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.25 END AS reward FROM part")
def _(t):
    tag = F.lit("<answer>the Gold</answer>")
    said = F.when(F.col("p_size") > 25, "gold").when(F.col("p_size") % 2 == 0, tag).otherwise(F.repeat(tag, 11))
    return t("part").select("p_partkey", X.em_reward(said, F.array(F.lit("gold."))).alias("reward"))


@query("t15_rule_cascade", "SELECT o_orderkey, o_totalprice > 100000 AS correct, 'decimal' AS source FROM orders")
def _(t):
    price = F.format_number("o_totalprice", 2)
    x = X.rule_cascade(price, F.when(F.col("o_totalprice") > 100000, F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string")).otherwise("-1"))
    return t("orders").select("o_orderkey", x["correct"].alias("correct"), x["source"].alias("source"))


@query("t24_gsm8k", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS strict, CAST(o_custkey AS VARCHAR) AS flexible FROM orders")
def _(t):
    said = F.concat(F.lit("so 12 apples. #### "), F.col("o_custkey").cast("string"))
    return t("orders").select("o_orderkey", X.gsm8k_number(said).alias("strict"), X.gsm8k_number(said, strict=False).alias("flexible"))


@query("p3_prompt_prefix", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'caption' WHEN 'P' THEN 'bbox' ELSE 'open_vqa' END AS task, o_orderpriority AS rest FROM orders")
def _(t):
    x = X.prompt_task(F.concat(F.when(F.col("o_orderstatus") == "F", "[CAP] ").when(F.col("o_orderstatus") == "P", "[ref]").otherwise(""), "o_orderpriority"))
    return t("orders").select("o_orderkey", x["task"].alias("task"), x["rest"].alias("rest"))


@query("p4_option_lines", "SELECT p_partkey, p_type AS a, p_brand AS b FROM part")
def _(t):
    m = X.option_lines(F.concat(F.lit("q\n(A) old\n (B)  "), "p_brand", F.lit("\n(A) "), "p_type"))
    return t("part").select("p_partkey", F.element_at(m, "A").alias("a"), F.element_at(m, "B").alias("b"))


@query("p9_canonical_prefix", "SELECT n_nationkey, '[CAP] ' || n_name AS prompt FROM nation")
def _(t):
    return t("nation").select("n_nationkey", X.canonical_prefix(F.concat(F.lit("[Caption] "), "n_name")).alias("prompt"))


@query("p22_portable_path", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 's/' || substr(url, 9) ELSE 'p/' || substr(url, 8) END AS path FROM pages")
def _(t):
    return t("pages").select("page_id", X.portable_path("url", {"http://": "p/", "https://": "s/"}).alias("path"))


@query("p28_area_bin", "SELECT l_orderkey, l_linenumber, CAST(least(5, greatest(0, floor((log10(greatest(l_discount / 10, 1e-8)) + 5) / 0.8))) AS INTEGER) AS bin FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", X.area_bin(F.col("l_discount") / 10).alias("bin"))


@query("p29_long_format", "SELECT p_partkey, 'size' AS metric, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def _(t):
    return N.long_format(t("part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")), ["p_partkey"], ["size", "price"])


@query("p30_shard_name", "SELECT DISTINCT source, source || '_' || lang AS shard FROM documents")
def _(t):
    return t("documents").select("source", N.shard_name("source", "lang").alias("shard")).distinct()


@query("p1_p11_messages", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS prompt, count(*) AS parts FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(t):
    part = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), F.col("text").alias("text"))
    turn = t("conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("p"))
    rows = turn.select("conv_id", F.array(F.struct(F.lit("user").alias("role"), F.transform("p", lambda x: x["part"]).alias("content"))).alias("messages"))
    return N.from_messages(rows).select("conv_id", "prompt", F.size(F.element_at("messages", 1)["content"]).cast("long").alias("parts"))


@query("p15_explode_references", "SELECT conv_id, turn - 1 AS reference_index, text AS reference FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, text FROM conversations)")
def _(t):
    refs = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    return N.explode_references(refs.select("conv_id", F.transform("r", lambda x: x["text"]).alias("references"))).select("conv_id", F.col("reference_index").cast("long").alias("reference_index"), "reference")


@query(
    "p14_subtask_choices",
    """SELECT p_partkey AS key, 'img/' || p_partkey || '.png' AS path, '[MCQ] ' || p_name || chr(10) || '(A) ' || p_brand || chr(10) || '(B) none' AS asked,
       CASE p_partkey % 3 WHEN 0 THEN 'A. (A) ' || p_brand WHEN 1 THEN 'B. (B) none' ELSE 'E' END AS answer FROM part WHERE p_size % 2 = 0 AND p_partkey % 5 <> 0""",
)
def _(t):
    p, k = t("part"), F.col("p_partkey")
    entries = p.select(
        F.when(F.col("p_size") % 2 == 0, N.REMOTE_SENSING).otherwise("Monitoring").alias("Subtask"), k.cast("string").alias("Image"), F.col("p_name").alias("Text"),
        F.array(F.concat(F.lit("(A) "), "p_brand"), F.lit("(B) none")).alias("Answer choices"), F.element_at(F.array(*map(F.lit, "ABE")), (k % 3 + 1).cast("int")).alias("Ground truth"),
    )
    files = p.where("p_partkey % 5 <> 0").select(k.cast("string").alias("name"), F.concat(F.lit("img/"), k.cast("string"), F.lit(".png")).alias("path"))
    turn = lambda i, j: F.col("messages")[i]["content"][j]
    return N.subtask_choices(entries, files).select(F.col("image").cast("long").alias("key"), turn(0, 0)["image"].alias("path"), turn(0, 1)["text"].alias("asked"), turn(1, 0)["text"].alias("answer"))


@query("p27_question_prefix", "SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 'unknown' ELSE array_to_string(w[1:3], ' ') END AS prefix FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations)")
def _(t):
    return t("conversations").select("conv_id", "turn", X.question_prefix("text").alias("prefix"))


@query(
    "u10_synthetic_mcq",
    r"""WITH pool AS (SELECT DISTINCT p_type AS o, lower(regexp_replace(trim(regexp_replace(p_type, '\s+', ' ', 'g')), ' +', ' ', 'g')) AS folded FROM part WHERE p_type IS NOT NULL),
       ranked AS (SELECT o, folded, row_number() OVER (ORDER BY sha256('42:pool:' || folded), folded, o) - 1 AS spot FROM pool),
       own AS (SELECT o AS answer, min(spot) OVER (PARTITION BY folded) AS first, count(*) OVER (PARTITION BY folded) AS forms, count(*) OVER () - count(*) OVER (PARTITION BY folded) AS others FROM ranked),
       asked AS (SELECT p_partkey, p_name AS question, p_type AS answer, first, forms, others, CAST('0x' || left(sha256('42:ask:' || p_partkey), 8) AS BIGINT) AS start FROM part LEFT JOIN own ON p_type = answer),
       places AS (SELECT p_partkey, answer, first, forms, (start + unnest([0, 1, 2]) * (others // 3)) % others AS p FROM asked WHERE others >= 3),
       four AS (SELECT p_partkey, o FROM places JOIN ranked ON spot = p + CASE WHEN p >= first THEN forms ELSE 0 END UNION ALL SELECT p_partkey, answer FROM asked WHERE others >= 3),
       shown AS (SELECT p_partkey, list(o ORDER BY sha256('43:' || p_partkey || ':' || o), o) AS options FROM four GROUP BY ALL)
       SELECT p_partkey, question, options, substr('ABCD', CAST(list_position(options, answer) AS BIGINT), 1) AS label FROM asked LEFT JOIN shown USING (p_partkey)""",
)
def _(t):
    return N.synthetic_mcq(t("part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_type").alias("answer")), "p_partkey", "question", "answer", 42)


# --- hashing -----------------------------------------------------------------------------------


@query("h1_stable_id", "SELECT doc_id, left(sha256(source || chr(31) || lang || chr(31) || CAST(doc_id AS VARCHAR)), 20) AS id FROM documents")
def _(t):
    return t("documents").select("doc_id", H.stable_id("source", "lang", "doc_id").alias("id"))


@query("h2_rank_keys", "SELECT doc_id, sha256('42:' || doc_id) AS k1, sha256('42|split|' || source) AS k2 FROM documents")
def _(t):
    return t("documents").select("doc_id", H.rank_key(42, "doc_id").alias("k1"), H.namespaced_key(42, "split", "source").alias("k2"))


@query("h5_text_sha256", "SELECT page_id, sha256(html) AS digest FROM pages")
def _(t):
    return t("pages").select("page_id", F.sha2("html", 256).alias("digest"))


@query("h8_token_budget", "SELECT l_orderkey, l_linenumber, CAST(256 * pow(2, least(l_linenumber - 1, 2)) AS INTEGER) AS budget FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", H.token_budget(F.lit(256), F.col("l_linenumber") - 1).alias("budget"))


# --- boxes -------------------------------------------------------------------------------------

_BOX = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS x1, CAST(l_linenumber * 3 AS INTEGER) AS y1, CAST(l_quantity + l_tax * 500 AS INTEGER) AS x2, CAST(l_linenumber * 3 + l_discount * 300 AS INTEGER) AS y2, CAST(l_quantity + l_discount * 200 AS INTEGER) AS u1 FROM lineitem"


def _boxes(t):
    i = lambda c: F.bround(c).cast("int")
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", i(q).alias("x1"), (n * 3).cast("int").alias("y1"), i(q + F.col("l_tax") * 500).alias("x2"), i(n * 3 + F.col("l_discount") * 300).alias("y2"), i(q + F.col("l_discount") * 200).alias("u1"))


@query("b1_parse_percent", f"SELECT l_orderkey, l_linenumber, CASE WHEN x1 <> x2 AND y1 <> y2 THEN [least(x1, x2), least(y1, y2), greatest(x1, x2), greatest(y1, y2)]::DOUBLE[] END AS box FROM ({_BOX})")
def _(t):
    said = F.concat(F.lit("x1: "), F.col("x1").cast("string"), F.lit(", y1="), F.col("y1").cast("string"), F.lit("; x2 "), F.col("x2").cast("string"), F.lit(" y2 "), F.col("y2").cast("string"), F.lit(" 77"))
    return B.with_percent_box(_boxes(t), said, "box").select("l_orderkey", "l_linenumber", "box")


@query("b2_parse_native", f"SELECT l_orderkey, l_linenumber, [x1, y1, x2, y2]::DOUBLE[] AS angle, [x1, y1, x2, y2]::DOUBLE[] AS square FROM ({_BOX})")
def _(t):
    c = [F.col(x).cast("string") for x in ("x1", "y1", "x2", "y2")]
    return _boxes(t).select("l_orderkey", "l_linenumber", B.parse_native(F.concat(F.lit("at {<"), F.concat_ws("><", *c), F.lit(">}"))).alias("angle"), B.parse_native(F.concat(F.lit("["), F.concat_ws(", ", *c), F.lit("]"))).alias("square"))


@query("b3_to_unit", f"SELECT l_orderkey, l_linenumber, list_transform([x1, y1, x2, y2], lambda v: v / CASE WHEN greatest(x1, y1, x2, y2) <= 1 THEN 1.0 WHEN greatest(x1, y1, x2, y2) <= 100 THEN 100.0 ELSE 1000.0 END) AS box FROM ({_BOX})")
def _(t):
    b = F.array(*[F.col(x).cast("double") for x in ("x1", "y1", "x2", "y2")])
    return _boxes(t).select("l_orderkey", "l_linenumber", B.to_unit(b).alias("box"))


@query("b4_b5_native_forms", f"SELECT l_orderkey, l_linenumber, list_transform([x1, y1, x2, y2], lambda v: v / 100.0) AS full_box, [-x1 - 1, y1, x2, y2]::DOUBLE[] AS signed_box FROM ({_BOX})")
def _(t):
    c = [F.col(x).cast("string") for x in ("x1", "y1", "x2", "y2")]
    s = F.concat(F.lit("{<"), F.concat_ws("><", *c), F.lit(">}"))
    return _boxes(t).select("l_orderkey", "l_linenumber", B.parse_full_native(s).alias("full_box"), B.parse_signed_angle(F.concat(F.lit("{<-"), F.concat_ws("><", (F.col("x1") + 1).cast("string"), *c[1:]), F.lit(">}"))).alias("signed_box"))


@query("b6_pixels_to_percent", f"SELECT l_orderkey, l_linenumber, [round_even(least(100, greatest(0, x1 / 64.0 * 100)), 0), round_even(least(100, y1 / 32.0 * 100), 0)]::INTEGER[] AS box FROM ({_BOX})")
def _(t):
    b = F.array(*[F.col(x).cast("double") for x in ("x1", "y1", "x2", "y2")])
    return _boxes(t).select("l_orderkey", "l_linenumber", F.slice(B.pixels_to_percent(b, F.lit(64), F.lit(32)), 1, 2).alias("box"))


def _iou_sql(p: str) -> str:
    i = f"greatest(0, least(x2, x2 + 5) - greatest(x1, u1) + {p}) * greatest(0, least(y2, y2 + 2) - greatest(y1, y1 + 1) + {p})"
    u = f"((x2 - x1 + {p}) * (y2 - y1 + {p}) + (x2 + 5 - u1 + {p}) * (y2 + 2 - y1 - 1 + {p}) - {i})"
    return f"CASE WHEN {u} > 0 THEN {i} / {u} ELSE 0.0 END"


@query("b7_iou", f"SELECT l_orderkey, l_linenumber, {_iou_sql('0.0')} AS iou, {_iou_sql('1.0')} AS iou_inclusive FROM ({_BOX})")
def _(t):
    f = lambda *c: F.array(*[x.cast("double") for x in c])
    c = F.col
    a, b = f(c("x1"), c("y1"), c("x2"), c("y2")), f(c("u1"), c("y1") + 1, c("x2") + 5, c("y2") + 2)
    return _boxes(t).select("l_orderkey", "l_linenumber", B.iou(a, b).alias("iou"), B.iou(a, b, True).alias("iou_inclusive"))


@query("b10_conversions", f"SELECT l_orderkey, l_linenumber, [x1, y1, x2 - x1, y2 - y1]::DOUBLE[] AS xywh, [(x1 + x2) / 2.0, (y1 + y2) / 2.0, x2 - x1, y2 - y1]::DOUBLE[] AS cxcywh, [x1, y1, x2, y2]::DOUBLE[] AS back, [greatest(0, least(x1, 30)), greatest(0, least(y1, 10)), greatest(0, least(x2, 30)), greatest(0, least(y2, 10))]::DOUBLE[] AS clipped FROM ({_BOX})")
def _(t):
    b = F.array(*[F.col(x).cast("double") for x in ("x1", "y1", "x2", "y2")])
    return _boxes(t).select("l_orderkey", "l_linenumber", B.xyxy_to_xywh(b).alias("xywh"), B.xyxy_to_cxcywh(b).alias("cxcywh"), B.xywh_to_xyxy(B.xyxy_to_xywh(b)).alias("back"), B.clip(b, 30, 10).alias("clipped"))


@query("b11_ioa_distance", f"SELECT l_orderkey, l_linenumber, sqrt(pow(greatest(x1 - 20, 0, 20 - x2), 2) + pow(greatest(y1 - 9, 0, 9 - y2), 2)) AS distance FROM ({_BOX})")
def _(t):
    b = F.array(*[F.col(x).cast("double") for x in ("x1", "y1", "x2", "y2")])
    return _boxes(t).select("l_orderkey", "l_linenumber", B.point_distance(F.lit(20.0), F.lit(9.0), b).alias("distance"))


@query("b12_box_score", f"SELECT l_orderkey, l_linenumber, CASE WHEN x1 < x2 AND y1 < y2 THEN 1.0 ELSE 0.0 END AS clean_iou, x1 < x2 AND y1 < y2 AS format_valid FROM ({_BOX})")
def _(t):
    s = F.concat(F.lit("["), F.concat_ws(", ", *[F.col(x).cast("string") for x in ("x1", "y1", "x2", "y2")]), F.lit("]"))
    return B.with_score(_boxes(t).withColumn("said", s), "said", "said").select("l_orderkey", "l_linenumber", "clean_iou", "format_valid")



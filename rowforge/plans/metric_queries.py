"""Queries of similarity metrics, detection, tracking and vector selection (M*, V*, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.functions import registry as U
from rowforge.functions.text import ascii_tokens, unicode_tokens
from rowforge.operators import ngrams as M
from rowforge.operators import vision as V

from .registry import query

_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+(?:''[a-z0-9]+)?')"
#: Benchmark items against the next item: predictions and references of similar make.
_PAIRS = "(SELECT a.item_id AS id, a.text AS prediction, b.text AS reference FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"


def _pairs(t):
    b = t("benchmark")
    other = b.select((F.col("item_id") - 1).alias("id"), F.array("text").alias("references"))
    return b.select(F.col("item_id").alias("id"), F.col("text").alias("prediction")).join(other, "id")


@query("m1_ascii_tokens", f"SELECT item_id, {_TOK.format('text')} AS tokens FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", ascii_tokens("text").alias("tokens"))


@query("m2_unicode_tokens", r"SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS tokens FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", unicode_tokens("text").alias("tokens"))


@query("m3_gram_counts", f"WITH w AS (SELECT item_id, {_TOK.format('text')} AS l FROM benchmark), g AS (SELECT item_id, unnest(list_transform(generate_series(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1])) AS gram FROM w) SELECT item_id, 2 AS n, gram, count(*) AS count FROM g GROUP BY ALL")
def _(t):
    return M.gram_counts(t("benchmark").select("item_id", ascii_tokens("text").alias("t")), ["item_id"], "t", range(2, 3))


def _gram_sql(n: int, col: str, table: str) -> str:
    gram = " || ' ' || ".join(f"l[i + {k}]" if k else "l[i]" for k in range(n))
    return f"SELECT id, {n} AS n, unnest(list_transform(generate_series(1, len(l) - {n - 1}), lambda i: {gram})) AS gram FROM (SELECT id, {_TOK.format(col)} AS l FROM {table})"


def _grams(col: str) -> str:
    return "SELECT id, n, gram, count(*) AS c FROM (" + " UNION ALL ".join(_gram_sql(n, col, _PAIRS) for n in range(1, 5)) + ") GROUP BY ALL"


_BLEU = f"""WITH c AS ({_grams('prediction')}), r AS ({_grams('reference')}),
 p AS (SELECT c.n, sum(least(c.c, coalesce(r.c, 0))) AS hit, sum(c.c) AS total FROM c LEFT JOIN r USING (id, n, gram) GROUP BY c.n),
 l AS (SELECT sum(len({_TOK.format('prediction')})) AS c, sum(len({_TOK.format('reference')})) AS r FROM {_PAIRS}),
 b AS (SELECT CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END AS bp FROM l)
 SELECT bp * (SELECT CASE WHEN min(hit) = 0 THEN 0 ELSE exp(sum(ln(hit / total))) END FROM p WHERE n <= 1) AS bleu_1, bp * (SELECT CASE WHEN min(hit) = 0 THEN 0 ELSE exp(sum(ln(greatest(hit, 1) / total)) / 2) END FROM p WHERE n <= 2) AS bleu_2,
 bp * (SELECT CASE WHEN min(hit) = 0 THEN 0 ELSE exp(sum(ln(greatest(hit, 1) / total)) / 3) END FROM p WHERE n <= 3) AS bleu_3, bp * (SELECT CASE WHEN min(hit) = 0 THEN 0 ELSE exp(sum(ln(greatest(hit, 1) / total)) / 4) END FROM p WHERE n <= 4) AS bleu_4 FROM b"""


@query("m4_corpus_bleu", _BLEU)
def _(t):
    return M.corpus_bleu(_pairs(t))


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"


def _word_grams(col: str) -> str:
    return _grams(col).replace(_TOK.format(col), _WORDS.format(col))


def _smoothed(order: int) -> str:
    return f"bp * (SELECT CASE WHEN count(*) < {order} THEN 0 ELSE exp(sum(ln(CASE WHEN hit = 0 THEN 0.1 ELSE hit END / total)) / {order}) END FROM p WHERE n <= {order}) AS bleu_{order}"


_SMOOTHED = f"""WITH c AS ({_word_grams('prediction')}), r AS ({_word_grams('reference')}),
 p AS (SELECT c.n, CAST(sum(least(c.c, coalesce(r.c, 0))) AS DOUBLE) AS hit, sum(c.c) AS total FROM c LEFT JOIN r USING (id, n, gram) GROUP BY c.n),
 l AS (SELECT sum(len({_WORDS.format('prediction')})) AS c, sum(len({_WORDS.format('reference')})) AS r FROM {_PAIRS}),
 b AS (SELECT CASE WHEN c = 0 THEN 0 WHEN c > r THEN 1 ELSE exp(1 - r / c) END AS bp FROM l) SELECT {', '.join(_smoothed(n) for n in range(1, 5))} FROM b"""


@query("m5_smoothed_bleu", _SMOOTHED)
def _(t):
    return M.corpus_bleu(_pairs(t), unicode_tokens, smooth=True)


_CIDER = f"""WITH c AS ({_grams('prediction')}), r AS ({_grams('reference')}), d AS (SELECT n, gram, count(DISTINCT id) AS df FROM r GROUP BY ALL), k AS (SELECT count(*) AS docs FROM {_PAIRS}),
 wc AS (SELECT c.id, c.n, c.gram, c.c / sum(c.c) OVER (PARTITION BY c.id, c.n) * ln((docs + 1) / (coalesce(df, 0) + 1)) AS w FROM c LEFT JOIN d USING (n, gram), k),
 wr AS (SELECT r.id, r.n, r.gram, r.c / sum(r.c) OVER (PARTITION BY r.id, r.n) * ln((docs + 1) / (coalesce(df, 0) + 1)) AS w FROM r LEFT JOIN d USING (n, gram), k),
 s AS (SELECT id, n, (SELECT sum(a.w * b.w) FROM wc a JOIN wr b USING (id, n, gram) WHERE a.id = x.id AND a.n = x.n) / nullif(sqrt((SELECT sum(w * w) FROM wc WHERE wc.id = x.id AND wc.n = x.n)) * sqrt((SELECT sum(w * w) FROM wr WHERE wr.id = x.id AND wr.n = x.n)), 0) AS v FROM (SELECT DISTINCT id, n FROM wc) x)
 SELECT id, 10 * sum(coalesce(v, 0)) / 4 AS score FROM s GROUP BY id"""


@query("m10_cider_proxy", _CIDER)
def _(t):
    return M.cider_proxy(_pairs(t))


def rouge_sql(tokens: str) -> str:
    """A row of the table of common subsequences for each token of the prediction."""
    return f"""WITH RECURSIVE t AS (SELECT id, {tokens.replace("{}", "prediction")} AS a, {tokens.replace("{}", "reference")} AS b FROM {_PAIRS}),
 g(id, i, row) AS (SELECT id, CAST(0 AS BIGINT), list_transform(b, lambda x: CAST(0 AS BIGINT)) FROM t
   UNION ALL SELECT g.id, i + 1, list_reduce(generate_series(1, len(b)), lambda acc, j: list_append(acc, CASE WHEN b[j] = a[i + 1] THEN (CASE WHEN j > 1 THEN row[j - 1] ELSE 0 END) + 1 ELSE greatest(row[j], CASE WHEN j > 1 THEN acc[j - 1] ELSE 0 END) END), CAST([] AS BIGINT[])) FROM g JOIN t USING (id) WHERE i < len(a)),
 l AS (SELECT id, coalesce(row[len(row)], 0) AS k FROM g QUALIFY i = max(i) OVER (PARTITION BY id))
 SELECT id, round(CASE WHEN k = 0 THEN 0.0 ELSE 2 * (k / len(a)) * (k / len(b)) / (k / len(a) + k / len(b)) END, 9) AS score FROM l JOIN t USING (id)"""


def _meteor_sql(tokens: str, backend: str) -> str:
    """The k-th place of a word in the prediction goes with its k-th place in the reference."""
    return f"""WITH t AS (SELECT id, {tokens.replace("{}", "prediction")} AS a, {tokens.replace("{}", "reference")} AS b FROM {_PAIRS}),
 x AS (SELECT *, row_number() OVER (PARTITION BY id, w ORDER BY i) AS k FROM (SELECT id, unnest(a) AS w, unnest(generate_series(1, len(a))) AS i FROM t)), y AS (SELECT *, row_number() OVER (PARTITION BY id, w ORDER BY j) AS k FROM (SELECT id, unnest(b) AS w, unnest(generate_series(1, len(b))) AS j FROM t)),
 p AS (SELECT id, i, j, i - lag(i) OVER o AS di, j - lag(j) OVER o AS dj FROM x JOIN y USING (id, w, k) WINDOW o AS (PARTITION BY id ORDER BY i)),
 m AS (SELECT id, count(*) AS m, 1 + count(*) FILTER (WHERE di IS NOT NULL AND (di <> 1 OR dj <> 1)) AS chunks FROM p GROUP BY id)
 SELECT id, round(CASE WHEN m IS NULL THEN 0.0 ELSE 10 * (m / len(a)) * (m / len(b)) / (m / len(b) + 9 * (m / len(a))) * (1 - 0.5 * pow(chunks / m, 3)) END, 9) AS score, '{backend}' AS backend FROM t LEFT JOIN m USING (id)"""


@query("m6_rouge_l", rouge_sql(_TOK))
def _(t):
    return M.rouge_l(_pairs(t)).withColumn("score", F.round("score", 9))


@query("m8_meteor_exact", _meteor_sql(_TOK, "exact"))
def _(t):
    return M.meteor(_pairs(t)).withColumn("score", F.round("score", 9))


_STEM = f"list_transform(list_transform(list_transform({_TOK}, lambda w: CASE WHEN regexp_matches(w, '(ss|us|is)$') THEN w ELSE regexp_replace(w, '([a-z][a-z][a-z])s$', '\\1') END), lambda w: regexp_replace(w, 'ie$', 'y')), lambda w: regexp_replace(w, '([a-z][a-z][a-z])(ing|ed|ly)$', '\\1'))"


@query("m9_meteor_stem", _meteor_sql(_STEM, "stem"))
def _(t):
    return M.meteor(_pairs(t), stem=True).withColumn("score", F.round("score", 9))


def _consensus(weight: str, product: str, factor: str) -> str:
    """Vectors of weights by order, their products over norms, the mean of four orders times 10."""
    side = lambda x: f"SELECT {x}.id, {x}.n, {x}.gram, {x}.c, {weight.format(x)} AS w FROM {x} LEFT JOIN d USING (n, gram), k"
    return f"""WITH c AS ({_word_grams('prediction')}), r AS ({_word_grams('reference')}), d AS (SELECT n, gram, count(DISTINCT id) AS df FROM r GROUP BY ALL), k AS (SELECT count(*) AS docs FROM {_PAIRS}),
 wc AS ({side('c')}), wr AS ({side('r')}), o AS (SELECT id, unnest([1, 2, 3, 4]) AS n FROM {_PAIRS}),
 na AS (SELECT id, n, sqrt(sum(w * w)) AS a FROM wc GROUP BY ALL), nb AS (SELECT id, n, sqrt(sum(w * w)) AS b FROM wr GROUP BY ALL),
 dot AS (SELECT id, n, sum({product}) AS dot FROM wc a JOIN wr b USING (id, n, gram) GROUP BY ALL),
 ca AS (SELECT id, sum(c) AS ca FROM c WHERE n = 2 GROUP BY id), cb AS (SELECT id, sum(c) AS cb FROM r WHERE n = 2 GROUP BY id),
 s AS (SELECT id, CASE WHEN a > 0 AND b > 0 THEN coalesce(dot, 0) / (a * b) ELSE 0 END * {factor} AS v FROM o LEFT JOIN na USING (id, n) LEFT JOIN nb USING (id, n) LEFT JOIN dot USING (id, n) LEFT JOIN ca USING (id) LEFT JOIN cb USING (id))
 SELECT id, 10 * avg(v) AS score FROM s GROUP BY id"""


@query("m11_cider_d", _consensus("{0}.c * (ln(docs) - ln(greatest(1, coalesce(df, 0))))", "least(a.w, b.w) * b.w", "exp(-power(coalesce(ca, 0) - coalesce(cb, 0), 2) / 72)"))
def _(t):
    return M.cider_d(_pairs(t))


@query("m12_cider_variant", _consensus("{0}.c / max({0}.c) OVER (PARTITION BY {0}.id, {0}.n) * (ln((docs + 1) / (coalesce(df, 0) + 1)) + 1)", "a.w * b.w", "1"))
def _(t):
    return M.cider_variant(_pairs(t))


@query("m14_caption_summary")
def _(t):
    return M.caption_summary(_pairs(t))


# --- vectors -----------------------------------------------------------------------------------


def _tokens(t):
    return t("embeddings").select(F.col("label").alias("group_id"), F.col("vec_id").alias("token_id"), "embedding")


@query("v17_norm_top_k_whole", "SELECT label AS group_id, vec_id AS token_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) DESC, vec_id) <= 5")
def _(t):
    return V.norm_top_k(_tokens(t), "group_id", "token_id", "embedding", 5).select("group_id", "token_id")


@query("v18_divprune")
def _(t):
    return V.select_tokens(_tokens(t), "group_id", "token_id", "embedding", "divprune", 8)


@query("v19_mmtok")
def _(t):
    return V.select_tokens(_tokens(t), "group_id", "token_id", "embedding", "mmtok", 8)


@query("v20_scope_l2")
def _(t):
    return V.select_tokens(_tokens(t), "group_id", "token_id", "embedding", "scope_l2", 8)


@query("v21_uniform", "WITH r AS (SELECT label AS group_id, vec_id AS token_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT group_id, token_id FROM r WHERE list_contains(list_transform(generate_series(0, least(n, 7) - 1), lambda i: CAST(round_even(i * (n - 1) / (least(n, 7) - 1), 0) AS BIGINT)), p)")
def _(t):
    return V.uniform_tokens(_tokens(t), "group_id", "token_id", 7).select("group_id", "token_id")


@query("v22_random_tokens", "SELECT label AS group_id, vec_id AS token_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha256('3|' || label || '|' || vec_id), vec_id) <= 6")
def _(t):
    return V.random_tokens(_tokens(t), "group_id", "token_id", 6, 3).select("group_id", "token_id")


#: The two halves of a vector as distributions.
_LEFT, _RIGHT = "embedding[1 : len(embedding) // 2]", "embedding[len(embedding) // 2 + 1 : 2 * (len(embedding) // 2)]"
_P, _Q = (f"list_transform({h}, lambda x: (abs(x) + 0.01) / (list_sum(list_transform({h}, lambda y: abs(y))) + 0.01 * (len(embedding) // 2)))" for h in (_LEFT, _RIGHT))


@query("v24_divergences", f"WITH d AS (SELECT vec_id, {_P.replace('abs(x)', 'CAST(abs(x) AS DOUBLE)').replace('abs(y)', 'CAST(abs(y) AS DOUBLE)')} AS p, {_Q.replace('abs(x)', 'CAST(abs(x) AS DOUBLE)').replace('abs(y)', 'CAST(abs(y) AS DOUBLE)')} AS q FROM embeddings) SELECT vec_id, list_sum(list_transform(list_zip(p, q), lambda z: z[1] * ln(z[1] / z[2]))) AS kl, list_sum(list_transform(list_zip(p, q), lambda z: 0.5 * z[1] * ln(z[1] / (0.5 * (z[1] + z[2]))) + 0.5 * z[2] * ln(z[2] / (0.5 * (z[1] + z[2]))))) AS jsd FROM d")
def _(t):
    half = F.floor(F.size("embedding") / 2).cast("int")

    def part(lo):
        s = F.transform(F.slice("embedding", lo, half), lambda x: F.abs(x).cast("double"))
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
        return F.transform(s, lambda x: (x + 0.01) / (total + 0.01 * half))

    d = t("embeddings").select("vec_id", part(F.lit(1)).alias("p"), part(half + 1).alias("q"))
    return d.select("vec_id", V.kl("p", "q").alias("kl"), V.jsd("p", "q").alias("jsd"))


@query("v24_kl_estimates", "SELECT l_orderkey, l_linenumber, l_tax - l_discount AS k1, abs(l_tax - l_discount) AS k_abs, 0.5 * pow(l_tax - l_discount, 2) AS k2, exp(-(l_tax - l_discount)) - 1 + (l_tax - l_discount) AS k3 FROM lineitem")
def _(t):
    e = lambda k, n: V.kl_estimate(F.col("l_tax"), F.col("l_discount"), k).alias(n)
    return t("lineitem").select("l_orderkey", "l_linenumber", e("k1", "k1"), e("abs", "k_abs"), e("k2", "k2"), e("k3", "k3"))


@query("v25_sparse_logprobs", "SELECT n_nationkey, n_name AS best FROM nation")
def _(t):
    text = F.format_string('[{"token":"z","logprob":-9.5},{"token":"%s","logprob":-0.1}]', "n_name")
    return t("nation").select("n_nationkey", V.sparse_logprobs(text, 1)[0]["token"].alias("best"))


# --- detection and tracking --------------------------------------------------------------------


def _detections(t):
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    box = F.array(q, q, q + 10 + d * 100, q + 10 + x * 100)
    return t("lineitem").select(F.col("l_partkey").alias("image"), F.col("l_returnflag").alias("cls"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("prediction_id"), (F.col("l_extendedprice") / 100000).alias("score"), box.alias("box"))


@query("v2_tube_iou", "WITH b AS (SELECT l_orderkey AS video, l_linenumber AS frame, avg(l_quantity) AS q, avg(l_tax) * 100 AS s FROM lineitem GROUP BY 1, 2) SELECT video, sum(CASE WHEN frame > 1 THEN greatest(0, s + 5 - 3) * (s + 5) ELSE 0 END) / sum((s + 5) * (s + 5) + CASE WHEN frame > 1 THEN (s + 5) * (s + 5) - greatest(0, s + 5 - 3) * (s + 5) ELSE 0 END) AS tube_iou FROM b GROUP BY video")
def _(t):
    b = t("lineitem").groupBy(F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("frame")).agg(F.avg("l_quantity").alias("q"), (F.avg("l_tax") * 100).alias("s"))
    q, s = F.col("q"), F.col("s") + 5
    pair = b.select("video", "frame", F.array(q, q, q + s, q + s).alias("a"), F.when(F.col("frame") > 1, F.array(q + 3, q, q + 3 + s, q + s)).alias("b"))
    return V.tube_iou(pair, ["video"], "a", "b")


@query("v5_cgf1")
def _(t):
    p = _detections(t)
    g = p.where("prediction_id % 3 <> 0").select("image", "box")
    return V.cgf1_totals(V.cgf1_images(g, p, "image", 0.3))


@query("v12_teta", "WITH s AS (SELECT l_returnflag AS cls, sum(l_quantity) AS loc_tp, sum(l_tax) AS loc_fp, sum(l_discount) AS loc_fn, sum(l_quantity) / 2 AS ass_sum FROM lineitem GROUP BY 1) SELECT cls, (loc_tp / greatest(1, loc_tp + loc_fp + loc_fn) + ass_sum / greatest(1, loc_tp) + loc_tp / greatest(1, loc_tp + loc_fn + loc_fp)) / 3 AS teta FROM s")
def _(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("cls"), F.col("l_quantity").alias("loc_tp"), F.col("l_tax").alias("loc_fp"), F.col("l_discount").alias("loc_fn"), (F.col("l_quantity") / 2).alias("ass_sum"), F.col("l_quantity").alias("cls_tp"), F.col("l_discount").alias("cls_fp"), F.col("l_tax").alias("cls_fn"))
    return V.teta(rows).select("cls", "teta")


@query("v13_count_tracks", "SELECT event_type, count(*) AS dets, count(DISTINCT user_id) AS ids, count(DISTINCT date_trunc('hour', ts)) AS frames FROM events GROUP BY 1")
def _(t):
    return V.count_tracks(t("events").withColumn("h", F.date_trunc("hour", "ts")), ["event_type"], "user_id", "h")


@query("v14_pair_ids", "WITH p AS (SELECT DISTINCT o_orderpriority AS v, o_orderstatus AS c, CAST(o_orderstatus = 'P' AS INTEGER) AS neg FROM orders) SELECT v, c, CAST(row_number() OVER (ORDER BY neg, v, c) AS INTEGER) AS pair_id FROM p")
def _(t):
    o = t("orders").select(F.col("o_orderpriority").alias("v"), F.col("o_orderstatus").alias("c"))
    return V.pair_ids(o.where("c <> 'P'"), o.where("c = 'P'"), ["v", "c"])


@query("v15_reindex", "SELECT n_nationkey + 1 AS n_nationkey, n_regionkey + 1 AS n_regionkey FROM nation")
def _(t):
    return V.reindex(t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey")


# --- registries --------------------------------------------------------------------------------


@query("u1_letter_accuracy", "SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM orders")
def _(t):
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "(B) yes").otherwise("none").alias("prediction"), F.array(F.lit("B")).alias("references"))
    return U.METRICS["letter_accuracy"](rows)


@query("u5_reward_by_source", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE 1.0 END AS reward FROM orders")
def _(t):
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "math").otherwise("mcq").alias("source"), F.when(F.col("o_orderstatus") == "F", "it is 42").when(F.col("o_orderstatus") == "O", "A.").otherwise("B.").alias("prediction"), F.when(F.col("o_orderstatus") == "F", "42").otherwise("A").alias("reference"))
    return U.by_source(rows, "source", {"math": "gsm8k", "mcq": "accuracy"}).select("o_orderkey", "reward")


@query("u5_overlong", "SELECT doc_id, least(-(n_chars - 1000) / 500.0, 0) AS penalty FROM documents")
def _(t):
    return t("documents").select("doc_id", U.overlong_penalty(F.col("n_chars"), 1500, 500).alias("penalty"))

"""Queries of selection, aggregation, joins, validation, batches and streams (A*, F*, J*, W*, R*, S*, K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.operators import aggregate as A
from rowforge.operators import batch as W
from rowforge.operators import joins as J
from rowforge.operators import select as S
from rowforge.operators import validate as V
from rowforge.streaming import streams as R

from .registry import query

# --- aggregation -------------------------------------------------------------------------------


@query("a2_roll_up", "WITH g AS (SELECT lang, source, count(*) n, count(quality) scoreable, count(*) FILTER (WHERE quality = 1) correct, count(*) FILTER (WHERE quality = 1) / count(quality) accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT lang, sum(n) AS n, sum(scoreable) AS scoreable, sum(correct) AS correct, sum(correct) / sum(scoreable) AS micro, avg(accuracy) AS macro, count(accuracy) AS groups FROM g GROUP BY lang")
def _(t):
    rows = t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id")
    return A.roll_up(A.grouped_accuracy(rows, ["lang", "source"], "quality"), ["lang"])


@query("a3_global_micro", "SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS correct, count(*) FILTER (WHERE toxic = 1) / count(toxic) AS micro FROM labels")
def _(t):
    return A.roll_up(A.grouped_accuracy(t("labels"), ["quality"], "toxic"), []).select("n", "correct", "micro")


@query("a4_box_metrics", "SELECT l_returnflag, count(*) AS n, avg(l_discount * 10) AS mean_iou, avg(CAST(l_discount * 10 >= 0.25 AS INTEGER)) AS acc_25, avg(CAST(l_discount * 10 >= 0.5 AS INTEGER)) AS acc_50, avg(CAST(l_discount * 10 >= 0.7 AS INTEGER)) AS acc_70, avg(CAST(l_tax > 0.02 AS INTEGER)) AS format_validity FROM lineitem GROUP BY l_returnflag")
def _(t):
    return A.box_metrics(t("lineitem").select("l_returnflag", (F.col("l_discount") * 10).alias("iou"), (F.col("l_tax") > 0.02).alias("valid")), ["l_returnflag"], "iou", "valid")


@query("a5_letter_distribution", "SELECT unnest(string_split(l_returnflag || ',' || l_linestatus, ',')) AS letter, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return A.letter_distribution(t("lineitem").select(F.array("l_returnflag", "l_linestatus").alias("labels")), "labels")


@query("a6_count_table", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value IS NULL) AS missing FROM events GROUP BY event_type")
def _(t):
    return A.count_table(t("events"), ["event_type"], high=F.col("value") > 50, missing=F.col("value").isNull())


@query("a8_efficiency", "SELECT l_returnflag, avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, sum(l_extendedprice) AS total, max(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag")
def _(t):
    return A.efficiency(t("lineitem"), ["l_returnflag"], "l_extendedprice")


@query("a9_category_accuracy", "SELECT p_type AS category, count(*) AS n, avg(CAST(p_size > 25 AS INTEGER)) AS accuracy, 'category' AS level FROM part GROUP BY p_type UNION ALL SELECT split_part(p_type, ' ', 1), count(*), avg(CAST(p_size > 25 AS INTEGER)), 'super' FROM part GROUP BY 1")
def _(t):
    out = A.category_accuracy(t("part").select(F.replace("p_type", F.lit(" "), F.lit("/")).alias("c"), (F.col("p_size") > 25).alias("ok")), "c", "ok")
    return out.withColumn("category", F.replace("category", F.lit("/"), F.lit(" ")))


@query("a10_confusion", "SELECT l_linestatus, count(*) FILTER (WHERE t AND a) AS tp, count(*) FILTER (WHERE NOT t AND a) AS fp, count(*) FILTER (WHERE t AND NOT a) AS fn, count(*) FILTER (WHERE NOT t AND NOT a) AS tn, avg(CAST(t AS INTEGER)) AS yes_ratio, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) AS f1 FROM (SELECT l_linestatus, l_quantity > 20 AS t, l_discount > 0.03 AS a FROM lineitem) GROUP BY 1")
def _(t):
    yn = lambda c: F.when(c, "yes").otherwise("no")
    return A.yes_no_confusion(t("lineitem").select("l_linestatus", yn(F.col("l_quantity") > 20).alias("t"), yn(F.col("l_discount") > 0.03).alias("a")), ["l_linestatus"], "t", "a")


@query("a11_fixed_categories", "SELECT avg(CAST(o_totalprice > 200000 AS INTEGER)) FILTER (WHERE o_orderstatus = 'F') AS \"F\", avg(CAST(o_totalprice > 200000 AS INTEGER)) FILTER (WHERE o_orderstatus = 'O') AS \"O\", 0.0 AS \"Z\", (avg(CAST(o_totalprice > 200000 AS INTEGER)) FILTER (WHERE o_orderstatus = 'F') + avg(CAST(o_totalprice > 200000 AS INTEGER)) FILTER (WHERE o_orderstatus = 'O')) / 3 AS mean FROM orders")
def _(t):
    return A.fixed_category_mean(t("orders").withColumn("ok", F.col("o_totalprice") > 200000), "o_orderstatus", "ok", ["F", "O", "Z"])


@query("a30_average_precision", "WITH r AS (SELECT lang, toxic = 1 AS hit, sum(CAST(toxic = 1 AS INTEGER)) OVER w / row_number() OVER w AS p FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT lang, sum(CASE WHEN hit THEN p ELSE 0 END) AS precision_sum, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit) AS truths, sum(CASE WHEN hit THEN p ELSE 0 END) / count(*) FILTER (WHERE hit) AS ap FROM r GROUP BY lang")
def _(t):
    rows = t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id").withColumn("hit", F.col("toxic") == 1)
    return A.average_precision(rows, ["lang"], "n_chars", "hit", F.count_if("hit"), ["doc_id"])


@query("a31_bootstrap_ci")
def _(t):
    return A.bootstrap_ci(t("labels"), [], "quality", "doc_id", repeats=200)


@query("a33_mcnemar_counts", "SELECT source, count(*) AS pairs, count(*) FILTER (WHERE NOT b AND a) AS gained, count(*) FILTER (WHERE b AND NOT a) AS lost, avg(CAST(a AS INTEGER) - CAST(b AS INTEGER)) AS delta, CASE WHEN gained + lost > 0 THEN pow(greatest(abs(gained - lost) - 1, 0), 2) / (gained + lost) ELSE 0 END AS chi2 FROM (SELECT source, quality = 1 AS b, toxic = 0 AS a FROM labels JOIN documents USING (doc_id)) GROUP BY source")
def _(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").select("source", (F.col("quality") == 1).alias("b"), (F.col("toxic") == 0).alias("a"))
    return A.mcnemar(rows, ["source"], "b", "a").drop("p")


@query("a34_validation_metrics")
def _(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_suppkey").alias("uid"), F.col("l_discount").alias("score"), F.col("l_linestatus").alias("answer"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return A.validation_metrics(rows, "source", "uid", "score", "answer", "pos", repeats=50)


@query("a35_majority_vote", "WITH l AS (SELECT l_orderkey, l_returnflag, l_quantity, l_linenumber * 1000000 + l_partkey * 100 + l_quantity AS pos FROM lineitem), c AS (SELECT l_orderkey, l_returnflag, count(*) AS votes, min(pos) AS f, min_by(l_quantity, pos) AS value FROM l GROUP BY 1, 2) SELECT l_orderkey, l_returnflag AS key, value, votes FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, f, l_returnflag) = 1")
def _(t):
    return A.majority_vote(t("lineitem").withColumn("pos", F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_quantity")), ["l_orderkey"], "l_returnflag", "l_quantity", "pos")


@query("a36_group_mean_std", "SELECT o_custkey, CASE WHEN count(*) <= 1 THEN 0 ELSE avg(o_totalprice) END AS mean, CASE WHEN count(*) <= 1 THEN 1 ELSE sqrt(greatest(var_samp(o_totalprice), 1e-8)) END AS std, count(*) AS n FROM orders GROUP BY o_custkey")
def _(t):
    return A.group_mean_std(t("orders"), ["o_custkey"], "o_totalprice")


@query("a37_group_normalised", "SELECT o_orderkey, CASE WHEN count(*) OVER w <= 1 THEN o_totalprice / (1 + 1e-6) ELSE (o_totalprice - avg(o_totalprice) OVER w) / (stddev_samp(o_totalprice) OVER w + 1e-6) END AS advantage FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def _(t):
    return A.group_normalised(t("orders"), ["o_custkey"], "o_totalprice").select("o_orderkey", "advantage")


@query("a38_rloo", "SELECT o_orderkey, CASE WHEN count(*) OVER w > 1 THEN (o_totalprice * count(*) OVER w - sum(o_totalprice) OVER w) / (count(*) OVER w - 1) ELSE o_totalprice END AS advantage FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def _(t):
    return A.rloo(t("orders"), ["o_custkey"], "o_totalprice").select("o_orderkey", "advantage")


@query("a38_opo", "SELECT o_orderkey, o_totalprice - CASE WHEN count(*) OVER w > 1 THEN sum(o_totalprice * l) OVER w / sum(l) OVER w ELSE 0 END AS advantage FROM (SELECT *, o_orderkey % 7 + 1 AS l FROM orders) WINDOW w AS (PARTITION BY o_custkey)")
def _(t):
    return A.opo(t("orders").withColumn("l", F.col("o_orderkey") % 7 + 1), ["o_custkey"], "o_totalprice", "l").select("o_orderkey", "advantage")


@query("a38_pass_at_k", "SELECT o_orderkey, CASE WHEN row_number() OVER o = 1 AND count(*) OVER (PARTITION BY o_custkey) > 1 THEN o_totalprice - lead(o_totalprice) OVER o ELSE 0 END AS advantage FROM orders WINDOW o AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def _(t):
    return A.pass_at_k(t("orders"), ["o_custkey"], "o_totalprice", "o_orderkey", by_std=False).select("o_orderkey", "advantage")


@query("a39_reward_to_go", "SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS place, sum(l_tax) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC ROWS UNBOUNDED PRECEDING) AS togo FROM (SELECT l_orderkey, l_linenumber, sum(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2)")
def _(t):
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_tax").alias("l_tax"))
    r = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_tax"))).alias("r"))
    return r.select("l_orderkey", F.posexplode(A.reward_to_go(F.transform("r", lambda x: x["l_tax"]))).alias("place", "togo"))


@query("a39_gae", "WITH l AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS r, count(*) * l_linenumber AS v FROM lineitem GROUP BY 1, 2), d AS (SELECT *, r + 0.5 * coalesce(lead(v) OVER w, 0) - v AS delta, row_number() OVER w AS k FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) SELECT a.l_orderkey, CAST(a.k - 1 AS INTEGER) AS place, sum(pow(0.25, b.k - a.k) * b.delta) AS advantage FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND b.k >= a.k GROUP BY 1, 2")
def _(t):
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("r"), (F.count("*") * F.col("l_linenumber")).cast("double").alias("v"))
    x = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "r", "v"))).alias("x"))
    return x.select("l_orderkey", F.posexplode(A.gae(F.transform("x", lambda y: y["r"]), F.transform("x", lambda y: y["v"]), 0.5, 0.5)).alias("place", "advantage"))


@query("a40_loss_modes", "SELECT sum(l_discount * m) / sum(m) AS loss FROM (SELECT l_discount, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 0 END AS m FROM lineitem)")
def _(t):
    seq = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("x"), F.collect_list((F.col("l_linenumber") <= 3).cast("int")).alias("m"))
    return A.loss_aggregate(seq, "x", "m", "token-mean")


@query("a41_masked_stats", "SELECT sum(l_tax) FILTER (WHERE l_quantity > 10) AS total, sum(l_tax) FILTER (WHERE l_quantity > 10) / (count(*) FILTER (WHERE l_quantity > 10) + 1e-8) AS mean, var_samp(l_tax) FILTER (WHERE l_quantity > 10) AS var FROM lineitem")
def _(t):
    return A.masked_stats(t("lineitem").withColumn("m", F.col("l_quantity") > 10), "l_tax", "m")


@query("a42_reduce_metrics", "SELECT 'len_max' AS metric, max(n_chars) AS value FROM documents UNION ALL SELECT 'len_min', min(n_chars) FROM documents UNION ALL SELECT 'len', avg(n_chars) FROM documents")
def _(t):
    v = t("documents").select(F.explode(F.array(*map(F.lit, ["len_max", "len_min", "len"]))).alias("metric"), F.col("n_chars").cast("double").alias("value"))
    return A.reduce_metrics(v)


@query("a43_score_lists", "SELECT l_returnflag, avg(s) AS score, count(*) AS n FROM (SELECT l_returnflag, l_orderkey, avg(l_discount) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return A.score_lists(t("lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.collect_list("l_discount").alias("s")), "l_returnflag", "s")


@query("a44_batch_statistics", "SELECT lang, avg(n_chars) AS length_mean, max(n_chars) AS length_max, min(n_chars) AS length_min, avg(CAST(n_chars >= 2000 AS INTEGER)) AS clip_ratio, avg(doc_id) AS doc_id_mean, max(doc_id) AS doc_id_max, min(doc_id) AS doc_id_min FROM documents GROUP BY lang")
def _(t):
    return A.batch_statistics(t("documents"), ["lang"], "n_chars", 2000, "doc_id")


@query("a45_profile", r"SELECT role, count(*) AS n, avg(CAST(turn = 0 AS INTEGER)) AS flag_share, min(w) AS words_min, avg(w) AS words_mean, max(w) AS words_max FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM conversations) GROUP BY role")
def _(t):
    return A.profile(t("conversations"), ["role"], "text", F.col("turn") == 0)


@query("a46_sensitivity", "WITH m AS (SELECT l_returnflag AS source, l_linenumber / 7.0 AS r, avg(l_quantity) AS metric FROM lineitem GROUP BY 1, 2), b AS (SELECT source, max(metric) AS base FROM m WHERE r = 1 GROUP BY 1) SELECT source, min(r) AS least_ratio FROM m JOIN b USING (source) WHERE metric >= 0.99 * base GROUP BY source")
def _(t):
    m = t("lineitem").groupBy(F.col("l_returnflag").alias("source"), (F.col("l_linenumber") / 7.0).alias("r")).agg(F.avg("l_quantity").alias("metric"))
    return A.sensitivity(m, "source", "r", "metric", 0.01)


@query(
    "a47_trend_gate",
    """WITH m AS (SELECT lang, source, avg(n_chars) AS initial, avg(n_chars) FILTER (WHERE doc_id % 2 = 0) AS short, avg(n_chars) FILTER (WHERE doc_id % 4 = 0) AS final FROM documents GROUP BY 1, 2)
       SELECT lang, avg(abs(initial - final)) AS initial_distance, avg(abs(short - final)) AS short_distance, max(initial - short) AS most_drop, count(*) FILTER (WHERE initial - short > 100) AS drops,
       avg(abs(short - final)) < avg(abs(initial - final)) AND count(*) FILTER (WHERE initial - short > 100) = 0 AS passes FROM m GROUP BY lang""",
)
def _(t):
    n, d = F.col("n_chars"), F.col("doc_id")
    m = t("documents").groupBy("lang", "source").agg(F.avg(n).alias("initial"), F.avg(F.when(d % 2 == 0, n)).alias("short"), F.avg(F.when(d % 4 == 0, n)).alias("final"))
    return A.trend_gate(m, "lang", most_drop=100)


@query("a29_trajectory_summary")
def _(t):
    return A.trajectory_summary(trajectories(t), repeats=200)


@query(
    "a29_trajectory_counts",
    """SELECT count(*) AS samples, count(*) FILTER (WHERE p_size % 3 <> 0) AS correct, avg(CAST(p_size % 3 <> 0 AS INTEGER)) AS accuracy, avg(CAST(p_partkey % 10 = 9 AS INTEGER)) AS illegal_rate, avg(p_size / 2.0) AS mean_pop, count(*) FILTER (WHERE p_size % 2 = 0) AS tree_search_samples,
       avg(CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 8 = 0 AS INTEGER) END) AS teacher_crop_accuracy, avg(CASE WHEN p_partkey % 4 = 0 THEN 0.5 + p_size END) AS teacher_logprob_gain_mean, avg(CAST(p_size > 25 AS INTEGER)) AS opsd_acceptance_rate,
       count(*) FILTER (WHERE p_size % 2 = 0 AND p_size % 3 <> 0 AND p_partkey % 3 <> 0) AS sam_recovered_target_count, 2 * count(*) FILTER (WHERE p_size % 2 = 0 AND p_size % 3 <> 0 AND p_partkey % 3 <> 0) AS sam_recovered_instance_count,
       count(*) FILTER (WHERE p_size % 2 = 0 AND p_size % 3 <> 0 AND p_partkey % 3 = 1) AS first_retry FROM part""",
)
def _(t):
    s = A.trajectory_summary(trajectories(t), repeats=2)
    names = ["samples", "correct", "accuracy", "illegal_rate", "mean_pop", "tree_search_samples", "teacher_crop_accuracy", "teacher_logprob_gain_mean", "opsd_acceptance_rate", "sam_recovered_target_count", "sam_recovered_instance_count"]
    return s.select(*names, F.coalesce(F.try_element_at("sam_recovery_stages", F.lit("local_retry_1")), F.lit(0)).alias("first_retry"))


def trajectories(t):
    """A trajectory a row of part: right where the size is no multiple of 3, by tree search where it is even.

    Its one target failed at first; a retry works but for keys that 3 divides, the first retry where the rest is 1. A
    retry finds two good masks and one that isn't kept.
    """
    k, n = F.col("p_partkey"), F.col("p_size")
    box = lambda a, b: F.array(F.lit(10.0), F.lit(10.0), a, b)
    inst = lambda i, kept, b: F.struct(F.lit(i).alias("prediction_index"), F.lit(0.5).alias("score"), F.lit(kept).alias("retained_by_cvsearch"), F.lit(True).alias("valid_mask"), F.when(k % 5 != 4, "m.png").alias("mask_path"), b.alias("pseudo_bbox_xyxy"))
    found = F.array(inst(0, True, box(n + 20.0, n + 20.0)), inst(1, False, box(F.lit(50.0), F.lit(50.0))), inst(2, True, box(F.lit(99.0), F.lit(99.0))))
    attempt = lambda c, stage, ok: F.struct(F.lit(c).alias("call_index"), F.lit(stage).alias("stage"), ok.alias("sam_success"), found.alias("instances"))
    tries = F.array(attempt(0, "initial", F.lit(False)), attempt(2, "local_retry_2", k % 3 != 0), attempt(1, "local_retry_1", k % 3 == 1))
    nodes = F.slice(F.array(*[F.struct(F.array(F.lit(10.0), F.lit(10.0), n * 2.0, n * 2.0).alias("bbox_xywh"), F.lit("n").alias("source"))] * 2), 1, (k % 3).cast("int"))
    target = F.struct(F.lit(0).alias("target_index"), F.when(k % 7 == 6, " ").otherwise("thing").alias("target_text"), F.lit(False).alias("initial_sam_success"), nodes.alias("final_nodes"), tries.alias("sam_attempts"))
    return t("part").select(
        k.cast("string").alias("sample_id"), F.lit(100).alias("width"), F.lit(100).alias("height"), F.when(n % 2 == 0, 2).otherwise(3).alias("search_mode"), (n % 3 != 0).alias("answer_correct"), F.when(k % 10 != 9, "A").alias("normalized_prediction"), (n / 2).alias("num_pop"),
        F.when(k % 2 == 0, "what color").alias("question_family"), F.when(k % 4 == 0, F.when(k % 8 == 0, "A").otherwise("B")).alias("teacher_prediction"), F.lit("A").alias("gt_answer"), (n + 0.5).alias("teacher_gt_logprob"), F.lit(0.0).alias("student_gt_logprob"), (n > 25).alias("accepted_for_opsd"), F.array(target).alias("target_traces"),
    )


_SEARCHED = "SELECT *, CAST(p_partkey AS VARCHAR) AS sample_id FROM part WHERE p_size % 2 = 0 AND p_size % 3 <> 0"


@query(
    "f9_tree_node_boxes",
    f"""SELECT sample_id, CASE WHEN p_partkey % 7 = 6 THEN 'empty_target_text' WHEN p_partkey % 3 = 0 THEN 'missing_final_node' WHEN p_partkey % 3 = 2 THEN 'ambiguous_multiple_final_nodes'
        WHEN pow(least(100, 10 + p_size * 2) - 10, 2) / 10000 NOT BETWEEN 0.01 AND 0.3 THEN 'pseudo_bbox_area_out_of_range' END AS reason,
        CASE WHEN p_partkey % 3 = 1 THEN pow(least(100, 10 + p_size * 2) - 10, 2) / 10000 END AS share FROM ({_SEARCHED})""",
)
def _(t):
    return V.tree_node_boxes(trajectories(t), 0.01, 0.3).select("sample_id", "reason", "share")


_RECOVERED = "CASE WHEN p_partkey % 5 <> 4 THEN (CASE WHEN pow(least(100, p_size + 20) - 10, 2) / 10000 BETWEEN 0.001 AND 0.25 THEN 1 ELSE 0 END) ELSE 0 END"


@query(
    "f10_recovered_boxes",
    f"""SELECT sample_id, CASE WHEN p_partkey % 7 = 6 THEN 'empty_target_text' WHEN p_partkey % 3 = 0 THEN 'missing_local_sam_recovery' WHEN {_RECOVERED} = 0 THEN 'no_valid_recovered_mask' END AS reason,
        CASE WHEN p_partkey % 7 <> 6 AND p_partkey % 3 <> 0 THEN {_RECOVERED} ELSE 0 END AS instances FROM ({_SEARCHED})""",
)
def _(t):
    targets, _ = V.recovered_boxes(trajectories(t), most=0.25)
    return targets.select("sample_id", "reason", F.col("instances").cast("int").alias("instances"))


@query(
    "f10_instance_reasons",
    f"""SELECT sample_id, i AS prediction_index, CASE WHEN p_partkey % 3 = 1 THEN 'local_retry_1' ELSE 'local_retry_2' END AS stage, CASE WHEN p_partkey % 5 = 4 THEN 'missing_mask_artifact' WHEN i = 2 OR pow(least(100, p_size + 20) - 10, 2) / 10000 > 0.25 THEN 'pseudo_bbox_area_out_of_range' END AS reason
        FROM ({_SEARCHED}), (VALUES (0), (2)) v(i) WHERE p_partkey % 7 <> 6 AND p_partkey % 3 <> 0""",
)
def _(t):
    return V.recovered_boxes(trajectories(t), most=0.25)[1].select("sample_id", "prediction_index", "stage", "reason")


# --- manifests (F4-F6, F18) --------------------------------------------------------------------


def samples(t):
    """A sample a line: the task by line number, no label for some choices."""
    tasks = F.array(*map(F.lit, ["caption", "open_vqa", "bbox", "single_choice", "multi_choice", "change_caption"]))
    n = F.col("l_linenumber")
    data = F.when(F.col("l_returnflag") == "A", "vrsbench").when(F.col("l_returnflag") == "N", "levir_cc").otherwise("other")
    return t("lineitem").select((F.col("l_orderkey") * 10 + n).alias("id"), data.alias("dataset"), F.col("l_linestatus").alias("subtask"), F.element_at(tasks, (n % 6 + 1).cast("int")).alias("task_type"), F.when(F.col("l_tax") > 0.02, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>")).alias("answer_labels"), F.when(n <= 3, "eval").otherwise("test").alias("split"))


_SAMPLES = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 'vrsbench' WHEN 'N' THEN 'levir_cc' ELSE 'other' END AS dataset, ['caption', 'open_vqa', 'bbox', 'single_choice', 'multi_choice', 'change_caption'][1 + l_linenumber % 6] AS task_type, l_tax > 0.02 AS labelled, CASE WHEN l_linenumber <= 3 THEN 'eval' ELSE 'test' END AS split FROM lineitem"


@query("f4_manifest", f"SELECT id FROM ({_SAMPLES}) WHERE task_type = 'single_choice' AND labelled ORDER BY id LIMIT 300")
def _(t):
    return V.manifest(samples(t), "mcq", 300).select("id")


@query("f4_manifest_all", f"SELECT id, task_type FROM ({_SAMPLES}) WHERE labelled OR task_type NOT IN ('single_choice', 'multi_choice')")
def _(t):
    return V.manifest(samples(t)).select("id", "task_type")


@query("f5_subtask_slice", f"SELECT id FROM ({_SAMPLES}) WHERE task_type = 'bbox'")
def _(t):
    return V.subtask_slice(samples(t), "bbox").select("id")


@query("f6_official", f"SELECT id, dataset FROM (SELECT DISTINCT id, dataset, split FROM ({_SAMPLES})) WHERE (dataset = 'vrsbench' AND split = 'eval') OR (dataset = 'levir_cc' AND split = 'test') GROUP BY ALL HAVING (SELECT count(*) FROM ({_SAMPLES}) s WHERE s.id = id) > 0")
def _(t):
    return V.official(samples(t).dropDuplicates(["id", "dataset", "split"])).select("id", "dataset")


@query("f18_referring", "WITH c AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('43:' || conv_id), conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 = 0)) SELECT conv_id, CASE WHEN r <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM c")
def _(t):
    c = t("conversations").select("conv_id").distinct()
    turn = F.struct(F.lit("human").alias("from"), F.when(F.col("conv_id") % 3 == 0, "<image>\n[refer] it").otherwise("[vqa] it").alias("value"))
    return V.referring_only(c.withColumn("conversations", F.array(turn)), "conv_id", held_out=0.2).select("conv_id", "split")


@query("a48_promotion_gate", "SELECT l_returnflag, a >= 25 AS accuracy_ok, p <= 0.06 AS search_ok, n >= 100 AS coverage_ok, f <= 0.05 AS negatives_ok, a >= 25 AND p <= 0.06 AND n >= 100 AND f <= 0.05 AS promoted FROM (SELECT l_returnflag, avg(l_quantity) AS a, avg(l_tax) AS p, count(*) AS n, avg(l_discount) AS f FROM lineitem GROUP BY 1)")
def _(t):
    c = t("lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("accuracy"), F.avg("l_tax").alias("mean_pop"), F.count("*").alias("tree_search_samples"), F.avg("l_discount").alias("negative_fpr"))
    b = c.sparkSession.createDataFrame([(25.0, 0.06, 100, 0.05)], "accuracy double, mean_pop double, tree_search_samples long, negative_fpr double")
    return A.promotion_gate(c, b).select("l_returnflag", "accuracy_ok", "search_ok", "coverage_ok", "negatives_ok", "promoted")


@query("a50_route_counts", "SELECT o_orderstatus AS route, count(*) AS n, false AS only FROM orders GROUP BY 1")
def _(t):
    return A.route_counts(t("orders"), F.col("o_orderstatus"))


# --- selection ---------------------------------------------------------------------------------


@query("a12_keep_best", "SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id) AS first_line FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CAST(event_type = 'error' OR value > 90 AS INTEGER), event_id DESC) = 1")
def _(t):
    return S.keep_best(t("events"), "user_id", "event_id", (F.col("event_type") == "error") | (F.col("value") > 90)).select("user_id", "event_id", "first_line")


@query("a13_latest_success", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CAST(value > 80 AS INTEGER) DESC, event_id DESC) = 1")
def _(t):
    return S.latest_success(t("events"), "user_id", "event_id", F.col("value") > 80).select("user_id", "event_id")


@query("a13_drifted", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS definitions FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def _(t):
    return S.drifted(t("orders"), "o_custkey", F.col("o_orderpriority"))


@query("a14_duplicates", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(t):
    return S.duplicates(t("documents"), "text")


@query("a15_keep_first", "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source, n_chars ORDER BY doc_id) = 1")
def _(t):
    return S.keep_first(t("documents"), ["lang", "source", "n_chars"], [F.col("doc_id")]).select("doc_id", "lang", "source")


@query("a16_first_shard", "SELECT l_orderkey, l_linenumber FROM (SELECT *, l_suppkey % 4 AS shard, min(l_suppkey % 4) OVER (PARTITION BY l_orderkey) AS s FROM lineitem) WHERE shard = s")
def _(t):
    return S.first_shard_wins(t("lineitem").withColumn("shard", F.col("l_suppkey") % 4), ["l_orderkey"], "shard").select("l_orderkey", "l_linenumber")


@query("a28_top_per_key", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_totalprice > 50000 QUALIFY rank <= 3")
def _(t):
    return S.top_per_key(t("orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, F.col("o_totalprice") > 50000).select("o_custkey", "o_orderkey", "rank")


@query("a18_coverage_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= greatest(1, ceil(n * 0.1))")
def _(t):
    return S.coverage_sample(t("documents"), "doc_id", "source", 0.1, 42).select("doc_id", "source")


@query("a19_exact_stratified", "WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) <> 1 AS one, sha256('7|fill|' || doc_id) AS h FROM documents) SELECT doc_id FROM r ORDER BY one, h, doc_id LIMIT 60")
def _(t):
    return S.exact_stratified(t("documents").select("doc_id", "source"), "doc_id", "source", 60, 7).select("doc_id")


@query("a20_group_fraction", "WITH k AS (SELECT DISTINCT source FROM documents), p AS (SELECT source FROM k ORDER BY sha256('3|group|' || source), source LIMIT (SELECT CAST(floor(count(*) * 0.25 + 0.5) AS BIGINT) FROM k)) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM p)")
def _(t):
    return S.group_fraction(t("documents").select("doc_id", "source"), "source", 0.25, 3)


@query("a21_group_split", "WITH k AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('5|split|' || o_custkey), o_custkey) AS r FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, CASE WHEN r <= 100 THEN 'eval' WHEN r <= 600 THEN 'train' END AS split FROM orders JOIN k USING (o_custkey)")
def _(t):
    return S.group_split(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", {"eval": 100, "train": 500}, 5).select("o_orderkey", "split")


@query("a22_stratified_split", "SELECT doc_id, CASE WHEN r <= 200 THEN 'test' WHEN r <= 300 THEN 'val' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('split:9:' || lang || ':' || doc_id), doc_id) AS r FROM documents)")
def _(t):
    return S.stratified_split(t("documents").select("doc_id", "lang"), "doc_id", "lang", {"test": 200, "val": 100}, 9).select("doc_id", "split")


@query("a24_split_summary", "SELECT lang, count(*) AS n, count(DISTINCT source) AS families, bool_and(n_chars > 0) AS all_ok FROM documents GROUP BY lang")
def _(t):
    return S.split_summary(t("documents").withColumn("ok", F.col("n_chars") > 0), "lang", F.col("source"), ["ok"])


@query("a25_seeded_sample", "SELECT doc_id FROM documents ORDER BY sha256('11:' || doc_id), doc_id LIMIT 40 OFFSET 10")
def _(t):
    return S.seeded_sample(t("documents").select("doc_id"), "doc_id", 40, 11, 10)


@query("a26_ratio_mix", "SELECT part, count(*) AS n FROM (SELECT 'a' AS part FROM supplier UNION ALL (SELECT 'b' FROM customer LIMIT (SELECT CAST(floor(count(*) * 0.5 + 0.5) AS BIGINT) FROM supplier))) GROUP BY part")
def _(t):
    parts = {"a": t("supplier").select(F.col("s_suppkey").alias("k")), "b": t("customer").select(F.col("c_custkey").alias("k"))}
    return S.ratio_mix(parts, "a", {"b": 0.5}, "k", 1).groupBy("part").agg(F.count("*").alias("n"))


@query(
    "a27_quota_per_image",
    """WITH one AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('P', 'F', 'O')
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY list_position(['P', 'F', 'O'], o_orderstatus), sha256('3:' || o_orderkey), o_orderkey) = 1)
       SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('3:' || o_orderkey), o_orderkey) <= CASE o_orderstatus WHEN 'P' THEN 50 WHEN 'F' THEN 100 ELSE 200 END""",
)
def _(t):
    return S.quota_per_image(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", "o_orderkey", {"P": 50, "F": 100, "O": 200}, 3)


# --- joins -------------------------------------------------------------------------------------


@query("j1_lookup_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3")
def _(t):
    n = J.small(t("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    return J.lookup_join(t("customer"), n, ["c_nationkey"]).select("c_custkey", "n_name")


@query("j1_unmatched", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return J.unmatched(t("documents"), t("labels"), ["doc_id"]).select("doc_id")


@query("j2_require_match", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def _(t):
    return J.require_match(t("supplier").withColumnRenamed("s_nationkey", "n_nationkey"), t("nation"), ["n_nationkey"], "n_name").groupBy("n_name").agg(F.count("*").alias("n"))


@query("j3_fallback_category", "SELECT c_custkey, coalesce(CASE WHEN c_nationkey < 5 THEN 'near' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END, 'unknown') AS category FROM customer")
def _(t):
    a = t("nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("near").alias("category"))
    b = t("customer").where("c_mktsegment = 'BUILDING'").select("c_mktsegment").distinct().withColumn("category", F.lit("segment"))
    return J.fallback_category(t("customer"), a, b, "c_nationkey", ["c_mktsegment"]).select("c_custkey", "category")


@query("j4_long_for_short", "WITH l AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT s.o_orderkey, l.o_orderkey AS long_key FROM orders s JOIN l USING (o_custkey) WHERE s.o_totalprice < 50000")
def _(t):
    o = t("orders")
    return J.long_for_short(o.where("o_totalprice < 50000"), o.where("o_totalprice > 200000"), "o_custkey", "o_orderkey").select("o_orderkey", F.col("long.o_orderkey").alias("long_key"))


@query("j5_merge_shards", "SELECT k, CASE WHEN e.s IS NULL THEN 'unexpected' WHEN f.n IS NULL THEN 'missing' WHEN f.n > 1 THEN 'duplicate' WHEN f.lo <> e.s THEN 'drift' ELSE 'ok' END AS status FROM (SELECT c_custkey AS k, c_nationkey % 3 AS s FROM customer) e FULL JOIN (SELECT o_custkey + 100 AS k, count(*) AS n, min(o_custkey % 3) AS lo FROM orders GROUP BY 1) f USING (k)")
def _(t):
    e = t("customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 3).cast("long").alias("s"))
    f = t("orders").select((F.col("o_custkey") + 100).alias("k"), (F.col("o_custkey") % 3).alias("s"))
    return J.merge_shards(e, f, "k", "s")


@query("j6_coverage", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return J.coverage(t("documents"), t("labels"), "doc_id")


@query("j7_paired", "SELECT c_mktsegment, count(*) AS n, sum(CAST(c_nationkey > 12 AS INTEGER) - CAST(c_acctbal > 5000 AS INTEGER)) AS gain FROM customer GROUP BY 1")
def _(t):
    c = t("customer")
    right = lambda cond: c.select("c_custkey", "c_mktsegment", cond.cast("int").alias("correct"))
    pairs = J.paired(right(F.col("c_acctbal") > 5000), right(F.col("c_nationkey") > 12), "c_custkey", ["c_mktsegment", "correct"])
    return pairs.groupBy(F.col("a.c_mktsegment").alias("c_mktsegment")).agg(F.count("*").alias("n"), F.sum(F.col("b.correct") - F.col("a.correct")).alias("gain"))


@query("j8_overlap", "SELECT DISTINCT c_nationkey AS n_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return J.overlap(t("customer").select(F.col("c_nationkey").alias("n_nationkey")), t("supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey")


@query("j12_excluding", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    banned = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.excluding(t("customer").select("c_custkey"), [banned], "c_custkey")


@query("j13_lexical_candidates", "WITH s AS (SELECT p_type AS id, unnest(list_distinct(string_split(p_type, ' '))) AS w, len(list_distinct(string_split(p_type, ' '))) AS n FROM (SELECT DISTINCT p_name AS p_type FROM part)), p AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS i, any_value(a.n) AS x, any_value(b.n) AS y FROM s a JOIN s b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2) SELECT left_id, right_id, i / (x + y - i) AS jaccard FROM p WHERE i / (x + y - i) < 0.9")
def _(t):
    return J.lexical_candidates(t("part").select(F.col("p_name").alias("p_type")).distinct(), "p_type", F.split("p_type", " "))


@query("j14_disjoint_partner")
def _(t):
    return J.disjoint_partner(t("part").select("p_partkey", F.split("p_name", " ").alias("w")), "p_partkey", "w").select("p_partkey", "partner", "rank")


@query("j15_coco_join", "SELECT o_orderkey AS ann, c_name AS image, n_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON o_orderkey % 25 = n_nationkey")
def _(t):
    img = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("image"))
    ann = t("orders").select(F.col("o_orderkey").alias("ann"), F.col("o_custkey").alias("image_id"), (F.col("o_orderkey") % 25).alias("category_id"))
    return J.coco_join(img, ann, t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))).select("ann", "image", "name")


@query("j16_union_columns", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    c = t("customer")
    return J.union_columns(c.select("c_custkey", "c_name", "c_acctbal"), c.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")


@query("j17_result_diff", "SELECT lang, avg(n_chars) AS before, max(n_chars) AS after, max(n_chars) - avg(n_chars) AS change, 100 * (max(n_chars) - avg(n_chars)) / avg(n_chars) AS percent FROM documents GROUP BY lang")
def _(t):
    d = t("documents").groupBy("lang")
    return J.result_diff(d.agg(F.avg("n_chars").alias("value")), d.agg(F.max("n_chars").alias("value")), ["lang"])


@query("j18_verified_blobs", "SELECT page_id FROM pages WHERE page_id % 2 = 0")
def _(t):
    p = t("pages")
    rec = p.select("page_id", F.octet_length("html").alias("n_bytes"), F.when(F.col("page_id") % 2 == 0, F.sha2("html", 256)).otherwise("x").alias("sha256"))
    return J.verified_blobs(rec, p.select("page_id", "html"), ["page_id"], "html").select("page_id")


# --- validation --------------------------------------------------------------------------------


@query("f1_reasons", "SELECT doc_id, list_filter([CASE WHEN n_chars < 400 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'lang' END], lambda x: x IS NOT NULL) AS reasons FROM documents")
def _(t):
    return t("documents").select("doc_id", V.reasons(short=F.col("n_chars") < 400, lang=F.col("lang") != "en").alias("reasons"))


@query("f8_first_reason", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'tax' WHEN l_discount = 0 THEN 'discount' WHEN l_quantity < 5 THEN 'quantity' END AS reason FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", V.first_reason(tax=F.col("l_tax") == 0, discount=F.col("l_discount") == 0, quantity=F.col("l_quantity") < 5).alias("reason"))


@query("f16_identity_kept", "SELECT c_custkey, c_nationkey % 2 = 0 AS kept FROM customer")
def _(t):
    e = F.create_map(F.lit("name"), F.col("c_name"))
    return t("customer").select("c_custkey", V.identity_kept(e, F.create_map(F.lit("name"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).otherwise("x"))).alias("kept"))


@query("f19_length_filter", "SELECT doc_id FROM documents WHERE length(text) <= 1500")
def _(t):
    return V.length_filter(t("documents"), "text", 1500).select("doc_id")


@query("f20_rejection_mask", "SELECT l_orderkey, max(l_tax) <= ln(1.07) AND avg(l_tax) BETWEEN ln(1.0) AND ln(1.05) AS ok FROM lineitem GROUP BY 1")
def _(t):
    r = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_tax").alias("r"))
    return r.select("l_orderkey", V.rejection_mask("r", {"token_k1": (0.5, 1.07), "seq_mean_k1": (1.0, 1.05)}).alias("ok"))


@query("f23_box_valid", "SELECT l_orderkey, l_linenumber, l_tax > 0 AND l_discount > 0 AND l_quantity + l_tax * 100 <= 50 AS ok FROM lineitem")
def _(t):
    from rowforge.functions import boxes

    b = F.array("l_quantity", F.lit(0.0), F.col("l_quantity") + F.col("l_tax") * 100, F.col("l_discount"))
    return t("lineitem").select("l_orderkey", "l_linenumber", boxes.valid(b, 50, 50).alias("ok"))


# --- batches -----------------------------------------------------------------------------------


@query("w2_slice", "SELECT doc_id FROM documents WHERE doc_id >= 10 AND doc_id < 500 AND (doc_id - 10) % 7 = 0")
def _(t):
    return W.slice_rows(t("documents"), "doc_id", 10, 500, 7).select("doc_id")


@query("w4_concat", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(t):
    return W.concat([t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))], [{"seed": 1}, {"seed": 1}])


@query("w5_key_difference", "SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
def _(t):
    return W.key_difference(t("customer"), t("orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("w7_select_positions", "SELECT p.pos, d.doc_id FROM (SELECT s_suppkey AS pos, (s_suppkey * 7) % 50 AS doc_id FROM supplier) p JOIN documents d USING (doc_id)")
def _(t):
    pos = t("supplier").select(F.col("s_suppkey").alias("pos"), ((F.col("s_suppkey") * 7) % 50).alias("doc_id"))
    return W.select_positions(t("documents").select("doc_id"), "doc_id", pos).select("pos", "doc_id")


@query("w8_repeat", "SELECT n_nationkey, c AS copy FROM nation, range(3) r(c)")
def _(t):
    return W.repeat(t("nation"), "n_nationkey", 3).select("n_nationkey", F.col("copy").cast("long").alias("copy"))


@query("w9_chunks", "SELECT n_nationkey, CASE WHEN n_nationkey < 4 THEN n_nationkey // 4 ELSE 1 + (n_nationkey - 4) // 3 END AS part FROM nation")
def _(t):
    return W.chunks(t("nation"), "n_nationkey", 25, 8).select("n_nationkey", "part")


@query("w9_pad", "SELECT n_nationkey, false AS pad FROM nation UNION ALL SELECT n_nationkey + 25, true FROM nation WHERE n_nationkey < 7")
def _(t):
    return W.pad_to_divisor(t("nation").select("n_nationkey"), "n_nationkey", 25, 8)


@query("w11_round_robin", "SELECT doc_id, CAST(doc_id % 8 AS INTEGER) AS shard FROM documents")
def _(t):
    return W.round_robin(t("documents").select("doc_id"), "doc_id", 8)


@query("w12_workload", "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS w FROM documents")
def _(t):
    return t("documents").select("doc_id", W.workload("n_chars").alias("w"))


@query("w12_balanced")
def _(t):
    return W.balanced(t("supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 101 + 1).alias("w")), "s_suppkey", "w", 8)


@query(
    "w12_greedy",
    """WITH RECURSIVE d AS (SELECT doc_id % 50 AS batch, doc_id, coalesce(n_chars, 0) AS w, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS k FROM documents),
       g(batch, k, part, sums) AS (SELECT DISTINCT batch, CAST(0 AS BIGINT), CAST(0 AS BIGINT), [0::HUGEINT, 0, 0, 0] FROM d
         UNION ALL SELECT g.batch, d.k, list_position(sums, list_min(sums)) - 1, list_transform(sums, lambda s, i: CASE WHEN i = list_position(sums, list_min(sums)) THEN s + w ELSE s END) FROM g JOIN d ON d.batch = g.batch AND d.k = g.k + 1)
       SELECT d.batch, d.doc_id, CAST(part AS INTEGER) AS part FROM d JOIN g USING (batch, k)""",
)
def _(t):
    d = t("documents").select((F.col("doc_id") % 50).alias("batch"), "doc_id", "n_chars")
    return W.balanced_batches(d, "batch", "doc_id", "n_chars", 4, "greedy").select("batch", "doc_id", "part")


@query("w12_grouped")
def _(t):
    """Eight groups of documents in each batch; a group stays together and each part holds two."""
    d = t("documents").select((F.col("doc_id") % 25).alias("batch"), "doc_id", (F.floor(F.col("doc_id") / 25) % 8).alias("uid"), W.workload(F.coalesce("n_chars", F.lit(0))).alias("w"))
    return W.balanced_batches(d, "batch", "doc_id", "w", 4, together="uid").select("batch", "doc_id", "uid", "part")


@query("w15_dynamic_batches")
def _(t):
    d = t("documents").select((F.col("doc_id") % 20).alias("batch"), "doc_id", F.least(F.coalesce("n_chars", F.lit(0)), F.lit(8192)).alias("n"))
    return W.dynamic_batches(d, "batch", "doc_id", "n", 16384, multiple=2, same=True).select("batch", "doc_id", "bin", "place", "back")


@query("w13_imbalance", "SELECT min(w) AS least, max(w) AS most, avg(w) AS mean, max(w) / avg(w) AS imbalance FROM (SELECT doc_id % 8 AS p, sum(n_chars) AS w FROM documents GROUP BY 1)")
def _(t):
    return W.imbalance(W.round_robin(t("documents"), "doc_id", 8), "shard", "n_chars")


@query(
    "w14_length_grouped",
    """WITH m AS (SELECT doc_id, n_chars, CAST('0x' || left(sha256('1:' || doc_id), 8) AS BIGINT) % (SELECT greatest(1, CAST(ceil(count(*) / 128) AS BIGINT)) FROM documents) AS mega FROM documents)
       SELECT doc_id, mega, row_number() OVER (PARTITION BY mega ORDER BY n_chars DESC, doc_id) - 1 AS place FROM m""",
)
def _(t):
    return W.length_grouped(t("documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 16, 8, 1).select("doc_id", "mega", "place")


# --- runs and event time -----------------------------------------------------------------------


@query("r1_versioned_queue")
def _(t):
    """Each user's events as commands of a queue of eight samples."""
    from rowforge.streaming import queues as Q

    k = F.col("event_id") % 10
    command = F.when(k < 6, "put").when(k < 9, "get").otherwise("version")
    return Q.versioned_queue(t("events").select("user_id", F.col("event_id").alias("at"), command.alias("command"), F.col("event_type").alias("item"), F.floor(F.col("event_id") / 50).alias("version")), "user_id", 8, 20)


@query("r1_fresh", "SELECT event_id FROM events WHERE 10000 - event_id <= 500")
def _(t):
    return R.fresh(t("events"), "event_id", 10000, 500).select("event_id")


@query("r2_pending", "SELECT user_id AS job, n + 1 AS attempt FROM (SELECT user_id, count(*) AS n, max(CAST(value > 90 AS INTEGER)) AS ok FROM events WHERE event_id % 50 = 0 GROUP BY 1) WHERE ok = 0 AND n < 3 UNION ALL SELECT user_id, 1 FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 50 = 0)")
def _(t):
    every = t("events").withColumnRenamed("user_id", "job")
    return R.pending(every.select("job").distinct(), every.where("event_id % 50 = 0"), "job", 3, F.col("value") > 90)


@query("x_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return R.tumbling(t("events"), "ts", "1 hour", ["event_type"]).select("start", "event_type", "n")


@query("x_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(t):
    return R.sessions(t("events"), "ts", "30 minutes", ["user_id"]).select("user_id", "start", "n")

"""Further queries of record conversion, gates and documents (P*, F*, K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowforge.operators import normalise as N
from rowforge.operators import validate as V
from rowforge.sources import writers

from .registry import query


@query("p2_reference_text", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name ELSE 'x ' || n_name END AS reference FROM nation")
def _(t):
    k = F.col("n_nationkey") % 3
    raw = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit('{"text": "'), "n_name", F.lit('"}'))).otherwise(F.concat(F.lit('["x", {"value": "'), "n_name", F.lit('"}]')))
    return t("nation").select("n_nationkey", N.reference_text(raw).alias("reference"))


@query("p7_flat_grounding", "SELECT l_orderkey, l_linenumber, l_partkey AS image, dense_rank() OVER (ORDER BY f, l_partkey) - 1 AS image_index FROM (SELECT *, min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_partkey) AS f FROM lineitem)")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("image"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.array("l_tax", "l_tax", "l_quantity", "l_quantity").alias("bbox"))
    return N.flat_grounding(rows, "o").select("l_orderkey", "l_linenumber", "image", F.col("image_index").cast("long").alias("image_index"))


@query("p31_class_jobs", "SELECT regexp_replace(n_name || '__' || c, '[^A-Za-z0-9_.-]+', '_', 'g') AS job_id, 'Is there a ' || c || ' in this image?' AS prompt FROM nation, (VALUES ('ship'), ('wind turbine')) v(c)")
def _(t):
    return N.class_jobs(t("nation").select(F.col("n_name").alias("image")), ["ship", "wind turbine"]).select("job_id", "prompt")


@query("f11_review_gates", "SELECT l_orderkey, l_linenumber, l_tax > 0 AND l_discount > 0.02 AS pass FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") > 0).alias("a"), (F.col("l_discount") > 0.02).alias("b")).select("l_orderkey", "l_linenumber", V.gates_pass("a", "b").alias("pass"))


@query("f13_grounding_gate", "SELECT page_id, list_filter([CASE WHEN contains(lower(html), 'script') THEN 'metadata' END, CASE WHEN (length(html) - length(replace(html, '<p>', ''))) / 3 <> 1 OR (length(html) - length(replace(html, '</p>', ''))) / 4 <> 1 THEN 'pair' END], lambda x: x IS NOT NULL) AS reasons FROM pages")
def _(t):
    return t("pages").select("page_id", V.grounding_reasons("html", ["script"]).alias("reasons"))


@query("k6_markdown", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS value FROM nation")
def _(t):
    return writers.markdown(t("nation").select("n_nationkey", "n_name"))


@query("k10_coco_document")
def _(t):
    n = t("nation")
    return writers.coco_document(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("file_name")), t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("image_id")), t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))

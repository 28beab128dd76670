"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs; run() does so in the shared folder. All but the last return the
columns of docs as they came. Numbered rows are written once, as another reading could number them otherwise.

Defined cases, in every stage: null texts and empty ones are scored, compared, measured and sized as texts without words, and
none fails on them; very long texts are read whole; repeated rows are judged each (near duplicates keep one of them); any column may
be null and any may bear a name that a stage uses, since a row goes along as one value; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.llm import common, decontamination, jaccard_join, mixing, sharding, toxicity
from rowforge.session import ship

#: Near duplicates: words of a shingle, and the least Jaccard similarity.
SHINGLE, SIMILARITY = 5, (80, 100)


def _same(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def _numbered(docs: DataFrame) -> DataFrame:
    return common.cut(docs.withColumn("__rid", F.monotonically_increasing_id()), "pipeline-numbered")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores under 0.5; one without words has the score of an empty window. Ties at 0.5 go."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = toxicity.train(docs, labels)
    # "score" may be a column of docs, so the operator works on the row as one value
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    scored = toxicity.score(whole, model, keep=["__row"])
    return scored.where(F.col("score") < 0.5).select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the least doc_id; a null doc_id comes after all others, equal ids by row number. Documents without words stay."""
    ship(spark)
    rows = _numbered(docs)
    found = jaccard_join.jaccard_join(rows, id_col="__rid", size=SHINGLE, threshold=SIMILARITY).select("__rid", "component_id")
    ids = common.cut(rows.select("__rid", "doc_id").join(common.cut(found, "pipeline-components"), "__rid"), "pipeline-ids")
    groups = ids.groupBy("component_id").agg(F.count("*").alias("n"), F.min_by("__rid", F.struct(F.col("doc_id").isNull(), "doc_id", "__rid")).alias("stays")).where("n > 1")
    goes = common.cut(common.join_groups(ids, common.cut(groups, "pipeline-groups"), "component_id", "n", "inner").where("__rid <> stays").select("__rid"), "pipeline-goes")
    return _same(rows.join(goes, "__rid", "left_anti"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; those without words stay."""
    ship(spark)
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    found = decontamination.decontaminate(whole, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["__row"])
    return found.where(F.col("n_hit") == 0).select("__row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most; a null source is a source of its own. Documents without words come once for each whole pass over their source and if they stand before its cut."""
    return _same(mixing.mixed_documents(docs), docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, 0 to 7; a column of that name is replaced."""
    docs = docs.drop("shard")
    # columns of docs may bear the names that the operator works with, so they go along as one value
    known = sharding.described(docs.select("text", "source", "lang", "doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))).select("__row", "size", "__h", "__crc", "__salt", *sharding.DIMENSIONS)
    tree = sharding.plan(common.cut(known.drop("__row"), "pipeline-described"))
    return sharding.place(known, tree).select("__row.*", "shard")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The stages hold trained and iterative steps that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None

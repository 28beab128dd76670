"""Registry of queries: each has a DataFrame builder and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a builder f(t) where t(name) reads a table."""

    def put(build):
        QUERIES[name] = lambda spark, sf_dir: build(lambda n: table(ship(spark), sf_dir, n))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return put


@query(
    "a1_grouped_accuracy",
    """SELECT d.lang, d.source, count(*) AS n, count(*) FILTER (WHERE l.toxic = 1) AS n_toxic,
       CASE WHEN count(l.toxic) = 0 THEN NULL ELSE count(*) FILTER (WHERE l.toxic = 1) / count(l.toxic) END AS rate
       FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang, d.source""",
)
def _a1(t):
    from rowforge.operators.aggregate import grouped_accuracy

    d, lab = t("documents").select("doc_id", "lang", "source"), t("labels").select("doc_id", "toxic")
    toxic = F.col("toxic") == 1
    return grouped_accuracy(d.join(lab, "doc_id"), ["lang", "source"], toxic).select("lang", "source", "n", F.col("correct").alias("n_toxic"), F.col("accuracy").alias("rate"))

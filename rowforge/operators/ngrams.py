"""Text similarity: BLEU, ROUGE-L, METEOR, CIDEr in their variants.

Counts are joins of one n-gram relation (id, n, gram, count), so they stay in the JVM and
distribute by gram; only the two alignments that are dynamic programs run as Arrow UDFs.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.text import ascii_tokens, unicode_tokens


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by blanks."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def gram_counts(df: DataFrame, keys: list[str], tokens: str, orders: range = range(1, 5)) -> DataFrame:
    """(keys, n, gram, count) (M3)."""
    all_ = F.flatten(F.array(*[_tagged(tokens, n) for n in orders]))
    return df.select(*keys, F.explode(all_).alias("g")).groupBy(*keys, "g.n", "g.gram").agg(F.count("*").alias("count"))


def _tagged(tokens: str, n: int) -> Column:
    def tag(g: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), g.alias("gram"))

    return F.transform(ngrams(F.col(tokens), n), tag)


def _tokens(df: DataFrame, tokenizer: Callable[[str], Column]) -> tuple[DataFrame, DataFrame]:
    """Candidates (id, t) and references (id, ref, t) of rows (id, prediction, references)."""
    cand = df.select("id", tokenizer("prediction").alias("t"))
    refs = df.select("id", F.posexplode("references").alias("ref", "text")).select("id", "ref", tokenizer("text").alias("t"))
    return cand, refs


def corpus_bleu(df: DataFrame, tokenizer: Callable[[str], Column] = ascii_tokens, smooth: bool = False) -> DataFrame:
    """BLEU-1 to 4 of (id, prediction, references): counts clipped by the greatest over references, closest reference length (ties shorter).

    Without smoothing a zero precision makes a score 0 (M4); with it, zero numerators count 0.1 (M5).
    """
    cand, refs = _tokens(df, tokenizer)
    c = gram_counts(cand, ["id"], "t")
    r = gram_counts(refs, ["id", "ref"], "t").groupBy("id", "n", "gram").agg(F.max("count").alias("most"))
    by_n = c.join(r, ["id", "n", "gram"], "left").groupBy("n").agg(F.sum(F.least("count", F.coalesce("most", F.lit(0)))).alias("hit"), F.sum("count").alias("total"))
    diff = refs.select("id", F.size("t").alias("r")).join(cand.select("id", F.size("t").alias("c")), "id")
    lengths = diff.groupBy("id").agg(F.min(F.struct(F.abs(F.col("r") - F.col("c")), F.col("r"))).alias("m"), F.first("c").alias("c")).agg(F.sum("m.r").alias("r"), F.sum("c").alias("c"))
    p = by_n.agg(F.map_from_entries(F.collect_list(F.struct("n", F.struct("hit", "total")))).alias("p"))  # four rows
    row = p.crossJoin(lengths)
    bp = F.when(F.col("c") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    out = []
    for order in range(1, 5):
        terms = []
        for n in range(1, order + 1):
            x = F.try_element_at(F.col("p"), F.lit(n))
            hit = F.coalesce(x["hit"], F.lit(0)).cast("double")
            total = F.coalesce(x["total"], F.lit(0)).cast("double")
            if smooth:
                hit = F.when((hit == 0) & (total > 0), 0.1).otherwise(hit)
            terms.append(F.when((hit > 0) & (total > 0), F.ln(hit / total)))
        total_log = terms[0]
        for t in terms[1:]:
            total_log = total_log + t
        out.append(F.when(F.col("c") == 0, 0.0).otherwise(F.coalesce(bp * F.exp(total_log / order), F.lit(0.0))).alias(f"bleu_{order}"))
    return row.select(*out)


def cider_proxy(df: DataFrame, tokenizer: Callable[[str], Column] = ascii_tokens) -> DataFrame:
    """(id, score): relative frequencies x ln((N + 1) / (df + 1)), cosine, mean over references and orders, x 10."""
    return _cider(df, tokenizer, "cosine")


def cider_d(df: DataFrame, tokenizer: Callable[[str], Column] = unicode_tokens, sigma: float = 6.0) -> DataFrame:
    """(id, score): counts x (ln N - ln max(1, df)), clipped products, a Gaussian on the difference in bigrams."""
    return _cider(df, tokenizer, "d", sigma)


def cider_variant(df: DataFrame, tokenizer: Callable[[str], Column] = unicode_tokens) -> DataFrame:
    """(id, score): counts over the greatest count, idf ln((N + 1) / (df + 1)) + 1, cosine."""
    return _cider(df, tokenizer, "maxtf")


def _cider(df: DataFrame, tokenizer, kind: str, sigma: float = 6.0) -> DataFrame:
    cand, refs = _tokens(df, tokenizer)
    c, r = gram_counts(cand, ["id"], "t"), gram_counts(refs, ["id", "ref"], "t")
    n_docs = df.agg(F.count("*").alias("docs"))
    dfs = r.select("id", "n", "gram").distinct().groupBy("n", "gram").agg(F.count("*").alias("df"))
    idf = {"cosine": F.ln((F.col("docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)), "d": F.ln("docs") - F.ln(F.greatest(F.lit(1), F.coalesce("df", F.lit(0)))), "maxtf": F.ln((F.col("docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1}[kind]

    def weighed(x: DataFrame, keys: list[str]) -> DataFrame:
        whole = x.groupBy(*keys, "n").agg(F.sum("count").alias("total"), F.max("count").alias("most"))
        tf = {"cosine": F.col("count") / F.col("total"), "d": F.col("count").cast("double"), "maxtf": F.col("count") / F.col("most")}[kind]
        return x.join(whole, [*keys, "n"]).join(dfs, ["n", "gram"], "left").crossJoin(F.broadcast(n_docs)).select(*keys, "n", "gram", "total", (tf * idf).alias("w"))

    a, b = weighed(c, ["id"]), weighed(r, ["id", "ref"])
    na = a.groupBy("id", "n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("na"))
    nb = b.groupBy("id", "ref", "n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nb"))
    left = F.least(F.col("a.w"), F.col("b.w")) if kind == "d" else F.col("a.w")
    dot = a.alias("a").join(b.alias("b"), ["id", "n", "gram"]).groupBy("id", "ref", "n").agg(F.sum(left * F.col("b.w")).alias("dot"))
    orders = refs.select("id", "ref").join(df.select("id"), "id").select("id", "ref", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"))
    sim = orders.join(dot, ["id", "ref", "n"], "left").join(na, ["id", "n"], "left").join(nb, ["id", "ref", "n"], "left")
    value = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb"))).otherwise(0.0)
    if kind == "d":
        bigrams = lambda x, keys, name: x.where("n = 2").groupBy(*keys).agg(F.sum("count").alias(name))
        sim = sim.join(bigrams(c, ["id"], "ca"), "id", "left").join(bigrams(r, ["id", "ref"], "cb"), ["id", "ref"], "left")
        d = F.coalesce("ca", F.lit(0)) - F.coalesce("cb", F.lit(0))
        value = value * F.exp(-(d * d) / (2 * sigma * sigma))
    scored = sim.withColumn("s", value).groupBy("id").agg((10 * F.avg("s")).alias("score"))
    return df.select("id").join(scored, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _lcs(a: list, b: list) -> int:
    """Length of a longest common subsequence, by bit vectors."""
    if not len(a) or not len(b):
        return 0
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        m = at.get(y, 0)
        u = row & m
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _rouge(c: pd.Series, refs: pd.Series) -> pd.Series:
    def one(t, rs):
        best = 0.0
        for r in rs if rs is not None else ():
            k = _lcs(list(t), list(r))
            if k:
                p, q = k / len(t), k / len(r)
                best = max(best, 2 * p * q / (p + q))
        return best

    return pd.Series([one(t, r) for t, r in zip(c, refs, strict=True)])


def _meteor(c: pd.Series, refs: pd.Series) -> pd.Series:
    def one(t, rs):
        best = 0.0
        for r in rs if rs is not None else ():
            places: dict = {}
            for j, x in enumerate(r):
                places.setdefault(x, []).append(j)
            pairs, taken = [], dict.fromkeys(places, 0)
            for i, x in enumerate(t):  # each word takes the first free equal one
                if taken.get(x, 0) < len(places.get(x, ())):
                    pairs.append((i, places[x][taken[x]]))
                    taken[x] += 1
            m = len(pairs)
            if not m:
                continue
            p, q = m / len(t), m / len(r)
            chunks = 1 + sum(b[0] - a[0] != 1 or b[1] - a[1] != 1 for a, b in zip(pairs, pairs[1:], strict=False))
            best = max(best, 10 * p * q / (q + 9 * p) * (1 - 0.5 * (chunks / m) ** 3))
        return best

    return pd.Series([one(t, r) for t, r in zip(c, refs, strict=True)])


def rouge_l(df: DataFrame, tokenizer=ascii_tokens) -> DataFrame:
    """(id, score): F1 of the longest common subsequence, best over references (M6, M7)."""
    return df.select("id", F.pandas_udf(_rouge, "double")(tokenizer("prediction"), _ref_tokens(tokenizer)).alias("score"))


def meteor(df: DataFrame, tokenizer=ascii_tokens, stem: bool = False) -> DataFrame:
    """(id, score, backend): exact matches, or of stems; WordNet isn't available, and the backend says so (M8, M9)."""
    t = (lambda x: F.transform(tokenizer(x), stem_column)) if stem else tokenizer
    return df.select("id", F.pandas_udf(_meteor, "double")(t("prediction"), _ref_tokens(t)).alias("score"), F.lit("stem" if stem else "exact").alias("backend"))


def _ref_tokens(tokenizer) -> Column:
    """Arrays of reference tokens; tokenizers take names or columns."""
    return F.transform("references", lambda r: tokenizer(r))


def stem_column(word: Column) -> Column:
    """A light suffix stemmer: plural, -ing, -ed, -ly."""
    w = F.when(word.rlike("(ss|us|is)$"), word).otherwise(F.regexp_replace(word, "(?<=[a-z]{3})s$", ""))
    w = F.regexp_replace(w, "ie$", "y")
    return F.regexp_replace(w, "(?<=[a-z]{3})(ing|ed|ly)$", "")


def caption_summary(df: DataFrame) -> DataFrame:
    """The proxy and the project family in one row, and what can't be computed here."""
    proxy = corpus_bleu(df).select(*[F.col(f"bleu_{i}").alias(f"bleu_{i}_proxy") for i in range(1, 5)])
    project = corpus_bleu(df, unicode_tokens, smooth=True).select(*[(100 * F.col(f"bleu_{i}")).alias(f"bleu_{i}") for i in range(1, 5)])
    mean = lambda d, n: d.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias(n))
    parts = [project, mean(rouge_l(df), "rouge_l_proxy"), mean(meteor(df), "meteor_proxy"), mean(cider_proxy(df), "cider_proxy"), mean(rouge_l(df, unicode_tokens), "rouge_l"), mean(cider_d(df), "cider_d")]
    out = proxy
    for p in parts:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("coco_official", F.lit("unavailable"))

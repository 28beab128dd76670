"""Phrases whose words stand together more often than their parts would by chance, per language.

1. Texts are split into pieces and words. All 1- to max_n-grams of words within pieces become rows and are hash-aggregated per
   language, in two steps that together give exact counts:
   a. one length after the other, rows are (hash of language and gram, times), a few bytes each. A gram can reach `min_count` only if both
      grams that are a word shorter do, so from two words on rows are made of such grams only. Which hashes reached it is kept in a bit
      table; collisions let through more, never less.
   b. grams of all lengths that their tables let through become rows (language, phrase, times) and are counted by their text.
   A bit table has BITS_PER_GRAM bits a gram and MOST_BITS at most, which bounds the broadcast; where it fills up, more rows are
   made and the counts stay right. Equal grams of a block of texts are one row.
2. Grams of two words and more that reach min_count are candidates. Each is cut after each of its words, and the counts of both
   parts are joined to it; the score a * n * 1000 / (l * r) is an integer quotient of decimals.
3. A candidate is dropped if a one-word extension of it has at least `drop_share` percent of its count: an anti-join on the
   extensions' first and last words. A longer candidate that holds it with such a count has one-word extensions with no smaller count on
   the way, so looking at these is enough.
4. The first `top` of a language are ranked in bins of rows first, so no task ranks all of a language.

Within a block of texts grams are told apart by 64-bit hashes, beyond that by their text.

Defined cases: null and empty texts have no words; a null language is `und` and one with that one; ties are ordered by count, then by the
phrase's bytes; repeated rows count each; any word may be of any length; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
#: Bytes of text whose equal grams become one row, and bytes of phrases in one batch of rows.
BLOCK_BYTES, BATCH_BYTES = 2 << 20, 1 << 20
#: Bits of a gram's hash that are counted, and of a table for each gram in it and at most (32 MB).
HASH_BITS, BITS_PER_GRAM, MOST_BITS = 44, 16, 28
#: Rows of a bin in which a language's candidates are ranked first.
BIN_ROWS = 500_000

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def _table() -> np.ndarray:
    """Blanks, tabs and the ends of pieces separate words; A-Z become a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[0] = 255  # U+0000 is part of a word; byte 255 is in no UTF-8 text
    t[_BREAKS] = 0
    t[[0x20, 0x09]] = 0
    return t


TABLE = _table()
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


class Grams:
    """Words of a block of texts, and the hashes of their n-grams; a gram's place is that of its first word."""

    def __init__(self, x: C.Texts, lang: np.ndarray):
        self.x, self.w = x, C.words(x, TABLE)
        row = self.w.row_of()
        self.count = np.diff(self.w.off)
        self.lang = lang[row] if len(row) else np.zeros(0, np.uint64)
        # pieces of all rows are numbered through: a row's end is the end of a piece
        self.piece = np.searchsorted(np.flatnonzero(_BREAKS[x.data]), self.w.start) + row

    def hashes(self, n: int) -> np.ndarray:
        g = C.grams(self.w.hash, n)
        return C.mix(g + self.lang[: len(g)])

    def possible(self, n: int, shorter: Bits | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of n-grams within pieces whose shorter grams are in a table, and their hashes."""
        at = self.whole(n)
        if shorter is not None and len(at):
            may = shorter(self.hashes(n - 1))
            at = at[may[at] & may[at + 1]]
        return at, self.hashes(n)[at] if len(at) else np.zeros(0, np.uint64)

    def whole(self, n: int) -> np.ndarray:
        """Places where n words belong to one piece."""
        m = len(self.piece) - n + 1
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1 :]) if m > 0 else np.zeros(0, np.int64)

    def phrases(self, places: np.ndarray, n: int) -> Iterator[tuple[slice, pa.Array]]:
        """The words from each place on, joined by single blanks, a bounded number of bytes at a time."""
        long = self.w.end - self.w.start
        off = np.concatenate([[0], np.cumsum(long + 1)])
        size = off[places + n] - off[places] - 1
        upto = np.cumsum(size)
        lo = 0
        while lo < len(places):
            before = int(upto[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, before + BATCH_BYTES, "right")))
            # words of the batch, each with the blank that follows it
            first, many = places[lo:hi], np.full(hi - lo, n)
            word = np.repeat(first, many) + np.tile(np.arange(n), hi - lo)
            each = long[word] + 1
            end = np.cumsum(each)
            at = np.repeat(self.w.start[word] - (end - each), each) + np.arange(int(end[-1]))
            text = _LOWER[self.x.data[np.minimum(at, len(self.x.data) - 1)]]
            text[end - 1] = 32
            keep = np.ones(len(text), bool)
            keep[end[n - 1 :: n] - 1] = False  # no blank after the last word
            ends = np.cumsum(size[lo:hi]).astype(np.int32)
            yield slice(lo, hi), pa.StringArray.from_buffers(hi - lo, pa.py_buffer(np.concatenate([np.zeros(1, np.int32), ends])), pa.py_buffer(text[keep]))
            lo = hi


def _language_keys(names: list[str]) -> np.ndarray:
    """A hash of each name, the same in all tasks."""
    x = next(C.texts(pa.array(names, pa.string()), 1 << 30))
    out = np.zeros(len(names), np.uint64)
    for i in range(len(names)):
        b = np.frombuffer(x.text(i), np.uint8)
        out[i] = C.mix(np.add.reduce(C.BYTE_KEYS[b] * C.powers(len(b))[0], keepdims=True) + U(len(b)))[0]
    return out


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, Grams]]:
    """(language names, each row's place in them, grams) of a batch (lang, text), a bounded number of bytes at a time."""
    coded = b.column(0).dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    keys = _language_keys(names.to_pylist())
    for x in C.texts(b.column(1), BLOCK_BYTES):
        own = code[x.lo : x.hi]
        yield names, own, Grams(x, keys[own])


def _hashed(docs: DataFrame, n: int, shorter: Broadcast | None) -> DataFrame:
    """(h, times) of n-grams: HASH_BITS bits of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, g in _blocks(b):
                _, h = g.possible(n, None if shorter is None else shorter.value)
                if len(h):
                    h, times = np.unique(h >> U(64 - HASH_BITS), return_counts=True)
                    yield pa.RecordBatch.from_arrays([C.signed(h), pa.array(times.astype(np.int64))], names=["h", "times"])

    return docs.mapInArrow(run, "h long, times long")


def _phrases(docs: DataFrame, tables: Broadcast) -> DataFrame:
    """(lang, phrase, times) of the grams that the tables of all lengths let through, and a row a language with a null phrase, which counts its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, own, g in _blocks(b):
                total = np.bincount(own, weights=g.count, minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), pa.array(total)], names=["lang", "phrase", "times"])
                for n, table in enumerate(tables.value, 1):
                    at, h = g.possible(n, tables.value[n - 2] if n > 1 else None)
                    through = table(h)
                    _, first, times = np.unique(h[through], return_index=True, return_counts=True)
                    at = at[through][first]
                    if not len(at):
                        break
                    lang = names.take(pa.array(own[g.w.row_of()[at]]))
                    for part, phrase in g.phrases(at, n):
                        yield pa.RecordBatch.from_arrays([lang.slice(part.start, part.stop - part.start), phrase, pa.array(times[part].astype(np.int64))], names=["lang", "phrase", "times"])

    return docs.mapInArrow(run, "lang string, phrase string, times long")


class Bits:
    """Which of 2^size hash prefixes occur."""

    def __init__(self, words: np.ndarray, size: int):
        self.words, self.size = words, size

    def __call__(self, h: np.ndarray) -> np.ndarray:
        p = h >> U(64 - self.size)
        return (self.words[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1) == 1


def _bits(frequent: DataFrame, size: int) -> Bits:
    """The table of the hashes h of frequent: one 64-bit word a row, at most 2^(size - 6) rows."""
    down = HASH_BITS - size
    found = frequent.groupBy(F.shiftright("h", down + 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftright(h, {down}) & 63 AS INT))")).alias("word")).toArrow()
    words = np.zeros(1 << (size - 6), np.uint64)
    words[found["i"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return Bits(words, size)


def gram_counts(documents: DataFrame, text_col: str, lang_col: str, max_n: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of the grams with f >= min_count; and (lang, n), the words of each language."""
    docs = documents.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    spark = documents.sparkSession
    tables: list[Bits] = []
    for n in range(1, max_n + 1):
        shorter = spark.sparkContext.broadcast(tables[-1]) if tables else None
        found = C.cut(_hashed(docs, n, shorter).groupBy("h").agg(F.sum("times").alias("f")).where(F.col("f") >= min_count).select("h"), f"collocations-hashes-{n}")
        size = min(MOST_BITS, max(10, (found.count() * BITS_PER_GRAM).bit_length()))
        tables.append(_bits(found, size))
        C.free(found)
        if not tables[-1].words.any():
            break
    counts = _phrases(docs, spark.sparkContext.broadcast(tables)).groupBy("lang", "phrase").agg(F.sum("times").alias("f"))
    table = C.cut(counts.where(F.col("phrase").isNull() | (F.col("f") >= min_count)), "collocations-counts")
    words = C.cut(table.where("phrase IS NULL AND f > 0").select("lang", F.col("f").alias("n")), "collocations-words")
    return table.where("phrase IS NOT NULL"), words


def _parts(candidates: DataFrame) -> DataFrame:
    """A row for each candidate (lang, phrase, a) and cut k: its first k words and the rest."""
    word = F.split("phrase", " ", -1)
    cuts = F.transform(F.sequence(F.lit(1), F.size(word) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(word, F.lit(1), k), " ").alias("head"), F.array_join(F.slice(word, k + 1, F.size(word) - k), " ").alias("tail")))
    return candidates.select("lang", "phrase", "a", F.size(word).alias("words"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "words", "c.k", "c.head", "c.tail")


def _with_counts(rows: DataFrame, part: str, counts: DataFrame, out: str) -> DataFrame:
    """rows with the count of their `part`, also where a part has very many rows."""
    key = F.struct(F.col("lang"), F.col(part).alias("phrase"))
    keyed = C.cut(rows.withColumn("__key", key), f"collocations-{part}")
    sizes = keyed.groupBy("__key").agg(F.count("*").alias("__n"))
    known = C.cut(sizes.join(counts.select(F.struct("lang", "phrase").alias("__key"), F.col("f").alias(out)), "__key"), f"collocations-{part}-counts")
    return C.join_groups(keyed, known, "__key", "__n", "inner").drop("__key")


#: floor(1000 * a * n / (l * r)). As no count is over n and a is no more than l and r, the score is at most 1000 * n; products have up to 38 digits.
SCORE = "(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(17, 0)) * CAST(r AS DECIMAL(17, 0)))"


def top_of_each(rows: DataFrame, group: str, order: list[Column], top: int, name: str) -> DataFrame:
    """The first `top` rows of each group with their rank, by bins of rows first and then among what those leave."""
    table = C.cut(rows, name)
    bins = max(1, -(-table.count() // BIN_ROWS))
    dealt = table.withColumn("__bin", F.pmod(F.xxhash64(*table.columns), F.lit(bins)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(group, "__bin").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= top).drop("__bin")


def collocations(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = 5, min_count: int = 100, drop_share: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, k): the best phrases of each language; k is the cut whose parts l and r count."""
    counts, words = gram_counts(documents, text_col, lang_col, max_n, min_count)
    candidates = counts.where(F.contains("phrase", F.lit(" "))).withColumnRenamed("f", "a")
    parts = C.cut(_parts(candidates), "collocations-parts")
    longest = reduce(DataFrame.unionByName, [parts.where(F.col("k") == k).select("lang", F.col(p).alias("phrase"), F.col("a").alias("longer")) for k, p in ((F.col("words") - 1, "head"), (F.lit(1), "tail"))])
    extended = longest.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = candidates.alias("c").join(extended.alias("e"), (F.col("c.lang") == F.col("e.lang")) & (F.col("c.phrase") == F.col("e.phrase")) & (F.lit(100) * F.col("e.longer") >= F.lit(drop_share) * F.col("c.a")), "left_anti")
    kept = parts.join(left.select("lang", "phrase"), ["lang", "phrase"], "left_semi")
    both = _with_counts(_with_counts(kept, "head", counts, "l"), "tail", counts, "r").join(words, "lang")
    scored = both.withColumn("score", F.expr(SCORE))
    lowest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("low"))
    flat = lowest.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score", "low.k")
    ranked = top_of_each(flat, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top, "collocations-scored")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")


def op11(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("rank", F.col("rank").cast("long")).drop("k")

"""Fill-in-middle examples: each text is cut at two of its units and its three parts are put in another order.

A unit begins at the start of a text and wherever a predicate of two adjacent characters holds (a line begins after a
line feed). So boundaries can be counted in pieces:

1. Texts are decomposed into chunks of `chunk_bytes` that overlap by one byte, so that each pair of neighbours is whole
   in exactly one chunk. A text of one chunk is counted where it lies; chunks of longer texts are dealt out over the tasks.
2. Each chunk counts its own boundaries, by itself.
3. Prefix sums over a text's counts give its number of units, hence its two cut ranks, and name the chunk that owns each rank.
4. Only the owning chunks are scanned again, for the byte at which the rank lies.

Predicates are of ASCII characters, so a chunk may begin within a longer character. All of this is DataFrame functions; texts
of one chunk are never shuffled, longer ones twice.

Defined cases: null and empty texts are `plain` with no units; a text that contains a mark is `plain`, since it couldn't be
taken apart again; a null id is hashed as the empty string; repeated rows give equal rows; a text without any boundary is one unit;
cuts may coincide and parts may be empty; an empty table gives no rows; kept columns may bear any names but are replaced by new ones of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.boxes import let
from . import common as C

#: The last character of a unit, with a look at the one after it, which begins the next unit.
BOUNDARIES = {
    "line": r"\n(?!\z)",
    "word": r"[\x20\x09-\x0D](?=[^\x20\x09-\x0D])",
    "char": r"[\x00-\xFF](?=[\x00-\x7F\xC0-\xFF])",
}
CHUNK_BYTES = 1 << 16
MARKS = ("<P>", "<S>", "<M>")
FIELDS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def draws(id_: Column, seed: int) -> list[Column]:
    """Four integers of 32 bits that depend on the seed and a row's id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _chunk(data: Column, k: Column, chunk_bytes: int) -> Column:
    """Chunk k with the byte before it, a character a byte."""
    lo = F.greatest(k.cast("int") * chunk_bytes - 1, F.lit(0))
    return F.decode(F.substring(data, lo + 1, k.cast("int") * chunk_bytes + chunk_bytes - lo), "ISO-8859-1")


def _place(data: Column, k: Column, rank: Column, boundary: str, chunk_bytes: int) -> Column:
    """Byte of the text at which the rank-th boundary of chunk k lies."""
    chunk = _chunk(data, k, chunk_bytes)
    rest = F.element_at(F.split(chunk, boundary, rank.cast("int") + 1), -1)
    return F.greatest(k.cast("int") * chunk_bytes - 1, F.lit(0)) + F.length(chunk) - F.length(rest)


def _ranks(n: Column, h1: Column, h2: Column) -> tuple[Column, Column]:
    return F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))


def _owners(chunks: DataFrame, boundary: str) -> DataFrame:
    """(rid, route) from chunks (rid, h, k, chunk), which are counted one by one; see _routed."""
    counts = chunks.select("rid", "h", "k", F.regexp_count("chunk", F.lit(boundary)).cast("long").alias("found"))
    upto = counts.withColumn("upto", F.expr("sum(found) OVER (PARTITION BY rid ORDER BY k)")).withColumn("n", F.expr("sum(found) OVER (PARTITION BY rid)") + 1)
    ranks = upto.withColumns(dict(zip(("a", "b"), _ranks(F.col("n"), F.col("h")[0], F.col("h")[1]), strict=True)))

    def owner(cut: str, value: Column) -> Column:
        return F.max(F.when((F.col(cut) <= F.col("upto")) & (F.col(cut) > F.col("upto") - F.col("found")) & (F.col(cut) < F.col("n")), value))

    found = ranks.groupBy("rid").agg(
        *[F.max(c).alias(c) for c in ("n", "a", "b")],
        *[owner(c, v).alias(f"{name}_{c}") for c in ("a", "b") for name, v in (("k", F.col("k")), ("r", F.col(c) - F.col("upto") + F.col("found")))],
    )
    return found.select("rid", F.struct(*[c for c in found.columns if c != "rid"]).alias("route"))


def _routed(docs: DataFrame, boundary: str, chunk_bytes: int) -> DataFrame:
    """docs (row, data, h) with route: units n, cut ranks a and b, and the owner k of each and the rank r within it; null where a cut is a text's start or end."""

    def local(n: Column) -> Column:
        a, b = _ranks(n, F.col("h")[0], F.col("h")[1])
        inside = lambda rank, value: F.when((rank > 0) & (rank < n), value)
        return F.struct(n.alias("n"), a.alias("a"), b.alias("b"), *[x for c, rank in (("a", a), ("b", b)) for x in (inside(rank, F.lit(0)).alias(f"k_{c}"), inside(rank, rank).alias(f"r_{c}"))])

    count = F.when(F.length("data") == 0, F.lit(0)).otherwise(F.regexp_count(_chunk(F.col("data"), F.lit(0), chunk_bytes), F.lit(boundary)) + 1).cast("long")
    one = docs.where(F.length("data") <= chunk_bytes).withColumn("route", let(count, local))
    # a row of these is numbered once, in a table that lost executors can read again
    many = C.cut(docs.where(F.length("data") > chunk_bytes).withColumn("rid", F.monotonically_increasing_id()), "fim-long")
    last = F.floor((F.length("data") - 1) / chunk_bytes).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("k"), _chunk(F.col("data"), k, chunk_bytes).alias("chunk")))
    dealt = many.select("rid", "h", F.explode(pieces).alias("p")).select("rid", "h", "p.k", "p.chunk").repartition("rid", "k")
    return one.unionByName(many.join(_owners(dealt, boundary), "rid").drop("rid"))


def fill_in_middle(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, marks: tuple[str, str, str] = MARKS, chunk_bytes: int = CHUNK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (id_col by default), n (units), form, prefix_chars, middle_chars and output (text in its new order).

    rate: percent of texts that are rearranged, the others stay plain; spm: percent of those that begin with the suffix.
    marks: of prefix, suffix and middle; none may end as it or another one begins (< and > tell the default ones apart).
    """
    kept = [c for c in (keep or [id_col]) if c not in FIELDS]
    boundary = BOUNDARIES[unit]
    data = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), data.alias("data"), F.array(*draws(F.col(f"`{id_col}`"), seed)).alias("h"))
    p, s, m = (F.lit(x) for x in marks)

    def end(x: Column, c: str) -> Column:
        r = x["route"]
        return F.when(r[c] == 0, F.lit(0)).when(r[c] == r["n"], F.length(x["data"])).otherwise(_place(x["data"], r[f"k_{c}"], r[f"r_{c}"], boundary, chunk_bytes))

    def form(text: Column, h: Column) -> Column:
        plain = (text == "") | (h[2] % 100 >= rate)
        for mark in marks:
            plain = plain | F.contains(text, F.lit(mark))
        return F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")

    def arranged(x: Column) -> Column:
        """form and the three parts of a text whose cuts are known."""
        part = lambda lo, hi: F.substring(x["data"], lo + 1, hi - lo).cast("string")
        cuts = F.struct(end(x, "a").alias("at"), end(x, "b").alias("to"))
        return let(cuts, lambda c: F.struct(part(F.lit(0), c["at"]).alias("prefix"), part(c["at"], c["to"]).alias("middle"), part(c["to"], F.length(x["data"])).alias("suffix")))

    def made(x: Column) -> Column:
        none = F.lit(None).cast("long")
        plain = F.struct(x["form"].alias("form"), none.alias("prefix_chars"), none.alias("middle_chars"), x["data"].cast("string").alias("output"))

        def moved(t: Column) -> Column:
            output = F.when(x["form"] == "psm", F.concat(p, t["prefix"], s, t["suffix"], m, t["middle"])).otherwise(F.concat(s, t["suffix"], p, t["prefix"], m, t["middle"]))
            return F.struct(x["form"].alias("form"), F.char_length(t["prefix"]).cast("long").alias("prefix_chars"), F.char_length(t["middle"]).cast("long").alias("middle_chars"), output.alias("output"))

        return F.when(x["form"] == "plain", plain).otherwise(let(arranged(x), moved))

    routed = _routed(docs, boundary, chunk_bytes)
    whole = F.struct("data", "route", form(F.col("data").cast("string"), F.col("h")).alias("form"))
    # values that are used often are bound once: as columns of their own, a filter on the output would multiply them
    return routed.select("row", F.col("route.n").alias("n"), let(whole, made).alias("made")).select("row.*", "n", "made.*")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of fill_in_middle was made from."""
    p, s, m = marks

    def between(first: str, second: str, order: tuple[int, int, int]) -> Column:
        """What stands after the marks first, second and m, in this order; texts hold none of them, so the first place of each is the right one."""

        def split(one: Column) -> Column:
            rest = F.substr(output, F.char_length(one) + len(second) + 1)
            return let(rest, lambda r: let(F.substring_index(r, m, 1), lambda two: F.concat(*[(F.substr(one, F.lit(len(first) + 1)), two, F.substr(r, F.char_length(two) + len(m) + 1))[i] for i in order])))

        return let(F.substring_index(output, second, 1), split)

    return F.when(form == "psm", between(p, s, (0, 2, 1))).when(form == "spm", between(s, p, (1, 2, 0))).otherwise(output)


def op12(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))

"""Row and column algebra of batches, sharding and balanced partitions."""

from __future__ import annotations

import bisect
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions.hashing import hash_bin


def slice_rows(df: DataFrame, idx: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... before stop, by index."""
    i = F.col(idx)
    inside = i >= start if stop is None else (i >= start) & (i < stop)
    return df.where(inside & (F.pmod(i - start, F.lit(step)) == 0))


def concat(frames: list[DataFrame], meta: list[dict] | None = None) -> DataFrame:
    """All rows; shared metadata must be equal."""
    seen: dict = {}
    for m in meta or []:
        for k, v in m.items():
            if k in seen and seen[k] != v:
                raise ValueError(f"metadata differs at {k}: {seen[k]} and {v}")
            seen[k] = v
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the left that the right lacks."""
    return left.select(key).subtract(right.select(key))


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def pop(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columns, and the rest."""
    return df.select(*columns), df.drop(*columns)


def select_positions(df: DataFrame, idx: str, positions: DataFrame) -> DataFrame:
    """Rows at positions (pos, idx), repeats and order kept by pos."""
    return positions.join(df, idx)


def repeat(df: DataFrame, idx: str, n: Column | int, interleave: bool = True) -> DataFrame:
    """Each row n times with `order`: copies side by side, or the whole batch again."""
    times = n if isinstance(n, Column) else F.lit(n)
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    return out.withColumn("order", F.struct(idx, "copy") if interleave else F.struct("copy", idx))


def unfold_chunks(df: DataFrame, column: str, size: int) -> DataFrame:
    """Arrays cut into pieces of `size`, one row each."""
    n = F.ceil(F.size(column) / size).cast("int")
    return df.where(F.size(column) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1))).withColumn(column, F.slice(F.col(column), F.col("chunk") * size + 1, F.lit(size)))


def chunks(df: DataFrame, idx: str, total: int, parts: int) -> DataFrame:
    """Contiguous parts whose sizes differ by one at most, the larger ones first."""
    size, more = divmod(total, parts)
    i = F.col(idx)
    big = more * (size + 1)
    return df.withColumn("part", F.when(i < big, F.floor(i / (size + 1))).otherwise(more + F.floor((i - big) / max(size, 1))).cast("int"))


def pad_to_divisor(df: DataFrame, idx: str, total: int, divisor: int) -> DataFrame:
    """df and its first rows again until the number divides; `pad` marks them."""
    missing = -total % divisor
    out = df.withColumn("pad", F.lit(False))
    turn = 0
    while missing > 0:
        take = min(missing, total)
        out = out.unionByName(df.where(F.col(idx) < take).withColumn(idx, F.col(idx) + total * (turn + 1)).withColumn("pad", F.lit(True)))
        missing -= take
        turn += 1
    return out


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("pad")).drop("pad")


def mini_batches(df: DataFrame, identity: str, size: int, epochs: int, seed: int) -> DataFrame:
    """(epoch, batch) of each row: another hash order each epoch (W10). Batches are dealt by hash ranges, near `size` rows each."""
    n = df.count()
    batches = max(1, n // size)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("epoch"), F.col(identity)), F.lit(batches))
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("batch", u)


def round_robin(df: DataFrame, idx: str, shards: int) -> DataFrame:
    """(W11)"""
    return df.withColumn("shard", F.pmod(F.col(idx), F.lit(shards)).cast("int"))


def workload(n: Column | str) -> Column:
    """Cost of a sequence: linear plus quadratic."""
    x = (F.col(n) if isinstance(n, str) else n).cast("long")
    return 24576 * x + x * x


class _Last:
    """Orders a heap by the greatest of what it holds."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other) -> bool:
        return other.value < self.value


def karmarkar_karp(weights: list[int], parts: int, equal: bool = False) -> list[list[int]]:
    """Places dealt to parts by largest differencing; with equal, parts hold equally many.

    A part is (weight, items, [(place, weight)]), and parts compare as such. The two partial solutions that differ most in
    their parts are joined first, of equally different ones those with the greatest part; the heavy parts of one join the light parts of the other.
    """
    order = sorted(range(len(weights)), key=lambda i: (weights[i], i))
    if equal and len(weights) % parts:
        raise ValueError("parts of equal size need a number of items that divides")
    step = parts if equal else 1
    empty = (0, 0, [])
    heap: list = []

    # a state lists its parts with items, the lightest first; the others, up to `parts`, are empty and lighter than any of them
    def push(state: list) -> None:
        least = state[0][0] if len(state) == parts else 0
        heapq.heappush(heap, (least - state[-1][0], _Last(state[-1]), state))

    def joined(a: list, b: list) -> list:
        """The heaviest parts of one join the lightest of the other; parts that meet an empty one stay as they are."""
        turned = len(a) < len(b)
        if turned:
            a, b = b, a
        meet = len(a) + len(b) - parts
        new = b
        if meet > 0:
            met = zip(reversed(b[:meet]), a[:meet]) if turned else zip(a[:meet], reversed(b[:meet]))  # the first state's items come first
            new = b[meet:] + [(x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in met]
            del a[:meet]
        if len(new) > 16:
            a += new
            a.sort()
        else:
            for x in new:
                bisect.insort(a, x)
        return a

    for k in range(0, len(order), step):
        push(sorted((weights[i], 1, [(i, weights[i])]) for i in order[k : k + step]))
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        push(joined(a, b))
    return [sorted(i for i, _ in p[2]) for p in [*reversed(heap[0][2]), *[empty] * (parts - len(heap[0][2]))]] if heap else [[] for _ in range(parts)]


def greedy_partition(weights: list[int], parts: int, equal: bool = False) -> list[list[int]]:
    """In their order, each to the lightest part, the first of equals; with equal, to one of those with the fewest items."""
    if equal and len(weights) % parts:
        raise ValueError("parts of equal size need a number of items that divides")
    heap = [(0, 0, k) for k in range(parts)]
    out: list[list[int]] = [[] for _ in range(parts)]
    for i, x in enumerate(weights):
        n, w, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (n + 1 if equal else 0, w + x, k))
    return out


def _by_batch(rows: DataFrame, batch: str, plan, fields: dict[str, str]) -> DataFrame:
    """(batch, identity, fields) that plan(Arrow table of one batch, in the order of identity) gives."""
    schema = T.StructType([rows.schema[batch], rows.schema["__id"], *[T.StructField(k, T.LongType()) for k in fields]])

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("__id")
        found = plan(table, key[0].as_py())
        return pa.table([table[batch], table["__id"], *[pa.array(found[k], pa.int64()) for k in fields]], names=schema.names)

    # a batch's rows are few bytes and dear, so partitions aren't joined by size
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, batch).groupBy(batch).applyInArrow(one, schema)


def balanced_batches(df: DataFrame, batch: str, identity: str, weight: str, parts: int, method: str = "kk", equal: bool = False, together: str | None = None) -> DataFrame:
    """df with `part`, 0 to parts - 1, of a balanced partition of each batch.

    method: "kk" (largest differencing) or "greedy"; equal: parts hold equally many rows. together: rows of one value stay in one part and parts hold
    equally many values. One batch is planned in one task, from its ids and weights only.

    Defined cases: a batch of fewer rows (or values) than parts is an error, as is one that doesn't divide where it has to; null weights count 0; ids are
    unique within a batch; an empty table stays empty.
    """
    rows = df.select(batch, F.col(identity).alias("__id"), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("__w"), *([F.col(together).alias("__u")] if together else []))

    def plan(t: pa.Table, key) -> dict:
        w = t["__w"].to_pylist()
        if together:
            first: dict = {}
            member = [first.setdefault(u, len(first)) for u in t["__u"].to_pylist()]
            total = [0] * len(first)
            for k, x in zip(member, w, strict=True):
                total[k] += x
        else:
            member, total = list(range(len(w))), w
        if len(total) < parts:
            raise ValueError(f"batch {key}: {len(total)} can't be dealt to {parts} parts")
        groups = karmarkar_karp(total, parts, equal or together is not None) if method == "kk" else greedy_partition(total, parts, equal or together is not None)
        of = {m: k for k, g in enumerate(groups) for m in g}
        return {"part": [of[m] for m in member]}

    found = _by_batch(rows, batch, plan, {"part": "long"}).withColumnRenamed("__id", identity)
    return df.join(found.withColumn("part", F.col("part").cast("int")), [batch, identity])


def dynamic_batches(df: DataFrame, batch: str, identity: str, length: str, most_tokens: int, least: int = 1, multiple: int = 1, same: bool = False, heaviest_inside: bool = True) -> DataFrame:
    """df with bin, place and back: each batch in bins of about most_tokens, balanced by workload.

    A batch gets as many bins as its tokens need, but no fewer than `least`, in multiples of `multiple`; with same, all batches get as many as the
    one that needs most. The lightest bins come first and last. place: a row's place when bins stand one after the other; back: its place in the batch
    by id, so a sort by `back` undoes it.

    Defined cases: a row longer than most_tokens, or more bins than rows, is an error; null lengths count 0; ids are unique within a batch; an empty table stays empty.
    """
    n = F.coalesce(F.col(length).cast("long"), F.lit(0))
    rows = df.select(batch, F.col(identity).alias("__id"), n.alias("__n"), workload(n).alias("__w"))
    need = rows.groupBy(batch).agg(F.greatest(F.lit(least), F.least(F.count("*"), F.ceil(F.sum("__n") / most_tokens))).alias("__k"))
    if same:
        need = need.select(batch).crossJoin(F.broadcast(need.agg(F.max("__k").alias("__k"))))  # one row
    rows = rows.join(need.withColumn("__k", F.ceil(F.col("__k") / multiple) * multiple), batch)

    def plan(t: pa.Table, key) -> dict:
        w, bins = t["__w"].to_pylist(), t["__k"][0].as_py()
        if max(t["__n"].to_pylist()) > most_tokens:
            raise ValueError(f"batch {key}: a row is longer than {most_tokens}")
        if bins > len(w):
            raise ValueError(f"batch {key}: {len(w)} rows can't fill {bins} bins")
        order = bin_order(karmarkar_karp(w, bins), w) if heaviest_inside else karmarkar_karp(w, bins)
        out = {c: [0] * len(w) for c in ("bin", "place", "back")}
        place = 0
        for b, items in enumerate(order):
            for i in items:
                out["bin"][i], out["place"][i], out["back"][i] = b, place, i
                place += 1
        return out

    found = _by_batch(rows, batch, plan, {"bin": "long", "place": "long", "back": "long"}).withColumnRenamed("__id", identity)
    return df.join(found, [batch, identity])


def bin_order(groups: list[list[int]], weights: list[int]) -> list[list[int]]:
    """Bins by weight with the heaviest in the middle: every second one of the falling order, turned round, then the others."""
    falling = sorted(groups, key=lambda g: (sum(weights[i] for i in g), g[0] if g else 0), reverse=True)
    return falling[::2][::-1] + falling[1::2]


def balanced(df: DataFrame, identity: str, weight: str, parts: int, method: str = "kk", most_rows: int = 100_000) -> DataFrame:
    """df with `part` of a balanced partition of one batch (W12). A batch is planned in one task, so a larger table is refused; see balanced_batches."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"a batch has no more than {most_rows} rows; deal the table into batches first")
    return balanced_batches(df.withColumn("__batch", F.lit(0)), "__batch", identity, weight, parts, method).select(*df.columns, "part")


def imbalance(df: DataFrame, part: str, weight: str) -> DataFrame:
    """Least, greatest and mean weight of parts, and greatest over mean."""
    return df.groupBy(part).agg(F.sum(weight).alias("w")).agg(F.min("w").alias("least"), F.max("w").alias("most"), F.avg("w").alias("mean"), (F.max("w") / F.avg("w")).alias("imbalance"))


def length_grouped(df: DataFrame, identity: str, length: str, batch: int, mega: int, seed: int) -> DataFrame:
    """Mega-batches by hash, rows by falling length within each (W14): (mega, place)."""
    n = max(1, -(-df.count() // (batch * mega)))
    m = df.withColumn("mega", hash_bin(F.concat(F.lit(f"{seed}:"), F.col(identity).cast("string")), n))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("mega").orderBy(F.col(length).desc(), identity)) - 1)


def micro_batches(weights: list[int], lengths: list[int], most_tokens: int) -> tuple[list[list[int]], list[int]]:
    """Of one batch in memory: balanced bins, the heaviest in the middle, and the permutation that restores the order (W15); dynamic_batches does so for tables."""
    bins = min(len(lengths), -(-sum(lengths) // most_tokens)) if lengths else 0
    order = bin_order([g for g in karmarkar_karp(weights, bins) if g], weights) if bins else []
    flat = [i for g in order for i in g]
    back = [0] * len(flat)
    for place, i in enumerate(flat):
        back[i] = place
    return order, back

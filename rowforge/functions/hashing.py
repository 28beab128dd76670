"""Portable ids, sampling keys and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def stable_id(*parts: Column | str, length: int = 20) -> Column:
    """SHA-256 of the parts joined by U+001F, first hex digits; null counts as None."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(_c(p).cast("string"), F.lit("None")) for p in parts]), 256), F.lit(length))


def rank_key(seed: int, identity: Column | str) -> Column:
    """Hex digests sort as their bytes do, so a rank by this key is portable."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), _c(identity).cast("string")), 256)


def hash_bin(text: Column, bins: int) -> Column:
    """0 to bins - 1 by the first eight hex digits of SHA-256."""
    return F.pmod(F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("long"), F.lit(bins).cast("long"))


def namespaced_key(seed: int, namespace: str, value: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|{namespace}|"), _c(value).cast("string")), 256)


def canonical_json(*names: str) -> Column:
    """JSON of columns: names sorted, no blanks, nulls kept."""
    return F.to_json(F.struct(*[F.col(n).alias(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def content_id(*names: str, explicit: str | None = None) -> Column:
    """An explicit id where it is there and not empty, else SHA-256 of canonical JSON (H3)."""
    digest = F.sha2(canonical_json(*names), 256)
    return digest if explicit is None else F.coalesce(F.when(F.col(explicit) != "", F.col(explicit)), digest)


def first_key(prefix: Column | str, names: list[str], images: Column | str, query: Column | str) -> Column:
    """prefix:name:value of the first id column that is there and not empty, else sha1: and SHA-1 of benchmark, images and query as JSON with blanks after commas and colons (H3)."""
    found = [F.when(F.col(n).cast("string") != "", F.concat_ws(":", _c(prefix), F.lit(n), F.col(n).cast("string"))) for n in names]
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    pictures = F.array_join(F.transform(F.coalesce(_c(images), F.array().cast("array<string>")), quoted), ", ")
    row = F.concat(F.lit('{"benchmark": '), quoted(_c(prefix)), F.lit(', "images": ['), pictures, F.lit('], "query": '), quoted(F.coalesce(_c(query), F.lit(""))), F.lit("}"))
    return F.coalesce(*found, F.concat(F.lit("sha1:"), F.sha1(row)))


def ordered_digest(order: Column | str, *names: str) -> Column:
    """Aggregate: SHA-256 of the canonical JSON list of a group's rows in order, for groups of a size that one row can hold (H4)."""
    rows = F.array_sort(F.collect_list(F.struct(_c(order).alias("o"), canonical_json(*names).alias("v"))))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["v"]), ","), F.lit("]")), 256)


def fractional_count(rate: Column | float, seed: int, *keys: Column | str) -> Column:
    """Whole part of a rate, and one more with the chance of its fraction, the same each time for a key."""
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    u = F.pmod(F.xxhash64(F.lit(seed), *[_c(k) for k in keys]), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(r) + F.when(u < r - F.floor(r), 1).otherwise(0)).cast("int")


def relative_delta(new: Column | str, old: Column | str) -> Column:
    """(new - old) / |old|, null at 0 (H7)."""
    return F.try_divide(_c(new) - _c(old), F.abs(_c(old)))


#: Tokens that a task may take at first; one data set's captions take more.
TASK_TOKENS = {"caption": 384, "change_caption": 128, "open_vqa": 128, "bbox": 64, "single_choice": 128, "multi_choice": 64}
DATASET_TOKENS = {("xlrs_caption", "caption"): 550}


def first_budget(dataset: Column | str, task: Column | str) -> Column:
    """Tokens of a first attempt (H8)."""
    table = F.create_map(*[F.lit(x) for kv in TASK_TOKENS.items() for x in kv])
    out = F.try_element_at(table, _c(task))
    for (d, k), n in DATASET_TOKENS.items():
        out = F.when((_c(dataset) == d) & (_c(task) == k), n).otherwise(out)
    return out


def token_budget(base: Column | str, retries: Column | str, most: int = 2) -> Column:
    """Doubles with each retry, up to 2^most times (H8)."""
    return (_c(base) * F.pow(F.lit(2.0), F.least(_c(retries), F.lit(most)))).cast("int")

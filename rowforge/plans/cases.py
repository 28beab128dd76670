"""Queries whose SQL states the results of hand-written cases.

Each row of `part` is dealt one case by its key; {p} in a case stands for the row's name, so texts differ by row. The
expected values are literals that were worked out from what the operator has to do, not from what it does here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import query


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(_literal(x) for x in v) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def cases(name: str, rows: list[tuple], columns: dict[str, str]):
    """Register f(inputs: list of columns) -> list of columns, one for each of `columns` (name -> DuckDB type).

    rows: inputs and expected values, e.g. ("(b) {p}", "B") where there is one input and one column.
    """
    wide = len(rows[0]) - len(columns)
    values = ", ".join(f"({i}, {', '.join(_literal(v) for v in r[wide:])})" for i, r in enumerate(rows))
    names = list(columns)

    def out(n: str) -> str:
        kind = columns[n]
        if kind == "VARCHAR":
            return f"replace(CAST({n}_ AS VARCHAR), '{{p}}', p_name) AS {n}"
        if kind == "VARCHAR[]":
            return f"list_transform(CAST({n}_ AS VARCHAR[]), lambda x: replace(x, '{{p}}', p_name)) AS {n}"
        return f"CAST({n}_ AS {kind}) AS {n}"

    sql = f"SELECT p_partkey, {', '.join(out(n) for n in names)} FROM part JOIN (VALUES {values}) AS c(i, {', '.join(n + '_' for n in names)}) ON i = p_partkey % {len(rows)}"

    def put(f: Callable[..., Column | list[Column]]):
        def build(t):
            at = (F.col("p_partkey") % len(rows) + 1).cast("int")
            pick = lambda j: F.element_at(F.array(*[F.lit(r[j]) for r in rows]), at)
            ins = [F.replace(pick(j), F.lit("{p}"), F.col("p_name")) if any(isinstance(r[j], str) for r in rows) else pick(j) for j in range(wide)]
            src = t("part").select("p_partkey", *[c.alias(f"in{j}") for j, c in enumerate(ins)])
            got = f(*[F.col(f"in{j}") for j in range(wide)])
            got = got if isinstance(got, (list, tuple)) else [got]
            return src.select("p_partkey", *[g.alias(n) for g, n in zip(got, names, strict=True)])

        query(name, sql)(build)
        return f

    return put

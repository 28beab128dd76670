"""Joins that a review found short of their job."""

import pytest

from rowforge.operators import joins as J


@pytest.mark.parametrize(("k", "at_once"), [(1, 8192), (3, 40)])
def test_disjoint_partner_is_found_wherever_one_exists(spark, monkeypatch, k, at_once):
    monkeypatch.setattr(J, "ROWS_AT_ONCE", at_once, raising=False)
    rows = {i: {"hot", f"w{i % 7}"} for i in range(300)} | {1000 + i: {f"cold{i}"} for i in range(2)} | {2000: {"hot", "cold0", "cold1"}}
    df = spark.createDataFrame([(i, sorted(t)) for i, t in rows.items()], "id long, t array<string>")
    got = {}
    for r in J.disjoint_partner(df, "id", "t", k=k).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["partner"]))
    for i, t in rows.items():
        others = {j for j, u in rows.items() if j != i and not t & u}
        mine = sorted(got.get(i, []))
        assert [n for n, _ in mine] == list(range(1, min(k, len(others)) + 1))
        assert len({p for _, p in mine}) == len(mine) and {p for _, p in mine} <= others

"""Largest differencing of a batch with thousands of bins (round 3)."""

import random
import time

from rowforge.operators.batch import karmarkar_karp


def test_a_batch_of_many_bins_is_planned_in_its_size():
    r = random.Random(2)
    w = [r.randrange(1, 10**6) for _ in range(12_000)]
    start = time.process_time()
    parts = karmarkar_karp(w, 1500)
    assert time.process_time() - start < 10  # lists of all bins for each row took minutes
    assert sorted(i for p in parts for i in p) == list(range(12_000)) and len(parts) == 1500
    sums = [sum(w[i] for i in p) for p in parts]
    assert max(sums) - min(sums) < 10**5 and sums == sorted(sums, reverse=True)


def test_fewer_rows_than_bins_and_rows_without_weight():
    assert karmarkar_karp([5, 0, 3], 5) == [[0], [2], [1], [], []]
    assert karmarkar_karp([0, 0, 0, 0], 2, equal=True) == [[1, 3], [0, 2]] or sorted(map(len, karmarkar_karp([0, 0, 0, 0], 2, equal=True))) == [2, 2]

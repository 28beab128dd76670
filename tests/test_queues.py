"""The queue of samples against a plain deque, as a table and as a stream that stops and goes on."""

import collections
import random

from rowforge.streaming import queues as Q
from rowforge.streaming import streams as R


def plain_queue(rows, capacity, staleness):
    out = []
    state = collections.defaultdict(lambda: [collections.deque(), 0, 0, 0, 0])
    for key, at, command, item, version in rows:
        s = state[key]

        def leave(event, s=s, key=key, at=at):
            item, version = s[0].popleft() if event != "empty" else (None, None)
            s[2 if event == "taken" else 3] += event != "empty"
            out.append((key, at, event, item, version, None if version is None else s[4] - version > staleness, s[1], s[2], s[3], len(s[0]), s[4]))

        if command == "put":
            if len(s[0]) >= capacity:
                leave("dropped")
            s[0].append((item, version or 0))
            s[1] += 1
        elif command == "get":
            leave("taken" if s[0] else "empty")
        elif command == "version":
            s[4] = version or 0
        elif command == "clear":
            s[0].clear()
    return out


def commands(n):
    r = random.Random(6)
    now = collections.Counter()
    out = []
    for at in range(n):
        key = r.choice("abc")
        command = r.choice(["put"] * 8 + ["get"] * 5 + ["version", "clear", "other", None])
        now[key] += command == "version"
        out.append((key, at, command, f"i{at}" if r.random() < 0.9 else None, r.choice([now[key], max(0, now[key] - 2), None])))
    return out


DDL = "q string, at long, command string, item string, version long"


def test_a_table_of_commands(spark):
    rows = commands(400)
    shuffled = rows[::-1]
    got = [tuple(x) for x in Q.versioned_queue(spark.createDataFrame(shuffled, DDL).repartition(3), "q", 4, 1).collect()]
    assert sorted(got, key=lambda x: x[1]) == plain_queue(rows, 4, 1)
    assert any(x[5] for x in got) and Q.versioned_queue(spark.createDataFrame([], DDL), "q", 4).count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = commands(300)
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    got = []
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], DDL).coalesce(1).write.mode("append").parquet(source)
        events = Q.versioned_queue(R.bounded_source(spark, source, DDL), "q", 3, 2)
        R.to_table(events, str(tmp_path / "out"), checkpoint).awaitTermination()
        got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()]
        assert got == plain_queue(rows[: 100 * k + 100], 3, 2)

"""The driver's heap is collected between jobs once much of it is in use."""

from rowforge.llm import common


def _collections(spark):
    """Collections of the whole heap so far."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def _broadcasts(spark):
    """Bytes in use after jobs that broadcast small tables, each held by nothing afterwards."""
    small = spark.range(1000).selectExpr("id", "id % 7 AS k")
    for i in range(6):
        found = common.cut(spark.range(1000).join(small.hint("broadcast"), "id"), f"heap-{i}")
        assert found.count() == 1000
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    return heap.totalMemory() - heap.freeMemory()


def test_heap_is_collected_when_much_is_in_use(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0, raising=False)
    before = _collections(spark)
    _broadcasts(spark)
    assert _collections(spark) - before >= 6


def test_a_heap_with_room_is_left_alone(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAP_SHARE", 1.0, raising=False)
    before = _collections(spark)
    _broadcasts(spark)
    assert _collections(spark) == before

"""Steps give back what they leave on the driver's heap, and only then."""


def _collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return max(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_a_stored_step_collects_a_heap_beyond_its_share(spark, monkeypatch):
    from skyledger import session
    monkeypatch.setattr(session, "HEAP_USED", 0.0)
    before = _collections(spark)
    assert session.stored(spark.range(5), "five").count() == 5
    assert _collections(spark) > before


def test_a_heap_within_its_share_is_left_alone(spark, monkeypatch):
    from skyledger import session
    monkeypatch.setattr(session, "HEAP_USED", 1.0)
    monkeypatch.setattr(session, "HEAP_TAKEN", 1.0)
    assert not session.give_back_heap(spark)


def test_a_collection_returns_free_heap(spark):
    from skyledger import session
    assert session.keep_heap_tight(spark)
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    spark._jvm.java.lang.System.gc()
    used = runtime.totalMemory() - runtime.freeMemory()
    assert runtime.totalMemory() < max(2 * used, 256 << 20)

"""Clearing settled tables has the driver collect its garbage, and keeps what the result reads."""

from corvane.llm import shared


def test_clearing_collects_the_drivers_garbage(spark):
    def collections() -> int:
        """Whole collections so far: of the old generation, or of the only one."""
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName())

    since = shared.mark(spark)
    first = shared.settle(spark.range(10), "first")
    kept = shared.settle(first.groupBy("id").count(), "second")
    before = collections()
    assert shared.clear(spark, since, kept).count() == 10
    assert collections() > before
    assert shared.mark(spark) == since + 1

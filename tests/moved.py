"""What a query moves: rows and bytes written to shuffles, from Spark's own counts."""

from __future__ import annotations


def shuffled(spark, run) -> tuple[int, int]:
    """Rows and bytes that stages wrote for others while ``run()`` went on."""
    context = spark.sparkContext._jsc.sc()

    def total() -> tuple[int, int]:
        context.listenerBus().waitUntilEmpty(30_000)
        store, none = context.statusStore(), spark._jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        every = [stages.apply(k) for k in range(stages.size())]
        return sum(s.shuffleWriteRecords() for s in every), sum(s.shuffleWriteBytes() for s in every)

    before = total()
    run()
    after = total()
    return after[0] - before[0], after[1] - before[1]

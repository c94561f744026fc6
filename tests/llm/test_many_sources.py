"""One queue a source, at any number of sources."""

import pytest

from tests.conftest import SF
from tidewright.llm import mixture_packing
from tidewright.llm.mixture_packing import Clock, Schedule, mixture_pack
from tidewright.llm.queries import table, vocabulary_path


@pytest.mark.parametrize(("totals", "weights", "window"), [([1000, 10, 3], None, 64), ([500, 500], [3, 1], 50), ([7, 90, 40], [1, 0, 0], 8), ([5], None, 100), ([30, 9, 12, 80], [2, 5, 0, 0], 7)])
def test_clock_is_the_schedule(totals, weights, window):
    ks = weights or totals
    clock, schedule = Clock([(k, n, 1) for k, n in zip(ks, totals, strict=True)], window), Schedule(totals, weights, window)
    for w in range(schedule.windows + 1):
        assert [clock.served(n, k, w) for n, k in zip(totals, ks, strict=True)] == [schedule.served(s, w) for s in range(len(totals))]


@pytest.mark.parametrize("weighted", [False, True])
def test_many_sources_are_packed_alike(spark, monkeypatch, weighted):
    docs = table(spark, SF, "documents").selectExpr("doc_id", "left(text, 400) text", "nullif(concat('site', doc_id % 17), 'site3') source")
    weights = {"site1": 5, "site2": 1, "site4": 2} if weighted else None
    pack = lambda: sorted(tuple(r) for r in mixture_pack(docs.repartition(3, "doc_id"), vocabulary_path(), sequence=64, window_sequences=4, weights=weights).drop("queue").collect())
    want = pack()
    monkeypatch.setattr(mixture_packing, "MAX_QUEUES", 5)
    assert pack() == want

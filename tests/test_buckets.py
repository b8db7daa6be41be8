"""Streams whose keys are dealt to a few buckets, held against plain Python."""

import datetime
import random

import pytest

from tests.test_variants import files_in_turn, rocks  # noqa: F401
from varigrid import streaming


def run(stream, path, mode, seen):
    stream.writeStream.foreachBatch(lambda df, i: seen.extend((i, *x) for x in df.collect())).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("block", [True, False])
def test_children_of_few_buckets_are_sent_once(spark, tmp_path, rocks, block):  # noqa: F811
    r = random.Random(5)
    edges = [(f"p{r.randrange(80)}", f"c{i}") for i in range(200) for _ in range(r.choice([1, 2, 4]))]
    batches = [[(r.randrange(9), 1000 * b + i, f"p{r.randrange(80)}", r.choice(["completed", "completed", "failed", "running"])) for i in range(70)] for b in range(3)]
    last, want, sent = {}, {}, set()
    for b, rows in enumerate(batches):
        for ts, i, p, status in sorted(rows):
            last[p] = status
        for c in {c for p, c in edges if p in {x[2] for x in rows}} - sent:
            ps = {p for p, x in edges if x == c}
            if all(last.get(p) == "completed" or (last.get(p) == "failed" and not block) for p in ps):
                want[c] = (b, len(ps))
        sent |= set(want)
    seen = []
    stream = files_in_turn(spark, tmp_path, batches, "ts long, event_id long, parent string, status string")
    run(streaming.ready(stream, streaming.with_need(spark.createDataFrame(edges, "parent string, child string")), block, buckets=3), tmp_path, "append", seen)
    assert len(seen) == len(want) > 20 and {c: (b, n) for b, c, n in seen} == want


def test_last_statuses_of_few_buckets(spark, tmp_path, rocks):  # noqa: F811
    r = random.Random(6)
    at = lambda: datetime.datetime(2024, 1, r.randrange(1, 9), r.randrange(24))
    batches = [[(at(), 1000 * b + i, f"t{r.randrange(40)}", f"r{r.randrange(3)}", r.choice(list(streaming.STATES) + ["other"])) for i in range(90)] for b in range(3)]
    best, want = {}, set()
    for b, rows in enumerate(batches):
        before = dict(best)
        for ts, i, task, real, event in rows:
            if event in streaming.STATES and (ts, i) > best.get((task, real), (datetime.datetime.min, 0))[:2]:
                best[task, real] = (ts, i, streaming.STATES[event])
        want |= {(b, *k, i, s) for k, (ts, i, s) in best.items() if before.get(k) != best[k]}
    seen = []
    stream = files_in_turn(spark, tmp_path, batches, "ts timestamp, event_id long, task string, realization string, event string")
    run(streaming.live_status_changes(stream, "9 days", 10 * 86400, buckets=3), tmp_path, "update", seen)
    assert len(seen) == len(want) and {(b, task, real, i, s) for b, task, real, at, i, s in seen} == want

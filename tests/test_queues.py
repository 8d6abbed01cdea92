"""Collectors' queues against a plain loop."""

import random

import pytest

from loomtrace.sources.shared import new_path
from loomtrace.streaming import flows, queues, stateful


def plain(signals, outages, pace):
    """Flushes, one signal after another."""
    out = []
    for source in {s for s, *_ in signals}:
        mine, spans = sorted((t, i) for s, t, i in signals if s == source), sorted(outages.get(source, []))
        groups, last = [], None
        for t, i in mine:
            end = next((e for b, e in spans if b <= t < e), None)
            slot, era = t // pace.every_ms, sum(b <= t for b, _ in spans)
            if end is None and last and last[1] is None and t - last[0] <= pace.debounce_ms and (slot, era) == last[2:]:
                groups[-1][1].append((t, i))
            else:
                groups.append((end, [(t, i)]))
            last = (t, end, slot, era)
        flushes = {}
        for end, rows in groups:
            t = rows[-1][0]
            due = min(t + pace.debounce_ms, (t // pace.every_ms + 1) * pace.every_ms)
            flushes.setdefault(end if end is not None else next((e for b, e in spans if t < b <= due), due), []).extend(rows)
        for due, rows in flushes.items():
            rows.sort()
            out += [(source, i, None, None, None) for _, i in rows[: -pace.bound]]
            out += [(source, i, due, k // pace.size + 1, k % pace.size + 1) for k, (_, i) in enumerate(rows[-pace.bound :])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("source", "id", "flush_ms", "batch", "place").collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_like_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    pace = queues.Pace(debounce_ms=9, every_ms=50, size=3, bound=7)
    signals = [(rng.choice("aab"), rng.choice([rng.randrange(400), rng.randrange(100, 130)]), i) for i in range(160)] + [("a", 120, 7), ("a", 120, 7)]
    outages = {"a": [(100, 160), (171, 174), (300, 301)], "b": [(5, 390)], "c": [(1, 2)]}
    table = spark.createDataFrame(signals + [(None, 5, 900), ("a", None, 901)], "source string, ts_ms long, id long")
    spans = spark.createDataFrame([(s, *x) for s, xs in outages.items() for x in xs], "source string, from_ms long, until_ms long")
    wanted = plain(signals, outages, pace)
    assert sum(w[2] is None for w in wanted) > 20
    assert rows(queues.batches(table.selectExpr("*", "1 as slot", "2 as era", "3 as flush_ms"), spans, pace)) == wanted
    assert rows(queues.batches(table.limit(0), spans, pace)) == []
    assert rows(queues.batches(table, spans.limit(0), pace)) == plain(signals, {}, pace)


def test_queues_of_a_stream(spark):
    rng = random.Random(5)
    pace = queues.Pace(debounce_ms=9000, every_ms=50_000, size=3, bound=7)
    signals = [(rng.choice("aab"), 1000 * rng.choice([rng.randrange(400), rng.randrange(100, 130)]), i) for i in range(120)]
    outages = {"a": [(100_000, 160_000), (171_000, 174_000)], "b": [(5_000, 390_000)]}
    folder = new_path(spark, "signals")
    frame = spark.createDataFrame([*signals, ("tick", 10**9, -1)], "source string, ts_ms long, id long").selectExpr("source", "timestamp_millis(ts_ms) as ts", "id")
    frame.where("id >= 0").repartition(5, "id").write.parquet(folder)
    frame.where("id < 0").coalesce(1).write.mode("append").parquet(folder)
    got = stateful.drained(queues.queued(flows.signals(spark, folder, frame.schema, 2), outages, "1 hour", pace), "queues")
    assert rows(got.where("source <> 'tick'")) == plain(signals, outages, pace)

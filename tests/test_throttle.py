"""A tab's throttle against a plain loop."""

import random

import pytest

from loomtrace.sources import collector


def plain(signals, least):
    """Signals sent by each tab, one after another."""
    out, last = [], {}
    for tab, ts, i, kind, label in sorted(signals, key=lambda s: (s[1], s[2])):
        key = (kind, label)
        if tab in last and last[tab][0] == key and ts - last[tab][1] < least:
            continue
        last[tab] = (key, ts)
        out.append(i)
    return sorted(out)


@pytest.mark.parametrize("least", [0, 1, 7, 1000])
def test_like_a_plain_loop(spark, least):
    rng = random.Random(least)
    signals, ts = [], 0
    for i in range(300):
        ts += rng.choice([0, 1, 3, 6, 7, 20])
        signals.append((rng.choice(["a", "a", "a", None]), ts, i, rng.choice(["click", "click", "click", "copy"]), rng.choice([None, None, "x"])))
    schema = "tab string, ts_ms long, id long, interaction string, label string"
    table = spark.createDataFrame([*signals, ("a", None, 999, "click", None)], schema).selectExpr("*", "1 as run", "2 as sent")
    got = collector.throttled(table, ["tab"], ["interaction", "label"], ["ts_ms", "id"], least)
    assert got.columns == table.columns
    assert sorted(r["id"] for r in got.collect()) == plain(signals, least)
    assert collector.throttled(table.limit(0), ["tab"], ["interaction"], ["ts_ms", "id"]).count() == 0

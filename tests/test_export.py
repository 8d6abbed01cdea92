"""The recorded export as a stream: marks, restarts, pages that repeat, lines that are no events."""

import json

from loomtrace.sources import export
from loomtrace.sources.shared import new_path


def page(root, app, high, lines, name="part-0.json"):
    folder = root / f"app={app}" / f"high_ms={high}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps({"id": x, "ts_ms": x, "user_id": "u", "action": "read"}) for x in lines))


def ids(df):
    return sorted((r["app"], r["id"]) for r in df.collect() if r["reject_reason"] is None)


def test_restarts_go_on_at_the_marks(spark, tmp_path):
    table, state = new_path(spark, "table"), new_path(spark, "state")

    def sync():
        return export.synced(export.exported(spark, f"file://{tmp_path}"), table, state)

    assert sync().count() == 0  # an empty folder
    page(tmp_path, "a", 20, [10, 20])
    page(tmp_path, "a", 30, [10, 20, 25, 30])  # repeats the page before it
    page(tmp_path, "a", 30, [22], "part-1.json")
    page(tmp_path, "a", 40, [])
    (tmp_path / "app=a" / "high_ms=40" / "_SUCCESS").write_text("x")
    (tmp_path / "other").mkdir()
    first = [("a", 10), ("a", 20), ("a", 22), ("a", 25), ("a", 30)]
    assert ids(sync()) == first
    assert ids(sync()) == first  # nothing new
    page(tmp_path, "a", 35, [34])  # under the mark: too late
    page(tmp_path, "a", 60, [5, 40, 41, 60])
    page(tmp_path, "b", -5, [-7, -5])  # an application seen for the first time
    assert ids(sync()) == sorted([*first, ("a", 41), ("a", 60), ("b", -7), ("b", -5)])


def test_lines_that_are_no_events(spark, tmp_path):
    good = json.dumps({"id": 1, "ts_ms": 3, "extra": {"app": "x"}})
    page(tmp_path, "a", 9, [good, "", "{", "[1]", "7", json.dumps({"id": None, "ts_ms": 3}), json.dumps({"id": 2}), json.dumps({"id": "4", "ts_ms": "5"}), good])
    got = export.synced(export.exported(spark, f"file://{tmp_path}"), new_path(spark, "table"), new_path(spark, "state")).collect()
    assert sorted(r["id"] for r in got if r["reject_reason"] is None) == [1, 1, 4]
    assert sum(r["reject_reason"] == "not an event" and r["app"] == "a" for r in got) == 5


def test_lines_longer_than_a_block(spark, tmp_path):
    long = json.dumps({"id": 8, "ts_ms": 8, "action": "x" * (3 << 20)})
    page(tmp_path, "a", 9, [long, 9])
    got = export.synced(export.exported(spark, f"file://{tmp_path}"), new_path(spark, "table"), new_path(spark, "state"))
    assert sorted((r["id"], len(r["action"])) for r in got.collect()) == [(8, 3 << 20), (9, 4)]

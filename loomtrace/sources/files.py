"""Activity logs from files: CSV and JSON lines of any heading into canonical events, with rejected rows.

Every row becomes a map from canonical heading to text, and one projection turns the map into an event
or a reason for rejection. Lines are numbered without moving rows: the rows of every file split are
counted, and the counts before a split are joined to it.

Defined results: blank rows are no rows; of headings with the same canonical name the last counts; a row
without a person or with an unreadable time is rejected, never fatal; empty cells are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.functions import normalise as N
from loomtrace.operators.ranks import once

CELLS = "map<string,string>"


def _present(text: Column) -> Column:
    return F.when(text != "", text)


def numbered(lines: DataFrame, first: int) -> DataFrame:
    """``lines`` with ``line``: the place of each row in its file, from ``first`` on."""
    placed = lines.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    counts = placed.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "split", "low", before.alias("before"))
    return placed.join(starts, ["file", "split"]).withColumn("line", F.col("at") - F.col("low") + F.col("before") + first).drop("split", "at", "low", "before")


def _last_of_each(entries: Column) -> Column:
    """A map of (key, value) entries in which later ones win."""
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def csv_rows(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """(file, line, cells, default_user, problem) of CSV files that share a heading.

    Files are read in parts, unless a cell holds a line break: then a file is one task. If it isn't said
    whether one does, a pass over the lines looks for a line whose quotes don't pair up, as the first of
    such a record has.
    """
    if multi_line is None:
        multi_line = not spark.read.text(path).where(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).isEmpty()
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    names = [c for c in raw.columns if c]
    keyed = {}
    for name in names:
        keyed[N.plain_key(name)] = name
    cells = F.create_map(*(x for key, name in keyed.items() for x in (F.lit(key), F.col(f"`{name}`")))) if keyed else F.create_map().cast(CELLS)
    person = bool(set(keyed) & set(C.COLUMN_ALIASES["user_id"]))
    rows = numbered(raw, 2).select("file", "line", F.map_filter(cells, lambda _, v: F.trim(v) != "").alias("cells"))
    return rows.where(F.size("cells") > 0).withColumns({"default_user": F.lit(None if person else C.LOCAL_USER).cast("string"), "problem": F.lit(None).cast("string")})


def jsonl_rows(spark: SparkSession, path: str) -> DataFrame:
    """The same of JSON lines; whether a line names a person is decided by the line."""
    lines = numbered(spark.read.text(path), 1).where(F.trim("value") != "")
    # each step is a row of its own, so that a line is parsed once and not for every field that is read of it
    parsed = lines.select("file", "line", once(F.when(F.trim("value").startswith("{"), F.from_json("value", CELLS))).alias("parsed"))
    entries = F.transform(F.map_entries("parsed"), lambda e: F.struct(N.canonical_key(e["key"]).alias("key"), e["value"].alias("value")))
    rows = parsed.select("file", "line", once(entries).alias("entries")).select("file", "line", once(_last_of_each(F.col("entries"))).alias("cells"))
    named = F.arrays_overlap(F.map_keys("cells"), F.array(*map(F.lit, C.COLUMN_ALIASES["user_id"])))
    return rows.select(
        "file",
        "line",
        once(F.map_filter("cells", lambda _, v: v.isNotNull() & (v != ""))).alias("cells"),
        F.when(~named, F.lit(C.LOCAL_USER)).alias("default_user"),
        F.when(F.col("cells").isNull(), F.lit("line is not a JSON object")).alias("problem"),
    )


def log_rows(spark: SparkSession, path: str, sample: str = "", multi_line: bool | None = None) -> DataFrame:
    """Rows of a log by its name: JSON lines, CSV, else by the first character of ``sample``."""
    name = path.lower()
    if name.endswith((".jsonl", ".ndjson", ".json")) or (not name.endswith(".csv") and sample.lstrip().startswith("{")):
        return jsonl_rows(spark, path)
    return csv_rows(spark, path, multi_line)


def field(cells: Column, canonical: str) -> Column:
    """The first non-empty cell among a canonical field's headings, in their order."""
    return F.coalesce(*(_present(F.try_element_at(cells, F.lit(alias))) for alias in C.COLUMN_ALIASES[canonical]))


def payload(cells: Column) -> Column:
    """An object as it is, other JSON under ``value``, other text under ``raw``; without one the cells nobody claims."""
    raw = F.try_element_at(cells, F.lit("payload"))
    given = F.when(F.trim(raw) != "", raw)
    loaded = F.try_parse_json(given)
    claimed = [*(a for names in C.COLUMN_ALIASES.values() for a in names), "id", "notes"]
    rest = F.map_filter(cells, lambda k, v: ~k.isin(*claimed) & (v != ""))
    other = F.when(loaded.isNull(), F.create_map(F.lit("raw"), given)).otherwise(F.create_map(F.lit("value"), F.try_variant_get(loaded, "$", "string")))
    return F.when(given.isNull(), rest).otherwise(F.coalesce(F.when(F.trim(given).startswith("{"), F.from_json(given, CELLS)), other))


def duration(cells: Column) -> Column:
    """Milliseconds of the first duration cell; a bare number counts in the unit its heading names, else in seconds."""
    steps = [F.when(_present(F.try_element_at(cells, F.lit(alias))).isNotNull(), N.duration_ms(F.try_element_at(cells, F.lit(alias)), C.BARE_UNITS.get(alias, 1000))) for alias in C.COLUMN_ALIASES["duration"]]
    return F.coalesce(*steps, F.lit(0).cast("long"))


def normalise(rows: DataFrame, source: str = "upload") -> DataFrame:
    """Canonical events of (file, line, cells, default_user, problem), with ``reject_reason`` for those that are none."""
    cells = F.col("cells")
    drawn = rows.select(
        "file", "line", "problem", "cells",
        F.trim(F.coalesce(field(cells, "user_id"), F.col("default_user"), F.lit(""))).alias("user_id"),
        F.trim(F.coalesce(field(cells, "team"), F.lit("unknown"))).alias("team"),
        field(cells, "timestamp").alias("written"),
        field(cells, "app").alias("raw_app"), field(cells, "action").alias("raw_action"),
        N.canonical_key(F.coalesce(field(cells, "object_type"), F.lit(""))).alias("named_object"),
        field(cells, "object_id").alias("object_id"), field(cells, "session_id").alias("session_id"), field(cells, "workflow").alias("workflow"),
    )
    split = drawn.withColumns({"ts": N.parse_timestamp(F.col("written")), "split": F.when(F.col("named_object") == "", N.split_action(F.col("raw_action")))})
    derived = F.when(F.col("named_object") != "", F.col("named_object")).otherwise(F.when(F.col("split.object") != "", F.col("split.object")).otherwise("unknown"))
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("user_id") == "", F.lit("missing user_id: no column named user_id, employee, person or role"))
        .when(F.col("ts").isNull(), F.concat(F.lit("unreadable timestamp: '"), F.coalesce("written", F.lit("")), F.lit("'")))
    )
    return split.select(
        "file", "line", "user_id", "team", "ts",
        N.canonical_app(F.col("raw_app")).alias("app"),
        N.canonical_action(F.coalesce(F.col("split.verb"), F.col("raw_action"))).alias("action"),
        derived.alias("object_type"), "object_id", duration(cells).alias("duration_ms"), payload(cells).alias("payload"),
        "session_id", "workflow", F.lit(source).alias("source"), _present(F.try_element_at(cells, F.lit("notes"))).alias("notes"), reason.alias("reject_reason"),
    )


def read_log(spark: SparkSession, path: str, source: str = "upload", sample: str = "", multi_line: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a log file or folder; rejects are (file, line, message)."""
    found = normalise(log_rows(spark, path, sample, multi_line), source)
    message = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("reject_reason"))
    return found.where("reject_reason is null").drop("reject_reason", "line", "file"), found.where("reject_reason is not null").select("file", "line", message.alias("message"))


def upload_summary(events: DataFrame, rejects: DataFrame, shown: int = 20) -> DataFrame:
    """Accepted and rejected rows, sessions and applications of an upload, with its first messages."""
    sums = events.agg(F.count(F.lit(1)).alias("accepted"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("app").alias("apps"))
    first = rejects.orderBy("file", "line").limit(shown).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "message"))), lambda r: r["message"]), "\n").alias("messages"))
    return sums.crossJoin(F.broadcast(rejects.agg(F.count(F.lit(1)).alias("rejected")))).crossJoin(F.broadcast(first))


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to the log, one folder a day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def export_csv(events: DataFrame, path: str) -> None:
    """The log as CSV with a heading; the payload is JSON text."""
    events.withColumn("payload", F.to_json("payload")).write.mode("overwrite").option("header", True).csv(path)


def export_jsonl(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)


def without_source(events: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """The log without the events of sources whose consent was withdrawn (source_id)."""
    return events.join(withdrawn.select("source_id").distinct(), "source_id", "left_anti")


def renamed_field(events: DataFrame, old: str, new: str) -> DataFrame:
    """Payload field ``old`` under the name ``new``, which it replaces where an event has both."""
    has = F.map_contains_key("payload", F.lit(old))
    kept = F.map_filter("payload", lambda k, _: ~k.isin(old, new))
    return events.withColumn("payload", F.when(has, F.map_concat(kept, F.create_map(F.lit(new), F.element_at("payload", old)))).otherwise(F.col("payload")))


def desktop_object(app_name: Column, title: Column) -> Column:
    """What was worked on: a window title as a slug, a browser tab by its site, ``window`` without a title."""
    site = F.trim(F.substring_index(title, " - ", -1))
    tab = app_name.isin(*C.BROWSER_NAMES) & F.contains(title, F.lit(" - "))
    shown = F.substring(N.slug(F.when(tab, site).otherwise(title)), 1, 40)
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("window")).otherwise(shown)


def desktop_events(samples: DataFrame, idle_gap_ms: int = C.DESKTOP_IDLE_MS) -> DataFrame:
    """One event for each stay in a desktop application, from samples (user_id, ts_ms, app_name, title) of the one in front.

    A stay lasts until another application comes to the front; stays under a second and the last, open one
    are dropped. A session ends where the end of the last stay is more than the gap ago.
    """
    order = Window.partitionBy("user_id").orderBy("ts_ms", "app_name")
    fresh = samples.withColumn("new", F.coalesce(F.lag("app_name").over(order) != F.col("app_name"), F.lit(True))).where("new")
    stays = fresh.withColumn("ends_ms", F.lead("ts_ms").over(order)).where(F.col("ends_ms") - F.col("ts_ms") >= 1000)
    cut = F.coalesce(F.col("ends_ms") - F.lag("ends_ms").over(order) > idle_gap_ms, F.lit(False))
    numbered_ = stays.withColumn("session", F.sum(cut.cast("int")).over(order))
    app = F.coalesce(N.lookup(C.DESKTOP_APPS, F.col("app_name")), N.slug(F.col("app_name")))
    return numbered_.select(
        "user_id", "ts_ms", app.alias("app"), F.lit("navigate").alias("action"), desktop_object(F.col("app_name"), F.col("title")).alias("object_type"),
        (F.col("ends_ms") - F.col("ts_ms")).alias("duration_ms"), F.concat_ws("#", "user_id", F.col("session").cast("string")).alias("session_id"),
    )


def commits(lines: DataFrame) -> DataFrame:
    """(sha, author, subject) of lines ``sha<TAB>author<TAB>subject``; other lines are dropped."""
    parts = F.split("value", "\t", 4)
    return lines.select(parts.alias("p")).where(F.size("p") >= 3).select(F.col("p")[0].alias("sha"), F.col("p")[1].alias("author"), F.col("p")[2].alias("subject"))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes) of the files of a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))

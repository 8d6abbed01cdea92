"""Recorded pages of an account's export as a streaming source whose offsets are high-water marks.

An export is a folder ``app=<app>/high_ms=<latest time of the page>/*.json`` of JSON lines, one object an event
(id, user_id, ts_ms, action). A page holds what its application had up to its time; pages of a later export may
repeat what earlier ones held. A sync takes the events later than its application's mark, and each page those later
than the page before it, so that an event is taken once however pages are cut into batches. The marks are the
offsets that the checkpoint keeps: a restart goes on where the last sync ended.

Only names of applications and pages above the mark are listed on the driver; tasks read the pages, one file each.

Defined results: a page at or under its mark is skipped; lines that are no event become rows with
``reject_reason``; empty pages, files that begin with ``_`` or ``.`` and other folders give no rows; an empty
folder is a stream without rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "recorded_export"
SCHEMA = pa.schema([("app", pa.string()), ("id", pa.int64()), ("user_id", pa.string()), ("ts_ms", pa.int64()), ("action", pa.string()), ("reject_reason", pa.string())])
DDL = "app string, id long, user_id string, ts_ms long, action string, reject_reason string"
#: Lines of a page that a task hands over at once.
LINES = 4096
#: The mark of an application of which nothing was taken yet.
NOTHING = -(1 << 63)


class Page(InputPartition):
    """A file of a page, and the mark that its events have to pass."""

    def __init__(self, app: str, file: str, above: int):
        self.app, self.file, self.above = app, file, above


class Pages(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def folders(self, below: str, key: str) -> dict[str, str]:
        """Values of ``key`` among the folders named key=value below a folder, with their paths."""
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(f"{root}{below}", allow_not_found=True))
        return {f.base_name[len(key) + 1 :]: f"{below}/{f.base_name}" for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(f"{key}=")}

    def marks(self, app_folder: str) -> list[tuple[int, str]]:
        return sorted((int(mark), folder) for mark, folder in self.folders(app_folder, "high_ms").items())

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        pages = {app: self.marks(folder) for app, folder in sorted(self.folders("", "app").items())}
        return {app: marks[-1][0] for app, marks in pages.items() if marks}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        system, root = fs.FileSystem.from_uri(self.path)
        out = []
        for app, folder in self.folders("", "app").items():
            above = start.get(app, NOTHING)
            for mark, page in self.marks(folder):
                if above < mark <= end.get(app, NOTHING):
                    files = system.get_file_info(fs.FileSelector(f"{root}{page}"))
                    out += [Page(app, f.path, above) for f in files if f.type == fs.FileType.File and f.base_name[0] not in "_."]
                    above = mark
        return out

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows: list[dict] = []
        with system.open_input_stream(partition.file) as source:
            for line in _lines(source):
                row = _event(partition.app, line)
                if row["reject_reason"] or row["ts_ms"] > partition.above:
                    rows.append(row)
                if len(rows) == LINES:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, SCHEMA)


def _lines(source) -> Iterator[bytes]:
    """Lines of a stream that are not blank, read a block at a time."""
    rest = b""
    while block := source.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (line for line in whole if line.strip())
    if rest.strip():
        yield rest


def _event(app: str, line: bytes) -> dict:
    """A line as a row of ``SCHEMA``; one that is no event is told so."""
    try:
        event = json.loads(line)
        return {"app": app, "id": int(event["id"]), "user_id": event.get("user_id"), "ts_ms": int(event["ts_ms"]), "action": event.get("action"), "reject_reason": None}
    except (ValueError, TypeError, KeyError, AttributeError):
        return {"app": app, "reject_reason": "not an event"}


class Export(DataSource):
    """``spark.readStream.format("recorded_export").load(folder)`` once registered."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return DDL

    def streamReader(self, schema) -> Pages:
        return Pages(self.options["path"])


def written_pages(log: DataFrame, folder: str, span_ms: int = 86_400_000) -> None:
    """Adds the export of a log (app, id, user_id, ts_ms, action) to a folder, a page for each application and span of time."""
    span = F.floor(F.col("ts_ms") / span_ms).alias("span")
    highs = log.groupBy("app", span).agg(F.max("ts_ms").alias("high_ms"))
    pages = log.withColumn("span", span).join(highs, ["app", "span"]).select("app", "high_ms", "id", "user_id", "ts_ms", "action")
    pages.repartition("app", "high_ms").write.mode("append").partitionBy("app", "high_ms").json(folder)


def exported(spark: SparkSession, folder: str) -> DataFrame:
    """The export in a folder as a stream."""
    spark.dataSource.register(Export)
    return spark.readStream.format(NAME).load(folder)


def synced(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """One sync: appends what is above the checkpoint's marks to a table, and returns all that the table holds."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

"""Filing documents by year and month, under names that no other document has.

The first document of a name in a folder keeps it, unless the folder has it already; further ones get the
least numbers from 2 on that neither the folder nor another document of the same run has by name. Places
are ranks of a range sort, so one name may have any number of documents. Nothing is moved but on demand.

Defined results: a date in none of the known formats counts as none, and files under the day of the run; a
folder that leads out of the root is refused; names without a suffix are numbered at their end; documents
of one source twice are filed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.operators.ranks import placed

#: What a name is made of: stem, and suffix with its dot.
_SUFFIX = r"(?<=[^/])(\.[^./]*[^./])$"


def period(raw: Column, today: Column) -> Column:
    """The date a document is filed by."""
    text = F.substring(F.trim(raw), 1, 10)
    return F.coalesce(*(F.when(F.length(text) == len(f), F.try_to_timestamp(text, F.lit(f))) for f in C.PERIOD_FORMATS), today.cast("timestamp"))


def planned(documents: DataFrame, existing: DataFrame, today: str) -> DataFrame:
    """Where (source, filename, dated, vendor, folder) go, given what folders (directory, filename) hold.

    Columns: source, directory, filed_name, year, month, vendor, dated_by_run, refused.
    """
    when = period(F.col("dated"), F.lit(today))
    inside = F.trim(F.coalesce("folder", F.lit("")))
    refused = F.exists(F.split(inside, "/"), lambda x: x == "..") | inside.startswith("/")
    year, month = F.date_format(when, "yyyy"), F.date_format(when, "MM")
    drawn = documents.select(
        "source", "filename", year.alias("year"), month.alias("month"), F.coalesce(F.nullif(F.trim("vendor"), F.lit("")), F.lit(C.UNFILED)).alias("vendor"),
        F.concat_ws("/", F.nullif(inside, F.lit("")), year, month).alias("directory"), period(F.col("dated"), F.lit(None)).isNull().alias("dated_by_run"), refused.alias("refused"),
        F.regexp_extract("filename", _SUFFIX, 1).alias("suffix"),
    ).withColumn("stem", F.expr("substring(filename, 1, length(filename) - length(suffix))"))
    name = ["directory", "filename"]
    ranked = placed(drawn.where(~F.col("refused")), "place", "directory", "filename", "source", F.xxhash64("vendor", "dated_by_run"))
    groups = ranked.groupBy(*name).agg(F.min("place").alias("first"), F.first("stem").alias("stem"), F.first("suffix").alias("suffix"))
    held = existing.select(*name).distinct().withColumn("held", F.lit(True))
    # names that are taken: held by a folder, or brought by a document of this run
    taken = groups.select(*name).unionByName(existing.select(*name)).distinct()
    number = F.regexp_extract("filename", r"-([1-9][0-9]{0,8})(\.[^./]*[^./])?$", 1)
    numbered = taken.where(number != "").select("directory", F.regexp_replace("filename", r"-[1-9][0-9]{0,8}((\.[^./]*[^./])?)$", "$1").alias("filename"), number.cast("long").alias("k")).where("k >= 2")
    numbers = numbered.groupBy(*name).agg(F.array_sort(F.collect_set("k")).alias("numbers"))
    known = groups.join(held, name, "left").join(numbers, name, "left")
    # with t the taken numbers in order, t[j] - 2 - j numbers are free before t[j]
    free = F.transform(F.coalesce("numbers", F.array().cast("array<long>")), lambda t, j: t - 2 - j)
    known = known.select(*name, "first", F.coalesce("held", F.lit(False)).alias("held"), free.alias("free"))
    nth = F.col("place") - F.col("first") - F.when(F.col("held"), 0).otherwise(1)
    k = nth + 2 + F.size(F.filter("free", lambda g: g <= nth))
    filed = F.when(nth < 0, F.col("filename")).otherwise(F.concat("stem", F.lit("-"), k.cast("string"), "suffix"))
    columns = ["source", "directory", "filed_name", "year", "month", "vendor", "dated_by_run", "refused"]
    placed_ = ranked.join(known, name).withColumn("filed_name", filed)
    return placed_.select(*columns).unionByName(drawn.where("refused").withColumn("filed_name", F.lit(None).cast("string")).select(*columns))


def file(documents: DataFrame, existing: DataFrame, root: str, today: str, dry_run: bool = True) -> DataFrame:
    """The plan; without ``dry_run`` also adds (source, content) of the documents to the archive below ``root``, by year and month."""
    plan = planned(documents, existing, today)
    if not dry_run:
        filed = plan.where("not refused").join(documents.select("source", "content"), "source")
        filed.select("source", "directory", "filed_name", "vendor", "content", "year", "month").write.mode("append").partitionBy("year", "month").parquet(root)
    return plan

"""The corpus pipeline stage by stage, WARC salvage and chat collapse."""

import gzip
import re
from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import chat, warc
from tests.llm.samples import SCHEMA, awkward, empty, passages
from tests.llm.test_jaccard import brute, lower
from tests.llm.test_text_operators import strip_brute, windows_expected
from tests.tables import SF_DIR


def test_stages_do_what_their_plain_versions_do(spark):
    docs = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    stages = dict(corpus_pipeline.STAGES)
    lettered = stages["language_id"](spark, docs, SF_DIR)
    assert {r["doc_id"] for r in lettered.collect()} == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    single = stages["near_duplicates"](spark, lettered, SF_DIR)
    assert {r["doc_id"] for r in single.collect()} == {r[2] for r in brute(lettered.collect())}
    stripped = stages["repeated_strings"](spark, single, SF_DIR)
    rows = single.collect()
    whole = {r["doc_id"]: n - gone for r, (n, gone, _, _) in zip(rows, strip_brute([r["text"] for r in rows]), strict=True)}
    assert {r["doc_id"] for r in stripped.collect()} == {d for d, left in whole.items() if left}
    free = stages["benchmark_free"](spark, stripped, SF_DIR)
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    assert {r["doc_id"] for r in free.collect()} == {r[0] for r in windows_expected(stripped.collect(), items) if not r[4]}
    for stage in (lettered, single, stripped, free):
        assert stage.columns == corpus_pipeline.COLUMNS
    packed = stages["packing"](spark, free, SF_DIR)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in free.collect()}


def five_words(rows):
    """Kept doc_ids (nulls too) by comparing all pairs of five-word shingle sets at 80 percent."""
    sets = []
    for r in rows:
        words = re.findall("[^\x20\x09-\x0d]+", lower(r["text"]))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    groups = {}
    for r, x in zip(rows, label, strict=True):
        groups.setdefault(x, []).append((r["doc_id"] is None, r["doc_id"] or 0))
    return sorted(None if min(g)[0] else min(g)[1] for g in groups.values() if not min(g)[0]), sum(min(g)[0] for g in groups.values())


def test_near_duplicates_by_five_words_and_with_null_ids(spark):
    rng, say = passages(31)
    base = say(100).split()
    texts = [" ".join(base), " ".join(base) + " " + say(22), say(60), say(60)]
    other = say(100).split()
    texts.append(" ".join(other))
    for at in (20, 60):
        other[at] = "edited"
    texts.append(" ".join(other))
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    rows += [(None, texts[2], "en", "a", 0), (None, say(50), "en", "a", 0), (None, texts[3] + " end", "en", "a", 0), (None, None, "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, SF_DIR).collect()
    ids, nulls = five_words(df.collect())
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == ids == [0, 2, 3, 4]
    assert sum(r["doc_id"] is None for r in got) == nulls == 2


def test_null_ids_stay_in_the_stages_behind(spark):
    _, say = passages(32)
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("length(text) > 80").first()["text"]
    df = spark.createDataFrame([(None, say(50), "en", "a", 0), (None, say(50), "en", "a", 0), (None, item, "en", "a", 0), (None, "12 !!", "en", "a", 0)], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert stages["repeated_strings"](spark, df, SF_DIR).count() == 4
    assert stages["benchmark_free"](spark, df, SF_DIR).count() == 3
    assert stages["language_id"](spark, df, SF_DIR).count() == 3


def test_repeated_strings_stage_returns_what_is_left(spark):
    _, say = passages(33)
    shared = say(60)
    texts = [say(20) + "\n" + shared + "\n" + say(15), say(5) + " " + shared, say(40), "é" * 20 + shared + "ü", shared, None, ""]
    rows = [(i, t, "en", "a", 99) for i, t in enumerate(texts)] + [(2, texts[2], "en", "a", 99), (None, say(30), None, None, None)]
    got = dict(corpus_pipeline.STAGES)["repeated_strings"](spark, spark.createDataFrame(rows, SCHEMA), SF_DIR).collect()
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    expected = []
    for r, d in zip(rows, data, strict=True):
        gone = {j for i in range(len(d) - 199) if seen[d[i : i + 200]] > 1 for j in range(i, i + 200)}
        left = bytes(b for j, b in enumerate(d) if j not in gone).decode("utf-8", "ignore")
        if left or not d:
            expected.append((r[0], left, r[2], r[3], len(left)))
    assert sorted(map(repr, (tuple(g) for g in got))) == sorted(map(repr, expected))


def test_language_stage_without_any_label_keeps_lettered_documents(spark):
    docs = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF_DIR)
    assert sorted(map(repr, (r["text"] for r in kept.collect()))) == sorted(repr(r["text"]) for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))


def test_empty_table_passes_all_stages(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR) if docs.columns == corpus_pipeline.COLUMNS else docs
    assert docs.count() == 0


def pages(spark):
    body = "<p>" + "long page " * 30
    rows = [(1, "http://a/", body), (2, "http://b/", body), (3, None, None), (4, "http://c/ d", "short"), (5, "http://e/", "short"), (None, "http://f/", body), (7, "http://g/", "é" * 60), (7, "http://g/", "é" * 60)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))


@pytest.mark.parametrize("compress", [True, False])
def test_archives_round_trip(spark, compress):
    read = warc.read_archives(warc.write_archives(pages(spark), compress)).collect()
    assert {r["kind"] for r in read} == {"record"}
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in read), key=repr)
    size = 3 + 300
    assert got == sorted([(1, "response", None, size), (2, "revisit", 1, size), (3, "response", None, 0), (4, "response", None, 5), (5, "response", None, 5), (None, "revisit", 1, size), (7, "response", None, 120), (7, "response", None, 120)], key=repr)


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_later_records_and_logs_the_gap(spark, compress):
    content = b"".join(bytes(r["content"]) for r in warc.write_archives(pages(spark).coalesce(1), compress).collect())
    whole = list(warc.salvage(content))
    _, begin, end, _ = whole[2]
    middle = (begin + end) // 2
    broken = content[:middle] + bytes(b ^ 0x55 for b in content[middle : middle + 4]) + content[middle + 4 :]
    found = list(warc.salvage(broken))
    assert [w[:3] for w in found if w[0] == "gap"] == [("gap", begin, end)]
    assert [w for w in found if w[0] == "record"] == whole[:2] + whole[3:]
    # what a cut member inflates to before the cut is kept
    assert [w[0] for w in warc.salvage(content[: end - 3])] == ["record", "record", *["record"] * compress, "gap"]
    assert list(warc.salvage(b"")) == []


def test_salvage_inside_a_member_of_many_records(spark):
    plain = b"".join(bytes(r["content"]) for r in warc.write_archives(pages(spark).coalesce(1), False).collect())
    whole = [w[3] for w in warc.salvage(plain)]
    begin, end = next(w[1:3] for w in list(warc.salvage(plain))[2:])
    middle = (begin + end) // 2
    broken = plain[:middle] + bytes(b ^ 0x55 for b in plain[middle : middle + 4]) + plain[middle + 4 :]
    packed = gzip.compress(broken)
    found = list(warc.salvage(packed))
    assert [f[3] for f in found if f[0] == "record"] == whole[:2] + whole[3:]
    assert [(f[1], f[2]) for f in found if f[0] == "gap"] == [(0, len(packed))]
    assert f"bytes {begin} to {end}" in next(f[3] for f in found if f[0] == "gap")
    for cut in (1, 3, 9):
        found = list(warc.salvage(gzip.compress(plain)[:-cut] + gzip.compress(plain)))
        assert [f[3] for f in found if f[0] == "record"][-len(whole) :] == whole
        assert len([f for f in found if f[0] == "record"]) >= 2 * len(whole) - 1
        assert [f[0] for f in found].count("gap") == 1
    spoilt = bytearray(gzip.compress(plain))
    spoilt[-6] ^= 1  # the check sum
    assert [f[3] for f in warc.salvage(bytes(spoilt)) if f[0] == "record"] == whole


def test_collapse_keeps_maximal_conversations(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", "a"), (4, 1, "bot", "c"), (5, 0, None, None), (None, 0, "user", "z"), (6, None, "user", "a"), (6, None, "user", "a")]
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {2: (2, 2), 4: (2, 1), 5: (1, 1), 6: (2, 1)}


def test_collapse_of_nothing(spark):
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_workers_take_batches_from_the_c_library():
    """Arrow's own pool would keep a stage's blocks while the next stage runs."""
    import os
    import subprocess
    import sys

    told = subprocess.run([sys.executable, "-c", "import pyarrow; print(pyarrow.default_memory_pool().backend_name)"], env={**os.environ, **corpus_pipeline.MALLOC}, capture_output=True, text=True, check=True)
    assert told.stdout.strip() == "system"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage_run_alone_has_lean_workers(name):
    """Stages also run one by one, without ``run``; the settings are there before anything starts a worker."""
    from types import SimpleNamespace

    session = SimpleNamespace(sparkContext=SimpleNamespace(environment={}))
    with pytest.raises(AttributeError):  # there are no documents
        dict(corpus_pipeline.STAGES)[name](session, None, "")
    assert session.sparkContext.environment == corpus_pipeline.MALLOC


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_small_batches(spark, name):
    """Ten thousand long texts in one batch are held several times over by executor and worker."""
    rows = spark.range(4000).select(F.repeat(F.col("id").cast("string"), 1000).alias("text")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        with pytest.raises(AttributeError):  # there are no documents
            dict(corpus_pipeline.STAGES)[name](spark, None, "")
        sizes = [r["n"] for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    assert len(sizes) > 1
    assert max(sizes) < 6 << 20

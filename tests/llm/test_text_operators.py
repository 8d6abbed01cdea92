"""Suffix de-duplication, scoring, quality, language identification and packing against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from loomtrace.llm import decontaminate, exchange, langid, licences, lm, packing, quality, suffixes
from loomtrace.llm.queries import QUERIES
from tests.llm.samples import SCHEMA, awkward, by_row, empty, passages
from tests.tables import SF_DIR

WORD = "[^\x20\x09-\x0d]+"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def strip_brute(texts, length=200):
    """(bytes, removed, spans, hash of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def strip_rows(df):
    return by_row(suffixes.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def strip_expected(df):
    rows = df.collect()
    return sorted(((r["doc_id"], *x) for r, x in zip(rows, strip_brute([r["text"] for r in rows]), strict=True)), key=repr)


def repeats(spark):
    _, say = passages(11)
    a, b, c = say(50), say(50), "ab" * 150
    texts = [a + " " + say(20), say(30) + a + b, b + say(5) + b, c, c + "x", "é" * 130 + say(3), "é" * 140, a[:199], a[1:], say(300), a * 3, b[:200]]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts * 2)], SCHEMA)


@pytest.mark.parametrize(("hot", "sent"), [(20_000, 0), (2, 100_000), (2, 0)])
def test_repeated_strings(spark, monkeypatch, hot, sent):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "HOT_ANCHORS", sent)
    for df in (awkward(spark), repeats(spark)):
        assert strip_rows(df) == strip_expected(df)


def test_long_texts_are_searched_in_segments(monkeypatch):
    rng = np.random.default_rng(7)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 150, 1700, 1700, 4100, 5000])

    def windows():
        return {w: (r, p, h) for r, p, first, last, h in zip(*suffixes.anchors(data, offsets), strict=True) for w in range(first, last + 1)}

    whole = windows()
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    assert windows() == whole
    assert len(whole) == 1550 - 199 + 2400 - 199 + 900 - 199


def test_suffix_sort_is_the_order_of_bytes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    start = rng.integers(0, 2900, 400)
    group = rng.integers(0, 5, 400)
    s = suffixes.Suffixes(data, start, len(data) - start)
    order, shared = s.verified(group)
    text = data.tobytes()
    keys = [(group[i], text[start[i] : start[i] + s.length[i]]) for i in order]
    assert keys == sorted(keys)
    for k in range(1, 400):
        (g, x), (h, y) = keys[k - 1], keys[k]
        n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert shared[k] == (n if g == h else -1)


def score_expected(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) and all bigram counts."""
    texts = [[*re.findall(WORD, lower(r["text"])), None] for r in rows]
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    counts = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t) for t in texts]
    return [(r["doc_id"], h, len(t), sum(counts[w] > 0 for w in t), n, round(b, 5)) for r, h, t, b in zip(rows, held, texts, base, strict=True)]


@pytest.mark.parametrize("fan", [1024, 2])
def test_base_scores(spark, monkeypatch, fan):
    monkeypatch.setattr(exchange, "FAN", fan)
    df = awkward(spark)
    got = lm.score_documents(df).withColumn("base_score", F.round("base_score", 5))
    assert by_row(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == sorted(score_expected(df.collect()), key=repr)


def model_expected(rows):
    """Scores by counting pairs in dictionaries, with weights from expectation-maximisation over single tokens."""
    texts = [[*re.findall(WORD, lower(r["text"])), "</s>"] for r in rows]
    fold = [4 if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 7 for r in rows]
    pairs = lambda t: list(zip(["<s>", *t[:-1]], t, strict=True))
    of = lambda chosen: (Counter(w for t, f in zip(texts, fold, strict=True) if chosen(f) for w in t), Counter(p for t, f in zip(texts, fold, strict=True) if chosen(f) for p in pairs(t)))
    bucket = lambda n: min(int(math.log2(n + 1)), lm.BUCKETS - 1)
    binned = lambda p: 2.0 ** (-round(-math.log2(p) * lm.BINS) / lm.BINS) if p else 0.0

    def parts(t, one, two):
        n = sum(one.values())
        for before, w in pairs(t):
            c = one["</s>" if before == "<s>" else before]
            yield bucket(c), (two[before, w] / max(c, 1), one[w] / max(n, 1), 1 / (types + 1))

    one, two = of(lambda f: f != 2)
    types = len(one)
    inner = of(lambda f: f not in (2, 3))
    seen = [(b, (binned(p[0]), binned(p[1]), p[2])) for t, f in zip(texts, fold, strict=True) if f == 3 for b, p in parts(t, *inner)]
    weights = {b: list(lm.START) for b in range(lm.BUCKETS)}
    for _ in range(lm.EM_ROUNDS if seen else 0):
        sums = {b: list(lm.START) for b in weights}
        for b, p in seen:
            mixed = [w * x for w, x in zip(weights[b], p, strict=True)]
            for k in range(3):
                sums[b][k] += mixed[k] / sum(mixed)
        weights = {b: [x / sum(s) for x in s] for b, s in sums.items()}
    weights[0] = [0, weights[0][0] + weights[0][1], weights[0][2]]
    for b, (x, y, z) in weights.items():
        total = x + y + max(z, lm.FLOOR)
        weights[b] = (x / total, y / total, max(z, lm.FLOOR) / total)
    return [sum(math.log10(sum(w * x for w, x in zip(weights[b], p, strict=True))) for b, p in parts(t, one, two)) for t in texts]


def test_model_scores(spark):
    df = awkward(spark)
    got = sorted((repr(r["doc_id"]), round(r["score"], 4)) for r in lm.score_documents(df).collect())
    assert got == sorted((repr(r["doc_id"]), round(x, 4)) for r, x in zip(df.collect(), model_expected(df.collect()), strict=True))


def test_model_beats_base_on_held_out_texts(spark):
    rows = QUERIES["op8_lm_score"](spark, SF_DIR).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_model_is_a_distribution(spark):
    df = awkward(spark)
    assert lm.score_documents(df).where("score > 0 or score is null").count() == 0


def quality_expected(r):
    text = r["text"] or ""
    words = re.findall(WORD, text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (r["doc_id"], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed)


def test_quality_counts(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(25, 1, 0), (28, 1, 0), (31, 0, 1), (31, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    got = quality.assess(df, labels)
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(map(quality_expected, df.collect()), key=repr)
    assert got.where("kept and base_failed").count() == 0


def test_quality_scores_like_a_plain_ratio(spark):
    from pyspark.sql import types as T

    _, say = passages(61)
    texts = [say(40 + i) for i in range(30)] + [None, "Word word WORD"]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    labelled = quality.labelled_ids(labels)
    target = {r["doc_id"] for r in labelled.where("fold = 0").collect()}
    # the hashes are the engine's own: one for every word and pair of neighbours
    words = [re.findall(WORD, (t or "").lower()) for t in texts]
    flat = sorted({w for t in words for w in t})
    table = spark.createDataFrame([(w,) for w in flat], T.StructType([T.StructField("w", T.StringType())]))
    one = {r[0]: r[1] for r in table.select("w", F.xxhash64("w")).collect()}
    pairs = sorted({(one[a], one[b]) for t in words for a, b in zip(t, t[1:], strict=False)})
    two = {(r[0], r[1]): r[2] for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b")).collect()}
    grams = [[(1, one[w] % quality.BUCKETS) for w in t] + [(2, two[one[a], one[b]] % quality.BUCKETS) for a, b in zip(t, t[1:], strict=False)] for t in words]
    raw, good = Counter(g for t in grams for g in t), Counter(g for i, t in enumerate(grams) if i in target for g in t)
    total = {n: sum(c for g, c in raw.items() if g[0] == n) for n in (1, 2)}
    own = {n: sum(c for g, c in good.items() if g[0] == n) for n in (1, 2)}
    weight = {}
    for g, c in raw.items():
        expected = c * own[g[0]] / total[g[0]]
        z = (good[g] - expected) ** 2 / (expected + 1)
        weight[g] = math.log((good[g] + quality.SMOOTHING) / (expected + quality.SMOOTHING)) * z / (z + quality.SIGNIFICANCE[g[0]] ** 2)
    scores = {i: sum(weight[g] for g in t) / len(t) if t else 0.0 for i, t in enumerate(grams)}
    got = {r["doc_id"]: r["score"] for r in quality.assess(df, labels).collect()}
    assert {i: round(x, 9) for i, x in got.items()} == {i: round(x, 9) for i, x in scores.items()}


def test_quality_without_labels_keeps_what_passes_the_base_rules(spark):
    got = quality.assess(awkward(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.where("kept = base_failed or score <> 0").count() == 0


def test_quality_drops_toxic_and_keeps_good_documents(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    got = QUERIES["op2_quality_rules"](spark, SF_DIR).join(labels, "doc_id").where("not base_failed")
    toxic, good = got.where("toxic = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0], got.where("toxic = 0 and quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.9
    assert toxic is None or toxic <= good


def test_quality_of_documents_whose_labels_are_not_seen(spark):
    rng, say = passages(21)
    rows, labels = [], []
    for i in range(400):
        kind = ("good", "good", "toxic", "low")[i % 4]
        words = say(60).split()
        if kind == "toxic":
            words[rng.randrange(60)] = rng.choice(["vile", "scum"])
        if kind == "low":
            words = [w + "###" if rng.random() < 0.5 else w for w in words]
        rows.append((i, " ".join(words), "en", "a", 0))
        if i < 320:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    got = quality.assess(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    unseen = got.where("doc_id >= 320 and not base_failed").groupBy((F.col("doc_id") % 4).alias("kind")).agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r["kind"]: r["kept"] for r in unseen.collect()}
    assert min(share[0], share[1]) > 0.8
    assert max(share[2], share[3]) < 0.2


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op4_language_id"](spark, SF_DIR).where("held_out and lang_pred <> 'und'").join(docs, "doc_id").where("lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_language_of_awkward_rows(spark):
    df = awkward(spark)
    got = {(r["doc_id"], r["lang_pred"] == "und", 0 <= r["score"] <= 1) for r in langid.identify(df).collect()}
    assert got == {(r["doc_id"], not any(c.isalpha() for c in r["text"] or ""), True) for r in df.collect()}


def test_language_without_labels(spark):
    assert {r["lang_pred"] for r in langid.identify(awkward(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_packing_is_an_exact_partition(spark):
    from tokenizers import Tokenizer

    df = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    coder = Tokenizer.from_file(VOCABULARY)
    ids = {r["doc_id"]: [*coder.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in df.collect()}
    pieces = packing.pack(df, VOCABULARY).collect()
    taken, sequences = {}, {}
    for p in pieces:
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        assert list(np.frombuffer(p["ids"], "<u4")) == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        taken.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert taken.keys() == ids.keys()
    for spans, total in [*((s, len(ids[d])) for d, s in taken.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for begin, length in sorted(spans):
            assert begin == at
            at += length
        assert at == total if total is not None else at <= 4096
    padded = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n == 4096 or n & (n - 1) == 0 for n in padded)


def test_ids_of_chunks_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    coder, encoder = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY)
    texts = ["Hello, World!", "", None, "a\u00a0b c\u2028d", "x\x1cy z\x85w", "naïve café İstanbul ǅ", "don't (stop) ... now--then", "名前 です。", "tab\tnew\nline\r\n", "Hello, World!", "ﬁ \u0301a e\u0301", "A" * 300, "3.14 1,000 C3PO"]
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == coder.encode(text or "", add_special_tokens=False).ids


def test_letters_beyond_ascii_are_remembered_without_case_and_punctuation():
    from tokenizers import Tokenizer

    coder, encoder = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY)
    texts = ["Été été, ÉTÉ! (été) a×b÷c Straße STRASSE", "ÿ Ÿ é\u0301 e\u0301té été\u0327 Ã· Ã— ñandú; ÑANDÚ;; é.é"]
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == coder.encode(text, add_special_tokens=False).ids
    known = len(encoder.hashes)
    encoder.encode(pa.array(["éTé ÉTé; Été ñANdú,"]))
    assert len(encoder.hashes) == known  # one way to write them is enough for all


def test_chunks_met_again_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 100)
    encoder = packing.Encoder(VOCABULARY)
    learned = []
    runs = encoder.runs
    monkeypatch.setattr(encoder, "runs", lambda text, at, tokenizer: learned.append(len(at) - 1) or runs(text, at, tokenizer))
    common, letters = " ".join(f"w{a}{b}" for a in "abcdef" for b in "abcdef"), "abcdefghijklmnopqrstuvwxyz"
    want = encoder.whole([common])[0]
    for k in range(12):
        rare = " ".join(f"x{letters[k]}{a}{b}" for a in "abcdef" for b in "abcdef")
        ids, at = encoder.encode(pa.array([common, rare]))
        assert ids[: at[1]].tobytes() == want and ids[at[1] :].tobytes() == encoder.whole([rare])[0]
    assert sum(learned) == 36 + 12 * 36  # the common words once, the others of each batch


@pytest.mark.parametrize("rows", [3, 200_000])
def test_pieces_of_a_term_are_counted_beyond_32_bits(spark, rows):
    """Every piece has the terms 1, 2 and one of the largest ids; so many pieces times terms take 64 bits."""
    own = F.concat(F.lit(b"\x01\x00\x02\x00\x01\x00"), F.lit(b"\xff\xbf"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        df, n, mean = packing.statistics(spark.range(rows, numPartitions=1).select(own.alias("ids"), F.lit(4).cast("long").alias("length")), "<u2")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (n, mean, np.flatnonzero(df).tolist(), set(df[df > 0].tolist())) == (rows, 4.0, [1, 2, 0xBFFF], {rows})


def test_repeated_rows_are_packed_each(spark):
    df = awkward(spark)
    assert packing.pack(df, VOCABULARY).where("start = 0").count() == df.count()


def test_neighbours_by_bm25():
    pieces = [[5, 6, 7, 2], [5, 6, 8, 2], [9, 9, 9, 2], [5, 1, 1, 2]]
    df = np.bincount([t for p in pieces for t in set(p)])
    shard = packing.Shard([np.array(x) for x in pieces], df, 4, 4.0)
    assert shard.neighbours(0, 99).tolist()[:2] == [1, 3]


@pytest.mark.parametrize("dense", [0.0, 0.3, 2.0])
def test_neighbours_are_ranked_by_all_terms(monkeypatch, dense):
    monkeypatch.setattr(packing, "DENSE", dense)
    rng = np.random.default_rng(3)
    pieces = [rng.zipf(1.5, rng.integers(5, 80)) % 60 for _ in range(300)]
    df = np.bincount([t for p in pieces for t in set(p.tolist())], minlength=60) * 3
    mean = 41.0
    shard = packing.Shard(pieces, df, 900, mean)

    def score(q, d):
        total = 0.0
        for t in set(q.tolist()):
            tf = int((d == t).sum())
            idf = math.log(1 + (900 - df[t] + 0.5) / (df[t] + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        return total

    for seed in (0, 7, 299):
        got = shard.neighbours(seed, 10**9)
        scores = [score(pieces[seed], pieces[r]) for r in got]
        assert len(got) == 299
        assert all(a >= b - 1e-4 for a, b in zip(scores, scores[1:], strict=False))
        few = shard.neighbours(seed, 500)
        assert few.tolist() == got[: len(few)].tolist()


def test_license_templates_are_found(spark):
    rows = [(i, f"// {text}\ncode code", None, "src", 0) for i, (_, text) in enumerate(licences.TEMPLATES)]
    got = {r["doc_id"]: r["license"] for r in licences.own_licences(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()}
    assert got == {i: name for i, (name, _) in enumerate(licences.TEMPLATES)}


def cosine_expected(text):
    """Largest cosine over whole text, blocks and lines, by the definition, with its license and unit."""
    unit, idf, other = licences.vectors()
    best = []
    for order, part in enumerate([text or "", *regex.split(r"\n(?:[^\p{L}\p{N}\n]*\n)+", text or ""), *(text or "").split("\n")]):
        tf = Counter(re.findall(licences.TERM, part.lower()))
        norm = math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in tf.items()))
        for vector, (name, _) in zip(unit, licences.TEMPLATES, strict=True):
            x = sum(n * idf[t] * vector.get(t, 0) for t, n in tf.items() if t in idf) / (norm or 1)
            if x >= licences.THRESHOLD:
                best.append((-round(x, 9), order, name))
    return (min(best)[2], round(-min(best)[0], 6), "header" if min(best)[1] else "file") if best else (None, None, None)


def test_own_licences_like_all_cosines(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r["doc_id"]: (r["license"], round(r["similarity"], 6)) for r in licences.own_licences(docs, "doc_id", "text").collect()}
    expected = {r["doc_id"]: cosine_expected(r["text"])[:2] for r in docs.collect()}
    assert got == {k: v for k, v in expected.items() if v[0]}


def test_nearest_ancestor_directory(spark):
    files = spark.createDataFrame([("a/b/c",), ("a/b",), ("a",), ("x",), (None,)], "directory string")
    owned = spark.createDataFrame([("a", "MIT", "a/L"), ("a/b", "GPL-3.0", "a/b/L2"), ("a/b", "Apache-2.0", "a/b/L1")], "directory string, license string, licence_file string")
    got = {r["directory"]: (r["inherited_from"], r["inherited"]) for r in licences.nearest_licences(files, owned).collect()}
    assert got == {"a/b/c": ("a/b", "Apache-2.0"), "a/b": ("a/b", "Apache-2.0"), "a": ("a", "MIT")}


def scan_expected(files):
    """Rows of the scan by looking at every file and walking up its directories."""
    own = [cosine_expected(text) for _, _, _, text in files]
    owned = {}
    for (_, path, directory, _), (name, _, unit) in sorted(zip(files, own, strict=True), key=lambda x: (x[0][1] is None, x[0][1] or "", x[1][0] or "")):
        if unit == "file" and directory is not None:
            owned.setdefault(directory, name)
    out = []
    for (doc, path, directory, _), (name, x, unit) in zip(files, own, strict=True):
        at = directory
        while at is not None and at not in owned:
            at = at.rpartition("/")[0] if "/" in at else None
        if name:
            out.append((doc, path, name, unit, x, None))
        else:
            out.append((doc, path, owned.get(at), "inherited" if at is not None else "none", None, at))
    return sorted(out, key=repr)


def test_license_scan_like_walking_up(spark):
    mit = next(t for _, t in licences.TEMPLATES if "NONINFRINGEMENT" in t)
    gpl = next(t for _, t in licences.TEMPLATES if t.startswith("This program is free software"))
    wrapped = "/*\n * " + gpl[:90] + "\n * " + gpl[90:] + "\n *\n * More words here.\n */\ncode and more code that says nothing of the kind\n"
    texts = [
        (1, "p/LICENSE", "p", mit), (2, "p/a.c", "p", "code"), (3, "p/q/b.c", "p/q", None), (4, "p/q/c.c", "p/q", wrapped), (5, "p/q/d.c", "p/q", ""),
        (None, "p/q/r/LICENSE", "p/q/r", "Released under the MIT License."), (None, None, None, "code"), (None, None, None, "Released under the MIT License."),
        (6, "p/q/r/e.c", "p/q/r", "x"), (6, "p/q/r/s/f.c", "p/q/r/s", "y"), (7, "pq/g.c", "pq", "z"), (8, "m/h.c", "m", "x\n" * 30 + "Released under the MIT License."), (9, "m/i.c", "m", "y"),
        (2, "p/a.c", "p", "code"), (8, "m/L2", "m", gpl), (8, "m/L1", "m", "Licensed under CC BY-NC 4.0."),
    ]
    files = spark.createDataFrame(texts, "doc_id long, path string, directory string, text string").withColumn("license", F.lit("x")).withColumn("known", F.lit(1))
    assert by_row(licences.scan(files), "doc_id", "path", "license", "evidence", "similarity", "inherited_from") == scan_expected(texts)
    assert {r[3] for r in scan_expected(texts)} == {"file", "header", "inherited", "none"}


def test_license_scan_of_awkward_rows(spark):
    df = awkward(spark)
    tree = [tuple(r) for r in licences.document_files(df).select("doc_id", "path", "directory", "text").collect()]
    assert by_row(licences.scan(licences.document_files(df)), "doc_id", "path", "license", "evidence", "similarity", "inherited_from") == scan_expected(tree)


def windows_expected(docs, items):
    """(doc_id, words, hit words, item ids) by looking for every window at every place."""
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = {}
    for r in items:
        w = cut(r["text"])
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(r["item_id"])
    lengths = {len(w) for w in windows}
    out = []
    for r in docs:
        w, hit, found = cut(r["text"]), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((r["doc_id"], len(w), len(hit), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_decontamination(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "SENT_PRINTS", sent)
    monkeypatch.setattr(decontaminate, "SENT_ROWS", sent)
    df = awkward(spark)
    texts = [r["text"] for r in df.collect() if r["text"]]
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate([texts[8], " ".join(texts[9].split()[5:25]), "two words", None, "", "zz", texts[15][:150], "two words"])], "item_id long, text string, n int")
    got = by_row(decontaminate.report(df, items), "doc_id", "n_words", "n_hit", "items_sha256", "contaminated")
    assert got == windows_expected(df.collect(), items.collect())


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_items_without_an_id_are_hits(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "SENT_PRINTS", sent)
    monkeypatch.setattr(decontaminate, "SENT_ROWS", sent)
    _, say = passages(41)
    a, b = say(12), say(12)
    docs = spark.createDataFrame([(1, say(5) + " " + a, "en", "s", 0), (2, b, "en", "s", 0), (3, say(30), "en", "s", 0)], SCHEMA)
    items = spark.createDataFrame([(None, a), (7, b)], "item_id long, text string")
    got = by_row(decontaminate.report(docs, items), "doc_id", "n_hit", "n_items", "contaminated")
    assert got == [(1, 12, 0, True), (2, 12, 1, True), (3, 0, 0, False)]


@pytest.mark.parametrize("run", [
    lambda d, s: quality.assess(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
    lambda d, s: lm.score_documents(d),
    lambda d, s: langid.identify(d),
    lambda d, s: packing.pack(d, VOCABULARY),
    lambda d, s: suffixes.remove_repeats(d),
    lambda d, s: licences.scan(licences.document_files(d)),
    lambda d, s: decontaminate.report(d, s.createDataFrame([(1, "a b")], "item_id long, text string")),
])
def test_empty_tables(spark, run):
    assert run(empty(spark), spark).count() == 0

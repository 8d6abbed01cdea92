"""The divergence audit against plain dictionaries, with blocks, pieces and pair sums of any size."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import divergence
from tests.llm.samples import SCHEMA, awkward, by_row, empty

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def brute(rows):
    having, counts = {}, {}
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        having.setdefault(lang, Counter()).update(set(terms))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
    out = []
    for lang, by_source in counts.items():
        kept = [t for t, n in having[lang].items() if n >= 10]

        def shares(count, kept=kept):
            size = sum(count[t] for t in kept)
            return {t: 1 + 1000000000 * (count[t] + 2) // (size + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in by_source.items()}
        q = shares(sum(by_source.values(), Counter()))
        for source, own in p.items():
            pairs = [(-sum((own[t] - p[o][t]) ** 2 // (own[t] + p[o][t]) for t in kept), o) for o in p if o != source]
            terms = [(-((own[t] - q[t]) ** 2 // (own[t] + q[t])), t) for t in kept if by_source[source][t] and own[t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                out += [(lang, source, part, item, -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out, key=repr)


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = ["Ämt", "ÄMT", "the", "The", "naïve", "名前", "x1y", "a-b"] + ["w" + "abcdefghij"[k % 10] * (k % 4 + 1) + "xyz"[k % 3] for k in range(60)]
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.5 else f"s{rng.randrange(6)}"
        rows.append((i, " ".join(rng.choices(words[rng.randrange(30) :], k=rng.randrange(12))), rng.choice(["en", "en", "de", None]), source, 0))
    return rows + rows[:3] + [(None, None, "xx", None, None), (None, None, "xx", "only", None), (1, "zz", "yy", "alone", 2)]


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert by_row(divergence.audit(df), *COLUMNS) == brute(rows)
    assert divergence.audit(empty(spark)).collect() == []


@pytest.mark.parametrize("entries", [1, 40, 1 << 20])
def test_blocks_of_any_size(spark, monkeypatch, entries):
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    rows = corpus(entries)
    assert by_row(divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3)), *COLUMNS) == brute(rows)


def test_pieces_never_cut_a_term(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    text = b"Alpha beta, gamma9delta " + "größe".encode() + b" " + b"x" * 40
    assert [t for piece in divergence.terms_of(text) for t in piece] == [b"alpha", b"beta", b"gamma", b"delta", "größe".encode(), b"x" * 40]


@pytest.mark.parametrize("pairs", [1, 7, 1 << 20])
def test_sums_of_pairs(monkeypatch, pairs):
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    rng, sums, expected = np.random.default_rng(5), divergence.Sums(), Counter()
    for _ in range(30):
        names = [f"s{k}" for k in rng.permutation(9)[: rng.integers(2, 9)]]
        p, gone = rng.integers(1, 10**9, len(names)), rng.integers(1, 10**9, len(names))
        sums.add("en", names, p, gone)
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                if a < b:
                    f = lambda x, y: int(x - y) ** 2 // int(x + y)
                    expected[a, b] += f(p[i], p[j]) - f(p[i], gone[j]) - f(gone[i], p[j]) + f(gone[i], gone[j])
    got = {tuple(sorted((r["a"], r["b"]))): r["value"] for r in sums.rows().to_pylist()}
    assert got == dict(expected)


def test_shares_beyond_64_bits(spark):
    """Counts at which a product with a billion exceeds 64 bits."""
    cases = [(3 * 10**12, 7 * 10**14, 10**6), (0, 9 * 10**14, 5), (10**15 - 1, 10**15, 1), (5, 5, 1)]
    df = spark.createDataFrame(cases, "n long, size long, terms long")
    got = [r[0] for r in df.select(divergence.share(df["n"], df["size"], df["terms"])).collect()]
    assert got == [1 + 10**9 * (n + 2) // (size + 2 * terms) for n, size, terms in cases]


def test_merge_sums_runs():
    block = divergence.Block()
    for k in range(12):
        block.add("en", f"s{k % 2}", b"alpha beta" if k < 9 else b"alpha")
    rows = [dict(zip(divergence.RUN.names, r, strict=True)) for r in block.runs(1)]
    merged = divergence.merge(pa.Table.from_pylist(rows, schema=divergence.RUN)).to_pylist()
    assert merged == [{"lang": "en", "term": "alpha", "sources": ["s0", "s1"], "counts": [6, 6]}]

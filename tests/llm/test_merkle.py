"""The Merkle manifest against a plain recursive version, whatever the height of the trees."""

import hashlib
import re
import zlib

import pytest

from loomtrace.llm import merkle
from tests.llm.samples import SCHEMA, awkward, by_row, empty

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, tamper=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), row[1]) if tamper and row[1] else row[1]
    fields = (row[0], row[3], row[2], row[4], text)
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(digests):
    """(root, path of (left, right) of each leaf)."""
    paths, groups = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, merged = [], []
        for first in range(0, len(digests), 8):
            run = digests[first : first + 8]
            for k in range(len(run)):
                for leaf in groups[first + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            merged.append([leaf for g in groups[first : first + 8] for leaf in g])
        digests, groups = above, merged
    return digests[0], paths


def brute(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        ordered = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = (ordered, *tree([leaf_of(r) for r in ordered]))
    root, upper = tree([trees[lang][1] for lang in langs])
    out = []
    for lang, suffix in zip(langs, upper, strict=True):
        ordered, subroot, paths = trees[lang]
        for row, path in zip(ordered, paths, strict=True):
            digest = leaf_of(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0)
            for left, right in path + suffix:
                digest = sha(left + digest + right)
            proof = sha("".join(left + right for left, right in path + suffix))
            out.append((row[0], leaf_of(row), subroot, root, proof, digest, digest == root))
    return sorted(out, key=repr)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_awkward_rows(spark):
    df = awkward(spark)
    assert by_row(merkle.manifest(df), *COLUMNS) == brute(rows_of(df))


def test_empty_and_single(spark):
    assert merkle.manifest(empty(spark)).collect() == []
    one = spark.createDataFrame([(6, "Ab", "en", None, 2)], SCHEMA)
    (row,) = merkle.manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")


@pytest.mark.parametrize("sizes", [(8, 9, 1), (64, 65, 513), (512,), (4097, 2)])
def test_heights(spark, sizes):
    rows = [(i * 7 + k, f"Text {i}", f"l{k}", "s", i) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert by_row(merkle.manifest(df), *COLUMNS) == brute(rows)


def test_more_languages_than_a_run(spark):
    rows = [(i, "x", f"l{i % 75:02d}", None, None) for i in range(160)]
    assert by_row(merkle.manifest(spark.createDataFrame(rows, SCHEMA)), *COLUMNS) == brute(rows)


def test_queue_delivers_in_label_order():
    digests = [sha(str(i)) for i in range(70)]
    nodes = merkle.sweep_up(digests, merkle.height(70))
    assert [len(n) for n in nodes] == [70, 9, 2, 1]
    assert nodes[-1][0] == tree(digests)[0]
    paths = merkle.sweep_down(nodes, ["above"], [""])
    assert all(p[0][-1] == "above" for p in paths)

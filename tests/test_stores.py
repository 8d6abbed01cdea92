"""The store of clusters, filing, and PDF files on small cases."""

import re

import pytest

from loomtrace.queries.stores import _pdf
from loomtrace.sources import filing, pdf, store
from loomtrace.sources.shared import new_path

DOC = "source string, filename string, dated string, vendor string, folder string, content string"


def test_pdf_files_of_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    whole = _pdf(["NORTHWIND O'NEIL-TRADERS LTD", "Invoice #: A\\B-7 (copy)", "Invoice date 03/04/2024", "Total: 1,200.5", "Grand total 99"])
    (tmp_path / "deep" / "a.pdf").write_bytes(whole)
    array = b"%PDF-1.7\nstream\r\nBT [(Invoice no. )-20(X\\0571)] TJ (plain) ' ET\nendstream"
    (tmp_path / "b.pdf").write_bytes(array)
    (tmp_path / "cut.pdf").write_bytes(whole[:60])
    (tmp_path / "empty.pdf").write_bytes(b"\n")
    (tmp_path / "other.txt").write_bytes(whole)
    found = pdf.texts(pdf.read(spark, f"file://{tmp_path}")).cache()
    got = {r["path"].rsplit("/", 1)[1]: r for r in found.collect()}
    assert sorted(got) == ["a.pdf", "b.pdf", "cut.pdf", "empty.pdf"]
    assert got["b.pdf"]["text"] == "Invoice no. X/1\nplain"
    assert got["cut.pdf"]["reject_reason"] == "no text can be read" and got["empty.pdf"]["reject_reason"] == "not a PDF file"
    fields = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in pdf.invoices(found).collect()}
    assert fields["a.pdf"] == ("A", "2024-04-03", 9900, "Northwind O'Neil-Traders Ltd")
    assert fields["b.pdf"] == ("X/1", None, None, None) and fields["cut.pdf"] == (None,) * 4


def plain_names(documents, held):
    """Names by the rule, one document after another."""
    brought = {d[1] for d in documents}
    seen, out = {}, {}
    for source, name, *_ in sorted(documents):
        stem, suffix = re.fullmatch(r"(.+?)((?:\.[^.]+)?)", name).groups()
        if name not in seen and name not in held:
            out[source] = name
            seen[name] = 1
            continue
        k = max(seen.get(name, 1), 1) + 1
        while f"{stem}-{k}{suffix}" in brought | held:
            k += 1
        out[source], seen[name] = f"{stem}-{k}{suffix}", k
    return out


@pytest.mark.parametrize("held", [set(), {"a.pdf", "a-3.pdf"}, {"a-2.pdf", "a-4.pdf", "b"}])
def test_names_are_unique(spark, held):
    names = ["a.pdf"] * 6 + ["a-2.pdf"] * 2 + ["a-5.pdf", "b", "b", "b-2", ".hidden"]
    documents = [(f"s{k:02d}", n, "2024-05-06", None, None, "x") for k, n in enumerate(names)]
    existing = spark.createDataFrame([("2024/05", h) for h in held] + [("2023/05", "a.pdf")], "directory string, filename string")
    plan = filing.planned(spark.createDataFrame(documents, DOC), existing, "2024-01-01").collect()
    got = {r["source"]: r["filed_name"] for r in plan}
    assert len(set(got.values()) | held) == len(got) + len(held)
    assert got == plain_names(documents, held)


def test_filing_writes_on_demand_only(spark):
    rows = [("s1", "a.pdf", "06/05/2024", " Acme ", "in", "one"), ("s2", "a.pdf", "2024-05-31", "", "in", "two"), ("s3", "b", None, None, "x/../..", "three"), ("s4", "c", "soon", "V", None, "four")]
    documents, root = spark.createDataFrame(rows, DOC), new_path(spark, "archive")
    existing = spark.createDataFrame([], "directory string, filename string")
    plan = {r["source"]: r for r in filing.file(documents, existing, root, "2025-02-03").collect()}
    assert [(plan[s]["directory"], plan[s]["filed_name"], plan[s]["vendor"]) for s in ("s1", "s2", "s4")] == [("in/2024/05", "a.pdf", "Acme"), ("in/2024/05", "a-2.pdf", "Unfiled"), ("2025/02", "c", "V")]
    assert plan["s3"]["refused"] and plan["s3"]["filed_name"] is None and plan["s4"]["dated_by_run"]
    filing.file(documents, existing, root, "2025-02-03", dry_run=False).collect()
    kept = spark.read.parquet(root)
    assert sorted((r["directory"], r["filed_name"], r["content"]) for r in kept.collect()) == [("2025/02", "c", "four"), ("in/2024/05", "a-2.pdf", "two"), ("in/2024/05", "a.pdf", "one")]


def test_a_set_is_replaced_as_a_whole(spark):
    root = new_path(spark, "store")
    assert store.current(spark, root, "clusters") is None
    instances = spark.createDataFrame([("i1", "c1"), ("i2", "c1"), ("i3", "c2"), ("i4", "gone")], "instance_id string, cluster_id string")
    one = spark.createDataFrame([("c1", 2), ("c2", 1)], "cluster_id string, n long")
    store.replace(root, one, instances)
    store.dismiss(root, spark.createDataFrame([("c2",), ("zz",)], "cluster_id string"))
    before, held = store.current(spark, root, "clusters"), store.current(spark, root, "instances")
    two = spark.createDataFrame([("c2", 5), ("c3", 1)], "cluster_id string, n long")
    store.replace(root, two, instances.where("cluster_id = 'c2'"))
    # who reads the old set still has all of it
    assert sorted((r["cluster_id"], r["dismissed"]) for r in before.collect()) == [("c1", False), ("c2", True)]
    assert sorted(r["instance_id"] for r in held.collect()) == ["i1", "i2", "i3"]
    assert sorted((r["cluster_id"], r["n"], r["dismissed"]) for r in store.current(spark, root, "clusters").collect()) == [("c2", 5, True), ("c3", 1, False)]
    assert [r["instance_id"] for r in store.current(spark, root, "instances").collect()] == ["i3"]
    assert sorted(r["version"] for r in store.versions(spark, root).collect()) == [1, 2, 3]


def test_invoices_are_read_once(spark):
    """Fields and reasons come from one pass over the files."""
    from loomtrace.queries import QUERIES
    from tests.tables import SF_DIR

    plan = QUERIES["pdf_invoices"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInPandas") == 2

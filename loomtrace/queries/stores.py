"""Queries on what is kept and filed: the set of clusters, the archive of documents, and PDF files."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from loomtrace.plans.adapters import RENAMED_MS, table
from loomtrace.queries import sql
from loomtrace.queries.workflows import recorded
from loomtrace.sources import filing, pdf, store
from loomtrace.sources.shared import new_path

TODAY = "2024-02-29"


def replaced_clusters(spark, sf_dir):
    """The set found in the whole log after that of its first half, of which some were dismissed."""
    root = new_path(spark, "store")
    _, runs, _ = recorded(spark, sf_dir)

    def found(part, least):
        return part.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.first("signature").alias("signature")).where(F.col("n") >= least)

    early = runs.where(F.col("started_ms") < RENAMED_MS)
    store.replace(root, found(early, 2), early)
    old = store.current(spark, root, "clusters")
    store.dismiss(root, old.where(F.substring("cluster_id", 1, 1) < "8"))
    store.replace(root, found(runs, 3), runs)
    of = store.current(spark, root, "instances").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("instances"), F.countDistinct("user_id").alias("users"))
    last = store.versions(spark, root).agg(F.max("version").alias("version"))
    joined = store.current(spark, root, "clusters").select("cluster_id", "n", "dismissed").join(of, "cluster_id")
    return joined.join(F.broadcast(last), F.lit(True))


def _papers(spark, sf_dir):
    """Documents of orders: few names, dates as people write them, some without a vendor or with a folder that leads out."""
    key = F.col("o_orderkey")
    dated = F.when(key % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key % 5 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(key % 5 == 2, F.date_format("o_orderdate", "yyyy-MM")).when(key % 5 == 3, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise("unknown")
    name = F.concat(F.lit("bill"), F.when(key % 7 == 0, "-3").when(key % 7 == 1, "-2").otherwise(""), F.when(key % 3 == 0, ".tar.gz").otherwise(".pdf"))
    return table(spark, sf_dir, "orders").select(
        F.lpad(key.cast("string"), 10, "0").alias("source"), name.alias("filename"), dated.alias("dated"), F.when(key % 4 != 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("vendor"),
        F.when(key % 31 == 0, "../up").when(key % 2 == 0, "bills").alias("folder"),
    )


def filing_plan(spark, sf_dir):
    """Where documents of orders would go, beside what the archive holds of earlier ones."""
    held = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(
        F.format_string("bills/%d/%02d", 1992 + F.col("c_custkey") % 7, 1 + F.col("c_custkey") % 12).alias("directory"),
        F.concat(F.lit("bill"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("-"), (2 + F.col("c_custkey") % 5).cast("string"))).otherwise(""), F.lit(".pdf")).alias("filename"),
    )
    return filing.planned(_papers(spark, sf_dir), held, TODAY)


def _pdf(lines: list[str]) -> bytes:
    """A page that shows the lines, compressed as writers do it."""
    shown = "\n".join("(%s) Tj T*" % line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") for line in lines)
    body = zlib.compress(f"BT /F1 12 Tf\n{shown}\nET".encode("latin-1"))
    return b"%PDF-1.4\n1 0 obj << /Length " + str(len(body)).encode() + b" /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream endobj\n%%EOF"


def _files(spark, sf_dir):
    """(path, content) of an invoice for every order; some are damaged."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("invoice"), key.cast("string"), F.lit(".pdf")).alias("path"), key.alias("key"),
        F.array(
            F.upper(F.concat(F.lit("acme trading "), "o_orderpriority")), F.concat(F.lit("Invoice No: INV-"), key.cast("string")),
            F.concat(F.lit("Invoice Date: "), F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))),
            F.lit("Subtotal 10.00"), F.concat(F.lit("Total Due (INR) "), F.format_number(F.round("o_totalprice", 2).cast("decimal(18,2)"), 2)),
        ).alias("lines"),
    )

    def made(batches):
        for batch in batches:
            content = [_pdf(list(lines)) for lines in batch["lines"]]
            batch["content"] = [c[4:] if k % 50 == 0 else c.replace(b"stream\nx", b"stream\nxx") if k % 50 == 1 else c for k, c in zip(batch["key"], content, strict=True)]
            yield batch[["path", "content"]]

    return rows.mapInPandas(made, "path string, content binary")


def pdf_invoices(spark, sf_dir):
    """Fields of the invoices of all orders, and why some files have none."""
    return pdf.invoices(pdf.texts(_files(spark, sf_dir)), "reject_reason")


QUERIES = {f.__name__: f for f in (replaced_clusters, filing_plan, pdf_invoices)}

ORACLES = {
    "replaced_clusters": f"""with {sql.RECORDED}, old as (select cluster_id from runs where started_ms < {RENAMED_MS} group by 1 having count(*) >= 2)
        select cluster_id, count(*) as n, cluster_id[1] < '8' and cluster_id in (select cluster_id from old) as dismissed, count(*) as instances, count(distinct user_id) as users, 3::bigint as version from runs group by 1 having count(*) >= 3""",
    "filing_plan": f"""with held as (
            select distinct printf('bills/%d/%02d', 1992 + c_custkey % 7, 1 + c_custkey % 12) as directory, 'bill' || case when c_custkey % 2 = 0 then '-' || (2 + c_custkey % 5) else '' end || '.pdf' as filename from customer where c_custkey % 3 = 0
        ), d as (
            select lpad(o_orderkey::varchar, 10, '0') as source, 'bill' || case o_orderkey % 7 when 0 then '-3' when 1 then '-2' else '' end || case when o_orderkey % 3 = 0 then '.tar.gz' else '.pdf' end as filename,
                   case when o_orderkey % 5 = 4 then date '{TODAY}' else o_orderdate::date end as day, o_orderkey % 5 = 4 as dated_by_run, case when o_orderkey % 4 <> 0 then 'c' || o_custkey else 'Unfiled' end as vendor,
                   o_orderkey % 31 = 0 as refused, case when o_orderkey % 31 = 0 then '../up/' when o_orderkey % 2 = 0 then 'bills/' else '' end || strftime(day, '%Y/%m') as directory from orders
        ), r as (
            select d.*, row_number() over (partition by d.directory, d.filename order by source) - 1 - case when h.filename is null then 1 else 0 end as nth from d left join held h using (directory, filename) where not refused
        ), taken as (
            select directory, filename from d where not refused union select directory, filename from held
        ), names as (
            select directory, filename, case when ends_with(filename, '.pdf') then replace(filename, '.pdf', '') else replace(filename, '.gz', '') end as stem, case when ends_with(filename, '.pdf') then '.pdf' else '.gz' end as suffix, max(nth) as most from r group by all
        ), numbers as (
            select *, unnest(range(2, most + 12)) as k from names
        ), free as (
            select n.*, row_number() over (partition by n.directory, n.filename order by k) - 1 as nth from numbers n left join taken t on t.directory = n.directory and t.filename = stem || '-' || k || suffix where t.filename is null
        )
        select source, directory, case when r.nth < 0 then filename else stem || '-' || k || suffix end as filed_name, strftime(day, '%Y') as year, strftime(day, '%m') as month, vendor, dated_by_run, refused from r left join free using (directory, filename, nth)
        union all select source, directory, null, strftime(day, '%Y'), strftime(day, '%m'), vendor, dated_by_run, refused from d where refused""",
    "pdf_invoices": """with o as (select *, o_orderkey % 50 < 2 as bad from orders)
        select 'invoice' || o_orderkey || '.pdf' as path, case when not bad then 'INV-' || o_orderkey end as invoice_no, case when not bad then case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y-%m-%d') end end as invoice_date,
               case when not bad then (round(o_totalprice, 2)::decimal(18,2) * 100)::bigint end as amount,
               case when not bad then 'Acme Trading ' || left(o_orderpriority, 2) || case o_orderpriority[1] when '1' then 'Urgent' when '2' then 'High' when '3' then 'Medium' when '4' then 'Not Specified' else 'Low' end end as vendor,
               case o_orderkey % 50 when 0 then 'not a PDF file' when 1 then 'no text can be read' end as reject_reason from o""",
}

"""The registered queries of this subpackage, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from loomtrace.llm import chat, decontaminate, divergence, factorisation, jaccard, langid, licences, lm, merkle, packing, quality, suffixes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, laid out as a file tree."""
    return licences.scan(licences.document_files(table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the target that the labels trust."""
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings that occur twice."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("text")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents under the shingle-set links."""
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logged conversations, collapsed to the maximal ones and rendered."""
    return chat.render(table(spark, sf_dir, "conversations"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back."""
    read = warc.roundtrip(table(spark, sf_dir, "pages"))
    return read.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances and own terms of all sources of all documents."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with proofs checked against tampered leaves."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from the labels that are not held out."""
    return factorisation.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_license_scan": op1_license_scan, "op2_quality_rules": op2_quality_rules, "op3_pack": op3_pack, "op4_language_id": op4_language_id, "op5_suffix_dedup": op5_suffix_dedup, "op6_jaccard_join": op6_jaccard_join, "op7_chat_format": op7_chat_format, "op8_lm_score": op8_lm_score, "op9_warc": op9_warc, "op10_decontaminate": op10_decontaminate, "op11_source_divergence": op11_source_divergence, "op12_merkle_manifest": op12_merkle_manifest, "op13_quality_classifier": op13_quality_classifier}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"



#: Unsigned CRC-32 of an ASCII text: byte by byte, eight steps of its reversed polynomial each.
_CRC32 = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({}, ''), lambda ch: ord(ch)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _merkle_sql(levels: int = 9) -> str:
    """SQL of the manifest for trees of at most 8 ** ``levels`` nodes: digests level by level, then folded proofs.

    Nodes are (g, tree, pos, d): g 0 has a tree for each language, g 1 the one tree of their subroots.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    enc = "coalesce(octet_length(encode({0}::varchar)) || ':' || {0}, '-')"
    head = " || ".join(enc.format(f) for f in fields)
    low = _LOWER.format("text")
    parts = [
        f"""t as (
            select row_number() over () as r, doc_id, lang, sha256({head} || {enc.format("text")}) as leaf,
                   case when crc32 % 3 = 0 then sha256({head} || {enc.format(low)}) end as tampered
            from (select *, {_CRC32.format("doc_id::varchar")} as crc32 from documents)
        ), l as (
            select *, dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from t
        )"""
    ]
    for g, first in ((0, "select tree, pos, leaf as d from l"), (1, f"select 0 as tree, tree as pos, d from a{levels}")):
        x = "ab"[g]
        parts.append(f"{x}0 as materialized ({first})")
        for k in range(levels):
            parts.append(f"""{x}n{k} as materialized (select tree, count(*) as n from {x}{k} group by 1)""")
            parts.append(f"""{x}{k + 1} as materialized (
                select tree, pos // 8 as pos, case when min(n) > 1 then sha256(string_agg(d, '' order by pos)) else min(d) end as d from {x}{k} join {x}n{k} using (tree) group by 1, 2)""")
            parts.append(f"""{x}s{k} as materialized (
                select tree, pos, n,
                       coalesce(string_agg(d, '') over (partition by tree, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as lo,
                       coalesce(string_agg(d, '') over (partition by tree, pos // 8 order by pos rows between 1 following and unbounded following), '') as hi
                from {x}{k} join {x}n{k} using (tree))""")
    parts.append("f0 as (select r, doc_id, tree, pos, leaf, coalesce(tampered, leaf) as f, '' as proof from l)")
    step = 0
    for x, key in (("a", "f.tree = s.tree and f.pos // {} = s.pos"), ("b", "f.tree // {} = s.pos")):
        for k in range(levels):
            parts.append(f"""f{step + 1} as (
                select f.r, f.doc_id, f.tree, f.pos, f.leaf, case when s.n > 1 then sha256(lo || f || hi) else f end as f, proof || case when s.n > 1 then lo || hi else '' end as proof
                from f{step} f join {x}s{k} s on {key.format(8**k)})""")
            step += 1
    return "with " + ", ".join(parts) + f"""
        select doc_id, leaf, sub.d as subroot, root.d as root, sha256(proof) as proof_sha256, f as folded_root, f = root.d as verified
        from f{step} join a{levels} sub using (tree), b{levels} root"""


ORACLES = {
    "op11_source_divergence": f"""
        with d as (
            select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents
        ), occ as (
            select r, lang, source, unnest(w) as term from d
        ), kept as (
            select lang, term from occ group by 1, 2 having count(distinct r) >= 10
        ), grp as (select distinct lang, source from d),
        c as (
            select lang, source, term, count(*) as n from occ join kept using (lang, term) group by all
        ), dense as (
            select g.lang, g.source, k.term, coalesce(n, 0) as n from grp g join kept k using (lang) left join c using (lang, source, term)
        ), p as (
            select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over w + 2 * count(*) over w) as p from dense window w as (partition by lang, source)
        ), q as (
            select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over w + 2 * count(*) over w) as q
            from (select lang, term, sum(n) as n from dense group by 1, 2) window w as (partition by lang)
        ), apart as (
            select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ), both_parts as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
            from grp a join grp b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
            union all
            select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p join q using (lang, term) where n > 0 and p > q
        )
        select * from (select *, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from both_parts) where part = 'pair' or rank <= 10""",
    "op12_merkle_manifest": _merkle_sql(),
    "op5_suffix_dedup": """
        with d as (
            select doc_id, encode(coalesce(text, '')) as b from documents
        ), n as (
            select doc_id, b, octet_length(b) as n from d
        ), w as (
            select doc_id, i, md5(b[i:i + 199]) as m from (select doc_id, b, unnest(range(1, n - 198)) as i from n where n >= 200)
        ), again as (
            select m from w group by 1 having count(*) > 1
        ), hit as (
            select doc_id, i, lag(i) over (partition by doc_id order by i) as before from w where m in (select m from again)
        ), runs as (
            select doc_id, min(i) as low, max(i) + 200 as high from (select *, sum((before is null or i - before > 200)::int) over (partition by doc_id order by i rows unbounded preceding) as run from hit) group by doc_id, run
        ), gaps as (
            select doc_id, low, high, coalesce(lag(high) over (partition by doc_id order by low), 1) as since, row_number() over (partition by doc_id order by low desc) as from_end from runs
        ), rest as (
            select doc_id, string_agg(hex(b[since:low - 1]), '' order by low) || max(case when from_end = 1 then hex(b[high:n]) end) as kept, sum(high - low)::bigint as gone, count(*) as spans from gaps join n using (doc_id) group by 1
        )
        select doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0) as n_spans, sha256(case when kept is null then b else unhex(kept) end) as kept_sha256 from n left join rest using (doc_id)""",
    "op6_jaccard_join": f"""
        with w as (
            select doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
        ), s as (
            select doc_id, unnest(list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from w
        ), n as (
            select doc_id, count(*) as n from s group by 1
        ), p as (
            select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
        ), l as (
            select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
        ), e as (select a, b from l union all select b, a from l),
        r as (
            with recursive reach(doc_id, other) as (select a, b from e union select reach.doc_id, e.b from reach join e on reach.other = e.a)
            select doc_id, min(other) as low from reach group by 1
        )
        select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) as component_id from documents d left join n using (doc_id) left join r using (doc_id)""",
    "op7_chat_format": """
        with t as (
            select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text,
                   row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'user'), coalesce(text, '')) as pos
            from conversations where conv_id is not null
        ), p as (
            select conv_id, pos, count(*) over (partition by conv_id) as n_turns,
                   string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
                       over (partition by conv_id order by pos rows unbounded preceding) as rendered
            from t
        ), whole as (
            select rendered, n_turns, min(conv_id) as conv_id, count(*) as n_copies
            from p where pos = n_turns group by rendered, n_turns
        )
        select conv_id, n_turns, n_copies, rendered from whole
        where not exists (select 1 from p where p.pos < p.n_turns and p.pos = whole.n_turns and p.rendered = whole.rendered)""",
    "op9_warc": """
        with base as (
            select page_id, coalesce(html, '') as html from pages
        ), sized as (
            select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from base
        ), firsts as (
            select *, min(page_id) over (partition by payload_digest) as first_page from sized
        )
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and first_page <> page_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and first_page <> page_id then first_page end as refers_to
        from firsts""",
    "op10_decontaminate": f"""
        with doc as (
            select doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '{_ALNUM}') as w from documents
        ), item as (
            select item_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '{_ALNUM}') as w from benchmark
        ), item_windows as (
            select distinct item_id, least(len(w), 10) as n, list_slice(w, i, i + least(len(w), 10) - 1) as win
            from (select *, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as i from item where len(w) > 0)
        ), lengths as (select distinct n from item_windows),
        hits as (
            select d.doc_id, d.i, d.n, iw.item_id
            from (select doc_id, n, i, list_slice(w, i, i + n - 1) as win
                  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from doc, lengths)) d
            join item_windows iw on iw.n = d.n and iw.win = d.win
        ), covered as (
            select doc_id, count(distinct p) as n_hit
            from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hits) group by doc_id
        ), items as (
            select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids
            from (select distinct doc_id, item_id::varchar as s from hits) group by doc_id
        )
        select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit,
               coalesce(i.n_items, 0)::bigint as n_items, sha256(coalesce(i.ids, '')) as items_sha256,
               coalesce(c.n_hit, 0) > 0 as contaminated
        from doc d left join covered c using (doc_id) left join items i using (doc_id)""",
}

"""Queries that cluster instances and score the clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.functions.sequences import collapse, signature_hash
from loomtrace.operators import clusters as K
from loomtrace.operators import reports as P
from loomtrace.operators.ranks import medians
from loomtrace.operators import scoring as S
from loomtrace.operators.vectors import nearest
from loomtrace.plans.adapters import chats, order_steps, table
from loomtrace.queries import sql
from loomtrace.sources.shared import written


def runs(spark, sf_dir):
    """Orders as instances with their collapsed signatures; clusters are orders of one priority."""
    lines = order_steps(spark, sf_dir)
    grouped = lines.groupBy("instance_id", "user_id", "o_orderpriority").agg(
        F.min("ts_ms").alias("started_ms"),
        F.sum("duration_ms").alias("duration_ms"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("raw_signature"),
    )
    signed = grouped.withColumn("signature", collapse(F.col("raw_signature")))
    return signed.withColumns({"signature_hash": signature_hash(F.col("signature")), "cluster_id": F.col("o_orderpriority"), "context_switches": F.size("raw_signature") - F.size("signature")})


def hash_buckets(spark, sf_dir):
    """Instances by exact signature, above the floor on instances and steps."""
    found = runs(spark, sf_dir).groupBy("signature_hash").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.array_join(F.first("signature"), "|").alias("variant"), F.first(F.size("signature")).alias("steps"))
    return found.where((F.col("n") >= C.MIN_INSTANCES) & (F.col("steps") >= C.MIN_STEPS)).select("signature_hash", "n", "users", "variant")


def variant_shares(spark, sf_dir):
    """The eight most frequent variants of each cluster with their shares."""
    counts = runs(spark, sf_dir).groupBy("cluster_id", "signature_hash").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "signature_hash"))
    return counts.withColumns({"share": F.round(F.col("n") / F.sum("n").over(Window.partitionBy("cluster_id")), 4), "rank": rank}).where("rank <= 8")


def step_entropy(spark, sf_dir):
    found = S.step_entropy(runs(spark, sf_dir))
    return found.select("cluster_id", "n_instances", "n_variants", F.round("entropy", 9).alias("entropy"), F.round("dominant_share", 9).alias("dominant_share"))


def _payloads(spark, sf_dir):
    """The steps of all orders with a map of their fields."""
    lines = order_steps(spark, sf_dir)
    fields = F.create_map(
        F.lit("quantity"), F.col("l_quantity").cast("long").cast("string"),
        F.lit("discount"), F.format_string("%.2f", "l_discount"),
        F.lit("status"), F.col("l_linestatus"),
        F.lit("part"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey").cast("string")),
        F.lit("currency"), F.lit("USD"),
    )
    return lines.select(F.col("o_orderpriority").alias("cluster_id"), "instance_id", "token", fields.alias("fields"))


def _values(spark, sf_dir):
    return _payloads(spark, sf_dir).select("cluster_id", "instance_id", "token", F.explode("fields").alias("key", "value")).where("value is not null")


def parameter_spread(spark, sf_dir):
    found = S.parameter_spread(_values(spark, sf_dir))
    return found.select("cluster_id", F.round("spread", 9).alias("spread"))


def free_text_ratio(spark, sf_dir):
    """Share of turns with long text, by role."""
    return chats(spark, sf_dir).groupBy("action").agg(F.round(F.avg(F.coalesce(F.length("text") > C.FREE_TEXT_CHARS, F.lit(False)).cast("double")), 9).alias("ratio"), F.count(F.lit(1)).alias("n"))


def _representatives(found):
    """Most frequent signature of each cluster, the first by name of equally frequent ones."""
    counts = found.groupBy("cluster_id", "signature_hash").agg(F.count(F.lit(1)).alias("n"), F.first("signature").alias("signature"))
    return counts.groupBy("cluster_id").agg(F.min_by("signature", F.struct(-F.col("n"), F.col("signature_hash"))).alias("signature"))


def branch_count(spark, sf_dir):
    found = runs(spark, sf_dir)
    return S.branch_count(found, _representatives(found))


def step_graph(spark, sf_dir):
    """Per cluster and position the representative's step and up to five alternatives."""
    found = runs(spark, sf_dir)
    main = _representatives(found).select("cluster_id", F.posexplode("signature").alias("pos", "token"))
    seen = found.select("cluster_id", F.posexplode("signature").alias("pos", "other")).groupBy("cluster_id", "pos").agg(F.collect_set("other").alias("others"))
    alternatives = F.slice(F.array_sort(F.array_except("others", F.array("token"))), 1, 5)
    return main.join(seen, ["cluster_id", "pos"]).select("cluster_id", "pos", "token", F.array_join(alternatives, ",").alias("alternatives"))


def effort(spark, sf_dir):
    found = S.effort(written(runs(spark, sf_dir), "runs"))
    return found.select("cluster_id", "n", "users", "median_ms", *(F.round(c, 6).alias(c) for c in ("weekly", "annual_hours", "tax_hours")))


def per_user(spark, sf_dir):
    """Each user's instances, median duration and hours at the cluster's weekly rate."""
    found = written(runs(spark, sf_dir), "runs")
    rate = S.effort(found).select("cluster_id", "weekly")
    counts = found.groupBy("cluster_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    users = counts.join(medians(found, ["cluster_id", "user_id"], "duration_ms", "median"), ["cluster_id", "user_id"]).withColumn("median_ms", F.col("median").cast("long"))
    hours = F.col("median_ms") / 3_600_000.0 * F.greatest(F.col("weekly"), F.lit(0.01)) * C.WORK_WEEKS
    return users.join(rate, "cluster_id").select("cluster_id", "user_id", "n", "median_ms", F.round(hours, 6).alias("hours"))


def cluster_scores(spark, sf_dir):
    """All scores of each cluster: automatability, potential, effort, confidence and evidence."""
    found = written(runs(spark, sf_dir), "runs")
    main = _representatives(found)
    steps = main.select("cluster_id", F.size("signature").alias("steps"), F.size(F.array_distinct("signature")).alias("apps"))
    variants = found.groupBy("cluster_id", "signature_hash").agg(F.first("signature").alias("signature"), F.count(F.lit(1)).alias("n"))
    alike = P.cluster_similarity(variants, main, F.array_join("signature", ""))
    busy = found.groupBy("cluster_id").agg((F.sum("duration_ms") / 60_000.0).alias("minutes"))
    parts = [S.step_entropy(found), S.parameter_spread(_values(spark, sf_dir)), S.branch_count(found, main), S.effort(found).select("cluster_id", "annual_hours", "tax_hours", "users"), steps, alike, busy]
    table_ = parts[0]
    for other in parts[1:]:
        table_ = table_.join(other, "cluster_id")
    # orders carry no text, so nothing speaks for judgement
    similarity, judgement = F.col("similarity"), P.judgement(F.lit(0.0))
    scored = table_.withColumns({
        "automatability": S.automatability(F.col("entropy"), F.col("spread"), F.col("branches"), F.col("steps"), judgement),
        "build_effort": S.build_effort(F.col("steps"), F.col("branches")),
        "potential": S.potential(similarity, F.col("n_instances"), F.col("minutes"), F.col("spread"), F.col("apps"), judgement, F.col("branches"), F.col("steps")),
    })
    scored = scored.withColumn("confidence", S.confidence(F.col("n_instances"), similarity, F.col("automatability")))
    return scored.select(
        "cluster_id", F.round("similarity", 9).alias("similarity"), "build_effort", "potential", "confidence", S.evidence(F.col("n_instances"), similarity, F.col("confidence")).alias("evidence"),
        F.round("automatability", 6).alias("automatability"),
        F.round((F.col("annual_hours") + F.col("tax_hours")) * F.col("automatability") / F.col("build_effort"), 4).alias("priority"),
        (F.col("automatability") < C.DO_NOT_AUTOMATE).alias("do_not_automate"), (F.col("users") > C.ORGANISATION_USERS).alias("organisational"),
    )


def variables_constants(spark, sf_dir):
    """Inputs and constants among the fields of each cluster's steps."""
    totals = runs(spark, sf_dir).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("runs"))
    steps = _payloads(spark, sf_dir).select("cluster_id", "instance_id", "token", F.map_keys(F.map_filter("fields", lambda _, v: v.isNotNull())).alias("keys"))
    found = S.variables_and_constants(_values(spark, sf_dir), totals, present=S.presence(steps))
    return found.select("cluster_id", "token", "key", "kind", "n_distinct", "present", F.when(F.col("kind") == "constant", F.col("least_value")).alias("value"))


def observed_fields(spark, sf_dir):
    """Sorted payload keys of each step token."""
    return _values(spark, sf_dir).groupBy("cluster_id", "token").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("fields"))


def _variants(spark, sf_dir):
    return K.variants(runs(spark, sf_dir))


def similarity_pairs(spark, sf_dir):
    """Sequence and set similarity of all pairs of variants."""
    pairs = K.similarity_pairs(_variants(spark, sf_dir))
    return pairs.select("a", "b", F.round("sequence", 9).alias("sequence"), F.round("jaccard", 9).alias("jaccard"))


def tfidf_cosine_pairs(spark, sf_dir):
    """TF-IDF cosine of variant texts over character n-grams."""
    pairs = K.cosine_pairs(K.tfidf(_variants(spark, sf_dir)))
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine"))


def embedding_cosine_topk(spark, sf_dir):
    """For every vector whose id is divisible by 20 the ten others nearest to it by cosine."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return nearest(vectors.where("vec_id % 20 = 0"), vectors, 10)


def near_variants(spark, sf_dir):
    """Combined similarity of all pairs of variants that could merge by it."""
    found = written(_variants(spark, sf_dir), "variants")
    pairs = K.near_pairs(found, written(K.tfidf(found), "vectors"))
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


def fuzzy_clusters(spark, sf_dir):
    """Variants with their fuzzy cluster and whether they are its medoid."""
    found = written(_variants(spark, sf_dir), "variants")
    placed, pairs = K.clustered(found)
    placed = written(placed, "placed")
    best = K.medoids(found, pairs, placed).select("signature_hash", F.lit(True).alias("medoid"))
    return placed.join(found, "signature_hash").join(best, "signature_hash", "left").select("signature_hash", "cluster_id", "n", F.coalesce("medoid", F.lit(False)).alias("medoid"))


QUERIES = {f.__name__: f for f in (hash_buckets, variant_shares, step_entropy, parameter_spread, free_text_ratio, branch_count, step_graph, effort, per_user, cluster_scores, variables_constants, observed_fields, similarity_pairs, tfidf_cosine_pairs, near_variants, embedding_cosine_topk, fuzzy_clusters)}

_BASE = f"""{sql.ORDERS}, found as (
        select k.*, o.o_orderpriority as cluster_id, len(raw_signature) - len(signature) as context_switches from keyed k join orders o on o.o_orderkey = k.instance_id
    )"""
_ENTROPY = """counts as (select cluster_id, signature_hash, count(*) as n from found group by 1, 2),
    shares as (select *, n / sum(n) over (partition by cluster_id) as share from counts),
    ent as (select cluster_id, sum(n)::bigint as n_instances, count(*) as n_variants, case when count(*) > 1 then -sum(share * log2(share)) / log2(count(*)) else 0.0 end as entropy,
                   max(share) as dominant_share from shares group by 1)"""
_VALUES = """vals as (
        select o_orderpriority as cluster_id, instance_id, token, key, value from (
            select *, unnest(['quantity', 'discount', 'status', 'part', 'currency']) as key,
                   unnest([l_quantity::bigint::varchar, printf('%.2f', l_discount), l_linestatus, case when l_partkey % 3 = 0 then l_partkey::varchar end, 'USD']) as value
            from lines) where value is not null)"""
_SPREAD = """spr as (select cluster_id, avg((d - 1) / (n - 1)) as spread from (select cluster_id, key, count(value) as n, count(distinct value) as d from vals group by 1, 2) where n >= 2 group by 1)"""
_MAIN = """mains as (select cluster_id, arg_min(signature, (-n, signature_hash)) as main from (select cluster_id, signature_hash, count(*) as n, any_value(signature) as signature from found group by 1, 2) group by 1)"""
_BRANCH = """br as (select cluster_id, count(*) filter (where tokens > 1) as branches from (
        select cluster_id, pos, count(distinct token) as tokens from (
            select f.cluster_id, unnest(list_filter(signature, lambda t: list_contains(main, t))) as token, generate_subscripts(list_filter(signature, lambda t: list_contains(main, t)), 1) as pos
            from found f join mains using (cluster_id)) group by 1, 2) group by 1)"""
_EFFORT = """eff0 as (select cluster_id, count(*) as n, count(distinct user_id) as users, trunc(quantile_cont(duration_ms, 0.5))::bigint as median_ms,
               greatest((max(started_ms) - min(started_ms)) // 86400000, 1) as days, sum(context_switches) as switches from found group by 1),
    eff1 as (select *, n / users / (days / 7.0) as weekly from eff0),
    eff as (select *, median_ms / 3600000.0 * weekly * 48 * users as annual_hours, switches / n * weekly * 48 * users * 4.0 / 60.0 as tax_hours from eff1)"""
_GRAMS = """vars as (select signature_hash, array_to_string(any_value(signature), ' ') as text from found group by 1),
    words as (select signature_hash, ' ' || unnest(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) || ' ' as word from vars),
    sizes as (select *, unnest(range(3, least(5, length(word)) + 1)) as n from words),
    grams as (select signature_hash, gram, count(*) as tf from (select signature_hash, substr(word, i, n) as gram from (select *, unnest(range(1, length(word) - n + 2)) as i from sizes)) group by 1, 2),
    weighted as (select g.*, tf * (ln((1 + (select count(*) from vars)) / (1 + df)) + 1) as w from grams g join (select gram, count(*) as df from grams group by 1) using (gram)),
    unit as (select *, w / sqrt(sum(w * w) over (partition by signature_hash)) as x from weighted)"""

ORACLES = {
    "hash_buckets": f"with {sql.ORDERS} select signature_hash, count(*) as n, count(distinct user_id) as users, any_value(variant) as variant from keyed group by 1 having count(*) >= 2 and any_value(len(signature)) >= 3",
    "variant_shares": f"""with {_BASE}, {_ENTROPY} select cluster_id, signature_hash, n, round(share, 4) as share, rank from (
        select *, row_number() over (partition by cluster_id order by n desc, signature_hash) as rank from shares) where rank <= 8""",
    "step_entropy": f"with {_BASE}, {_ENTROPY} select cluster_id, n_instances, n_variants, round(entropy, 9) as entropy, round(dominant_share, 9) as dominant_share from ent",
    "parameter_spread": f"with {sql.LINES}, {_VALUES}, {_SPREAD} select cluster_id, round(spread, 9) as spread from spr",
    "free_text_ratio": "select role as action, round(avg(coalesce(length(text) > 40, false)::int), 9) as ratio, count(*) as n from conversations group by 1",
    "branch_count": f"with {_BASE}, {_MAIN}, {_BRANCH} select * from br",
    "step_graph": f"""with {_BASE}, {_MAIN}, m as (select cluster_id, unnest(main) as token, generate_subscripts(main, 1) - 1 as pos from mains),
        s as (select cluster_id, unnest(signature) as other, generate_subscripts(signature, 1) - 1 as pos from found)
        select m.cluster_id, m.pos, token, array_to_string((list_sort(list_distinct(list(other) filter (where other <> token))))[:5], ',') as alternatives
        from m join s using (cluster_id, pos) group by m.cluster_id, m.pos, token""",
    "effort": f"with {_BASE}, {_EFFORT} select cluster_id, n, users, median_ms, round(weekly, 6) as weekly, round(annual_hours, 6) as annual_hours, round(tax_hours, 6) as tax_hours from eff",
    "per_user": f"""with {_BASE}, {_EFFORT}, u as (select cluster_id, user_id, count(*) as n, trunc(quantile_cont(duration_ms, 0.5))::bigint as median_ms from found group by 1, 2)
        select u.cluster_id, user_id, u.n, u.median_ms, round(u.median_ms / 3600000.0 * greatest(weekly, 0.01) * 48, 6) as hours from u join eff using (cluster_id)""",
    "cluster_scores": f"""with {_BASE}, {_ENTROPY}, {_VALUES}, {_SPREAD}, {_MAIN}, {_BRANCH}, {_EFFORT},
        jud as (select cluster_id, 0.0 as judgement, sum(duration_ms) / 60000.0 as minutes, avg(1 - levenshtein(array_to_string(signature, ''), array_to_string(main, '')) / greatest(len(signature), len(main))) as similarity from found join mains using (cluster_id) group by 1),
        a as (select *, len(main) as steps from ent join spr using (cluster_id) join br using (cluster_id) join (select cluster_id, annual_hours, tax_hours, users from eff) using (cluster_id) join mains using (cluster_id) join jud using (cluster_id)),
        b as (select *, greatest(0, least(1, 1 - (0.35 * entropy + 0.20 * spread + 0.20 * least(1.0, branches / greatest(steps, 1)) + 0.25 * judgement))) as auto,
                     greatest(1, least(5, 1 + steps // 3 + case when branches > 2 then 1 else 0 end)) as build_effort,
                     round_even(greatest(0, least(100, (least(1, greatest(0, similarity)) * 0.30 + least(1.0, n_instances / 20.0) * 0.25 + least(1.0, minutes / 120.0) * 0.20 + least(1, greatest(0, 1 - spread)) * 0.15 + least(1.0, len(list_distinct(main)) / 4.0) * 0.10) * 100
                         - least(25.0, judgement * 40) - least(15.0, branches / greatest(steps, 1) * 15) * (1 - least(1.0, similarity)))), 0)::bigint as potential from a),
        c as (select *, round(greatest(0, least(1, 0.25 * least(1.0, n_instances / 5) + 0.40 * similarity + 0.35 * auto)), 3) as confidence from b)
        select cluster_id, round(similarity, 9) as similarity, build_effort, potential, confidence,
               case when n_instances >= 5 and similarity >= 0.85 and confidence >= 0.75 then 'strong' when n_instances >= 5 or (n_instances >= 2 and similarity >= 0.85) then 'moderate' else 'early' end as evidence,
               round(auto, 6) as automatability, round((annual_hours + tax_hours) * auto / build_effort, 4) as priority, auto < 0.4 as do_not_automate, users > 3 as organisational from c""",
    "variables_constants": f"""with {_BASE}, {_VALUES}, r as (select cluster_id, count(*) as runs from found group by 1),
        f as (select cluster_id, token, key, count(value) as n_values, count(distinct value) as n_distinct, count(distinct instance_id) as present, min(value) as low from vals group by 1, 2, 3)
        select cluster_id, token, key, case when n_distinct = 1 then 'constant' else 'variable' end as kind, n_distinct, present, case when n_distinct = 1 then low end as value
        from f join r using (cluster_id) where present >= runs * 0.6 and (n_distinct = 1 or n_distinct >= n_values * 0.6)""",
    "observed_fields": f"with {sql.LINES}, {_VALUES} select cluster_id, token, string_agg(distinct key, ',' order by key) as fields from vals group by 1, 2",
    "similarity_pairs": f"""with {sql.ORDERS}, v as (select distinct signature_hash, signature, array_to_string(signature, '') as code from keyed)
        select x.signature_hash as a, y.signature_hash as b, round(1 - levenshtein(x.code, y.code) / greatest(length(x.code), length(y.code)), 9) as sequence,
               round(len(list_intersect(x.signature, y.signature)) / len(list_distinct(list_concat(x.signature, y.signature))), 9) as jaccard
        from v x join v y on x.signature_hash < y.signature_hash""",
    "tfidf_cosine_pairs": f"""with {_BASE}, {_GRAMS} select a.signature_hash as a, b.signature_hash as b, round(sum(a.x * b.x), 6) as cosine
        from unit a join unit b on a.gram = b.gram and a.signature_hash < b.signature_hash group by 1, 2""",
    "near_variants": f"""with {_BASE}, {_GRAMS}, v as (select signature_hash, any_value(signature) as signature, any_value(array_to_string(signature, '')) as code from keyed group by 1),
        cos as (select a.signature_hash as a, b.signature_hash as b, sum(a.x * b.x) as cosine from unit a join unit b on a.gram = b.gram and a.signature_hash < b.signature_hash group by 1, 2),
        p as (select x.signature_hash as a, y.signature_hash as b, 1 - levenshtein(x.code, y.code) / greatest(length(x.code), length(y.code)) as seq,
                     len(list_intersect(x.signature, y.signature)) / len(list_distinct(list_concat(x.signature, y.signature))) as jac from v x join v y on x.signature_hash < y.signature_hash)
        select a, b, round(similarity, 6) as similarity from (select a, b, 0.45 * seq + 0.30 * jac + 0.25 * greatest(0.0, least(1.0, coalesce(cosine, 0))) as similarity from p left join cos using (a, b)) where 1 - similarity < 0.65""",
    "embedding_cosine_topk": """select query_id, vec_id, label, cosine, rank from (
        select q.vec_id as query_id, v.vec_id, v.label, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 5) as cosine,
               row_number() over (partition by q.vec_id order by round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 5) desc, v.vec_id) as rank
        from embeddings q join embeddings v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id) where rank <= 10""",
}

"""Requests, answers, soft labels, donors, mixtures and batches on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import lenient, passages as G, rubrics as B, text as X
from verdigris.functions.hashing import stable_order
from verdigris.operators import assembly, distractors, records, validation
from verdigris.plans.evaluation_queries import ABC, predictions, preds_sql
from verdigris.plans.registry import query, table
from verdigris.storage import spread


@query(
    """with s as (select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') s from documents), c as (select doc_id, rtrim(left(s, 24), '_') c from s)
select doc_id, case when c = '' then 'option' else c end slug from c"""
)
def option_slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.slug(F.col("text"), 24).alias("slug"))


@query("select conv_id, turn, coalesce(regexp_matches(lower(text), '\\b(?:cannot|can''t|could not|not (?:enough|sufficient|clear|stated|given|shown|specified)|unclear|unknown|insufficient|impossible to (?:tell|say|know)|no way to)\\b'), false) hedged, ceil(length(coalesce(text, '')) / 3.2)::int tokens from conversations")
def hedges_and_estimates(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.hedged(F.col("text")).alias("hedged"), X.token_estimate(F.col("text")).alias("tokens"))


@query("select event_type, sha256(json_object('event_type', event_type, 'user', user_id)::varchar) digest, count(*) n from events group by all")
def canonical_digests(spark, sf_dir):
    """Digest of JSON text with its keys sorted, whatever order they come in."""
    raw = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "event_type": "'), F.col("event_type"), F.lit('"}'))
    rows = table(spark, sf_dir, "events").select("event_type", X.canonical_digest(raw).alias("digest"))
    return rows.groupBy("event_type", "digest").agg(F.count("*").alias("n"))


@query(
    "with m as (select event_id, event_type, user_id, value, unnest(range(3)) k, unnest(['low', 'mid', 'high']) l from events) select event_id, 'band' \"name\", k::int as \"at\", l \"label\", 'boolean' \"type\" from m "
    "union all select event_id, 'kind', 0, null, 'choice' from events union all select event_id, 'level', 0, null, 'ordinal' from events"
)
def request_compile(spark, sf_dir):
    """Three questions a request: a multi question that fans out to a field a criterion, a choice and a score."""
    q = lambda kind, criteria="cast(null as array<string>)": f"struct('{kind}' as kind, 'which?' as question, {criteria} as criteria)"
    bands = q("multi", "array('low', 'mid', 'high')")
    asked = F.expr(f"map('band', {bands}, 'kind', {q('choice')}, 'level', {q('score')})")
    rows = table(spark, sf_dir, "events").select("event_id", asked.alias("questions"))
    return records.compile_request(rows, "event_id", "questions").select("event_id", "name", "at", "label", "type")


@query(
    "with " + preds_sql() + ", x as (select vec_id, unnest(p[1:4]) v, unnest(range(4)) k from preds) select vec_id, coalesce(string_agg('l' || k, ',' order by k) filter (v > 0.1 + 1e-9 and not (vec_id % 5 = 0)), '') selected, vec_id % 5 = 0 abstained from x group by vec_id"
)
def multi_fold(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("vec_id", F.posexplode(F.slice("p", 1, 4)).alias("at", "p"))
    answers = rows.select("vec_id", F.lit("q").alias("name"), "at", F.concat(F.lit("l"), F.col("at").cast("string")).alias("label"), "p", (F.col("vec_id") % 5 == 0).alias("abstained"))
    return records.fold_multi(answers, "vec_id", 0.1).select("vec_id", F.array_join("selected", ",").alias("selected"), "abstained")


@query("with " + preds_sql() + ", s as (select vec_id, p[2:4] q from preds), t as (select vec_id, q, list_sum(q) t from s) select vec_id, round(q[1] / t, 6) k1, round(q[2] / t, 6) k2, round(q[3] / t, 6) k3 from t")
def projected_probabilities(spark, sf_dir):
    keys = F.array(*[F.lit(f"k{i}") for i in range(10)])
    rows = predictions(spark, sf_dir).select("vec_id", F.map_from_arrays(keys, F.col("p")).alias("probs"), F.array(F.lit("k1"), F.lit("k2"), F.lit("k3")).alias("labels"))
    out = records.project_probabilities(rows, "vec_id", "probs", "labels")
    return out.select("vec_id", *[F.round(F.col("p")[k], 6).alias(k) for k in ("k1", "k2", "k3")])


@query(
    """with e as (select user_id doc_id, event_id, value, event_type <> 'view' ok from events), b as (select doc_id, arg_max(value, (ok::int, event_id)) v, bool_or(ok) has from e group by doc_id)
select d.doc_id, case when has then round(v, 6) end value from documents d left join b using (doc_id)"""
)
def soft_label_attach(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", "value", "event_type")
    out = records.attach_soft_labels(table(spark, sf_dir, "documents").select("doc_id"), rows, "doc_id", F.col("event_type") != "view", "event_id", ["value"])
    return out.withColumn("value", F.round("value", 6))


@query("select user_id, event_id, case event_type when 'purchase' then 0 when 'click' then 1 else 2 end::int src from events qualify row_number() over (partition by user_id order by src, event_id) = 1")
def first_source_wins(spark, sf_dir):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return records.first_source_wins(table(spark, sf_dir, "events").select("user_id", "event_id", rank.alias("src")), "user_id", "src", "event_id")


@query(
    """with o as (select doc_id, row_number() over (order by sha256(doc_id::varchar), doc_id) - 1 i, count(*) over () n, ('0x' || sha256('donor' || chr(0) || doc_id)[1:12])::bigint h from documents)
select a.doc_id, b.doc_id donor_doc_id from o a join o b on b.i = (a.i + 1 + a.h % (a.n - 1)) % a.n"""
)
def donor_lookup(spark, sf_dir):
    return records.donors(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", stable_order(F.col("doc_id")), ["doc_id"])


@query("select doc_id from documents where doc_id not in (select doc_id from labels) and source not in ('src1', 'src2')")
def exclusions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("k", F.col("doc_id").cast("string"))
    gone = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key")).unionAll(spark.sql("select explode(array('src1', 'src2')) as key"))
    return records.without_keys(docs, ["k", "source"], gone).select("doc_id")


@query(
    "with p as (select vec_id // 3 g, max(case when vec_id % 3 = 0 then (label % 2 = 0)::int end) base, max(case when vec_id % 3 = 1 then (label % 2 = 0)::int end) flip, max(case when vec_id % 3 = 2 then (label % 2 = 0)::int end) invariant from embeddings group by 1) select * from p where base is not null and flip is not null and invariant is not null"
)
def intervention_triplets(spark, sf_dir):
    role = F.element_at(F.array(F.lit("base"), F.lit("flip"), F.lit("invariant")), (F.col("vec_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 3").alias("g"), role.alias("role"), (F.col("label") % 2 == 0).cast("int").alias("ok"))
    return records.triplets(rows, "g", "role", "ok")


@query("with c as (select unnest(['full', 'no_image', 'no_state']) condition), x as (select p.page_id, c.condition, case when c.condition <> 'no_image' then p.url end u, case when c.condition <> 'no_state' then p.html end h from pages p, c) select condition, count(*) n, count(u) images, count(h) states from x group by condition")
def ablation_conditions(spark, sf_dir):
    out = records.ablations(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "url", "html")
    return out.groupBy("condition").agg(F.count("*").alias("n"), F.count("url").alias("images"), F.count("html").alias("states"))


PARTS = "d as (select doc_id, source || lang g, case ('0x' || sha256('p' || chr(0) || doc_id)[1:8])::bigint % 40 when 0 then 'test' when 1 then 'dev' when 2 then 'dev' else 'train' end p from documents), s as (select g, list_sort(list(distinct p)) l from d group by g)"


@query(f"with {PARTS} select doc_id, case when len(l) > 1 and not list_contains(l, 'test') and p = 'dev' then 'train' else p end \"partition\", case when len(l) = 1 then 'kept' when list_contains(l, 'test') then 'dropped' when p = 'dev' then 'moved' else 'kept' end \"action\" from d join s using (g)")
def partition_repair(spark, sf_dir):
    from verdigris.functions.hashing import hex_prefix

    b = hex_prefix(stable_order("p", F.col("doc_id")), 8) % 40
    part = F.when(b == 0, "test").when(b.isin(1, 2), "dev").otherwise("train")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", "lang").alias("g"), part.alias("p"))
    return assembly.repair_partitions(rows, "doc_id", "g", "p")


@query("with c as (select distinct conv_id from conversations), n as (select floor(count(*) * 0.2 + 0.5) n from c) select conv_id from c order by sha256('audit' || chr(0) || conv_id) limit (select n::bigint from n)")
def audit_sample(spark, sf_dir):
    """A fifth of the clusters, whole, for a second look."""
    return assembly.audit_sample(table(spark, sf_dir, "conversations"), "conv_id", 0.2, "audit")


@query(
    """with r as (select source, toxic = 1 d, doc_id % 3 = 0 r, quality = 0 w from documents join labels using (doc_id)), g as (select source, count(*) n, count_if(d) d, count_if(d and r) r, count_if(d and r and w) w from r group by source),
q as (select source, n, d, case when r >= 2 then w / r else (select sum(w) / sum(r) from g) end p from g) select source, n, round(p, 6) "precision", round((d * p + (n - d) * 0.02) / n, 6) error_rate from q"""
)
def review_error_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("source", (F.col("toxic") == 1).alias("d"), (F.col("doc_id") % 3 == 0).alias("r"), (F.col("quality") == 0).alias("w"))
    return assembly.review_error(rows, "source", "d", "r", "w", 2, 0.02).withColumns({c: F.round(c, 6) for c in ("precision", "error_rate")})


@query(
    ABC
    + """, s as (select track "step", avg(correct::int) a from a group by 1), t as (select track "step", avg(correct::int) b from b group by 1), m as (select "step", (a + b) / 2 m, sqrt(a * (1 - a) / 100 + b * (1 - b) / 100) / 2 se from s join t using ("step")),
best as (select arg_max(m, (m, "step")) bm, arg_max(se, (m, "step")) bs from m) select max("step") "step", round(arg_max(m, "step"), 6) "mean" from m, best where m >= bm - sqrt(2.0) * bs"""
)
def checkpoint_selection(spark, sf_dir):
    a = predictions(spark, sf_dir, 0).groupBy(F.col("track").alias("step")).agg(F.avg(F.col("correct").cast("double")).alias("a"))
    b = predictions(spark, sf_dir, 10).groupBy(F.col("track").alias("step")).agg(F.avg(F.col("correct").cast("double")).alias("b"))
    return assembly.select_checkpoint(a.join(b, "step"), "step", "a", "b", 100, 100).withColumn("mean", F.round("mean", 6))


@query("with s as (select source, count(*) seen from documents group by source), e(source, expected) as (values ('src0', 50), ('src1', 50), ('gone', 5)) select source, expected, coalesce(seen, 0) seen, coalesce(expected = seen, false) complete from e full join s using (source)")
def completeness(spark, sf_dir):
    expected = spark.sql("select * from values ('src0', 50L), ('src1', 50L), ('gone', 5L) as t(source, expected)")
    return assembly.completeness(table(spark, sf_dir, "documents").select("source"), expected, "source")


@query(
    """with j as (select d.doc_id, d.source, l.quality q, d.doc_id % 4 = 0 t from documents d join labels l using (doc_id)), c as (select source, q, count(*) c from j where not t and q is not null group by all),
p as (select source, arg_max(q, (c, q)) g from c group by source) select count(*) n, count(g) known, round(avg(coalesce((g = q)::int, 0)), 6) accuracy from (select * from j where t) left join p using (source)"""
)
def blind_prior(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    out = assembly.blind_prior(j.where("doc_id % 4 <> 0"), j.where("doc_id % 4 = 0"), "source", "quality")
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query(
    """with s as (select lang, count(*) n from documents where lang in ('en', 'de') group by lang), t as (select min(n / (case lang when 'en' then 0.7 else 0.3 end)) t from s), q as (select lang, floor(t * (case lang when 'en' then 0.7 else 0.3 end) + 1e-9)::bigint take from s, t),
r as (select doc_id, lang, row_number() over (partition by lang order by (source = 'src0') desc, sha256('mix' || chr(0) || doc_id)) r from documents) select doc_id, lang from r join q using (lang) where r <= take"""
)
def mixture_build(spark, sf_dir):
    return assembly.mixture(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", {"en": 0.7, "de": 0.3}, F.col("source") == "src0", "mix").select("doc_id", "lang")


@query(
    """with d as (select source || ':' || (doc_id % 40) g, lang, sha256(text) k from documents), gr as (select g, min(lang) family, count(*) n from d group by g), h as (select distinct g, k from d),
l as (select distinct x.g a, y.g b from h x join h y on x.k = y.k and x.g <> y.g), c as (select a g, sum(n) cost from l join gr on gr.g = l.b group by a),
p as (select gr.*, coalesce(cost, 0) cost, case family when 'en' then 60 when 'de' then 40 else 0 end want from gr left join c using (g) where coalesce(cost, 0) <= 60),
o as (select *, coalesce(sum(n) over (partition by family order by cost, sha256('held-out' || chr(0) || g) rows between unbounded preceding and 1 preceding), 0) before from p),
held as (select g from o where before < want)
select g "group", case when g in (select g from held) then 'held_out' when g in (select b from l join held on held.g = l.a) then 'removed' else 'kept' end state from gr"""
)
def held_out_resolution(spark, sf_dir):
    """Parts of sources as groups, linked where they share a text; 60 English and 40 German documents are held out, about."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", (F.col("doc_id") % 40).cast("string")).alias("group"), "lang", F.sha2("text", 256).alias("k"))
    groups = docs.groupBy("group").agg(F.min("lang").alias("family"), F.count("*").alias("rows"))
    holders = docs.select("group", "k").distinct()
    links = holders.join(holders.withColumnRenamed("group", "b"), "k").where("group < b").select(F.col("group").alias("a"), "b").distinct()
    return assembly.resolve_held_out(groups, links, {"en": 60, "de": 40}, 60)


@query(
    """with recursive r as (select doc_id, ceil(length(coalesce(text, '')) / 3.2)::int tokens from documents), n as (select greatest(1, ceil(count(*) / 4096.0))::bigint n from r),
d as (select doc_id, tokens, (('0x' || sha256(doc_id::varchar)[1:15])::bigint % n)::int chunk from r, n), o as (select *, row_number() over (partition by chunk order by tokens, doc_id) k from d),
b(chunk, k, doc_id, batch, size) as (select chunk, k, doc_id, 0, 1 from o where k = 1 union all
  select o.chunk, o.k, o.doc_id, case when (b.size + 1) * o.tokens > 8192 then b.batch + 1 else b.batch end, case when (b.size + 1) * o.tokens > 8192 then 1 else b.size + 1 end from b join o on o.chunk = b.chunk and o.k = b.k + 1)
select doc_id, chunk, batch from b"""
)
def batch_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))
    return assembly.batch_plan(rows, "doc_id", "tokens", 8192)




@query(
    """select p_partkey, (case when p_size >= 10 then 2 else 0 end + case when p_retailprice >= 1000 then 1 else 0 end + case when p_brand = 'Brand#11' then 3 else 0 end)::int points,
((p_size >= 10)::int + (p_size >= 20)::int + (p_size >= 40)::int)::int band, case when p_size >= 5 then case when p_retailprice >= 1000 then case when p_size >= 25 then 3 else 2 end else 1 end else 0 end::int ladder,
round((p_size * 2 + p_retailprice / 100 * 1) / 3, 6) weighted, case when p_size < 25 then case when p_retailprice < 1000 then 0 else 1 end else case when p_retailprice < 1000 then 1 else 3 end end::int cell from part"""
)
def ordinal_rubrics(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        B.points((size >= 10, 2), (price >= 1000, 1), (F.col("p_brand") == "Brand#11", 3)).alias("points"),
        B.banded(size, [10, 20, 40]).alias("band"),
        B.ladder(size >= 5, price >= 1000, size >= 25).alias("ladder"),
        F.round(B.weighted((size, 2.0), (price / 100, 1.0)), 6).alias("weighted"),
        B.matrix((size >= 25).cast("int"), (price >= 1000).cast("int"), [[0, 1], [1, 3]]).alias("cell"),
    )


@query("with w as (select user_id, event_type in ('purchase', 'click') a from events) select user_id, count(*) worlds, case when count(distinct a) = 1 then min(a) end answer from w group by user_id")
def certain_answers(spark, sf_dir):
    """A user's rows stand for completions of what is withheld."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").isin("purchase", "click").alias("a"))
    return records.certain_answers(rows, "user_id", "a")


@query("with t(k, v) as (values ('conv:1', 'a'), ('conv', 'b')), x as (select distinct 'conv:' || conv_id % 3 id from conversations) select id, coalesce(t.v, case when true then (select v from t where k = 'conv') end) domain from x left join t on t.k = x.id")
def domain_attach(spark, sf_dir):
    told = spark.sql("select * from values ('conv:1', 'a'), ('conv', 'b') as t(k, domain)")
    ids = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv:"), (F.col("conv_id") % 3).cast("string")).alias("id")).distinct()
    return records.attach_with_fallback(ids, told, "id", "k", "domain")


@query("select distinct r_name \"start\", c_mktsegment node from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey")
def multihop_walk(spark, sf_dir):
    n, c, r = (table(spark, sf_dir, t) for t in ("nation", "customer", "region"))
    edge = lambda df, a, rel, b: df.select(F.col(a).cast("string").alias("source"), F.lit(rel).alias("relation"), F.col(b).cast("string").alias("target"))
    named = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    edges = edge(named, "r_name", "has", "n_nationkey").unionAll(edge(c, "c_nationkey", "buys", "c_mktsegment"))
    return records.walk(edges, r.select(F.col("r_name").alias("node")), ["has", "buys"])


@query(
    "with u as (select doc_id, ('0x' || sha256('mix' || chr(0) || doc_id)[1:12])::bigint / 281474976710656.0 u from documents) select doc_id, case when u < 0.2 then 'object' when u < 0.3 then 'other_option' else 'plain' end variant from u"
)
def presentation_mix(spark, sf_dir):
    return records.presentation_mix(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", [("object", 0.2), ("other_option", 0.1)], "mix")


@query(
    "with o as (select vec_id, unnest(['a', 'b', 'c', 'd']) x, unnest(range(4)) i from embeddings) select vec_id, string_agg(x, '' order by sha256(vec_id || chr(0) || i)) options from o group by vec_id"
)
def option_permutation(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(records.permuted(F.array(*map(F.lit, "abcd")), F.col("vec_id")), "").alias("options"))


@query(
    """with x as (select conv_id, turn, case turn % 4 when 0 then 'yes' when 1 then ' NO ' when 2 then 'maybe' end a, turn % 4 k from conversations)
select conv_id, turn, case when k = 3 then 'unparsed' when k = 2 then 'out_of_domain' else 'ok' end status, case when k < 2 then lower(trim(a)) end answer, case when k < 2 then 1.0::double end confidence from x"""
)
def reply_parse(spark, sf_dir):
    """Replies with an object amid prose, with odd case and space, outside the domain, and without an object."""
    k = F.col("turn") % 4
    said = F.when(k == 0, "yes").when(k == 1, " NO ").otherwise("maybe")
    text = F.when(k == 3, "no object here {").otherwise(F.concat(F.lit('Well: {"answer": "'), said, F.lit('", "confidence": 1.5} so.')))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", records.parse_reply(text, F.array(F.lit("yes"), F.lit("no"))).alias("r"))
    return rows.select("conv_id", "turn", "r.status", "r.answer", "r.confidence")


@query("with l as (select user_id, value, row_number() over (partition by user_id order by event_id desc) r from events) select user_id, count(*) entries, round(avg(value), 6) \"mean\" from l where r <= 2 group by user_id")
def last_two_mean(spark, sf_dir):
    return assembly.last_mean(table(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("mean", F.round("mean", 6))


@query(
    "with k as (select doc_id, sha256(coalesce(text, '')) h, lang, n_chars from documents), f as (select h, min(doc_id) m from k group by h) "
    "select doc_id, case when n_chars < 150 then 'short' when lang not in ('en', 'de') then 'language' when doc_id <> m then 'near_duplicate' when doc_id in (select doc_id from labels where toxic = 1) then 'contaminated' else 'kept' end reason from k join f using (h)"
)
def teacher_records(spark, sf_dir):
    from verdigris.operators.similarity import first_of

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    later = docs.join(first_of(docs.select("doc_id", "h"), ["h"], [F.col("doc_id")]), "doc_id", "left_anti")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return assembly.teacher_records(docs, "doc_id", [("short", F.col("n_chars") < 150), ("language", ~F.col("lang").isin("en", "de"))], later, toxic)


@query("select lane, count(*) n from (select unnest(list_filter([case when label + 2 <= 4 then 'narrow' end, case when label + 2 <= 8 then 'wide' end, 'all'], lambda x: x is not null)) lane from embeddings) group by lane")
def lane_derivation(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") + 2).alias("options"))
    return assembly.lanes(rows, "options", {"narrow": 4, "wide": 8, "all": 99}).groupBy("lane").agg(F.count("*").alias("n"))


@query("select doc_id from documents where source in ('src1', 'src3', 'src5', 'src7', 'src9', 'src11', 'src13', 'src15', 'src17', 'src19')")
def licence_filter(spark, sf_dir):
    receipts = spark.sql("select concat('src', id) source, if(id % 2 = 1, 'CC-BY-4.0', 'unknown') licence from range(20)")
    return assembly.allowed(table(spark, sf_dir, "documents").select("doc_id", "source"), receipts, "source", ["cc-by-4.0", "cc0-1.0"]).select("doc_id")


@query(
    """with d as (select distinct doc_id, trim(regexp_replace(lower(l), '\\s+', ' ', 'g')) l from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) l from documents)),
b as (select distinct trim(regexp_replace(lower(l), '\\s+', ' ', 'g')) l from (select unnest(string_split(coalesce(text, ''), chr(10))) l from benchmark)) select doc_id, count(*) hits from d where length(l) >= 20 and l in (select l from b) group by doc_id"""
)
def bundle_check(spark, sf_dir):
    return assembly.bundle_hits(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")


@query("with " + preds_sql(0, "a") + "," + preds_sql(10, "b") + ", u as (select 'a' model, track, family, correct from a union all select 'b', track, family, correct from b) select model, track, family, count(*) n, round(avg(correct::int), 6) accuracy from u group by grouping sets ((model), (model, track), (model, track, family))")
def evaluation_summary(spark, sf_dir):
    rows = [predictions(spark, sf_dir, at).select(F.lit(m).alias("model"), "track", "family", "correct") for m, at in (("a", 0), ("b", 10))]
    return assembly.evaluation_summary(rows[0].unionAll(rows[1]), "model", "track", "family", "correct").withColumn("accuracy", F.round("accuracy", 6))


LENIENT_SQL = """with s as (select p_partkey, p_name n, p_brand b, p_size z, p_partkey % 5 k from part)
select p_partkey, case k when 1 then 'noul' when 2 then 'choice' else 'score' end kind,
  case k when 0 then n || '=' || n || ';' || b || '=' || b when 1 then 'a=' || n || ';b=' || b when 2 then n || '=' || b || ';' || b || '=' || b when 3 then z || '=' || z || ';true=true' end options,
  case k when 0 then '1=level 1;' || z || '=level ' || z when 1 then '3=low;7=high' when 2 then '4=' || b || ';1=t' when 3 then '2=level 2;3=level 3' end levels,
  case k when 0 then z::varchar when 1 then 'true' when 2 then n when 3 then 'soon' end intended, case k when 0 then 'see document' when 1 then b || ' 2' else n end justification from s"""


@query(LENIENT_SQL)
def lenient_shapes(spark, sf_dir):
    part = spread(table(spark, sf_dir, "part")).select("p_partkey", F.col("p_name").alias("n"), F.col("p_brand").alias("b"), F.col("p_size").cast("string").alias("z"))
    shapes = [
        '{"type": "score", "options": ["{n}", " {b} "], "levels": [1, "{z}", true, null], "intended": " {z} "}',
        '{"type": "noul", "options": {"b": "{b}", "a": "{n}"}, "levels": {"7": "high", "3": "low"}, "intended": "Yes", "justification": ["{b}", 2]}',
        '{"type": "choice", "options": [{"label": "{n}", "meaning": "{b}"}, {"text": "", "name": "{b}"}], "levels": [{"score": "4", "label": "{b}"}, {"value": "x", "text": "t"}], "intended": {"option": "{n}"}, "justification": "{n}"}',
        '{"type": "score", "options": [{z}, true], "levels": [false, "2", 3.7, "high"], "intended": "soon", "justification": "{n}"}',
        '{"type": "score", "options": 3, "justification": "{n}"}',
    ]
    shaped = F.get(F.array(*map(F.lit, shapes)), (F.col("p_partkey") % 5).cast("int"))
    for c in "nbz":
        shaped = F.replace(shaped, F.lit("{" + c + "}"), F.col(c))
    told = lenient.with_questions(part.select("p_partkey", F.concat(F.lit('{"questions": ['), shaped, F.lit("]}")).alias("t")), "t").select("p_partkey", F.get("questions", F.lit(0)).alias("q"))
    listed = lambda c, v: F.array_join(F.transform(c, lambda x: F.concat(x[v].cast("string"), F.lit("="), x["description"])), ";")
    return told.select("p_partkey", F.col("q.type").alias("kind"), listed(F.col("q.options"), "text").alias("options"), listed(F.col("q.levels"), "value").alias("levels"), "q.intended", "q.justification")


@query(
    """select p_partkey, case p_partkey % 10 when 1 then ['gold_domain'] when 2 then ['text_has_image'] when 3 then ['image_missing'] when 4 then ['request_id', 'flagged'] when 5 then ['two_reviews']
when 6 then ['json'] when 7 then ['withheld_gold'] when 8 then ['truth_gold'] when 9 then case when p_size > 30 then ['gold_domain'] else []::varchar[] end else []::varchar[] end problems from part"""
)
def record_rules(spark, sf_dir):
    """Records made of parts: a choice between a part's name and brand whose answer is the name, or its size on a scale to 30, each shape with faults of its own."""
    k, own = F.col("p_partkey") % 10, F.concat(F.lit('{"request_id": "'), F.col("p_partkey"), F.lit('", "fields": [{"id": "x", '))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    choice = text(own, '"type": "choice", "options": [{"value": "', F.col("p_name"), '"}, {"value": "', F.col("p_brand"), '"}]}]}')
    scale = text(own, '"type": "ordinal", "levels": [', F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda x: F.format_string('{"value": %d}', x)), ", "), "]}]}")
    gold = F.when(k == 1, F.lit('"none"')).when(k == 9, F.col("p_size").cast("string")).otherwise(text('"', F.col("p_name"), '"'))
    truth = F.when(k == 8, text('"', F.col("p_brand"), '"')).otherwise(gold)
    made = text('{"review_route": "construction_verified", "construction": {"truth_source": "programmatic", "truth": ', truth, ', "image_checks": "passed"}', F.when(k == 4, ', "quarantined": true').otherwise(""), "}")
    image = F.when(k == 2, '{"path": "a/b.png", "sha256": "' + "0" * 64 + '"}').otherwise("")
    record = text(
        '{"id": "', F.col("p_partkey"), F.when(k == 4, "x").otherwise(""), '", "track": "', F.when(k == 3, "joint").otherwise("text"), '", "split": "dev", "group_id": "', F.col("p_brand"), '", "annotation_status": "reviewed", "gold": ', gold,
        F.when(k == 7, ', "gold_withheld": true').otherwise(""), ', "images": [', image, '], "request": ', F.when(k == 9, scale).otherwise(choice), ', "provenance": ', F.when(k == 5, "{}").otherwise(made), F.when(k == 6, "").otherwise("}"),
    )
    return validation.validated(table(spark, sf_dir, "part").select("p_partkey", record.alias("t")), "t").select("p_partkey", "problems")


@query(
    """with o as (select o_orderkey id, o_custkey g, o_orderkey % 50 < 1 s, [o_orderdate::varchar] i from orders where o_orderkey % 7 > 0 union all select o_orderkey, o_custkey, o_orderkey % 50 < 1, [o_orderdate::varchar] from orders where o_orderkey % 9 = 0),
a as (select id from o group by id having count(*) > 1), b as (select g from o group by g having count(distinct s) > 1), c as (select i[1] d from o group by 1 having count(distinct s) > 1)
select list_filter([case when id in (from a) then 'repeated_id' end, case when g in (from b) then 'group_crosses' end, case when i[1] in (from c) then 'image_crosses' end], lambda x: x is not null) problems, count(*) n from o group by 1"""
)
def record_crossings(spark, sf_dir):
    """Orders as records: customers as groups, dates as images, a fiftieth held out; some orders come twice."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("g"), (F.col("o_orderkey") % 50 < 1).alias("s"), F.array(F.col("o_orderdate").cast("string")).alias("i"))
    return validation.across_records(o.where("id % 7 > 0").unionAll(o.where("id % 9 = 0")), "id", "g", "s", "i").groupBy("problems").agg(F.count("*").alias("n"))


@query(
    r"""with s as (select doc_id, trim(regexp_replace(unnest(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), '\s+', ' ', 'g')) c, generate_subscripts(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) i from documents)
select doc_id, count(*) n, string_agg(regexp_replace(c, '\.+$', ''), '|' order by i) clauses from (select * from s where length(c) between 40 and 180 and c not like '%?' and not regexp_matches(c, '^(User|System|Assistant):') and regexp_matches(c, '^\pL') qualify row_number() over (partition by doc_id order by i) <= 8) group by doc_id"""
)
def passage_clauses(spark, sf_dir):
    told = table(spark, sf_dir, "documents").select("doc_id", G.clauses(F.col("text")).alias("c"))
    return told.where(F.size("c") > 0).select("doc_id", F.size("c").cast("long").alias("n"), F.array_join("c", "|").alias("clauses"))


NUMBERS_SQL = r"""with t as (select doc_id, text || ' It costs $' || n_chars || ' or £ 1,' || lpad((doc_id % 1000)::varchar, 3, '0') || '.50, ' || doc_id % 120 || ' per cent, and takes ' || n_chars || ' Hours or ' || doc_id % 90 || ' lbs.' t from documents),
f as (select doc_id, 0 k, unnest(list_transform(regexp_extract_all(t, '[$£€]\s?\d[\d,]*(?:\.\d+)?'), lambda x, i: {'x': x, 'i': i})) s from t union all select doc_id, 1, unnest(list_transform(regexp_extract_all(t, '(\d[\d,]*(?:\.\d+)?)\s?(?:%|per cent|percent)'), lambda x, i: {'x': x, 'i': i})) from t
  union all select doc_id, 2, unnest(list_transform(regexp_extract_all(t, '(?i)\d[\d,]*(?:\.\d+)?\s?(?:UNITS)\b'), lambda x, i: {'x': x, 'i': i})) from t),
g as (select doc_id, k, s.i i, s.x x, regexp_extract(s.x, '\d[\d,]*(?:\.\d+)?') v, regexp_extract(s.x, '[A-Za-z]+$') u, regexp_replace(lower(regexp_extract(s.x, '[A-Za-z]+$')), 's+$', '') stem from f),
q as (select doc_id, k, i, case k when 0 then left(x, 1) || v when 1 then v || '%' else v || ' ' || u end raw, replace(v, ',', '')::double "value", case k when 0 then map {'$': 'USD', '£': 'GBP', '€': 'EUR'}[left(x, 1)] when 1 then 'per cent' else lower(u) end unit,
  case k when 0 then 'price' when 1 then 'percentage' else case CASES end end quantity from g),
w as (select * from q where "value" > 0 and "value" < 1000000 and quantity is not null qualify row_number() over (partition by doc_id, raw order by k, i) = 1)
select doc_id, row_number() over (partition by doc_id order by k, i)::int "at", raw, "value", unit, quantity from w qualify "at" <= 8""".replace("UNITS", G.UNITS).replace("CASES", " ".join(f"when stem in ({', '.join(repr(u) for u in units)}) then '{q}'" for q, units in G.QUANTITIES.items()))


@query(NUMBERS_SQL)
def passage_numbers(spark, sf_dir):
    """Documents with a sentence of amounts behind them."""
    c = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    n, d = F.col("n_chars"), F.col("doc_id")
    text = F.concat(*map(c, (F.col("text"), " It costs $", n, " or £ 1,", F.lpad((d % 1000).cast("string"), 3, "0"), ".50, ", d % 120, " per cent, and takes ", n, " Hours or ", d % 90, " lbs.")))
    told = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(G.quantities(text)).alias("i", "q")).where("i is not null")  # outer: the filter that a plain one infers would repeat the whole expression
    return told.select("doc_id", (F.col("i") + 1).alias("at"), "q.raw", "q.value", "q.unit", "q.quantity")


@query(
    r"""with c as (select min(t) t, n from (select p_name || ' ' || p_type t, list_aggregate(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), 'string_agg', ' ') n from part) group by n),
o as (select t, n, row_number() over (order by sha256(n)) - 1 i from c), m as (select count(*) m from o),
pr as (select min(x) p from (select unnest(range(greatest(2, m), 2 * m + 3)) x from m) where not exists (select 1 from range(2, x) d(d) where d * d <= x and x % d = 0)),
r as (select p_partkey id, lower(p_name) own, ('0x' || sha256('pool:start:' || p_partkey)[1:12])::bigint % p a, ('0x' || sha256('pool:step:' || p_partkey)[1:12])::bigint % (p - 1) + 1 b, p from part, pr),
w as (select id, own, k, (a + b * k) % p i from (select *, unnest(range(p)) k from r))
select id p_partkey, (row_number() over (partition by id order by k))::int place, t distractor from w join o using (i)
where not contains(n, own) and len(list_filter(string_split(own, ' '), lambda x: not list_contains(string_split(n, ' '), x))) > 0 qualify place <= 3"""
)
def distractor_draws(spark, sf_dir):
    """Three wrong products for each part, from all names with their types."""
    part = table(spark, sf_dir, "part")
    return distractors.draw(part, "p_partkey", "p_name", part.select(F.concat_ws(" ", "p_name", "p_type").alias("t")), "t", 3)

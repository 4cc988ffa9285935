"""The data pipeline: splits, samples, cascades, audits, inventories and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import hashing as H, values as V
from verdigris.operators import quality, sampling
from verdigris.plans.registry import query, table
from verdigris.sources import inventory

UNIT = "('0x' || sha256({x})[1:{d}])::bigint / {m}"


def unit_sql(x: str, digits: int = 12) -> str:
    return UNIT.format(x=x, d=digits, m=float(16**digits))


@query("with u as (select doc_id, " + unit_sql("'split' || chr(0) || doc_id") + " u from documents) select doc_id, round(u, 6) u, case when u < 0.2 then 'dev' when u < 0.3 then 'calibration' else 'test' end split from u")
def split_units(spark, sf_dir):
    u = H.unit("split", F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(u, 6).alias("u"), H.cumulative_split(u, [("dev", 0.2), ("calibration", 0.1), ("test", 0.7)]).alias("split"))


@query("with b as (select doc_id, ('0x' || sha256('seed'||chr(0)||source)[1:8])::bigint % 100 b from documents) select doc_id, b::int bucket, case when b < 5 then 'dev' when b < 15 then 'test' else 'train' end \"partition\" from b")
def percent_partition(spark, sf_dir):
    b = H.percent("seed", F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", b.alias("bucket"), H.dev_test_train(b).alias("partition"))


@query("select doc_id from documents where ('0x' || sha1('order:' || doc_id)[1:8])::bigint / 4294967295.0 < 0.2")
def hash_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(H.sha1_share("order:", F.col("doc_id")) < 0.2).select("doc_id")


@query("with r as (select doc_id, source, row_number() over (partition by source order by sha256(doc_id::varchar)) - 1 i, ('0x' || sha256(source)[1:8])::bigint % 4 s from documents) select doc_id, source, ((s + i) % 4)::int shard from r")
def sharded_round_robin(spark, sf_dir):
    return sampling.sharded(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", H.stable_order(F.col("doc_id")), 4)


@query("select source, doc_id, row_number() over (partition by source order by sha256(doc_id::varchar)) turn from documents")
def round_robin(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", [H.stable_order(F.col("doc_id"))])


@query("select lang, count(distinct source)::bigint \"values\" from documents group by lang having count(distinct source) > 1")
def split_isolation(spark, sf_dir):
    return quality.spans_several(table(spark, sf_dir, "documents"), "lang", "source")


@query("select md5(text) k, count(*) uses from documents group by 1 having count(*) > 3")
def reuse_caps(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("k")).agg(F.count("*").alias("uses")).where("uses > 3")


@query("select source, count(*) n, count(distinct d.lang) langs, count(distinct l.quality) qualities, bool_and(l.quality = 1) all_good from documents d join labels l using (doc_id) group by source")
def group_crossings(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.count_distinct("quality").alias("qualities"), F.bool_and(F.col("quality") == 1).alias("all_good"))


MIX = """with j as (select d.doc_id, d.source, d.lang, l.quality, l.toxic from documents d left join labels l using (doc_id))"""


@query(
    MIX
    + """ select doc_id, 'unlabelled' error from j where quality is null union all select doc_id, 'toxic' from j where toxic = 1
union all select doc_id, 'low_quality' from j where quality = 0 union all select doc_id, 'held_out_language' from j where lang = 'es' and source = 'src0'"""
)
def mixture_audit(spark, sf_dir):
    """One row for each broken rule of a document."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rules = [("unlabelled", F.col("quality").isNull()), ("toxic", F.col("toxic") == 1), ("low_quality", F.col("quality") == 0), ("held_out_language", (F.col("lang") == "es") & (F.col("source") == "src0"))]
    return joined.select("doc_id", F.explode(quality.problems(*rules)).alias("error"))


CASCADE = "case when n_chars < 200 then 'short' when n_chars > 20000 then 'long' when lang not in ('en', 'de', 'fr') then 'language' when text like '%!!%' then 'shouting' else 'kept' end"


@query(
    f"""with r as (select {CASCADE} r from documents), s("step", "rule") as (values (1, 'short'), (2, 'long'), (3, 'language'), (4, 'shouting')), c as (select "step", s."rule", count(r) dropped from s left join r on r = s."rule" group by all)
select "step", "rule", dropped, ((select count(*) from r) - sum(dropped) over (order by "step"))::bigint "left" from c"""
)
def filter_cascade(spark, sf_dir):
    rules = [("short", F.col("n_chars") < 200), ("long", F.col("n_chars") > 20000), ("language", ~F.col("lang").isin("en", "de", "fr")), ("shouting", F.col("text").contains("!!"))]
    return quality.cascade(table(spark, sf_dir, "documents"), rules)


@query("with c as (select source, toxic, count(*) c from labels join documents using (doc_id) group by all) select source, sum(c)::bigint n, round(max(c) / sum(c), 6) baseline from c group by source")
def majority_baseline(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return quality.majority_baseline(joined, "source", "toxic").withColumn("baseline", F.round("baseline", 6))


@query("select count(*) n, round(avg((l.doc_id is null)::int), 6) share, case when avg((l.doc_id is null)::int) between 0.1 and 0.35 then 'pass' else 'warn' end status from documents d left join labels l using (doc_id)")
def unknown_share(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return quality.share_in_band(joined, F.col("has").isNull(), 0.10, 0.35).withColumn("share", F.round("share", 6))


@query(
    """with j as (select contains(text, '!!') cue, toxic = 1 hit from documents join labels using (doc_id)), a as (select avg(hit::int) filter (cue) x, avg(hit::int) filter (not cue) y from j)
select round(x, 6) with_cue, round(y, 6) without_cue, round(abs(x - y), 6) gap, case when abs(x - y) > 0.25 then 'fail' when abs(x - y) > 0.10 then 'warn' else 'pass' end status from a"""
)
def cue_gap(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = quality.cue_gap(joined, F.col("text").contains("!!"), F.col("toxic") == 1)
    return out.withColumns({c: F.round(c, 6) for c in ("with_cue", "without_cue", "gap")})


@query(
    """with c as (select source, count(*) n from documents group by source), t as (select sum(n) t from c), b as (select source, n, floor(least(200, t) * n / t) f, least(200, t) * n / t - floor(least(200, t) * n / t) p, row_number() over (order by round(least(200, t) * n / t - floor(least(200, t) * n / t), 9) desc, sha256(source)) a from c, t)
, q as (select source, f::bigint + (a <= (select least(200, max(t)) - sum(f) from b, t))::int take from b)
select source, doc_id from (select source, doc_id, row_number() over (partition by source order by sha256(doc_id::varchar)) r from documents) join q using (source) where r <= take""".replace("(select least(200, max(t)) - sum(f) from b, t)", "(select (select least(200, t) from t) - sum(f) from b)")
)
def stratified_take(spark, sf_dir):
    """200 documents in proportion to the sources, by hash order within each."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    allocation = sampling.largest_remainder(docs.groupBy("source").agg(F.count("*").alias("n")), "source", "n", 200)
    return sampling.take_per_stratum(docs, allocation, "source", [H.stable_order(F.col("doc_id"))])


@query("with c as (select lang, count(*) n from documents group by lang), b as (select lang, n, coalesce(sum(n) over (order by lang rows between unbounded preceding and 1 preceding), 0) b from c) select lang, n, greatest(0, least(n, 300 - b))::bigint take from b")
def tiered_take(spark, sf_dir):
    return sampling.tiered_take(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", "n", 300)


@query(
    """with c as (select lang, count(*) n from documents group by lang), g as (select least(400, sum(n)) goal from c), l as (select max(lv) lv from range(401) t(lv), g where (select sum(least(n, lv)) from c) <= goal),
r as (select goal - (select sum(least(n, lv)) from c, l) rest from g) select lang, n, (least(n, lv) + (n > lv and row_number() over (partition by n > lv order by n desc, lang) <= rest)::int)::bigint take from c, l, r"""
)
def equal_alloc(spark, sf_dir):
    """Equal shares of 400 documents among languages, water-filled over the count table."""
    sizes = {r["lang"]: r["n"] for r in table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    take = sampling.water_fill(sizes, 400)
    return spark.createDataFrame([(k, sizes[k], take[k]) for k in sorted(sizes)], "lang string, n long, take long")


@query("select doc_id, source from documents qualify row_number() over (partition by source order by sha256(doc_id::varchar)) <= 10")
def family_cap(spark, sf_dir):
    return sampling.family_cap(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", [H.stable_order(F.col("doc_id"))], 10)


@query(
    """with recursive c as (select lang, source, count(*) m from documents group by lang, source), g as (select *, row_number() over (partition by lang order by sha256('cap' || chr(0) || source)) k from c),
f(lang, source, k, total, taken) as (select lang, source, k, m, true from g where k = 1 union all
  select g.lang, g.source, g.k, case when f.total + g.m <= 100 then f.total + g.m else f.total end, f.total + g.m <= 100 from f join g on g.lang = f.lang and g.k = f.k + 1)
select doc_id, lang, source from documents semi join (select lang, source from f where taken) using (lang, source)"""
)
def group_running_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.running_cap(docs, "lang", "source", 100, "cap")


ADMIT = """with r as (select event_id, event_type, value, row_number() over (partition by event_type order by value desc, event_id) k from events), q as (select * from r where k <= 400)
, g as (select *, row_number() over (order by value desc, event_id) a from q) select event_id, event_type, round(value, 6) value, a admitted_at from g where a <= 1000"""


@query(ADMIT)
def quota_admission(spark, sf_dir):
    """At most 400 a type and 1,000 in all, by priority. The global rank orders only what the quotas and a limit leave."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    within = sampling.family_cap(rows, "event_type", [F.desc("value"), F.col("event_id")], 400)
    top = within.orderBy(F.desc("value"), "event_id").limit(1000)
    return top.withColumn("admitted_at", F.row_number().over(Window.orderBy(F.desc("value"), "event_id"))).withColumn("value", F.round("value", 6))


@query("select 'text' kind, sha256(text) value_sha256, count(*) occurrences from documents where text is not null group by 2 union all select 'url', sha256(url), count(*) from pages where url is not null group by 2")
def exposure_inventory(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("text").alias("kind"), F.col("text").alias("value"))
    pages = table(spark, sf_dir, "pages").select(F.lit("url").alias("kind"), F.col("url").alias("value"))
    return inventory.exposure(docs.unionAll(pages))


@query("select conv_id, turn, role, list_filter([case when text is null or trim(text) = '' then 'empty' end, case when role not in ('user', 'assistant', 'system') then 'role' end, case when turn < 0 then 'turn' end, case when length(text) > 400 then 'long' end], lambda x: x is not null) problems from conversations")
def record_validation(spark, sf_dir):
    rules = [("empty", F.col("text").isNull() | (F.trim("text") == "")), ("role", ~F.col("role").isin("user", "assistant", "system")), ("turn", F.col("turn") < 0), ("long", F.length("text") > 400)]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", quality.problems(*rules).alias("problems"))


@query(
    """with g as (select d.doc_id, l.toxic gold, d.doc_id % 5 k, (d.doc_id % 2)::int v from documents d left join labels l using (doc_id))
select doc_id, case when gold is null then k = 0 else k not in (0, 1) and v = gold end correct, case when k = 0 then 'abstained' when k = 1 then 'error' else 'answered' end status from g"""
)
def typed_correctness(spark, sf_dir):
    """Gold is a label or unknown (no label); a fifth of the rows abstains, a fifth fails, the rest answers."""
    g = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    status = F.when(F.col("doc_id") % 5 == 0, "abstained").when(F.col("doc_id") % 5 == 1, "error").otherwise("answered")
    value = F.when(status == "answered", V.typed("int", (F.col("doc_id") % 2).cast("int")))
    gold = F.when(F.col("toxic").isNotNull(), V.typed("int", F.col("toxic")))
    return g.select("doc_id", V.correct(gold, status, value).alias("correct"), status.alias("status"))


@query("select source, sha256(string_agg(sha256(coalesce(text, '')), '' order by doc_id)) digest, count(*) n from documents group by source")
def dataset_digest(spark, sf_dir):
    return inventory.ordered_digest(table(spark, sf_dir, "documents"), ["source"], "doc_id", F.coalesce("text", F.lit("")))


@query("with n as (select doc_id, row_number() over (order by doc_id) - 1 r from documents) select doc_id from n where r % 7 = 0")
def strided_scan(spark, sf_dir):
    """Every seventh row in order of id. Rows are numbered in two levels: within ranges of the id, and over the ranges."""
    return inventory.strided(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("select source, count(*) \"rows\", sum(1 + doc_id % 3)::bigint decisions, round(avg((quality is null)::int), 6) unknown_share from documents left join labels using (doc_id) group by source")
def mixture_statistics(spark, sf_dir):
    return quality.mixture_statistics(_labelled(spark, sf_dir), "source", 1 + F.col("doc_id") % 3, "quality").withColumn("unknown_share", F.round("unknown_share", 6))


@query(
    """with x as (select lang, quality g, (doc_id % 10) / 10.0 u from documents left join labels using (doc_id))
select lang, count(*) n, round(avg(u) filter (g is not null), 6) mass_known, round(avg(u) filter (g is null), 6) mass_unknown, round(avg((u > 0.5)::int) filter (g is not null), 6) over_half from x group by lang"""
)
def unknown_mass_audit(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("u", (F.col("doc_id") % 10) / 10)
    return quality.unknown_mass(rows, ["lang"], "u", "quality").withColumns({c: F.round(c, 6) for c in ("mass_known", "mass_unknown", "over_half")})


@query(
    """with x as (select source, case doc_id % 10 when 0 then 'parse_error' when 1 then 'truncated' else 'ok' end s, coalesce(quality = 1, false) k, n_chars * 0.001 c from documents left join labels using (doc_id))
select source, count(*) n, round(avg((s = 'parse_error')::int), 6) parse_error, round(avg((s = 'truncated')::int), 6) truncated, round(avg(k::int), 6) keep_rate, round(sum(c) / nullif(count_if(k), 0), 6) cost_per_kept from x group by source"""
)
def pilot_metrics(spark, sf_dir):
    status = F.when(F.col("doc_id") % 10 == 0, "parse_error").when(F.col("doc_id") % 10 == 1, "truncated").otherwise("ok")
    rows = _labelled(spark, sf_dir).withColumns({"s": status, "k": F.coalesce(F.col("quality") == 1, F.lit(False)), "c": F.col("n_chars") * 0.001})
    return quality.pilot(rows, "source", "s", "k", "c").withColumns({c: F.round(c, 6) for c in ("parse_error", "truncated", "keep_rate", "cost_per_kept")})


@query("select doc_id, quality a, case when doc_id % 7 <> 0 then quality end b, coalesce(doc_id % 7 <> 0 and quality is not null and doc_id % 2 = quality, false) all_match from labels")
def reviewer_comparison(spark, sf_dir):
    """Two reviewers, of whom the second skips a seventh, against a truth read from the id."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", (F.col("doc_id") % 2).cast("int").alias("truth"))
    long = rows.withColumn("reviewer", F.lit("a")).unionAll(rows.where("doc_id % 7 <> 0").withColumn("reviewer", F.lit("b")))
    return quality.reviewer_comparison(long, "doc_id", "reviewer", "quality", "truth", ["a", "b"])


@query("select doc_id from documents where not (source = 'src0') or ('0x' || sha256('cap' || chr(0) || doc_id)[1:8])::bigint % 100 < 30")
def share_cap(spark, sf_dir):
    """Only three tenths of the largest source, by hash of the id."""
    return quality.share_capped(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", F.col("source") == "src0", 30, "cap").select("doc_id")


@query(
    """select event_id, event_type, rank() over w "rank", dense_rank() over w "dense", percent_rank() over w share, ntile(4) over (partition by event_type order by value desc, event_id) fourth,
round(avg(value) over (partition by event_type order by value desc, event_id rows between 2 preceding and current row), 6) last_three, lag(event_id) over (partition by event_type order by value desc, event_id) previous
from events window w as (partition by event_type order by floor(value / 10) desc)"""
)
def ranking_windows(spark, sf_dir):
    """Ranks with ties, quarters, a frame of rows and the row before, by type."""
    from pyspark.sql import Window

    ties = Window.partitionBy("event_type").orderBy(F.desc(F.floor(F.col("value") / 10)))
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.rank().over(ties).alias("rank"), F.dense_rank().over(ties).alias("dense"), F.percent_rank().over(ties).alias("share"), F.ntile(4).over(order).alias("fourth"),
        F.round(F.avg("value").over(order.rowsBetween(-2, 0)), 6).alias("last_three"), F.lag("event_id").over(order).alias("previous"),
    )


@query("select coalesce(r_name, 'none') region, coalesce(c_mktsegment, 'none') segment, count(distinct n_nationkey) nations, count(c_custkey) customers from region full join nation on n_regionkey = r_regionkey and n_nationkey % 5 <> 0 full join customer on c_nationkey = n_nationkey group by all")
def full_outer_counts(spark, sf_dir):
    """Regions, nations and customers by full outer joins: sides without a partner stay."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    joined = r.join(n, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("n_nationkey") % 5 != 0), "full").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "full")
    return joined.groupBy(F.coalesce("r_name", F.lit("none")).alias("region"), F.coalesce("c_mktsegment", F.lit("none")).alias("segment")).agg(F.countDistinct("n_nationkey").alias("nations"), F.count("c_custkey").alias("customers"))


@query("select conv_id, turn, l.doc_id, quality from (select conv_id, turn, conv_id doc_id from conversations) c natural join (select doc_id, quality from labels) l")
def natural_join(spark, sf_dir):
    """Joined by the names both sides have."""
    from verdigris.operators.records import natural

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("conv_id").alias("doc_id"))
    return natural(c, table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query("with s as (select source, count(*) n from documents group by source), k as (select sum(sqrt(n)) w, count(*) c, least(300, sum(n)) t from s) select source, n, round(sqrt(n) / w, 6) share from s, k")
def root_shares(spark, sf_dir):
    """Shares of sources in proportion to the root of their size."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum(F.sqrt("n")).alias("w"))  # one row
    return sizes.join(F.broadcast(whole), F.lit(True)).select("source", "n", F.round(F.sqrt("n") / F.col("w"), 6).alias("share"))

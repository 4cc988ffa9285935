"""Evaluation: metrics, statistics and calibration over predictions read from the embeddings table.

Stand-in: a row's logits are ten components of its embedding, scaled; its gold is its label. Slices at 0 and 10 are two
systems or two orders; the family is the label's parity class, the track the remainder by 3, the cluster the remainder by 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdigris.functions import distributions as D, targets as T
from verdigris.functions.hashing import sha1_share
from verdigris.operators import calibration, labels, metrics, quality, stats
from verdigris.plans.registry import query, table

SCALE = 12.0


def predictions(spark: SparkSession, sf_dir: str, at: int = 0) -> DataFrame:
    """vec_id, gold, family, track, cluster, z, p, conf, pred, correct."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("gold"), F.transform(F.slice("embedding", at + 1, 10), lambda x: x.cast("double") * SCALE).alias("z"))
    rows = rows.withColumn("p", D.softmax(F.col("z")))
    rows = rows.withColumns({"conf": F.array_max("p"), "pred": D.argmax(F.col("p"))})
    return rows.withColumns({"correct": F.col("pred") == F.col("gold"), "family": F.col("gold") % 4, "track": (F.col("vec_id") % 3).cast("int"), "cluster": (F.col("vec_id") % 50).cast("int")})


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def preds_sql(at: int = 0, name: str = "preds") -> str:
    return f"""
{name}_z as (select vec_id, label gold, list_transform(embedding[{at + 1}:{at + 10}], lambda x: x::double * {SCALE}) z from embeddings),
{name}_e as (select *, list_transform(z, lambda x: exp(x - list_max(z))) e from {name}_z),
{name}_p as (select vec_id, gold, z, list_transform(e, lambda x: x / list_sum(e)) p from {name}_e),
{name} as (select *, list_max(p) conf, (list_position(p, list_max(p)) - 1)::int pred, (list_position(p, list_max(p)) - 1) = gold as correct, gold % 4 as family,
  (vec_id % 3)::int track, (vec_id % 50)::int "cluster" from {name}_p)"""


def weights_sql(units: str, unit: str, seed: str, replicates: int = 1000, name: str = "w") -> str:
    """``units`` with r and w, the weight of a unit in each replicate."""
    passes = " + ".join(f"(u >= {x})::int" for x in stats.PASSES)
    return f"""{name}_h as (select *, sha256('{seed}:' || {unit}) h from {units}),
{name}_u as (select *, (('0x' || h[1:8])::bigint % {stats.MODULUS} * r + ('0x' || h[9:16])::bigint % {stats.MODULUS}) % {stats.MODULUS} u from {name}_h, range(1, {replicates + 1}) x(r)),
{name} as (select *, {passes} w from {name}_u)"""


P = "with " + preds_sql()
AB = "with " + preds_sql(0, "a") + "," + preds_sql(10, "b")


@query(P + " select family, count(*) n, round(avg(correct::int), 6) accuracy from preds group by family")
def accuracy_by_family(spark, sf_dir):
    return r6(metrics.accuracy_by(predictions(spark, sf_dir), ["family"]), "accuracy")


@query(
    P
    + """, g as (select track, gold c, count(*) s, sum(correct::int) tp from preds group by all),
f as (select track, pred c, count(*) fp from preds where not correct group by all),
j as (select g.*, coalesce(fp, 0) fp from g left join f using (track, c))
select track, sum(s)::bigint n, round(sum(tp) / sum(s), 6) accuracy, round(avg(tp / s), 6) balanced_accuracy, round(avg(2 * tp / (2 * tp + fp + s - tp)), 6) macro_f1 from j group by track"""
)
def classification_report(spark, sf_dir):
    return r6(metrics.classification(predictions(spark, sf_dir), ["track"], "gold", "pred"), "accuracy", "balanced_accuracy", "macro_f1")


@query(
    P
    + """, f as (select track, family, avg(correct::int) a from preds group by all), t as (select track::varchar "name", 100 * avg(a) s from f group by track)
select 'track' "level", "name", round(s, 6) score from t union all select 'overall', 'all', case when count(*) = 3 then round(avg(s), 6) end from t"""
)
def macro_scores(spark, sf_dir):
    return r6(metrics.macro_scores(predictions(spark, sf_dir), "track", "family"), "score")


@query(P + ' select "cluster", bool_and(correct) all_correct from preds group by "cluster"')
def group_all_correct(spark, sf_dir):
    return metrics.group_all_correct(predictions(spark, sf_dir), "cluster")


@query(P + " select count(*) n, round(avg(list_sum(list_transform(p, lambda v, i: (v - (case when i - 1 = gold then 1.0 else 0.0 end)) ** 2))), 6) brier, round(avg(-ln(greatest(p[gold + 1], 1e-15))), 6) nll from preds")
def brier_nll(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return r6(p.agg(F.count("*").alias("n"), F.avg(D.brier(F.col("p"), F.col("gold"))).alias("brier"), F.avg(D.nll(F.get("p", F.col("gold")))).alias("nll")), "brier", "nll")


_BINS = {"left": "least(floor(conf * {n}), {n} - 1)", "right": "greatest(ceil(conf * {n}) - 1, 0)", "right_open_zero": "case when conf > 0 then greatest(ceil(conf * {n}) - 1, 0) end"}


def _ece(rule: str) -> None:
    n, side = D.ECE_RULES[rule]
    sql = P + f", b as (select {_BINS[side].format(n=n)} b, count(*) m, avg(correct::int) a, avg(conf) c from preds group by b) select sum(m)::bigint n, round(sum(case when b is not null then m * abs(a - c) else 0 end) / sum(m), 6) ece from b"

    @query(sql, f"ece_{rule}")
    def ece(spark, sf_dir):
        return r6(metrics.expected_calibration_error(predictions(spark, sf_dir), [], "conf", "correct", rule), "ece")


for _rule in D.ECE_RULES:
    _ece(_rule)

CURVE = P + """, r as (select round(conf, 9) c, correct, gold <> 9 answerable from preds), t as (select sum(answerable::int)::bigint al from r),
s as (select c, count(*) m, sum((not correct)::int) e from r where answerable group by c),
w as (select c, m, sum(m) over (order by c desc)::bigint n, sum(e) over (order by c desc)::bigint errors from s)"""


def _answerable(spark, sf_dir):
    return predictions(spark, sf_dir).select(F.round("conf", 9).alias("conf"), "correct", (F.col("gold") != 9).alias("answerable"))


@query(CURVE + " select round(c, 6) confidence, n, errors, round(n / al, 6) coverage, round(errors / n, 6) risk from w, t")
def risk_coverage(spark, sf_dir):
    return r6(metrics.risk_coverage(_answerable(spark, sf_dir), "conf", "correct").select("confidence", "n", "errors", "coverage", "risk"), "confidence", "coverage", "risk")


@query(CURVE + " select round(sum(errors / n * m / al), 6) partial_aurc, round(max(n / al), 6) coverage, case when max(n) = max(al) then round(sum(errors / n * m / al), 6) end aurc from w, t")
def aurc(spark, sf_dir):
    return r6(metrics.aurc(metrics.risk_coverage(_answerable(spark, sf_dir), "conf", "correct")), "partial_aurc", "coverage", "aurc")


@query(P + " select track, count(*) n, sum((conf >= 0.4 and pred <> 9)::int)::bigint accepted, round(avg((conf >= 0.4 and pred <> 9)::int), 6) coverage, round(avg(case when conf >= 0.4 and pred <> 9 then correct::int end), 6) \"precision\" from preds group by track")
def auto_accept(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("unknown", F.col("pred") == 9)
    return r6(metrics.auto_accept(rows, ["track"], "conf", "correct", "unknown", 0.4), "coverage", "precision")


@query(P + ", x as (select gold, abs(list_sum(list_transform(p[1:5], lambda v, i: v / list_sum(p[1:5]) * (i - 1))) - gold) d from preds where gold < 5) select count(*) n, round(avg(d), 6) mae from x")
def ordinal_mae(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("gold < 5").withColumn("known", F.slice("p", 1, 5))
    expected = D.expected_level(F.col("known"), F.array(*[F.lit(float(i)) for i in range(5)]))
    return r6(rows.agg(F.count("*").alias("n"), F.avg(F.abs(expected - F.col("gold"))).alias("mae")), "mae")


@query(
    "select event_type, count(*) n, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_disc(value, 0.95), 6) p95_nearest, round(sum(value), 4) total from events group by event_type"
)
def latency_quantiles(spark, sf_dir):
    return r6(metrics.efficiency(table(spark, sf_dir, "events"), ["event_type"], "value"), "p50", "p95", "p95_nearest").withColumn("total", F.round("total", 4))


@query(
    AB
    + """, l as (select a.vec_id, a.gold, list_transform(a.p, lambda v, i: (ln(v) + ln(b.p[i])) / 2) lp from a join b using (vec_id)),
e as (select vec_id, list_transform(lp, lambda x: exp(x - list_max(lp))) e from l)
select vec_id, (list_position(e, list_max(e)) - 1)::int pred, round(list_max(e) / list_sum(e), 6) conf from e"""
)
def order_average(spark, sf_dir):
    """Two orders: the second lists the candidates from the fourth on and is read back before averaging."""
    a = predictions(spark, sf_dir, 0).select("vec_id", F.transform("p", lambda v: F.log(v)).alias("lp"), F.lit(0).alias("offset"))
    b = predictions(spark, sf_dir, 10).select("vec_id", D.rotated(F.transform("p", lambda v: F.log(v)), 3).alias("lp"), F.lit(3).alias("offset"))
    rows = a.unionAll(b)
    slots = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.pmod(i - F.col("offset"), F.lit(10)).cast("int"))
    averaged = calibration.average_orders(rows, "vec_id", F.col("lp"), slots)
    return averaged.select("vec_id", D.argmax(F.col("p")).alias("pred"), F.round(F.array_max("p"), 6).alias("conf"))


@query(AB + ", u as (select vec_id, unnest(p) v, unnest(range(10)) k from a union all select vec_id, unnest(p), unnest(range(10)) from b) select vec_id, k::varchar \"label\", round(sum(v) / 2, 6) p from u group by vec_id, k")
def solve_mean(spark, sf_dir):
    both = predictions(spark, sf_dir, 0).select("vec_id", "p").unionAll(predictions(spark, sf_dir, 10).select("vec_id", "p"))
    keys = F.array(*[F.lit(str(i)) for i in range(10)])
    return r6(labels.merge_solves(both.select("vec_id", F.map_from_arrays(keys, F.col("p")).alias("probs")), "vec_id", "probs"), "p")


@query(AB + " select a.vec_id, round(1 - list_sum(list_transform(a.p, lambda v, i: abs(v - b.p[i]))) / 2, 6) agreement from a join b using (vec_id)")
def order_agreement(spark, sf_dir):
    b = predictions(spark, sf_dir, 10).select("vec_id", F.col("p").alias("q"))
    return predictions(spark, sf_dir).join(b, "vec_id").select("vec_id", F.round(D.agreement(F.col("p"), F.col("q")), 6).alias("agreement"))


GRID = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]
OFFSETS = [-1.0, 0.0, 1.0]


@query(
    "with "
    + preds_sql()
    + f""", pts as (select unnest({GRID}) t, unnest(range({len(GRID)})) i), os as (select unnest({OFFSETS}) o, unnest(range({len(OFFSETS)})) j),
x as (select track, gold, t, o, j * {len(GRID)} + i k, list_transform(z, lambda v, q: (v + (case when q = 10 then o else 0.0 end)) / t) s from preds, pts, os),
l as (select track, t, o, k, avg(-ln(greatest(exp(s[gold + 1] - list_max(s)) / list_sum(list_transform(s, lambda v: exp(v - list_max(s)))), 1e-15))) loss from x group by all)
select track, arg_min(t, (round(loss, 9), k)) temperature, arg_min(o, (round(loss, 9), k)) unknown_offset, round(min(loss), 6) loss from l group by track"""
)
def temperature_grid(spark, sf_dir):
    return r6(calibration.grid_temperatures(predictions(spark, sf_dir), "track", "z", "gold", GRID, OFFSETS), "loss")


def fit_sql(rows: str, name: str, key: str = "key", rounds: int = 7, points: int = 32) -> str:
    """CTEs that end in ``name`` (key, n, temperature): the rounds of ``fit_temperatures`` over ``rows`` (key, z, y)."""
    out = f"{name}_0 as (select {key} k, {calibration.LOW} a, {calibration.HIGH} b, 0.0::double t from {rows} group by 1)"
    for r in range(1, rounds + 1):
        at = lambda i: f"(a + (b - a) * {i} / {points})"
        out += f""",
{name}_p{r} as (select k, a, b, i, exp(case when i < 0 then 0 else {at("i")} end) e, z, y from {rows} join {name}_{r - 1} on k = {key}, range(-1, {points + 1}) g(i)),
{name}_l{r} as (select k, a, b, i, sum(-ln(greatest(exp((z[y + 1] - list_max(z)) / e) / list_sum(list_transform(z, lambda v: exp((v - list_max(z)) / e))), 1e-300))) s from {name}_p{r} group by all),
{name}_m{r} as (select k, a, b, arg_min(i, (case when i < 0 then 'inf'::double else s end, i)) i, arg_min(i, (s, i)) o from {name}_l{r} group by all),
{name}_{r} as (select k, {at("greatest(i - 1, 0)")} a, {at(f"least(i + 1, {points})")} b, case when o < 0 then 0 else {at("i")} end t from {name}_m{r})"""
    return out + f",\n{name} as (select k, count(*) n, exp(any_value(t)) temperature from {rows} join {name}_{rounds} on k = {key} group by k)"


def r4(df: DataFrame) -> DataFrame:
    return df.withColumn("temperature", F.round("temperature", 4))


@query(P + ", rows_ as (select track \"key\", z, gold y from preds), " + fit_sql("rows_", "f") + " select k track, n, round(temperature, 4) temperature from f")
def temperature_golden(spark, sf_dir):
    return r4(calibration.fit_temperatures(predictions(spark, sf_dir), "track", "z", "gold"))


#: Decisions of 3, 5 and 10 outcomes; a rare kind takes every 97th.
KIND_SQL = """, typed as (select *, case when vec_id % 97 = 0 then 'rare' else ['noul', 'choice', 'score'][vec_id % 3 + 1] end kind, [3, 5, 10][vec_id % 3 + 1] m from preds),
rows_ as (select vec_id, kind "key", list_transform(z[1:m], lambda v: v * 0.6) z, (case when vec_id % 4 < 2 then list_position(z[1:m], list_max(z[1:m])) - 1 else gold % m end)::int y from typed),
all_ as (select 'all' "key", z, y from rows_), """
BY_TYPE_SQL = P + KIND_SQL + fit_sql("rows_", "f") + ", " + fit_sql("all_", "w") + ", fits as (select f.k kind, f.n, f.n < 50 pooled, greatest(1.0, case when f.n < 50 then w.temperature else f.temperature end) temperature from f, w)"


def typed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, kind, z, y: decisions whose number of outcomes depends on their kind."""
    kind = F.when(F.col("vec_id") % 97 == 0, "rare").otherwise(F.get(F.array(*map(F.lit, ("noul", "choice", "score"))), (F.col("vec_id") % 3).cast("int")))
    m = F.get(F.array(*map(F.lit, (3, 5, 10))), (F.col("vec_id") % 3).cast("int"))
    z = F.transform(F.slice("z", F.lit(1), m), lambda v: v * 0.6)
    y = F.when(F.col("vec_id") % 4 < 2, D.argmax(z)).otherwise(F.col("gold") % m).cast("int")
    return predictions(spark, sf_dir).select("vec_id", kind.alias("kind"), z.alias("z"), y.alias("y"))


@query(BY_TYPE_SQL + " select kind, n, pooled, round(temperature, 4) temperature from fits")
def temperature_by_type(spark, sf_dir):
    return r4(calibration.fit_by_type(typed_decisions(spark, sf_dir), "kind", "z", "y"))


@query(
    BY_TYPE_SQL
    + """, e as (select z, y, list_transform(z, lambda v: exp((v - list_max(z)) / temperature)) x from rows_ join fits on kind = "key" where vec_id % 2 = 1),
c as (select 1 / list_sum(x) conf, list_position(z, list_max(z)) - 1 = y as correct from e),
b as (select greatest(ceil(conf * 10) - 1, 0) b, count(*) m, avg(correct::int) a, avg(conf) c from c group by 1), g as (select sum(m * abs(a - c)) / sum(m) ece from b)
select kind, round(case when ece <= 0.03 then temperature else 1.5 end, 4) temperature, case when ece <= 0.03 then 'per_type' else 'authored' end source, round(ece, 4) pooled_ece from fits, g"""
)
def calibration_choice(spark, sf_dir):
    rows = typed_decisions(spark, sf_dir)
    fits = calibration.fit_by_type(rows, "kind", "z", "y")
    return r4(calibration.choose_calibration(rows.where("vec_id % 2 = 1"), fits, 1.5, "kind", "z", "y")).withColumn("pooled_ece", F.round("pooled_ece", 4))


@query(
    P + """, t(track, t) as (values (0, 2.0), (1, 4.0)), x as (select vec_id, pred, list_transform(z, lambda v: v / coalesce(t, 1.0)) s from preds left join t using (track))
select vec_id, pred, round(1 / list_sum(list_transform(s, lambda v: exp(v - list_max(s)))), 6) conf from x"""
)
def apply_temperature(spark, sf_dir):
    told = spark.sql("select * from values (0, 2.0D), (1, 4.0D) as t(track, temperature)")
    out = calibration.apply_temperatures(predictions(spark, sf_dir).drop("p", "pred"), told, "track", "z")
    return out.select("vec_id", "pred", F.round(F.array_max("p"), 6).alias("conf"))


@query(
    "select case when label % 3 = 0 then 'boolean' when label % 3 = 1 then 'choice' else 'ordinal' end || ':' || (case when vec_id % 40 + 2 <= 2 then '2' when vec_id % 40 + 2 <= 5 then '3-5' when vec_id % 40 + 2 <= 10 then '6-10' when vec_id % 40 + 2 <= 25 then '11-25' else '26-254' end) bucket, count(*) n from embeddings group by 1"
)
def calibration_buckets(spark, sf_dir):
    kind = F.when(F.col("label") % 3 == 0, "noul").when(F.col("label") % 3 == 1, "choice").otherwise("score")
    return table(spark, sf_dir, "embeddings").groupBy(D.calibration_key(kind, F.col("vec_id") % 40 + 2).alias("bucket")).agg(F.count("*").alias("n"))


@query(P + ", c as (select \"cluster\", count(*) n, sum(correct::int) k from preds group by 1) select count(*) clusters, sum(n)::bigint n, round(sum(k) / sum(n), 6) accuracy from c")
def cluster_accuracy(spark, sf_dir):
    return r6(stats.cluster_accuracy(predictions(spark, sf_dir), "cluster", "correct"), "accuracy")


@query(
    P
    + """, c as (select "cluster", count(*) n, sum(correct::int) k from preds group by 1), t as (select count(*) m, sum(k) / sum(n) a from c), """
    + weights_sql("c", '"cluster"', "bootstrap")
    + """, b as (select r, sum(k * w) / sum(n * w) v from w group by r)
select m clusters, round(a, 6) accuracy, round(quantile_cont(v, 0.025), 6) low, round(quantile_cont(v, 0.975), 6) high from t, b group by all"""
)
def cluster_bootstrap(spark, sf_dir):
    return r6(stats.cluster_bootstrap(predictions(spark, sf_dir), "cluster", "correct", 1000), "accuracy", "low", "high")


@query(
    AB
    + """, d as (select a.vec_id % 14 c, count(*) n, sum(a.correct::int - b.correct::int) d from a join b using (vec_id) group by 1),
m as (select d, row_number() over (order by c) - 1 bit from d where d <> 0), o as (select count(*) filter (d <> 0) k, abs(sum(d)) obs, sum(d) / sum(n) diff, count(*) c from d),
f as (select s, abs(sum(case when (s >> bit) & 1 = 1 then -d else d end)) t from m, range(1 << (select count(*) from m)) r(s) group by s)
select c clusters, k discordant, round(diff, 6) difference, case when k = 0 then 1.0 else (select round(avg((t >= obs - 1e-12)::int), 6) from f, o) end p_value from o"""
)
def paired_signflip_exact(spark, sf_dir):
    b = predictions(spark, sf_dir, 10).select("vec_id", F.col("correct").alias("b"))
    both = predictions(spark, sf_dir).select("vec_id", F.col("correct").alias("a"), (F.col("vec_id") % 14).alias("c")).join(b, "vec_id")
    return r6(stats.paired_signflip(both, "c", "a", "b"), "difference", "p_value")


@query(
    AB
    + """, c as (select a."cluster"::varchar f, count(*) n, sum(b.correct::int - a.correct::int) d from a join b using (vec_id) group by 1), """
    + weights_sql("c", "f", "families")
    + """, m as (select list_sort(list(v)) l from (select sum(d * w) / sum(n * w) v from w group by r))
select round((select sum(d) / sum(n) from c), 6) delta, round(l[1 + floor(0.025 * len(l))::int], 6) low, round(l[1 + floor(0.975 * len(l))::int], 6) high, (select count(*) from c) families from m"""
)
def paired_family_bootstrap(spark, sf_dir):
    left, right = predictions(spark, sf_dir), predictions(spark, sf_dir, 10)
    return r6(stats.paired_family_bootstrap(left, right, "vec_id", "cluster", "correct", 1000), "delta", "low", "high")


@query(
    P
    + """, c as (select 'p' || (vec_id // 2) pair, 1 n, sum(case when vec_id % 2 = 1 then correct::int else -correct::int end) d, sum(case when vec_id % 2 = 0 then correct::int end) t,
  sum(case when vec_id % 2 = 1 then correct::int end) i from preds group by 1 having count(*) = 2), """
    + weights_sql("c", "pair", "pairs", 200)
    + """, m as (select list_sort(list(v)) l from (select sum(d * w) / sum(n * w) v from w group by r))
select round((select avg(d) from c), 6) irrelevant_image_delta, round(l[1 + floor(0.025 * len(l))::int], 6) low, round(l[1 + floor(0.975 * len(l))::int], 6) high, (select count(*) from c) pairs,
  round((select avg(t) from c), 6) text_only_accuracy, round((select avg(i) from c), 6) irrelevant_image_accuracy from m"""
)
def paired_irrelevance_delta(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("vec_id", "correct", F.expr("concat('p', vec_id div 2)").alias("pair"), F.expr("if(vec_id % 2 = 0, 'text_only', 'irrelevant_image')").alias("variant"), F.lit("test").alias("partition"))
    whole = rows.join(rows.groupBy("pair").agg(F.count("*").alias("m")).where("m = 2").select("pair"), "pair", "left_semi")
    return r6(stats.paired_irrelevance_delta(whole, "vec_id", "pair", "variant", "correct", "partition", 200), "irrelevant_image_delta", "low", "high", "text_only_accuracy", "irrelevant_image_accuracy")


@query(
    AB
    + """, d as (select a.vec_id % 14 c, count(*) n, sum(a.correct::int - b.correct::int) d, count(*) filter (a.correct and not b.correct) x, count(*) filter (b.correct and not a.correct) y from a join b using (vec_id) group by 1),
m as (select d, row_number() over (order by c) - 1 bit from d where d <> 0), o as (select abs(sum(d)) obs from d),
f as (select s, abs(sum(case when (s >> bit) & 1 = 1 then -d else d end)) t from m, range(1 << (select count(*) from m)) r(s) group by s), """
    + weights_sql("d", "c", "paired")
    + """, b2 as (select r, sum(d * w) / sum(n * w) v from w group by r)
select (select round(sum(d) / sum(n), 6) from d) difference, (select sum(n)::bigint from d) records, (select count(*) from d) clusters, (select count(*) from m) discordant_clusters,
  (select sum(x)::bigint from d) a_only_correct, (select sum(y)::bigint from d) b_only_correct, coalesce((select round(avg((t >= obs - 1e-12)::int), 6) from f, o), 1.0) p_value,
  round(quantile_cont(v, 0.025), 6) low, round(quantile_cont(v, 0.975), 6) high from b2"""
)
def paired_comparison(spark, sf_dir):
    b = predictions(spark, sf_dir, 10).select("vec_id", F.col("correct").alias("b"))
    both = predictions(spark, sf_dir).select("vec_id", F.col("correct").alias("a"), (F.col("vec_id") % 14).alias("c")).join(b, "vec_id")
    return r6(stats.paired_comparison(both, "c", "a", "b", replicates=1000), "difference", "p_value", "low", "high")


@query(
    P
    + """, c as (select "cluster", count(*) n, sum(correct::int) s, sum(correct::int) q from preds group by 1),
t as (select count(*) k, sum(n) n, sum(s) s, sum(q) q, sum(s * s / n) w, sum(n * n) n2 from c),
x as (select k, n, (w - s * s / n) / (k - 1) b, (q - w) / (n - k) w, (n - n2 / n) / (k - 1) m from t)
select k clusters, n::bigint n, case when b + (m - 1) * w > 0 then round(greatest(0.0, (b - w) / (b + (m - 1) * w)), 6) end icc from x"""
)
def icc(spark, sf_dir):
    return r6(stats.intraclass_correlation(predictions(spark, sf_dir), "cluster", "correct"), "icc")


@query(
    AB
    + """, j as (select a.pred x, b.pred y from a join b using (vec_id)), t as (select count(*) n, avg((x = y)::int) po from j),
e as (select sum(p.c * q.c) / max(n) / max(n) pe from (select x v, count(*) c from j group by 1) p join (select y v, count(*) c from j group by 1) q using (v), t)
select n, round(po, 6) agreement, round(case when pe = 1 then 1.0 else (po - pe) / (1 - pe) end, 6) kappa from t, e"""
)
def kappa(spark, sf_dir):
    b = predictions(spark, sf_dir, 10).select("vec_id", F.col("pred").alias("b"))
    return r6(stats.kappa(predictions(spark, sf_dir).select("vec_id", F.col("pred").alias("a")).join(b, "vec_id"), "a", "b"), "agreement", "kappa")


@query(
    """with c as (select source, count(*) n, sum(toxic) e from labels join documents using (doc_id) group by source)
select source, n, e::bigint errors, round((e / n + 1.959964 ** 2 / (2 * n) + 1.959964 * sqrt(e / n * (1 - e / n) / n + 1.959964 ** 2 / (4 * n * n))) / (1 + 1.959964 ** 2 / n), 6) upper_bound from c"""
)
def wilson_upper(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    g = joined.groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("errors"))
    return g.withColumn("upper_bound", F.round(stats.wilson_upper(F.col("errors"), F.col("n")), 6))


FLAGS = AB + """, j as (select a.*, b.pred rot, (case when a.gold = 9 then null else a.gold end) g, ('0x' || sha1('order:' || a.vec_id)[1:8])::bigint / 4294967295.0 < 0.2 as chk from a join b using (vec_id)),
f as (select vec_id, list_filter([case when g is not null and pred <> g then 'wrong' end, case when g is not null and pred = g and p[g + 1] < 0.6 then 'low_conf' end,
 case when g is null and conf < 0.6 then 'unsure' end, case when chk and rot <> pred then 'order_flip' end], lambda x: x is not null) flags,
 case when g is not null and pred <> g then 2 + conf when g is not null and pred = g and p[g + 1] < 0.6 then 1 + (0.6 - p[g + 1]) when chk and rot <> pred then 0.5 when g is null and conf < 0.6 then 0.25 + (0.6 - conf) / 4 else 0 end priority from j)"""


def _flagged(spark, sf_dir):
    b = predictions(spark, sf_dir, 10).select("vec_id", F.col("pred").alias("rot"))
    rows = predictions(spark, sf_dir).join(b, "vec_id").withColumn("g", F.when(F.col("gold") != 9, F.col("gold")))
    flags, priority = labels.mining_flags(F.col("g"), F.col("pred"), F.get("p", F.col("g")), F.col("conf"), F.col("rot"), sha1_share("order:", F.col("vec_id")) < 0.2)
    return rows.select("vec_id", flags.alias("flags"), priority.alias("priority"))


@query(FLAGS + " select vec_id, array_to_string(flags, ',') flags, round(priority, 6) priority from f where len(flags) > 0")
def mining_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).where("size(flags) > 0").select("vec_id", F.array_join("flags", ",").alias("flags"), F.round("priority", 6).alias("priority"))


@query(FLAGS + " select vec_id, round(priority, 6) priority, row_number() over (order by round(priority, 9) desc, vec_id) place from f where len(flags) > 0 order by place limit 100")
def priority_order(spark, sf_dir):
    """The report of the 100 most urgent rows, most confidently wrong first."""
    from pyspark.sql import Window

    top = _flagged(spark, sf_dir).where("size(flags) > 0").orderBy(F.desc(F.round("priority", 9)), "vec_id").limit(100)
    return top.select("vec_id", F.round("priority", 6).alias("priority"), F.row_number().over(Window.orderBy(F.desc(F.round("priority", 9)), "vec_id")).alias("place"))


@query(AB + " select vec_id, case when a.pred <> b.pred then 'orders_disagree' when a.pred = 9 and (a.conf + b.conf) / 2 >= 0.5 then 'kept' when a.pred <> 9 and (a.conf + b.conf) / 2 >= 0.6 then 'kept' else 'low_confidence' end reason from a join b using (vec_id)")
def keep_rule(spark, sf_dir):
    b = predictions(spark, sf_dir, 10).select("vec_id", F.col("pred").alias("q"), F.col("conf").alias("c"))
    both = predictions(spark, sf_dir).join(b, "vec_id")
    return both.select("vec_id", labels.keep_rule(F.col("pred") == F.col("q"), (F.col("conf") + F.col("c")) / 2, F.col("pred") == 9).alias("reason"))


def _three(spark, sf_dir):
    rows = [predictions(spark, sf_dir, 10 * i).select("vec_id", F.lit(f"s{i}").alias("provider"), (F.col("pred") % 2).alias("value"), (F.col("conf") < 0.3).alias("hedged")) for i in range(3)]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


ABC = "with " + ",".join(preds_sql(10 * i, n) for i, n in enumerate("abc")) + ", u as (" + " union all ".join(f"select vec_id, '{n}' s, pred % 2 v, conf < 0.3 h from {n}" for n in "abc") + ")"


@query(ABC + " select vec_id, count(distinct s) providers, case when count(distinct v) = 1 then min(v) end consensus from u group by vec_id")
def consensus(spark, sf_dir):
    return labels.consensus(_three(spark, sf_dir), "vec_id", "provider", "value")


@query(ABC + " select vec_id, count(distinct v) = 1 strict, bool_or(v = 1) and not bool_or(v <> 1 and not h) relaxed from u group by vec_id")
def agreement(spark, sf_dir):
    rows = _three(spark, sf_dir).withColumns({"parsed": F.lit(True), "unknown": F.lit(1)})
    return labels.agreement(rows, "vec_id", "value", "parsed", "unknown", "hedged")


@query(AB + " select count(*) n, sum((a.correct and b.correct)::int)::bigint both_correct, sum((a.correct and not b.correct)::int)::bigint only_a, sum((b.correct and not a.correct)::int)::bigint only_b from a join b using (vec_id)")
def multi_run_join(spark, sf_dir):
    b = predictions(spark, sf_dir, 10).select("vec_id", F.col("correct").alias("b"))
    joined = predictions(spark, sf_dir).select("vec_id", F.col("correct").alias("a")).join(b, "vec_id")
    c = lambda x: F.sum(x.cast("long"))
    return joined.agg(F.count("*").alias("n"), c(F.col("a") & F.col("b")).alias("both_correct"), c(F.col("a") & ~F.col("b")).alias("only_a"), c(F.col("b") & ~F.col("a")).alias("only_b"))


@query("select count(*) records, count(l.doc_id) predicted, count(*) - count(l.doc_id) missing, (select count(*) from labels where doc_id not in (select doc_id from documents)) unexpected from documents d left join labels l using (doc_id)")
def missing_predictions(spark, sf_dir):
    docs, rows = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"))
    joined = docs.join(rows, "doc_id", "left").agg(F.count("*").alias("records"), F.count("has").alias("predicted"))
    extra = rows.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("unexpected"))
    return joined.join(F.broadcast(extra)).select("records", "predicted", (F.col("records") - F.col("predicted")).alias("missing"), "unexpected")


@query(
    P
    + """, f(track, c) as (values (0, 100), (1, 50), (2, 10)), t as (select track, count(*) n, sum(correct::int) k from preds group by track)
select round(sum(k) / sum(n), 6) "primary", round(avg(k / n), 6) macro, round(sum(k / n * c) / sum(c), 6) poststratified from t join f using (track)"""
)
def poststratified_accuracy(spark, sf_dir):
    full = spark.sql("select * from values (0, 100), (1, 50), (2, 10) as t(track, c)")
    return r6(quality.poststratified(predictions(spark, sf_dir), "track", "correct", full, "c"), "primary", "macro", "poststratified")


@query(
    P
    + """, g as (select count(*) n, avg(correct::int) acc, avg(conf) conf from preds)
select 'rows' gate, n >= 100 passed, n::varchar detail from g union all select 'accuracy', acc >= 0.5, round(acc, 4)::varchar from g union all select 'overconfidence', conf - acc <= 0.1, round(conf - acc, 4)::varchar from g"""
)
def acceptance_gates(spark, sf_dir):
    g = predictions(spark, sf_dir).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"), F.avg("conf").alias("conf"))
    return quality.gates([
        ("rows", g, F.col("n") >= 100, F.col("n")),
        ("accuracy", g, F.col("acc") >= 0.5, F.round("acc", 4)),
        ("overconfidence", g, F.col("conf") - F.col("acc") <= 0.1, F.round(F.col("conf") - F.col("acc"), 4)),
    ])


@query(
    AB
    + """, w as (select a.vec_id, list_transform(a.p, lambda v, i: v - b.p[i]) d from a join b using (vec_id))
select vec_id, round(list_sum(list_transform(range(1, 11), lambda i: abs(list_sum(d[1:i])))), 6) distance from w"""
)
def ordinal_transport(spark, sf_dir):
    b = predictions(spark, sf_dir, 10).select("vec_id", F.col("p").alias("q"))
    return predictions(spark, sf_dir).join(b, "vec_id").select("vec_id", F.round(D.earth_mover(F.col("p"), F.col("q")), 6).alias("distance"))


@query(
    P + """ select vec_id, (list_position(p, list_max(p)) - 1)::int choice, round(greatest(0.0, (9 * list_max(list_transform(p[1:9], lambda v: v / list_sum(p[1:9]))) - 1) / 8) * (1 - p[10]), 6) confidence,
round(p[1] / (p[1] + p[2] + p[10]) + p[10] / (p[1] + p[2] + p[10]) / 2, 6) noul, round(list_sum(list_transform(p[1:9], lambda v, i: v / list_sum(p[1:9]) * i)), 6) score from preds"""
)
def response_shaping(spark, sf_dir):
    """Choice with concentration, yes-or-no mass with half of unknown, expected level; the tenth candidate is unknown."""
    rows = predictions(spark, sf_dir).withColumn("known", D.normalised(F.slice("p", 1, 9))).withColumn("u", F.get("p", 9))
    return rows.select(
        "vec_id",
        F.col("pred").alias("choice"),
        F.round(D.concentration(F.col("known")) * (1 - F.col("u")), 6).alias("confidence"),
        F.round(D.shaped_boolean(F.get("p", 0), F.get("p", 1), F.col("u")), 6).alias("noul"),
        F.round(D.expected_level(F.col("known"), F.array(*[F.lit(float(i)) for i in range(1, 10)])), 6).alias("score"),
    )


@query(
    P + """, t as (select vec_id, ['boolean', 'choice', 'ordinal'][vec_id % 3 + 1] kind, case when vec_id % 3 = 0 then [p[1], p[2], 1 - p[1] - p[2]] else p end p from preds), x as (select *, vec_id % 7 = 0 and kind <> 'boolean' bad from t)
select vec_id, case when not bad then 'answered' end status, case when not bad then (list_position(p[:-2], list_max(p[:-2])) - 1)::int end answer, case when not bad then round(p[1], 6) end first, case when not bad then round(p[-1], 6) end unknown,
  case when bad then [case kind when 'choice' then 'choice' else 'score' end] else []::varchar[] end problems from x"""
)
def response_decode(spark, sf_dir):
    """Distributions shaped as responses and read back; every seventh choice or score declares another answer than its distribution's."""
    kind = F.get(F.array(*map(F.lit, ("boolean", "choice", "ordinal"))), (F.col("vec_id") % 3).cast("int"))
    two = F.array(F.get("p", 0), F.get("p", 1), 1 - F.get("p", 0) - F.get("p", 1))
    rows = predictions(spark, sf_dir).select("vec_id", kind.alias("kind"), F.when(kind == "boolean", two).otherwise(F.col("p")).alias("p"))
    wire = F.when(F.col("kind") == "boolean", "noul").when(F.col("kind") == "choice", "choice").otherwise("score")
    shaped = rows.withColumn("r", T.shaped(wire, F.col("p")))
    wrong = F.col("vec_id") % 7 == 0
    broken = F.col("r").withField("choice", F.when(wrong, (F.col("r.choice") + 1) % 9).otherwise(F.col("r.choice"))).withField("score", F.when(wrong, F.col("r.score") + 1).otherwise(F.col("r.score")))
    told = shaped.select("vec_id", T.decoded(F.col("kind"), F.size("p") - 1, broken).alias("x"))
    back = F.col("x.probabilities")
    return told.select("vec_id", "x.status", F.col("x.value").alias("answer"), F.round(F.get(back, 0), 6).alias("first"), F.round(F.element_at(back, -1), 6).alias("unknown"), "x.problems")


@query(
    P + """, t as (select vec_id, vec_id % 5 k, p from preds), w as (select *, p[1] + p[2] + p[10] m from t)
select vec_id, case when k in (0, 1, 4) then round(p[1] / m, 6) end "true", case when k in (0, 1, 4) then round(p[10] / m, 6) end unknown, case when k = 3 then ['maybe'] end unknown_keys,
  case k when 2 then ['duplicate_aliases'] when 3 then ['unknown_keys'] else []::varchar[] end problems, case when k in (0, 1, 4) then case when p[1] >= p[2] and p[1] >= p[10] then 'true' when p[2] >= p[10] then 'false' end end gold from w"""
)
def soft_targets(spark, sf_dir):
    """Weights of yes, no and unknown under the names of five exports: two of them name a key twice or one that isn't there."""
    names = [("true", "false", "__unknown__"), ("True", "False", "unknown"), ("true", "True", "null"), ("true", "maybe", "null"), ("True", "false", "null")]
    keys = F.get(F.array(*[F.array(*map(F.lit, n)) for n in names]), (F.col("vec_id") % 5).cast("int"))
    soft = F.map_from_arrays(keys, F.array(F.get("p", 0), F.get("p", 1), F.get("p", 9)))
    choices = F.array(*map(F.lit, ("true", "false", T.UNKNOWN)))
    told = predictions(spark, sf_dir).select("vec_id", T.soft_weights(soft, choices).alias("x"))
    w = F.col("x.weights")
    return told.select("vec_id", F.round(F.get(w, 0), 6).alias("true"), F.round(F.get(w, 2), 6).alias("unknown"), "x.unknown_keys", "x.problems", T.soft_gold(w, choices).alias("gold"))

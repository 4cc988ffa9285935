"""Decontamination, leakage, duplicates and evidence clusters over documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions.text import state_key
from verdigris.operators import graph, similarity
from verdigris.plans.registry import query, table

D = {"id": "doc_id", "text": "text"}
DB = D | {"bench_id": "item_id", "bench_text": "text"}

TOKENS = "regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"
GRAMS = "list_distinct(list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(w[i:i+{n}-1], ' ')))"


def grams_sql(n: int) -> str:
    t = TOKENS.format(x="text")
    g = GRAMS.format(n=n)
    return f"""with dw as (select doc_id, source, {t} w from documents), bw as (select item_id, {t} w from benchmark),
dg as (select doc_id, source, {g} g from dw), bg as (select item_id, {g} g from bw),
d as (select doc_id, source, len(g) u, unnest(g) gram from dg), b as (select item_id, len(g) v, unnest(g) gram from bg),
pairs as (select doc_id, item_id, count(*) shared, greatest(count(*) / any_value(u), count(*) / any_value(v)) share from d join b using (gram) group by all)"""


@query(grams_sql(13) + " select doc_id, item_id, shared, round(share, 6) share from pairs where share > 0.5")
def near_dup_13gram(spark, sf_dir):
    found = similarity.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13, **DB)
    return found.where("share > 0.5").withColumn("share", F.round("share", 6))


LINES = f"""dl as (select doc_id, {TOKENS.format(x='l')} w from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) l from documents)),
bl as (select item_id, {TOKENS.format(x='l')} w from (select item_id, unnest(string_split(coalesce(text, ''), chr(10))) l from benchmark)),
lm as (select distinct doc_id, item_id from dl join bl using (w) where len(w) >= 6), sm as (select distinct doc_id, item_id from dw join bw using (w) where len(w) >= 3)"""


@query(f"with dw as (select doc_id, {TOKENS.format(x='text')} w from documents), bw as (select item_id, {TOKENS.format(x='text')} w from benchmark), {LINES} select doc_id, item_id, false template from lm")
def exact_field_match(spark, sf_dir):
    return similarity.line_match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), **DB)


@query(f"with dw as (select doc_id, {TOKENS.format(x='text')} w from documents), bw as (select item_id, {TOKENS.format(x='text')} w from benchmark), {LINES} select doc_id, item_id from sm")
def exact_state_match(spark, sf_dir):
    return similarity.sequence_match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 3, **DB)


@query(
    grams_sql(13)
    + f""", {LINES}, r as (select doc_id, case when share > 0.5 then 'near_dup' else 'shared_gram' end reason from pairs union select doc_id, 'field' from lm union select doc_id, 'state' from sm),
g as (select doc_id, list_sort(list(distinct reason)) rs from r group by doc_id)
select doc_id, case when rs is null then 'keep' when list_has_any(rs, ['near_dup', 'field', 'state']) then 'drop' else 'flag' end verdict, coalesce(array_to_string(rs, ','), '') reasons from documents left join g using (doc_id)"""
)
def decontam_verdict(spark, sf_dir):
    return similarity.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13, **DB)


@query(grams_sql(8) + " select doc_id, count(distinct gram) shared from d where gram in (select gram from b) group by doc_id having count(distinct gram) >= 2")
def ngram8_lint(spark, sf_dir):
    grams = similarity.gram_table(table(spark, sf_dir, "documents"), "doc_id", "text", 8)
    known = similarity.gram_table(table(spark, sf_dir, "benchmark"), "item_id", "text", 8).select("gram").distinct()
    return grams.join(known, "gram", "left_semi").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("shared")).where("shared >= 2")


@query(
    grams_sql(13)
    + f""", {LINES}, l8 as (select doc_id, count(distinct gram) n from ({grams_sql(8)} select doc_id, gram from d where gram in (select gram from b)) group by doc_id),
short as (select distinct doc_id, item_id from (select doc_id, {TOKENS.format(x='l')} w from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) l from documents)) x
  join (select item_id, {TOKENS.format(x='l')} w from (select item_id, unnest(string_split(coalesce(text, ''), chr(10))) l from benchmark)) y using (w) where len(w) between 3 and 5)
select lang, source, count(*) records, count(a.doc_id) any_gram, count(a.doc_id) filter (a.share > 0.5) near_dup, count(l8.doc_id) filter (l8.n >= 2) two_8grams, count(e.doc_id) exact, count(f.doc_id) short_line
from documents left join (select doc_id, max(share) share from pairs group by doc_id) a using (doc_id) left join l8 using (doc_id)
left join (select distinct doc_id from (select doc_id from lm union all select doc_id from sm)) e using (doc_id) left join (select distinct doc_id from short) f using (doc_id) group by lang, source"""
)
def contamination_by_task(spark, sf_dir):
    """By language and source: any shared 13-gram, near-duplicates, two or more shared 8-grams, exact lines or texts, and lines of 3 to 5 words."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return similarity.contamination(docs, items, ["lang", "source"], **DB)


CLASSES = f"""with w as (select doc_id, source, n_chars, {TOKENS.format(x='text')} w from documents),
g as (select doc_id, source, n_chars, list_sort({GRAMS.format(n=13)}) g from w), r as (select min(doc_id) rep, g from g where len(g) > 0 group by g),
m as (select doc_id, source, n_chars, rep from g join r using (g)), d as (select rep, len(g) u, unnest(g) gram from r),
p as (select x.rep a, y.rep b, count(*) shared, greatest(count(*) / any_value(x.u), count(*) / any_value(y.u)) share from d x join d y on x.gram = y.gram and x.rep < y.rep group by all having share > 0.5
  union all select rep, rep, len(g), 1.0 from r)"""


@query(
    CLASSES
    + """ select a, b, shared, round(share, 6) share, count(*) links from p join m x on x.rep = a join m y on y.rep = b and x.source <> y.source and (a <> b or x.doc_id < y.doc_id) group by all"""
)
def cross_source_near_dup_pairs(spark, sf_dir):
    """Pairs of the smallest records with their n-grams; ``first_with_grams`` has what each stands for."""
    pairs, _ = similarity.near_duplicate_pairs(table(spark, sf_dir, "documents"), **D, source="source")
    return pairs.withColumn("share", F.round("share", 6))


@query(CLASSES + " select doc_id, rep from m")
def first_with_grams(spark, sf_dir):
    return similarity.gram_members(table(spark, sf_dir, "documents"), 13, **D).select(F.col("id").alias("doc_id"), "rep")


@query(
    CLASSES.replace("with w as", "with recursive w as")
    + """, l as (select x.doc_id i, y.doc_id j, share, x.n_chars > y.n_chars or (x.n_chars = y.n_chars and x.doc_id < y.doc_id) first, x.n_chars cx, y.n_chars cy
  from p join m x on x.rep = a join m y on y.rep = b and x.source <> y.source and (a <> b or x.doc_id < y.doc_id)),
o as (select row_number() over (order by share desc, greatest(cx, cy) desc, w, least(cx, cy) desc, l) k, w, l from (select *, case when first then i else j end w, case when first then j else i end l from l)),
run(k, lost) as (select 0::bigint, []::bigint[] union all select o.k, case when list_contains(run.lost, o.w) or list_contains(run.lost, o.l) then run.lost else list_append(run.lost, o.l) end from run join o on o.k = run.k + 1)
select doc_id, source, lang, n_chars from documents where doc_id not in (select unnest(lost) from run where k = (select max(k) from run))"""
)
def cross_source_dedup_survivors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = similarity.near_duplicate_survivors(docs, **D, source="source", score=F.col("n_chars"))
    return kept.select("doc_id", "source", "lang", "n_chars")


@query(
    grams_sql(8)
    + """, e as (select x.doc_id, y.doc_id earlier, count(*) shared from d x join d y on x.gram = y.gram and y.doc_id < x.doc_id group by all having count(*) >= 5)
select doc_id, min(earlier) earlier, arg_min(shared, earlier) shared from e group by doc_id"""
)
def earlier_doc_8gram_dups(spark, sf_dir):
    return similarity.earlier_duplicates(table(spark, sf_dir, "documents"), 8, 5, **D)


CODE_SQL = f"""with v as (select doc_id, {TOKENS.format(x='text')} w from documents), t as (select doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i+2], ' '))) w from v), h as (select doc_id, ('0x' || sha256(w)[1:15])::bigint h from t),
s as (select doc_id, {' + '.join(f'case when 2 * count_if((h >> {b}) & 1 = 1) > count(*) then {1 << b} else 0 end' for b in range(60))} code from h group by doc_id),
c as (select doc_id, coalesce(code, 0)::bigint code from documents left join s using (doc_id)), k as (select code, min(doc_id) id, count(*) n from c group by code)"""


@query(CODE_SQL + " select x.id a, y.id b, bit_count(xor(x.code, y.code))::int distance, x.n copies_a, y.n copies_b from k x join k y on (x.id < y.id and bit_count(xor(x.code, y.code)) <= 6) or (x.id = y.id and x.n > 1)")
def hamming_pairs(spark, sf_dir):
    """60-bit codes of whole texts, in place of an image's difference hash."""
    return similarity.hamming_pairs(similarity.bit_codes(table(spark, sf_dir, "documents"), **D), "doc_id", "code", 6, width=60)


LEAK_SQL = f"""with t as (select doc_id, {TOKENS.format(x='text')} w, text, lang || ':' || (doc_id % 97) family, doc_id % 5 = 0 held from documents),
g as (select doc_id, held, {GRAMS.format(n=13)} g from t), u as (select doc_id, held, len(g) u, unnest(g) gram from g),
near as (select x.doc_id, y.doc_id held_id, 'near_dup' reason from u x join u y on x.gram = y.gram and not x.held and y.held group by x.doc_id, y.doc_id having greatest(count(*) / any_value(x.u), count(*) / any_value(y.u)) > 0.5),
k as (select distinct doc_id, held, {TOKENS.format(x='l')} w from (select doc_id, held, unnest(string_split(coalesce(text, ''), chr(10))) l from t)), ln as (select * from k where len(w) >= 6),
often as (select w, count(*) >= 50 template from ln where held group by w),
field as (select x.doc_id, y.doc_id held_id, 'field' reason from ln x join ln y on x.w = y.w and not x.held and y.held join often on often.w = x.w group by all having not bool_and(template)),
state as (select x.doc_id, y.doc_id held_id, 'state' reason from t x join t y on x.w = y.w and not x.held and y.held and len(x.w) >= 3),
fam as (select t.doc_id, f.held_id, 'family' reason from t join (select family, min(doc_id) held_id from t where held group by family) f using (family) where not held)
select * from near union select * from field union select * from state union select * from fam"""


@query(LEAK_SQL)
def leakage_gate(spark, sf_dir):
    """Every fifth document is held out; families are made of languages and ids."""
    docs = table(spark, sf_dir, "documents").withColumn("family", F.concat_ws(":", "lang", (F.col("doc_id") % 97).cast("string")))
    return similarity.leakage(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0"), "family", **D)


@query(
    f"""with w as (select doc_id, source, list_distinct({TOKENS.format(x='text')}) w from documents), b as (select item_id, list_distinct({TOKENS.format(x='text')}) w from benchmark),
d as (select doc_id, len(w) u, unnest(w) t from w), i as (select item_id, len(w) v, unnest(w) t from b)
select doc_id, item_id, round(count(*) / (any_value(u) + any_value(v) - count(*)), 6) jaccard from d join i using (t) group by all having count(*) / (any_value(u) + any_value(v) - count(*)) >= 0.3"""
)
def jaccard_with_items(spark, sf_dir):
    """Documents and items whose sets of words are alike to 0.3 or more."""
    return similarity.jaccard_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 0.3, **DB).withColumn("jaccard", F.round("jaccard", 6))


KEY = "sha256(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')))"


@query(f"with k as (select doc_id, source, {KEY} key, case source when 'src0' then 3 when 'src1' then 2 else 1 end p from documents) select doc_id, source from k qualify p = max(p) over (partition by key)")
def dedup_by_partition_priority(spark, sf_dir):
    priority = F.when(F.col("source") == "src0", 3).when(F.col("source") == "src1", 2).otherwise(1)
    return similarity.partition_priority(table(spark, sf_dir, "documents"), state_key(F.col("text")), priority).select("doc_id", "source")


@query(f"with k as (select doc_id, {KEY} key from documents) select min(doc_id) doc_id, key from k group by key")
def first_occurrence(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", state_key(F.col("text")).alias("key"))
    return similarity.first_of(keyed, ["key"], [F.col("doc_id")])


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_row(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return similarity.first_of(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(
    f"with recursive k as (select doc_id, {KEY} key from documents), e as (select x.doc_id a, y.doc_id b from k x join k y using (key)), "
    "r(doc_id, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on e.a = r.doc_id) select doc_id, min(c) cluster_id from r group by doc_id"
)
def evidence_clusters(spark, sf_dir):
    """Records and the evidence they share form a bipartite graph; each record's cluster is the smallest record it reaches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", state_key(F.col("text")).alias("key"))
    anchor = docs.groupBy("key").agg(F.min("doc_id").alias("a"))
    edges = docs.join(anchor, "key").select("doc_id", "a")
    return graph.connected_components(edges, "doc_id", "a").withColumnsRenamed({"node": "doc_id", "component": "cluster_id"})


@query(
    "with recursive p as (select conv_id, case when conv_id % 7 = 0 then null else conv_id - 7 end parent from (select distinct conv_id from conversations)), "
    "r(conv_id, root, depth) as (select conv_id, conv_id, 0 from p where parent is null or parent < 0 or parent not in (select conv_id from p) union all select p.conv_id, r.root, r.depth + 1 from p join r on p.parent = r.conv_id) "
    "select conv_id, root, depth from r"
)
def family_roots(spark, sf_dir):
    """Chains of parents: a conversation's parent is the one seven before it, unless its id is divisible by seven."""
    convs = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    parents = convs.withColumn("parent", F.when(F.col("conv_id") % 7 != 0, F.col("conv_id") - 7))
    return graph.family_roots(parents, "conv_id", "parent")


@query(
    """with t as (select conv_id, turn, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) k from conversations),
f as (select conv_id, min(turn) first_turn from t group by 1), o as (select t.conv_id, k from t join f on t.conv_id = f.conv_id and turn = first_turn)
select t.conv_id, count(*) variants, count_if(t.k = o.k) same, count_if(t.k <> o.k) changed from t join f using (conv_id) join o using (conv_id) where turn > first_turn group by 1"""
)
def contrast_metrics(spark, sf_dir):
    """Original (first turn) against its variants (later turns) of a set."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")).alias("k"))
    first = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "k")).alias("o"))
    joined = rows.join(first, "conv_id").where("turn > o.turn")
    return joined.groupBy("conv_id").agg(F.count("*").alias("variants"), F.count_if(F.col("k") == F.col("o.k")).alias("same"), F.count_if(F.col("k") != F.col("o.k")).alias("changed"))


@query(
    """with c as (select conv_id, role, count(*) m from conversations group by all), b as (select conv_id, sum(m) n, max(m) best, count(*) kinds from c group by 1)
select count(*) sets, round(sum(best) / sum(n), 6) baseline, count_if(kinds = 1) solvable from b"""
)
def constant_baseline(spark, sf_dir):
    """The best constant answer per set, the label being the role."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("m"))
    b = c.groupBy("conv_id").agg(F.sum("m").alias("n"), F.max("m").alias("best"), F.count("*").alias("kinds"))
    return b.agg(F.count("*").alias("sets"), F.round(F.sum("best") / F.sum("n"), 6).alias("baseline"), F.count_if(F.col("kinds") == 1).alias("solvable"))


@query(
    "with c as (select role, length(text) % 5 g, conv_id % 2 v, count(*) m from conversations group by all), t as (select role, g, sum(m) n, sum(m * (m - 1) / 2) s from c group by all) select role, g, (n * (n - 1) / 2)::bigint pairs, (n * (n - 1) / 2 - s)::bigint opposite from t"
)
def sibling_pairs(spark, sf_dir):
    """Pairs of rows of one question and how many have opposite labels, from counts rather than from the pairs."""
    c = table(spark, sf_dir, "conversations").groupBy("role", (F.length("text") % 5).alias("g"), (F.col("conv_id") % 2).alias("v")).agg(F.count("*").alias("m"))
    t = c.groupBy("role", "g").agg(F.sum("m").alias("n"), F.sum(F.expr("m * (m - 1) div 2")).alias("s"))
    return t.select("role", "g", F.expr("n * (n - 1) div 2").alias("pairs"), F.expr("n * (n - 1) div 2 - s").alias("opposite"))

"""The queries of these operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from verdigris.session import ship_package
from verdigris.storage import materialise, scratch_path, spread

#: Whether a document's labels are kept from learning; a null id has no remainder and is not held out.
HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, false)"


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    ship_package(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import bpe

    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    coded = bpe.encode_digests(docs, "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "coded.n_tokens", "coded.ids_sha256", "coded.decoded_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import toxicity

    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    labels = _read(spark, sf_dir, "labels", "doc_id", "toxic").where(f"not ({HELD_OUT})")
    scored = toxicity.with_score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import url_filter

    return url_filter.judge_urls(_read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES()).select("page_id", "host", "path", "rule", "verdict")


def URL_RULES() -> list:
    from verdigris.llm.url_filter import PATTERN_RULES, host_rule

    return [host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"), *PATTERN_RULES]


URL_SQL = r"""
with a as (select page_id, case when contains(url, '://') then url[instr(url, '://') + 3:] else '' end rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from a),
c as (select *, case
  when ('.' || host) like '%.example.net' and path like '/en/%' then 'example.net/en/'
  when ('.' || host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
  when ('.' || host) like '%.org' and path like '/fr/%' then 'org/fr/'
  when ('.' || host) like '%.net' and path like '/%' then 'net/' end rule from b)
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
  when regexp_matches(host, '(^|[.-])(adult|bets|betting|casino|escort|jackpot|phishing|pills|poker|porn|sex|spam|torrent|viagra|warez|xxx)([.-]|$)') then 'block'
  when regexp_matches(host || path, '^.*/wp-admin/.*\.php$|^.*/track/click/.*$|^ads\..*/banner/.*$') then 'block' else 'allow' end verdict
from c
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import warc

    return warc.archive_and_read(_read(spark, sf_dir, "pages", "page_id", "html"))


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import ann

    rows = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(rows, rows.where("vec_id % 100 = 0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import simhash

    return simhash.simhash_components(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import edit_fingerprint

    return edit_fingerprint.compare_edited(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import packing

    return packing.pack_documents(_read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: inserts with the length-based estimate, their revision to the tokenizer's
    counts (sent twice, as after a lost acknowledgement), and the deletion of exact copies of a smaller id's text."""
    from verdigris.llm import bpe
    from verdigris.llm.token_ledger import TokenLedger

    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang").withColumn("version", F.lit("byte_bpe_50k"))
    ledger = TokenLedger(spark, scratch_path(spark, "ledger"))
    ledger.apply("001-arrivals", inserts=docs.withColumn("tokens", F.ceil(F.length(F.coalesce("text", F.lit(""))) / 3.2)))
    exact = materialise(bpe.count_tokens(docs.select("doc_id", "version", "text"), "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "tokens").select("doc_id", "version", "tokens", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")), "counts")
    for _ in range(2):
        ledger.apply("002-exact-counts", revised=exact)
    # copies are told by the ids that are nobody's copy, so that no text's hash meets its rows again
    first = exact.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    ledger.apply("003-copies", deletes=exact.join(first, "doc_id", "left_anti").select("doc_id", "version"))
    ledger.vacuum()
    return ledger.totals()


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import secret_scan

    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train_forest(secret_scan.labelled_findings(spark)))
    return found.select("doc_id", "scan.candidates", F.size("scan.findings").alias("secrets"), F.transform("scan.findings", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("spans"), F.sha2("scan.redacted", 256).alias("redacted_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import token_alignment

    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return token_alignment.align_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import embedding_dedup

    return embedding_dedup.near_duplicate_vectors(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import source_divergence

    return source_divergence.divergence(_read(spark, sf_dir, "documents", "text", "lang", "source"))


DIVERGENCE_SQL = r"""
with d as (select row_number() over () id, coalesce(text, '') text, coalesce(lang, '') lang, coalesce(source, '') source from documents),
w as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
kept as (select lang, term from w group by lang, term having count(distinct id) >= 30),
g as (select distinct lang, source from d),
v as (select lang, count(*) v from kept group by lang),
c as (select lang, source, term, count(*) n from w group by all),
cells as (select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint n, v.v from g join kept k using (lang) join v using (lang) left join c using (lang, source, term)),
p as (select *, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v)::hugeint p from cells),
l as (select lang, term, sum(n)::hugeint n, any_value(v) v from cells group by lang, term),
q as (select lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang) + 5 * v)::hugeint q from l),
pairs as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
found as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0) f from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select p.lang, p.source, 'term', p.term, p.p - q.q from p join q using (lang, term) where p.n > 0 and p.p > q.q)
select lang, source, part, item, f::bigint "value", (row_number() over (partition by lang, source, part order by f desc, item))::int rank from found
qualify part = 'pair' or rank <= 50
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_toxicity,
        op3_url_filter,
        op4_warc,
        op5_prefix_forest,
        op6_simhash,
        op7_edit_fingerprint,
        op8_best_two_fit,
        op9_token_counts,
        op10_secret_scan,
        op11_token_alignment,
        op12_embedding_dedup,
        op13_source_divergence,
    )
}
SQL: dict[str, str] = {"op3_url_filter": URL_SQL, "op13_source_divergence": DIVERGENCE_SQL}

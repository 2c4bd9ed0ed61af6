"""The registered queries of this subpackage, and the SQL of those that SQL can say."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, exact, forest, language, lines, mixing, near, negatives, packing, suffix, urls, warc
from .common import store, text_key, text_of

TOKENIZER = "word_bpe_49k.json"


def tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha_text(c: str):
    return F.sha2(F.encode(text_of(c), "UTF-8"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer(), with_text=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha_text("text").alias("kept_sha256"))


def op3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved(warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages"))))


def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.keep_longest(table(spark, sf_dir, "documents"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = suffix.strip_repeats(docs).select(
        "key", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", text_key().alias("key")).join(found, "key").drop("key")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    model = language.fit(docs.filter(~held).select("text", "lang"))
    return (docs.select("doc_id", held, language.identify(F.col("text"), model, spark).alias("f"))
            .select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score")))


RULES = [urls.host_rule("net/", "block"), urls.host_rule("example.net/en/", "allow"),
         urls.host_rule("example.com/de/", "block"), urls.host_rule("org/fr/", "allow"),
         # for urls that no listed rule fits
         *(urls.pattern_rule(f"{word} host", "block", rf"^([^/]*[.-])?{word}[.-]", word) for word in ("adserver", "doubleclick", "casino"))]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.encode("groups", "UTF-8"), 256)).alias("groups_sha256")
    rows = store(align.align(table(spark, sf_dir, "documents"), *files).select("doc_id", "n_a", "n_b", "n_groups", groups, "pairs", "times"))
    return align.score(rows, *files).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    return {f.__name__: f for f in (op1_bpe, op2_lines, op3_forest, op4_warc, op5_near, op6_packing, op7_exact, op8_suffix,
                                    op9_language, op10_urls, op11_mixing, op12_negatives, op13_align)} | {"pipeline": run}


LINES_SQL = r"""
with l as (
  select doc_id, unnest(range(1, len(s) + 1)) as at, unnest(s) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents)),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as top from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, f.key is not null and k.doc_id < f.top as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by "at") filter (where not gone), '')) as kept_sha256
from m group by doc_id"""

WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as n, sha256(html) as digest from p),
w as (select *, min(page_id) over (partition by digest) as first from d)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id <> first then first end as refers_to from w"""

EXACT_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare from documents),
w as (select doc_id, bare, count(*) over (partition by bare) as group_size,
             first_value(doc_id) over (partition by bare order by chars desc, doc_id) as keep_id from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(bare) as text_sha256 from w"""

URLS_SQL = r"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path from pages),
r(rule, verdict, rhost, rpath) as (values ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
m as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
      from u join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select u.page_id, host, path, m.rule,
       coalesce(m.verdict, case when regexp_matches(host || path, '^([^/]*[.-])?(adserver|doubleclick|casino)[.-]') then 'block' else 'allow' end) as verdict
from u left join m using (page_id)"""


NEGATIVES_SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label as own, c.vec_id, c.label,
         cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) as bigint) as score
  from r a join r c on c.vec_id <> a.vec_id where a.vec_id % 50 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where label = own
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over w as int) as rank, s.vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and label <> own and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, s.vec_id)
qualify row_number() over w <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op2_lines": LINES_SQL, "op4_warc": WARC_SQL, "op7_exact": EXACT_SQL, "op10_urls": URLS_SQL, "op12_negatives": NEGATIVES_SQL}

"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graderoom.llm import exact, quality, warc
from graderoom.llm.clusters import CLUSTERS, DIMS, ROUNDS, SCALE, cluster_vectors, with_inertia
from graderoom.llm.clusters import SEED as CLUSTER_SEED
from graderoom.llm.common import materialise, table
from graderoom.llm.decontaminate import find_leaks
from graderoom.llm.lexical import TOP, rank_documents
from graderoom.llm.lm import score_documents
from graderoom.llm.mixing import SEED as MIX_SEED
from graderoom.llm.mixing import TEMPERATURE, mix_sources
from graderoom.llm.neardup import near_duplicates
from graderoom.llm.preference import preferences_from_turns
from graderoom.llm.sharding import SHARDS, interleave
from graderoom.llm.tokens import encode_documents
from graderoom.llm.urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The rules that the url query judges by (host, path, verdict).
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


@query("op1_packed_tokens")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_prefix_doubling")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.summarise(exact.remove_repeats(table(spark, sf_dir, "documents"), exact.THRESHOLD))


@query("op3_deleted_interpolation")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@query("op6_robust_outliers")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.with_statistics(table(spark, sf_dir, "documents"))
    slim = materialise(stats.select("doc_id", "lang", "source", "_q", "base_failed", "_x"), "quality-statistics")
    return quality.judge(slim, quality.estimate(slim)).select(
        "doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words",
        "base_failed", "kept", F.round("distance", 3).alias("distance"))


@query("op4_simhash_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.withColumn("similarity", F.round("similarity", 4))


@query("op5_interleave_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")


OP7_SQL = f"""
with docs as (
  select doc_id, coalesce(source, '') as source, coalesce(doc_id::varchar, md5(coalesce(text, ''))) as name,
    row_number() over () as r from documents),
sizes as (
  select source, count(*) as n, pow(count(*)::double, {TEMPERATURE}) as w from docs group by source),
rates as (
  select source, w / (select sum(w) from sizes) * (select sum(n) from sizes) / n as rate from sizes),
terms as (
  select source, rate, k, case when k = 0 then 0.0 else ln(k::double) end as l
  from rates, lateral (select unnest(range(0, ceil(rate + sqrt(rate) * 10 + 20)::bigint + 1)) as k)),
logs as (
  select source, rate, k, sum(l) over (partition by source order by k) as fact from terms),
cdf as (
  select source, k, sum(exp(k * ln(rate) - rate - fact)) over (partition by source order by k) as c from logs),
draws as (
  select r, doc_id, name, source,
    (('0x' || substr(md5('{MIX_SEED}:' || name), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from docs),
counts as (
  select r, doc_id, name, d.source, count(*)::int as n_copies
  from draws d join cdf on d.source = cdf.source and cdf.c <= d.u group by r, doc_id, name, d.source)
select doc_id, source, n_copies, copy::int as copy,
  substr(md5('{MIX_SEED + 1}:' || name || ':' || copy::varchar), 1, 16) as shuffle_key
from counts, lateral (select unnest(range(1, n_copies + 1)) as copy)
"""


@query("op7_poisson_mix", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_copies", "copy", "shuffle_key")


OP9_SQL = """
with t as (
  select conv_id, coalesce(turn, -4611686018427387904) as turn, coalesce(role, 'unknown') as role,
    coalesce(text, '') as text from conversations),
c as (
  select conv_id, list({'role': role, 'text': text} order by turn, role, text) as turns from t group by conv_id),
h as (
  select conv_id, turns, list_transform(turns, lambda x: md5(x.role || chr(10) || x.text)) as hs from c),
o as (
  select conv_id, turns, row_number() over (
    order by array_to_string(hs[1:3], ''), md5(array_to_string(hs, '')), conv_id) - 1 as pos from h),
i as (
  select pos // 2 as pair_id, min(conv_id) as chosen_id,
    case when count(*) > 1 then max(conv_id) end as rejected_id from o group by pos // 2),
e as (
  select conv_id, list_transform(turns, lambda x: {
    'role': replace(x.role, '<|', '< |'), 'text': replace(x.text, '<|', '< |')}) as turns from c),
p as (
  select i.*, a.turns as ch, coalesce(b.turns, a.turns[1:0]) as rj
  from i join e a on a.conv_id = i.chosen_id left join e b on b.conv_id = i.rejected_id),
q as (
  select *, coalesce((select min(k) from (select unnest(range(1, greatest(len(ch), len(rj)) + 1)) as k)
    where k > len(ch) or k > len(rj) or ch[k].role <> rj[k].role or ch[k].text <> rj[k].text) - 1,
    len(ch)) as n from p),
r as (
  select pair_id, chosen_id, rejected_id, n,
    array_to_string(list_transform(ch[1:n], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') as prompt,
    array_to_string(list_transform(ch[n+1:], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') as chosen_text,
    array_to_string(list_transform(rj[n+1:], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') as rejected_text,
    coalesce(list_sum(list_transform(ch[n+1:], lambda x: case when x.role = 'assistant' then length(x.text) else 0 end)), 0) as nc,
    coalesce(list_sum(list_transform(rj[n+1:], lambda x: case when x.role = 'assistant' then length(x.text) else 0 end)), 0) as nr
  from q)
select pair_id, chosen_id, rejected_id, n::int as n_common, md5(prompt) as prompt_md5, md5(chosen_text) as chosen_md5,
  md5(rejected_text) as rejected_md5, nc::bigint as chosen_learned, nr::bigint as rejected_learned from r
"""


@query("op8_minmax_neardup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_preference_pairs", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    def learned(spans: str):
        return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])

    rows = preferences_from_turns(table(spark, sf_dir, "conversations"))
    return rows.select(
        "pair_id", "chosen_id", "rejected_id", "n_common",
        F.md5("prompt").alias("prompt_md5"), F.md5("chosen_text").alias("chosen_md5"),
        F.md5("rejected_text").alias("rejected_md5"),
        learned("chosen_spans").alias("chosen_learned"), learned("rejected_spans").alias("rejected_learned"))


OP10_SQL = r"""
with rules(host, path, verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as raw, coalesce(rest, '') as rest from parts),
parsed as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from split),
fits as (
  select page_id, arg_max(r.host || r.path, length(r.host || r.path)) as rule,
    arg_max(r.verdict, length(r.host || r.path)) as verdict
  from parsed p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  group by page_id)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parsed p left join fits f on p.page_id = f.page_id
"""


@query("op10_url_rules", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(str(rule) for rule in URL_RULES)
    rules = spark.sql(f"select * from values {rows} as rules(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def _terms_sql(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


OP11_SQL = f"""
with docs as materialized (
  select row_number() over () as d, doc_id, {_terms_sql('text')} as terms from documents),
corpus as (
  select count(*)::bigint as n, sum(len(terms))::bigint as l from docs where len(terms) > 0),
postings as materialized (
  select d, term, count(*) as tf from (select d, unnest(terms) as term from docs) group by d, term),
weights as (
  select term, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from postings, corpus group by term, n),
lengths as (
  select d, doc_id, 50 + (50 * len(terms) * n) // l as m from docs, corpus where len(terms) > 0),
items as (
  select i, item_id, unnest(list_distinct(terms)) as term
  from (select row_number() over () as i, item_id, {_terms_sql('text')} as terms from benchmark)),
scores as (
  select i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from items join postings using (term) join weights using (term) join lengths using (d) group by i, item_id, d, doc_id),
ranked as (
  select *, row_number() over (partition by i order by score desc, doc_id nulls last) as r from scores where score > 0)
select item_id, r::int as rank, doc_id, score from ranked where r <= {TOP}
"""


@query("op11_block_max_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _cluster_sql() -> str:
    """One CTE for the assignment and one for the means of every round."""
    def assigned(r: int) -> str:
        return f"""
a{r} as materialized (
  select p, any_value(vec_id) as vec_id, any_value(v) as v, arg_min(c, (d, c)) as c, min(d) as d from (
    select p, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from points, c{r}) group by p)"""

    def moved(r: int) -> str:
        return f"""
s{r} as (
  select c, i, sum(x)::hugeint as s, count(*)::hugeint as n from (select c, unnest(v) as x, unnest(range(1, {DIMS} + 1)) as i from a{r - 1})
  group by c, i),
f{r} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as m from s{r} group by c),
c{r} as materialized (select o.c, coalesce(f.m, o.m) as m from c{r - 1} o left join f{r} f on o.c = f.c)"""

    rounds = ",".join(f"{moved(r)},{assigned(r)}" for r in range(1, ROUNDS + 1))
    return f"""
with points as materialized (
  select row_number() over () as p, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMS}),
c0 as materialized (
  select (row_number() over (order by h, vec_id, v) - 1)::int as c, v as m from (
    select sha256('{CLUSTER_SEED}:' || coalesce(vec_id::varchar, '')) as h, vec_id, v from points order by h, vec_id, v limit {CLUSTERS})),
{assigned(0).strip()},{rounds}
select vec_id, a.c as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia,
  (sum(d) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} k on a.c = k.c
"""


@query("op12_bisector_tournament", _cluster_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    return with_inertia(assigned, centroids)


OP13_SQL = f"""
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
b as (
  select page_id, n, sha1(html) as digest,
    case when n >= {warc.LEAST_BYTES} then max(page_id) over (partition by html) end as best from p)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when best is distinct from page_id and best is not null then 'revisit' else 'response' end as record_type,
  case when best is distinct from page_id then best end as refers_to from b
"""


@query("op13_warc_archives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(warc.write_archives(table(spark, sf_dir, "pages")))

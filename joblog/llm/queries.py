"""One thin query per operator over its whole table; SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from joblog.llm import bpe, chat, clusters, embeddings, exact, language, lines, mixing, quality, repeats, sharding, simhash, whitening
from joblog.llm.common import table
from joblog.session import configure


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(configure(spark), sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(table(configure(spark), sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(configure(spark), sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(configure(spark), sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(configure(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    text = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    return chat.chat_report(turns.unionByName(own))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_report(table(configure(spark), sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines_report(table(configure(spark), sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(configure(spark), sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(configure(spark), sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(configure(spark), sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_report(table(configure(spark), sf_dir, "embeddings"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_report(table(configure(spark), sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(table(configure(spark), sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_language, op2_bpe, op3_quality, op4_mixing, op5_chat, op6_repeats, op7_lines, op8_simhash, op9_embeddings, op10_sharding, op11_clusters, op12_exact, op13_whitening)
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in named}


SQL = {
    "op3_quality": r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
g as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g
  from w),
d as (select doc_id, i, count(*) over (partition by doc_id, g) as n from g),
r as (
  select doc_id, count(distinct i + k) as n_repeat_words
  from d, (values (0), (1), (2)) as o(k) where n > 1 group by doc_id),
s as (
  select w.doc_id, len(w)::bigint as n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         len(l) as n_lines, len(regexp_replace(text, '\P{L}+', '', 'g')) as letters
  from w left join r using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (10 * n_symbols > word_chars or 10 * n_dup_lines > 3 * n_lines or 2 * letters < word_chars) as kept
from b""",
    "op5_chat": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (
  select *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') as et,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':' || chr(10), '\c') as er
  from t)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(len(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(14 + len(er) + len(et))::bigint as formatted_chars
from e group by conv_id""",
}


SQL["op12_exact"] = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from t"""


def clusters_sql(rounds: int = clusters.ROUNDS) -> str:
    """Rounds of assignment and exact floors, one pair of CTEs a round; tied vectors of a centroid draw by id alone."""
    assign = """
a{r} as materialized (
  select vec_id, x, min_by(cluster, struct_pack(d, cluster)) as cluster, min(d) as distance
  from (select v.vec_id, v.x, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.c[i]) * (v.x[i] - c.c[i])))::bigint as d from v, c{r} as c)
  group by vec_id, x)"""
    move = """
c{n} as materialized (
  with s as (
    select cluster, i, sum(x[i])::bigint as s, count(*) as n from a{r}, range(1, 65) as g(i) group by cluster, i),
  m as (select cluster, list((s - ((s % n) + n) % n) // n order by i) as c from s group by cluster)
  select k.cluster, coalesce(m.c, k.c) as c from c{r} as k left join m using (cluster))"""
    parts = []
    for r in range(rounds + 1):
        parts.append(assign.format(r=r))
        if r < rounds:
            parts.append(move.format(r=r, n=r + 1))
    return f"""
with v as materialized (
  select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = 64),
c0 as materialized (
  select row_number() over (order by sha256('2:' || vec_id)) - 1 as cluster, x as c from v order by sha256('2:' || vec_id) limit 40),{",".join(parts)}
select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
       sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{rounds} join c{rounds} as c using (cluster)"""


SQL["op11_clusters"] = clusters_sql()


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

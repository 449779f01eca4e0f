"""Registered queries of the training-data operators: name -> (function, DuckDB text or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.llm import (
    decontamination,
    embedding_copies,
    hard_negatives,
    languages,
    packing,
    search,
    secrets,
    sharding,
    simhash,
    substrings,
    token_counts,
    toxicity,
    whitening,
)
from formline.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir):
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), with_ids=False)


def op3_languages(spark, sf_dir):
    return languages.held_out_languages(table(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir):
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op5_sharding(spark, sf_dir):
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_search(spark, sf_dir):
    vectors = search.integers(table(spark, sf_dir, "embeddings"))
    return search.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op7_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark, sf_dir):
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op9_substrings(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op10_token_counts(spark, sf_dir):
    import public_tokenizers
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_embedding_copies(spark, sf_dir):
    return embedding_copies.near_copies(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", changed)
    return hard_negatives.hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score
from pairs qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10
"""

OP9_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
p as (select doc_id, words, unnest(range(1, len(words) + 1)) as i from d),
w as (select doc_id, i, words[i] as word,
             case when i + 34 <= len(words) then sha256(array_to_string(words[i:i + 34], ' ')) end as win from p),
c as (select doc_id, i, word, win is not null and count(*) over (partition by win) > 1 as repeated from w),
k as (select doc_id, i, word,
             max(repeated::int) over (partition by doc_id order by i rows between 34 preceding and current row) as gone
      from c),
s as (select doc_id, count(*) as n_words, sum(gone)::bigint as n_removed,
             sha256(coalesce(string_agg(word, ' ' order by i) filter (gone = 0), '')) as kept_sha256
      from k group by doc_id)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(s.n_removed, 0)::bigint as n_removed,
       coalesce(s.kept_sha256, sha256('')) as kept_sha256
from d left join s on d.doc_id = s.doc_id
"""

OP12_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b
  on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
n as (select a, count(*) as n_links from links group by a),
c as (select a, min(b) as least from reach group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(least, vec_id) as component_id,
       coalesce(least, vec_id) = vec_id as kept
from embeddings left join n on vec_id = n.a left join c on vec_id = c.a
"""

OP13_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
       (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::integer as rank,
       vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5
"""

QUERIES = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_packing": (op2_packing, None),
    "op3_languages": (op3_languages, None),
    "op4_secrets": (op4_secrets, None),
    "op5_sharding": (op5_sharding, None),
    "op6_search": (op6_search, OP6_SQL),
    "op7_decontamination": (op7_decontamination, None),
    "op8_simhash": (op8_simhash, None),
    "op9_substrings": (op9_substrings, OP9_SQL),
    "op10_token_counts": (op10_token_counts, None),
    "op11_whitening": (op11_whitening, None),
    "op12_embedding_copies": (op12_embedding_copies, OP12_SQL),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
}

"""The registered queries of this subpackage: thin, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import html_text, language_id, near_duplicates, packing, projection_search, repeated_passages, sentencepiece_bpe, token_counts, token_store, topk_search

TOKEN_LIMIT = 4096


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_projection_search(spark, sf_dir):
    return projection_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_html_text(spark, sf_dir):
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op3_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_repeated_passages(spark, sf_dir):
    return repeated_passages.without_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.digests(_table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.packed(_table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    return language_id.identified(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.counted(_table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_token_store(spark, sf_dir):
    return token_store.round_trip(_table(spark, sf_dir, "documents"))


def op10_topk_search(spark, sf_dir):
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_projection_search, op2_html_text, op3_near_duplicates, op4_repeated_passages, op5_sentencepiece, op6_packing, op7_language_id, op8_token_counts, op9_token_store, op10_topk_search, pipeline)}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    # Set sizes are counted in SQL; links need all pairs that share a shingle, so the smallest reachable id is found by
    # a recursive query over the links.
    "op3_near_duplicates": f"""
        with recursive words as (
          select doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
        shingles as (
          select distinct doc_id, s from (
            select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
              else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from words)),
        sizes as (select doc_id, count(*) n from shingles group by 1),
        shared as (
          select a.doc_id x, b.doc_id y, count(*) c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
        links as (
          select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
        both_ways as (select x, y from links union all select y, x from links),
        reach(a, b) as (
          select doc_id, doc_id from documents union select a, y from reach join both_ways on b = x)
        select d.doc_id, coalesce(n, 0)::bigint n_shingles, min(b) component_id, d.doc_id = min(b) kept
        from documents d join reach on a = d.doc_id left join sizes s on s.doc_id = d.doc_id group by d.doc_id, n""",
    "op4_repeated_passages": f"""
        with words as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} w from documents),
        windows as (
          select doc_id, i, array_to_string(w[i:i + 12], ' ') s from (
            select doc_id, w, unnest(range(1, greatest(len(w) - 11, 1)::bigint)) i from words)),
        firsts as (select s, min(doc_id) f from windows group by s),
        gone as (select distinct doc_id, i + k p from windows join firsts using (s), range(13) t(k) where f < doc_id),
        placed as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) x from words),
        kept as (select doc_id, string_agg(x, ' ' order by p) t from placed anti join gone using (doc_id, p) group by doc_id),
        counts as (select doc_id, count(*) n from gone group by doc_id)
        select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
        from words left join kept using (doc_id) left join counts using (doc_id)""",
    "op10_topk_search": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) e from embeddings
          where vec_id is not null and len(embedding) > 0 and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
        s as (
          select q.vec_id query_id, b.vec_id, list_sum(list_transform(list_zip(q.e, b.e), lambda z: z[1] * z[2]))::bigint score
          from v q join v b on q.vec_id <> b.vec_id where q.vec_id % 100 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
        select query_id, rank, vec_id, score from r where rank <= 10""",
}

"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.url_filter import url_verdicts

    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.language_id import fit_language_model, held_out, with_language

    docs = table(spark, sf_dir, "documents")
    learn = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = with_language(docs.select("doc_id", "text"), fit_language_model(learn))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.pii import find_pii, pii_digests

    return pii_digests(find_pii(table(spark, sf_dir, "documents")))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.common import placed
    from tidelog.llm.mixing import mixed_order

    docs = placed(table(spark, sf_dir, "documents"), "at").select("at", "doc_id", "source")
    return mixed_order(docs, row="at").drop("at")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.secrets import find_secrets, secret_digests

    return secret_digests(find_secrets(table(spark, sf_dir, "documents")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.common import new_path
    from tidelog.llm.token_store import read_store, write_store

    path = new_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_store(spark, path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), order=3, min_count=1)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.hard_negatives import hard_negatives

    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", turned.alias("label"))
    return hard_negatives(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


QUERIES = {
    "op2_pii": op2_pii,
    "op3_mix": op3_mix,
    "op4_topk": op4_topk,
    "op5_secrets": op5_secrets,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_store": op7_token_store,
    "op1_url_filter": op1_url_filter, "op8_language_id": op8_language_id}
QUERIES |= {"op9_jaccard_join": op9_jaccard_join, "op10_lm_score": op10_lm_score, "op11_minhash": op11_minhash, "op12_collocations": op12_collocations, "op13_hard_negatives": op13_hard_negatives}
ORACLE_SQL: dict[str, str] = {
    "op4_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
           from embeddings where embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
          from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 10""",
    "op12_collocations": """
with d as (select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents where text is not null),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') as w from pieces),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) as p from w, (select unnest([1, 2, 3, 4]) as k)),
f as (select lang, k, p, count(*) as f from grams group by all),
totals as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
c as (select * from f where k > 1 and f >= 30),
cuts as (select c.lang, c.p, c.k, c.f as a, x.f as l, y.f as r, j, cast(2000000::hugeint * c.f // (x.f + y.f) as bigint) as score
         from (select *, unnest(range(1, k)) as j from c) c
         join f x on x.lang = c.lang and x.p = c.p[1 : j] join f y on y.lang = c.lang and y.p = c.p[j + 1 : c.k]),
weakest as (select * from cuts qualify row_number() over (partition by lang, p order by score, j) = 1),
parts as (select lang, f, k, m, unnest(list_transform(range(1, k - m + 2), lambda i: p[i : i + m - 1])) as p from (select *, unnest(range(2, k)) as m from c where k > 2)),
longer as (select lang, p, max(f) as f from parts group by all),
kept as (select w.* from weakest w left join longer x on x.lang = w.lang and x.p = w.p where x.f is null or 100::hugeint * x.f < 80::hugeint * w.a)
select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank, array_to_string(p, ' ') as phrase, a, l, r, n, score
from kept join totals using (lang)
qualify row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) <= 2000""",
    "op13_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
           from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as a, c.vec_id as c, q.label = c.label as same,
            cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
          from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
positives as (select * from pairs where same qualify row_number() over (partition by a order by score desc, c) <= 5)
select p.a as anchor_id, p.c as positive_id,
  cast(row_number() over (partition by p.a, p.c order by n.score desc, n.c) as int) as rank,
  n.c as negative_id, p.score as positive_score, n.score as negative_score
from positives p join pairs n on n.a = p.a and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify row_number() over (partition by p.a, p.c order by n.score desc, n.c) <= 3""",
}

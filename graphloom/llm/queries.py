"""The queries of this subpackage: each applies an operator to the whole of its table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ballsearch, decontam, fim, htmlmain, langid, linedup, lmscore, packing, quality, simhash, substrdedup, tokens, whiten
from .common import table

#: Where the public vocabularies are; GRAPHLOOM_TOKENIZERS names another folder.
VOCABULARIES = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    try:
        import public_tokenizers

        default = os.path.dirname(public_tokenizers.path(name))
    except ImportError:
        default = VOCABULARIES
    return os.path.join(os.environ.get("GRAPHLOOM_TOKENIZERS", default), name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballsearch.search(table(spark, sf_dir, "embeddings"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op7_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed lines, the removed (line, n_lines), and length and digest of what stays."""
    out = linedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", "removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed bytes, the removed (start, size) in bytes, and length and digest of what stays."""
    out = substrdedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", "spans", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text rebuilt from it."""
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pack, op2_simhash, op3_decontam, op4_topk, op5_html, op6_langid, op7_lmscore, op8_lines, op9_tokens, op10_substrings, op11_quality, op12_whiten, op13_fim, pipeline)}
#: Only op13 can be said in the SQL of the check; tests hold each of the others against a brute-force version.
ORACLE_SQL = {
    "op13_fim": """
        with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as g from documents),
        h as (select *, ('0x' || g[1:8])::bigint % (n + 1) as a, ('0x' || g[9:16])::bigint % (n + 1) as b, ('0x' || g[17:24])::bigint as h3, ('0x' || g[25:32])::bigint as h4 from d),
        f as (select *, least(a, b) as p, greatest(a, b) as q, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
        c as (select *, substring(t, 1, p) as x, substring(t, p + 1, q - p) as y, substring(t, q + 1, n - q) as z from f)
        select doc_id, n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then q - p end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256,
               sha256(t) as restored_sha256
        from c""",
}

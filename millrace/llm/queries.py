"""The registered queries: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, exact, idcoder, images, langid, lines, packing, shards, simhash
from .common import stage, stage_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(mod: int):
    """crc32 of the id's text modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def op1_packing(spark, sf_dir):
    return packing.pieces(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op2_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.learn(docs.where(remainder(3) != 1))
    return langid.predict(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op3_id_files(spark, sf_dir):
    path = stage_path(spark, "ids")
    idcoder.write(documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"))
    return idcoder.read(spark, path)


def op4_simhash(spark, sf_dir):
    return simhash.classes(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_bpe(spark, sf_dir):
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op6_image_copies(spark, sf_dir):
    """Images drawn from each row of ``embeddings`` (TESTDATA has no pictures),
    with an edited copy of every tenth."""
    return images.copies(images.drawn(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op7_exact_dedup(spark, sf_dir):
    return exact.decisions(documents(spark, sf_dir))


def op8_sharding(spark, sf_dir):
    return shards.plan(documents(spark, sf_dir)).withColumn("grown_shard", F.lit(None).cast("int"))


def op9_lm_score(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = brown.fit(docs.where(remainder(7) != 2))
    return brown.score(docs, model).select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_line_dedup(spark, sf_dir):
    return lines.drop_common(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_language_id, op3_id_files, op4_simhash, op5_bpe, op6_image_copies, op7_exact_dedup, op8_sharding, op9_lm_score, op10_line_dedup, pipeline)}

#: Rows repeated in the table are documents of their own.
_LINES = """
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
lines AS (SELECT row_id, doc_id, unnest(own) AS line, generate_subscripts(own, 1) AS pos FROM docs),
keyed AS (
  SELECT row_id, doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row_id) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE c.k IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c ON keyed.k = c.k GROUP BY row_id
"""

ORACLES = {
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op10_line_dedup": _LINES,
}

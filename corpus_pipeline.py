"""A corpus-cleaning pipeline of four stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads back as the next one's docs.

* language: documents without a language (null text or no letter) go;
* exact dedup: of equal texts the one with the largest id stays;
* near dedup: of each class of near copies by SimHash (five-word shingles,
  similarity of 0.8 or more) the one with the smallest id stays;
* packing: what is left is packed into training sequences, a row per piece.

``language`` learns from the labelled rows among its own input; if none is labelled
it keeps every text that has a letter.

Defined results: columns of any name and null values are carried through; repeated
rows are equal texts, of which one stays; null ids are ids like any other (never the
largest of equal texts, never the smallest of near copies unless all are null); an
empty table stays empty and packs to nothing.
"""

from millrace.llm import exact, langid, packing, resemblance
from millrace.llm.common import stage
from millrace.llm.queries import documents, tokenizer_path


def language(spark, docs, sf_dir):
    return langid.accept(docs, langid.learn(docs))


def exact_dedup(spark, docs, sf_dir):
    return exact.keep(docs)


def near_dedup(spark, docs, sf_dir):
    return resemblance.keep_one(docs)


def pack(spark, docs, sf_dir):
    return packing.pieces(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pack", pack)]

#: Suffix automata, fingerprints and tokenizers are beyond SQL; the tests hold
#: ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs

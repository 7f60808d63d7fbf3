"""The registered queries as a whole: their columns against brute force and SQL."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from millrace.llm import queries, vocab

from .conftest import DATA
from .test_dedup import brute_classes


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text, r.lang) for r in queries.documents(spark, DATA).collect()]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_sql(spark):
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    for name, sql in queries.ORACLES.items():
        got, rel = queries.QUERIES[name](spark, DATA), con.sql(sql)
        order = sorted(got.columns)
        assert order == sorted(rel.columns)
        assert Counter(tuple(r[c] for c in order) for r in got.collect()) == Counter(tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall())


def test_op1(spark, rows):
    tok, by_doc, by_seq = vocab.load(queries.tokenizer_path("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    for r in queries.op1_packing(spark, DATA).collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(raw(ids[r.doc_id][r.start : r.start + r.length]))
    for i, own in by_doc.items():
        ends = np.cumsum([0, *[r.length for r in sorted(own, key=lambda r: r.start)]])
        assert sorted(r.start for r in own) == ends[:-1].tolist() and ends[-1] == len(ids[i])
    assert set(by_doc) == set(ids)
    for own in by_seq.values():
        n = sum(length for _, length in own)
        assert sorted(own) == sorted(zip(np.cumsum([0, *[length for _, length in sorted(own)]])[:-1].tolist(), [length for _, length in sorted(own)])) and n <= 4096


def test_op2(spark, rows):
    langs = {x for i, _, x in rows if x is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    texts = {i: t for i, t, _ in rows}
    got = queries.op2_language_id(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred in langs if any(c.isalpha() for c in texts[r.doc_id] or "") else r.lang_pred == "und"


def test_op3(spark, rows):
    tok, start = vocab.load(queries.tokenizer_path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in queries.op3_id_files(spark, DATA).collect()}
    for i, t, _ in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(raw(ids)))
        start += len(ids)
    assert len(got) == len(rows)


def test_op4(spark, rows):
    want = Counter((i, f"{fp:016x}", c) for (i, fp, c), n in brute_classes([r[:2] for r in rows]).items() for _ in range(n))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, DATA).collect()) == want


def test_op5(spark, rows):
    tok = vocab.load(queries.tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries.op5_bpe(spark, DATA).collect()}
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_op6(spark):
    """Each picture's edited copy is with it, and nothing else is."""
    got = {r.image_id: r for r in queries.op6_image_copies(spark, DATA).collect()}
    copies = [i for i in got if i < 0]
    assert len(copies) >= 40 and sum(got[i].class_id == got[-1 - i].class_id == i for i in copies) >= 0.9 * len(copies)
    assert all(r.class_id == i and r.class_size == 1 for i, r in got.items() if i >= 0 and i % 10)


def test_op8(spark, rows):
    own, sizes = defaultdict(list), Counter()
    got = queries.op8_sharding(spark, DATA).collect()
    texts = {i: (t or "").encode() for i, t, _ in rows}
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "bytes", None)
        own[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert len(got) == len(rows) and set(own) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in own.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)


def test_op9(spark, rows):
    got = queries.op9_lm_score(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got) and len({r.train_tokens for r in got}) == 1


def test_pipeline_stages_on_edges(spark, edge, empty):
    """Nulls, ties, repeated rows, clashing columns, no rows and no labels."""
    import corpus_pipeline

    unlabelled = edge.drop("lang").selectExpr("*", "cast(null as string) lang").select(*edge.columns)
    for docs in (edge, empty, unlabelled):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, stage(spark, docs, DATA)
            assert docs.columns == before.columns, name
            kept, given = Counter(map(str, docs.collect())), Counter(map(str, before.collect()))
            assert all(n <= given[r] for r, n in kept.items()), name
        assert (docs.count() > 0) == (before.count() > 0)
        assert corpus_pipeline.pack(spark, docs, DATA).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_null_and_text_ids(spark):
    """Ids of any type, null ones among them, come back as they are from every operator."""
    from millrace.llm import bpe, brown, exact, langid, lines, packing, resemblance, shards, simhash

    rows = [("b", "the cat sat on the mat", "en"), (None, "der Hund lief durch den Wald", "de"), (None, None, None), ("a", "the cat sat on the mat", "en"), ("c", "", "en")]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = brown.fit(df, head=5, tails=4, classes=3)
    word, byte = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")
    made = {
        "packing": packing.pieces(df, word).where("start = 0"),
        "langid": langid.predict(df, langid.learn(df)), "simhash": simhash.classes(df), "resemblance": resemblance.classes(df), "bpe": bpe.encode_decode(df, byte),
        "exact": exact.decisions(df), "shards": shards.plan(df, shards=2), "brown": brown.score(df, model), "lines": lines.drop_common(df),
    }
    for name, out in made.items():
        got = Counter(r.doc_id for r in out.collect())
        assert got == Counter(i for i, _, _ in rows), name

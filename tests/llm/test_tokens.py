"""Packing (1), id files (3) and BPE (5) against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import bpe, idcoder, packing, vocab
from millrace.llm.common import stage_path
from millrace.llm.queries import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def library(path):
    tok = vocab.load(path)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_chunked_encoding_is_the_librarys():
    odd = ["", " ", "  ", "a  b", "a \n b", "a\n  b\n", "  lead", "trail   ", "a\n <|endoftext|>", "it's 'll", "\n\n x", "a   b", "x   y", "\r \r"]
    byte, word = vocab.library_encoder(BYTE), vocab.word_encoder(WORD)
    odd += [text + extra for text in odd for extra in ("a|b | |", "\u0338x \u0130", "\x1d y", "\u3000")]
    for encode, path in ((byte, BYTE), (word, WORD)):
        one = library(path)
        for text in odd:
            assert encode.encode(text) == raw(one(text)), text
        ids, ends = encode(pa.array(odd), 7)  # and all together
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*one(t), 7] for t in odd]
        assert encode(pa.array(odd[5:], pa.string()))[0].tolist() == [i for t in odd[5:] for i in one(t)]


def test_packing_places_each_id_once(cases):
    for df, rows in cases:
        encode = library(WORD)
        want = sorted((i if i is not None else -1, raw([*encode(t), 2])) for i, t in rows)
        got = packing.pieces(df, WORD, hold=20_000, with_ids=True).collect()
        by_seq, by_doc = defaultdict(list), defaultdict(list)
        for r in got:
            assert r.ids_crc32 == zlib.crc32(raw(r.ids)) and len(r.ids) == r.length > 0
            by_seq[r.sequence_id].append(r)
            by_doc[r.doc_id].append(r)
        for own in by_seq.values():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == list(np.cumsum([0, *[r.length for r in own[:-1]]]))
            total = sum(r.length for r in own)
            assert total <= 4096 and total & (total - 1) == 0 and {r.tier for r in own} == {total}
        once = {i for i, n in __import__("collections").Counter(i for i, _ in rows).items() if n == 1}
        texts = dict(want)
        for i in once:
            own = sorted(by_doc[i], key=lambda r: r.start)
            assert b"".join(raw(r.ids) for r in own) == texts[i]
            assert {r.doc_tokens for r in own} == {len(texts[i]) // 4}
        assert sum(r.length for r in got) == sum(len(x) // 4 for _, x in want)


def test_step_groups_hold_alike():
    full, rest = packing.pack([300, 5000, 17, 4096, 90, 2000, 1, 700] * 50)
    sequences = full + packing.powers(rest)
    groups = defaultdict(int)
    for s, g in zip(sequences, packing.step_groups(sequences, 32_768)):
        groups[g] += sum(p[2] for p in s)
    assert max(groups.values()) <= 32_768 + 4096


def test_packing_empty(empty):
    assert packing.pieces(empty, WORD).count() == 0


def test_block_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([5], np.uint32), rng.integers(0, 60_000, 3000).astype(np.uint32), np.full(9000, 7, np.uint32), rng.zipf(1.3, 50_000).clip(0, 9999).astype(np.uint32)):
        data = idcoder.encode_block(ids)
        assert (idcoder.decode_block(data) == ids).all()
    assert len(idcoder.encode_block(np.full(9000, 7, np.uint32))) < 2000
    for bit in [*range(8 * 40), *rng.integers(0, 8 * len(data), 40).tolist()]:  # header and payload
        hurt = bytearray(data)
        hurt[bit // 8] ^= 1 << bit % 8
        with pytest.raises(idcoder.BlockError):
            idcoder.decode_block(bytes(hurt))
    for cut in (0, 10, 31, 32, len(data) - 1):
        with pytest.raises(idcoder.BlockError):
            idcoder.decode_block(data[:cut])


def test_id_files(spark, cases, empty):
    encode = library(BYTE)
    for df, rows in cases:
        path = stage_path(spark, "t")
        idcoder.write(df, path, BYTE, block_ids=5000)
        got = sorted(idcoder.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
        assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got[:-1]]]))
        want = sorted((i, [*encode(t), 0]) for i, t in rows)
        assert sorted((r.doc_id, r.ids) for r in got) == want
        assert all(r.ids_crc32 == zlib.crc32(raw(r.ids)) for r in got)
    path = stage_path(spark, "t")
    idcoder.write(empty, path, BYTE)
    assert idcoder.read(spark, path).count() == 0
    path = stage_path(spark, "t")
    idcoder.write(spark.createDataFrame([("b", "x y"), (None, "z"), ("a", None)], "doc_id string, text string"), path, BYTE)
    assert [(r.doc_id, r.start) for r in sorted(idcoder.read(spark, path).collect(), key=lambda r: r.start)] == [(None, 0), ("a", 2), ("b", 3)]


def test_a_row_that_is_not_its_block(spark, sf):
    """Lengths, counts and checksums of a row are held against the block."""
    from pyspark.sql import functions as F

    path = stage_path(spark, "t")
    idcoder.write(sf.limit(20), path, BYTE)
    for column, value in (("n_ids", F.col("n_ids") + 1), ("ids_crc32", F.col("ids_crc32") + 1), ("lengths", F.transform("lengths", lambda x: x + 1)), ("doc_ids", F.slice("doc_ids", 1, 3))):
        hurt = stage_path(spark, "t")
        spark.read.parquet(path).withColumn(column, value).write.parquet(hurt)
        with pytest.raises(Exception, match="BlockError"):
            idcoder.read(spark, hurt).collect()


def test_automaton_accepts_only_the_tokenization():
    labels = {bytes([c]): c for c in b"abc"} | {b"ab": 200, b"aa": 201, b"abc": 202, b"bc": 203}
    a = bpe.Automaton(labels, [(b"a", b"b"), (b"a", b"a"), (b"ab", b"c"), (b"b", b"c")])
    assert a.encode(b"aab") == [97, 200] and a.encode(b"aaa") == [201, 97] and a.encode(b"aabc") == [97, 202] and a.encode(b"bbc") == [98, 203]
    assert not a.arc(97, 98) and not a.arc(97, 97) and a.arc(201, 97) and not a.arc(97, 201)


def test_automaton_equals_the_library_on_random_merges():
    """Trained lists, lists with merges that can't happen, and unordered ones."""
    from tokenizers import Tokenizer, models

    rng, unfit = random.Random(0), 0
    for _ in range(1500):
        alphabet = "abc"[: rng.randint(1, 3)]
        vocab = {c: i for i, c in enumerate(alphabet)}
        merges: list = []
        for _ in range(rng.randint(0, 8)):
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if len(a + b) <= 7 and (a, b) not in merges and (a + b not in vocab or rng.random() < 0.3):
                vocab.setdefault(a + b, len(vocab))
                merges.append((a, b))
        if rng.random() < 0.2:
            rng.shuffle(merges)
        library = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        labels, pairs = {k.encode(): v for k, v in vocab.items()}, [(a.encode(), b.encode()) for a, b in merges]
        try:
            bpe.Automaton(labels, pairs)
        except bpe.Unfit:
            unfit += 1
        encode = bpe.encoder_of(labels, pairs)
        for _ in range(10):
            word = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))
            assert encode(word.encode()) == library.encode(word).ids, (merges, word)
    assert 50 < unfit < 700


def test_merges_side_by_side_equal_the_library():
    tok = vocab.load(BYTE)
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["straße", "naïve", "a"]
    data = [w.encode() for w in words]
    sizes = np.array([len(x) for x in data])
    for first, space in ((True, ""), (False, " ")):
        ids, n = vocab.merges_of(BYTE, True)[first](np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes, sizes)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(space + w, add_special_tokens=False).ids for w in words]


def test_bpe(cases, empty):
    tok = vocab.load(BYTE)
    for df, rows in cases:
        got = sorted((r.doc_id, r.ids, r.decoded, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(df, BYTE, with_ids=True).collect())
        want = []
        for i, t in rows:
            ids = tok.encode(t or "", add_special_tokens=False).ids
            back = tok.decode(ids, skip_special_tokens=False)
            want.append((i, ids, back, len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe.encode_decode(empty, BYTE).count() == 0

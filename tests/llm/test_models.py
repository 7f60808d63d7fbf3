"""Language ID (2), sharding (8), scoring (9), images (6) and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import brown, exact, images, langid, queries, shards

from .conftest import DATA
from .test_resemblance import brute


def brute_phrases(text, sample):
    """Longest-match parse by substring search."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in sample:
            size += 1
        at += max(1, size - 1)
        n += 2 if size == 1 else 1  # a letter that the sample lacks counts twice
    return n


def test_cross_parse_is_longest_match():
    """For short and long texts, dense and sparse tables, and pieces of any size."""
    rng = np.random.default_rng(2)
    samples = {g: langid.folded("".join(rng.choice(list(a), 400))) for g, a in (("x", "abc de"), ("y", "cdef gé"))}
    texts = ["".join(rng.choice(list("abcdefgéq "), rng.integers(0, 2500))) for _ in range(12)] + ["".join(rng.choice(list("abc"), 5000)), "abc" * 2000, "q" * 500]
    seqs = [langid.folded(t) for t in texts]
    spell = lambda s: "".join(chr(c) for c in s)
    want = {g: [brute_phrases(spell(s), spell(samples[g])) for s in seqs] for g in samples}
    for dense in (160, 0):
        model = langid.Model(samples, dense)
        for piece, meet in ((1024, 128), (7, 2), (64, 1), (16, 16)):
            got = model.phrases([model.coded(s) for s in seqs], piece, meet)
            for g, lang in enumerate(model.langs):
                assert got[:, g].tolist() == want[lang]
        cost = np.array([want[g] for g in model.langs]).T * np.array(model.bits)
        lang, score = model.predict(texts)
        for k in range(len(texts)):
            if any(c.isalpha() for c in texts[k]):
                assert lang[k] == model.langs[int(cost[k].argmin())] and score[k] == pytest.approx(cost[k].max() / cost[k].sum())


def test_scripts_of_many_letters():
    rng = np.random.default_rng(3)
    scripts = {g: [chr(at + i) for i in range(2048)] for g, at in (("zz", 0x4E00), ("aa", 0xAC00), ("mm", 0x3400))}
    model = langid.Model({g: langid.folded("".join(rng.choice(own, 24_000))) for g, own in scripts.items()})
    assert len(model.alphabet) == 3 * 2048
    for g, own in scripts.items():
        assert set(model.predict(["".join(rng.choice(own, 300)) for _ in range(20)])[0]) == {g}


def test_many_languages():
    rng = np.random.default_rng(4)
    samples = {f"l{k:03}": langid.folded("".join(rng.choice(list("abcdefgh"), 60, p=rng.dirichlet(np.ones(8))))) for k in range(600)}
    model = langid.Model(samples)
    assert len(model.langs) == 600 and model.predict(["abcdefgh"])[0][0] in samples


def test_language_accuracy(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(queries.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_edges(edge, empty):
    model = langid.learn(edge)
    rows = {r.doc_id: r for r in langid.predict(edge, model).collect()}
    texts = {r.doc_id: r.text for r in edge.collect()}
    for i, r in rows.items():
        blank = not any(c.isalpha() for c in texts[i] or "")
        assert (r.lang_pred == "und") == blank and (r.score == 0) == blank
    kept = langid.accept(edge, model)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.lang_pred != "und"}
    nothing = langid.learn(empty)
    assert {r.lang_pred for r in langid.predict(edge, nothing).collect()} == {"und"}
    assert {r.doc_id for r in langid.accept(edge, nothing).collect()} == {r.doc_id for r in kept.collect()}  # no label: all with a letter
    assert langid.predict(empty, model).count() == 0


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(cases, empty, law):
    for df, rows in cases:
        got = shards.plan(df, shards=7, law=law, rows_a_range=5).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
        own = defaultdict(list)
        for r in got:
            own[r.shard].append(r)
        for s in own.values():
            assert sorted(r.slot for r in s) == list(range(len(s)))
        sizes = [sum(r.size if law == "bytes" else 1 for r in own[s]) for s in range(7)]
        assert max(sizes) - min(sizes) <= (2 * max(r.size for r in got) if law == "bytes" else 1)
        # Exactly the groups that lie in two shards are marked.
        texts, where = {i: t or "" for i, t in rows}, defaultdict(set)
        for r in got:
            where[texts[r.doc_id]].add(r.shard)
        assert [r for r in got if r.group_cut != (len(where[texts[r.doc_id]]) > 1)] == []
    assert shards.plan(empty, law=law).count() == 0
    named = df.selectExpr("concat('id', doc_id) doc_id", "text").unionByName(df.limit(1).selectExpr("cast(null as string) doc_id", "text"))
    assert shards.plan(named, law=law).select("shard", "slot").distinct().count() == named.count()


def test_overfull_ranges_are_cut(spark):
    df = spark.range(0, 9000).selectExpr("id doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id) end text")
    got = shards.plan(df, shards=10, rows_a_range=100).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)
    rows = Counter(r.shard for r in shards.plan(df, shards=10, law="rows", rows_a_range=100).collect())
    assert set(rows.values()) == {900}


def test_written_shards(spark, sf, tmp_path):
    shards.write(sf, str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == sf.count() and back.select("shard").distinct().count() == 4


def brute_base(rows, train):
    counts = Counter(w for t in train for w in brown.tokens(t or ""))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(x := brown.tokens(t or "")), sum(w in counts for w in x), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)) for i, t in rows}, n


def brute_scores(rows, train, model, alpha=0.5, beta=0.5):
    """Transitions, emissions and their sums from the classes alone."""
    cls, n_classes = {}, len(model.transition)
    places = brown.Places(model.known, model.tails)
    of = lambda w: cls.setdefault(w, int(model.class_of[places[w]]))
    pairs, counts = Counter(), Counter()
    for t in train:
        toks = brown.tokens(t or "")
        counts.update(toks)
        pairs.update(zip(map(of, [brown.END, *toks]), map(of, toks)))
    out, into, size, types = Counter(), Counter(), Counter(), Counter()
    for (a, _), n in pairs.items():
        out[a] += n
    for w, n in counts.items():
        size[of(w)] += n
        types[of(w)] += 1
    scores = {}
    for i, t in rows:
        total, before = 0.0, of(brown.END)
        for w in brown.tokens(t or ""):
            c = of(w)
            total += math.log10((pairs[before, c] + beta) / (out[before] + beta * n_classes))
            total += math.log10((counts[w] + alpha) / (size[c] + alpha * (types[c] + 1)))
            before = c
        scores[i] = total
    return scores


def test_scores(cases, empty):
    for df, rows in cases:
        train = df.where(queries.remainder(7) != 2)
        kept = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
        want, n = brute_base(rows, kept)
        for options in ({"known": 50_000}, {"known": 20}, {"known": 400, "min_count": 3}):  # known words, or nearly all joined
            model = brown.fit(train, head=20, tails=16, classes=8, **options)
            assert model.tokens == n and len(model.known) <= options["known"]
            got = brown.score(df, model).collect()
            assert len(got) == len(rows)
            score = brute_scores(rows, kept, model)
            for r in got:
                assert (r.n_tokens, r.n_known) == want[r.doc_id][:2]
                assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
                assert r.score == pytest.approx(score[r.doc_id], rel=1e-9)
            assert (np.power(10.0, model.transition).sum(1) == pytest.approx(1))
    assert model.clustered > 20 and model.gains[1] > model.gains[0]  # insertion raises the likelihood
    assert brown.score(empty, model).count() == 0
    none = brown.fit(empty)
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in brown.score(cases[0][0], none).collect())


def test_words_of_one_kind_share_a_class(spark):
    """Colours follow articles and come before things, in texts of rare and frequent words."""
    rng = np.random.default_rng(8)
    kinds = [[f"{k}{i}" for i in range(40)] for k in ("art", "col", "thing")]
    p = 1 / np.arange(1, 41)
    texts = [" ".join(rng.choice(own, p=p / p.sum()) for _ in range(30) for own in kinds) for _ in range(300)]
    model = brown.fit(spark.createDataFrame([(t,) for t in texts], "text string"), head=10, tails=4, classes=4, min_count=5)
    places = brown.Places(model.known, model.tails)
    classes = [{int(model.class_of[places[w.encode()]]) for w in own} for own in kinds]
    assert model.clustered > 100 and all(len(c) == 1 for c in classes) and len(set.union(*classes)) == 3


def test_model_beats_words_alone(spark):
    got = queries.op9_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    true = rng.integers(0, 3, 30)
    pairs = np.where((true[:, None] + 1) % 3 == true[None], 50, 1) * rng.integers(1, 5, (30, 30)).astype(float)
    own = brown.exchange(pairs, 4)

    def likelihood(cls):
        onto = np.eye(cls.max() + 1)[cls]
        t = onto.T @ pairs @ onto
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(t) - f(t.sum(1)) - f(t.sum(0))

    assert own[0] == 0 and (own[1:] > 0).all()
    assert likelihood(own) > max(likelihood(np.r_[0, 1 + rng.integers(0, 3, 29)]) for _ in range(20))


def test_image_copies(spark):
    from pyspark.sql import functions as F

    vectors = spark.range(0, 60).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.rand(3).cast("float") + k).alias("embedding"))
    made = images.drawn(spark.createDataFrame(vectors.collect(), vectors.schema))
    rows = made.collect() + [(900, None), (901, b""), (902, b"junk"), (903, images.pgm(np.zeros((50, 50))))]
    rows += [(904, rows[5].image), (905, images.pgm(np.zeros((50, 50))))]
    got = {r.image_id: (r.class_id, r.class_size) for r in images.copies(spark.createDataFrame(rows, "image_id long, image binary").repartition(3)).collect()}
    assert len(got) == len(rows)
    same = {i: got[i][0] for i in got}
    for i in range(0, 60, 10):
        assert same[i] == same[-1 - i] == -1 - i
    assert same[904] == same[rows[5].image_id] and got[904][1] >= 2 and same[903] == same[905] == 903
    assert all(got[i] == (i, 1) for i in range(60) if i % 10 and i != rows[5].image_id) and got[900] == (900, 1) and got[902] == (902, 1)
    assert images.copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_png_decoding():
    import struct

    rng = np.random.default_rng(4)
    px = rng.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    raw = bytearray()
    for y in range(9):
        kind = y % 5
        raw.append(kind)
        for x in range(21):
            cur, a, b, c = int(px[y].reshape(-1)[x]), int(px[y].reshape(-1)[x - 3]) if x >= 3 else 0, int(px[y - 1].reshape(-1)[x]) if y else 0, int(px[y - 1].reshape(-1)[x - 3]) if y and x >= 3 else 0
            p = a + b - c
            raw.append((cur - [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v))][kind]) % 256)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")
    assert np.allclose(images.decode(data), px.mean(2))


def test_pipeline(spark):
    docs = queries.documents(spark, DATA)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    kept = {max(g) for g in groups.values()}
    rows = [(i, t) for i, t in rows if i in kept]
    left = set(brute(rows).values())
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == left
    by_doc = defaultdict(int)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens] += r.length
    assert all(n == total for (_, n), total in by_doc.items()) and len(by_doc) == len(left)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language", "exact_dedup", "near_dedup"):
        assert stages[name](spark, docs, DATA).columns == docs.columns

"""Near copies (pipeline) against brute force, and the recall on planted edits."""

import random

import corpus_pipeline
from millrace.llm import resemblance, simhash


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows):
    """doc_id -> smallest id of its class."""
    sets, root = [set(simhash.shingles(t or "", 5)) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def planted(pairs=60, words=500, seed=1):
    """Texts of random words, each with a copy of which a few words are edited:
    pairs of similarity 0.8 and more, and some below."""
    rng = random.Random(seed)
    rows = []
    for k in range(pairs):
        text = [f"w{rng.randrange(20_000)}" for _ in range(words)]
        copy = list(text)
        for at in rng.sample(range(0, words, 6), 3 + k % 10):
            copy[at] = f"x{rng.randrange(20_000)}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    return rows


def test_planted_edits_go(spark):
    rows = planted()
    near = [k for k in range(0, len(rows), 2) if jaccard(*(set(simhash.shingles(t, 5)) for _, t in rows[k : k + 2])) >= 0.8]
    assert len(near) > 40 and len(near) < len(rows) / 2
    want = {doc for doc, least in brute(rows).items() if doc == least}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_classes(cases, empty):
    for df, rows in cases:
        want = brute(rows)
        for options in ({}, {"chunk": 2}, {"broadcast_ids": 0}):
            assert {r.doc_id: r.component_id for r in resemblance.classes(df, **options).collect()} == want
    kept = resemblance.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    assert resemblance.classes(empty).count() == 0 and resemblance.keep_one(empty).count() == 0

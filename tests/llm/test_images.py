"""Image copies (6): matches against brute force, groups of copies, recall by edit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import images
from millrace.llm.simhash import forest


def rows_of(rng, n, keys=12):
    """Corners of 40 images that share few keys and differ in few other bits."""
    key, other = rng.integers(0, keys, n), rng.integers(0, 2**63, 3, np.uint64)[rng.integers(0, 3, n)]
    for _ in range(9):
        other = other ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return rng.integers(0, 2, n), key, other, rng.integers(0, 40, n)


@pytest.mark.parametrize("first", [1000, 3])
def test_agreeing_is_exact(first):
    rng = np.random.default_rng(1)
    side, key, other, tag = rows_of(rng, 1500)
    got = [(int(a), int(b)) for p, q in images.agreeing(side, key, other, tag, np.zeros(1500, int), 12, first) for a, b in zip(p, q)]
    want = {(i, j) for i in range(1500) for j in range(1500) if tag[i] < tag[j] and side[i] == side[j] and key[i] == key[j] and int(other[i] ^ other[j]).bit_count() <= 12}
    assert len(set(got)) == len(got) and set(got) <= want
    if first == 1000:
        assert set(got) == want
    for j in range(1500):
        mine = sorted(tag[i] for i, k in want if k == j)
        assert sorted(tag[i] for i, k in got if k == j) == mine[:first]


def test_hot_keys_are_cut_without_loss(spark):
    """Chunk pairs find what one chunk finds."""
    rng = np.random.default_rng(2)
    made = [(t, list(range(8)), [int(x) for x in rng.integers(0, 2, 8)], [int(x) for x in rng.integers(0, 4, 8)]) for t in range(400)]
    points = spark.createDataFrame(made, "tag long, geo array<long>, d0 array<long>, d1 array<long>")
    all_of = lambda chunk: {tuple(r) for r in images.matches(points, 3200, 1, 10_000, chunk).collect()}
    whole = all_of(1 << 20)
    assert len(whole) > 100_000 and all_of(64) == whole


def test_a_group_of_many_copies(spark):
    """Each of 300 brightened copies meets the earliest ones, not every other."""
    rng = np.random.default_rng(3)
    base = images.draw(rng.normal(size=8))
    rows = [(i, images.pgm((base * (0.7 + i / 2000) + i % 40).clip(0, 255))) for i in range(300)] + [(500 + i, images.pgm(images.draw(rng.normal(size=8)))) for i in range(20)]
    df = spark.createDataFrame(rows, "image_id long, image binary").repartition(4)
    got = {r.image_id: (r.class_id, r.class_size) for r in images.copies(df).collect()}
    assert all(got[i] == (0, 300) for i in range(300)) and all(got[i] == (i, 1) for i in range(500, 520))
    points = images.described(df, "image_id", "image", 48)
    assert images.matches(points, 30_000, images.RADIUS, 8).count() < 2 * 8 * 320 * 200


def copies_of(spark, monkeypatch, corners, **options):
    """Classes of images that are given as lists of (geo, d0, d1), by their places."""
    made = [(i, i, str(i).encode(), *([int(c[k]) for c in own] for k in range(3))) for i, own in enumerate(corners)]
    points = spark.createDataFrame(made, "image_id long, tag long, pixels binary, geo array<long>, d0 array<long>, d1 array<long>")
    monkeypatch.setattr(images, "described", lambda *_: points)
    got = {r.image_id: r.class_id for r in images.copies(points, **options).collect()}
    return [got[i] for i in range(len(corners))]


def spot(k):
    """The place of corner k of a grid."""
    return int(images.packed(*(np.array([v]) for v in (20 * (k // 8), 20 * (k % 8), 0, 0.0)))[0])


def test_links_beyond_the_first_partners(spark, monkeypatch):
    """Two images share 16 corners, each of which 10 earlier images have as well; these have 4 each."""
    rng = np.random.default_rng(11)
    d = rng.integers(-(2**62), 2**62, (16, 2))
    shared = [(spot(k), *d[k]) for k in range(16)]
    early = [[shared[k] for k in range(16) if k % 4 == t % 4] for t in range(40)]
    got = copies_of(spark, monkeypatch, [*early, shared, shared[:8] + [(g, a + 1, b + 1) for g, a, b in shared[8:]], shared])
    assert got == [*range(40), 40, 40, 40]


def test_a_corner_that_all_have_makes_no_candidates(spark, monkeypatch):
    """7 corners of a logo link nothing, and no two of 300 images are compared for them."""
    rng = np.random.default_rng(12)
    logo = [(spot(k), *rng.integers(-(2**62), 2**62, 2)) for k in range(7)]
    seen, real = [], images.decided
    monkeypatch.setattr(images, "decided", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    own = [[*logo, *((spot(k), *rng.integers(-(2**62), 2**62, 2)) for k in range(8, 20))] for _ in range(300)]
    got = copies_of(spark, monkeypatch, [*own, own[7]])
    assert got == [*range(300), 7] and seen[0] < 300


@pytest.mark.parametrize("first, chunk", [(1, 1 << 20), (2, 16)])
def test_classes_are_those_of_all_matches(spark, monkeypatch, first, chunk):
    """Against brute force, on images of which many share corners with many."""
    rng = np.random.default_rng(first)
    pool = rng.integers(-(2**62), 2**62, (40, 2))
    corners = []
    for _ in range(150):
        own = rng.choice(40, rng.integers(3, 14), replace=False)
        bits = np.int64(1) << rng.integers(0, 20, (len(own), 2))
        corners.append([(spot(k), *(pool[k] ^ (b * (rng.random(2) < 0.3)))) for k, b in zip(own, bits)])
    sizes = [len(c) for c in corners]
    flat = np.array([c for own in corners for c in own], np.int64)
    tag, geo, d0, d1 = np.repeat(np.arange(150), sizes), *flat.T
    n = len(tag)
    pairs = list(images.agreeing(np.repeat([0, 1], n), np.concatenate([d0, d1]), np.concatenate([d1, d0]).view(np.uint64), np.tile(tag, 2), np.zeros(2 * n, int), images.RADIUS, 10**6))
    p, q = (np.concatenate(x) for x in zip(*pairs))
    linked = images.voted(np.tile(tag, 2)[p], np.tile(tag, 2)[q], np.tile(geo, 2)[p], np.tile(geo, 2)[q], 5)
    want = forest(150, [(linked[:, 0], linked[:, 1])]).tolist()
    assert 3 < len(set(want)) < 147
    assert copies_of(spark, monkeypatch, corners, first=first, chunk=chunk, least=5) == want


def test_across_is_exact():
    rng = np.random.default_rng(4)
    side, key, other, tag = rows_of(rng, 1200)
    root, early = tag // 3, rng.random(1200) < 0.5
    got = [(int(a), int(b)) for p, q in images.across(side, key, other, tag, np.zeros(1200, int), root, early, 12, 500) for a, b in zip(p, q)]
    want = {(i, j) for i in range(1200) for j in range(1200) if early[i] and tag[i] < tag[j] and root[i] != root[j] and side[i] == side[j] and key[i] == key[j] and int(other[i] ^ other[j]).bit_count() <= 12}
    assert want and len(set(got)) == len(got) and set(got) == want


EDITS = {
    "crop": lambda g, r: images.edited(g, 0), "turn by 90": lambda g, r: images.edited(g, 1), "brighter": lambda g, r: images.edited(g, 2),
    "smaller": lambda g, r: images.edited(g, 3), "stamp": lambda g, r: images.edited(g, 4), "quarter": lambda g, r: g[10:70, 14:74], "mirror of turn by 180": lambda g, r: g[::-1, ::-1],
    "noise": lambda g, r: (g + r.normal(0, 0.7, g.shape)).clip(0, 255),
}


def recall(size=80, n=40, seed=5):
    """The share of edited copies, by kind, whose matches link them to their original."""
    rng, out = np.random.default_rng(seed), {}
    for name, edit in EDITS.items():
        hits = 0
        for _ in range(n):
            g = images.draw(rng.normal(size=8), size)
            sides = [images.describe(np.floor(x).clip(0, 255).astype(np.float32)) for x in (g, edit(g, rng))]
            geo = np.concatenate([images.packed(*s[:4]) for s in sides])
            d0, d1 = (np.concatenate([s[k] for s in sides]) for k in (4, 5))
            tag = np.repeat([0, 1], [len(s[0]) for s in sides])
            side, key, other = np.repeat([0, 1], len(geo)), np.concatenate([d0, d1]), np.concatenate([d1, d0]).view(np.uint64)
            pairs = list(images.agreeing(side, key, other, np.tile(tag, 2), np.zeros(2 * len(geo), int), images.RADIUS, images.FIRST))
            p, q = (np.concatenate([np.zeros(0, int), *x]) for x in zip(*pairs)) if pairs else (np.zeros(0, int),) * 2
            hits += len(images.voted(np.tile(tag, 2)[p], np.tile(tag, 2)[q], np.tile(geo, 2)[p], np.tile(geo, 2)[q], images.LEAST)) > 0
        out[name] = hits / n
    return out


def test_recall_by_edit():
    got = recall(n=20)
    assert all(v >= 0.9 for v in got.values()), got


def test_corners_grow_with_the_picture():
    rng = np.random.default_rng(7)
    a, b = (len(images.describe(images.draw(rng.normal(size=8), n).astype(np.float32))[0]) for n in (128, 512))
    assert b > 4 * a


def test_edges(spark):
    empty = spark.createDataFrame([], "image_id long, image binary, tag int, pixels string")
    assert images.copies(empty).count() == 0
    flat, junk = images.pgm(np.zeros((50, 50))), b"P5 99999 99999 255\n"
    rows = [(None, flat, 1, ""), (3, flat, 1, ""), (3, flat, 2, ""), (4, junk, 1, ""), (5, None, 1, None), (6, b"", 1, None)]
    got = sorted((str(r.image_id), str(r.class_id), r.class_size) for r in images.copies(spark.createDataFrame(rows, empty.schema)).collect())
    assert got == [("3", "3", 3), ("3", "3", 3), ("4", "4", 1), ("5", "5", 1), ("6", "6", 1), ("None", "3", 3)]


if __name__ == "__main__":
    print(recall(n=200), recall(240, 40))

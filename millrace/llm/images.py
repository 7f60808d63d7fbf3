"""Copies of images by local descriptors.

Corners are found on several scales; around each, the intensity centroid gives
an orientation, and 128 tests of turned point pairs on the smoothed image give a
binary descriptor.  Descriptors meet in two Hamming tables, keyed by either half
of 64 bits: those that agree in one half and differ in at most ``radius`` bits of
the other are a match.  The keys are as long for every table size, so whether two
images match never depends on what else is there; descriptors of a copy mostly
agree in a whole half, and those of other images hardly ever do.  The matches of
two images vote for the shift, turn and scale that map one onto the other; images
with at least ``least`` matched corners in one cell of votes are linked, which
holds for cropped, turned, resized, brightened or overprinted copies, since a part
of the corners is enough.  Classes are the connected components of the links.

Images with equal pixels are compared once, by one of them.  Of the images that
agree in a key, each is first matched with the ``first`` earliest that it agrees
with: in a group of many copies all are so linked to the earliest ones, and the
matches grow with the group and not with its pairs.  Rows (key, other half, tag,
place) are shuffled once, to buckets of many keys; a key with very many rows is cut
into chunks and each pair of chunks is a task of its own.

What that limit left out is then made up for (``rest``), so the classes are those
of all matches, whatever ``first`` is.  The keys where it left out a match are
known; among them only those matter that hold images of more than one class so far.
A link needs ``least`` corners of its earlier image, so at least one is left when
each image's ``least - 1`` corners with the most classes are put aside: any two
images of different classes that share one of the others in such a key, or that
were matched before and may still come to ``least``, are a candidate, and each
candidate is decided by all matches of the two images.  A corner that thousands of
pictures have in common, as of a logo, is so put aside in all of them.

Corners grow with the picture: the ``corners`` strongest of each square of ``CELL``
pixels on each scale, and scales go on by 0.7 down to the smallest that has room
for a descriptor.

Images are binary: PGM or PPM (P5, P6, 8 bits) or PNG (8 bits, grey, RGB, with
or without alpha, not interlaced) of up to ``MOST_PIXELS``.  Defined results: a
null, empty, unknown, larger or damaged image, and one without corners, is a class
of its own (equal pixels still join); repeated rows are classed together; null ids
are kept and are the smallest of a class only if it has no other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, map_arrow, small, stage
from .simhash import components

SCALE, CORNERS, CELL, REACH, RADIUS, LEAST, FIRST = 0.7, 48, 96, 11, 16, 8, 8
MOST_PIXELS = 1 << 26

#: Rows of a chunk of a key, and rows that a bucket should have.
CHUNK, BUCKET = 8192, 100_000

#: Up to this many keys are broadcast, and pairs of rows that are compared together.
BROADCAST_KEYS, BLOCK = 500_000, 1 << 20
_TURNS = 32
_HEADER = re.compile(rb"P([56])(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)\s")


def pgm(grey: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + grey.astype(np.uint8).tobytes()


def _png(data: bytes) -> np.ndarray:
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace or colour not in (0, 2, 4, 6):
        raise ValueError("this kind of PNG isn't read")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if not 0 < width * height <= MOST_PIXELS:
        raise ValueError("too large")
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), height * (1 + n * width)), np.uint8).reshape(height, 1 + n * width)
    out, above = np.zeros((height, n * width), np.uint8), np.zeros(n * width, np.uint8)
    for y in range(height):
        line, kind = raw[y, 1:].copy(), raw[y, 0]
        if kind == 2:
            line += above
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, n), 0, dtype=np.uint8).reshape(-1)
        elif kind in (3, 4):
            for x in range(len(line)):
                a, b, c = (int(line[x - n]), int(above[x]), int(above[x - n])) if x >= n else (0, int(above[x]), 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))
                line[x] = (int(line[x]) + guess) & 255
        out[y] = above = line
    return out.reshape(height, width, n)[:, :, : 3 if n > 2 else 1]


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels as float32, or None for what isn't an image."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            px = _png(data)
        else:
            kind, w, h, top = map(int, (m := _HEADER.match(data)).groups())
            if top > 255 or not 0 < w * h <= MOST_PIXELS:
                return None
            n = 3 if kind == 6 else 1
            px = np.frombuffer(data, np.uint8, w * h * n, m.end()).reshape(h, w, n)
        return px.astype(np.float32).mean(2)
    except (TypeError, AttributeError, ValueError, struct.error, zlib.error):
        return None


def resized(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    y = ((np.arange(h) + 0.5) * img.shape[0] / h - 0.5).clip(0, img.shape[0] - 1)
    x = ((np.arange(w) + 0.5) * img.shape[1] / w - 0.5).clip(0, img.shape[1] - 1)
    y0, x0 = y.astype(int).clip(0, max(img.shape[0] - 2, 0)), x.astype(int).clip(0, max(img.shape[1] - 2, 0))
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    up, down = img[y0], img[y1]
    return (up[:, x0] * (1 - fx) + up[:, x1] * fx) * (1 - fy) + (down[:, x0] * (1 - fx) + down[:, x1] * fx) * fy


def boxed(img: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r + 1, edges repeated."""
    k = 2 * r + 1
    for axis in (0, 1):
        pad = np.pad(img, [(r + 1, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge").astype(np.float64)
        total = np.cumsum(pad, axis)
        img = (total[k:] - total[:-k] if axis == 0 else total[:, k:] - total[:, :-k]) / k
    return img


def _pairs() -> np.ndarray:
    """128 point pairs (y, x, y, x), turned in each of the steps of a circle."""
    rng = np.random.default_rng(20)
    pts = rng.normal(0, REACH / 2.2, (128, 2, 2)).clip(-REACH + 3, REACH - 3)
    out = []
    for t in range(_TURNS):
        a = 2 * math.pi * t / _TURNS
        turn = np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])  # on (y, x)
        out.append(np.rint(pts @ turn.T).astype(np.int64))
    return np.array(out)


_PAIRS = _pairs()
_DISC = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if y * y + x * x <= 49])


def describe(grey: np.ndarray, corners: int = CORNERS) -> tuple[np.ndarray, ...]:
    """(y, x in the whole image, scale number, turn in radians, d0, d1) of its corners."""
    found = []
    for s in range(32):
        scale = SCALE**s
        h, w = round(grey.shape[0] * scale), round(grey.shape[1] * scale)
        if min(h, w) <= 2 * REACH + 2:
            break
        img = resized(grey, h, w) if scale != 1 else grey
        soft = boxed(boxed(img, 1), 1)
        gy, gx = np.gradient(soft)
        a, b, c = boxed(gy * gy, 2), boxed(gx * gx, 2), boxed(gy * gx, 2)
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        core = strength[1:-1, 1:-1]
        peak = np.zeros(strength.shape, bool)
        around = [strength[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
        peak[1:-1, 1:-1] = (core > np.max(around, 0)) & (core > 1.0)
        peak[:REACH] = peak[-REACH:] = False
        peak[:, :REACH] = peak[:, -REACH:] = False
        y, x = np.nonzero(peak)
        cell = y // CELL * (w // CELL + 1) + x // CELL
        order = np.lexsort((-strength[y, x], cell))
        place = np.arange(len(order)) - np.searchsorted(cell[order], cell[order])
        best = np.sort(order[place < corners])
        y, x = y[best], x[best]
        if not len(y):
            continue
        disc = soft[y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
        angle = np.arctan2(disc @ _DISC[:, 0], disc @ _DISC[:, 1])
        pts = _PAIRS[np.rint(angle / (2 * math.pi) * _TURNS).astype(int) % _TURNS]
        near = soft[y[:, None, None] + pts[..., 0], x[:, None, None] + pts[..., 1]]
        bits = np.packbits(near[..., 0] < near[..., 1], axis=1).view(">i8").astype(np.int64)
        found.append((y / scale, x / scale, np.full(len(y), s), angle, bits[:, 0], bits[:, 1]))
    if not found:
        return tuple(np.zeros(0, t) for t in (float, float, np.int64, float, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found))


def packed(y, x, s, a) -> np.ndarray:
    """A corner's place as one long: y and x in 20 bits, scale in 5, turn in 16."""
    turn = np.rint(a / (2 * math.pi) * 65536).astype(np.int64) & 0xFFFF
    return np.rint(y).astype(np.int64) << 41 | np.rint(x).astype(np.int64) << 21 | s.astype(np.int64) << 16 | turn


def unpacked(geo: np.ndarray):
    return (geo >> 41).astype(float), (geo >> 21 & 0xFFFFF).astype(float), geo >> 16 & 31, (geo & 0xFFFF) * (2 * math.pi / 65536)


def described(images: DataFrame, id_col: str, image_col: str, corners: int) -> DataFrame:
    """(image_id, tag, pixels, geo, d0, d1): arrays of an image's corners;
    ``pixels`` is the digest of its grey levels, null for what isn't an image."""
    rows = images.select(F.col(f"`{id_col}`").alias("image_id"), F.col(f"`{image_col}`").alias("image")).withColumn("tag", F.monotonically_increasing_id())

    def run(it):
        for b in small(it, "image"):
            pixels, cols = [], [[] for _ in range(3)]
            for data in b.column("image").to_pylist():
                grey = decode(data)
                pixels.append(None if grey is None else hashlib.sha256(repr(grey.shape).encode() + grey.tobytes()).digest())
                y, x, s, a, d0, d1 = describe(np.zeros((1, 1), np.float32) if grey is None else grey, corners)
                for c, v in zip(cols, (packed(y, x, s, a), d0, d1)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("image_id"), b.column("tag"), pa.array(pixels, pa.binary()), *[pa.array(c, pa.list_(pa.int64())) for c in cols]], names=["image_id", "tag", "pixels", "geo", "d0", "d1"])

    kind = rows.schema["image_id"].dataType.simpleString()
    return map_arrow(rows, run, f"image_id {kind}, tag long, pixels binary, geo array<long>, d0 array<long>, d1 array<long>")


def agreeing(side: np.ndarray, key: np.ndarray, other: np.ndarray, tag: np.ndarray, part: np.ndarray, radius: int, first: int, cut: np.ndarray | None = None):
    """Yield (earlier, later) rows that agree in side and key, differ in at most
    ``radius`` bits of ``other``, are of different tags and, where there are two
    parts, of different parts; a row has its ``first`` earliest partners, and
    ``cut`` is set for rows that have more."""
    order = np.lexsort((part, tag, key, side))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(side[order]) != 0)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(order)))
    two = len(part) and part.min() != part.max()
    for m in np.unique(sizes[sizes > 1]).tolist():
        own = starts[sizes == m]
        for at in range(0, len(own), max(1, 4_000_000 // (m * min(m, 512)))):
            rows = order[own[at : at + max(1, 4_000_000 // (m * min(m, 512)))][:, None] + np.arange(m)]
            met = np.zeros((len(rows), 1, m), np.int64)  # partners so far of each later row
            for k in range(0, m, 512):
                left = rows[:, k : k + 512]
                hit = np.bitwise_count(other[left][:, :, None] ^ other[rows][:, None]) <= radius
                hit &= tag[left][:, :, None] < tag[rows][:, None]
                if two:
                    hit &= part[left][:, :, None] != part[rows][:, None]
                count = np.cumsum(hit, 1) + met
                met = count[:, -1:]
                g, i, j = np.nonzero(hit & (count <= first))
                yield left[g, i], rows[g, j]
            if cut is not None:
                cut[rows[met[:, 0] > first]] = True


def across(side: np.ndarray, key: np.ndarray, other: np.ndarray, tag: np.ndarray, part: np.ndarray, root: np.ndarray, early: np.ndarray, radius: int, block: int = BLOCK):
    """Yield all (earlier, later) rows that agree as ``agreeing`` says, without a
    limit, but only those of different classes ``root`` whose earlier row is one of
    ``early``."""
    order = np.lexsort((tag, key, side))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(side[order]) != 0)
    ends = np.append(np.flatnonzero(new)[1:], len(order))[np.cumsum(new) - 1]
    two = len(part) and part.min() != part.max()
    left = np.flatnonzero(early[order])
    after = ends[left] - left - 1
    total, at = np.cumsum(after), 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, total[at] - after[at] + block, "right")))
        n = after[at:to]
        i = np.repeat(left[at:to], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        p, q = order[i], order[j]
        keep = (root[p] != root[q]) & (tag[p] < tag[q]) & (np.bitwise_count(other[p] ^ other[q]) <= radius)
        if two:
            keep &= part[p] != part[q]
        yield p[keep], q[keep]
        at = to


def _bucket_matches(radius: int, first: int):
    def run(table: pa.Table) -> pa.Table:
        side, key, other, tag, geo, part = (table.column(c).to_numpy() for c in ("side", "key", "other", "tag", "geo", "part"))
        cut = np.zeros(len(tag), bool)
        made = list(agreeing(side, key, other.view(np.uint64), tag, part, radius, first, cut))
        p, q = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*made) if made else ((), ())))
        keys = np.unique(np.stack([side[cut], key[cut]], 1), axis=0)
        found = pa.table({"a": tag[p], "b": tag[q], "ga": geo[p], "gb": geo[q]})
        return pa.concat_tables([found, pa.table({"side": keys[:, 0].astype(np.int32), "key": keys[:, 1]})], promote_options="default")

    return run


def half_rows(points: DataFrame) -> DataFrame:
    """(tag, geo, side, key, other): both rows of each corner of ``points``."""
    corner = points.select("tag", F.explode(F.arrays_zip("geo", "d0", "d1")).alias("c"))
    return corner.select("tag", "c.geo", F.expr("stack(2, 0, c.d0, c.d1, 1, c.d1, c.d0) as (side, key, other)"))


def by_bucket(rows: DataFrame, count: int, chunk: int):
    """The ``count`` rows grouped to buckets of keys and, of keys with very many
    rows, to pairs of chunks; ``part`` is a row's chunk."""
    # Which keys are cut is told by a sample; it changes no result.  At most 100,000 keys
    # can have so large a share of the rows.
    share = max(chunk, count // 100_000)
    hot = rows.where("pmod(xxhash64(tag, geo), 64) = 0").groupBy("side", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") * 64 > share)
    hot = F.broadcast(stage(hot.select(F.col("side").alias("h_side"), F.col("key").alias("h_key"), F.ceil(F.col("m") * 64 / chunk).cast("int").alias("parts")), "hot"))
    dealt = rows.join(hot, (F.col("side") == F.col("h_side")) & (F.col("key") == F.col("h_key")), "left").drop("h_side", "h_key")
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("tag"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    buckets = bucket_count(count, BUCKET)
    dealt = dealt.select(*rows.columns, "part", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), F.pmod(F.xxhash64("side", "key"), F.lit(buckets)).cast("int").alias("bucket"))
    return dealt.groupBy("bucket", "i", "j")


def first_matches(points: DataFrame, n: int, radius: int, first: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b, ga, gb, side, key): ``matches``, and rows that have only side and key,
    of the keys where ``first`` left out matches."""
    return by_bucket(half_rows(points), 2 * n, chunk).applyInArrow(_bucket_matches(radius, first), "a long, b long, ga long, gb long, side int, key long")


def matches(points: DataFrame, n: int, radius: int, first: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b, ga, gb) of matching corners of different images, a < b, of
    ``points`` (tag, geo, d0, d1), arrays with ``n`` corners in all; a match may
    come from both tables."""
    return first_matches(points, n, radius, first, chunk).where("a is not null").select("a", "b", "ga", "gb")


def _often(code: np.ndarray, least: int) -> np.ndarray:
    """Whether a match's code is there ``least`` times."""
    _, at, n = np.unique(code, return_inverse=True, return_counts=True)
    return n[at] >= least


def voted(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, least: int) -> np.ndarray:
    """(a, b) rows of the images that matches of corners ga and gb link.

    A match votes for zoom, turn and where the left image's origin comes to lie
    in the right one; cells of turn and place overlap by half."""
    _, pair = np.unique(np.stack([a, b], 1), axis=0, return_inverse=True)
    pair = pair.reshape(-1)
    # A cell with too few votes can't win, so a match that has none goes early.
    keep = _often(pair, least)
    a, b, ga, gb, pair = a[keep], b[keep], ga[keep], gb[keep], pair[keep]
    ay, ax, az, at = unpacked(ga)
    by, bx, bz, bt = unpacked(gb)
    pair = pair * 64 + (az - bz) + 32
    keep = _often(pair, least)
    if not keep.any():
        return np.zeros((0, 2), np.int64)
    a, b, ga, pair, ay, ax, by, bx, at, bt = (v[keep] for v in (a, b, ga, pair, ay, ax, by, bx, at, bt))
    ratio = SCALE ** (az - bz)[keep].astype(float)
    turn = np.mod(bt - at, 2 * math.pi)
    c, z = np.cos(turn), np.sin(turn)
    oy, ox = np.floor((by - ratio * (c * ay + z * ax)) / 10).astype(np.int64), np.floor((bx - ratio * (c * ax - z * ay)) / 10).astype(np.int64)
    step = np.floor(turn * 24 / (2 * math.pi)).astype(np.int64)
    cell, row = pair, np.arange(len(a))
    for value, ring in ((step, 24), (oy - oy.min(), 0), (ox - ox.min(), 0)):
        value = value[row]
        both = np.concatenate([value, value + 1])
        width = ring or int(both.max()) + 1
        _, cell = np.unique(cell, return_inverse=True)
        cell, row = np.tile(cell, 2) * width + both % width, np.tile(row, 2)
    cells, cell = np.unique(cell, return_inverse=True)
    _, corner = np.unique(ga, return_inverse=True)
    one, at = np.unique(cell * (int(corner.max()) + 1) + corner[row], return_index=True)  # a corner votes once
    n = np.bincount(one // (int(corner.max()) + 1), minlength=len(cells))
    won = row[at[n[one // (int(corner.max()) + 1)] >= least]]
    return np.unique(np.stack([a[won], b[won]], 1), axis=0)


def links(found: DataFrame, least: int, buckets: int) -> DataFrame:
    """(a, b) of images with ``least`` matched corners that agree on a mapping."""

    def run(table: pa.Table) -> pa.Table:
        made = voted(*(table.column(c).to_numpy() for c in ("a", "b", "ga", "gb")), least)
        return pa.table({"a": made[:, 0], "b": made[:, 1]})

    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(run, "a long, b long")


def _bucket_pairs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side, key, other, tag, part, root = (table.column(c).to_numpy() for c in ("side", "key", "other", "tag", "part", "root"))
        early = table.column("early").to_numpy()
        tags, place = np.unique(tag, return_inverse=True)
        for p, q in across(side, key, other.view(np.uint64), tag, part, root, early, radius):
            pair = np.unique(place[p] * len(tags) + place[q])
            yield pa.RecordBatch.from_arrays([pa.array(tags[pair // len(tags)]), pa.array(tags[pair % len(tags)])], names=["a", "b"])

    return run


def decided(pairs: DataFrame, points: DataFrame, radius: int, least: int) -> DataFrame:
    """The (a, b) of ``pairs`` that all matches of the two images link."""
    both = pairs
    for c in ("a", "b"):
        both = both.join(points.select(F.col("tag").alias(c), *[F.col(v).alias(f"{v}_{c}") for v in ("geo", "d0", "d1")]), c)

    def run(it):
        for b in small(small(it, "geo_a", 1 << 18), "geo_b", 1 << 18):
            sizes = [pc.list_value_length(b.column(f"geo_{c}")).to_numpy() for c in "ab"]
            pair = np.concatenate([np.repeat(np.arange(b.num_rows), n) for n in sizes])
            geo, d0, d1 = (np.concatenate([b.column(f"{v}_{c}").flatten().to_numpy() for c in "ab"]) for v in ("geo", "d0", "d1"))
            tag, side = np.tile(np.repeat([0, 1], [n.sum() for n in sizes]), 2), np.concatenate([2 * pair, 2 * pair + 1])
            made = list(across(side, np.concatenate([d0, d1]), np.concatenate([d1, d0]).view(np.uint64), tag, np.zeros(len(tag), int), tag, tag == 0, radius))
            p, q = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*made) if made else ((), ())))
            pair, geo = np.tile(pair, 2)[p], np.tile(geo, 2)
            won = voted(b.column("a").to_numpy()[pair], b.column("b").to_numpy()[pair], geo[p], geo[q], least)
            yield pa.RecordBatch.from_arrays([pa.array(won[:, 0]), pa.array(won[:, 1])], names=["a", "b"])

    return map_arrow(both, run, "a long, b long")


def rest(points: DataFrame, reps: DataFrame, met: DataFrame, roots: DataFrame, radius: int, least: int, chunk: int = CHUNK) -> DataFrame | None:
    """(a, b) links between classes (node, root) that ``met``, the first matches of
    the ``reps`` (tag) among ``points``, left out; None if it left out nothing that
    could link two classes."""
    cut = stage(met.where("side is not null").select("side", "key").distinct(), "cut")
    if not (keys := cut.count()):
        return None
    rows = half_rows(points).join(F.broadcast(cut) if keys <= BROADCAST_KEYS else cut, ["side", "key"], "left_semi")
    rows = stage(rows.join(reps, "tag", "left_semi").join(roots.select(F.col("node").alias("tag"), "root"), "tag", "left").withColumn("root", F.coalesce("root", "tag")), "cut_rows")
    wide = stage(rows.groupBy("side", "key").agg(F.count_distinct("root").alias("held")).where("held > 1"), "wide")
    rows = rows.join(wide, ["side", "key"])
    place = Window.partitionBy("tag").orderBy(F.desc("cost"), "geo")
    corner = rows.groupBy("tag", "root", "geo").agg(F.sum("held").alias("cost")).withColumn("early", F.row_number().over(place) >= least)
    corner = stage(corner.select("tag", "root", "geo", "early"), "corners")
    if not corner.take(1):
        return None
    rows = stage(rows.drop("held", "root").join(corner, ["tag", "geo"]), "wide_rows")
    later = by_bucket(rows, rows.count(), chunk).applyInArrow(_bucket_pairs(radius), "a long, b long")
    # Pairs matched before come to at most their corners that lost nothing and all of those that may have.
    own = stage(corner.groupBy("tag", "root").agg(F.count(F.lit(1)).alias("lost")), "own")
    before = met.where("a is not null").join(own.select(F.col("tag").alias("a"), F.col("root").alias("ra"), "lost"), "a").join(own.select(F.col("tag").alias("b"), F.col("root").alias("rb")), "b")
    before = before.where("ra <> rb").join(corner.select(F.col("tag").alias("a"), F.col("geo").alias("ga"), "early"), ["a", "ga"], "left")
    before = before.groupBy("a", "b", "lost").agg(F.count_distinct(F.when(F.col("early").isNull(), F.col("ga"))).alias("n")).where(F.col("n") + F.col("lost") >= least)
    pairs = stage(later.unionByName(before.select("a", "b")).distinct(), "candidates")
    return decided(pairs, points, radius, least)


def copies(images: DataFrame, id_col: str = "image_id", image_col: str = "image", *, corners: int = CORNERS, radius: int = RADIUS, least: int = LEAST, first: int = FIRST, chunk: int = CHUNK) -> DataFrame:
    """(image_id, class_id, class_size): class_id is the smallest id of the class
    and class_size the images it has."""
    all_images = stage(described(images, id_col, image_col, corners), "described")
    # One image stands for all with its pixels; what isn't an image stands for itself.
    group = F.coalesce(F.col("pixels"), F.concat(F.lit("-"), F.col("tag").cast("string")).cast("binary"))
    groups = stage(all_images.groupBy(group.alias("g")).agg(F.min("tag").alias("rep"), F.count(F.lit(1)).alias("same"), F.min("image_id").alias("least_id")), "groups")
    points, reps = all_images.select("tag", "geo", "d0", "d1"), groups.select(F.col("rep").alias("tag"))
    n = all_images.agg(F.coalesce(F.sum(F.size("geo")), F.lit(0))).first()[0]
    met = stage(first_matches(points.where(F.size("geo") > 0).join(reps, "tag", "left_semi"), n, radius, first, chunk), "matches")
    found = met.where("a is not null").select("a", "b", "ga", "gb")
    roots = components(links(found, least, bucket_count(found.count(), BUCKET)))
    more = rest(points, reps, met, roots, radius, least, chunk)
    if more is not None:
        roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))
    named = stage(groups.join(roots, groups.rep == roots.node, "left").select("g", "least_id", "same", F.coalesce("root", "rep").alias("root")), "named")
    classes = stage(named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("same").alias("class_size")), "classes")
    final = stage(named.join(classes, "root").select("g", "class_id", "class_size"), "final")
    return all_images.select("image_id", group.alias("g")).join(final, "g").select("image_id", "class_id", "class_size")


def draw(vector, size: int = 80) -> np.ndarray:
    """A picture of shapes and textures that the numbers of ``vector`` seed."""
    rng = np.random.default_rng(zlib.crc32(np.asarray(vector, "<f4").tobytes()))
    img = np.full((size, size), rng.integers(90, 166), np.float64)
    yy, xx = np.mgrid[:size, :size]
    for _ in range(10):
        y, x, h, w, level, kind = rng.integers(0, size), rng.integers(0, size), rng.integers(6, 24), rng.integers(6, 24), rng.integers(60, 196), rng.integers(0, 3)
        img[(yy - y) ** 2 + (xx - x) ** 2 < h * h // 3 if kind == 0 else (abs(yy - y) < h // 2) & (abs(xx - x) < w // 2)] = level
    for cells, strength in ((10, 30), (20, 25), (32, 12)):
        img += resized(rng.normal(0, strength, (cells, cells)), size, size)
    return img.clip(0, 255)


def edited(img: np.ndarray, how: int) -> np.ndarray:
    """A crop, a turn, a brighter picture, a smaller one, or one with a stamp."""
    n = img.shape[0]
    if how == 0:
        return img[n // 8 : n - n // 16, n // 16 : n - n // 8]
    if how == 1:
        return np.rot90(img)
    if how == 2:
        return (img * 0.8 + 30).clip(0, 255)
    if how == 3:
        return resized(img, round(n * 0.7), round(n * 0.7))
    out = img.copy()
    out[n // 3 : n // 2, n // 3 : 2 * n // 3] = 255
    return out


def drawn(embeddings: DataFrame) -> DataFrame:
    """(image_id, image) from (vec_id, embedding): a picture of each row, and
    for ids divisible by 10 an edited copy with id -1 - vec_id."""

    def run(it):
        for b in small(it, "embedding", 1 << 16):
            ids, out = [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
                img = draw(v or [])
                ids.append(i)
                out.append(pgm(img))
                if i is not None and i % 10 == 0:
                    ids.append(-1 - i)
                    out.append(pgm(edited(img, i // 10 % 5)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["image_id", "image"])

    return map_arrow(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), run, "image_id long, image binary")

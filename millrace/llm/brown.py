"""Language-model scoring with a Brown class-based bigram model.

P(word | word before) = P(class | class before) * P(word | class).  Counts of
words are exact over all training texts and stay distributed.

Classes maximise the likelihood of the training texts under the class bigram model.
They are found in three steps, each over all training texts:

* exchange: each of the ``head`` most frequent words is a unit, the other words
  share ``tails`` units by a hash of their last letters, and units move, one at a
  time, to the class that raises the likelihood most, until a pass moves none;
* insertion: every other word that comes ``min_count`` times or more is put into
  the class that its neighbours' classes make most likely; the gain is taken to
  first order, a single such word being small against a class;
* class transitions are counted anew with the classes so found.

Words seen less often, and unseen ones, have the class of their unit, so every word
has a class.  The vocabulary that is clustered grows with the corpus, up to ``known``
words, which with their counts are what is broadcast: at most so many, and each
of at most ``WORD_BYTES`` bytes.  Training texts are turned into numbers of known
words once, and the steps read these.

Scoring makes one pass over the texts: class transitions and known words are summed
on the spot; rarer words are joined with the table of counts.  A shared word's rows
are partly summed by document, and the words left to join are the rare ones, so no
key is hot.

Smoothing: transitions add ``beta`` to each class, emissions ``alpha`` to each
word of a class and to one further word, which stands for all unseen ones.

Defined results: null text counts as empty (the end token alone); repeated rows
count and are scored as often as they come; an empty training set gives every
word the same unseen chance; an empty table gives an empty result; null ids are
kept; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, small, stage

END = b"\n"
HEAD, TAILS, CLASSES, KNOWN, MIN_COUNT, WORD_BYTES = 512, 256, 64, 400_000, 50, 64

#: Contexts that a task counts together, and tasks whose counts are summed together.
CONTEXTS, FAN = 4_000_000, 64


def tokens(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased, then the end."""
    return [*text.encode("utf-8").lower().split(), END]


def _count(it):
    """Partial counts of an Arrow stream's words; flushed when many are held."""
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for b in small(it):
        for text in b.column("text").to_pylist():
            held.update(tokens(text))
        if len(held) > 400_000:
            yield out()
            held = Counter()
    if held:
        yield out()


class Places(dict):
    """word -> its number: known words first, then ``tails`` units for the others,
    filled on demand; number 0 is the end."""

    def __init__(self, known: list[bytes], tails: int):
        super().__init__(zip(known, range(len(known))))
        self.known, self.tails, self.base = known, tails, len(known)

    def __missing__(self, word: bytes) -> int:
        place = self.base + tail_of(word, self.tails)
        if len(self) > self.base + 200_000:
            self.clear()
            self.update(zip(self.known, range(self.base)))
        self[word] = place
        return place


def tail_of(word: bytes, tails: int) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % tails


def exchange(pairs: np.ndarray, classes: int, passes: int = 20) -> np.ndarray:
    """Class of each unit from the unit bigram counts; unit 0 has class 0 alone."""
    n = len(pairs)
    free = max(1, min(classes, n) - 1)
    order = 1 + np.argsort(-pairs[1:].sum(1), kind="stable")
    own = np.zeros(n, np.int64)
    own[order] = 1 + np.arange(n - 1) % free
    total = free + 1
    onto = np.zeros((n, total))
    onto[np.arange(n), own] = 1
    table = onto.T @ pairs @ onto

    def f(x):
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(passes):
        moved = 0
        for u in order:
            right, left = np.bincount(own, pairs[u], total), np.bincount(own, pairs[:, u], total)
            loop, old = pairs[u, u], own[u]
            right[old] -= loop
            left[old] -= loop
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= loop
            rows, cols = table.sum(1), table.sum(0)
            gain = (f(table + right) - f(table)).sum(1) + (f(table.T + left) - f(table.T)).sum(1)
            d = np.diag(table)  # the cell of a class with itself gains from both sides
            gain += f(d + right + left + loop) - f(d + right) - f(d + left) + f(d)
            gain -= f(rows + right.sum() + loop) - f(rows) + f(cols + left.sum() + loop) - f(cols)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[old] + 1e-9:
                best = old
            table[best] += right
            table[:, best] += left
            table[best, best] += loop
            own[u] = best
            moved += best != old
        if not moved:
            break
    return own


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams of a table of counts, up to what no class changes."""
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return float(f(table) - f(table.sum(1)) - f(table.sum(0)))


def rank_expr(n):
    """A number that grows with a count and takes a bounded number of values."""
    return F.when(n < 65536, n).otherwise(F.floor(65536 + 1000 * F.log(n / 65536.0))).cast("long")


@dataclass
class Model:
    words: DataFrame  # (word, n) of the training words that aren't known
    tokens: int
    types: int
    known: list[bytes]  # by falling count, the end first
    counts: np.ndarray  # of the known words
    tails: int
    class_of: np.ndarray  # by place
    transition: np.ndarray  # log10 P(class | class before)
    class_tokens: np.ndarray
    class_types: np.ndarray
    alpha: float
    clustered: int  # words with a learned class of their own
    gains: tuple[float, float]  # likelihoods of the classes before and after insertion

    def emission(self, n, cls):
        """log10 P(word | class) of words seen n times."""
        return np.log10((n + self.alpha) / (self.class_tokens[cls] + self.alpha * (self.class_types[cls] + 1)))

    def class_of_word(self, word: bytes) -> int:
        """For single words; numbers of many come from ``Places``."""
        return int(self.class_of[Places(self.known, self.tails)[word]])


def _flat(b: pa.RecordBatch) -> np.ndarray:
    """The places of all texts of a batch, each text after an end."""
    return np.concatenate([[0], b.column("ids").flatten().to_numpy()]).astype(np.int64)


def _pairs(ids: DataFrame, group_of: np.ndarray, size: int) -> np.ndarray:
    """Counts of (group, next group), float[size, size], over all texts."""

    def run(it):
        counts = np.zeros(size * size, np.int64)
        for b in it:
            g = group_of.take(_flat(b))
            counts += np.bincount(g[:-1] * size + g[1:], minlength=size * size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["pair", "n"])

    got = map_arrow(ids, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


def _insert(ids: DataFrame, class_of: np.ndarray, table: np.ndarray, first: int, last: int) -> dict[int, int]:
    """The best class of each word with a place from ``first`` to ``last`` - 1.

    A word's contexts are the classes after and before it.  Tasks hand on the
    contexts of blocks of words, packed; these are summed ``FAN`` tasks at a time,
    so what a task adds up is bounded however many tasks there were."""
    classes = len(table)
    block = 65536 // (2 * classes)  # words, so that a word's context takes two bytes

    def packed(code: np.ndarray, count: np.ndarray, size: int):
        """Arrow columns (block, context, n) of sorted codes."""
        own = code // size
        at = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
        binary = lambda v: pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * v.itemsize).astype(np.int32)), pa.py_buffer(v.tobytes())])
        return [pa.array(own[at[:-1]].astype(np.int32)), binary((code % size).astype(np.uint16)), binary(count.astype(np.int64))]

    def contexts(it):
        held, n, task = [], 0, TaskContext.get().partitionId()

        def out():
            made = packed(*np.unique(np.concatenate(held), return_counts=True), block * 2 * classes)
            return pa.RecordBatch.from_arrays([*made, pa.array(np.full(len(made[0]), task, np.int32))], names=["block", "context", "n", "task"])

        for b in it:
            flat = _flat(b)
            cls = class_of.take(flat)
            at = np.flatnonzero((flat >= first) & (flat < last))  # never the end, so there is a next one
            base = (flat[at] - first) * (2 * classes)
            held += [base + cls[at + 1], base + classes + cls[at - 1]]
            n += 2 * len(at)
            if n > CONTEXTS:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def total(t: pa.Table) -> np.ndarray:
        out = np.zeros(block * 2 * classes, np.int64)
        for context, n in zip(t.column("context").to_pylist(), t.column("n").to_pylist()):
            out[np.frombuffer(context, np.uint16)] += np.frombuffer(n, np.int64)
        return out

    def some(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        own = total(t)
        code = np.flatnonzero(own)
        made = packed(code, own[code], len(own))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *made[1:], pa.array([key[1].as_py()], pa.int32())], names=["block", "context", "n", "task"])

    near = np.log(table + 0.5)
    rows, cols = np.log(table.sum(1) + 0.5 * classes), np.log(table.sum(0) + 0.5 * classes)

    def best(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        counts = total(t).reshape(block, 2 * classes).astype(float)
        own = np.flatnonzero(counts.sum(1))
        after, before = counts[own, :classes], counts[own, classes:]
        gain = after @ near.T + before @ near - after.sum(1)[:, None] * rows - before.sum(1)[:, None] * cols
        gain[:, 0] = -np.inf  # the class of the end
        return pa.table({"word": pa.array((own + key[0].as_py() * block).astype(np.int32)), "cls": pa.array(gain.argmax(1).astype(np.int32))})

    schema = "block int, context binary, n binary, task int"
    made, tasks = map_arrow(ids, contexts, schema), ids.rdd.getNumPartitions()
    while tasks > FAN:
        made, tasks = made.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("block", "task").applyInArrow(some, schema), -(-tasks // FAN)
    found = made.groupBy("block").applyInArrow(best, "word int, cls int").toArrow()
    return dict(zip((found.column("word").to_numpy() + first).tolist(), found.column("cls").to_pylist()))


def fit(docs: DataFrame, text_col: str = "text", *, classes: int = CLASSES, head: int = HEAD, tails: int = TAILS, known: int = KNOWN, min_count: int = MIN_COUNT, alpha: float = 0.5, beta: float = 0.5) -> Model:
    """Learn from every text of ``docs``."""
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    words = stage(map_arrow(texts, _count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    types, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # The words above a count that at most ``known`` words reach.
    fits = (F.octet_length("word") <= WORD_BYTES) & (F.col("word") != F.lit(END))
    ranks = words.where(fits).groupBy(rank_expr(F.col("n")).alias("r")).agg(F.count(F.lit(1)).alias("m")).toArrow()
    least, left = 1 << 62, max(known, 1) - 1
    for r, m in sorted(zip(ranks.column("r").to_pylist(), ranks.column("m").to_pylist()), reverse=True):
        if m > left:
            break
        least, left = r, left - m
    is_known = (fits & (rank_expr(F.col("n")) >= least)) | (F.col("word") == F.lit(END))
    got = words.where(is_known).toArrow()
    n, spelled = got.column("n").to_numpy(), got.column("word").to_pylist()
    order = sorted(range(len(spelled)), key=lambda i: (spelled[i] != END, -n[i], spelled[i]))
    names, counts = [spelled[i] for i in order] or [END], n[order] if len(order) else np.zeros(1, np.int64)
    head = max(1, min(head, len(names)))
    sent = docs.sparkSession.sparkContext.broadcast(names)

    def number(it):
        places = Places(sent.value, tails)
        for b in small(it):
            flat, ends = array("i"), [0]
            for text in b.column("text").to_pylist():
                flat.extend(map(places.__getitem__, tokens(text)))
                ends.append(len(flat))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))], names=["ids"])

    ids = stage(map_arrow(texts, number, "ids array<int>"), "ids")
    unit_of = np.concatenate([np.arange(head), [head + tail_of(w, tails) for w in names[head:]], head + np.arange(tails)]).astype(np.int64)
    unit_class = exchange(_pairs(ids, unit_of, head + tails), classes)
    n_classes = int(unit_class.max()) + 1
    class_of = unit_class[unit_of]
    table = _pairs(ids, class_of, n_classes)
    # Known words stand by falling count: those that come often enough are the first ones.
    last = head + int((counts[head:] >= min_count).sum())
    before = likelihood(table)
    if last > head:
        class_of = class_of.copy()
        found = _insert(ids, class_of, table, head, last)
        class_of[list(found)] = list(found.values())
        table = _pairs(ids, class_of, n_classes)
    smooth = table + beta
    transition = np.log10(smooth / smooth.sum(1, keepdims=True))
    class_tokens = np.bincount(class_of[: len(names)], counts, n_classes)
    class_types = np.bincount(class_of[: len(names)], (counts > 0).astype(float), n_classes)
    tail_class = class_of[len(names) :]

    def sizes(it):
        tok, typ = np.zeros(n_classes), np.zeros(n_classes)
        for b in it:
            c = tail_class[[tail_of(w, tails) for w in b.column("word").to_pylist()]] if b.num_rows else np.zeros(0, np.int64)
            tok += np.bincount(c, b.column("n").to_numpy(), n_classes)
            typ += np.bincount(c, minlength=n_classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_classes)), pa.array(tok), pa.array(typ)], names=["cls", "tok", "typ"])

    for c, tok, typ in map_arrow(words.where(~is_known), sizes, "cls long, tok double, typ double").groupBy("cls").agg(F.sum("tok"), F.sum("typ")).collect():
        class_tokens[c] += tok
        class_types[c] += typ
    return Model(words.where(~is_known), total, types, names, counts, tails, class_of, transition, class_tokens, class_types, alpha, last, (before, likelihood(table)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each whole text."""
    rows = id_text(docs, id_col, text_col).withColumn("tag", F.monotonically_increasing_id())
    kind = rows.schema["doc_id"].dataType.simpleString()
    base = np.log10(model.tokens + model.types + 1)
    edge, n = len(model.known), model.counts.astype(float)
    cls = model.class_of[:edge]
    # By place: known words first, then the units, whose words are joined with their counts.
    blank = np.zeros(model.tails)
    emit, plain = np.concatenate([model.emission(n, cls), blank]), np.concatenate([np.log10(n + 1) - base, blank])
    seen = np.concatenate([model.counts > 0, np.ones(model.tails, bool)])
    sent = docs.sparkSession.sparkContext.broadcast((model.known, model.tails, model.class_of, emit, plain, seen, model.transition))

    def run(it):
        known, tails, class_of, emit, plain, seen, transition = sent.value
        places, first = Places(known, tails), int(class_of[0])
        for b in small(it):
            tag, word, tf, c_out = [], [], [], []
            docs_n, docs_base, docs_score, docs_known = [], [], [], []
            for t, text in zip(b.column("tag").to_pylist(), b.column("text").to_pylist()):
                toks = tokens(text)
                at = np.fromiter(map(places.__getitem__, toks), np.int64, len(toks))
                c = class_of[at]
                rare = np.flatnonzero(at >= edge)
                docs_n.append(len(toks))
                docs_known.append(int(seen[at].sum()) - len(rare))
                docs_base.append(plain[at].sum())
                docs_score.append(emit[at].sum() + transition[np.concatenate([[first], c[:-1]]), c].sum())
                if len(rare):
                    held = Counter([toks[i] for i in rare.tolist()])
                    word += held.keys()
                    tf += held.values()
                    c_out += [int(class_of[places[w]]) for w in held]
                    tag += [t] * len(held)
            k = len(tag)
            null = pa.nulls(k, b.schema.field("doc_id").type)
            zero_i, zero_f = np.zeros(k, np.int64), np.zeros(k)
            m = len(docs_n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[np.array(b.column("tag")), np.array(tag, np.int64)]), pa.concat_arrays([b.column("doc_id"), null]), pa.array([None] * m + word, pa.binary()), pa.array([0] * m + tf, pa.int32()), pa.array([0] * m + c_out, pa.int32())]
                + [pa.array(np.r_[x, z]) for x, z in ((np.array(docs_n, np.int64), zero_i), (np.array(docs_known, np.int64), zero_i), (np.array(docs_base), zero_f), (np.array(docs_score), zero_f))],
                names=["tag", "doc_id", "word", "tf", "cls", "n_tokens", "n_known", "base_score", "score"],
            )

    parts = stage(map_arrow(rows, run, f"tag long, doc_id {kind}, word binary, tf int, cls int, n_tokens long, n_known long, base_score double, score double"), "parts")
    whole = parts.where("word is null").select("tag", "doc_id", F.lit(True).alias("whole"), "n_tokens", "n_known", "base_score", "score")
    norm = np.log10(model.class_tokens + model.alpha * (model.class_types + 1))
    norms = F.array(*[F.lit(float(x)) for x in norm])
    joined = parts.where("word is not null").select("tag", "word", "tf", "cls").join(model.words, "word", "left")
    seen = F.coalesce("n", F.lit(0))
    rare = joined.select(
        "tag", F.lit(None).cast(kind).alias("doc_id"), F.lit(False).alias("whole"), F.lit(0).cast("long").alias("n_tokens"),
        F.when(seen > 0, F.col("tf").cast("long")).otherwise(0).alias("n_known"),
        (F.col("tf") * (F.log10(seen + 1.0) - F.lit(float(base)))).alias("base_score"),
        (F.col("tf") * (F.log10(seen + F.lit(model.alpha)) - F.element_at(norms, F.col("cls") + 1))).alias("score"),
    )
    rare = rare.groupBy("tag").agg(F.max("doc_id").alias("doc_id"), F.lit(False).alias("whole"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.unionByName(rare).groupBy("tag").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]).drop("tag")

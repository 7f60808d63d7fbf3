"""Language identification by cross-parsing entropy.

Of each language a bounded sample of labelled text is made into a suffix
automaton.  A text is parsed against it into phrases, each the longest match
from where the last one ended; a text in the language needs few.  The language
needing fewest phrases, normalised by text length and the logarithm of its
sample's length, wins.

Letters are lower-cased and each stretch of other characters counts as one
separator.  Every letter of every sample has a code; a letter that a language's
sample lacks counts as two phrases: an empty match, and the letter itself.  The automata become transition tables that also count the
phrases closed, so many texts take a step with a few lookups each: dense tables
where the samples have few letters, else sparse ones (an arc stands at the base
of its state plus its letter), with the same result.

Whole texts are parsed, and the parse is that of the whole text.  Texts are cut
into pieces of ``PIECE`` letters that all start at once; then each piece is begun
again from the state in which the piece before it ended, until it meets the first
parse (mostly within ``MEET`` letters), and so on until no end changes.

The sample is bounded by parameters of ``learn``: ``sample_docs`` rows a language,
``doc_chars`` characters of each, at a place chosen by a hash, and
``sample_chars`` characters in all; rows are chosen by a hash of the id, alike in
all runs.  What the driver holds grows with the number of languages only.

Defined results: a null text and one without letters give ``und`` with score 0;
rows with null language are predicted and never learned from; null ids count as
one id in the choice of the sample; ties go to the language first in order;
repeated rows are predicted as often as they come; an empty table gives an empty
result, and with nothing to learn from every text is ``und``; other columns are
ignored by ``predict`` and carried by ``accept``.  Where there was nothing to learn
from, ``accept`` keeps every row whose text has a letter.
"""

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_arrow, parts, small

SAMPLE_DOCS, SAMPLE_CHARS, DOC_CHARS, PIECE, MEET = 200, 24_000, 6_000, 1024, 128

#: Up to this many letters the tables are dense.
DENSE = 160
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0."""
    out = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000 and unicodedata.category(c := chr(cp))[0] == "L":
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


_LETTERS: list = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    return _LETTERS[0]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(text: str) -> np.ndarray:
    """Lower-case letters' code points, with one 0 for each stretch of others."""
    low = letters()[points(text)]
    return low[(low != 0) | np.concatenate([[True], low[:-1] != 0])] if len(low) else low


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of ``seq``."""
    arcs, link, size, last = [{}], [-1], [0], 0
    for c in seq:
        cur = len(arcs)
        arcs.append({}), link.append(0), size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = cur
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(arcs)
                arcs.append(dict(arcs[q])), link.append(link[q]), size.append(size[p] + 1)
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return arcs


class Dense:
    """Next state * 4 + phrases closed, at state * letters + letter."""

    def __init__(self, arcs: list[dict[int, int]], width: int):
        self.width = width
        table = np.full((len(arcs), width), -1, np.int32)
        for s, own in enumerate(arcs):
            for c, t in own.items():
                table[s, c] = t
        root, absent = table[0].copy(), table < 0
        # A failed match closes the open phrase; an unknown letter is two by itself.
        restart = np.where(root < 0, 2, root * 4).astype(np.int32)
        closes = (np.arange(len(arcs)) > 0).astype(np.int32)[:, None]
        self.table = np.where(absent, restart[None] + closes, table * 4).astype(np.int32).reshape(-1)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        return self.table.take(state * self.width + letter)


class Sparse:
    """The same with an arc at ``base[state] + letter``, where its state is named."""

    def __init__(self, arcs: list[dict[int, int]], width: int):
        n = sum(map(len, arcs))
        room = 1 << (4 * n + 2 * width).bit_length()
        self.base = np.full(len(arcs), width, np.int32)
        self.owner, self.to = np.full(room + 2 * width, -1, np.int32), np.zeros(room + 2 * width, np.int32)
        self.restart = np.full(width, 2, np.int32)
        for c, t in arcs[0].items():
            self.restart[c] = t * 4
        rng = np.random.default_rng(0)
        many = sorted((s for s, own in enumerate(arcs) if len(own) > 1), key=lambda s: (-len(arcs[s]), s))
        for s in many:
            letter = np.array(list(arcs[s]))
            while True:
                at = letter + (base := int(rng.integers(0, room)))
                if (self.owner[at] < 0).all():
                    break
            self.base[s], self.owner[at], self.to[at] = base, s, np.array(list(arcs[s].values())) * 4
        one = [s for s, own in enumerate(arcs) if len(own) == 1]
        if one:  # any free place will do; a base may not be negative
            letter, target = np.array([next(iter(arcs[s])) for s in one]), np.array([next(iter(arcs[s].values())) for s in one])
            at = np.flatnonzero(self.owner[width : width + room] < 0)[: len(one)] + width
            self.base[one], self.owner[at], self.to[at] = at - letter, one, target * 4

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        at = self.base.take(state) + letter
        return np.where(self.owner.take(at) == state, self.to.take(at), self.restart.take(letter) + (state > 0))


class Model:
    """A transition table for each language, over one code for all letters."""

    def __init__(self, samples: dict[str, np.ndarray], dense: int = DENSE):
        self.langs = sorted(samples)
        have = np.unique(np.concatenate([*samples.values(), np.zeros(1, np.int32)]))
        self.alphabet = have[have != 0]
        self.width = len(self.alphabet) + 2  # separator first, any other letter last
        self.tables, self.bits = [], []
        for lang in self.langs:
            seq = self.coded(samples[lang])
            self.tables.append((Dense if len(self.alphabet) <= dense else Sparse)(suffix_automaton(seq.tolist()), self.width))
            self.bits.append(math.log2(max(len(seq), 2)))

    def coded(self, low: np.ndarray) -> np.ndarray:
        """Letters as places in the alphabet + 1; 0 stays, others are the last code."""
        if not len(self.alphabet):
            return np.where(low == 0, 0, self.width - 1).astype(np.int32)
        at = np.searchsorted(self.alphabet, low).clip(0, len(self.alphabet) - 1)
        return np.where(low == 0, 0, np.where(self.alphabet[at] == low, at + 1, self.width - 1)).astype(np.int32)

    @staticmethod
    def _walk(table, steps: np.ndarray, lens: np.ndarray, state: np.ndarray, until: int, mark: int = 0):
        """Take up to ``until`` steps, pieces being in order of falling length:
        (state, phrases closed) at the end and after ``mark`` steps."""
        state, count = state.copy(), np.zeros(len(state), np.int64)
        early = state.copy(), count.copy()
        last = min(until, int(lens[0])) if len(lens) else 0
        active = np.searchsorted(-lens, -np.arange(last), "left")  # pieces longer than each step
        for k in range(last):
            if k == mark:
                early = state.copy(), count.copy()
            m = active[k]
            to = table.step(state[:m], steps[k, :m])
            count[:m] += to & 3
            state[:m] = to >> 2
        return state, count, early if mark < last else (state.copy(), count.copy())

    def phrases(self, seqs: list[np.ndarray], piece: int = PIECE, meet: int = MEET) -> np.ndarray:
        """Phrases of each sequence in each language: int64[len(seqs), languages]."""
        out, group, size = np.zeros((len(seqs), len(self.langs)), np.int64), [], 0
        for i, s in enumerate(seqs):
            group.append(i)
            size += -(-len(s) // piece)
            if size >= 16_384 or i == len(seqs) - 1:
                out[group] = self._phrases([seqs[k] for k in group], piece, meet)
                group, size = [], 0
        return out

    def _phrases(self, seqs: list[np.ndarray], piece: int, meet: int) -> np.ndarray:
        cuts = [(i, s[k : k + piece], k + piece >= len(s)) for i, s in enumerate(seqs) for k in range(0, len(s), piece)]
        out = np.zeros((len(seqs), len(self.langs)), np.int64)
        if not cuts:
            return out
        owner, lens = np.array([i for i, _, _ in cuts]), np.array([len(s) for _, s, _ in cuts])
        ends = np.array([e for _, _, e in cuts])
        order = np.argsort(-lens, kind="stable")
        place = np.empty(len(cuts), np.int64)
        place[order] = np.arange(len(cuts))
        steps = np.zeros((len(cuts), int(lens.max())), np.uint8 if self.width < 256 else np.int32)
        for row, at in enumerate(order.tolist()):
            steps[row, : lens[at]] = cuts[at][1]
        steps, lens = np.ascontiguousarray(steps.T), lens[order]
        before = np.full(len(cuts), -1)  # the piece that a piece goes on from, by place
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        before[place[follows]] = place[follows - 1]
        for g, table in enumerate(self.tables):
            begun = np.zeros(len(cuts), np.int64)
            state, count, early = self._walk(table, steps, lens, begun, piece, meet)
            while True:
                again = np.flatnonzero((before >= 0) & (begun != state[before]))
                if not len(again):
                    break
                begun[again] = state[before[again]]
                met_state, met_count, _ = self._walk(table, steps[:, again], lens[again], begun[again], meet)
                met = met_state == early[0][again]
                at = again[met]
                count[at] += met_count[met] - early[1][at]
                early[1][at] = met_count[met]
                at = again[~met]
                if len(at):
                    state[at], count[at], now = self._walk(table, steps[:, at], lens[at], begun[at], piece, meet)
                    early[0][at], early[1][at] = now
            count[place[ends]] += state[place[ends]] > 0  # the phrase that the end of the text closes
            out[:, g] = np.bincount(owner, count[place], len(seqs))
        return out

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        seqs = [folded(t) if t else np.zeros(0, np.int32) for t in texts]
        known = [bool((s != 0).any()) and bool(self.langs) for s in seqs]
        seqs = [self.coded(s) if k else s[:0] for s, k in zip(seqs, known)]
        if not any(known):
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cost = self.phrases(seqs) * np.array(self.bits)[None] / np.maximum([len(s) for s in seqs], 1)[:, None]
        best = cost.argmin(1)
        rows = np.arange(len(texts))
        least = cost[rows, best]
        cost[rows, best] = np.inf
        second = cost.min(1) if len(self.langs) > 1 else np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, second / np.maximum(second + least, 1e-12))
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], [float(s) if k else 0.0 for s, k in zip(score, known)]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, doc_chars: int = DOC_CHARS) -> Model:
    """Learn from the labelled rows of ``docs``; what reaches the driver is at
    most about 2 * sample_docs * doc_chars characters a language."""
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").alias("lang"), F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("sample")).alias("h"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model({})
    below = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * sample_docs / n)))])
    u = F.col("h").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    got = rows.where(u < below[F.col("lang")]).select("lang", "h", F.expr(f"substring(text, cast(1 + pmod(h, greatest(char_length(text) - {doc_chars}, 0) + 1) as int), {doc_chars})").alias("text")).collect()
    samples = {}
    for lang in sizes:
        own = sorted((r.h, r.text) for r in got if r.lang == lang)[:sample_docs]
        parts, size = [np.zeros(1, np.int32)], 0
        for _, text in own:
            if size < sample_chars:
                parts += [folded(text), np.zeros(1, np.int32)]
                size += len(parts[-2])
        samples[lang] = np.concatenate(parts)[:sample_chars]
    return Model({k: v for k, v in samples.items() if (v != 0).any()})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((model, letters()))

    def run(it):
        own, table = sent.value
        _LETTERS[:] = [table]
        for b in small(it):
            lang, score = own.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that have a language (not ``und``) with at least
    ``least_score``, all columns as they were: a filter, row by row, without a
    shuffle or join."""
    sent = docs.sparkSession.sparkContext.broadcast((model, letters()))

    @F.pandas_udf("boolean")
    def fits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, table = sent.value
        _LETTERS[:] = [table]
        for texts in batches:
            kept: list[bool] = []
            for b in parts(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])):
                own_texts = b.column("text").to_pylist()
                if own.langs:
                    kept += [x != UNKNOWN and s >= least_score for x, s in zip(*own.predict(own_texts))]
                else:
                    kept += [bool(letters()[points(t)].any()) for t in own_texts]
            yield pd.Series(kept, dtype=bool)
        give_back()

    return docs.where(fits(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


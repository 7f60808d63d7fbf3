"""BPE by a tokenization automaton.

The automaton reads token labels; a label sequence is accepted exactly if it is
the BPE tokenization of the string it spells.  It starts as one state with a
loop for each byte and is rebuilt for each merge (u, v) -> w, in order, by the
merge gadget: the state q that u leads to is replaced, for u, by a copy of q
without the arc v, and each state with an arc u gets an arc w to where v led.

All arcs of one label lead to one state, and a state is only ever copied or
given arcs, so a gadget is stored in constant space: which arc the copy lacks,
and since when.  An arc's existence is read off by undoing the gadgets, once,
into a transition table (of at most ``TABLE`` arcs, those met) that is looked up.

A merge is live only if its gadget was applied: where its two parts can't stand
together any more it never happens.  Where two live merges make one token, or a
merge stands before one that makes a part of it, gadgets in the order of the
merges don't give the tokenizer's result; such a file (none of the trained ones)
is encoded by merging instead (``merges``).

A string's every prefix has one tokenization, so the path of a word is found
from left to right: the last label of prefix i is the only label ending there
that the state reached at its start can take.  Decoding emits the labels'
bytes along the arcs.

Defined results: null text counts as empty and has no ids; special tokens'
strings in a text are their ids; ids that aren't valid UTF-8 decode with
replacement characters; null ids are kept; repeated rows and an empty table are as
they come; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import grouped, id_text, map_arrow
from .merges import Merges
from .vocab import BYTES, LETTERS, SPELLED, Kept, Words, byte_level

#: How the library's byte-level pre-tokenizer cuts texts; other files are refused.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Arcs kept in the transition table, and bytes of words whose ids are kept.
TABLE, WORDS_BYTES = 1_000_000, 80 << 20


class Unfit(ValueError):
    """The automaton can't be built by gadgets in the order of the merges."""


class Automaton:
    """``arc(label, next)``: whether the state after ``label`` has an arc ``next``.

    ``removed[u, v]`` is the time at which the state after u was replaced by a
    copy without v; a label made of (left, right) leads, when made, to the state
    that right then led to, and exists as an arc where left then did."""

    def __init__(self, labels: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        size = max(labels.values(), default=-1) + 1
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        self.removed: dict[int, int] = {}
        self.spelled = {i: b for b, i in labels.items()}
        self.live = {b: i for b, i in labels.items() if len(b) == 1}
        self.table: dict[int, bool] = {}
        self.states, waiting = 1, set()
        for time, (a, b) in enumerate(merges):
            if a in self.live and b in self.live and a + b in labels and self._gadget(time, labels[a], labels[b], labels[a + b]):
                if a + b in waiting:
                    raise Unfit("a merge stands before one that makes a part of it")
                self.live[a + b] = labels[a + b]
            waiting.update(x for x in (a, b) if x not in self.live)
        self.table.clear()
        self.ends = ahocorasick.Automaton()  # the labels that end at each byte
        for b, i in self.live.items():
            self.ends.add_word(b.decode("latin-1"), (len(b), i))
        self.ends.make_automaton()

    def _gadget(self, time: int, u: int, v: int, w: int) -> bool:
        if not self._has(u, v):  # u v can't stand together any more
            return False
        if self.made[w] >= 0 or len(self.spelled[w]) == 1:
            raise Unfit("two merges make one token")
        self.removed[u << 24 | v] = time
        self.left[w], self.right[w], self.made[w] = u, v, time
        self.states += 1
        return True

    def _has(self, u: int, v: int) -> bool:
        """Undo the gadgets from the youngest: an arc is there unless a copy made
        up to ``time`` removed it; before v was made it stands for v's left
        part, before u was made the state is that after u's right part."""
        made, removed, time = self.made, self.removed, 1 << 62
        while True:
            gone = removed.get(u << 24 | v)
            if gone is not None and gone <= time:
                return False
            if made[v] >= made[u]:
                if made[v] < 0:
                    return True
                time = min(time, made[v])
                v = self.left[v]
            else:
                time = min(time, made[u] - 1)
                u = self.right[u]

    def arc(self, u: int, v: int) -> bool:
        key = u << 24 | v
        known = self.table.get(key)
        if known is None:
            if len(self.table) > TABLE:
                self.table.clear()
            known = self.table[key] = self._has(u, v)
        return known

    def encode(self, word: bytes) -> list[int]:
        """The labels of the only accepted path that spells ``word``."""
        n, arc, table = len(word), self.arc, self.table
        last = [-1] * (n + 1)
        for at, (size, label) in self.ends.iter(word.decode("latin-1")):
            at += 1
            if last[at] < 0:
                if size == at:
                    last[at] = label
                else:
                    known = table.get(last[at - size] << 24 | label)
                    if arc(last[at - size], label) if known is None else known:
                        last[at] = label
        if min(last[1:], default=0) < 0:
            raise ValueError("a byte is no token")
        out = []
        while n:
            out.append(last[n])
            n -= len(self.spelled[last[n]])
        return out[::-1]


def encoder_of(labels: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
    """The function from a word's bytes to its ids."""
    try:
        return Automaton(labels, merges).encode
    except Unfit:
        first = np.array([labels.get(bytes([b]), -1) for b in range(256)])
        plain = Merges(first, first, [(labels[a], labels[b], labels[a + b]) for a, b in merges])

        def encode(word: bytes) -> list[int]:
            if not word:
                return []
            data = np.frombuffer(word, np.uint8)
            if (first[data] < 0).any():
                raise ValueError("a byte is no token")
            return plain(data, np.zeros(1, np.int64), np.array([len(word)]))[0].tolist()

        return encode


class SideBySide:
    """The automaton over many words: what ``Merges`` is to the library."""

    def __init__(self, encode, before: bytes):
        self.kept, self.before = Kept(lambda w: array("I", encode(w)).tobytes(), WORDS_BYTES), before

    def __call__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, kept, before = data.tobytes(), self.kept, self.before
        made = [kept[before + raw[s : s + n]] for s, n in zip(starts.tolist(), sizes.tolist())]
        return np.frombuffer(b"".join(made), "<u4"), np.array([len(x) // 4 for x in made], np.int64)


class Codec:
    """Encoder and decoder of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("not a byte-level file that cuts texts by the usual pattern")
        spell = lambda s: bytes(BYTES[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {spell(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.word = encoder_of(labels, [(spell(a), spell(b)) for a, b in merges])
        self.words = Kept(lambda w: array("I", self.word(w.encode("utf-8"))).tobytes())
        self.pattern = regex.compile(PATTERN)
        spelled = {i: b for b, i in labels.items()} | {i: s.encode() for s, i in self.special.items()}
        self.emit = [spelled.get(i, b"") for i in range(max(spelled, default=-1) + 1)]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        many = Words({True: SideBySide(self.word, b""), False: SideBySide(self.word, b" ")}, LETTERS, False, " ", self._chunk)
        self.encoder = byte_level(many, self._chunk, sorted(self.special))
        self.encoder.whole = self._whole

    def _chunk(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def _whole(self, text: str) -> bytes:
        """A text with special tokens' strings: these are their ids."""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += [self._chunk(text[at : m.start()]), array("I", [self.special[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._chunk(text[at:])])

    def encode(self, text: str) -> list[int]:
        return array("I", self.encoder.encode(text)).tolist()

    def spell(self, ids) -> bytes:
        """The labels of the arcs, one after the other."""
        return b"".join(map(self.emit.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.spell(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One codec a worker process: its automaton and stores serve all its tasks."""
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of whole texts."""
    rows = id_text(docs, id_col, text_col)

    def run(it):
        codec = codec_of(tokenizer)
        for b in grouped(it, size=4 << 20):
            ids, ends = codec.encoder(b.column("text"))
            made = np.split(ids, ends[:-1])
            back = [codec.decode(x.tolist()) for x in made]
            cols = [b.column("doc_id"), pa.array([len(x) for x in made], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in made]), pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in back])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(made, pa.list_(pa.int64())), pa.array(back)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else ""))

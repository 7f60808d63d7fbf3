"""Fast exact use of the public tokenizers: texts are cut, by Arrow, where no
token can cross; the distinct chunks of a group of texts are merged side by side
(``merges``), and the ids of the texts are gathered from those of their chunks.
Nothing is kept from group to group but the ids of chunks that aren't words."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .merges import Merges

#: Bytes of chunks and ids that a worker process keeps; beyond it they are let go.
STORE_BYTES = 16 << 20

#: Longer words, in bytes, are left to the library.
LONGEST = 48

#: White space other than space, tab, line feed and carriage return.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


def load(path: str):
    """The tokenizer of a file, without truncation or padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def safe_chunks(text: str) -> list[str]:
    """Cut ``text`` only at spaces between two characters that aren't white
    space: byte-level pre-splitting of the chunks is then that of the whole."""
    return _SAFE_CUT.split(text) if text else []


class Stretches:
    """Id stretches by number; number 0 has no ids."""

    def __init__(self):
        self.ids, self.sizes, self.n = [], [np.zeros(1, np.int64)], 1

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """The number of the first of the new stretches that ``ids`` is cut into."""
        self.ids.append(ids)
        self.sizes.append(np.asarray(sizes, np.int64))
        self.n += len(sizes)
        return self.n - len(sizes)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the stretches, one after the other, and where each ends."""
        table, size = np.concatenate([np.zeros(0, np.uint32), *self.ids]), np.concatenate(self.sizes)
        start = np.cumsum(size) - size
        sizes = size.take(numbers)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(table)) < 1 << 31 else np.int64
        at = np.repeat((start.take(numbers) - ends + sizes).astype(kind), sizes)
        at += np.arange(total, dtype=kind)
        return table.take(at), ends


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts], np.int64)


class Kept(dict):
    """chunk -> ids as bytes, filled on demand, in two generations: when the younger
    one has half of ``most`` bytes it becomes the older one, whose chunks come back
    when they are met again, so frequent ones stay."""

    def __init__(self, encode: Callable, most: int = STORE_BYTES):
        super().__init__()
        self.encode, self.most, self.size, self.old = encode, most, 0, {}

    def __missing__(self, chunk) -> bytes:
        made = self.old.get(chunk)
        if made is None:
            made = self.encode(chunk)
        self.size += len(chunk) + len(made) + 200  # and what a dict's entry takes
        if self.size > self.most // 2:
            self.old, self.size = dict(self), len(chunk) + len(made) + 200
            self.clear()
        self[chunk] = made
        return made


class Encoder:
    """Ids of whole texts from the ids of their chunks.

    ``cut(texts)`` gives Arrow lists of chunks, of which the first one of a text
    may mean something else than the same chunk later on (``first``).
    ``many(chunks, first)`` encodes an Arrow array of chunks: ids and how many
    each has.  ``uncut`` finds, by a pattern of RE2, the texts that can't be cut:
    ``chunks``, if given, cuts those that have no ``special`` string after all,
    and ``whole`` encodes the others.  Ids of a text are little-endian uint32."""

    def __init__(self, cut: Callable, uncut: str, special: list[str], many: Callable, one: Callable, first: bool, chunks: Callable | None = None):
        self.cut, self.uncut, self.special, self.many, self.first, self.chunks = cut, uncut, special, many, first, chunks
        self.whole, self.kept = one, Kept(one)

    def _uncut(self, text: str) -> bytes:
        if self.chunks and not any(s in text for s in self.special):
            return b"".join(map(self.kept.__getitem__, self.chunks(text)))
        return self.whole(text)

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and where each text's end."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, self.uncut)
        lists = self.cut(pc.if_else(odd, "", texts))
        starts = np.asarray(lists.offsets)[:-1].astype(np.int64) - lists.offsets[0].as_py()
        flat = lists.flatten()
        table = Stretches()
        coded = flat.dictionary_encode()
        numbers = table.add(*self.many(coded.dictionary, False)) + np.asarray(coded.indices).astype(np.int64)
        if self.first:
            coded = flat.take(pa.array(starts)).dictionary_encode()
            numbers[starts] = table.add(*self.many(coded.dictionary, True)) + np.asarray(coded.indices)
        whole = np.flatnonzero(np.asarray(odd))
        if len(whole):
            numbers[starts[whole]] = table.add(*joined([self._uncut(texts[i].as_py()) for i in whole.tolist()])) + np.arange(len(whole))
        if end is not None:
            last = table.add(np.array([end], np.uint32), [1])
            numbers = np.insert(numbers, np.append(starts[1:], len(numbers)), last)
            starts = starts + np.arange(n)
        ids, ends = table.gather(numbers)
        return ids, ends[np.append(starts[1:], len(numbers)) - 1]

    def encode(self, text: str) -> bytes:
        return self(pa.array([text]))[0].tobytes()


def byte_level(many: Callable, one: Callable, special: list[str]) -> Encoder:
    """Byte-level BPE.  Cutting at every space is exact unless white space stands
    before a space, or there is white space of another kind."""
    uncut = "|".join(["[ \n\t\r] ", _ODD_SPACE.pattern, *map(re.escape, special)])
    return Encoder(lambda texts: pc.split_pattern(texts, " "), uncut, special, many, one, True, safe_chunks)


#: Byte-level files spell a byte as a printable letter: printable bytes of
#: Latin-1 stand for themselves, the others for the letters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED: dict[int, str] = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
BYTES: dict[str, int] = {c: b for b, c in SPELLED.items()}


#: Letters of which a run is a piece of its own for either kind of file, and
#: what may follow it: ASCII that doesn't begin with a letter, or nothing.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
LETTERS = LATIN + "Ā-ɏΑ-ΡΣ-Ωα-ωЀ-ҁҊ-ԯぁ-ゖァ-ヺ一-龥가-힣"
_REST = r"[\x00-\x40\x5b-\x60\x7b-\x7f][\x00-\x7f]*"


class Words:
    """Encodes chunks that begin with a run of ``letters``: the run is merged
    side by side with the others, and what follows it, which is seldom new, goes
    to the library (``one``), as other chunks do."""

    def __init__(self, merges: dict[bool, Callable], letters: str, lower: bool, space: str, one: Callable):
        self.merges = merges  # for the first chunk of a text, and for the others
        self.kept, self.lower = {True: Kept(one), False: Kept(lambda x: one(space + x))}, lower
        self.pattern = f"^(?P<head>[{letters}]+)(?P<rest>(?:{_REST})?)$"

    def __call__(self, words: pa.Array, first: bool) -> tuple[np.ndarray, np.ndarray]:
        made = pc.extract_regex(words, self.pattern)
        heads = pc.struct_field(made, [0])
        fits = np.asarray(pc.fill_null(pc.less_equal(pc.binary_length(heads), LONGEST), False))
        at, table = np.flatnonzero(fits), Stretches()
        numbers = np.zeros((len(words), 2), np.int64)
        if len(at):
            place = pa.array(at)
            heads, rests = heads.take(place), pc.struct_field(made, [1]).take(place)
            coded = (pc.utf8_lower(heads) if self.lower else heads).dictionary_encode()
            ends = np.frombuffer(coded.dictionary.buffers()[1], np.int32)[coded.dictionary.offset :][: len(coded.dictionary) + 1].astype(np.int64)
            data = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)
            numbers[at, 0] = table.add(*self.merges[first](data, ends[:-1], np.diff(ends))) + np.asarray(coded.indices)
            coded = rests.dictionary_encode()
            after = self.kept[True]
            numbers[at, 1] = table.add(*joined([after[x] if x else b"" for x in coded.dictionary.to_pylist()])) + np.asarray(coded.indices)
        left = np.flatnonzero(~fits)
        if len(left):
            numbers[left, 0] = table.add(*joined(list(map(self.kept[first].__getitem__, words.take(pa.array(left)).to_pylist())))) + np.arange(len(left))
        ids, ends = table.gather(numbers.reshape(-1))
        return ids, np.diff(ends[1::2], prepend=0)


def merges_of(path: str, space: bool) -> dict[bool, Merges]:
    """The merges of a file, for words at the beginning of a text and for others,
    before which a ``space`` may stand."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError("not a plain byte-pair model")
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    symbol = lambda suffix: np.array([vocab[SPELLED[b] + suffix] for b in range(256)])
    made = Merges(symbol(""), symbol(end), [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
    return {True: made, False: made.after(vocab[SPELLED[32]]) if space else made}


def _library(path: str) -> tuple[Callable, list[str]]:
    tok = load(path)

    def one(text: str) -> bytes:
        return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()

    return one, sorted(t.content for t in tok.get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """Ids of the tokenizers library for a byte-level file."""
    one, special = _library(path)
    return byte_level(Words(merges_of(path, True), LETTERS, False, " ", one), one, special)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> Encoder:
    """Ids of the tokenizers library for a file that lowers letters and drops
    white space: chunks are the words between white space.  Control characters
    that only Python and Arrow count as white space, and special tokens, send a
    text to the library whole."""
    one, special = _library(path)
    uncut = "[\x1c-\x1f\x85\u180e]|" + "|".join(map(re.escape, special))
    return Encoder(pc.utf8_split_whitespace, uncut, special, Words(merges_of(path, False), LATIN, True, "", one), one, False)

"""Token ids of texts through a table of distinct words, inside one Python worker."""

from __future__ import annotations

import gc
import os
import re
import threading
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa

from . import spans

#: Words that a worker keeps; about 150 MB.
_KEEP = 700_000
#: A run of marks (no apostrophe) after a letter or digit, up to the word's end: a piece of its own anyway.
_STOP = re.compile(rb"(?<=[a-z0-9])[!-&(-/:-@\[-`{-~]+(?=[\t-\r ])")


def _forget(table: dict) -> None:
    """Drop the older half."""
    for key in list(islice(table, len(table) // 2)):
        del table[key]


_loaded: dict = {}
#: Seconds after a task's end at which a worker without a new one forgets its tables.
_IDLE = 3.0
_timer: threading.Timer | None = None


def _drop() -> None:
    _loaded.clear()
    gc.collect()
    spans.trim()


def rest() -> None:
    """At a task's end: tables serve the next task, but are not kept by a worker that other stages need memory beside."""
    global _timer
    wake()
    _timer = threading.Timer(_IDLE, _drop)
    _timer.daemon = True
    _timer.start()


def wake() -> None:
    if _timer is not None:
        _timer.cancel()


class WordEncoder:
    """Encodes a word once and keeps its ids as little-endian 32-bit bytes.

    For tokenizers that ignore case, drop white space and never join across
    it or between a letter and a stop, so that a text's ids are its words'
    ids in order. path names a file of the
    tokenizers library, on every worker.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table: dict[bytes, bytes] = {}

    @staticmethod
    def of(path: str) -> WordEncoder:
        wake()
        if path not in _loaded:
            _loaded[path] = WordEncoder(path)
        return _loaded[path]

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.table]
        if len(self.table) + len(new) > _KEEP:
            _forget(self.table)
            new = [w for w in words if w not in self.table]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.table.update(zip(part, [array("I", e.ids).tobytes() for e in found], strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        # small letters and split-off stops make fewer distinct words; texts that could hold special tokens stay as they are
        split = [t.split() if b"<|" in t else _STOP.sub(rb" \g<0>", t.lower()).split() for t in texts]
        self.learn(set().union(*split) if split else set())
        get = self.table.__getitem__
        return [b"".join(map(get, words)) for words in split]


_WHITE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f" ?[A-Za-z]+(?=[.,])| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


class ChunkEncoder:
    """As WordEncoder, for byte-level tokenizers whose pattern lets a piece begin with one space and never cross white space otherwise: the text splits into words with the space before them, and runs of white space. Texts with a special token's string go to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table: dict[str, bytes] = {}
        self.bytes: dict[bytes, bytes] = {}

    @staticmethod
    def of(path: str) -> ChunkEncoder:
        wake()
        key = "chunks " + path
        if key not in _loaded:
            _loaded[key] = ChunkEncoder(path)
        return _loaded[key]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if any(s in t for s in self.special) else _CHUNK.findall(t) for t in texts]
        wanted = set().union(*[s for s in split if s is not None])
        new = [w for w in wanted if w not in self.table]
        if len(self.table) + len(new) > _KEEP:
            _forget(self.table)
            new = [w for w in wanted if w not in self.table]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.table.update(zip(part, [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)], strict=True))
        get = self.table.__getitem__
        return [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]

    def encode_column(self, column: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of a string column, nulls as empty, end after each text's ids; bounds are the texts' places in ids, one more than texts.

        Texts whose bytes could hold other white space than ASCII's, or a special token, are split by encode; all others at once, at the same places.
        """
        off, data = spans.buffers(column)
        data, off = data[off[0] : off[-1]], off - off[0]
        rare = _RARE[data]
        for content in self.special:
            rare |= data == content.encode()[0]
        slow = np.unique(np.searchsorted(off, np.flatnonzero(rare), "right") - 1)
        cuts = _cuts(data, off)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, off[-1])), pa.py_buffer(data)])
        first = np.searchsorted(cuts, off)
        places = np.ones(len(cuts), bool)
        if len(slow):
            kept = []
            for i in slow:
                text = data[off[i] : off[i + 1]].tobytes().decode()
                if any(c in text for c in self.special) or _OTHER_WHITE.search(text):
                    kept.append(i)
                    places[first[i] : first[i + 1]] = False
            slow = np.array(kept, np.int64)
        if len(slow):
            chunks = chunks.filter(pa.array(places))
            first = np.append(0, np.cumsum(places))[first]
        words = chunks.dictionary_encode()
        coded = [*self._ids(words.dictionary.to_pylist()), end]
        n = len(coded) - 1
        for i in slow:
            coded.append(self.encode([data[off[i] : off[i + 1]].tobytes().decode()])[0])
        # the words' numbers, those of whole texts, and an end after each text
        which = np.concatenate([slow, np.arange(len(off) - 1)])
        put = np.append(np.arange(n + 1, len(coded)), np.full(len(off) - 1, n))
        order = np.argsort(which, kind="stable")
        numbers = np.insert(words.indices.to_numpy().astype(np.int64), first[which[order] + 1], put[order])
        lengths = np.array([len(c) // 4 for c in coded], np.int64)
        ids = pa.array(coded, pa.large_binary()).take(pa.array(numbers))
        total = np.append(0, np.cumsum(lengths[numbers]))
        bounds = np.append(0, total[np.flatnonzero(numbers == n) + 1])
        return np.frombuffer(ids.buffers()[2] or b"", "<u4", int(total[-1])), bounds

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of many distinct words; new ones are encoded, for the next call too."""
        found = [*map(self.bytes.get, words)]
        new = [w for w, f in zip(words, found, strict=True) if f is None]
        if len(self.bytes) + len(new) > _KEEP:
            _forget(self.bytes)
        coded: list[bytes] = []
        for i in range(0, len(new), 20_000):
            coded += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in new[i : i + 20_000]], add_special_tokens=False)]
        self.bytes.update(zip(new, coded, strict=True))
        rest = iter(coded)
        return [next(rest) if f is None else f for f in found]


#: First bytes of white space beyond ASCII in UTF-8.
_RARE = np.zeros(256, bool)
_RARE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_OTHER_WHITE = re.compile(f"[{_WHITE[4:]}]")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOPS = np.zeros(256, bool)
_STOPS[[44, 46]] = True


def _cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where _CHUNK's pieces begin in texts with no other white space than ASCII's; off bounds the texts."""
    if not len(data):
        return np.zeros(0, np.int64)
    begin = np.zeros(len(data) + 1, bool)
    begin[off] = True
    begin = begin[:-1]
    white = spans.SPACE[data]
    cut = begin.copy()
    # white space after a word, and a word after white space: with one space before it, if it is in the same text
    change = np.zeros(len(data), bool)
    np.not_equal(white[1:], white[:-1], out=change[1:])
    change &= ~begin
    cut |= change
    word = np.flatnonzero(change & ~white)
    cut[word - 1] = True
    cut[word[data[word - 1] == 32]] = False
    # a text may begin with white space of one, or with a word; both are cut already. Letters at a word's start, then a stop
    other = np.flatnonzero(~_LETTER[data])
    before = np.append(-1, other[:-1])
    starts = np.flatnonzero(begin)
    stop = _STOPS[data[other]] & (other - before >= 2)
    cut[other[stop & (white[before] | (before < 0))]] = True
    near = np.searchsorted(other, starts)
    ok = near < len(other)
    near, starts = other[near[ok]], starts[ok]
    last = np.append(np.flatnonzero(begin)[1:], len(data))[ok]
    cut[near[_STOPS[data[near]] & (near > starts) & (near < last)]] = True
    return np.flatnonzero(cut)

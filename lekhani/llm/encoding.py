"""Token ids of whole texts by the tokenizers library, with repeated chunks encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash

from .hashing import GOLDEN, mix

#: White space beyond the four usual characters, where cutting at spaces could change a tokenizer's pieces.
_ODD = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
_ENCODERS: dict = {}


#: Kinds of bytes: 1 white space, 2 ASCII letters, 3 ASCII punctuation but the apostrophe, which contractions need.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 13, 32]] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[[x for x in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)) if x != 39]] = 3


def _cuts(b: np.ndarray) -> np.ndarray:
    """Whether a cut before each byte, after the first, is always an edge of the tokenizers' pieces.

    So it is where white space begins, between an ASCII letter and punctuation, and after a single line feed.
    """
    k = _KIND[b]
    p, q = k[:-1], k[1:]
    out = (q == 1) & (p != 1) | (p == 2) & (q == 3) | (p == 3) & (q == 2)
    feed = (b[1:-1] == 10) & (k[:-2] != 1) & (k[2:] != 1)
    out[1:] |= feed
    return out


#: Chunks of up to so many words of 8 bytes are compared as numbers; longer ones as bytes.
_LANES = 4


def _lanes(data: bytes, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first bytes of each chunk as ``_LANES`` numbers, a column each, and a fingerprint of the whole chunk.

    With its length the numbers say exactly what a chunk of up to 8 * ``_LANES`` bytes is.
    """
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), 0, (1,))  # the 8 bytes from each place on
    lanes = np.zeros((_LANES, len(start)), np.uint64)
    name = n.astype(np.uint64) * GOLDEN
    here = np.arange(len(start))
    for k in range(_LANES):
        if k:
            here = here[n[here] > 8 * k]
            if not len(here):
                break
        left = np.minimum(n[here] - 8 * k, 8).astype(np.uint64)
        got = eight[start[here] + 8 * k]
        got &= np.where(left < 8, (np.uint64(1) << (left * np.uint64(8) & np.uint64(63))) - np.uint64(1), ~np.uint64(0))
        lanes[k, here] = got
        name[here] = mix(name[here] ^ got)
    for i in np.flatnonzero(n > 8 * _LANES).tolist():
        name[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + n[i]])
    return lanes, name


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    Texts are cut where both public tokenizers always cut, and only chunks not met before go to the library. A chunk is
    looked up by a fingerprint, then compared with what was found, so no two are ever taken for each other. The table
    is emptied when it holds over ``keep`` chunks. Texts with odd white space, or with the string of an added token,
    which the library matches across cuts, are encoded as a whole.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self.count, self.used = 0, 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.length, self.bytes = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.lanes = np.zeros((_LANES, 1 << 12), np.uint64)
        self.long: dict[int, bytes] = {}
        self.tables = [(np.empty(0, np.uint64), np.empty(0, np.int64))] * 2  # main and recent: names, places

    @staticmethod
    def _room(x: np.ndarray, size: int) -> np.ndarray:
        if size <= x.shape[-1]:
            return x
        more = np.zeros((*x.shape[:-1], max(x.shape[-1] // 2, size - x.shape[-1])), x.dtype)
        return np.concatenate([x, more], axis=-1)

    def _learn(self, chunks: list[bytes], lanes: np.ndarray) -> np.ndarray:
        """Encode chunks; returns their places in the table."""
        got = [x.ids for x in self.tok.encode_batch_fast([c.decode("utf-8", "surrogatepass") for c in chunks], add_special_tokens=False)]
        n, first = np.fromiter(map(len, got), np.int64, len(got)), self.count
        total = int(n.sum())
        self.count += len(chunks)
        self.flat = self._room(self.flat, self.used + total)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
        self.start, self.length, self.bytes, self.lanes = (self._room(x, self.count) for x in (self.start, self.length, self.bytes, self.lanes))
        self.start[first : self.count] = self.used + np.cumsum(n) - n
        self.length[first : self.count] = n
        self.bytes[first : self.count] = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.lanes[:, first : self.count] = lanes
        self.long.update((first + i, c) for i, c in enumerate(chunks) if len(c) > 8 * _LANES)
        self.used += total
        return np.arange(first, self.count)

    def _name(self, names: np.ndarray, places: np.ndarray) -> None:
        recent = self._join(self.tables[1], (names, places))
        if len(recent[0]) * 4 > len(self.tables[0][0]):
            self.tables = [self._join(self.tables[0], recent), tuple(x[:0] for x in recent)]
        else:
            self.tables[1] = recent

    @staticmethod
    def _join(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)

    def _look(self, names: np.ndarray) -> np.ndarray:
        """Places of sorted names; -1 where unknown."""
        out = np.full(len(names), -1, np.int64)
        for known, places in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, names), len(known) - 1)
                hit = known[at] == names
                out[hit] = places[at[hit]]
        return out

    def _places(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place in the table of each chunk, which is learnt if it isn't there."""
        n = end - start
        lanes, names = _lanes(data, start, n)
        unique, first, back = np.unique(names, return_index=True, return_inverse=True)
        place = self._look(unique)
        new = np.flatnonzero(place < 0)
        if len(new):
            i = first[new]
            place[new] = self._learn([data[x:y] for x, y in zip(start[i].tolist(), end[i].tolist(), strict=True)], lanes[:, i])
            self._name(unique[new], place[new])
        place = place[back]
        same = self.bytes[place] == n
        for k in range(_LANES):
            here = np.flatnonzero(n > 8 * k) if k else slice(None)
            same[here] &= self.lanes[k][place[here]] == lanes[k][here]
        for i in np.flatnonzero(n > 8 * _LANES).tolist():
            same[i] = self.long.get(int(place[i])) == data[start[i] : end[i]]
        other = np.flatnonzero(~same).tolist()
        if other:  # one fingerprint, another chunk
            chunk = {i: data[start[i] : end[i]] for i in other}
            where = {c: i for i, c in chunk.items()}
            got = dict(zip(where, self._learn(list(where), lanes[:, list(where.values())]), strict=True))
            place[other] = [got[chunk[i]] for i in other]
        return place

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        plain = [bool(t) and not _ODD.search(t) and not any(x in t for x in self.added) for t in texts]
        coded = [t.encode("utf-8", "surrogatepass") for t, ok in zip(texts, plain, strict=True) if ok]
        out = []
        if coded:
            if self.count > self.keep:
                self._clear()
            data = b"".join(coded)
            edge = np.zeros(len(data) + 1, bool)
            edge[1:-1] = _cuts(np.frombuffer(data, np.uint8))
            firsts = np.concatenate([[0], np.cumsum([len(x) for x in coded])])
            edge[firsts] = True
            where = np.flatnonzero(edge)
            place = self._places(data, where[:-1], where[1:])
            at, n = self.start[place], self.length[place]
            ends = np.cumsum(n)
            flat = self.flat[np.arange(int(ends[-1])) + np.repeat(at - (ends - n), n)]
            cut = np.concatenate([[0], ends])[np.searchsorted(where, firsts[1:-1])]
            out = np.split(flat, cut)
        got = iter(out)
        return [next(got) if ok else np.array(self.tok.encode(t, add_special_tokens=False).ids if t else [], np.uint32) for t, ok in zip(texts, plain, strict=True)]


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(texts: Iterator[str], path: str, chars: int = 2_000_000) -> Iterator[np.ndarray]:
    """The ids of each text in order, some millions of characters at a time."""
    e, some, size = encoder(path), [], 0
    for t in texts:
        some.append(t or "")
        size += len(some[-1])
        if size >= chars:
            yield from e.batch(some)
            some, size = [], 0
    yield from e.batch(some)

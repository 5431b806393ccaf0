"""Whole texts to ids, where tokens never cross certain cuts: each distinct chunk is encoded once while it is cached.

Texts are cut before white space that follows other bytes. Chunks are told apart by two 64-bit hashes, which numpy
computes for all chunks at once from prefix sums; Python sees distinct chunks alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

SPACE = b" "
#: Bytes that are hashed at a time; a longer chunk is not looked up; cached chunks and ids, beyond which a cache starts anew.
_SLAB, _LONG, _CACHE, _CACHED_IDS = 1 << 20, 128, 600_000, 1 << 23
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def strings(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as one byte array, and the places where they start, with the end of the last."""
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in values], dtype=np.int64)))


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one behind the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def gather(table: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> bytes:
    """The strings at these places, joined."""
    flat, starts = table
    return flat[_spread(starts[at], starts[at + 1] - starts[at])].tobytes()


class ChunkEncoder:
    """encode: distinct chunks (UTF-8) to their ids; breaks: the bytes before which a text may be cut."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], breaks: bytes, odd: re.Pattern | None = None):
        self.encode, self.odd = encode, odd
        self.is_break = np.zeros(256, bool)
        self.is_break[list(breaks)] = True
        rng = np.random.default_rng(5)
        self.values = [rng.integers(1, 1 << 63, 256, dtype=np.uint64) for _ in _BASES]
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []
        self._grow(_SLAB + 1024)
        self._empty()

    def _grow(self, n: int) -> None:
        self.size, self.powers = n, []
        for base in _BASES:
            both = [np.full(n, x, np.uint64) for x in (base, np.uint64(pow(int(base), -1, 1 << 64)))]
            for x in both:
                x[0] = 1
            self.powers.append(tuple(np.multiply.accumulate(x) for x in both))

    def _empty(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.flat, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0
        self.count, self.seen = 0, np.zeros(1 << 16, bool)

    def _add(self, fresh: list[bytes]) -> list[int]:
        """Places of new chunks."""
        ids = self.encode(fresh)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(sizes.sum()), self.count + len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.seen = np.concatenate((self.seen, np.zeros_like(self.seen)))
        self.flat[self.used : self.used + total] = np.fromiter((x for own in ids for x in own), np.uint32, total)
        self.starts[self.count + 1 : n + 1] = self.used + np.cumsum(sizes)
        places = list(range(self.count, n))
        self.used, self.count = self.used + total, n
        return places

    def _shrink(self) -> None:
        """Keep the chunks that more than one slab had; none, if they are most of the cache."""
        kept = [(x, place) for x, place in self.cache.items() if self.seen[place]]
        old, starts = self.flat, self.starts
        self._empty()
        if len(kept) > _CACHE // 2:
            return
        at = np.array([place for _, place in kept], np.int64)
        sizes = starts[at + 1] - starts[at]
        ids = old[_spread(starts[at], sizes)]
        self.flat, self.used, self.count = np.concatenate((ids, np.zeros(1 << 16, np.uint32))), len(ids), len(at)
        self.starts = np.concatenate(([0], np.cumsum(sizes), np.zeros(len(at) + (1 << 16), np.int64)))
        self.seen = np.zeros(len(self.starts), bool)
        self.cache = {x: k for k, (x, _) in enumerate(kept)}

    def _slab(self, texts: list[bytes], whole: list[bool]) -> Iterator[np.ndarray]:
        joined = b"".join(texts)
        if not joined:
            yield from (np.zeros(0, np.uint32) for _ in texts)
            return
        if len(joined) >= self.size:
            self._grow(len(joined) + 1024)
        raw = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends_of = np.cumsum(sizes)
        begins_of = ends_of - sizes
        blank = self.is_break[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = blank[1:] & ~blank[:-1]
        for k in np.flatnonzero(whole):
            cut[begins_of[k] : ends_of[k]] = False
        cut[begins_of] = True
        cut[-1] = True
        edges = np.flatnonzero(cut)
        begin, end = edges[:-1], edges[1:]
        hashes = []
        for values, (power, inverse) in zip(self.values, self.powers, strict=True):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[raw] * power[: len(raw)])))
            hashes.append((sums[end] - sums[begin]) * inverse[begin])
        short = np.flatnonzero(end - begin <= _LONG)
        long = np.flatnonzero(end - begin > _LONG)
        _, first, back = np.unique(hashes[0][short], return_index=True, return_inverse=True)
        if (hashes[1][short][first][back] != hashes[1][short]).any():
            first, back = np.arange(len(short)), np.arange(len(short))
        shown = short[first]
        names = [joined[b:e] for b, e in zip(begin[shown].tolist(), end[shown].tolist(), strict=True)]
        get = self.cache.get
        places = [get(x) for x in names]
        fresh = [k for k, x in enumerate(places) if x is None]
        self.seen[[x for x in places if x is not None]] = True
        new = [names[k] for k in fresh]
        for k, x, place in zip(fresh, new, self._add(new), strict=True):
            places[k] = self.cache[x] = place
        at = np.zeros(len(begin), np.int64)
        at[short] = np.array(places, np.int64)[back] if len(short) else 0
        if len(long):
            at[long] = self._add([joined[b:e] for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True)])
        begin_ids, n_ids = self.starts[at], self.starts[at + 1] - self.starts[at]
        ids = self.flat[_spread(begin_ids, n_ids)]
        bounds = np.concatenate(([0], np.cumsum(n_ids)))[np.searchsorted(begin, np.concatenate((begins_of, [len(raw)])))]
        yield from (ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        if len(self.cache) > _CACHE or self.used > _CACHED_IDS:
            self._shrink()

    def __call__(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        wait, whole, held = [], [], 0
        for text in texts:
            raw = text.encode()
            wait.append(raw)
            whole.append(bool(self.odd and not text.isascii() and self.odd.search(text)))
            held += len(raw)
            if held > _SLAB:
                yield from self._slab(wait, whole)
                wait, whole, held = [], [], 0
        yield from self._slab(wait, whole)

"""SentencePiece encoding and decoding by vectorised merge rounds over flat symbol arrays."""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.chunk_encoder import SPACE, ChunkEncoder, gather, strings
from clickloom.llm.shared import sliced

_MARK = "▁"
_NONE = np.int64(1 << 40)  # the rank of a pair that never merges
#: Symbols of a word from which on its merges are found through lists of places by rank, and not by rounds over all symbols.
_LONG_WORD = 256
codecs.register_error("clickloom-each-byte", lambda e: ("\ufffd", e.start + 1))


class Vocabulary:
    """A BPE model with byte fallback, a dummy prefix and no other normalisation, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.end = model.eos_id()
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        symbols = {pieces[i]: i for i in plain}
        for c in sorted({c for i in plain for c in pieces[i]} - symbols.keys()):
            symbols[c] = n + len(symbols)  # a character that is no piece by itself
        ranks = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        found = [
            (symbols[p[:k]], symbols[p[k:]], ranks[model.get_score(i)], i)
            for i, p in ((i, pieces[i]) for i in plain)
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        ]
        left, right, rank, whole = np.array(found, np.int64).T
        order = np.argsort(left << 32 | right)
        self.pairs, self.rank, self.whole = (left << 32 | right)[order], rank[order], whole[order]
        chars = sorted(((ord(c), s) for c, s in symbols.items() if len(c) == 1))
        self.chars, self.char_symbols = (np.array(x, np.int64) for x in zip(*chars, strict=True))
        self.known: dict[int, tuple[int, int]] = {}  # rank and piece by pair, once they are needed one by one
        self.n, self.strange = n, n + len(symbols) + 1  # symbols from strange on are characters of no piece
        shown = {i: pieces[i].replace(_MARK, " ").encode() for i in plain} | {int(i): bytes([b]) for b, i in enumerate(self.byte)} | {model.unk_id(): " ⁇ ".encode()}
        self.marked = np.array([p.startswith(_MARK) for p in pieces])
        self.shown = strings([shown.get(i, b"") for i in range(n)])
        self.decimals = strings([b"%d " % i for i in range(n)])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        hit = self.pairs[at] == key
        return np.where(hit, self.rank[at], _NONE), self.whole[at]

    def merge(self, symbols: np.ndarray, word: np.ndarray, one: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair is left: (symbols, word), in order.

        symbols: of all words, one behind the other; word: rising. With one, one merge after the other; else several
        at once, short words by rounds and long ones by ranks. Where several merges at once make a pair that ranks no
        later, their order might matter: such words are merged again one by one.
        """
        if not len(symbols):
            return symbols, word
        sizes = np.bincount(word)[word]
        long = sizes >= _LONG_WORD
        parts = []
        for own, how in ((~long, self._by_rounds), (long, self._by_ranks)):
            if one or not own.any():
                continue
            merged, of, doubtful = how(symbols[own], word[own])
            parts.append((merged, of))
            if len(doubtful):
                again = np.isin(word, doubtful)
                parts.append(self._one_by_one(symbols[again], word[again]))
        if one:
            parts.append(self._one_by_one(symbols, word))
        symbols, word = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _by_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A round finds the least rank of each word and merges its leftmost non-overlapping places at once; words
        without a pair leave. Also returns the words that it left out as doubtful."""
        done: list[tuple[np.ndarray, np.ndarray]] = [(symbols[:0], word[:0])]
        doubtful: list[np.ndarray] = [word[:0]]
        rank, whole = self._ranks(symbols, word)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(word)])))
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least < _NONE, sizes)
            if not live.all():
                done.append((symbols[~live], word[~live]))
                symbols, word, rank, whole = symbols[live], word[live], rank[live], whole[live]
                sizes, least = sizes[least < _NONE], least[least < _NONE]
                if not len(symbols):
                    break
                starts = np.cumsum(sizes) - sizes
            here = np.flatnonzero(rank == np.repeat(least, sizes))
            here = here[_alternate(np.diff(here) == 1)]
            merged_rank = rank[here]
            symbols[here] = whole[here]
            stay = np.ones(len(symbols), bool)
            stay[here + 1] = False
            new_at = np.cumsum(stay) - 1
            symbols, word, rank, whole = symbols[stay], word[stay], rank[stay], whole[stay]
            at = new_at[here]
            before = at[(at > 0)] - 1
            before = before[word[before] == word[before + 1]]
            touched = np.concatenate((at, before))
            again = touched[touched < len(symbols) - 1]
            joined = word[again] == word[again + 1]
            rank[touched] = _NONE
            again = again[joined]
            rank[again], whole[again] = self.look_up(symbols[again], symbols[again + 1])
            # one rank a word and round
            of_word = np.full(int(word[-1]) + 1, -1, np.int64)
            of_word[word[at]] = merged_rank
            odd = again[rank[again] <= of_word[word[again]]]
            if len(odd):
                bad = np.unique(word[odd])
                doubtful.append(bad)
                keep = ~np.isin(word, bad)
                symbols, word, rank, whole = symbols[keep], word[keep], rank[keep], whole[keep]
        return *(np.concatenate([x[k] for x in done]) for k in (0, 1)), np.concatenate(doubtful)

    def _by_ranks(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _by_rounds, but rank after rank over all words, touching only the places of that rank and around them:
        places wait in lists by rank, and symbols are chained, so that a merge costs the same in a word of any length."""
        symbols, n = symbols.copy(), len(symbols)
        last = np.concatenate((word[1:] != word[:-1], [True]))
        after = np.where(last, -1, np.arange(1, n + 1))
        before = np.where(np.concatenate(([True], last[:-1])), -1, np.arange(-1, n - 1))
        rank, whole = self._ranks(symbols, word)
        gone, bad = np.zeros(n, bool), np.zeros(int(word[-1]) + 1, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[np.argsort(rank[places], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[places])) + 1
            for part in np.split(places, cuts) if len(places) else []:
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        wait(np.flatnonzero(rank < _NONE))
        while ranks:
            r = heapq.heappop(ranks)
            here = np.unique(np.concatenate(waiting.pop(r)))
            here = here[(rank[here] == r) & ~bad[word[here]]]
            if not len(here):
                continue
            here = here[_alternate(after[here[:-1]] == here[1:])]
            right = after[here]
            symbols[here], gone[right], rank[right] = whole[here], True, _NONE
            after[here] = after[right]
            follow = after[here] >= 0
            before[after[here[follow]]] = here[follow]
            touched = np.unique(np.concatenate((here, before[here][before[here] >= 0])))
            rank[touched] = _NONE
            touched = touched[after[touched] >= 0]
            rank[touched], whole[touched] = self.look_up(symbols[touched], symbols[after[touched]])
            low = touched[rank[touched] <= r]
            if len(low):
                several, merges = np.unique(word[here], return_counts=True)
                bad[np.intersect1d(several[merges > 1], word[low])] = True
            wait(touched[rank[touched] < _NONE])
        stay = ~gone & ~bad[word]
        return symbols[stay], word[stay], np.flatnonzero(bad)

    def _one_by_one(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least rank first, of equal ones the leftmost, by a heap."""
        if not self.known:
            self.known.update(zip(self.pairs.tolist(), zip(self.rank.tolist(), self.whole.tolist(), strict=True), strict=True))
        own, of, n = symbols.tolist(), word.tolist(), len(symbols)
        after = [k + 1 if k + 1 < n and of[k + 1] == of[k] else -1 for k in range(n)]
        before = [k - 1 if k and of[k - 1] == of[k] else -1 for k in range(n)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0:
                found = self.known.get(own[k] << 32 | own[after[k]])
                if found:
                    heapq.heappush(heap, (found[0], k, own[k], own[after[k]]))

        for k in range(n):
            offer(k)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            nxt = after[k]
            if own[k] != left or nxt < 0 or own[nxt] != right:
                continue
            own[k], own[nxt] = self.known[left << 32 | right][1], -1
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        merged = np.array(own, np.int64)
        return merged[merged >= 0], word[merged >= 0]

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, whole = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        at = np.flatnonzero(word[:-1] == word[1:])
        rank[at], whole[at] = self.look_up(symbols[at], symbols[at + 1])
        return rank, whole

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of chunks that no piece crosses."""
        if not chunks:
            return []
        texts = [c.decode() for c in chunks]
        codes = np.frombuffer("".join(texts).replace(" ", _MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        at = np.searchsorted(self.chars, codes)
        at[at == len(self.chars)] = 0
        symbols = np.where(self.chars[at] == codes, self.char_symbols[at], self.strange + codes)
        symbols, word = self.merge(symbols, word)
        out: list[list[int]] = [[] for _ in texts]
        bounds = np.searchsorted(word, np.arange(len(texts) + 1))
        values, odd = symbols.tolist(), symbols >= self.n
        by_char = dict(zip(self.char_symbols.tolist(), self.chars.tolist(), strict=True))
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if odd[a:b].any():
                for s in values[a:b]:
                    if s < self.n:
                        out[k].append(s)
                    else:
                        out[k] += self.byte[list(chr(s - self.strange if s >= self.strange else by_char[s]).encode())].tolist()
            else:
                out[k] = values[a:b]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Control ids give nothing, bytes that are no UTF-8 give U+FFFD each."""
        raw = gather(self.shown, ids)
        text = raw.decode(errors="clickloom-each-byte")
        first = ids[(np.diff(self.shown[1])[ids] > 0)][:1]
        return text[1:] if len(first) and text.startswith(" ") and self.marked[first[0]] else text


def _alternate(follows: np.ndarray) -> np.ndarray:
    """Of places in order, where follows tells which ones overlap the one before: every second one of a run, from the left."""
    at = np.arange(len(follows) + 1)
    first = np.maximum.accumulate(np.where(np.concatenate(([True], ~follows)), at, 0))
    return np.flatnonzero((at - first) % 2 == 0)


class Codec:
    """encode and decode of whole texts; encode adds the end id alone."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.chunks = ChunkEncoder(self.vocabulary.encode_chunks, SPACE, re.compile(_MARK))

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        end = np.array([self.vocabulary.end], np.uint32)
        for ids in self.chunks(" " + t if t else "" for t in texts):
            yield np.concatenate((ids, end))

    def decode(self, ids: np.ndarray) -> str:
        return self.vocabulary.decode(ids)

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        return gather(self.vocabulary.decimals, ids)[:-1]


_kept: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The process's codec, so that tasks of one Python worker share a cache."""
    if path not in _kept:
        _kept[path] = Codec(path)
    return _kept[path]


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, ids_text, decoded) for every row of docs.

    model: the path of a model file, readable on every executor. ids: little-endian unsigned 32-bit integers with the
    end id behind; ids_text: the same in decimal, joined by one space; decoded: the text they decode to. A null or
    empty text has the end id alone. Null ids and repeated rows stay; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in sliced(batches):
            ids = list(own.encode(t or "" for t in batch.column("text").to_pylist()))
            columns = [
                batch.column("id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                pa.array([own.decimals(x).decode() for x in ids], pa.string()),
                pa.array([own.decode(x) for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "ids_text", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.col(text_col)).alias("text")).mapInArrow(run, "id long, n_tokens long, ids binary, ids_text string, decoded string")

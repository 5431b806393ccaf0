"""Whole texts to the ids that the tokenizers library gives for them, added tokens included, at less cost.

Two kinds of vocabulary have a short way: byte-level ones, and ones with word ends that lower texts and drop white
space. In both, a text is parted into words that no token crosses; each word goes to the library's model once and is
then looked up. Words of characters whose classes are not plain go to the whole library, with what stands around them
up to the next white space, and so do texts of all other vocabularies. Added tokens part a text first, as in the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Fixed value: how vocabularies with word ends part a text, in their files.
_WORD_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Classes of plain characters: letters, digits and white space; the rest of _PLAIN is neither. None has another normal form.
_L, _N, _B = "A-Za-zªµºÀ-ÖØ-öø-ÿĀ-įı-ſ", "0-9²³¹¼½¾", "\t-\r "
_PLAIN = re.compile("[\x00-\x84\x86-\x9f\xa1-\xffĀ-įı-ſ‐-‧€]*").fullmatch
#: The two ways to part a text, for plain characters.
_byte_words = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_B}{_L}{_N}]+|[{_B}]+(?![^{_B}])|[{_B}]+").findall
_word_words = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_B}{_L}{_N}]+").findall
#: A text in chunks that each begin where white space (Unicode's, which never changes) follows something else.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_chunks = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+").findall
#: A longer text is parted like this first, so that the lists of its words stay short.
_SEGMENT, _gap = 1 << 20, re.compile(f"[^{_WHITE}](?=[{_WHITE}])").search
#: Words of one generation of a cache; a longer word is not kept.
_CACHED, _LONG = 250_000, 128


def _printable() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) if b in plain else chr(256 + b - sum(x < b for x in plain)) for b in range(256)}


_SHOWN = _printable()


class _Cache(dict):
    """Values of make by string. A full cache becomes the old one, from which what is still in use comes back."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= _LONG:
            if len(self) >= _CACHED:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


def _segments(text: str) -> Iterator[str]:
    """text in parts of about _SEGMENT characters, each but the first from white space behind something else on."""
    begin = 0
    while found := _gap(text, begin + _SEGMENT):
        yield text[begin : found.end()]
        begin = found.end()
    yield text[begin:]


class TextEncoder:
    """Ids of texts by a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        self.library = Tokenizer.from_file(path)
        added = {x["content"]: np.array([x["id"]], np.uint32) for x in given["added_tokens"]}
        exact = not any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in given["added_tokens"])
        parted = exact and self._parted(given)
        self.short, self.added = None, added
        if parted:
            words, lowered = parted
            self.part_at = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
            self.short = self._short(words, lowered)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _parted(self, given: dict) -> tuple[Callable[[str], list[str]], bool] | None:
        """How a plain text is parted into words, and whether it is lowered first; nothing for other vocabularies."""
        model, parts, form = given["model"], given["pre_tokenizer"] or {}, given["normalizer"] or {}
        if model["type"] != "BPE" or given["post_processor"] and given["post_processor"]["type"] != "ByteLevel" or given["truncation"]:
            return None
        if parts.get("type") == "ByteLevel" and parts["use_regex"] and not parts["add_prefix_space"] and not form:
            return _byte_words, False
        steps, forms = parts.get("pretokenizers", []), form.get("normalizers", [])
        fits = [x["type"] for x in forms] == ["NFC", "Replace", "Lowercase"] and forms[1]["pattern"] == {"Regex": r"\s+"} and forms[1]["content"] == " "
        fits = fits and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _WORD_PIECES} and steps[0]["invert"] and steps[0]["behavior"] == "Removed"
        return (_word_words, True) if fits and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"] else None

    def _short(self, parted: Callable[[str], list[str]], lowered: bool) -> Callable[[str], np.ndarray]:
        merges = self.library.model.tokenize

        def merged(word: str) -> bytes:
            shown = word if lowered and word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_SHOWN)
            return array("I", [x.id for x in merges(shown)]).tobytes()

        word = _Cache(merged).__getitem__
        other = _Cache(lambda chunk: self._whole(chunk).tobytes()).__getitem__
        if lowered:
            plain = lambda text: b"".join(map(word, parted(text.lower())))
        else:
            plain = lambda text: b"".join(map(word, parted(text)))

        def raw(text: str) -> bytes:
            return plain(text) if _PLAIN(text) else b"".join(plain(c) if _PLAIN(c) else other(c) for c in _chunks(text))

        def short(text: str) -> np.ndarray:
            return np.frombuffer(raw(text) if len(text) <= _SEGMENT else b"".join(map(raw, _segments(text))), "<u4")

        return short

    def encode(self, text: str) -> np.ndarray:
        if self.short is None:
            return self._whole(text)
        if not any(x in text for x in self.added):
            return self.short(text)
        return np.concatenate([self.added[x] if x in self.added else self.short(x) for x in self.part_at(text)])

    def __call__(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        return map(self.encode, texts)


_kept: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The process's encoder of a file, so that tasks of one Python worker share its caches."""
    if path not in _kept:
        _kept[path] = TextEncoder(path)
    return _kept[path]


def forget() -> None:
    """Give up this process's encoders and Arrow's unused memory: Spark uses a Python worker for one stage after another,
    and the next ones that need memory of their own should not pay for the words of those before."""
    _kept.clear()
    pa.default_memory_pool().release_unused()

"""Byte-level BPE ids of whole texts through the ``tokenizers`` library, word by word.

The tokenizer's pre-tokeniser never joins what stands before a space to a space that something
other than white space follows, and takes a line feed between two such characters alone. So a
text is cut there and each distinct piece is encoded once if it is in a bounded cache. The ids
are those of encoding the whole text. Commas and full stops after a letter or digit are pieces of
their own, as they are for the pre-tokeniser. A key of the cache is a piece without its leading
space; a piece that has none has ``\\0`` before it.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np

_CUT = re.compile(r"(?= \S)")
#: A comma or full stop before white space that follows something other than a letter or digit.
_RUN = re.compile(r"[,.](?<![^\W_][,.])[ \n]")
#: White space other than spaces and line feeds.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_OTHER_ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


def _raw(key: str) -> str:
    return key[1:] if key[:1] == "\0" else " " + key


def _regular(t: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters."""
    if "  " in t or " \n" in t or "\n " in t or "\n\n" in t or t[0] in " \n" or t[-1] in " \n":
        return False
    return not any(c in t for c in _OTHER_ASCII_SPACE) if t.isascii() else not _OTHER_SPACE.search(t)


class _Numbers(dict):
    """Numbers for keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


#: Distinct pieces that a worker remembers, and characters encoded at a time.
CACHE = 1_200_000
PART = 1 << 21


class CachedEncoder:
    """``tokenizers`` with a cache of pieces. With ``added``, the strings of added tokens get their ids
    in texts, as the library does it unless told otherwise; without, they are ordinary text."""

    def __init__(self, path: str, cache: int = CACHE, added: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):  # what it would remember is remembered here
            model = self.tokenizer.model
            model._resize_cache(0)
            self.tokenizer.model = model
        self.tokenizer.encode_special_tokens = not added
        tokens = list(self.tokenizer.get_added_tokens_decoder().values()) if added else []
        if self.tokenizer.normalizer is not None and tokens or any(t.lstrip or t.rstrip or t.single_word for t in tokens):
            raise ValueError(f"{path} has added tokens that are more than their own strings")
        self.added = sorted((t.content for t in tokens), key=len, reverse=True)
        self._at_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.opens = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)  # tokens that begin with a space
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(space)]] = True
        self.cache = cache
        self._clear()

    def _clear(self) -> None:
        self.at = _Numbers()
        self.start = np.zeros(1024, dtype=np.int64)
        self.size = np.zeros(1024, dtype=np.int64)
        self.pool = np.zeros(4096, dtype=np.uint32)
        self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))

    def _ids(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these keys in one array, and how many each has. Those without white space
        are encoded as one text, in which a token that begins with a space begins the next key."""
        every = "\n".join(keys)
        if _OTHER_SPACE.search(every) or " " in every or every.count("\n") >= len(keys):
            alone = np.array([k[:1] == "\0" or k.split() != [k] for k in keys], dtype=bool)
        else:
            alone = np.array([k[:1] == "\0" or not k for k in keys], dtype=bool)
        plain, rest = [k for k, x in zip(keys, alone, strict=True) if not x], [k for k, x in zip(keys, alone, strict=True) if x]
        got = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast([_raw(k) for k in rest], add_special_tokens=False)]
        sizes = np.zeros(len(keys), dtype=np.int64)
        sizes[alone] = [len(x) for x in got]
        if not plain:
            return np.concatenate(got) if got else np.zeros(0, np.uint32), sizes
        joined = self.tokenizer.encode_batch_fast([" " + " ".join(plain)], add_special_tokens=False)[0].ids
        joined = np.fromiter(joined, np.uint32, len(joined))
        sizes[~alone] = np.diff(np.append(np.flatnonzero(self.opens[joined]), len(joined)))
        if not len(got):
            return joined, sizes
        out = np.zeros(int(sizes.sum()), dtype=np.uint32)
        of_rest = np.repeat(alone, sizes)
        out[of_rest], out[~of_rest] = np.concatenate(got), joined
        return out, sizes

    def _learn(self, keys: list[str]) -> None:
        """Encode the keys that were numbered last."""
        ids, sizes = self._ids(keys)
        n = len(self.at) - len(keys)
        self.start, self.size = self._room(self.start, n + len(keys)), self._room(self.size, n + len(keys))
        self.pool = self._room(self.pool, self.used + len(ids))
        self.start[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _forget(self, n: int, used: int) -> None:
        """Drop what came after the first ``n`` keys."""
        for k in list(islice(reversed(self.at), len(self.at) - n)):
            del self.at[k]
        self.used = used

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        if not any(a in t for a in self.added for t in texts):
            return self._encode(texts)
        # What stands between added tokens is encoded as a text of its own.
        cut = [self._at_added.split(t) for t in texts]
        ids, sizes = self._encode([x for c in cut for x in c])
        counts = np.array([len(c) for c in cut])
        return ids, np.add.reduceat(sizes, np.cumsum(counts) - counts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[str] = []
        counts = []
        for t in texts:
            if not t:
                counts.append(0)
                continue
            if "\0" in t or not _regular(t):
                own = ["\0" + x for x in _CUT.split(t) if x]
            else:
                if not _RUN.search(t):
                    t = t.replace(", ", " \0, ").replace(". ", " \0. ").replace(".\n", " \0.\n")
                own = t.replace("\n", " \0\n \0").split(" ")
                own[0] = "\0" + own[0]
            counts.append(len(own))
            parts += own
        known, used = len(self.at), self.used
        where = np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))
        if len(self.at) > known:
            self._learn(list(islice(reversed(self.at), len(self.at) - known))[::-1])
        new = len(self.at) - known
        sizes = self.size[where]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.start[where] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        if known >= self.cache:
            if 8 * new > len(parts):  # the texts have changed: start anew
                self._clear()
            else:
                self._forget(known, used)
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
        return ids, np.diff(at)


def portions(texts: list[str], chars: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


_encoders: dict[tuple[str, bool], CachedEncoder] = {}


def encoder(path: str, added: bool = False) -> CachedEncoder:
    """The worker's encoder of that file; it outlives a task where Spark reuses workers."""
    if (path, added) not in _encoders:
        gc.set_threshold(100_000)  # many strings and few cycles
        _encoders[path, added] = CachedEncoder(path, added=added)
    return _encoders[path, added]

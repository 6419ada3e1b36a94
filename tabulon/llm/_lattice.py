"""The piece lattice of one word under a unigram vocabulary.

The tokenizer is the ``tokenizers`` library's Unigram model with byte fallback over the pieces
and scores of a SentencePiece file, behind a Metaspace pre-tokeniser: a text begins with a space
mark, as SentencePiece's dummy prefix, each space opens a new word that begins with a mark, and
words are segmented alone. Its rules: scores add in double
precision; of two ways to a position with the same score the one with the longer last piece stays;
a character that is no piece costs the lowest score less ``UNKNOWN_PENALTY`` and becomes one piece
for each of its UTF-8 bytes. The names of control and byte pieces in a text are ordinary text.

An Aho-Corasick automaton over the pieces yields all matches of a word in one pass, ordered by
where they end, and longest first. Many words at once are segmented with a trie in arrays instead,
which numpy walks at all of them together.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain
from typing import NamedTuple

import numpy as np

#: Fixed values of the model: the space mark and the penalty of unknown characters.
SPACE_MARK = "\u2581"
UNKNOWN_PENALTY = 10.0


class Path(NamedTuple):
    score: float
    ids: tuple[int, ...]


class Trie:
    """Pieces as arrays, which numpy walks at many places at once.

    A state is a place in them. From state ``s`` a character of class ``c`` leads to ``t = base[s] + c`` if
    ``owner[t] == s``, and nowhere otherwise; ``piece[t]`` is the id of the piece that ends there, or -1.
    ``first`` has the state after each class at the beginning, 0 where there is none. Class 0 is any
    character that no piece has.
    """

    STRIDE, TRIES = 7919, 10_000

    def __init__(self, ids: dict[str, int]):
        nodes = {"": 0}
        for p in ids:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        chars = sorted(set().union(*ids))
        class_of = {c: k for k, c in enumerate(chars, 1)}
        self.classes = np.zeros(0x110000, dtype=np.int64)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        n, span = len(nodes), len(chars) + 1
        parent = np.fromiter((nodes[x[:-1]] for x in nodes), np.int64, n)[1:]
        by = np.fromiter((class_of[x[-1]] for x in nodes if x), np.int64, n - 1)
        children = np.bincount(parent, minlength=n)
        order = np.argsort(parent, kind="stable")
        begin = np.cumsum(children) - children
        taken, base, at = np.zeros(2 * n + 2 * span, dtype=bool), np.zeros(n, dtype=np.int64), 0
        room = len(taken) - span
        for node in np.argsort(-children, kind="stable")[: int((children > 1).sum())].tolist():
            own = by[order[begin[node] : begin[node] + children[node]]]
            for _ in range(self.TRIES):
                at = (at + self.STRIDE) % room
                if not taken[at + own].any():
                    break
            else:  # there is room at the end
                at = len(taken)
                taken = np.concatenate((taken, np.zeros(span, dtype=bool)))
            taken[at + own], base[node] = True, at
        alone = np.flatnonzero(children == 1)  # these go wherever there is room
        taken = np.concatenate((taken, np.zeros(span, dtype=bool)))
        base[alone] = (np.flatnonzero(~taken[span:]) + span)[: len(alone)] - by[order[begin[alone]]]
        place = np.concatenate(([0], base[parent] + by))
        self.base, self.owner, self.piece = np.zeros(len(taken) + span, np.int64), np.full(len(taken) + span, -1), np.full(len(taken) + span, -1)
        self.base[place], self.owner[place[1:]] = base, place[parent]
        self.piece[place[[nodes[p] for p in ids]]] = list(ids.values())
        self.first = np.zeros(span, dtype=np.int64)
        self.first[by[parent == 0]] = place[1:][parent == 0]


class Lattice:
    """Matches and segmentations of words under the vocabulary of a SentencePiece file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [float(sp.get_score(i)) for i in range(n)]
        self.unknown_id = sp.unk_id()
        self.unknown_score = min(self.scores) - UNKNOWN_PENALTY
        at = {p: i for i, p in enumerate(self.pieces)}
        self.byte_ids = [at.get(f"<0x{b:02X}>") for b in range(256)]
        if None in self.byte_ids:
            raise ValueError(f"{path} has no byte pieces")
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids) if i is not None}
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if p and not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.automaton.add_word(p, (len(p), self.scores[i], i))
        self.automaton.make_automaton()
        self.score_of = np.array(self.scores)
        self.chars_or_one = np.array([*map(len, self.pieces), 1])  # the last: of an unknown character, whose piece is -1
        self.apart = next(c for c in map(chr, range(0xE000)) if c not in set("".join(self.automaton.keys())))
        as_bytes = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.pieces)]
        self.piece_size = np.array([len(x) for x in as_bytes], dtype=np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(as_bytes), dtype=np.uint8)
        self._trie: Trie | None = None
        # Sums of whole numbers don't depend on where they begin; only then may a word be cut.
        whole = all(x.is_integer() for x in self.scores)
        self.pairs = {a + b for p in self.pieces for a, b in zip(p, p[1:])} if whole else None
        self.line_feed_alone = not any("\n" in p and len(p) > 1 for p in self.pieces)
        self._line_feeds = re.compile("(\n)")

    @property
    def trie(self) -> Trie:
        """The pieces as arrays, made when they are first asked for, and what each character costs alone."""
        if self._trie is None:
            self._trie = Trie({p: i for p, (_, _, i) in self.automaton.items()})
            self.single_id = self._trie.piece[self._trie.first]
            self.single_score = np.where(self.single_id >= 0, self.score_of[self.single_id], self.unknown_score)
        return self._trie

    def cut(self, word: str) -> list[str]:
        """A word with its space mark, cut where two characters stand that are together in no piece:
        around line feeds, and before a last character such as a comma."""
        text, out = SPACE_MARK + word, []
        if self.pairs is None:
            return [text]
        for part in self._line_feeds.split(text) if self.line_feed_alone and "\n" in text else (text,):
            if len(part) > 1 and part[-2:] not in self.pairs:
                out += (part[:-1], part[-1])
            elif part:
                out.append(part)
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text, without their space marks."""
        return text.replace(SPACE_MARK, " ").split(" ") if text else []

    def _unknown(self, ch: str) -> tuple[int, ...]:
        """The byte pieces of a character that is no piece."""
        return tuple(self.byte_ids[b] for b in ch.encode("utf-8", "surrogatepass"))

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation; the dynamic program carries just these two."""
        n = len(text)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        unknown = self.unknown_score
        at, top, held, single = 1, None, 0, False
        for last, (size, score, _) in self.automaton.iter(text):
            if last >= at:  # matches up to here are complete
                while at <= last:
                    if not single and (top is None or best[at - 1] + unknown > top):
                        top, held = best[at - 1] + unknown, pieces[at - 1] + len(text[at - 1].encode("utf-8", "surrogatepass"))
                    best[at], pieces[at] = top, held
                    at, top, single = at + 1, None, False
            start = at - size
            total = best[start] + score
            if top is None or total > top:
                top, held = total, pieces[start] + 1
            single = size == 1
        while at <= n:
            if not single and (top is None or best[at - 1] + unknown > top):
                top, held = best[at - 1] + unknown, pieces[at - 1] + len(text[at - 1].encode("utf-8", "surrogatepass"))
            best[at], pieces[at] = top, held
            at, top, single = at + 1, None, False
        return pieces[n], best[n]

    def edges(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end: (start, score, ids) of what may end there, longest first."""
        into: list[list] = [[] for _ in range(len(text) + 1)]
        for last, (size, score, i) in self.automaton.iter(text):
            into[last + 1].append((last + 1 - size, score, (i,)))
        for end in range(1, len(text) + 1):
            if not into[end] or into[end][-1][0] != end - 1:
                into[end].append((end - 1, self.unknown_score, self._unknown(text[end - 1])))
        return into

    def best(self, text: str) -> tuple[list[int], float, float]:
        """(ids, score, what the second best segmentation scores less) of the best segmentation.

        The second best enters some position of the best path by another edge, along the best
        way to that edge's start, and follows the best path from there.
        """
        n, unknown, least = len(text), self.unknown_score, float("-inf")
        score, via, size_of, loss = [0.0] * (n + 1), [0] * (n + 1), [1] * (n + 1), [0.0] * (n + 1)
        at, top, second, piece, size_in, single = 1, least, least, -1, 1, False
        for last, (size, x, i) in chain(self.automaton.iter(text), ((n, (0, 0.0, -1)),)):
            while at <= last:
                if not single:
                    total = score[at - 1] + unknown
                    if total > top:
                        top, second, piece, size_in = total, top, -1, 1
                    elif total > second:
                        second = total
                score[at], via[at], size_of[at], loss[at] = top, piece, size_in, top - second
                at, top, second, piece, single = at + 1, least, least, -1, False
            if not size:
                break
            total = score[at - size] + x
            if total > top:
                top, second, piece, size_in = total, top, i, size
            elif total > second:
                second = total
            single = size == 1
        ids: list[int] = []
        at, gap = n, float("inf")
        while at:
            gap = min(gap, loss[at])
            if via[at] >= 0:
                ids.append(via[at])
            else:
                ids += self._unknown(text[at - 1])[::-1]
            at -= size_of[at]
        return ids[::-1], score[n], gap

    def best_of_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``best`` gives for each word with its space mark: all ids in one array, and each word's
        number of ids, score, and loss of the second best.

        The words lie by length, longest first, so that those with a character at a position are the first
        ones, and a row holds that character of each of them. From each row on, all words walk the trie
        together, and each piece that ends is held against what its end has. Rows are taken in order, so
        scores are final when they are read, and longer pieces come first.
        """
        m = len(words)
        if not m:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        trie, least = self.trie, float("-inf")
        text = np.frombuffer(SPACE_MARK.join(("", *words)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        size = np.fromiter(map(len, words), np.int64, m) + 1
        order = np.argsort(-size, kind="stable")
        first, size = (np.cumsum(size) - size)[order], size[order]
        longest = int(size[0])
        width = np.searchsorted(-size, -np.arange(longest), side="left")  # words with a character at a position
        rows = [trie.classes[text[first[:k] + p]] for p, k in enumerate(width.tolist())]
        off = np.concatenate(([0, m], m + np.cumsum(width)))
        score, second, via = np.full(off[-1], least), np.full(off[-1], least), np.full(off[-1], -1, dtype=np.int32)
        score[:m] = 0
        of = [slice(lo, hi) for lo, hi in zip(off.tolist(), off[1:].tolist(), strict=False)]
        scores, seconds, vias = ([x[k] for k in of] for x in (score, second, via))
        for p, here in enumerate(rows):
            before = scores[p][: len(here)]
            total, top, own = before + self.single_score[here], scores[p + 1], seconds[p + 1]
            np.maximum(own, np.minimum(total, top), out=own)
            better = total > top
            np.copyto(top, total, where=better)
            np.copyto(vias[p + 1], self.single_id[here], where=better)
            state = trie.first[here]
            at = np.flatnonzero(state)
            state = state[at]
            for q in range(p + 1, longest):
                if len(at) and at[-1] >= width[q]:
                    k = int(np.searchsorted(at, width[q]))
                    at, state = at[:k], state[:k]
                if not len(at):
                    break
                to = trie.base[state] + rows[q][at]
                on = np.flatnonzero(trie.owner[to] == state)
                at, state = at[on], to[on]
                piece = trie.piece[state]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    ends, piece = at[hit], piece[hit]
                    total, top, own = before[ends] + self.score_of[piece], scores[q + 1][ends], seconds[q + 1]
                    own[ends] = np.maximum(own[ends], np.minimum(total, top))
                    better = np.flatnonzero(total > top)
                    ends = ends[better]
                    scores[q + 1][ends], vias[q + 1][ends] = total[better], piece[better]
        place, gap, steps, going = size.copy(), np.full(m, np.inf), [], np.arange(m)
        while len(going):
            end = place[going]
            now = off[end] + going
            gap[going] = np.minimum(gap[going], score[now] - second[now])
            piece = via[now].astype(np.int64)
            place[going] = end - self.chars_or_one[piece]
            odd = np.flatnonzero(piece < 0)
            piece[odd] = -1 - text[first[going[odd]] + end[odd] - 1].astype(np.int64)
            steps.append((order[going], piece))
            going = going[place[going] > 0]
        counts, total, loss = np.zeros(m, dtype=np.int64), np.zeros(m), np.zeros(m)
        total[order], loss[order] = score[off[size] + np.arange(m)], gap
        for of_words, _ in steps:
            counts[of_words] += 1
        stop = np.cumsum(counts)
        out = np.zeros(int(stop[-1]), dtype=np.int64)
        for k, (of_words, piece) in enumerate(steps):
            out[stop[of_words] - 1 - k] = piece
        odd = out < 0
        if odd.any():  # a character for each of whose bytes there is a piece
            as_bytes = (-1 - out[odd]).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            each = np.ones(len(out), dtype=np.int64)
            each[odd] = 1 + sum((-1 - out[odd] >= x).astype(np.int64) for x in (0x80, 0x800, 0x10000))
            counts = np.add.reduceat(each, stop - counts)
            odd, out = np.repeat(odd, each), np.repeat(out, each)
            out[odd] = np.array(self.byte_ids)[np.frombuffer(as_bytes, dtype=np.uint8)]
        return out.astype(np.int32), counts, total, loss

    def nbest(self, word: str, n: int) -> list[Path]:
        """The n best segmentations by a backward A-star search over the lattice.

        Forward Viterbi scores are exact heuristics of what lies before a position. Of equal scores,
        the segmentation with the longer last piece comes first, then the one with the longer piece
        before, and so on; the open ways are kept in that order. Each of them leads to a segmentation
        of its own score, so no more are kept than are still wanted. A way is its first piece and the
        number of the way that follows, so time and memory grow with the word's length.
        """
        text = SPACE_MARK + word
        length = len(text)
        sizes, ids, at = array("i"), array("i"), array("i", [0, 0])  # the edges into each position, longest first
        best, end, top, single = array("d", [0.0]), 1, float("-inf"), False
        for last, (size, x, i) in chain(self.automaton.iter(text), ((length, (0, 0.0, -1)),)):
            while end <= last:  # the edges into this position are complete
                if not single:
                    sizes.append(1)
                    ids.append(-1)
                    top = max(top, best[end - 1] + self.unknown_score)
                best.append(top)
                at.append(len(sizes))
                end, top, single = end + 1, float("-inf"), False
            if not size:
                break
            sizes.append(size)
            ids.append(i)
            top, single = max(top, best[end - size] + x), size == 1
        first, follows = array("i"), array("i")
        ways, out = [(best[length], length, 0.0, -1, 0)], []  # (score of its best completion, position, own score, way that follows, piece)
        while ways and len(out) < n:
            k = max(range(len(ways)), key=lambda w: ways[w][0])
            score, pos, own, after, piece = ways.pop(k)
            if pos < length:
                first.append(piece)
                follows.append(after)
                after = len(first) - 1
            if not pos:
                got, here = [], 0
                while after >= 0:
                    i = first[after]
                    got += (i,) if i >= 0 else self._unknown(text[here])
                    here += len(self.pieces[i]) if i >= 0 else 1
                    after = follows[after]
                out.append(Path(score, tuple(got)))
                continue
            more = []
            for e in range(at[pos], at[pos + 1]):
                i, start = ids[e], pos - sizes[e]
                total = own + (self.scores[i] if i >= 0 else self.unknown_score)
                more.append((best[start] + total, start, total, after, i))
            ways[k:k] = more
            while len(ways) > n - len(out):
                del ways[min(range(len(ways) - 1, -1, -1), key=lambda w: ways[w][0])]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces joined to characters, space marks as spaces but the first."""
        ids = np.asarray(ids, dtype=np.int64)
        sizes = self.piece_size[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.piece_start[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        text = self.piece_bytes[at].tobytes().decode("utf-8", "replace").replace(SPACE_MARK, " ")
        return text[1:] if text[:1] == " " else text


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """The worker's lattice of that file; it outlives a task where Spark reuses workers."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]

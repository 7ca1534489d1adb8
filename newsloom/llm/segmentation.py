"""SentencePiece encoding by sampled segmentations, and decoding.

Every text has a lattice of the pieces that spell it.  Drawing the k largest of
Gumbel-perturbed path weights gives k different segmentations, the same as
drawing without replacement.  The search is A* from the top: a node of the tree
is a prefix of pieces, its bound the largest perturbed weight below it.  The
siblings a path leaves behind at one decision are one node until they are
wanted, so a path costs a few vector operations.

Pieces never reach over a word's start, so a text's lattice is a chain of word
lattices; those of words met before are kept.  Random numbers come from the
row's key, so a repeated task gives the same samples.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SAMPLES = 2
SEED = 17
# Weight of a piece of rank r in a merge vocabulary: (r + 2) ** -SHARPNESS.
SHARPNESS = 2.0
SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
# Lattice positions kept before a worker starts anew.
KEPT = 1_000_000
# Characters of text compiled at a time.
SLICE = 1 << 18


def _mixed(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


# Hashes of prefixes are found by their first bits, a table of so many for each length.
BITS = 16


def _prefix_tables(pieces: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length the sorted hashes of all prefixes of pieces, the piece each spells, or -1, and the first hash for each start of a hash."""
    levels: list[dict[int, int]] = [{} for _ in range(max(map(len, pieces), default=1))]
    for piece, ident in pieces.items():
        h = np.zeros(1, np.uint64)
        for k, c in enumerate(piece):
            h = _mixed(h, np.array([ord(c)], np.uint64))
            levels[k].setdefault(int(h[0]), -1)
        levels[len(piece) - 1][int(h[0])] = ident
    out = []
    for level in levels:
        hashes = np.array(sorted(level), np.uint64)
        begin = np.searchsorted(hashes, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS))
        out.append((hashes, np.array([level[int(x)] for x in hashes], np.int32), np.minimum(begin, len(hashes) - 1).astype(np.int32)))
    return out


def _found(hashes: np.ndarray, begin: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each of ``h`` in the sorted ``hashes``, and whether it is there."""
    place = begin[h >> np.uint64(64 - BITS)]
    held = hashes[place]
    # the first of those that start alike may not be the one
    late = np.flatnonzero(held < h)
    place[late] = np.minimum(np.searchsorted(hashes, h[late]), len(hashes) - 1)
    held[late] = hashes[place[late]]
    return place, held == h


class Lattices:
    """Word lattices of one worker in flat arrays.

    Arcs are ordered by the position they leave, longest piece first, with the
    cumulative probability in ``cum``; ``first`` is where a position's arcs
    begin, ``rest`` the log probability of the other arcs of its position.
    """

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        usable = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.pieces = {self.sp.id_to_piece(i): i for i in usable}
        self.tables = _prefix_tables(self.pieces)
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        scores = np.array([self.sp.get_score(i) for i in range(n)])
        # merge vocabularies store ranks, others log probabilities
        self.weight = -sharpness * np.log(2 - scores) if scores.min() < -1000 else sharpness * scores
        self.rare = float(self.weight[usable].min()) if usable else -1.0
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spelled: list[list[int]] = []
        self.spelling: dict[int, int] = {}
        self.spoken = self._spoken()
        self.clear()

    def _spoken(self) -> list[bytes] | None:
        """UTF-8 of every piece inside a text; None if the decoder does not give a text's pieces one by one."""
        out = [b"\xff"] * self.sp.get_piece_size()  # in no text: unknown pieces are left to the decoder
        for piece, i in self.pieces.items():
            out[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            if self.sp.is_byte(i):
                out[i] = bytes([b])
        # after a letter, so that nothing is at the start
        inner = [self.pieces.get("a", -1), *self.pieces.values()]
        return out if inner[0] >= 0 and self.sp.decode(inner).encode() == b"".join(map(out.__getitem__, inner)) else None

    def restored(self, ids: list[int], text: str) -> bool:
        """Whether the decoder gives ``text``.

        It takes one space away at the start of a text, and joins its pieces.
        What is not the text by that rule is asked of the decoder itself.
        """
        if self.spoken and text and text[0] != " " and b"".join(map(self.spoken.__getitem__, ids)) == b" " + text.encode("utf-8", "surrogatepass"):
            return True
        return self.sp.decode(ids) == text

    def forget(self) -> None:
        """Start anew in the same arrays."""
        self.start: dict[str, int] = {}
        self.nodes = self.arcs = 0

    def clear(self) -> None:
        self.forget()
        self.cum, self.logp, self.rest = (np.zeros(1 << 16, np.float32) for _ in range(3))
        self.piece, self.to, self.first = (np.zeros(1 << 16, np.int32) for _ in range(3))

    def _append(self, name: str, at: int, x: np.ndarray) -> None:
        """Write ``x`` into an array from ``at`` on; a full array grows by a quarter."""
        held = getattr(self, name)
        if at + len(x) > len(held):
            held = np.concatenate((held, np.zeros(max(at + len(x) - len(held), len(held) // 4), held.dtype)))
            setattr(self, name, held)
        held[at:at + len(x)] = x

    def words(self, text: str) -> list[str]:
        shown = self.sp.normalize(text) if text else ""
        if not self.by_word:
            return [shown] if shown else []
        if shown.startswith(SPACE) and not shown.endswith(SPACE) and SPACE * 2 not in shown:
            return [SPACE + w for w in shown[1:].split(SPACE)]
        return _SEGMENT.findall(shown)

    def _spell(self, code: int) -> int:
        """A character without a piece, as bytes: one arc, numbered below zero."""
        if code not in self.spelling:
            ids = [self.bytes[b] for b in chr(code).encode("utf-8", "surrogatepass")]
            self.spelled.append([self.sp.unk_id()] if self.sp.unk_id() in ids else ids)
            self.spelling[code] = -len(self.spelled)
        return self.spelling[code]

    def _arcs(self, codes: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length, from 1 on, the positions with a piece of that length, the piece, and if it ends the word; a position has one a length at most."""
        out = []
        at, h, to_end = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.uint64), left
        for k, (hashes, pieces, begin) in enumerate(self.tables, 1):
            h = _mixed(h, codes[at + (k - 1)])
            place, known = _found(hashes, begin, h)
            piece = np.where(known, pieces[place], -1)
            full = np.flatnonzero(piece >= 0)
            goes_on = to_end > k
            out.append((at[full], piece[full], ~goes_on[full]))
            longer = np.flatnonzero(known & goes_on)
            at, h, to_end = at[longer], h[longer], to_end[longer]
        alone = np.ones(len(codes), bool)
        alone[out[0][0]] = False
        rest = np.flatnonzero(alone).astype(np.int32)
        kinds, back = np.unique(codes[rest], return_inverse=True)
        spelled = np.array([self._spell(int(c)) for c in kinds], np.int32)[back]
        out[0] = tuple(map(np.concatenate, zip(out[0], (rest, spelled, left[rest] == 1))))
        return out

    def starts(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Per text the lattice positions its words start at; words met for the first time are compiled."""
        fresh = [w for w in dict.fromkeys(chain.from_iterable(texts)) if w not in self.start]
        if fresh:
            self._compile(fresh)
        return [np.fromiter(map(self.start.__getitem__, words), np.int32, len(words)) for words in texts]

    def _compile(self, fresh: list[str]) -> None:
        """Add the lattices of new words, and where each starts."""
        codes = np.frombuffer("".join(fresh).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(w) for w in fresh])
        base = len(codes)
        left = (np.repeat(np.cumsum(sizes), sizes) - np.arange(base)).astype(np.int32)
        longest = int(left.max())
        # positions are numbered from the ends of words backwards; numbers of two bytes are sorted by counting
        order = np.argsort(left.astype(np.uint16) if longest < 1 << 16 else left, kind="stable").astype(np.int32)
        number = np.zeros(base + 1, np.int32)
        number[order] = np.arange(base, dtype=np.int32)
        by_length = self._arcs(codes, left)
        arcs_of = np.zeros(base, np.int32)
        for at, _, _ in by_length:
            arcs_of[at] += 1
        per = arcs_of[order]
        arc_at = np.concatenate(([0], np.cumsum(per)))
        slot = arc_at[number[:base]]
        piece, target = np.empty(arc_at[-1], np.int32), np.empty(arc_at[-1], np.int32)
        # longest pieces first; -1 is a word's end
        for k, (at, found, last) in reversed(list(enumerate(by_length, 1))):
            here = slot[at]
            piece[here] = found
            after = number[at + k]
            after[last] = -1
            target[here] = after
            slot[at] = here + 1
        w = self.weight[piece]
        bytewise = np.flatnonzero(piece < 0)
        if len(bytewise):
            w[bytewise] = np.array([self.rare * len(x) for x in self.spelled])[-piece[bytewise] - 1]
        beta = np.zeros(base + 1)  # the last one is the end
        levels = np.concatenate(([0], np.cumsum(np.bincount(left, minlength=longest + 1)[1:])))
        for lo, hi in zip(levels[:-1].tolist(), levels[1:].tolist()):
            a, b = arc_at[lo], arc_at[hi]
            x = w[a:b] + beta[target[a:b]]
            cuts = arc_at[lo:hi] - a
            top = np.maximum.reduceat(x, cuts)
            beta[lo:hi] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, per[lo:hi])), cuts))
        logp = w + beta[target] - np.repeat(beta[:-1], per)
        p = np.exp(logp)
        # what the other arcs of the position have together, exact also where one has nearly all
        small = np.add.reduceat(np.where(p > 0.5, 0.0, p), arc_at[:-1])
        with np.errstate(divide="ignore"):
            rest = np.log(np.where(p > 0.5, np.repeat(small, per), 1.0 - p))
        ends = arc_at[1:] - 1
        many = np.flatnonzero(per > 1)
        k = 1
        while len(many):
            at = arc_at[many] + k
            p[at] += p[at - 1]
            k += 1
            many = many[per[many] > k]
        p[ends] = 2.0  # cumulated; a draw never goes past the last one
        at = self.nodes
        self._append("first", at, arc_at + self.arcs)
        for name, x in (("cum", p), ("logp", np.minimum(logp, 0.0)), ("rest", rest), ("piece", piece), ("to", np.where(target >= 0, target + at, -1))):
            self._append(name, self.arcs, x)
        self.arcs += len(p)
        self.nodes += base
        self.start.update(zip(fresh, (number[np.cumsum(sizes) - sizes] + at).tolist()))

    def draw(self, starts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path from every start to its word's end: arcs in order, and how many each start has."""
        active, at, steps = np.arange(len(starts)), starts, []
        counts = np.zeros(len(starts), np.int64)
        while len(active):
            arc, u = self.first[at], _uniform(seeds, len(steps) + 1)
            late = np.flatnonzero(u >= self.cum[arc])
            while len(late):
                arc[late] += 1
                late = late[u[late] >= self.cum[arc[late]]]
            steps.append((active, arc))
            counts[active] += 1
            at = self.to[arc]
            go = at >= 0
            if not go.all():
                active, at, seeds = active[go], at[go], seeds[go]
        out = np.empty(int(counts.sum()), np.int32)
        first = np.cumsum(counts) - counts
        for k, (who, arc) in enumerate(steps):
            out[first[who] + k] = arc
        return out, counts

    def ids(self, arcs: np.ndarray, ends: np.ndarray | None = None):
        """Piece ids of arcs; with ``ends``, where paths end among the arcs, also where they end among the ids."""
        piece = self.piece[arcs]
        bytewise = np.flatnonzero(piece < 0)
        if len(bytewise):
            spelled = -piece[bytewise] - 1
            size_of = np.array([len(x) for x in self.spelled])
            sizes = np.ones(len(piece), np.int64)
            sizes[bytewise] = size_of[spelled]
            if ends is not None:
                ends = np.concatenate(([0], np.cumsum(sizes)))[ends]
            flat = np.array([i for x in self.spelled for i in x], np.int32)
            own, of = size_of[spelled], (np.cumsum(size_of) - size_of)[spelled]
            out = np.repeat(piece, sizes)
            out[out < 0] = flat[np.repeat(of - np.cumsum(own) + own, own) + np.arange(int(own.sum()))]
            piece = out
        piece = piece.astype(np.uint32)
        return piece if ends is None else (piece, ends)

    def top(self, texts: list[list[str]], seeds: np.ndarray, k: int) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
        """Per text at most ``k`` different segmentations ``(arcs, log probability, perturbed)``, best first, and the next bound.

        Texts are drawn together; the random numbers of each come from its own seed.
        """
        trees = [_Tree(self, s, int(seed)) for s, seed in zip(self.starts(texts), seeds)]
        wanted = [(t, None, 0, -1, t.starts, 0) for t in trees]
        for left in range(k - 1, -1, -1):
            self._grow(wanted)
            wanted = [w for w in (t.next(bound_only=not left) for t in trees) if w]
        # what was taken beyond k only told the next bound
        return [(t.found[:k], t.bound) for t in trees]

    def _grow(self, wanted: list[tuple]) -> None:
        """Draw the rest of every path asked for, and bound the siblings along it."""
        if not wanted:
            return
        sizes = np.array([len(w[4]) for w in wanted])
        salt = np.array([w[0].salt() for w in wanted], np.uint64)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = _mix64(np.repeat(salt, sizes) + place.astype(np.uint64) * _GOLD)
        arcs, counts = self.draw(np.concatenate([w[4] for w in wanted]), own)
        ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(sizes)))]
        logp = self.logp[arcs].astype(np.float64)
        lengths = np.diff(ends)
        # summed text by text, so that what a text shares its slice with does not show in the last digits
        before = -logp
        for w, lo, hi in zip(wanted, ends[:-1], ends[1:]):
            before[lo:hi] += np.cumsum(logp[lo:hi]) + w[0].log_before(w)
        loc = before + self.rest[arcs]
        with np.errstate(divide="ignore"):
            e = -np.log(1.0 - _uniform(np.repeat(_mix64(salt + np.uint64(1)), lengths) + np.arange(len(logp), dtype=np.uint64) * _GOLD
                                       - np.repeat(ends[:-1].astype(np.uint64) * _GOLD, lengths), 1).astype(np.float64))
        group = _truncated(loc, np.repeat(np.array([w[0].bound for w in wanted]), lengths), e)
        words = np.repeat(place, counts)
        for w, lo, hi in zip(wanted, ends[:-1], ends[1:]):
            w[0].take(w, arcs[lo:hi], words[lo:hi], logp[lo:hi], before[lo:hi], group[lo:hi])


_GOLD, _ALL = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1), a function of seed and step only."""
    return (_mix64(seeds + np.uint64(step * 0x9E3779B97F4A7C15 & _ALL)) >> np.uint64(11)) * 2.0 ** -53


class _Tree:
    """The search tree of one text: its leaves so far, and the siblings left behind at their decisions."""

    def __init__(self, of: Lattices, starts: np.ndarray, seed: int):
        self.of, self.starts, self.seed, self.drawn = of, starts, seed, 0
        self.bound = float(-np.log(-np.log(max(self._one(), 1e-300))))
        self.paths: list[dict] = []
        self.found: list[tuple[np.ndarray, float, float]] = []

    def salt(self) -> int:
        """The next number of this text's own sequence."""
        self.drawn += 1
        x = self.seed + self.drawn * 0x632BE59BD9B4E019 & _ALL
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
        return x ^ x >> 31

    def _one(self) -> float:
        return (self.salt() >> 11) * 2.0 ** -53

    def log_before(self, wanted: tuple) -> float:
        _, path, d, arc, _, _ = wanted
        return 0.0 if path is None else float(path["before"][d] + self.of.logp[arc])

    def take(self, wanted: tuple, arcs, words, logp, before, group) -> None:
        """A new leaf: the prefix of the path it leaves, the arc taken instead, and what was drawn."""
        _, path, d, arc, _, word = wanted
        if path is None:
            own = {"arcs": arcs, "word": words, "before": before, "group": group}
        else:
            at = path["before"][d]
            own = {"arcs": np.concatenate((path["arcs"][:d], np.array([arc], np.int32), arcs)),
                   "word": np.concatenate((path["word"][:d], [path["word"][d]], words + word)),
                   "before": np.concatenate((path["before"][:d], [at], before)),
                   "group": np.concatenate((np.full(d + 1, -np.inf), group))}
        own["taken"] = {}
        last = len(own["arcs"])
        total = float(own["before"][-1] + self.of.logp[own["arcs"][-1]]) if last else 0.0
        self._look(own)
        self.paths.append(own)
        self.found.append((own["arcs"], total, self.bound))

    @staticmethod
    def _look(path: dict) -> None:
        path["where"] = int(path["group"].argmax()) if len(path["group"]) else 0
        path["best"] = float(path["group"][path["where"]]) if len(path["group"]) else -np.inf

    def next(self, bound_only: bool = False) -> tuple | None:
        """Leave the best path for the siblings with the largest bound; None if no segmentation is left, or only the bound is wanted."""
        if not self.paths or self.bound == -np.inf:
            return None
        path = max(self.paths, key=lambda p: p["best"])
        self.bound = path["best"]
        if bound_only or self.bound == -np.inf:
            return None
        of, d = self.of, path["where"]
        mine = int(path["arcs"][d])
        node = int(np.searchsorted(of.first[:of.nodes], np.int32(mine), side="right")) - 1
        lo, hi = int(of.first[node]), int(of.first[node + 1])
        p = np.exp(of.logp[lo:hi].astype(np.float64))
        gone = path["taken"].setdefault(d, [mine])
        p[np.array(gone) - lo] = 0
        run = np.cumsum(p)
        pick = lo + int(min(np.searchsorted(run, self._one() * run[-1], side="right"), np.flatnonzero(p)[-1]))
        gone.append(pick)
        p[pick - lo] = 0
        left = p.sum()
        loc = np.array([path["before"][d] + np.log(left) if left > 0 else -np.inf])
        path["group"][d] = _truncated(loc, self.bound, -np.log(max(self._one(), 1e-300)))[0]
        self._look(path)
        word, after = int(path["word"][d]), int(of.to[pick])
        rest = self.starts[word + 1:] if after < 0 else np.concatenate((np.array([after], np.int32), self.starts[word + 1:]))
        return self, path, d, pick, rest, word + (after < 0)


def _truncated(loc: np.ndarray, bound: float, e: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``loc`` under the condition that none is above ``bound``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = loc - np.log(np.exp(loc - bound) + e)
    return np.where(np.isneginf(loc), -np.inf, np.minimum(out, bound))


def _log_inclusion(logp: float, kappa: float) -> float:
    """Log of the probability that a segmentation is among the k, given the bound of the next one."""
    if kappa == -np.inf:
        return 0.0
    x = logp - kappa
    return float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x


_workers: dict[tuple, Lattices] = {}


def _lattices(path: str, sharpness: float) -> Lattices:
    if (path, sharpness) not in _workers:
        _workers[path, sharpness] = Lattices(path, sharpness)
    return _workers[path, sharpness]


def sample_segmentations(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", samples: int = SAMPLES,
                         seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """``(key, sample, ids, log_prob, perturbed, log_inclusion, restored)``, up to ``samples`` rows per row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit piece ids, ``restored`` says that
    the decoder gives the text back.  Rows of one sampling are different
    segmentations, from the largest perturbed weight down; a text with fewer
    segmentations has fewer rows, null and empty texts have one without ids.
    Equal keys with equal texts get equal samples; a null key is a key.
    Columns other than ``key`` and ``text`` are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _lattices(path, sharpness)
        try:
            for batch in batches:
                texts = [t.as_py() or "" for t in batch.column(1)]
                for lo, hi in _slices(texts):
                    yield _sampled(of, batch.column(0).slice(lo, hi - lo), texts[lo:hi], samples, seed)
        finally:
            of.clear()  # the worker may serve other operators next

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, sample int, ids binary, log_prob double, perturbed double, log_inclusion double, restored boolean")


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _sampled(of: Lattices, keys: pa.Array, texts: list[str], samples: int, seed: int) -> pa.RecordBatch:
    if of.nodes > KEPT:
        of.forget()
    cut = [of.words(t) for t in texts]
    seeds = np.array([zlib.crc32(f"{seed}:{k}".encode()) | zlib.crc32(f"{k}:{seed}".encode()) << 32 for k in keys.to_pylist()], np.uint64)
    row, rank, paths, logp, perturbed, inclusion = [], [], [], [], [], []
    for i, (found, kappa) in enumerate(of.top(cut, seeds, samples)):
        for r, (arcs, lp, g) in enumerate(found):
            row.append(i)
            rank.append(r)
            paths.append(arcs)
            logp.append(lp)
            perturbed.append(g)
            inclusion.append(_log_inclusion(lp, kappa))
    ids, ends = of.ids(np.concatenate(paths or [np.zeros(0, np.int32)]), np.cumsum([0] + [len(x) for x in paths]))
    listed = ids.tolist()
    restored = [of.restored(listed[a:b], texts[i]) for i, a, b in zip(row, ends[:-1], ends[1:])]
    data = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(row, pa.int64())), pa.array(rank, pa.int32()), data,
         pa.array(logp, pa.float64()), pa.array(perturbed, pa.float64()), pa.array(inclusion, pa.float64()), pa.array(restored, pa.bool_())],
        names=["key", "sample", "ids", "log_prob", "perturbed", "log_inclusion", "restored"])


def decode(ids: Column, path: str) -> Column:
    """The text of little-endian unsigned 32-bit piece ids; null stays null."""
    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = _lattices(path, SHARPNESS).sp
        for part in parts:
            yield pd.Series([None if x is None else sp.decode(np.frombuffer(x, "<u4").tolist()) for x in part], dtype=object)

    return text(ids)

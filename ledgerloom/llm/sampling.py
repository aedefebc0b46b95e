"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding (operator 9).

A text's lattice has an edge for every vocabulary piece that occurs in it, weighted by
``TEMPERATURE`` times the piece's score; a segmentation is a path, its probability the softmax over all
paths.  ``samples`` different segmentations are drawn by a perturbed A-star search: every open node of the
search is a set of paths (a prefix, less the continuations already taken) with the sampled maximum of the
Gumbel-perturbed log-probabilities of its paths as its priority, and the exact log-mass of the lattice
behind it as heuristic.  The best node is followed down to one path; what it leaves behind on the way
becomes open nodes, whose maxima are Gumbels cut off at the parent's.  So paths come out in the order of
their perturbed log-probability, all different.  With kappa the best priority left open, the inclusion
score of a path is ``1 - exp(-exp(log p - kappa))``, the chance to be above kappa.

Random numbers are seeded by the row's key, so that a repeated task draws the same samples.

Defined results: a null or empty text has one segmentation, without pieces; a text with fewer
segmentations than asked for gives all of them, with inclusion 1; characters outside the vocabulary are
bytes; a stretch without a space is one lattice, however long; rows with equal keys draw equal numbers; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import mix, ragged, slices

MODEL = "piece_bpe_32k.model"
SAMPLES = 4
TEMPERATURE = 1 / 2000
SEED = 9
#: Edges remembered, and bytes of text searched at once; neither changes a result.
_REMEMBERED, _SLICE = 2_500_000, 1 << 17
_UNUSED = -1e8
#: Log-probabilities are added as whole numbers of this part, so that sums do not depend on the texts beside them.
_FIXED = float(1 << 36)
_STRETCH = re.compile("▁*[^▁]+|▁+")
_GOLDEN, _ROOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)


class Trie:
    """The vocabulary's pieces by code points; a step is one look into a hashed table of (state, code point)."""

    def __init__(self, pieces: dict[str, int]):
        steps: dict[int, int] = {}
        ends = [-1]
        for piece, i in pieces.items():
            state = 0
            for symbol in map(ord, piece):
                state = steps.setdefault(state << 21 | symbol, len(ends))
                if state == len(ends):
                    ends.append(-1)
            ends[state] = i
        self.piece = np.array(ends, np.int32)
        keys = np.fromiter(steps.keys(), np.int64, len(steps))
        states = np.fromiter(steps.values(), np.int32, len(steps))
        bits = max(4, (3 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._key, self._state = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self._key[slot[left]] < 0)
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free[first]]
            self._key[slot[put]], self._state[slot[put]] = keys[put], states[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self._mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _GOLDEN) >> self._shift).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after one more code point (-1: no piece goes on so)."""
        key = state.astype(np.int64) << 21 | symbol
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int32)
        look = np.arange(len(key))
        while len(look):
            there = self._key[slot]
            hit = there == key
            out[look[hit]] = self._state[slot[hit]]
            on = ~hit & (there >= 0)
            look, key, slot = look[on], key[on], (slot[on] + 1) & self._mask
        return out


class Lattices:
    """Lattices of the stretches between spaces, each built once while it is remembered; those met again are remembered longer.

    All lattices lie one after the other in flat arrays: node n has the edges ``first[n]`` to ``first[n + 1]``, the
    longest piece first; an edge has the probability of going on that way (summed up, as a fixed-point logarithm, and
    that of its sisters), its end node (-1: end of the stretch) and its piece.
    """

    def __init__(self, path: str, temperature: float):
        self.model = _model(path)
        single, scores = {}, []
        self.pieces: dict[str, int] = {}
        for i in range(self.model.get_piece_size()):
            scores.append(temperature * self.model.get_score(i))
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                piece = self.model.id_to_piece(i)
                if self.model.get_score(i) > _UNUSED:
                    self.pieces[piece] = i
                elif len(piece) == 1:
                    single[piece] = i
        self.least = min(scores[i] for i in self.pieces.values())
        self.longest = max(map(len, self.pieces))
        # A character that the vocabulary holds without a usable score is as likely as the rarest piece.
        for piece, i in single.items():
            self.pieces[piece], scores[i] = i, self.least
        self.trie = Trie(self.pieces)
        # Ids and weight of every piece; further characters are added as bytes when they occur.
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.piece_ids, self.piece_weight = [(i,) for i in range(len(scores))], scores
        self.others: dict[int, int] = {}
        self._sizes, self._flat = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._weight = np.zeros(0)
        self._said = self._spoken()
        self._forget()

    def _as_bytes(self, symbol: int) -> int:
        piece = self.others.get(symbol)
        if piece is None:
            piece = self.others[symbol] = len(self.piece_ids)
            self.piece_ids.append(tuple(self.bytes[b] for b in chr(symbol).encode()))
            self.piece_weight.append(2 * self.least)
        return piece

    def _spoken(self) -> pa.Array | None:
        """What each piece stands for in a decoded text, then the same for a text's first piece.

        None if the model decodes by other rules.
        """
        unlike = {b: bytes([v]) for v, b in enumerate(self.bytes)}
        raw = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inside = [unlike.get(i, b"" if self.model.is_control(i) else x.replace("▁", " ").encode()) for i, x in enumerate(raw)]
        first = [x[1:] if r.startswith("▁") else x for x, r in zip(inside, raw)]
        said = pa.array(inside + first, pa.large_binary())
        probes = [self.model.encode(x) for x in ("", "a", "  two  spaces ", "naïve 龘\n\ttab \x00", "x 😀▁▁ é")]
        probes += [self.bytes[0x41:0x44], probes[2][1:], [i for i, x in enumerate(raw) if "▁" in x[1:]][:50]]
        offsets = np.cumsum([0] + [len(x) for x in probes])
        plain = _joined(said, np.fromiter(chain.from_iterable(probes), np.int32, int(offsets[-1])), offsets)
        return said if plain.to_pylist() == [self.model.decode(x) for x in probes] else None

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each list of ids, as the model decodes it; the bytes in ``ids`` make whole characters."""
        if self._said is None:
            return pa.array([self.model.decode(ids[a:b].tolist()) for a, b in pairwise(offsets.tolist())], pa.string())
        return _joined(self._said, ids, offsets)

    def _fade(self) -> None:
        """Forget the stretches not met again since the last time, and more if the others are many."""
        runs, begin = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        length, uses, least = np.fromiter(map(len, runs), np.int64, len(runs)), self._uses[begin], 2
        cost = self.first[begin + length] - self.first[begin]
        while cost[uses >= least].sum() > _REMEMBERED // 2:
            least *= 2
        held = np.flatnonzero(uses >= least)
        node = ragged(begin[held], length[held])
        degree = self.first[node + 1] - self.first[node]
        edge = ragged(self.first[node], degree)
        moved = np.full(len(self.first), -1, np.int32)
        moved[node] = np.arange(len(node))
        # Place -1 of ``moved`` is no node: the end of a stretch stays one.
        end = moved[self.end[edge]]
        kept = {name: getattr(self, name)[edge] for name in ("reached", "rest", "step", "piece")}
        self._forget()
        start = np.cumsum(length[held]) - length[held]
        self.known = dict(zip([runs[i] for i in held.tolist()], start.tolist()))
        self.nodes, self.edges, self.end = len(node), len(edge), end
        self.first = np.concatenate((self.first, np.cumsum(degree)))
        for name, values in kept.items():
            setattr(self, name, values)
        self._uses = np.zeros(len(node), np.int64)
        self._uses[start] = 1

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self._uses = np.zeros(0, np.int64)
        self.nodes = self.edges = 0
        self._new: list[str] = []
        self._pending = 0
        self.first = np.zeros(1, np.int64)
        self.reached, self.rest = np.zeros(0), np.zeros(0)
        self.step, self.end, self.piece = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _edges(self, symbol: np.ndarray, stop: np.ndarray):
        """Every piece that starts at a code point and ends before its stretch does: (degree, length, piece), longest first."""
        degree, found = np.zeros(len(symbol), np.int64), []
        at, state, depth = np.arange(len(symbol)), np.zeros(len(symbol), np.int32), 0
        while len(at):
            state = self.trie.step(state, symbol[at + depth])
            on = state >= 0
            piece = np.where(on, self.trie.piece[state], -1)
            if not depth:
                lacking = np.flatnonzero(piece < 0)
                distinct, which = np.unique(symbol[lacking], return_inverse=True)
                piece[lacking] = np.array([self._as_bytes(int(c)) for c in distinct], np.int32)[which]
            depth += 1
            hit = piece >= 0
            found.append((at[hit], piece[hit], depth))
            degree[at[hit]] += 1
            on &= at + depth < stop[at]
            at, state = at[on], state[on]
        slot = np.cumsum(degree) - degree
        length, pieces = np.empty(int(degree.sum()), np.int32), np.empty(int(degree.sum()), np.int32)
        for where, piece, depth in reversed(found):
            length[slot[where]], pieces[slot[where]] = depth, piece
            slot[where] += 1
        return degree, length, pieces

    def _settle(self) -> None:
        """Work out the lattices of the stretches met since the last call, and put them behind the others."""
        if not self._new:
            return
        old, lengths = len(self.first) - 1, np.array([len(x) for x in self._new])
        symbol = np.frombuffer("".join(self._new).encode("utf-32-le"), np.uint32).astype(np.int64)
        stop = np.repeat(np.cumsum(lengths), lengths)
        degree, length, piece = self._edges(symbol, stop)
        if len(self._weight) < len(self.piece_weight):
            self._weight = np.array(self.piece_weight)
        weight = self._weight[piece]
        begin = np.cumsum(degree) - degree
        node = np.repeat(np.arange(len(degree)), degree)
        after = node + length
        final = after == stop[node]
        # The mass behind a node needs that of later nodes only: all nodes with the same way to go at once.
        to_go = stop - np.arange(len(degree))
        behind = np.zeros(len(degree) + 1)
        after[final] = len(degree)
        order = np.argsort(to_go, kind="stable")
        for same in np.split(order, np.searchsorted(to_go[order], np.arange(2, lengths.max() + 1))):
            edges = ragged(begin[same], degree[same])
            heads = np.cumsum(degree[same]) - degree[same]
            mass = weight[edges] + behind[after[edges]]
            top = np.maximum.reduceat(mass, heads)
            behind[same] = top + np.log(np.add.reduceat(np.exp(mass - np.repeat(top, degree[same])), heads))
        step = weight + behind[after] - np.repeat(behind[:-1], degree)
        share = np.exp(step)
        # What the other edges of the node have; at most one edge has more than half, and there the others are added up.
        small = np.where(share > 0.5, 0.0, share)
        rest = np.where(share > 0.5, np.repeat(np.add.reduceat(small, begin), degree), np.maximum(np.repeat(np.add.reduceat(share, begin), degree) - share, 0.0))
        rest[begin[degree == 1]] = 0.0
        up = np.cumsum(share)
        up -= np.repeat(np.concatenate(([0.0], up))[begin], degree)
        up[begin + degree - 1] = 1.0
        used, self.edges = self.edges, self.edges + len(piece)
        end = np.where(final, -1, after + old)
        for name, values in (("reached", up), ("rest", rest), ("step", np.rint(step * _FIXED)), ("end", end), ("piece", piece)):
            held = getattr(self, name)
            if self.edges > len(held):
                longer = np.empty(max(2 * len(held), self.edges), held.dtype)
                longer[:used] = held[:used]
                held = longer
                setattr(self, name, held)
            held[used : self.edges] = values
        self.first = np.concatenate((self.first, self.first[-1] + begin + degree))
        self._new, self._pending = [], 0

    def stretches(self, text: str) -> list[int]:
        """First nodes of a text's stretches, each of which starts with its spaces."""
        known = self.known
        runs = _STRETCH.findall(self.model.normalize(text)) if text else []
        out = list(map(known.get, runs))
        for i in [i for i, node in enumerate(out) if node is None] if None in out else ():
            run = runs[i]
            node = known.get(run)
            if node is None:
                node = known[run] = self.nodes
                self._new.append(run)
                self.nodes += len(run)
                self._pending += len(run)
                if self._pending > _SLICE:
                    self._settle()
            out[i] = node
        return out

    def _walk(self, start: np.ndarray, seed: np.ndarray, fixed: np.ndarray, edge: np.ndarray):
        """Follow every start node to the end of its stretch; at the walkers ``fixed`` the first edge is given.

        Returns walker, node, edge and the uniform number for what the edge leaves behind, in the order of the walkers.
        """
        active, node, t = np.arange(len(start), dtype=np.int32), start, 0
        walkers, nodes, edges, numbers = [], [], [], []
        while len(active):
            own = seed[active]
            drawn = _uniform(own, 2 * t)
            e = self.first[node]
            look = np.flatnonzero(self.reached[e] <= drawn)
            while len(look):
                e[look] += 1
                look = look[self.reached[e[look]] <= drawn[look]]
            if not t:
                e[fixed] = edge
            walkers.append(active)
            nodes.append(node)
            edges.append(e)
            numbers.append(_uniform(own, 2 * t + 1))
            on = self.end[e]
            going = np.flatnonzero(on >= 0)
            active, node, t = active[going], on[going].astype(np.int64), t + 1
        size = np.bincount(np.concatenate(walkers), minlength=len(start))
        out = [np.empty(int(size.sum()), kind) for kind in (np.int64, np.int64, np.float64)]
        # A walker's steps lie one after the other.
        place = np.cumsum(size) - size
        for t, walker in enumerate(walkers):
            at = place[walker] + t
            for whole, part in zip(out, (nodes, edges, numbers)):
                whole[at] = part[t]
        return np.repeat(np.arange(len(start)), size), *out

    def _reopen(self, node: np.ndarray, shut: np.ndarray, drawn: np.ndarray):
        """An edge of each node that is not shut, the share of the others that are free, and the bits then shut."""
        degree = self.first[node + 1] - self.first[node]
        slot = np.arange(degree.max(initial=1))
        free = (slot < degree[:, None]) & ((shut[:, None] >> slot.astype(np.uint64)) & np.uint64(1) == 0)
        share = np.where(free, np.exp(self.step[np.minimum(self.first[node][:, None] + slot, self.edges - 1)] / _FIXED), 0.0)
        reached = np.cumsum(share, axis=1)
        passed = (reached <= (drawn * reached[:, -1])[:, None]) | ~free
        chosen = np.where(passed.all(axis=1), degree.max(initial=1) - 1 - free[:, ::-1].argmax(axis=1), (~passed).argmax(axis=1))
        share[np.arange(len(node)), chosen] = 0.0
        return self.first[node] + chosen, share.sum(axis=1), shut | (np.uint64(1) << chosen.astype(np.uint64))

    def sample_all(self, texts: list[str], keys: np.ndarray, k: int):
        """Up to k segmentations of each text: (row, list offsets, piece ids, log-probability, perturbed, inclusion).

        All texts go through the search together, one path a round; a row's numbers come from its key alone.
        """
        if self.edges > _REMEMBERED:
            self._fade()
        lists = [self.stretches(t) for t in texts]
        self._settle()
        count = np.array([len(x) for x in lists], np.int64)
        begin = np.cumsum(count) - count
        starts = np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum()))
        met, times = np.unique(starts, return_counts=True)
        self._uses = np.concatenate((self._uses, np.zeros(self.nodes - len(self._uses), np.int64)))
        self._uses[met] += times
        root = -np.log(-np.log(_uniform(mix(keys ^ _ROOT), 0)))
        blank = np.flatnonzero(count == 0)
        found = [(blank, np.zeros(len(blank), np.int64), np.zeros(len(blank), np.int64), np.zeros(len(blank)), root[blank])]
        rows = np.flatnonzero(count)
        zero = np.zeros(len(rows), np.int64)
        # Open nodes: row, priority, stretch, node, fixed-point log-probability so far, shut edges, path so far in ``pool``.
        now = (rows, root[rows], zero, starts[begin[rows]], zero, zero.astype(np.uint64), zero, zero)
        kept = tuple(c[:0] for c in now)
        pool = np.zeros(0, np.int32)
        for turn in range(k):
            row, best, s, node, so_far, shut, origin, taken = now
            if not len(row):
                break
            width = count[row] - s
            head = np.cumsum(width) - width
            owner = np.repeat(np.arange(len(row)), width)
            place = ragged(s, width)
            start = starts[begin[row][owner] + place]
            start[head] = node
            with np.errstate(over="ignore"):
                seed = mix(keys[row][owner] + (place.astype(np.uint64) + np.uint64(turn << 40)) * _GOLDEN)
            again = np.flatnonzero(shut)
            edge, left, closed = self._reopen(node[again], shut[again], _uniform(seed[head[again]], 0))
            walker, nodes, e, number = self._walk(start, seed, head[again], edge)
            item_row = owner[walker]
            size = np.bincount(item_row, minlength=len(row))
            top = np.cumsum(size) - size
            step = self.step[e]
            up = np.cumsum(step)
            before = so_far[item_row] + (up - step) - (up - step)[top][item_row]
            rest = self.rest[e]
            rest[top[again]] = left
            # The whole path, for the result and for the nodes that branch off from it.
            length = taken + size
            at = np.cumsum(length) - length
            path = np.empty(int(length.sum()), np.int32)
            path[ragged(at, taken)] = pool[ragged(origin, taken)]
            path[ragged(at + taken, size)] = e
            at += len(pool)
            pool = np.concatenate((pool, path))
            total = so_far + np.add.reduceat(step, top)
            found.append((row, at, length, total / _FIXED, best))
            # What a step leaves behind: a Gumbel at its log-mass, cut off at the node's own maximum.  The cut keeps
            # their order, and only as many as paths are missing can ever matter.
            items = np.flatnonzero(rest > 0)
            gumbel = before[items] / _FIXED + np.log(rest[items] / -np.log(number[items]))
            first = _greatest(gumbel, item_row[items], k - turn)
            items, gumbel = items[first], gumbel[first]
            r = item_row[items]
            low = np.minimum(gumbel, best[r])
            cut = low - np.log(np.exp(low - best[r]) + np.exp(low - gumbel))
            bits = np.uint64(1) << (e[items] - self.first[nodes[items]]).astype(np.uint64)
            came = np.full(len(row), -1)
            came[again] = np.arange(len(again))
            same = np.flatnonzero((items == top[r]) & (came[r] >= 0))
            bits[same] = closed[came[r[same]]]
            inside = items - top[r]
            fresh = (row[r], cut, place[walker[items]], nodes[items], before[items], bits, at[r], taken[r] + inside)
            merged = [np.concatenate(pair) for pair in zip(kept, fresh)]
            order = np.lexsort((-merged[1], merged[0]))
            heads = merged[0][order]
            rank = np.arange(len(order)) - np.searchsorted(heads, heads)
            # Only as many nodes as paths are missing, and the one after them, can ever matter.
            order, rank = order[rank < k - turn], rank[rank < k - turn]
            now = tuple(c[order[rank == 0]] for c in merged)
            kept = tuple(c[order[rank > 0]] for c in merged)
        kappa = np.full(len(texts), -inf)
        kappa[now[0]] = now[1]
        row, at, length, log_p, perturbed = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(row, kind="stable")
        row, at, length, log_p, perturbed = (c[order] for c in (row, at, length, log_p, perturbed))
        pieces = self.piece[pool[ragged(at, length)]]
        size, spelled = self._spelled()
        many = size[pieces]
        ids = spelled[ragged((np.cumsum(size) - size)[pieces], many)]
        offsets = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], np.cumsum(length)))]
        return row, offsets, ids, log_p, perturbed, -np.expm1(-np.exp(np.minimum(700.0, log_p - kappa[row])))

    def _spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all these ids."""
        if len(self._sizes) < len(self.piece_ids):
            self._sizes = np.array([len(x) for x in self.piece_ids])
            self._flat = np.fromiter(chain.from_iterable(self.piece_ids), np.int32)
        return self._sizes, self._flat

    def sample(self, text: str, k: int, rng: np.random.Generator) -> list[tuple[list[int], float, float, float]]:
        """(piece ids, log-probability, perturbed log-probability, inclusion score) of up to k segmentations of one text."""
        _, offsets, ids, *scores = self.sample_all([text], rng.integers(0, 1 << 64, 1, np.uint64), k)
        return [(ids[a:b].tolist(), *map(float, s)) for a, b, *s in zip(offsets, offsets[1:], *scores)]


def _joined(said: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The strings of each list of ids in ``said``, joined; its second half holds those for the first id of a list."""
    own = ids.astype(np.int32)
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    own[heads] += len(said) // 2
    _, at, data = said.take(pa.array(own)).buffers()
    at = np.frombuffer(at, np.int64)[: len(own) + 1][offsets] if len(own) else np.zeros(len(offsets), np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(at.tobytes()), data]).cast(pa.large_string()).cast(pa.string())


def _uniform(seed: np.ndarray, turn: int) -> np.ndarray:
    """A number above 0 and under 1 for each seed."""
    x = mix(seed + np.uint64((turn + 1) * int(_GOLDEN) & (1 << 64) - 1))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _greatest(value: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values of each row (all, if fewer), in order; rows lie together, ascending."""
    if not len(row):
        return np.zeros(0, np.int64)
    left, out = value.copy(), []
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(heads, len(row)))
    for _ in range(k):
        at = np.flatnonzero((left == np.repeat(np.maximum.reduceat(left, heads), size)) & (left > -inf))
        if not len(at):
            break
        # Of equal ones the first.
        at = at[np.append(True, row[at][1:] != row[at][:-1])]
        out.append(at)
        left[at] = -inf
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def _model(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _lattices(path: str, temperature: float) -> Lattices:
    return Lattices(path, temperature)


def _path(path: str | None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


def encode(
    table: DataFrame, key: list[str], samples: int = SAMPLES, temperature: float = TEMPERATURE, seed: int = SEED, model: str | None = None, decoded: bool = False
) -> DataFrame:
    """The key columns, rank (from 0), ids, log_prob, perturbed and inclusion of every sampled segmentation of ``text``.

    With ``decoded`` also the text that the ids give back (``decoded``), made by the same Python workers.
    """
    fields = [f"`{c}` {t}" for c, t in table.select(*key).dtypes]
    drawn_fields = ["rank int", "ids array<int>", "log_prob double", "perturbed double", "inclusion double"] + ["decoded string"] * decoded
    names = [*key, *(f.split()[0] for f in drawn_fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices(_path(model), temperature)
        salt = np.uint64(seed * int(_GOLDEN) & (1 << 64) - 1)
        for batch in batches:
            for lo, hi, _, _ in slices(batch.column(0), _SLICE):
                part = batch.slice(lo, hi - lo)
                keys = mix(part.column(1).to_numpy().view(np.uint64) ^ salt)
                row, offsets, ids, *scores = lattices.sample_all([t or "" for t in part.column(0).to_pylist()], keys, samples)
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                drawn = [pa.array(rank, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                columns = [part.column(2 + c).take(pa.array(row)) for c in range(len(key))] + drawn + [pa.array(x) for x in scores]
                if decoded:
                    columns.append(lattices.decode_all(ids, offsets))
                yield pa.RecordBatch.from_arrays(columns, names)

    chosen = table.select(F.col("text").cast("string").alias("_text"), F.xxhash64(*key).alias("_own"), *key)
    return chosen.mapInArrow(run, ", ".join(fields + drawn_fields))


def decode(ids: Column, model: str | None = None) -> Column:
    """Text of an array of piece ids (null for null)."""
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        own = _model(_path(model))
        return pd.Series([None if x is None else own.decode(x.tolist()) for x in column], dtype=object)

    return run(ids)

"""Sampled SentencePiece segmentations without replacement, and their decoding.

A text becomes a lattice: its characters, spaces as U+2581 with one more in front, and an edge for each
piece of the vocabulary that fits; a character without a piece has one edge of its UTF-8 byte pieces.
Pieces hold U+2581 only at their beginning, so the lattice falls apart into units (spaces with the
characters behind them; line breaks), which no piece crosses and which may be of any length. The
probability of a segmentation is the product of its pieces' weights over the sum for all segmentations.

The k segmentations with the largest Gumbel-perturbed log-probabilities are k draws without
replacement. They are found best first: the maximum over all segmentations is drawn for the root, and
whatever a set of segmentations has as its maximum belongs to one segmentation, drawn by the weights.
Taking that one out splits the set by the first unit in which the others differ; the maxima of these
parts are Gumbel variables cut off at the maximum of the set. A queue holds one bound per part, so the
largest bound is always the next segmentation, and the bound left on top at the end is the threshold
of the inclusion probabilities. Random numbers are functions of (seed, row key, unit, step): results do
not depend on how rows are batched.

A row gives k rows, or as many as it has segmentations. An empty or null text has the one empty
segmentation. Rows that repeat a key and text get equal samples; a null key counts as its own key.
Weights follow the rank of a piece in the vocabulary (no training): log p = -log(rank + 2.7), times
``sharpness``. Decoding gives the text back exactly, a literal U+2581 included.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.llm.common import small_batches, table
from loanframe.llm.wordhash import mix, pieces as slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SHARPNESS = 1.0
#: Characters of a unit over which products of weights stay within a double; behind them sums are of logs.
LINEAR = 48
#: Log-weight of a character spelled in bytes.
BYTES_WEIGHT = -12.0
#: Added per character to log-weights, so that products over LINEAR characters stay within a double.
LIFT = 4.0
BLANK = 0x2581
#: Stands for a literal U+2581 of the text, which has no piece.
LITERAL = 0x110000
_BASE = 0x9E3779B97F4A7C15
#: An odd number that spreads the values of prefixes over the upper bits.
SPREAD = np.uint64(0xD1342543DE82EF95)
TABLE_BITS = 20


def _power(n: int, base: int = _BASE) -> np.ndarray:
    from loanframe.llm.wordhash import _power as power

    return power(base, n)


@dataclass
class Vocabulary:
    """Prefixes of pieces by hash, the weight of every piece and its bytes; fixed in size."""

    prefixes: np.ndarray
    near: np.ndarray
    crowd: int
    piece_of: np.ndarray
    weights: np.ndarray
    longest: int
    byte_ids: np.ndarray
    blob: np.ndarray
    offsets: np.ndarray
    alone: np.ndarray

    @classmethod
    def load(cls, model: bytes, sharpness: float) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        if size > 1 << 16:
            raise ValueError(f"ids are kept as 16 bits, the vocabulary has {size} pieces")
        weights = np.full(size, -np.inf)
        byte_ids = np.zeros(256, np.int64)
        data, found, prefixes = [], {}, set()
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                data.append(bytes([int(piece[3:5], 16)]))
                continue
            data.append(piece.replace(chr(BLANK), " ").encode())
            bare = piece.lstrip(chr(BLANK))
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or chr(BLANK) in bare or "\n" in piece:
                continue
            weights[i] = -np.log(max(0.0, -sp.get_score(i)) + 2.7) * sharpness
            found[piece] = i
            prefixes.update(piece[:n] for n in range(1, len(piece) + 1))
        names = sorted(prefixes)
        hashes = np.array([_value_of(p) for p in names], np.uint64) * SPREAD
        order = np.argsort(hashes)
        ids = np.array([found.get(names[o], -1) for o in order], np.int64)
        lengths = np.array([len(d) for d in data])
        alone = np.zeros(LITERAL + 1, bool)
        alone[[ord(p) for p in found if len(p) == 1]] = True
        # Where the hashes with given upper bits begin; at most ``crowd`` share them.
        near = np.searchsorted(hashes[order], np.arange(1 << TABLE_BITS, dtype=np.uint64) << np.uint64(64 - TABLE_BITS))
        crowd = int(np.diff(np.append(near, len(order))).max())
        return cls(
            hashes[order], near.astype(np.int32), crowd, ids, weights, max(map(len, found)), byte_ids,
            np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum(lengths))),
            alone,
        )

    def has_piece(self, codes: np.ndarray) -> np.ndarray:
        """Whether a character alone is a piece."""
        return self.alone[np.minimum(codes, len(self.alone) - 1)]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the prefix, whether it is one) for each hash."""
        at = self.near[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        last = len(self.prefixes) - 1
        at = np.minimum(at, last)
        for _ in range(self.crowd):
            below = np.flatnonzero(self.prefixes[at] < hashes)
            if not len(below):
                break
            at[below] = np.minimum(at[below] + 1, last)
        return at, self.prefixes[at] == hashes

    def decode(self, ids: np.ndarray) -> str:
        """The text of one segmentation."""
        lo, n = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - n), n)
        return self.blob[at].tobytes().decode("utf-8", "surrogatepass")[1:]


def _value_of(piece: str) -> int:
    return sum((ord(c) + 1) * pow(_BASE, i, 1 << 64) for i, c in enumerate(piece)) % (1 << 64)


class _Lattice:
    """Edges and sampling tables for the distinct units of some texts."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, v: Vocabulary):
        n = len(codes)
        ends = np.append(starts[1:], n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power(n), out=sums[1:])
        back = _power(n + 1, pow(_BASE, -1, 1 << 64))
        hashes = lambda a, b: mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
        _, first, unit_of = np.unique(hashes(starts, ends), return_index=True, return_inverse=True)
        self.unit_of = unit_of.ravel()
        self.lengths = (ends - starts)[first]

        # Distinct units side by side; node k of a unit stands before its character k.
        begin = np.cumsum(self.lengths) - self.lengths
        self.begin = begin + np.arange(len(first))  # one more node than characters in each unit
        places = np.arange(int(self.lengths.sum()), dtype=np.int32)
        at = places + np.repeat((starts[first] - begin).astype(np.int32), self.lengths)
        until = np.repeat(ends[first].astype(np.int32), self.lengths) - at
        node = places + np.repeat(np.arange(len(first), dtype=np.int32), self.lengths)
        codes_at = codes[at]

        src, dst, piece = [], [], []
        # Starts whose characters so far are the prefix of some piece, one character more each turn.
        live, base, turn = node, sums[at], back[at] * SPREAD
        end = at
        for size in range(1, v.longest + 1):
            fits = until >= size
            if size > 1:
                fits &= hit
            live, until, base, turn, end = live[fits], until[fits], base[fits], turn[fits], end[fits] + 1
            if not len(live):
                break
            k, hit = v.find((sums[end] - base) * turn)
            ids = v.piece_of[k]
            ok = np.flatnonzero(hit & (ids >= 0))
            src.append(live[ok])
            dst.append(live[ok] + size)
            piece.append(ids[ok])
        spelled = np.flatnonzero(~v.has_piece(codes_at))
        src.append(node[spelled])
        dst.append(node[spelled] + 1)
        piece.append(-1 - codes_at[spelled].astype(np.int64))
        # Edges side by side by the node they end in: those of one size end in different nodes.
        nodes = len(at) + len(first)
        many = np.zeros(nodes, np.int32)
        for d in dst:
            many[d] += 1
        self.edge_at = np.concatenate(([0], np.cumsum(many)))
        slot = self.edge_at[:-1].astype(np.int32)
        total = int(many.sum())
        self.src, self.piece = np.empty(total, np.int32), np.empty(total, np.int32)
        for a, d, p in zip(src, dst, piece):
            here = slot[d]
            self.src[here], self.piece[here] = a, p
            slot[d] = here + 1
        del src, piece
        dst = np.repeat(np.arange(nodes, dtype=np.int32), many)
        width = dst - self.src
        log_w = np.where(self.piece >= 0, v.weights[np.maximum(self.piece, 0)], BYTES_WEIGHT)
        self.log_w = log_w
        w = np.exp(log_w + LIFT * width)

        alpha = np.zeros(nodes)
        alpha[self.begin] = 1.0
        depth = np.arange(nodes) - np.repeat(self.begin, self.lengths + 1)
        # The narrowest type for the longest unit at hand: small ones sort faster.
        edge_depth = depth.astype(np.min_scalar_type(int(self.lengths.max(initial=0))))[dst]
        by_depth = np.argsort(edge_depth, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(edge_depth, minlength=2))))[1:]
        share = np.zeros(len(dst))
        log_alpha = None
        for d, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
            e = by_depth[a:b]
            if not len(e):
                continue
            to = dst[e]
            heads = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            if d > LINEAR:
                if log_alpha is None:
                    with np.errstate(divide="ignore"):
                        log_alpha = np.log(alpha)
                values = log_alpha[self.src[e]] + log_w[e] + LIFT * width[e]
                top = np.maximum.reduceat(values, heads)
                many_at = np.diff(np.append(heads, len(e)))
                values = np.exp(values - np.repeat(top, many_at))
                sums = np.add.reduceat(values, heads)
                log_alpha[to[heads]] = top + np.log(sums)
                share[e] = values / np.repeat(sums, many_at)
                continue
            values = alpha[self.src[e]] * w[e]
            alpha[to[heads]] = np.add.reduceat(values, heads)
            share[e] = values / alpha[to]
        self.share = share
        # Edges into a node as steps of a ladder: node number plus the share up to the edge.
        running = np.cumsum(share)
        heads = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1]))) if len(dst) else np.empty(0, int)
        counts = np.diff(np.append(heads, len(dst)))
        below = np.repeat(running[heads] - share[heads], counts) if len(heads) else running
        self.ladder = dst + np.minimum(running - below, 1.0)
        if len(heads):
            self.ladder[np.append(heads[1:], len(dst)) - 1] = dst[heads] + 1.0
        ends = self.begin + self.lengths
        total = np.log(alpha[ends]) if log_alpha is None else log_alpha[ends]
        self.log_total = total - LIFT * self.lengths

    def into(self, node: int) -> tuple[int, int]:
        """The edges that end in a node."""
        return int(self.edge_at[node]), int(self.edge_at[node + 1])

    def path(self, node: int, begin: int, ids: list[int]) -> list[int]:
        """The edges of a segmentation, from the end of its unit."""
        out, ids = [], list(ids)
        while node > begin:
            lo, hi = self.into(node)
            spelled = None
            for e in range(lo, hi):
                if self.piece[e] == ids[-1]:
                    ids.pop()
                    break
                if self.piece[e] < 0:
                    spelled = e
            else:
                e = spelled
                code = -1 - int(self.piece[e])
                del ids[-len((chr(BLANK) if code == LITERAL else chr(code)).encode("utf-8", "surrogatepass")) :]
            out.append(e)
            node = int(self.src[e])
        return out

    def free(self, node: int, begin: int, paths: list[list[int]]) -> tuple[list[dict[int, int]], list[float]]:
        """The ends that paths share, as a tree, and at each of its places the share of segmentations up
        to there that are none of the paths. The first place is the node; edges lead on."""
        tree, nodes = [{}], [node]
        for path in paths:
            at = 0
            for e in path:
                if e not in tree[at]:
                    tree[at][e] = len(tree)
                    tree.append({})
                    nodes.append(int(self.src[e]))
                at = tree[at][e]
        left = [0.0] * len(tree)
        for at in range(len(tree) - 1, -1, -1):  # places come before those behind them
            if nodes[at] > begin:
                left[at] = float(self.shares(nodes[at], tree[at], left).sum())
        return tree, left

    def shares(self, node: int, on: dict[int, int], left: list[float]) -> np.ndarray:
        """The shares of the edges into a node without the segmentations that are taken."""
        lo, hi = self.into(node)
        shares = self.share[lo:hi].copy()
        for e, at in on.items():
            shares[e - lo] *= left[at]
        return shares

    def draw(self, units: np.ndarray, keys: np.ndarray):
        """(order, piece codes from the end of each unit, log-probabilities) for units with random keys.

        Steps are lists of (index into units, piece); each walks one piece back from the end.
        """
        logp = -self.log_total[units]
        at = self.begin[units] + self.lengths[units]
        goal = self.begin[units]
        live = np.arange(len(units))
        who, what = [], []
        step = 0
        while len(live):
            u = _uniform(keys[live] + _times(step, 0xA0761D6478BD642F))
            e = np.minimum(np.searchsorted(self.ladder, at[live] + u, "right"), len(self.ladder) - 1)
            who.append(live)
            what.append(self.piece[e])
            logp[live] += self.log_w[e]
            at[live] = self.src[e]
            live = live[at[live] > goal[live]]
            step += 1
        return who, what, np.minimum(logp, 0.0)


def _times(n: int, factor: int, plus: int = 0) -> np.uint64:
    """n * factor + plus modulo 2^64."""
    return np.uint64((n * factor + plus) % (1 << 64))


def _uniform(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _laid_out(who, what, count: int, v: Vocabulary):
    """Piece ids of all units in text order, and where each unit begins."""
    if not who:
        return np.empty(0, np.uint16), np.zeros(count + 1, np.int64)
    many = np.zeros(count, np.int64)
    for step, units in enumerate(who):  # a unit with a piece at this step has at least so many
        many[units] = step + 1
    ends = np.cumsum(many)
    piece = np.empty(ends[-1], np.int64)
    for step, (units, found) in enumerate(zip(who, what)):
        piece[ends[units] - 1 - step] = found
    spelled = np.flatnonzero(piece < 0)
    if len(spelled):
        unit = np.repeat(np.arange(count), many)
        sizes = np.ones(len(piece), np.int64)
        texts = [(chr(BLANK) if c == LITERAL else chr(c)).encode("utf-8", "surrogatepass") for c in (-1 - piece[spelled]).tolist()]
        sizes[spelled] = [len(t) for t in texts]
        out = np.repeat(piece, sizes)
        at = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(texts), np.uint8)
        spots = np.repeat(at[spelled], sizes[spelled])
        spots = spots + np.arange(len(spots)) - np.repeat(np.cumsum(sizes[spelled]) - sizes[spelled], sizes[spelled])
        out[spots] = v.byte_ids[flat]
        piece = out
        many = np.bincount(unit, weights=sizes, minlength=count).astype(np.int64)
    return piece.astype(np.uint16), np.concatenate(([0], np.cumsum(many)))


def _cut_gumbel(log_mass: np.ndarray, bound, keys: np.ndarray) -> np.ndarray:
    """Maxima of parts of some log-mass, each cut off at ``bound``."""
    spread = -np.log1p(-_uniform(keys))
    with np.errstate(divide="ignore", over="ignore"):
        return -np.logaddexp(-bound, np.log(np.maximum(spread, 1e-300)) - log_mass)


def _codes(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, where units begin, and the first unit of each text."""
    raw = [b"" if not t else (" " + t).encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(raw), np.uint32).copy()
    sizes = np.array([len(r) // 4 for r in raw], np.int64)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    codes[codes == BLANK] = LITERAL
    codes[codes == 0x20] = BLANK
    begins = np.zeros(len(codes), bool)
    if len(codes):
        blank, line = codes == BLANK, codes == 0x0A
        begins[1:] = blank[1:] & ~blank[:-1] | line[1:] | line[:-1]
        begins[edges[:-1][sizes > 0]] = True
    starts = np.flatnonzero(begins)
    return codes, starts, np.searchsorted(starts, edges)


class _Sampler:
    def __init__(self, v: Vocabulary, samples: int, seed: int):
        self.v, self.samples = v, samples
        self.seed = mix(np.array([seed], np.uint64) + np.uint64(0x8BB84B93962EACC9))[0]

    def __call__(self, keys: np.ndarray, texts) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
        """(row, sample, ids, log-probability, perturbed, inclusion) for each segmentation."""
        codes, starts, first = _codes(texts)
        row_keys = mix(mix(keys) + self.seed)
        count = len(starts)
        if count:
            lattice = _Lattice(codes, starts, self.v)
            unit = lattice.unit_of
            row = np.repeat(np.arange(len(texts)), np.diff(first))
            place = (np.arange(count) - first[row]).astype(np.uint64)
            unit_keys = mix(row_keys[row] + place * np.uint64(_BASE))
            # Sorted by unit the tables are walked from front to back.
            order = np.argsort(unit, kind="stable")
            draws = []
            for j in range(self.samples):
                who, what, logp = lattice.draw(unit[order], mix(unit_keys[order] + np.uint64(j + 1)))
                ids, at = _laid_out([order[w] for w in who], what, count, self.v)
                back = np.empty(count)
                back[order] = logp
                draws.append((ids, at, back))
            # The first segmentation of every row, and what it leaves, at once.
            tops = -np.log(-np.log(np.maximum(_uniform(mix(row_keys)), 1e-300)))
            steps = draws[0][2]
            running = np.cumsum(steps)
            before = running - steps - (running - steps)[np.minimum(first[:-1], count - 1)][row]
            rest = _left(before, steps)
            keys = mix(row_keys[row] + np.uint64(0x9FB21C651E98DF25) + place)
            bounds = _cut_gumbel(rest, tops[row], keys)
        for i in range(len(texts)):
            a, b = int(first[i]), int(first[i + 1])
            if a == b:
                yield i, 0, np.empty(0, np.uint16), 0.0, 0.0, 1.0
                continue
            yield from self._best_first(
                i, a, b, int(row_keys[i]), float(tops[i]), before[a:b], bounds[a:b], draws, lattice, unit, unit_keys
            )

    def _best_first(self, i, a, b, key, top, before, bounds, draws, lattice, unit, unit_keys):
        """Segmentations of units a..b, largest perturbed value first."""
        queue: list = []
        found = []
        age = 0
        # The part at hand: pieces of the units it fixes, their number and log-probability, and what the
        # unit after them must not be.
        prefix, fixed, mass, taken, bound = [], 0, 0.0, [], top
        for j in range(self.samples):
            ids, at, logp = draws[j]
            here = a + fixed
            if j == 0:
                own, own_logp = ids[at[a] : at[a + 1]], float(logp[a])
                steps = logp[a:b]
            else:
                other = None
                while other is None:
                    other = self._other(lattice, int(unit[here]), int(unit_keys[here]), taken, j)
                    if other is None and not queue:
                        break
                    if other is None:  # rounding gave a part some mass that has none
                        bound, _, (prefix, fixed, mass, taken) = heapq.heappop(queue)
                        bound, here = -bound, a + fixed
                if other is None:
                    break
                own, own_logp = other
                steps = np.concatenate(([own_logp], logp[here + 1 : b]))
                before = mass + np.cumsum(steps) - steps
                rest = _left(before, steps)
                left = self._left_at(lattice, int(unit[here]), [*taken, (own.tobytes(), own_logp)])
                rest[0] = mass + math.log(left) if left > 0 else -np.inf
                places = np.arange(fixed, b - a, dtype=np.uint64)
                bounds = _cut_gumbel(rest, bound, mix(_times(j + 1, 0x9FB21C651E98DF25, key) + places))
            parts = [*prefix, own, ids[at[here + 1] : at[b]]]
            found.append((np.concatenate(parts), mass + float(steps.sum()), bound))
            # As many parts can be wanted as segmentations are still asked for, and one bound more.
            wanted = self.samples - j
            best = np.argpartition(bounds, -wanted)[-wanted:] if len(bounds) > wanted else np.arange(len(bounds))
            for t in best.tolist():
                if bounds[t] == -np.inf:
                    continue
                if t == 0:
                    part = (prefix, fixed, mass, [*taken, (own.tobytes(), own_logp)])
                else:
                    u = here + t
                    choice = (ids[at[u] : at[u + 1]].tobytes(), float(steps[t]))
                    part = ([*prefix, own, ids[at[here + 1] : at[u]]], fixed + t, float(before[t]), [choice])
                heapq.heappush(queue, (-float(bounds[t]), age, part))
                age += 1
            if not queue or j + 1 == self.samples:
                break
            bound, _, (prefix, fixed, mass, taken) = heapq.heappop(queue)
            bound = -bound
        threshold = -queue[0][0] if queue else -np.inf
        for j, (ids, logp, bound) in enumerate(found):
            inclusion = 1.0 if threshold == -np.inf else -math.expm1(-math.exp(min(logp - threshold, 700.0)))
            yield i, j, ids, logp, bound, inclusion

    def _left_at(self, lattice, unit: int, taken) -> float:
        """The share of segmentations of a unit that are not taken."""
        begin = int(lattice.begin[unit])
        end = begin + int(lattice.lengths[unit])
        paths = [lattice.path(end, begin, np.frombuffer(t, np.uint16).tolist()) for t, _ in taken]
        return lattice.free(end, begin, paths)[1][0]

    def _other(self, lattice, unit: int, key: int, taken, j: int):
        """A draw of a unit that is none of the taken ones, None if there is no other."""
        begin = int(lattice.begin[unit])
        end = begin + int(lattice.lengths[unit])
        paths = [lattice.path(end, begin, np.frombuffer(t, np.uint16).tolist()) for t, _ in taken]
        tree, left = lattice.free(end, begin, paths)
        codes, logp, node, step, on = [], -float(lattice.log_total[unit]), end, 0, 0
        while node > begin:
            lo, hi = lattice.into(node)
            shares = lattice.shares(node, {} if on is None else tree[on], left)
            total = float(shares.sum())
            if total <= 0.0:
                return None
            u = float(_uniform(np.array([_times(step + 1, 0xE7037ED1A0B428DB, key + j)]))[0]) * total
            e = lo + min(int(np.searchsorted(np.cumsum(shares), u, "right")), hi - lo - 1)
            on = None if on is None else tree[on].get(e)
            codes.append((np.array([0]), lattice.piece[e : e + 1]))
            logp += float(lattice.log_w[e])
            node, step = int(lattice.src[e]), step + 1
        ids, _ = _laid_out([c[0] for c in codes], [c[1] for c in codes], 1, self.v)
        return ids, min(logp, 0.0)


def _left(before: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Log-mass of the segmentations that agree before a unit and differ in it."""
    with np.errstate(divide="ignore"):
        rest = before + np.log(-np.expm1(steps))
    rest[steps > -1e-11] = -np.inf
    return rest


def _vocabulary(spark: SparkSession, path: str, sharpness: float):
    """The vocabulary as a broadcast: the file is read on the driver, executors need no copy."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0] if "://" in path else open(path, "rb").read()
    return spark.sparkContext.broadcast(Vocabulary.load(bytes(io.BytesIO(data).getvalue()), sharpness))


def encode(
    docs: DataFrame, samples: int = SAMPLES, seed: int = 0, key: str = "doc_id", text: str = "text",
    model: str = MODEL, sharpness: float = SHARPNESS, checked: bool = False,
) -> DataFrame:
    """``samples`` rows per row: all columns but the text, and the segmentation.

    Adds ``sample`` (from 0, best first), ``ids`` (piece ids as 16-bit little-endian numbers),
    ``log_prob``, ``perturbed`` and ``inclusion`` (the probability to be among the samples, given the
    threshold); columns of these names are replaced. ``checked`` adds ``round_trip``: whether decoding
    gives the text, looked at where it was encoded, without a second stage of Python workers.
    """
    sent = _vocabulary(docs.sparkSession, model, sharpness)
    made_here = {"sample", "ids", "log_prob", "perturbed", "inclusion", *(["round_trip"] if checked else [])}
    others = [c for c in docs.columns if c != text and c not in made_here]
    schema = docs.select(*others, F.col(text).alias("__text"), F.coalesce(F.xxhash64(key), F.lit(0)).alias("__key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = _Sampler(sent.value, samples, seed)
        for batch in batches:
            for part in slices(batch["__text"]):
                rows = batch.iloc[part]
                made = list(sampler(rows["__key"].to_numpy(np.int64).view(np.uint64), rows["__text"]))
                out = rows[others].iloc[[m[0] for m in made]].reset_index(drop=True)
                out["sample"] = np.array([m[1] for m in made], np.int32)
                out["ids"] = [m[2].astype("<u2").tobytes() for m in made]
                out["log_prob"], out["perturbed"], out["inclusion"] = ([m[c] for m in made] for c in (3, 4, 5))
                if checked:
                    texts = rows["__text"].to_list()
                    again = (sent.value.decode(np.frombuffer(b, "<u2").astype(np.int64)) for b in out["ids"])
                    out["round_trip"] = [t == (texts[m[0]] or "") for t, m in zip(again, made)]
                yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema if f.name in others)
    return schema.mapInPandas(
        run, f"{kinds}, sample int, ids binary, log_prob double, perturbed double, inclusion double" + ", round_trip boolean" * checked
    )


def decode(rows: DataFrame, ids: str = "ids", name: str = "text", model: str = MODEL) -> DataFrame:
    """All columns of ``rows`` and the text of ``ids``."""
    sent = _vocabulary(rows.sparkSession, model, SHARPNESS)

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [None if b is None else sent.value.decode(np.frombuffer(b, "<u2").astype(np.int64)) for b in batch],
                dtype=object,
            )

    texts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(name, F.pandas_udf(texts, "string")(F.col(ids)))


def op3_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text: digests, scores, and whether decoding gives the text."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, checked=True)
    return encoded.select(
        "doc_id",
        "sample",
        (F.octet_length("ids") / 2).cast("bigint").alias("n_pieces"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "log_prob",
        "perturbed",
        "inclusion",
        "round_trip",
    )


QUERIES = {"op3_segmentation": op3_segmentation}
ORACLE: dict[str, str] = {}

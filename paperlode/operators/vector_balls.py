"""Exact vector search that leaves out blocks which can't matter.

A batch of candidate vectors is halved until its parts are small; a part is known by its centre m and its radius r. For a
query q no vector c of the part has q·c above q·m + |q| r, because |q·(c - m)| <= |q| |c - m|, and none has it below
q·m - |q| r. A part whose upper bound stays below a query's k-th best score so far is not met by that query. Results
are those of the full scan: a bound is widened by more than the rounding of scores and sums, and equal scores are met.

The bounds hold for vectors of any length, zero vectors included. How much is left out depends on the data: vectors in
clusters leave out most, independent random ones of many dimensions nearly nothing, at the cost of one more product a part.
"""

from collections.abc import Iterator

import numpy as np

#: Vectors of a part. Larger parts have wider bounds, smaller ones cost more calls.
PART = 128
#: Queries that meet a batch at once, below 65,536: their bounds and products are held.
SLICE = 4096
#: Scores are rounded to this many digits, so that equal ones are equal whatever the shape of a product.
SCORE_DIGITS = 9
#: Widening of the bounds, relative to the size of what is added up.
SLACK = 1e-8
#: Vectors below this length are multiplied in single precision first: no sum overflows. What rounding an entry or a sum
#: may add to a product of d entries is below (d + 4) times SINGLE times both lengths, and far below SLACK for tiny entries.
SAFE = 1e15
SINGLE = 2.0**-23


def parts_of(matrix: np.ndarray, size: int = PART) -> list[np.ndarray]:
    """Row numbers in parts of near vectors, ``size`` at most.

    A part is cut midway between two far vectors; where that takes away less than 1/64 of it, into halves.
    """
    done, open_ = [], [np.arange(len(matrix))]
    while open_:
        at = open_.pop()
        if len(at) <= size:
            done.append(at)
            continue
        rows = matrix[at]
        one = rows[np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1))]
        other = rows[np.argmax(((rows - one) ** 2).sum(axis=1))]
        side = rows @ (one - other)
        order = np.argsort(side, kind="stable")
        cut = int((side <= (one + other) @ (one - other) / 2).sum())
        if min(cut, len(at) - cut) * 64 < len(at):
            cut = len(at) // 2
        open_ += [at[order[:cut]], at[order[cut:]]]
    return done


class Parts:
    """Parts of a batch with their centres and radii."""

    def __init__(self, matrix: np.ndarray, size: int = PART):
        self.rows = parts_of(matrix, size)
        self.centres = np.stack([matrix[p].mean(axis=0) for p in self.rows])
        self.radii = np.array([np.sqrt(((matrix[p] - m) ** 2).sum(axis=1).max()) for p, m in zip(self.rows, self.centres, strict=True)])


class Balls:
    """Parts of a batch with bounds of their products with some queries."""

    def __init__(self, queries: np.ndarray, matrix: np.ndarray, size: int = PART, parts: Parts | None = None):
        made = parts or Parts(matrix, size)
        self.parts = made.rows
        lengths = np.linalg.norm(queries, axis=1)[:, None]
        middle, span = queries @ made.centres.T, lengths * made.radii
        slack = SLACK * (1 + lengths * (np.linalg.norm(made.centres, axis=1) + made.radii))
        self.upper, self.lower = middle + span + slack, middle - span - slack


def _single(matrix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return matrix.astype(np.float32)


def _slices(n: int) -> list[slice]:
    return [slice(i, min(i + SLICE, n)) for i in range(0, n, SLICE)]


class TopK:
    """Best ``k`` candidates of each query over all batches it was given; ties by id."""

    def __init__(self, queries: np.ndarray, k: int, size: int = PART):
        self.queries, self.k, self.size = queries, k, size
        self._single, self._lengths = _single(queries), np.linalg.norm(queries, axis=1)
        n = len(queries)
        self.floor = np.full(n, -np.inf)
        #: Candidates each query has so far, and their scores and ids, best first.
        self.counts = np.zeros(n, dtype=np.int64)
        self._scores = np.full((n, k), -np.inf)
        self._ids: np.ndarray | None = None
        #: Pairs of query and candidate whose product was taken, and all pairs.
        self.met = self.pairs = 0

    @property
    def scores(self) -> list[np.ndarray]:
        return [line[:n] for line, n in zip(self._scores, self.counts, strict=True)]

    @property
    def ids(self) -> list:
        return [line[:n] if n else None for line, n in zip(self._ids, self.counts, strict=True)] if self._ids is not None else [None] * len(self.counts)

    def hits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All that was found, in slices of queries: number of the query, id and score."""
        for at in _slices(len(self.counts)) if self._ids is not None else []:
            filled = np.arange(self.k) < self.counts[at, None]
            yield np.nonzero(filled)[0] + at.start, self._ids[at][filled], self._scores[at][filled]

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        """Candidates with an entry that is no finite number have no score and never come up."""
        finite = np.isfinite(matrix).all(axis=1)
        self.pairs += len(self.queries) * len(ids)
        ids, matrix = ids[finite], matrix[finite]
        if not len(ids) or not len(self.queries):
            return
        if self._ids is None:
            self._ids = np.zeros(self._scores.shape, dtype=ids.dtype)
        elif self._ids.dtype != ids.dtype:
            self._ids = self._ids.astype(np.promote_types(self._ids.dtype, ids.dtype))
        parts = Parts(matrix, self.size)
        blocks = [_Block(ids[p], matrix[p]) for p in parts.rows]
        for at in _slices(len(self.queries)):
            self._add(at, matrix, parts, blocks)

    def _add(self, at: slice, matrix: np.ndarray, parts: Parts, blocks: list["_Block"]) -> None:
        balls = Balls(self.queries[at], matrix, self.size, parts)
        upper, floor = balls.upper, self.floor[at]
        # Every query meets its most promising part first: that raises its floor for the others.
        first = upper.argmax(axis=1)
        own = upper[np.arange(len(first)), first] >= floor
        found = [self._meet(at, own & (first == j), blocks[j]) for j in np.unique(first[own])]
        self._merge(found)
        upper[np.arange(len(first)), first] = -np.inf
        found, waiting = [], 0
        for j in np.argsort(-upper.max(axis=0), kind="stable"):
            found.append(self._meet(at, (upper[:, j] > -np.inf) & (upper[:, j] >= floor), blocks[j]))
            waiting += len(found[-1][0])
            # Floors rise when what was found is merged; a merge for every part would cost more than the products.
            if 2 * waiting > len(first) * self.k:
                self._merge(found)
                found, waiting = [], 0
        self._merge(found)

    def _meet(self, at: slice, alive: np.ndarray, block: "_Block") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, scores and ids of the pairs of a part and the queries ``alive`` in a slice that may enter a best ``k``.

        Products are taken in single precision if that can't overflow. A pair is left out if its product is below the bar by
        more than their error; scores are always those of double precision.
        """
        some = np.flatnonzero(alive)
        self.met += len(some) * len(block.ids)
        # Most queries of a slice are met where they lie: a bar that nothing reaches is cheaper than a copy.
        dense = 2 * len(some) > len(alive)
        of = at if dense else at.start + some
        lengths, bar = self._lengths[of], self.floor[of].copy()
        met = alive if dense else np.ones(len(some), dtype=bool)
        single = block.length < SAFE and bool((lengths < SAFE).all())
        lines = self._single[of] @ block.single.T if single else self.queries[of] @ block.matrix.T
        error = SINGLE * (block.matrix.shape[1] + 4) * lengths * block.length if single else 0.0
        if len(block.ids) > self.k:
            # A query that has no floor yet takes the best k of the part and their equals.
            new = np.flatnonzero(met & (bar == -np.inf))
            if len(new):
                seen = lines[new]
                seen = np.partition(np.where(np.isnan(seen), -np.inf, seen), len(block.ids) - self.k, axis=1)[:, len(block.ids) - self.k]
                bar[new] = seen - (error[new] if single else 0.0)
        # Scores are rounded where they may enter only; until then the bar is lower by more than the rounding.
        bar -= SLACK * (1 + np.where(np.isfinite(bar), np.abs(bar), 0)) + error
        bar[~met] = np.inf
        if single:
            bar = np.nextafter(bar.astype(np.float32), np.float32(-np.inf))
            bar[~met] = np.inf
        pairs = np.flatnonzero(lines >= bar[:, None])
        row, column = np.divmod(pairs, len(block.ids))
        queries = at.start + (row if dense else some[row])
        if not single:
            scores = lines[row, column]
        elif 8 * len(pairs) > lines.size:
            scores = (self.queries[of] @ block.matrix.T)[row, column]
        else:
            scores = np.einsum("ij,ij->i", self.queries[queries], block.matrix[column])
        scores, ids = np.round(scores, SCORE_DIGITS), block.ids[column]
        # Of equal scores the lower id enters.
        floor = self.floor[queries]
        able = (scores > floor) | (self.counts[queries] < self.k) & (scores == floor)
        equal = np.flatnonzero(~able & (scores == floor))
        able[equal] = ids[equal] < self._ids[queries[equal], self.k - 1]
        return queries[able], scores[able], ids[able]

    def _merge(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """What was found next to what the queries have; the best ``k`` stay."""
        if not sum(len(queries) for queries, _, _ in found):
            return
        queries, scores, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        at, row = np.unique(queries, return_inverse=True)
        held_row, held_rank = np.nonzero(np.arange(self.k) < self.counts[at, None])
        row = np.concatenate([held_row, row])
        scores = np.concatenate([self._scores[at[held_row], held_rank], scores])
        ids = np.concatenate([self._ids[at[held_row], held_rank], ids])
        order = np.argsort(-scores)
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
        if ((np.diff(row[order]) == 0) & (scores[order[1:]] == scores[order[:-1]])).any():
            order = np.lexsort((ids, -scores, row))
        sizes = np.bincount(row, minlength=len(at))
        row, rank = row[order], np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = rank < self.k
        to, rank, order = at[row[kept]], rank[kept], order[kept]
        self._scores[to, rank], self._ids[to, rank] = scores[order], ids[order]
        self.counts[at] = np.minimum(sizes, self.k)
        full = at[self.counts[at] == self.k]
        self.floor[full] = self._scores[full, self.k - 1]


class _Block:
    """Ids and vectors of a part, also in single precision, and the greatest length."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix, self.single = ids, matrix, _single(matrix)
        self.length = float(np.linalg.norm(matrix, axis=1).max())


class Profile:
    """Pairs compared, pairs of ``at_least`` and the best score of each query over all batches."""

    def __init__(self, queries: np.ndarray, at_least: float, size: int = PART):
        self.queries, self.at_least, self.size = queries, at_least, size
        self.compared = np.zeros(len(queries), dtype=np.int64)
        self.similar = np.zeros(len(queries), dtype=np.int64)
        self.best = np.full(len(queries), -np.inf)

    def add(self, matrix: np.ndarray) -> None:
        self.compared += len(matrix)
        matrix = matrix[np.isfinite(matrix).all(axis=1)]
        if not len(matrix) or not len(self.queries):
            return
        parts = Parts(matrix, self.size)
        for at in _slices(len(self.queries)):
            self._add(at, matrix, parts)

    def _add(self, at: slice, matrix: np.ndarray, parts: Parts) -> None:
        queries, similar, best = self.queries[at], self.similar[at], self.best[at]
        balls = Balls(queries, matrix, self.size, parts)
        for j in np.argsort(-balls.upper.max(axis=0), kind="stable"):
            upper, part = balls.upper[:, j], balls.parts[j]
            raises = upper >= best
            # Whole parts on one side of the limit are counted without a product.
            similar[~raises & (balls.lower[:, j] >= self.at_least)] += len(part)
            alive = np.flatnonzero(raises | (upper >= self.at_least) & (balls.lower[:, j] < self.at_least))
            lines = np.round(queries[alive] @ matrix[part].T, SCORE_DIGITS)
            similar[alive] += (lines >= self.at_least).sum(axis=1)
            best[alive] = np.maximum(best[alive], lines.max(axis=1))

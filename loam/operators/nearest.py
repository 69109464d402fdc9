"""Nearest labels by cosine of character-bigram tf-idf without comparing every pair: what a task does with its blocks.

Bigrams are numbered from the rarest to the commonest.  If the rarest bigram that two labels share is ``g``, their cosine
is at most the product of the lengths of what is left of both unit vectors from ``g`` on.  Pairs whose product is below
the score that already stands at the last place of a query are never multiplied, which leaves out no pair that belongs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Half the last decimal of a score, and a margin for single precision; a cosine below the first counts as 0.
HALF, MARGIN = 0.00005, 0.00002
#: Labels that give the first bounds, rows multiplied at once, and pairs merged at once.
SEED, QUERIES, LABELS, PAIRS = 2048, 512, 4096, 2_000_000


class Weights(NamedTuple):
    """Bigrams in order of their code, their numbers in order of weight, and the weights by number."""

    codes: np.ndarray
    numbers: np.ndarray
    weights: np.ndarray


def weights(codes: np.ndarray, counts: np.ndarray, n: int) -> Weights:
    order = np.argsort(codes)
    codes, w = codes[order], np.log((n + 2) / (counts[order] + 1)) + 1
    rarest = np.lexsort((codes, -w))
    numbers = np.empty(len(w), np.int64)
    numbers[rarest] = np.arange(len(w))
    return Weights(codes, numbers, w[rarest])


def bigram_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of every pair of neighbouring characters, both characters in one number."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    same = rows[1:] == rows[:-1]
    return rows[1:][same], (points[:-1] << 21 | points[1:])[same]


def labels_by_bigram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``code, n``: labels that hold each bigram, by batch."""
    for b in batches:
        rows, found = bigram_codes(b.column(0))
        codes, at = np.unique(found, return_inverse=True)
        held = np.unique(rows * max(1, len(codes)) + at) % max(1, len(codes))
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.bincount(held, minlength=len(codes)).astype(np.int64))], ["code", "n"])


def _spans(first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each ``first`` to its end, and which span each is of."""
    n = ends - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.arange(len(n)), n)


class Vectors:
    """Entries of sparse vectors in order of row and bigram; ``rest`` is the length of the unit vector from an entry on."""

    def __init__(self, texts: pa.Array, w: Weights) -> None:
        self.n, self.n_grams = len(texts), max(1, len(w.codes))
        rows, found = bigram_codes(texts)
        numbers = w.numbers[np.searchsorted(w.codes, found)] if len(found) else found
        self.keys, tf = np.unique(rows * self.n_grams + numbers, return_counts=True)
        self.rows, self.grams = np.divmod(self.keys, self.n_grams)
        self.x = tf * w.weights[self.grams]
        self.starts = np.searchsorted(self.rows, np.arange(self.n + 1))
        squares = np.bincount(self.rows, self.x**2, self.n)
        self.norms = np.sqrt(squares)
        before = np.cumsum(self.x**2) - self.x**2
        self.rest = np.sqrt(np.maximum(0.0, squares[self.rows] - (before - before[self.starts[self.rows]]))) / self.norms[self.rows]

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries in order of bigram, and where each bigram begins."""
        order = np.argsort(self.grams, kind="stable")
        return order, np.searchsorted(self.grams[order], np.arange(self.n_grams + 1))

    def dense(self, entries: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
        """Unit vectors from the given entries on, with the bigrams that have a place."""
        at, of = _spans(entries, self.starts[self.rows[entries] + 1])
        column = places[self.grams[at]]
        held = column >= 0
        m = np.zeros((len(entries), width), np.float32)
        m[of[held], column[held]] = (self.x[at] / self.norms[self.rows[at]])[held]
        return m

    def used(self, entries: np.ndarray) -> np.ndarray:
        return np.unique(self.grams[_spans(entries, self.starts[self.rows[entries] + 1])[0]])


def near(asked: Vectors, labels: Vectors, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``asked`` and ``labels`` whose cosine may reach the query's floor, none that does left out; a pair may come
    again.  The floors may rise meanwhile."""
    (q_order, q_bounds), (x_order, x_bounds) = asked.postings(), labels.postings()
    places = np.full(asked.n_grams, -1, np.int64)
    for g in np.flatnonzero((np.diff(q_bounds) > 0) & (np.diff(x_bounds) > 0)):
        a = q_order[q_bounds[g] : q_bounds[g + 1]]
        need = (floor[asked.rows[a]] - MARGIN) / asked.rest[a]
        order = np.argsort(need, kind="stable")
        order = order[: np.searchsorted(need[order], 1.0, "right")]
        a, need = a[order], need[order]
        b = x_order[x_bounds[g] : x_bounds[g + 1]]
        b = b[np.argsort(-labels.rest[b], kind="stable")]
        rest = -labels.rest[b]
        for i in range(0, len(a), QUERIES):
            reach = np.searchsorted(rest, -need[i], "right")
            if not reach:
                break
            part = a[i : i + QUERIES]
            used = asked.used(part)
            places[used] = np.arange(len(used))
            left = asked.dense(part, places, len(used))
            least = (floor[asked.rows[part]] - MARGIN)[:, None].astype(np.float32)
            for j in range(0, reach, LABELS):
                right = b[j : min(j + LABELS, reach)]
                hit = np.flatnonzero(left @ labels.dense(right, places, len(used)).T >= least)
                if len(hit):
                    q, x = np.divmod(hit, len(right))
                    yield asked.rows[part[q]], labels.rows[right[x]]
            places[used] = -1


class Nearest:
    """The best ``top`` labels of each query of a block among the labels seen so far."""

    def __init__(self, ids: pa.Array, texts: pa.Array, w: Weights, top: int) -> None:
        self.ids, self.w, self.top, self.seen = ids, w, top, 0
        self.v = Vectors(texts, w)
        self.floor = np.full(len(ids), HALF)
        self.q, self.number, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), ids[:0]

    def see(self, ids: pa.Array, texts: pa.Array) -> None:
        """Parts grow with what was seen, so that most labels meet high floors."""
        if not self.seen:
            self._seed(texts[:SEED])
        first = 0
        while first < len(ids):
            n = min(max(SEED, self.seen), len(ids) - first)
            part, labels = ids[first : first + n], Vectors(texts[first : first + n], self.w)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for pair in near(self.v, labels, self.floor):
                found.append(pair)
                if sum(len(q) for q, _ in found) > PAIRS:
                    self._merge(found, part, labels)
                    found = []
            if found:
                self._merge(found, part, labels)
            first, self.seen = first + n, self.seen + n

    def _seed(self, texts: pa.Array) -> None:
        """First floors: one place more than ``top``, as a query's own id does not count."""
        labels = Vectors(texts, self.w)
        if labels.n <= self.top:
            return
        rows = np.flatnonzero(np.diff(self.v.starts))
        for i in range(0, len(rows), QUERIES):
            entries = self.v.starts[rows[i : i + QUERIES]]
            used, places = self.v.used(entries), np.full(labels.n_grams, -1, np.int64)
            places[used] = np.arange(len(used))
            scores = self.v.dense(entries, places, len(used)) @ labels.dense(labels.starts[:-1][np.diff(labels.starts) > 0], places, len(used)).T
            if scores.shape[1] > self.top:
                least = np.partition(scores, -self.top - 1, axis=1)[:, -self.top - 1]
                self.floor[rows[i : i + QUERIES]] = np.maximum(HALF, least - MARGIN - 2 * HALF)

    def _merge(self, found: list[tuple[np.ndarray, np.ndarray]], ids: pa.Array, labels: Vectors) -> None:
        pairs = np.unique(np.concatenate([q << 32 | x for q, x in found]))
        pairs = pairs[~np.isin((pairs >> 32) << 40 | (pairs & 0xFFFFFFFF) + self.seen, self.q << 40 | self.number)]
        q, x = pairs >> 32, pairs & 0xFFFFFFFF
        other = pc.not_equal(self.ids.take(pa.array(q)), ids.take(pa.array(x))).to_numpy(zero_copy_only=False)
        q, x = q[other], x[other]
        at, of = _spans(labels.starts[x], labels.starts[x + 1])
        key = q[of] * labels.n_grams + labels.grams[at]
        mine = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        shared = self.v.keys[mine] == key
        dots = np.bincount(of[shared], (self.v.x[mine] * labels.x[at])[shared], len(q))
        score = np.floor(dots / (self.v.norms[q] * labels.norms[x]) * 10_000 + 0.5) / 10_000
        good = score > 0
        q, x, score = q[good], x[good], score[good]
        rows = pa.table({"q": np.concatenate([self.q, q]), "number": np.concatenate([self.number, x + self.seen]), "score": np.concatenate([self.score, score]), "id": pa.concat_arrays([self.id, ids.take(pa.array(x))])})
        rows = rows.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        q = rows["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        rows, place = rows.filter(pa.array(place < self.top)), place[place < self.top]
        self.q, self.number, self.score = (rows[c].to_numpy() for c in ("q", "number", "score"))
        self.id = rows["id"].combine_chunks()
        last = place == self.top - 1
        self.floor[self.q[last]] = np.maximum(self.floor[self.q[last]], self.score[last] - HALF)

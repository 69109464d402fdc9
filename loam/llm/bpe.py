"""Byte-level BPE over a whole batch of distinct words at once (problem 8).

A *pair occurrence index* maps each active merge rank to all positions at which its pair stands, over every
distinct word of the batch.  Ranks are applied in ascending order; a merge rewrites all its positions with array
operations on a linked list and only the pairs beside them are looked up again.  That equals merging word by word,
because a pair that contains a merged token is always learned after that token, so its rank is higher.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the split of a text into words that byte-level BPE of this family uses.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 400_000


def byte_letters() -> dict[int, str]:
    """Printable stand-in of each byte: itself if visible in Latin-1, else the next code point from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@dataclass
class Merges:
    """Merge table as arrays: sorted pair codes with rank; by rank, both sides and the merged id; ids of bytes."""

    codes: np.ndarray
    ranks: np.ndarray
    left: np.ndarray
    right: np.ndarray
    merged: np.ndarray
    of_byte: np.ndarray

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        codes = left << 20 | right
        order = np.argsort(codes)
        letters = byte_letters()
        return cls(
            codes[order], order.astype(np.int64), left, right,
            np.array([vocab[a + b] for a, b in pairs], np.int64), np.array([vocab[letters[b]] for b in range(256)], np.int64),
        )

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it is never merged."""
        code = left << 20 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = np.append(self.of_byte[np.frombuffer(b"".join(words), np.uint8)], -1)
        end = len(symbol) - 1
        ends = np.cumsum(sizes)
        after = np.arange(1, end + 2)
        before = np.arange(-1, end)
        full = sizes > 0
        after[ends[full] - 1] = end  # a word's last symbol has no neighbour
        before[(ends - sizes)[full]] = end
        alive = np.ones(end + 1, bool)
        alive[end] = False
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            """Enter the pairs that begin at ``places`` into the index."""
            rank = self.rank_of(symbol[places], symbol[after[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            if not len(places):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        first = np.arange(end)
        note(first[after[:end] != end])
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            places = places[alive[places] & (symbol[places] == a)]
            follow = after[places]
            places = places[symbol[follow] == b]
            if not len(places):
                continue
            if a == b:  # in a run of one symbol every other pair is merged, from the left
                linked = np.append(False, after[places[:-1]] == places[1:])
                heads = np.flatnonzero(~linked)
                inside = np.arange(len(places)) - np.repeat(heads, np.diff(np.append(heads, len(places))))
                places = places[inside % 2 == 0]
            gone = after[places]
            beyond = after[gone]
            symbol[places] = self.merged[r]
            alive[gone] = False
            after[places] = beyond
            before[beyond] = places
            previous = before[places]
            touched = np.concatenate([previous[previous != end], places[beyond != end]])
            if len(touched) > 1:
                touched = np.unique(touched)
            if len(touched):
                note(touched)
        counts = np.add.reduceat(np.append(alive[:end], False).astype(np.int64), np.minimum(ends - sizes, end)) if len(words) else sizes
        return symbol[:end][alive[:end]], np.where(full, counts, 0)


class WordCache:
    """Ids of the distinct words met so far in a partition, as one flat array."""

    def __init__(self, merges: Merges):
        import regex

        self.merges, self.split = merges, regex.compile(PATTERN)
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        if len(self.place) > CACHE_WORDS:
            self.reset()
        place, known = self.place, len(self.place)
        per_text = []
        for t in texts:
            words = self.split.findall(t) if t else ()
            per_text.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words)))
        if len(place) > known:
            new = [w.encode("utf-8") for w in list(place)[known:]]
            ids, sizes = self.merges.encode_words(new)
            self.start = np.append(self.start, len(self.ids) + np.cumsum(sizes) - sizes)
            self.ids, self.size = np.append(self.ids, ids), np.append(self.size, sizes)
        words = np.concatenate(per_text) if per_text else np.zeros(0, np.int64)
        size = self.size[words]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        inside = np.arange(total) - np.repeat(ends - size, size)
        flat = self.ids[np.repeat(self.start[words], size) + inside]
        lengths = np.array([len(p) for p in per_text], np.int64)
        upto = np.append(0, ends)[np.append(0, np.cumsum(lengths))]
        return flat, np.diff(upto)


def _encoder(df: DataFrame, vocabulary: str):
    return df.sparkSession.sparkContext.broadcast(Merges.load(f"{vocabulary}/byte_bpe_50k.json"))


def encode_documents(documents: DataFrame, vocabulary: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, ids)`` of every document's whole text; the list is empty for null and empty text.

    ``vocabulary`` is the folder of the public vocabulary files; only the driver reads it, and the merge table
    (about 2 MB whatever the data) is broadcast.  Special tokens are ordinary text.  Rows are streamed in Arrow
    batches and no shuffle is needed.
    """
    merges = _encoder(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(merges.value)
        for batch in batches:
            flat, lengths = cache.encode(batch.column("text").to_pylist())
            offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, *keep: str, vocabulary: str = TOKENIZERS) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` (the length of ``ids`` of ``encode_documents``) of every document."""
    merges = _encoder(documents, vocabulary)
    chosen = documents.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(merges.value)
        for batch in batches:
            _, lengths = cache.encode(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lengths)], [*batch.schema.names[:-1], "n_tokens"])

    return chosen.mapInArrow(run, f"{schema}, n_tokens long")

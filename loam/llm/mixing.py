"""Mixing sources to target weights (problem 9).

Documents are aggregated by membership pattern (the set of sources that hold their text).  A flow of least cost on the
driver routes each pattern's tokens to the quotas of the sources; passing a pattern again costs one more each time (a
convex cost), so repeats are spread as evenly as the quotas let them.  Documents are then laid on a seeded tape per
pattern, and every document's copies follow from where its tokens begin.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.bpe import TOKENIZERS, count_tokens
from loam.plans.ordered import TARGET_ROWS, bucketed
from loam.session import cut

SEED = 17
#: Patterns that may reach the driver, about 100 bytes each; more are an error.
MAX_PATTERNS = 1_000_000
#: Rows of the plan that are broadcast; a larger plan is joined by shuffling.
BROADCAST_ROWS = 100_000
ALLOT = "mix string, pattern string, source string, begins long, tokens long, pattern_tokens long"


class Flow:
    """Flow of least cost from patterns (rows) to sources (columns), all patterns at a time.

    The n-th pass of a pattern's tokens costs n, whichever source takes it.  A cheapest way through the network costs
    what the pass at its start costs, since all other arcs are free and none leads back to the start; so the ways of
    cost 0 are used up first, then those of cost 1, and so on.  A way may lead on from a source whose quota is full:
    some pattern's tokens move from it to another source, and what they leave is filled anew.
    """

    def __init__(self, tokens: np.ndarray, capacity: np.ndarray, quota: np.ndarray):
        self.tokens, self.capacity, self.need = tokens, capacity, quota.copy()
        self.flow = np.zeros_like(capacity)
        self.left = np.zeros_like(tokens)

    @staticmethod
    def _first(room: np.ndarray, most: int) -> np.ndarray:
        """The first of ``room`` that sum to ``most`` at most."""
        upto = np.cumsum(room)
        return np.clip(most - (upto - room), 0, room)

    def _fresh(self, j: int) -> np.ndarray:
        return np.minimum(self.left, self.capacity[:, j] - self.flow[:, j])

    def _moved(self, a: int, b: int) -> np.ndarray:
        return np.minimum(self.flow[:, a], self.capacity[:, b] - self.flow[:, b])

    def _way(self) -> list[int]:
        """Sources of a shortest way from unused tokens to an open quota; empty if there is none."""
        via = {j: -1 for j in range(len(self.need)) if self._fresh(j).any()}
        queue = list(via)
        for a in queue:
            if self.need[a] > 0:
                way = [a]
                while via[way[0]] >= 0:
                    way.insert(0, via[way[0]])
                return way
            for b in range(len(self.need)):
                if b not in via and self._moved(a, b).any():
                    via[b] = a
                    queue.append(b)
        return []

    def _push(self, way: list[int]) -> None:
        steps = list(zip(way, way[1:], strict=False))
        most = min(int(self.need[way[-1]]), int(self._fresh(way[0]).sum()), *(int(self._moved(a, b).sum()) for a, b in steps))
        self.need[way[-1]] -= most
        for a, b in reversed(steps):
            x = self._first(self._moved(a, b), most)
            self.flow[:, a] -= x
            self.flow[:, b] += x
        x = self._first(self._fresh(way[0]), most)
        self.flow[:, way[0]] += x
        self.left -= x

    def run(self, passes: np.ndarray) -> np.ndarray:
        """Tokens by pattern and source; pattern ``p`` may be passed ``passes[p]`` times in all."""
        for n in range(int(passes.max(initial=0))):
            self.left += np.where(passes > n, self.tokens, 0)
            while self.need.any() and (way := self._way()):
                self._push(way)
            if not self.need.any():
                break
            self.left[:] = 0
        return self.flow


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens each pattern gives to each source: a flow of least repetition cost that fills the quotas as far as
    ``repeats`` passes of the tokens allow."""
    names, sources = list(patterns), list(quotas)
    place = {s: j for j, s in enumerate(sources)}
    times = np.zeros((len(names), len(sources)), np.int64)
    for i, p in enumerate(names):
        for s in p:
            if s in place:
                times[i, place[s]] = repeats[s]
    tokens = np.array([patterns[p] for p in names], np.int64)
    flow = Flow(tokens, tokens[:, None] * times, np.array([quotas[s] for s in sources], np.int64)).run(times.sum(1))
    return {(names[i], sources[j]): int(flow[i, j]) for i, j in zip(*np.nonzero(flow), strict=True)}


def quotas_of(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Whole tokens per source that sum to ``total`` (largest remainders)."""
    whole = sum(weights.values())
    exact = {s: total * w / whole for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: total - sum(out.values())]:
        out[s] += 1
    return out


def largest_total(patterns: dict[tuple[str, ...], int], weights: dict[str, float], repeats: dict[str, int]) -> int:
    """Most tokens at which every source still reaches its share exactly.

    Sources may take the same tokens, each as often as it may repeat them, so a source can give ``repeats`` times the
    tokens of its patterns whatever the others take.
    """
    able = {s: repeats[s] * sum(t for p, t in patterns.items() if s in p) for s in weights}
    low, high = 0, sum(able.values())
    while low < high:
        mid = (low + high + 1) // 2
        if all(q <= able[s] for s, q in quotas_of(mid, weights).items()):
            low = mid
        else:
            high = mid - 1
    return low


def allot(patterns: dict[tuple[str, ...], int], targets: list[tuple[str, str, float, int]], total_tokens: int | None = None) -> list[tuple]:
    """Rows of ``ALLOT``: the stretch of each pattern's tape that each source of each mix takes."""
    out = []
    for mix in sorted({t[0] for t in targets}):
        chosen = {s: (w, r) for m, s, w, r in targets if m == mix and w > 0 and r > 0}
        own = {p: t for p, t in patterns.items() if t > 0 and any(s in chosen for s in p)}
        there = {s for p in own for s in p}
        weights = {s: w for s, (w, _) in sorted(chosen.items()) if s in there}
        repeats = {s: chosen[s][1] for s in weights}
        if not weights:
            continue
        total = largest_total(own, weights, repeats) if total_tokens is None else total_tokens
        begins: dict[tuple[str, ...], int] = defaultdict(int)
        for (p, s), tokens in sorted(route(own, quotas_of(total, weights), repeats).items()):
            out.append((mix, "\x1f".join(p), s, begins[p], tokens, own[p]))
            begins[p] += tokens
    return out


def sized_documents(documents: DataFrame, vocabulary: str = TOKENIZERS) -> DataFrame:
    """``doc_id, pattern, n_tokens`` of every document that has a source and text; ``pattern``: the sorted sources that
    hold its text, joined by a unit separator.

    Documents without source or with empty text belong to no pattern and are left out.  Tokens are counted first, in one
    scan, so no text is shuffled: what is joined has a digest of 16 bytes.  The sets are combined before the shuffle
    and are never larger than the number of sources, whatever the number of copies.
    """
    named = documents.where(F.col("source").isNotNull() & (F.length("text") > 0))
    counted = cut(count_tokens(named.select("doc_id", "source", F.unhex(F.md5(F.col("text").cast("binary"))).alias("_md5"), "text"), "doc_id", "source", "_md5", vocabulary=vocabulary))
    sets = counted.groupBy("_md5").agg(F.array_join(F.array_sort(F.collect_set("source")), "\x1f").alias("pattern"))
    return counted.join(sets, "_md5").select("doc_id", "pattern", "n_tokens")


def mix_sources(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``(mix, source, doc_id, n_tokens, copies)`` of the documents that each source gives to each mix.

    ``sized`` has ``doc_id, pattern, n_tokens``.  ``targets`` has ``mix, source, weight, max_repeats``; weights are
    relative, rows with a null, a weight or repeats not above 0 ask for nothing, a source listed twice in a mix
    counts once (its largest row), and a source without documents leaves its weight to the others.  Without
    ``total_tokens`` a mix is as large as it can be with every share exact.  A document is never repeated for a
    source more than ``max_repeats`` times.
    """
    spark = sized.sparkSession
    sized = cut(sized)
    found = sized.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources")
    patterns = {tuple(r["pattern"].split("\x1f")): int(r["tokens"]) for r in sorted(found, key=lambda r: r["pattern"])}
    wanted = targets.where("weight > 0 and max_repeats > 0 and source is not null and mix is not null").groupBy("mix", "source")
    asked = [tuple(r) for r in wanted.agg(F.max("weight"), F.max("max_repeats")).collect()]
    rows = allot(patterns, asked, total_tokens)
    plan = spark.createDataFrame(rows, ALLOT)
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_ROWS else plan
    order = F.struct(F.xxhash64("doc_id", F.lit(seed)).alias("h"), F.col("doc_id"))
    unique = sized.groupBy("pattern", "doc_id").agg(F.max("n_tokens").alias("n_tokens")).withColumn("_at", order)
    tape = bucketed(unique, ["pattern"], "_at", target_rows).running_total("n_tokens", "upto", "_all").df
    first = F.col("upto") - F.col("n_tokens")
    turn = lambda at: F.ceil((at - first) / F.col("pattern_tokens"))
    copies = (turn(F.col("begins") + F.col("tokens")) - turn(F.col("begins"))).cast("int")
    return (
        tape.join(plan, "pattern")
        .select("mix", "source", "doc_id", "n_tokens", copies.alias("copies"))
        .where("copies > 0")
    )


def _frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ALLOT)


def share_report(picked: DataFrame, targets: DataFrame, sized: DataFrame) -> DataFrame:
    """Per mix and source: share asked for, documents, copies, tokens and the share reached (0 without documents), and
    the tokens there are (``available_tokens``, each as often as it may be repeated), so that what a mix leaves shows."""
    got = picked.groupBy("mix", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens")
    )
    whole = targets.groupBy("mix").agg(F.sum("weight").alias("_w"))
    mixed = got.groupBy("mix").agg(F.sum("n_tokens").alias("_t"))
    there = sized.groupBy("pattern").agg(F.sum("n_tokens").alias("_n")).select(F.explode(F.split("pattern", "\x1f")).alias("source"), "_n").groupBy("source").agg(F.sum("_n").alias("_n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        targets.join(whole, "mix").join(got, ["mix", "source"], "left").join(mixed, "mix", "left").join(there, "source", "left")
        .select(
            "mix", "source", (F.col("weight") / F.col("_w")).alias("target_share"), "max_repeats",
            zero("n_docs"), zero("n_copies"), zero("most_copies"), zero("n_tokens"),
            F.coalesce(F.col("n_tokens") / F.col("_t"), F.lit(0.0)).alias("reached_share"),
            F.coalesce(F.col("_n") * F.col("max_repeats"), F.lit(0)).cast("long").alias("available_tokens"),
        )
    )

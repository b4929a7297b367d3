"""Filling containers of fixed capacity with texts (problem 8): vector best-fit."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import materialise

#: Pieces that one task packs by itself.
PACKER_ITEMS = 20_000
#: Containers filled less than this are opened again in the next round, where their pieces meet those of other packers.
CLOSED_AT = 0.985

_PACKED = "doc_id bigint, piece int, text_start bigint, n_tokens int, packer int, bin int, place int, start int, fill double"


class VectorBestFit:
    """Containers with three residual capacities: tokens, documents and attention cost (sum of squared lengths).

    A piece goes to the container whose residual vector, after taking it, has the
    least weighted norm among all those where every residual stays non-negative.
    Containers lie by tokens left, documents left and, in order, attention left: of equal
    tokens and documents the least sufficient attention is best, and no container
    whose token term alone reaches the best norm can be better, so the search is exact.
    A piece that exceeds the attention capacity by itself gets a container of its own.
    """

    def __init__(self, capacity: int, max_docs: int, max_attention: float, weights=(1.0, 0.05, 0.05)):
        self.full = (capacity, max_docs, max_attention)
        self.w = [w / f**2 for w, f in zip(weights, self.full, strict=True)]
        self.left: list[list[float]] = []
        self.levels: list[dict[int, list[tuple[float, int]]]] = [{} for _ in range(capacity + 1)]
        self.mask = 0

    def _leave(self, b: int) -> None:
        t, d, a = self.left[b]
        same = self.levels[t][d]
        del same[bisect_left(same, (a, b))]
        if not same:
            del self.levels[t][d]
            if not self.levels[t]:
                self.mask &= ~(1 << t)

    def _join(self, b: int) -> None:
        t, d, a = self.left[b]
        if d > 0:
            self.mask |= 1 << t
            insort(self.levels[t].setdefault(d, []), (a, b))

    def _best(self, size: int, cost: float) -> int:
        best, norm = -1, None
        rest, level = self.mask >> size, size
        w0, w1, w2 = self.w
        while rest:
            step = (rest & -rest).bit_length() - 1
            level += step
            tokens = w0 * (level - size) ** 2
            if norm is not None and tokens >= norm:
                break
            for d, same in self.levels[level].items():
                n = tokens + w1 * (d - 1) ** 2
                if norm is not None and n >= norm:
                    continue
                k = bisect_left(same, (cost, -1))
                if k < len(same):
                    n += w2 * (same[k][0] - cost) ** 2
                    if norm is None or n < norm:
                        best, norm = same[k][1], n
            rest >>= step + 1
            level += 1
        return best

    def put(self, size: int) -> int:
        if size > self.full[0]:
            raise ValueError(f"a piece of {size} tokens fits no container")
        cost = float(size) * size
        b = self._best(size, cost)
        if b < 0:
            self.left.append(list(self.full))
            b = len(self.left) - 1
        else:
            self._leave(b)
        t, d, a = self.left[b]
        self.left[b] = [t - size, d - 1, max(a - cost, 0.0) if cost <= self.full[2] else -1.0]
        if self.left[b][2] >= 0:
            self._join(b)
        return b


def _pack_group(capacity: int, max_docs: int, max_attention: float):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        fit, bins, places, starts = VectorBestFit(capacity, max_docs, max_attention), [], [], []
        for size in items["n_tokens"].tolist():
            b = fit.put(int(size))
            t, d, _ = fit.left[b]
            bins.append(b)
            places.append(max_docs - d - 1)
            starts.append(capacity - t - int(size))
        items = items.assign(bin=bins, place=places, start=starts)
        items["fill"] = [(capacity - fit.left[b][0]) / capacity for b in bins]
        return items[["doc_id", "piece", "text_start", "n_tokens", "packer", "bin", "place", "start", "fill"]]

    return run


def pack(sizes: DataFrame, capacity: int = 2048, max_docs: int = 64, max_attention: float | None = None, packer_items: int = PACKER_ITEMS) -> DataFrame:
    """(doc_id, piece, text_start, n_tokens, container, place, start) of every text in ``sizes`` (doc_id, n_tokens).

    A text longer than ``capacity`` is cut into pieces of ``capacity`` tokens and a
    rest, each with its ``text_start``; no other text is split. ``place`` counts the
    pieces of a container from 0, ``start`` is the first token's position in it.
    ``max_attention`` bounds the sum of squared piece lengths of a container of several pieces. Its
    default is ``capacity`` squared, which is also the least bound under which no text
    has to be split or left alone with room; the squares of pieces that share a container can't exceed
    it, so by default it chooses among containers but excludes none. Texts without tokens (null sizes count as 0) take
    a place but no room. Repeated rows are packed once each; an empty table gives no rows.

    Pieces are spread by hash over packers of about ``packer_items``. Containers
    left less than full are opened again and their pieces packed once more with
    those of the other packers, in rounds, until one packer holds the rest or a
    round needs no fewer containers for what it got than there were.
    """
    limit = float(capacity) ** 2 if max_attention is None else float(max_attention)
    piece_max = capacity
    n = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("bigint")
    cut = F.when(n > piece_max, F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / piece_max))).otherwise(F.array(F.lit(0).cast("bigint")))
    items = sizes.select("doc_id", n.alias("_n"), F.explode(cut).alias("_k")).select(
        "doc_id", F.col("_k").cast("int").alias("piece"), (F.col("_k") * piece_max).alias("text_start"), F.least(F.col("_n") - F.col("_k") * piece_max, F.lit(piece_max)).cast("int").alias("n_tokens")
    )
    rest, out, round_no = materialise(items, "pieces"), None, 0
    left, before = rest.count(), None
    while True:
        packers = max(1, -(-left // packer_items))
        spread = rest.withColumn("packer", F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_no)), F.lit(packers)).cast("int"))
        packed = materialise(spread.groupBy("packer").applyInPandas(_pack_group(capacity, max_docs, limit), _PACKED), "packed")
        named = packed.withColumn("container", F.format_string("%d-%d-%d", F.lit(round_no), "packer", "bin"))
        open_ = packed.where(F.col("fill") < CLOSED_AT)
        firsts = F.col("place") == 0  # one a container
        used, again, still = packed.agg(F.count_if(firsts), F.count_if(F.col("fill") < CLOSED_AT), F.count_if(firsts & (F.col("fill") < CLOSED_AT))).first()
        final = packers == 1 or again == 0 or (before is not None and used >= before)
        done = named if final else named.where(F.col("fill") >= CLOSED_AT)
        out = done if out is None else out.unionAll(done)
        if final:
            return out.select("doc_id", "piece", "text_start", "n_tokens", "container", "place", "start")
        rest, left, before, round_no = open_.select("doc_id", "piece", "text_start", "n_tokens"), again, still, round_no + 1


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, pieces, tokens, the mean share of a container that is filled, and the least possible number."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("k").alias("pieces"), F.sum("t").alias("tokens"),
        (F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("fill"), F.ceil(F.sum("t") / capacity).alias("least_containers"), F.max("t").alias("largest"),
    )

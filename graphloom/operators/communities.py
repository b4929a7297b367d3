"""Communities of each project's graph and their names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def louvain(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Label of each of n vertices for undirected weighted edges: greedy modularity moves, then merging, until neither helps."""
    w = np.ones(len(a))
    label = np.arange(n)
    while True:
        m2 = 2 * w.sum()
        near: list[dict[int, float]] = [{} for _ in range(n)]
        deg = np.zeros(n)
        for x, y, v in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            deg[x] += v
            deg[y] += v
            if x != y:
                near[x][y] = near[x].get(y, 0) + v
                near[y][x] = near[y].get(x, 0) + v
        own, total, moved, any_move = np.arange(n), deg.copy(), True, False
        while moved:
            moved = False
            for x in range(n):
                links: dict[int, float] = {}
                for y, v in near[x].items():
                    links[own[y]] = links.get(own[y], 0) + v
                old = own[x]
                total[old] -= deg[x]
                best, gain = old, links.get(old, 0) - deg[x] * total[old] / m2
                for c, v in sorted(links.items()):
                    g = v - deg[x] * total[c] / m2
                    if g > gain + 1e-12:
                        best, gain = c, g
                total[best] += deg[x]
                if best != old:
                    own[x], moved, any_move = best, True, True
        _, own = np.unique(own, return_inverse=True)
        label = own[label]
        if not any_move:
            return label
        a, b = own[a], own[b]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        key, at = np.unique(lo.astype(np.int64) * (own.max() + 1) + hi, return_inverse=True)
        w = np.bincount(at, w)
        a, b, n = key // (own.max() + 1), key % (own.max() + 1), int(own.max()) + 1


def _area(ids: list[str], depth: int) -> tuple[str, float]:
    heads = pd.Series(["/".join(i.split("/")[:-1][:depth]) or i for i in ids]).value_counts()
    top = sorted(heads[heads == heads.max()].index)[0]
    return top, heads.max() / len(ids)


def _name(groups: dict[int, list[str]]) -> dict[int, str]:
    """The directory that holds half of a community, deeper where two would share a name, else ``mixed``; then numbered."""
    out: dict[int, str] = {}
    for g in sorted(groups):
        options = [a for d in range(2, 6) for a, share in [_area(groups[g], d)] if share >= 0.5] or ["mixed"]
        name = next((o for o in options if o not in out.values()), options[0])
        base, k = name, 2
        while name in out.values():
            name, k = f"{base} ({k})", k + 1
        out[g] = name
    return out


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, id, community, name): Louvain groups ranked by size, then first member; files without an edge are -1, ``unconnected``.

    Each project's graph is one group of one task: the algorithm is sequential
    there, so this operator holds for projects whose edges fit a worker.
    """
    pairs = edges.where(F.col("source") != F.col("target")).select("project", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(g["a"]) | set(g["b"]))
        at = {v: k for k, v in enumerate(ids)}
        g = g.sort_values(["a", "b"])
        label = louvain(g["a"].map(at).to_numpy(), g["b"].map(at).to_numpy(), len(ids))
        groups: dict[int, list[str]] = {}
        for i, c in zip(ids, label, strict=True):
            groups.setdefault(int(c), []).append(i)
        ranked = dict(enumerate(sorted(groups.values(), key=lambda m: (-len(m), m[0]))))
        names = _name(ranked)
        return pd.DataFrame([(g["project"].iloc[0], i, c, names[c]) for c, m in ranked.items() for i in m], columns=["project", "id", "community", "name"])

    found = pairs.groupBy("project").applyInPandas(run, "project string, id string, community int, name string")
    return nodes.select("project", "id").join(found, ["project", "id"], "left").select("project", "id", F.coalesce("community", F.lit(-1)).alias("community"), F.coalesce("name", F.lit("unconnected")).alias("name"))

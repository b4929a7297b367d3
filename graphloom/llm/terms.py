"""Package names of files: term frequency (problem 2) and co-occurrence (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import materialise
from graphloom.sources.tables import latest

#: Outer white space as Python's ``str.strip`` has it.
_WS = r"[\p{IsWhite_Space}\x1c-\x1f]+"


def clean_name(name: Column) -> Column:
    """Lower case without outer white space; null and blank names become null."""
    return F.nullif(F.lower(F.regexp_replace(name, f"^{_WS}|{_WS}$", "")), F.lit(""))


def records(nodes: DataFrame) -> DataFrame:
    """(project, id, external_deps) of the latest ``scanned_at`` of each file; ties go to the latest ``loaded_at``."""
    return latest(nodes, ["project", "id"], ["external_deps"], ["scanned_at", "loaded_at"])


def term_counts(nodes: DataFrame, rare_below: int = 3, common_percent: float = 5.0) -> DataFrame:
    """(name, occurrences, n_records, share, is_rare, is_common) for every distinct package name.

    ``occurrences`` counts a name as often as records hold it, ``n_records`` the
    records that hold it, ``share`` is its part of the records that have at
    least one name. A name is rare in fewer than ``rare_below`` records and
    common in more than ``common_percent`` % of those records; in a tiny
    collection both can hold. Null, empty and blank names and null lists count
    for nothing; an empty table gives no rows.

    Term counts per record need no shuffle of their own, as the rows already lie
    by (project, id). Names are then combined by hash in every input partition,
    so a name held by a third of all records arrives as one row per partition.
    A record with names also emits one null: their number comes out of the same pass.
    """
    own = F.array_compact(F.transform("external_deps", clean_name))
    per_record = (
        records(nodes)
        .select("project", "id", own.alias("names"))
        .where(F.size("names") > 0)
        .select("project", "id", F.explode(F.concat("names", F.array(F.lit(None).cast("string")))).alias("name"))
        .groupBy("project", "id", "name")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    counts = materialise(per_record.groupBy("name").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("n_records")), "terms")
    n = counts.where(F.col("name").isNull()).agg(F.max("n_records")).scalar()
    return counts.where(F.col("name").isNotNull()).select(
        "name", "occurrences", "n_records", (F.col("n_records") / n).alias("share"),
        (F.col("n_records") < rare_below).alias("is_rare"), (F.col("n_records") * 100 > n * common_percent).alias("is_common"),
    )


def marked_terms(nodes: DataFrame, rare_below: int = 3, common_percent: float = 5.0) -> DataFrame:
    """(name, mark) of the names outside the bounds; a name that is both has two rows."""
    t = term_counts(nodes, rare_below, common_percent)
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), "rare"), F.when(F.col("is_common"), "common")))
    return t.select("name", F.explode(marks).alias("mark"))


# --- co-occurrence ---------------------------------------------------------------------------------

#: Log-likelihood ratio from which a pair is no chance: chi square of one degree of freedom at 0.1 %.
LLR_SIGNIFICANT = 10.828
_STRIPE = "a int, part int, neighbours array<int>, counts array<bigint>"


def _count_stripes(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sum n over equal (a, b); gives each a with its sorted neighbours."""
    key = (a.astype(np.int64) << 32) | b
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n, starts) if len(key) else n
    key = key[starts]
    first, second = key >> 32, key & 0xFFFFFFFF
    cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(key) else []
    for i, j in zip(cuts, [*cuts[1:], len(key)], strict=True):
        yield int(first[i]), second[i:j].astype(np.int32), sums[i:j]


#: Neighbour entries that a worker gathers before it combines and sends them.
STRIPE_ENTRIES = 4_000_000


def _stripes_of_batches(parts: int, entries: int):
    def emit(a, b):
        rows = [(x, int(hash(x * 2654435761 + int(nb[0]))) % parts, nb, c) for x, nb, c in _count_stripes(np.concatenate(a), np.concatenate(b), np.ones(sum(map(len, a)), np.int64))]
        return pd.DataFrame(rows, columns=["a", "part", "neighbours", "counts"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, held = [], [], 0
        for batch in batches:
            for items in batch["items"]:
                items = np.asarray(items, np.int32)
                for i in range(len(items) - 1):  # the stripe of item i: all later items of the record
                    a.append(np.full(len(items) - 1 - i, items[i], np.int32))
                    b.append(items[i + 1 :])
                    held += len(items) - 1 - i
                    if held >= entries:
                        yield emit(a, b)
                        a, b, held = [], [], 0
        if held:
            yield emit(a, b)

    return run


def _merge_stripes(group: pd.DataFrame) -> pd.DataFrame:
    """One merged stripe out of those of a key."""
    a, part = int(group["a"].iloc[0]), int(group["part"].iloc[0])
    nb = np.concatenate([np.asarray(x, np.int64) for x in group["neighbours"]])
    ct = np.concatenate([np.asarray(x, np.int64) for x in group["counts"]])
    rows = [(x, part, n, c) for x, n, c in _count_stripes(np.full(len(nb), a, np.int64), nb, ct)]
    return pd.DataFrame(rows, columns=["a", "part", "neighbours", "counts"])


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def _numbered(names: DataFrame) -> DataFrame:
    """(item, name, k): names numbered from 0 by code points, over sorted ranges; the driver sees a count per range."""
    ranges = materialise(names.orderBy("name").withColumn("_m", F.monotonically_increasing_id()), "ranges")
    part, row = F.shiftright("_m", 33).cast("int"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, {}
    for r in sorted(ranges.groupBy(part.alias("part")).count().collect()):
        starts[r["part"]], before = before, before + r["count"]
    start = F.array(*[F.lit(starts.get(p, 0)) for p in range(max(starts, default=0) + 1)])
    return materialise(ranges.select((start[part] + row).cast("int").alias("item"), "name", "k"), "names")


def co_occurrence(nodes: DataFrame, min_joint: int = 5, min_share: int | None = 2000, min_lift: float = 30.0, parts: int = 16, min_llr: float | None = LLR_SIGNIFICANT) -> DataFrame:
    """(name_a, name_b, k_a, k_b, k_ab, n, lift, llr) for the pairs of names that share enough records.

    A pair comes out where k_ab >= ``min_joint``, ``min_share`` * k_ab >= n and
    k_ab * n >= ``min_lift`` * k_a * k_b (``min_share`` None: no such bound; with
    ``min_joint`` 1 and ``min_lift`` 0 every pair that occurs comes out); n counts the records with at least one
    name, ``llr`` is Dunning's log-likelihood ratio of the 2 x 2 table; pairs below
    ``min_llr`` are left out as chance (None: none are). Under the default bounds
    no case is: five joint records at thirty times chance have a ratio above 20. The
    smaller name (by code points) comes first. Nulls, blanks and repeats within a
    record count for nothing, an empty table gives no rows.

    Stripes: each record adds to every item the array of its later items; a
    worker sums stripes of many records before it sends them, they are merged by
    (item, part), then by item. Two exact prunings follow from the bounds, so no
    case is lost: k_ab cannot exceed k_a or k_b, hence both must reach the joint
    minimum; and k_ab <= min(k_a, k_b) gives max(k_a, k_b) * min_lift <= n, so the
    hottest names drop out before any pair is made. The first leaves at most
    min_share names per average list length, whatever the size of the collection,
    and every name where there are no bounds.
    """
    named = (
        records(nodes)
        .select("project", "id", F.array_distinct(F.array_compact(F.transform("external_deps", clean_name))).alias("names"))
        .where(F.size("names") > 0)
    )
    named = materialise(named, "named")
    n = named.count()
    counts = named.select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    often = lambda c: (c >= min_joint) & (F.lit(True) if min_share is None else c * min_share >= n)
    names = _numbered(counts.where(often(F.col("k")) & (F.col("k") * F.lit(float(min_lift)) <= n)))
    baskets = (
        named.withColumn("_r", F.monotonically_increasing_id())
        .select("_r", F.explode("names").alias("name"))
        .join(names.select("item", "name"), "name")
        .groupBy("_r")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
        .where(F.size("items") > 1)
        .select("items")
    )
    stripes = baskets.mapInPandas(_stripes_of_batches(parts, STRIPE_ENTRIES), _STRIPE)
    merged = stripes.groupBy("a", "part").applyInPandas(_merge_stripes, _STRIPE)
    whole = merged.withColumn("part", F.lit(0)).groupBy("a", "part").applyInPandas(_merge_stripes, _STRIPE)
    pairs = whole.select("a", F.explode(F.arrays_zip("neighbours", "counts")).alias("x")).select("a", F.col("x.neighbours").alias("b"), F.col("x.counts").alias("k_ab"))
    pairs = pairs.where(often(F.col("k_ab")))
    a, b = names.select(F.col("item").alias("a"), F.col("name").alias("name_a"), F.col("k").alias("k_a")), names.select(F.col("item").alias("b"), F.col("name").alias("name_b"), F.col("k").alias("k_b"))
    pairs = pairs.join(a, "a").join(b, "b").where(F.col("k_ab") * n >= F.lit(float(min_lift)) * F.col("k_a") * F.col("k_b"))
    k, ka, kb, t = (F.col(c).cast("double") for c in ("k_ab", "k_a", "k_b", "n"))
    h = lambda *xs: sum((_xlogx(x) for x in xs[1:]), _xlogx(xs[0]))
    llr = 2 * (h(k, ka - k, kb - k, t - ka - kb + k) - h(ka, t - ka) - h(kb, t - kb) + _xlogx(t))
    pairs = pairs.withColumn("n", F.lit(n).cast("bigint")).withColumn("llr", llr)
    if min_llr is not None:
        pairs = pairs.where(F.col("llr") >= min_llr)
    return pairs.select("name_a", "name_b", "k_a", "k_b", "k_ab", "n", (k * t / (ka * kb)).alias("lift"), "llr")

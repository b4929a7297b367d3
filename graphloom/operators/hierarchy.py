"""Parent-child links to hierarchies by leaf peeling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import dir_name, plain
from graphloom.plans.shared import materialise
from graphloom.sources.tables import latest

#: Rows of one project that one task peels by itself; larger projects are cut into blocks of about this size.
BLOCK_ROWS = 200_000

PEELED, PENDING, MESSAGE = 0, 1, 2


def module_links(edges: DataFrame) -> DataFrame:
    """(project, id, parent): of the ``module`` rows with the file as target, the source of the latest ``scanned_at``.

    A null source means no parent; rows with null target are dropped. Ties in
    ``scanned_at`` go to the latest ``loaded_at``, then to the greatest source.
    """
    rows = edges.where(F.col("kind") == "module").select(
        "project", plain(F.col("target")).alias("id"), plain(F.col("source")).alias("parent"), "scanned_at", "loaded_at"
    )
    return latest(rows.where(F.col("id").isNotNull()), ["project", "id"], ["parent"], ["scanned_at", "loaded_at"])


def _nodes(links: DataFrame, block_rows: int) -> DataFrame:
    """Every file that is child or parent, with its parent, its number of children and its block.

    A project of more than ``block_rows`` links is cut into blocks by folder, so that most parents
    lie in their children's block; the files of a folder that would fill a quarter of a
    block are spread by their own hash.
    """
    ends = links.select("project", "id", "parent", F.lit(0).alias("kids")).unionAll(
        links.where(F.col("parent").isNotNull()).select("project", F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("kids"))
    )
    nodes = ends.groupBy("project", "id").agg(F.max("parent").alias("parent"), F.sum("kids").alias("kids")).withColumn("_dir", dir_name(F.col("id")))
    sizes = links.groupBy("project").agg((F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("_blocks")).withColumnRenamed("project", "_p")
    crowded = links.groupBy("project", dir_name(F.col("id")).alias("dir")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * 4 > block_rows).select(F.col("project").alias("_q"), F.col("dir").alias("_d"))
    placed = nodes.join(sizes, F.col("project").eqNullSafe(F.col("_p"))).join(crowded, F.col("project").eqNullSafe(F.col("_q")) & (F.col("_dir") == F.col("_d")), "left")
    return placed.select("project", F.pmod(F.hash(F.when(F.col("_d").isNull(), F.col("_dir")).otherwise(F.col("id"))), F.col("_blocks")).alias("block"), "id", "parent", "kids")


_PEEL = "project string, block int, id string, parent string, kids bigint, size bigint, descendants array<string>, step int, place int, kind int"


def _peel_block(round_no: int, lists: bool):
    def peel(block: pd.DataFrame) -> pd.DataFrame:
        ids = block["id"].tolist()
        parents = [p if isinstance(p, str) else None for p in block["parent"].tolist()]
        kids = [int(k) for k in block["kids"].tolist()]
        size = [int(s) for s in block["size"].tolist()]
        below = [list(d) if d is not None else [] for d in block["descendants"].tolist()] if lists else None
        at = {v: k for k, v in enumerate(ids)}
        out: dict[str, list] = {}
        peeled: list[int] = []
        ready = [k for k, n in enumerate(kids) if n == 0]
        while ready:
            following: list[int] = []
            for k in ready:
                peeled.append(k)
                p = parents[k]
                if p is None:
                    continue
                j = at.get(p)
                if j is None:
                    m = out.setdefault(p, [0, 0, []])
                    m[0] += 1
                    m[1] += size[k] + 1
                    if lists:
                        m[2].extend(below[k])
                        m[2].append(ids[k])
                    continue
                kids[j] -= 1
                size[j] += size[k] + 1
                if lists:
                    below[j].extend(below[k])
                    below[j].append(ids[k])
                if kids[j] == 0:
                    following.append(j)
            ready = following
        place = {k: n for n, k in enumerate(peeled)}
        rows = [(ids[k], parents[k], kids[k], size[k], sorted(below[k]) if lists and k in place else (below[k] if lists else None), place.get(k, -1), PEELED if k in place else PENDING) for k in range(len(ids))]
        rows += [(p, None, n, s, d if lists else None, -1, MESSAGE) for p, (n, s, d) in out.items()]
        made = pd.DataFrame(rows, columns=["id", "parent", "kids", "size", "descendants", "place", "kind"])
        made["project"], made["block"], made["step"] = block["project"].iloc[0], block["block"].iloc[0], round_no
        return made[["project", "block", "id", "parent", "kids", "size", "descendants", "step", "place", "kind"]]

    return peel


def peel(links: DataFrame, lists: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Bottom-up leaf peeling of (project, id, parent).

    Gives (project, block, id, parent, size, descendants, step, place, peeled): ``size`` is the number
    of descendants, ``descendants`` their sorted ids (null unless ``lists``); a file was peeled in
    round ``step`` as number ``place`` of its block.
    As each file has at most one parent, the files that are never peeled are
    exactly those on a cycle.

    Each round peels every block to its local fixpoint and sends the counts,
    sizes and lists of the peeled files to parents in other blocks. A project of
    up to ``block_rows`` links is one block and ends in the first round; the
    blocks of a larger one go through as many rounds as its tree changes blocks.
    No group is larger than a block, whatever share of the links a project holds.
    """
    state = _nodes(links, block_rows).withColumns({"size": F.lit(0).cast("bigint"), "descendants": F.lit(None).cast("array<string>")})
    parts, round_no = [], 0
    while True:
        done = materialise(state.groupBy("project", "block").applyInPandas(_peel_block(round_no, lists), _PEEL), "peel")
        parts.append(done.where(F.col("kind") == PEELED))
        pending, sent = done.where(F.col("kind") == PENDING), done.where(F.col("kind") == MESSAGE)
        if sent.isEmpty():
            parts.append(pending)
            break
        come = sent.groupBy("project", "id").agg(
            F.sum("kids").alias("_kids"), F.sum("size").alias("_size"), F.flatten(F.collect_list("descendants")).alias("_below")
        ).withColumnsRenamed({"project": "_p", "id": "_i"})
        state = pending.join(come, F.col("project").eqNullSafe(F.col("_p")) & (F.col("id") == F.col("_i")), "left").select(
            "project", "block", "id", "parent", (F.col("kids") - F.coalesce("_kids", F.lit(0))).alias("kids"), (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"),
            (F.concat(F.coalesce("descendants", F.array().cast("array<string>")), F.coalesce("_below", F.array().cast("array<string>"))) if lists else F.col("descendants")).alias("descendants"),
        )
        round_no += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("project", "block", "id", "parent", "size", "descendants", "step", "place", (F.col("kind") == PEELED).alias("peeled"))


_PATHS = "project string, id string, path array<string>"


def _assign_block(block: pd.DataFrame) -> pd.DataFrame:
    """Paths in reverse peel order: a parent was peeled after its children, so its path is known before theirs."""
    block = block.sort_values("place", ascending=False)
    path: dict[str, list] = {}
    for i, p, given in zip(block["id"], block["parent"], block["given"], strict=True):
        above = path.get(p) if isinstance(p, str) else []
        if above is None and given is not None:
            above = list(given)
        if above is not None:
            path[i] = [*above, i]
    return pd.DataFrame({"project": block["project"], "id": block["id"], "path": [path.get(i) for i in block["id"]]})


def hierarchy(links: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(project, id, parent, root, depth, path, n_descendants, descendants, state) for each file of ``links``.

    ``path`` joins the ids from the root down with `` > ``; a root has depth 0.
    ``state`` is ``tree``, ``cycle`` (the file lies on a cycle; its own parent
    included) or ``below_cycle``; the two last have null root, depth and path,
    and a file on a cycle null descendants. Null parents make roots, equal rows
    count once, an empty table gives no rows.

    Paths and depths are assigned in reverse peel order: the rounds of the peeling from the
    last to the first, and within a round each block from its last file. A parent in
    another block was peeled in a later round than its child, so one join per round brings its path.
    """
    peeled = materialise(peel(links, True, block_rows), "peeled")
    last = peeled.where("peeled").agg(F.max("step")).first()[0]
    known = None
    for step in range(-1 if last is None else last, -1, -1):
        own = peeled.where(F.col("peeled") & (F.col("step") == step)).select("project", "block", "id", "parent", "place")
        if known is None:
            own = own.withColumn("given", F.lit(None).cast("array<string>"))
        else:
            up = known.select(F.col("project").alias("_p"), F.col("id").alias("_i"), F.col("path").alias("given"))
            own = own.join(up, F.col("project").eqNullSafe(F.col("_p")) & (F.col("parent") == F.col("_i")), "left").drop("_p", "_i")
        done = materialise(own.groupBy("project", "block").applyInPandas(_assign_block, _PATHS).where(F.col("path").isNotNull()), "paths")
        known = done if known is None else known.unionAll(done)
    if known is None:
        known = peeled.select("project", "id", F.lit(None).cast("array<string>").alias("path")).limit(0)
    paths = known.select(F.col("project").alias("_p"), F.col("id").alias("_i"), F.col("path").alias("_path"))
    return peeled.join(paths, F.col("project").eqNullSafe(F.col("_p")) & (F.col("id") == F.col("_i")), "left").select(
        "project", "id", "parent", F.col("_path")[0].alias("root"), F.when(F.col("_path").isNotNull(), F.size("_path") - 1).cast("bigint").alias("depth"),
        F.array_join("_path", " > ").alias("path"), F.when(F.col("peeled"), F.col("size")).alias("n_descendants"), F.when(F.col("peeled"), F.coalesce("descendants", F.array().cast("array<string>"))).alias("descendants"),
        F.when(~F.col("peeled"), "cycle").when(F.col("_path").isNull(), "below_cycle").otherwise("tree").alias("state"),
    )


def on_cycles(links: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(project, id) of the files that lie on a cycle of parents: what leaf peeling leaves over."""
    return peel(links, False, block_rows).where(~F.col("peeled")).select("project", "id")

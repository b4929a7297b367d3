"""Source files that do not parse (problem 1): tokens as rows, adjacent pairs, nesting, productions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import extension, plain
from graphloom.llm.grammar import GRAMMARS
from graphloom.llm.lex import LEXERS, token_pairs
from graphloom.llm.machine import EOF, INLINE, name
from graphloom.plans.shared import materialise
from graphloom.sources.tables import latest

def decoded(content: Column) -> Column:
    """UTF-8 with or without BOM, else Latin-1; line breaks as ``\\n``."""
    as_utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")


def languages(tree: DataFrame, nodes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(file, project, path, lang, content) of the files to judge; ``file`` numbers the rows of ``tree``.

    Rows of ``tree`` that nothing excludes, with content and an extension of a
    language with status ``analysed``. The language is that of the newest row in
    ``nodes``, else the catalogue's. Only nodes that differ from the catalogue
    are joined; the contents, by far the largest column, are not shuffled unless those are many.
    """
    known = catalogue.where(F.col("status") == "analysed").select(F.lower("extension").alias("_ext"), F.col("lang").alias("_lang")).dropDuplicates(["_ext"])
    known = F.broadcast(known)  # one row per known extension: fixed by the catalogue, not by the data
    other = latest(nodes, ["project", "id"], ["path", "lang"], ["scanned_at", "loaded_at"])
    other = other.select(F.col("project").alias("_p"), plain(F.coalesce("path", "id")).alias("_f"), "lang", extension(F.coalesce("path", "id")).alias("_ext"))
    other = materialise(other.join(known, "_ext").where(F.col("lang") != F.col("_lang")).groupBy("_p", "_f").agg(F.max("lang").alias("_own")), "other-langs")
    files = (
        tree.where(F.col("excluded_by").isNull() & F.col("content").isNotNull())
        .select(F.monotonically_increasing_id().alias("file"), "project", F.col("path"), "content", extension(F.col("path")).alias("_ext"))
        .join(known, "_ext")
        .join(other, F.col("project").eqNullSafe(F.col("_p")) & (plain(F.col("path")) == F.col("_f")), "left")
    )
    return files.select("file", "project", "path", F.coalesce("_own", "_lang").alias("lang"), "content")


def permissible(spark: SparkSession) -> DataFrame:
    """(lang, pair) of all languages, derived from the first and last tokens of the grammars' rules. Its size is fixed by the grammars (some 50,000 rows)."""
    rows = sorted((lang, a + b) for lang, g in GRAMMARS.items() for a, b in g.pairs())
    return spark.createDataFrame(pd.DataFrame(rows, columns=["lang", "pair"]), "lang string, pair string")


_ROUND, _SQUARE, _CURLY = (re.compile(p) for p in (r"\(([^()\[\]{}]*+)\)", r"\[([^()\[\]{}]*+)\]", r"\{([^()\[\]{}]*+)\}"))


def _inner_groups_marked(cls: str) -> str:
    """Brackets of groups without groups become marks, so that they need no row of their own."""
    for pattern, o, c in ((_ROUND, "(", ")"), (_SQUARE, "[", "]"), (_CURLY, "{", "}")):
        cls = pattern.sub(rf"{INLINE[o]}\1{INLINE[c]}", cls)
    return cls


def _splitter(lang: str):
    g = GRAMMARS[lang]
    turn = {c: 1 for c in g.closers} | {c: -1 for c in g.closers.values()}
    return re.compile("([" + re.escape("".join(turn)) + "])"), turn


_SPLIT = {lang: _splitter(lang) for lang in GRAMMARS}
_WORDY = {lang for lang, g in GRAMMARS.items() if any(len(name(c)) > 1 for c in g.closers)}


def token_rows(lang: str, text: str) -> tuple[list[str], list[int], list[str]]:
    """Runs of tokens, each up to a bracket; how that bracket changes the depth; distinct adjacent pairs."""
    cls = LEXERS[lang](text)
    pairs = token_pairs(cls)
    split, turn = _SPLIT[lang]
    if lang not in _WORDY:
        cls = _inner_groups_marked(cls)
    parts = split.split(cls)
    parts.append(EOF)
    runs = [parts[k] + parts[k + 1] for k in range(0, len(parts), 2)]
    return runs, [turn.get(r[-1], 0) for r in runs], pairs


_LEXED = "file bigint, project string, path string, lang string, runs array<string>, turns array<int>, pairs array<string>"


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs, turns, pairs = [], [], []
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            r, t, p = token_rows(lang, text)
            runs.append(r)
            turns.append(t)
            pairs.append(p)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("file", "project", "path", "lang")), pa.array(runs, pa.list_(pa.string())), pa.array(turns, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.string()))], ["file", "project", "path", "lang", "runs", "turns", "pairs"])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, faults = [], []
        for k, (lang, text, even, pairs) in enumerate(zip(*(b.column(c).to_pylist() for c in ("lang", "text", "even", "pairs")))):
            found = [f"pair: {name(p[0])} {name(p[1])}" for p in pairs or ()]
            fault = GRAMMARS[lang].judge(text) if even else "nesting"
            if fault:
                found.append(fault)
            if found:
                keep.append(k)
                faults.append(sorted(found))
        b = b.take(pa.array(keep, pa.int32()))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("project", "path", "lang")), pa.array(faults, pa.list_(pa.string()))], ["project", "path", "lang", "faults"])


def faulty(files: DataFrame) -> DataFrame:
    """(project, path, lang, faults) of the files (file, project, path, lang, content) with a fault; ``file`` is unique.

    Every file is lexed where it lies into rows: a row holds the tokens up to the next
    bracket, and further rows hold its distinct adjacent pairs. An anti-join with the
    permissible pairs leaves the others. Windows over the token rows of a file give each its depth
    and, per depth, the number of its group; the groups come together outer levels first, and
    are reduced from the inside out: a group becomes a symbol for the productions that it satisfies.
    Only tokens are shuffled, one character each, and one file's rows meet in one task.
    """
    spark = files.sparkSession
    text = files.where(F.col("lang").isin(*GRAMMARS)).select("file", "project", "path", "lang", decoded(F.col("content")).alias("text"))
    lexed = text.where(F.rlike("text", F.lit(r"\S"))).mapInArrow(_lexed, _LEXED)
    none, pair = F.lit(None), "seq int, run string, turn int, pair string"
    as_row = lambda *c: F.struct(*c).cast(f"struct<{pair.replace(' ', ':').replace(',:', ',')}>")
    both = F.concat(
        F.transform(F.arrays_zip("runs", "turns"), lambda x, k: as_row(k, x["runs"], x["turns"], none)),
        F.transform("pairs", lambda p: as_row(none, none, none, p)),
    )
    rows = lexed.select("file", "lang", F.struct("project", "path").alias("of"), F.explode(both).alias("r")).select("file", "lang", F.when(F.col("r.seq") == 0, F.col("of")).alias("of"), "r.*")
    # size of the broadcast side: fixed by the grammars
    rows = rows.join(F.broadcast(permissible(spark)), ["lang", "pair"], "left_anti")
    before = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("depth", F.coalesce(F.sum("turn").over(before), F.lit(0)))
    earlier = Window.partitionBy("file", "depth").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("group", F.coalesce(F.sum(F.when(F.col("turn") < 0, 1)).over(earlier), F.lit(0)))
    ordered = F.sort_array(F.collect_list(F.when(F.col("seq").isNotNull(), F.struct("depth", "group", "seq", "run"))))
    whole = rows.groupBy("file").agg(
        F.max("lang").alias("lang"), F.max("of").alias("of"), F.array_join(F.transform(ordered, lambda x: x["run"]), "").alias("text"),
        ((F.min("depth") >= 0) & (F.coalesce(F.sum("turn"), F.lit(0)) == 0)).alias("even"), F.collect_set("pair").alias("pairs"),
    )
    return whole.select("of.project", "of.path", "lang", "text", "even", "pairs").mapInArrow(_judged, "project string, path string, lang string, faults array<string>")


def broken_files(tree: DataFrame, nodes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(project, path, lang, faults) of the files whose text is not valid syntax, one row per file.

    Files without content, excluded files and files of other extensions are not
    judged; empty and blank files and style sheets are valid. Repeated rows
    count once; a path with several contents is broken if one of them is. Null
    projects are kept, null paths have no extension and are not judged.
    """
    found = faulty(languages(tree, nodes, catalogue))
    return found.groupBy("project", "path", "lang").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("faults")))).alias("faults"))


def broken_rates(tree: DataFrame, nodes: DataFrame, catalogue: DataFrame, failures: DataFrame) -> DataFrame:
    """(project, lang, files, broken, rate, reported): judged files, invalid ones, and those of them that have a row in ``failures``.

    The newest row of a (project, path) in ``failures`` counts; its reason may be null.
    """
    files = languages(tree, nodes, catalogue).select("project", "path", "lang").distinct()
    broken = broken_files(tree, nodes, catalogue).select("project", "path", F.lit(1).alias("broken"))
    told = failures.select(F.col("project").alias("_p"), plain(F.col("path")).alias("_f")).distinct()
    b = broken.join(told, F.col("project").eqNullSafe(F.col("_p")) & (F.col("path") == F.col("_f")), "left").select(F.col("project").alias("_bp"), F.col("path").alias("_bf"), "broken", F.col("_f").isNotNull().cast("int").alias("told"))
    joined = files.join(b, F.col("project").eqNullSafe(F.col("_bp")) & (F.col("path") == F.col("_bf")), "left")
    n, k = F.count(F.lit(1)), F.coalesce(F.sum("broken"), F.lit(0))
    return joined.groupBy("project", "lang").agg(n.alias("files"), k.alias("broken"), (k / n).alias("rate"), F.coalesce(F.sum("told"), F.lit(0)).alias("reported"))

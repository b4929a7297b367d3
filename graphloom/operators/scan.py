"""From a table of files to the graph: extraction, ranked-candidate resolution, nodes, edges and diagnostics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import candidates as cand
from graphloom.functions.catalogue import classify_files
from graphloom.functions.frontends import FrontEnds
from graphloom.functions.paths import base_name, dir_name, loc
from graphloom.functions.specifiers import extract
from graphloom.plans.shared import materialise

CONFIG = r"(?:^|/)(?:tsconfig[^/]*\.json|package\.json|go\.mod|Cargo\.toml|composer\.json)$"
#: stands for a null project while projects are joined
NO_PROJECT = "\u0000"
_SPEC = "project string, path string, lang string, ordinal int, line int, raw string"


def prepare(tree: DataFrame, ends: FrontEnds | None = None) -> DataFrame:
    """Files with text, status and language. Text that is not UTF-8 fails; only files to read keep their text.

    ``ends`` decides which extensions are read; source of other languages stays unread.
    """
    t = tree.select("project", "path", "content", "bytes", F.coalesce("is_symlink", F.lit(False)).alias("is_symlink"), "excluded_by").dropDuplicates(["project", "path"])
    f = classify_files(t)
    if ends is not None:
        own = F.create_map(*[F.lit(x) for pair in ends.langs().items() for x in pair])[F.col("extension")]
        f = f.withColumn("lang", own).withColumn("status", F.when(F.col("lang").isNotNull(), "analysed").when(F.col("status") == "analysed", "unsupported_language").otherwise(F.col("status")))
    text = F.col("content").cast("string")
    wanted = (F.col("status") == "analysed") & F.col("excluded_by").isNull() & ~F.col("is_symlink")
    good = F.col("content").isNotNull() & F.is_valid_utf8(text)
    return f.select(
        "project", "path", "bytes", "is_symlink", "excluded_by", "extension", "family", F.when(wanted & ~good, "failed").otherwise(F.col("status")).alias("status"), "lang",
        F.when(wanted & good, F.regexp_replace(text, "^﻿", "")).when(F.rlike("path", F.lit(CONFIG)) & F.col("excluded_by").isNull() & good, text).alias("text"),
    )


def specifiers(files: DataFrame, extractor: Callable[[str, str], list[tuple[int, str]]] = extract) -> DataFrame:
    """(project, path, lang, ordinal, line, raw) of the analysed files, in source order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, f, lang, k, line, raw) for p, f, lang, text in b.itertuples(index=False) for k, (line, raw) in enumerate(extractor(lang, text))]
            yield pd.DataFrame(rows, columns=["project", "path", "lang", "ordinal", "line", "raw"])

    read = files.where((F.col("status") == "analysed") & F.col("text").isNotNull() & F.col("excluded_by").isNull() & ~F.col("is_symlink"))
    return read.select("project", "path", "lang", "text").mapInPandas(run, _SPEC)


def configs(files: DataFrame) -> DataFrame:
    """(project, config): side indexes as one JSON text per project, out of its configuration files only."""

    def build(g: pd.DataFrame) -> pd.DataFrame:
        made = cand.project_config(dict(zip(g["path"], g["text"], strict=True)))
        return pd.DataFrame({"project": [g["project"].iloc[0]], "config": [json.dumps(made)]})

    return files.where(F.rlike("path", F.lit(CONFIG)) & F.col("text").isNotNull() & F.col("excluded_by").isNull()).select("project", "path", "text").groupBy("project").applyInPandas(build, "project string, config string")


def keys(files: DataFrame) -> DataFrame:
    """(project, key, path): everything a file can be found by."""
    disk = files.select("project", F.concat(F.lit("f:"), F.col("path")).alias("key"), "path")
    open_ = files.where(F.col("excluded_by").isNull() & ~F.col("is_symlink"))
    rel = F.regexp_extract("path", r"^(?:.*/)?(?:java|kotlin|src)/(.+)\.java$", 1)
    jv = open_.where(F.col("extension") == "java").select("project", "path", F.regexp_replace(F.when(rel == "", F.regexp_replace("path", r"\.java$", "")).otherwise(rel), "/", ".").alias("fqn"))
    j = jv.select("project", F.concat(F.lit("j:"), F.col("fqn")).alias("key"), "path").unionByName(jv.select("project", F.concat(F.lit("jp:"), F.regexp_replace("fqn", r"\.?[^.]*$", "")).alias("key"), "path"))
    ns = open_.where((F.col("extension") == "cs") & F.col("text").isNotNull()).select("project", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^\s*namespace\s+([\w.]+)"), F.lit(1)))).alias("n"), "path").select("project", F.concat(F.lit("ns:"), F.col("n")).alias("key"), "path")
    gd = open_.where(F.col("extension") == "go").select("project", F.concat(F.lit("gd:"), dir_name(F.col("path"))).alias("key"), "path")
    parts = F.split(dir_name(F.col("path")), "/")
    dn = open_.where(F.col("path").contains("/")).select("project", F.explode(parts).alias("d")).distinct().select("project", F.concat(F.lit("dn:"), F.col("d")).alias("key"), F.lit(None).cast("string").alias("path"))
    return disk.unionByName(j).unionByName(ns).unionByName(gd).unionByName(dn)


_CAND = _SPEC + ", keys array<string>, tag string, package string"


#: Specifiers of a project that one task resolves with one copy of the project's configuration.
GROUP_ROWS = 200_000


def with_candidates(specs: DataFrame, config: DataFrame, candidates: Callable = cand.candidates) -> DataFrame:
    """Specifiers with their candidate keys.

    A project's configuration meets its specifiers once per group of some ``GROUP_ROWS``
    of them, not once per row; a project of many specifiers is cut into groups by path.
    """

    def run(own: pd.DataFrame, conf: pd.DataFrame) -> pd.DataFrame:
        c = json.loads(conf["config"].iloc[0]) if len(conf) else {}
        made = own[["project", "path", "lang", "ordinal", "line", "raw"]].copy()
        out = [candidates(r.lang, r.raw, r.path, c) for r in own.itertuples(index=False)]
        made["keys"], made["tag"], made["package"] = [k or [] for k, _, _ in out], [t for _, t, _ in out], [p for _, _, p in out]
        return made

    groups = specs.groupBy("project").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("_groups"))
    left = specs.join(groups, "project").withColumn("_group", F.pmod(F.xxhash64("path"), F.col("_groups")).cast("int")).drop("_groups")
    right = config.join(groups, "project").select("project", "config", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_group"))
    return left.groupBy("project", "_group").cogroup(right.groupBy("project", "_group")).applyInPandas(run, _CAND)


def resolve(specs: DataFrame, files: DataFrame, candidates: Callable = cand.candidates) -> DataFrame:
    """(project, path, lang, ordinal, line, raw, tag, package, targets): the ranked-candidate join.

    Candidates are exploded with their rank, joined with the keys of the project, and
    the least rank that exists decides; all files of that key are targets (a
    Go folder, a wildcard). ``tag`` is internal, external, unresolved or outside_root.
    """
    c = with_candidates(specs, configs(files), candidates)
    spread = c.select("project", "path", "ordinal", F.posexplode("keys").alias("rank", "key"))
    hit = spread.join(keys(files).withColumnRenamed("path", "target"), ["project", "key"])
    hit = hit.where(~F.startswith("key", F.lit("ns:")) | (F.col("target") != F.col("path")))  # a namespace's importer is no target
    per = hit.groupBy("project", "path", "ordinal", "rank").agg(F.sort_array(F.collect_set("target")).alias("targets"), F.max(F.startswith("key", F.lit("dn:"))).alias("named"))
    best = per.groupBy("project", "path", "ordinal").agg(F.min_by(F.struct("targets", "named"), "rank").alias("b"))
    j = c.drop("keys").join(best, ["project", "path", "ordinal"], "left")
    tag = F.when(F.col("b").isNull(), F.col("tag")).when(F.col("b.named"), "unresolved").otherwise("internal")
    return j.select("project", "path", "lang", "ordinal", "line", "raw", tag.alias("tag"), F.when(tag == "external", F.col("package")).alias("package"), F.when(tag == "internal", F.col("b.targets")).otherwise(F.array().cast("array<string>")).alias("targets"))


@dataclass
class Scan:
    files: DataFrame
    specifiers: DataFrame
    resolved: DataFrame
    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    failures: DataFrame


def scan(tree: DataFrame, extractor: Callable[[str, str], list[tuple[int, str]]] = extract, store: Callable[[DataFrame, str], DataFrame] = materialise, ends: FrontEnds | None = None) -> Scan:
    """The whole scan of a file table. ``ends`` replaces the built-in front ends; ``store`` keeps the costly steps, which later ones read several times.

    Files without a project form one project of their own; its rows come out with a null project.
    """
    keep = store
    files = keep(prepare(tree.withColumn("project", F.coalesce("project", F.lit(NO_PROJECT))), ends), "files")
    specs = keep(specifiers(files, ends.extract if ends else extractor), "specifiers")
    resolved = keep(resolve(specs, files, ends.candidates if ends else cand.candidates), "resolved")
    known = files.select("project", F.col("path").alias("target"), "status", "excluded_by", "is_symlink")
    t = resolved.where(F.col("tag") == "internal").select("project", "path", "lang", "ordinal", "line", "raw", F.posexplode("targets").alias("k", "target")).join(known, ["project", "target"], "left")
    reason = F.when(F.col("excluded_by") == "always_skip", "skipped_directory").when(F.col("excluded_by").isNotNull() | F.col("is_symlink"), "gitignored").when(F.col("status") == "failed", "target_unreadable")
    t = t.withColumn("reason", reason)
    edges = t.where(F.col("reason").isNull() & (F.col("path") != F.col("target"))).select("project", F.col("path").alias("source"), "target").distinct()
    # of a set without any good target, the first unreadable one sticks, else the latest reason
    per = t.groupBy("project", "path", "lang", "ordinal", "line", "raw").agg(F.count_if(F.col("reason").isNull()).alias("good"), F.max_by("reason", F.struct((F.col("reason") == "target_unreadable").cast("int"), "k")).alias("reason"))
    bad = per.where(F.col("good") == 0).select("project", "path", "line", F.col("raw").alias("specifier"), F.when(F.col("reason") == "target_unreadable", "unresolved").otherwise("excluded").alias("kind"), "reason", "lang", F.col("ordinal").cast("bigint").alias("seq"))
    lost = resolved.where(F.col("tag").isin("unresolved", "outside_root")).select("project", "path", "line", F.col("raw").alias("specifier"), F.when(F.col("tag") == "outside_root", "excluded").otherwise("unresolved").alias("kind"), F.when(F.col("tag") == "outside_root", "outside_root").otherwise("not_found").alias("reason"), "lang", F.col("ordinal").cast("bigint").alias("seq"))
    deps = resolved.where(F.col("package").isNotNull()).groupBy("project", "path").agg(F.sort_array(F.collect_set("package")).alias("external_deps"))
    visible = files.where(F.col("excluded_by").isNull() & ~F.col("is_symlink") & (F.col("status") != "failed"))
    kind = F.when(F.col("status") == "analysed", "source").when(F.col("status") == "unsupported_language", "unread_source").otherwise("asset")
    nodes = visible.join(deps, ["project", "path"], "left").select(
        "project", F.col("path").alias("id"), "path", F.coalesce("lang", F.lower("family"), F.lit("unknown")).alias("lang"), kind.alias("kind"),
        F.when(F.col("status") == "analysed", loc(F.coalesce("text", F.lit("")))).otherwise(0).cast("bigint").alias("loc"), "bytes", F.coalesce("external_deps", F.array().cast("array<string>")).alias("external_deps"),
    )
    failed = files.where(F.col("status") == "failed").select("project", "path", F.lit("read failed: stream did not contain valid UTF-8").alias("reason"))
    skipped = configs(files).select("project", F.explode(F.from_json(F.get_json_object("config", "$.skipped"), "map<string,string>")).alias("path", "r")).select("project", "path", F.concat(F.lit("tsconfig skipped: "), F.col("r")).alias("reason"))
    told = lambda df: df.withColumn("project", F.nullif(F.col("project"), F.lit(NO_PROJECT)))
    return Scan(*map(told, (files, specs, resolved, nodes, edges, bad.unionByName(lost), failed.unionByName(skipped))))


def counters(s: Scan) -> DataFrame:
    """Files, specifiers by outcome, edges and the resolution rate: per project and language, per project and in all.

    Every specifier counts once, whatever its targets; ``level`` is 0 for (project, lang), 1
    for a project, 3 for all. rate = resolved / (internal - excluded), 1.0 where that is 0.
    """
    from graphloom.operators.stats import rate

    zero, one = F.lit(0), F.lit(1)
    columns = ("files", "total", "external", "unresolved", "excluded", "edges")

    def part(df: DataFrame, **given) -> DataFrame:
        return df.select("project", "lang", *[given.get(c, zero).cast("bigint").alias(c) for c in columns])

    langs = s.nodes.where(F.col("kind") == "source").select("project", F.col("id").alias("source"), "lang")
    owned = s.edges.alias("e").join(langs.alias("n"), F.col("e.project").eqNullSafe(F.col("n.project")) & (F.col("e.source") == F.col("n.source"))).select("n.project", "n.lang")
    rows = (
        part(langs, files=one).unionAll(part(owned, edges=one)).unionAll(part(s.resolved, total=one, external=(F.col("tag") == "external").cast("int")))
        .unionAll(part(s.diagnostics, unresolved=(F.col("kind") == "unresolved").cast("int"), excluded=(F.col("kind") == "excluded").cast("int")))
    )
    per = rows.groupBy("project", "lang").agg(*[F.sum(c).alias(c) for c in columns])
    g = per.groupingSets([["project", "lang"], ["project"], []], "project", "lang").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in columns], F.grouping_id().cast("int").alias("level"))
    internal = F.col("total") - F.col("external")
    resolved = internal - F.col("unresolved") - F.col("excluded")
    return g.select("project", "lang", "level", "files", F.col("total").alias("specifiers_total"), internal.alias("specifiers_internal"), resolved.alias("resolved"), "unresolved", "excluded", F.col("external").alias("external_specifiers"), "edges", rate(resolved, internal - F.col("excluded")).alias("resolution_rate"))

"""Files that nobody wrote by hand (problem 4): belief propagation over directory trees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import base_name, dir_name, plain
from graphloom.llm.syntax import decoded
from graphloom.plans.shared import materialise
from graphloom.sources.tables import latest

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")

#: P(label of a file | label of its directory) and P(label of a directory | label of its parent); rows: the upper label.
FILE_IN_DIR = (
    (0.830, 0.080, 0.030, 0.040, 0.020),
    (0.080, 0.860, 0.020, 0.020, 0.020),
    (0.300, 0.040, 0.600, 0.040, 0.020),
    (0.050, 0.030, 0.060, 0.840, 0.020),
    (0.350, 0.050, 0.020, 0.030, 0.550),
)
DIR_IN_DIR = (
    (0.800, 0.050, 0.050, 0.050, 0.050),
    (0.050, 0.870, 0.020, 0.030, 0.030),
    (0.200, 0.030, 0.700, 0.050, 0.020),
    (0.030, 0.020, 0.030, 0.900, 0.020),
    (0.200, 0.040, 0.020, 0.040, 0.700),
)
#: log prior of a project's root directory
ROOT_PRIOR = (3.0, 0.0, 0.0, 0.0, 0.0)

#: Code of fewer characters (without comments and white space) is no evidence of a copy.
COPY_CHARS = 300
#: Code of fewer characters says too little of its form to be called minified or a mass of data.
BULK_CHARS = 100

# --- fixed values: what tools and publishers write, and what projects call their folders ----------------
GENERATED_BANNER = (
    r"@generated\b|<auto-?generated|\bcode generated by\b|\bauto-?generated (?:by|from|file|code|source)|\bmachine[- ]generated\b"
    r"|\b(?:is|was|been|file|code|source)? ?(?:automatically|auto) (?:generated|created|produced|written)\b|\bgenerated (?:on \d|by \w+[ ;:,.-]+(?:do not|changes|edits|v?\d)|by the|automatically|from [\w./-]+\.\w+)"
    r"|\b(?:changes|edits|modifications) (?:will be|are) (?:lost|overwritten)\b|\b(?:this file|this code)[^\n]{0,40}\b(?:made|created|generated|produced) by a? ?(?:tool|compiler|program|script)"
    r"|\bautomatisch (?:erzeugt|erstellt|generiert)\b|\bnicht (?:von hand|manuell) (?:bearbeiten|ändern)|\bgénéré automatiquement|\bgenerado automáticamente|\bdo not (?:modify|edit)(?:[.;!*/ -]*$| (?:by hand|manually|this file|directly))"
)
HAND_BANNER = r"maintained by hand|hand[- ]written|hand[- ]maintained|edited by hand since|written by hand"
VENDOR_BANNER = r"\bcopied from [\w@/.-]+ v?\d|\bversion v?\d+(?:\.\d+)+,? +<?https?://|[\w.-]+ v\d+(?:\.\d+)+ *\| *\(c\)|\(c\) [\w.-]+ contributors|[\w.-]+ v?\d+(?:\.\d+)+ *- *(?:released|licensed) under|\bvendored from\b|^\s*/\*!"
SURELY_GENERATED_DIR = r"^(?:__generated__|generated|generated-sources|gen|autogen)$"
GENERATED_DIR = r"^(?:__generated__|generated|generated-sources|gen|autogen|proto|protobuf|bindings|mocks|migrations|parser|grpc|stubs)$"
VENDOR_DIR = r"^(?:third[_-]?party|3rd-?party|vendor|_vendor|vendored|extern|external|externals|deps|contrib|node_modules|bower_components|site-packages|[a-z][\w-]*-v?\d+(?:\.\d+)+)$"
MINIFIED_DIR = r"^(?:dist|min|minified|bundles?)$"
BLOB_DIR = r"^(?:data|fixtures|blobs?)$"
GENERATED_NAME = r"(?i)[._]pb2?(?:_grpc)?\.\w+$|\.(?:gen|generated|g|tab|pb|freezed|designer)\.\w+$|(?<=[a-z])Grpc\.java$|(?<=[a-z])Stub\.java$|_bindings\.\w+$|_wrap\.\w+$|_sys\.rs$|^mock_\w+\.go$|^\d{2,4}_auto_\w+\.py$|^zz_generated|_generated\.\w+$|^lex\.yy\.|\.yy\.\w+$"
MINIFIED_NAME = r"(?i)[.-]min\.\w+$|\.bundle\.\w+$|\.[0-9a-f]{8,20}\.(?:js|css)$|[.-]chunk\.\w+$"
# --- end of fixed values ----------------------------------------------------------------------------

_COMMENT = r"/\*(?:[^*]|\*(?!/))*+\*/|(?m:^)[ \t]*+(?://|--|#(?![ \t]*(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma|error)\b))[^\n]*+"
_LITERAL = r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`[^`]*+`|[-+]?(?<![\w$])(?:0[xX][0-9a-fA-F]++|\d[\w.]*+)'
_LINE, _BLOCK = r"(?://|#|--|;|%|\*)[^\n]*+", r"/\*(?:[^*]|\*(?!/))*+\*/|<!--(?:[^-]|-(?!->))*+-->"
_LEAD = rf"\A(?:\s++|{_BLOCK}|/\*[^\n]*+|{_LINE}|\"\"\"(?:[^\"\\]|\\(?s:.)|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\\\]|\\\\(?s:.)|'(?!''))*+'''|(?m:<\?(?:php\b|xml\b[^>\n]*+>)|package [\w.]++;?$|[\"']use strict[\"'];?$))*+"
#: the same from the end, over the reversed text: blocks read alike from both sides
_TRAIL = r"\A(?:\s++|[^\n]*?(?://|#|--|;|%)[ \t]*+(?=\n|\z)|/\*(?:[^*]|\*(?!/))*+\*/(?=[ \t]*+(?:\n|\z))|>--(?:[^-]|-(?!-!<))*+--!<(?=[ \t]*+(?:\n|\z)))*+"
#: lines of the lead that are code
_NO_COMMENT = r"(?m)^[ \t]*+(?:package [\w.]++;?|[\"']use strict[\"'];?|<\?(?:php\b|xml\b[^>\n]*+>))[ \t]*+$"
_QUOTED_DEFINE = r"(?m)^[ \t]*+#[ \t]*+define\b[^\n\"']*+[\"'][^\n]*+"
_HAND_LINE = rf"(?m)^[ \t]*+(?:/?\*|//|#|--|;|%)[^\n]*?(?:{HAND_BANNER})"


def features(tree: DataFrame) -> DataFrame:
    """Evidence of each text, computed where the text lies; the text itself goes no further.

    (project, path, code_hash, code_chars, banner, hand, by_hand, headed, vendor, minified, data)

    Banners are read in the comments before the first and behind the last line of code, however long: these
    speak of the whole file, comments among the code of what they stand at. ``by_hand`` is read in every
    comment line.
    """
    text = tree.where(F.col("content").isNotNull()).select("project", plain(F.col("path")).alias("path"), decoded(F.col("content")).alias("t"))
    code = text.select("project", "path", "t", F.trim(F.regexp_replace("t", _COMMENT, "")).alias("c"))
    code = code.select("*", F.regexp_replace("c", r"\s++", "").alias("tight"), F.regexp_replace("c", _LITERAL, "").alias("bare"))
    head = F.regexp_extract("t", _LEAD, 0)
    edges = F.concat_ws("\n", head, F.reverse(F.regexp_extract(F.reverse("t"), _TRAIL, 0)))
    edges = F.lower(F.regexp_replace(edges, _QUOTED_DEFINE, ""))
    n, lines = F.length("c"), F.regexp_count("c", F.lit(r"(?m)^[ \t]*+\S"))
    spaces = F.length("c") - F.length("tight")
    rest = F.length(F.regexp_replace("bare", r"[\s,;:+\-\[\](){}]++", ""))  # what is neither literal nor list
    short_names = F.regexp_count("c", F.lit(r"(?<![\w$])[A-Za-z_$][\w$]?(?![\w$])"))
    names = F.regexp_count("c", F.lit(r"[A-Za-z_$][\w$]*+"))
    long_line = F.length("c") - F.length(F.regexp_replace("c", r"[^\n]{300,}+", ""))
    out = code.select(
        "project", "path", F.xxhash64("tight").alias("code_hash"), F.length("tight").alias("code_chars"),
        F.rlike(edges, F.lit("(?m)" + GENERATED_BANNER)).alias("banner"), F.rlike(edges, F.lit(HAND_BANNER)).alias("hand"), F.rlike(F.lower("t"), F.lit(_HAND_LINE)).alias("by_hand"), F.rlike(F.regexp_replace(head, _NO_COMMENT, ""), F.lit(r"[A-Za-z]{3}")).alias("headed"), F.rlike(edges, F.lit("(?m)" + VENDOR_BANNER)).alias("vendor"),
        ((n >= BULK_CHARS) & (n > 140 * lines) & (spaces < 0.10 * n) | (n >= BULK_CHARS) & (long_line > 0.6 * n) & (spaces < 0.08 * n) & ((short_names > 0.3 * names) | (spaces < 0.05 * n))).alias("minified"),
        ((F.length("tight") >= BULK_CHARS) & (rest < 0.06 * F.length("tight") + 60) & (rest < 0.25 * F.length("tight"))).alias("data"),
    )
    return out.groupBy("project", "path").agg(F.min_by(F.struct(*out.columns[2:]), F.struct("code_hash", "banner")).alias("f")).select("project", "path", "f.*")


def copies(feats: DataFrame) -> DataFrame:
    """(code_hash, salt, n_projects) of code found in several projects; eight salts, so that files of a hot copy spread over as many tasks."""
    per = feats.where(F.col("code_chars") >= COPY_CHARS).select("code_hash", "project").distinct()
    several = per.groupBy("code_hash").agg(F.count(F.lit(1)).alias("n_projects")).where(F.col("n_projects") > 1)
    return several.select("code_hash", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt"), "n_projects")


def _add(*parts: Column) -> Column:
    return sum(parts[1:], parts[0])


def _if(cond: Column, value: float) -> Column:
    return F.when(cond, F.lit(float(value))).otherwise(F.lit(0.0))


def file_evidence(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """(project, path, dir, e0..e4): log evidence of each label for the source files of ``nodes``.

    The newest row of a (project, id) counts. A file whose text is missing is
    judged by its size per line (``bytes`` and ``loc``) and names.
    """
    files = latest(nodes, ["project", "id"], ["path", "kind", "loc", "bytes"], ["scanned_at", "loaded_at"])
    files = files.where(F.col("kind") == "source").select("project", plain(F.coalesce("path", "id")).alias("path"), "loc", "bytes")
    files = files.groupBy("project", "path").agg(F.max("loc").alias("loc"), F.max("bytes").alias("bytes"))
    feats = materialise(features(tree), "evidence")
    f = feats.withColumn("salt", F.pmod(F.xxhash64("project", "path"), F.lit(8)).cast("int")).join(copies(feats), ["code_hash", "salt"], "left")
    f = f.withColumnsRenamed({"project": "_p", "path": "_f"})
    x = files.join(f, F.col("project").eqNullSafe(F.col("_p")) & (F.col("path") == F.col("_f")), "left")
    name = base_name(F.col("path"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    copy = F.coalesce(F.col("n_projects"), F.lit(0)) > 1
    unique = F.col("n_projects").isNull() & (F.coalesce("code_chars", F.lit(0)) >= COPY_CHARS)
    foreign = F.exists(F.split(F.lower(dir_name(F.col("path"))), "/"), lambda p: F.rlike(p, F.lit(VENDOR_DIR)))
    tiny = F.coalesce("code_chars", F.lit(1000)) < 60
    unseen = F.col("_f").isNull() & (F.col("bytes") > 300 * F.greatest(F.col("loc"), F.lit(1)))
    e = [
        _add(F.lit(1.0), _if(yes("hand") | yes("by_hand"), 2.5), _if(yes("headed") & ~yes("banner") & ~yes("vendor"), 1.0), _if(tiny, 2.5)),
        _add(_if(yes("banner") & ~yes("hand"), 8.0), _if(F.rlike(name, F.lit(GENERATED_NAME)), 4.5), _if(~yes("banner"), -0.5), _if(tiny, -1.0)),
        _add(_if(yes("minified") & ~yes("data"), 8.0), _if(unseen, 2.0), _if(F.rlike(name, F.lit(MINIFIED_NAME)), 2.0), _if(~yes("minified") & F.col("_f").isNotNull(), -3.0)),
        _add(_if(copy, 8.0), _if(yes("vendor"), 4.5), _if(unique & ~yes("vendor"), -2.5), _if(foreign, 2.5), _if(tiny, -2.0)),
        _add(_if(yes("data"), 8.0), _if(unseen, 1.0), _if(~yes("data") & F.col("_f").isNotNull(), -3.0)),
    ]
    return x.select("project", "path", dir_name(F.col("path")).alias("dir"), *[c.alias(f"e{k}") for k, c in enumerate(e)])


def _log_sum(terms: Column) -> Column:
    """log of the sum of exponentials of an array."""
    return F.aggregate(
        F.array(F.array_max(terms)),
        F.lit(0.0).cast("double"),
        lambda _, top: top + F.log(F.aggregate(terms, F.lit(0.0).cast("double"), lambda acc, t: acc + F.exp(t - top))),
    )


def _logs(rows) -> Column:
    return F.array(*[F.array(*[F.lit(math.log(x)) for x in row]) for row in rows])


def _message(rows, values: Column) -> Column:
    """For each row of ``rows``, log of the sum over k of row[k] * exp(values[k])."""
    return F.transform(_logs(rows), lambda row: _log_sum(F.zip_with(values, row, lambda v, w: v + w)))


def _up(psi, values: Column) -> Column:
    """Message to the upper label p: log of the sum over lower labels c of psi[p][c] * exp(values[c])."""
    return _message(psi, values)


def _down(psi, values: Column) -> Column:
    return _message(list(zip(*psi)), values)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


_U = [f"u{k}" for k in range(5)]


def _spread(values: str, names: list[str]) -> list[Column]:
    return [F.col(values)[k].alias(n) for k, n in enumerate(names)]


def _summed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _U])


def _dir_evidence(path: Column) -> list[Column]:
    last = F.lower(base_name(path))
    return [F.lit(0.0), _if(F.rlike(last, F.lit(GENERATED_DIR)), 3.0) + _if(F.rlike(last, F.lit(SURELY_GENERATED_DIR)), 4.0), _if(F.rlike(last, F.lit(MINIFIED_DIR)), 1.0), _if(F.rlike(last, F.lit(VENDOR_DIR)), 4.0), _if(F.rlike(last, F.lit(BLOB_DIR)), 0.5)]


def beliefs(evidence: DataFrame) -> DataFrame:
    """(project, path, label, p_hand): exact sum-product over the tree of directories of each project.

    Messages go from the files to their directories and up by depth, then down
    again, one level of all projects at a time: as many rounds as the deepest
    path has folders, each over that level's directories only. Messages of equal
    directories are summed before they are shuffled, so a directory that holds a
    third of all files costs a row per input partition. Null projects form one project.
    """
    files = materialise(evidence.select("project", "path", "dir", F.array(*[f"e{k}" for k in range(5)]).alias("e")), "evidence-of-files")
    files = files.withColumn("m", _up(FILE_IN_DIR, F.col("e")))
    held = _summed(files.select("project", "dir", *_spread("m", _U)), ["project", "dir"])
    parts = F.split("dir", "/")
    chain = F.concat(F.array(F.lit("")), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    every = held.select("project", F.explode(chain).alias("dir")).distinct().select("project", "dir", *[x.alias(u) for u, x in zip(_U, _dir_evidence(F.col("dir")))])
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    # a folder a level, so that each round reads its own directories only
    dirs = materialise(_summed(held.unionByName(every), ["project", "dir"]).withColumn("depth", depth), "dirs", ["depth"])
    deepest = dirs.agg(F.max("depth")).first()[0]
    if deepest is None:
        return files.select("project", "path", F.lit(LABELS[0]).alias("label"), F.lit(1.0).alias("p_hand"))
    levels, come = {}, None
    for level in range(deepest, -1, -1):
        own = dirs.where(F.col("depth") == level).select("project", "dir", *_U)
        if come is not None:
            own = _summed(own.unionByName(come), ["project", "dir"])
        levels[level] = materialise(own.select("project", "dir", F.array(*_U).alias("u")).withColumn("m", _up(DIR_IN_DIR, F.col("u"))), "level")
        come = levels[level].select("project", dir_name(F.col("dir")).alias("dir"), *_spread("m", _U))
    total = levels[0].select("project", "dir", _plus(F.col("u"), F.array(*[F.lit(x) for x in ROOT_PRIOR])).alias("t"))
    found = total
    for level in range(1, deepest + 1):
        up = total.select(F.col("project").alias("_p"), F.col("dir").alias("_d"), "t")
        below = levels[level].join(up, F.col("project").eqNullSafe(F.col("_p")) & (dir_name(F.col("dir")) == F.col("_d")))
        total = materialise(below.select("project", "dir", _plus(F.col("u"), _down(DIR_IN_DIR, _minus(F.col("t"), F.col("m")))).alias("t")), "total")
        found = found.unionByName(total)
    up = found.select(F.col("project").alias("_p"), F.col("dir").alias("_d"), "t")
    both = files.join(up, F.col("project").eqNullSafe(F.col("_p")) & (F.col("dir") == F.col("_d"))).select("project", "path", _plus(F.col("e"), _down(FILE_IN_DIR, _minus(F.col("t"), F.col("m")))).alias("b"))
    label = F.array(*[F.lit(x) for x in LABELS])[(F.array_position("b", F.array_max("b")) - 1).cast("int")]
    return both.select("project", "path", label.alias("label"), F.exp(F.col("b")[0] - _log_sum(F.col("b"))).alias("p_hand"))


def provenance(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """(project, path, label, p_hand) of every source file; ties go to the earlier of ``LABELS``.

    Empty files are handwritten unless their place says otherwise; repeated
    rows count once; empty tables give no rows.
    """
    return beliefs(file_evidence(nodes, tree))


def not_handwritten(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    return provenance(nodes, tree).where(F.col("label") != LABELS[0]).select("project", "path")

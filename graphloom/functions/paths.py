"""Path expressions. All are built-in column functions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(path: Column) -> Column:
    """Slashes instead of backslashes, no leading ``./``; null stays null."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./+)+", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Directory part, '' for a file at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name; '' for none and for names like ``.gitignore``."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?s)(?<=.)\.[^.]*$", "")


def loc(text: Column) -> Column:
    """Number of lines; a final line break opens no further line."""
    n = F.size(F.split(text, "\n", -1)) - F.when(F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return F.when(text == "", 0).otherwise(n).cast("bigint")

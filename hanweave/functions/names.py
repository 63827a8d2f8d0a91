"""File and folder names, path templates, and tag groups."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that names and paths may not hold on Windows, besides the control characters.  Fixed values.
BAD_IN_NAMES = '"<>|:*?\\/'
BAD_IN_PATHS = '"<>|'
LONGEST = 245


def _class(signs: str) -> str:
    return "[\\x00-\\x1F" + re.sub(r"([\\\[\]^\-])", r"\\\1", signs) + "]"


def _valid(name: Column, signs: str) -> Column:
    cut = F.substring(F.regexp_replace(name, r"\.+$", ""), 1, LONGEST)
    return F.regexp_replace(cut, _class(signs), "_")


def valid_file_name(name: Column) -> Column:
    """Without trailing dots, of at most 245 characters, bad characters as ``_``; null for nothing left."""
    out = _valid(name, BAD_IN_NAMES)
    return F.when(out != "", out)


def valid_folder_name(name: Column) -> Column:
    out = _valid(name, BAD_IN_PATHS)
    return F.when(out != "", out)


def wildcard_pattern(wildcard: str) -> str:
    """A regular expression for a path with ``*``, which capture; either slash separates."""
    literal = [re.sub(r"([\\^$.|?+()\[\]{}])", r"\\\1", part) for part in wildcard.replace("\\", "/").split("*")]
    return "(.*?)".join(literal) + "$"


def output_path(path: Column, source: str, target: str) -> Column:
    """The path that a template gives: each ``*`` of the target holds what that of the source matched.

    A target without ``*`` is a folder that keeps the file's name.
    """
    n_source, n_target = source.count("*"), target.count("*")
    if n_target and n_source != n_target:
        raise ValueError("source and target must have the same number of *")
    if not n_target:
        if n_source and not target.endswith("/"):
            raise ValueError("many files can't be written to one")
        return F.concat(F.lit(target), F.element_at(F.split(path, "/"), -1)) if n_source else F.lit(target)
    pattern = wildcard_pattern(source)
    parts = target.split("*")
    out = [F.lit(parts[0])]
    for i, part in enumerate(parts[1:], 1):
        out += [F.regexp_extract(path, pattern, i), F.lit(part)]
    return F.concat(*out)


def rerooted(path: Column, parent: Column, root: Column | str) -> Column:
    """A path below ``parent`` as the same path below ``root``."""
    base = F.lit(root) if isinstance(root, str) else root
    return F.concat_ws("/", base, F.substr(path, F.length(parent) + 2))


def occurrences(text: Column, sign: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))) / len(sign)).cast("int")


def name_parts(path: Column) -> Column:
    """Depth, parent and name of a path."""
    parts = F.split(path, "/")
    parent = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return F.struct(F.size(parts).alias("depth"), parent.alias("parent"), F.element_at(parts, -1).alias("name"))


def with_first(values: Column, first: Column) -> Column:
    """An array with another first element; an empty one stays."""
    return F.when(F.size(values) > 0, F.concat(F.array(first), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))))).otherwise(values)


def split_group(joined: Column) -> Column:
    """The values of a joined tag group, empty ones left out."""
    return F.filter(F.split(joined, "; "), lambda x: x != "")


def joined_group(values: Column) -> Column:
    return F.array_join(values, "; ")

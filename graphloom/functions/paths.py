"""Paths, module names and globs as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: Column, root: str | None = None) -> Column:
    """Slashes forward, no leading ``./``, no closing slash; absolute paths relative to ``root``, null outside it."""
    out = F.regexp_replace(F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"^(\./)+", ""), r"(?<=.)/+$", "")
    if root is None:
        return F.when(out.startswith("/"), F.lit(None).cast("string")).otherwise(out)
    base = root.rstrip("/") + "/"
    return F.when(out.startswith(base), F.substr(out, F.lit(len(base) + 1))).when(~out.startswith("/"), out)


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_of(path: Column) -> Column:
    """The path before the last slash; ``.`` at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def suffix_of(name: Column) -> Column:
    """The last suffix with its dot, lower case; empty for names without one and for dot-files."""
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def ancestors(path: Column, with_self: bool = False) -> Column:
    """Every directory prefix of a path, shortest first."""
    parts = F.split(path, "/")
    last = F.size(parts) - (0 if with_self else 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def _python_parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"\.pyi?$", ""), "/")


def build_module(path: Column) -> Column:
    """Module name for linking: a package's own file keeps all its parts, any other file drops those through the first ``src``."""
    parts = _python_parts(path)
    package = F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")
    at = F.array_position(parts, "src")
    rest = F.when(at > 0, F.slice(parts, at.cast("int") + 1, F.size(parts))).otherwise(parts)
    return F.when(F.element_at(parts, -1) == "__init__", package).otherwise(F.array_join(rest, "."))


def query_module(path: Column) -> Column:
    """Module name for looking up: only a leading ``src`` goes, from packages too."""
    parts = _python_parts(F.regexp_replace(path, r"^src/", ""))
    return F.array_join(F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), ".")


def glob_to_regex(pattern: str) -> str:
    """An anchored Java regex for a case-sensitive glob: ``*``, ``?``, ``[...]`` and ``[!...]``."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", at + 1 + (pattern[at : at + 1] == "!"))) > 0:
            inner = pattern[at:end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else ("\\" if inner.startswith("^") else "") + inner) + "]")
            at = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + r"\z"


#: Line ends of ``str.splitlines``.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def split_lines(text: Column) -> Column:
    """Lines by every line end; a closing one adds no empty line."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

"""Path expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path styles that use backslashes, directories never listed, extensions listed by default.
WINDOWS_STYLES = ("windows", "mapped_drive", "unc")
EXCLUDED_DIRS = (".git", ".svn", ".hg", "$recycle.bin", "system volume information", ".trash", ".trashes", "__pycache__", "node_modules")
DEFAULT_EXTENSIONS = ("pdf", "txt", "md", "csv", "docx")


def extension(name: Column) -> Column:
    """The last suffix in lower case without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """The directories above a relative path, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def is_included(ext: Column, extensions: tuple[str, ...] = ()) -> Column:
    """Whether an extension is listed; without a choice the default set holds."""
    return ext.isin(*(extensions or DEFAULT_EXTENSIONS))


def in_excluded_dir(path: Column) -> Column:
    """Whether some directory of the path is never listed, whatever its case."""
    return F.exists(F.split(parent_dir(path), "/"), lambda d: F.lower(d).isin(*EXCLUDED_DIRS))


def glob_regex(pattern: str) -> str:
    """A shell pattern whose ``*`` crosses ``/`` as a regular expression for whole strings."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[{'^' + body[1:] if body[0] == '!' else '\\' + body if body[0] == '^' else body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_glob(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern fits the path or a directory above it."""
    if not patterns:
        return F.lit(False)
    one = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    return path.rlike(one) | F.exists(ancestors(path), lambda d: d.rlike(one))


def path_style(path: Column) -> Column:
    """The style that the shape of a path shows."""
    return F.when(path.rlike(r"^\\\\[^\\]"), "unc").when(path.rlike(r"^[A-Za-z]:([\\/]|$)"), "mapped_drive").otherwise("linux")


def is_windows(style: Column) -> Column:
    return style.isin(*WINDOWS_STYLES)


def display_path(style: Column, root: Column, relative: Column) -> Column:
    """Root and relative path joined the way the location's users write paths."""
    windows = F.regexp_replace(root, r"[\\/]+$", "")
    plain = F.regexp_replace(root, "/+$", "")
    win = F.when(relative == "", windows).otherwise(F.concat(windows, F.lit("\\"), F.replace(relative, F.lit("/"), F.lit("\\"))))
    return F.when(is_windows(style), win).otherwise(F.when(relative == "", plain).otherwise(F.concat(plain, F.lit("/"), relative)))


def source_name(display: Column) -> Column:
    """The file name at the end of a path of any style."""
    return F.element_at(F.split(F.regexp_replace(F.replace(display, F.lit("\\"), F.lit("/")), "/+$", ""), "/"), -1)


def embedding_context(name: Column) -> Column:
    """A file name as words."""
    return F.trim(F.regexp_replace(name, r"[._/\\-]+", " "))


def page_tag(first: Column, last: Column) -> Column:
    """`` (page n)``, `` (pages a–b)`` or nothing."""
    one = F.concat(F.lit(" (page "), first.cast("string"), F.lit(")"))
    many = F.concat(F.lit(" (pages "), first.cast("string"), F.lit("–"), last.cast("string"), F.lit(")"))
    return F.when(first.isNull(), "").when(last.isNull() | (first == last), one).otherwise(many)


def normalize_extensions(values: Column) -> Column:
    """Extensions without dots and spaces, in lower case; null if one is empty."""
    out = F.transform(values, lambda v: F.lower(F.regexp_replace(F.trim(v), r"^\.+", "")))
    return F.when(~F.exists(out, lambda v: v == ""), out)


def comparable_root(root: Column, style: Column) -> Column:
    """A root with ``/`` between and at the end of its parts, in lower case for Windows styles."""
    slashed = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    windows = F.concat(F.regexp_replace(F.lower(F.replace(root, F.lit("\\"), F.lit("/"))), "/+$", ""), F.lit("/"))
    return F.when(is_windows(style), windows).otherwise(slashed)


def root_problem(root: Column, style: Column, allowed: list[tuple[str, str]]) -> Column:
    """Why a scan root is refused: ``not_absolute``, ``bad_drive``, ``bad_unc``, ``not_allowed``, or null."""
    windows = is_windows(style)
    absolute = F.when(windows, root.rlike(r"^([A-Za-z]:[\\/]|[\\/]{2}[^\\/]+[\\/]+[^\\/]+)")).otherwise(root.startswith("/"))
    dots = F.array_contains(F.split(F.when(windows, F.replace(root, F.lit("\\"), F.lit("/"))).otherwise(root), "/"), "..")
    own = comparable_root(root, style)
    under = F.lit(False)
    for base, base_style in allowed:
        prefix = comparable_root(F.lit(base), F.lit(base_style))
        under = under | ((windows == F.lit(base_style in WINDOWS_STYLES)) & own.startswith(prefix))
    return (
        F.when(~absolute | dots, "not_absolute")
        .when(style.isin("windows", "mapped_drive") & ~root.rlike(r"^[A-Za-z]:"), "bad_drive")
        .when((style == "unc") & ~root.rlike(r"^[\\/]{2}"), "bad_unc")
        .when(~under, "not_allowed")
    )

"""Path rules: extensions, globs, prefixes, scope and remapping."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default exclusion globs.
DEFAULT_EXCLUDES = ("**/@eaDir/**", "**/.DS_Store", "**/*.lrprev")

NO_EXT = "(no ext)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scan_ext(path: Column | str) -> Column:
    """Suffix of the last path component, lower-cased; ``''`` for none or a dotfile."""
    return F.lower(F.regexp_extract(_col(path), r"[^/](\.[^./]+)$", 1))


def report_ext(path: Column | str) -> Column:
    """Text from the last dot anywhere in the path; reports group by this one."""
    p = _col(path)
    return F.when(
        F.contains(p, F.lit(".")), F.lower(F.concat(F.lit("."), F.substring_index(p, ".", -1)))
    ).otherwise(F.lit(NO_EXT))


def glob_regex(pattern: str) -> str:
    """Java regex for one glob. ``*`` and ``**`` both cross ``/``.

    A wildcard at the start does not match a leading dot of the whole string.
    """
    out = [r"(?!\.)"] if pattern[:1] in ("*", "?", "[") else []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            while pattern[i : i + 1] == "*":
                i += 1
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "\\" and i < len(pattern):
            out.append(re.escape(pattern[i]))
            i += 1
        elif ch == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i:end]
            negated = body[0] in "!^"
            body = body[1:] if negated else body
            safe = re.sub(r"([\\\[\]&^~])", r"\\\1", body)
            out.append(f"[{'^' if negated else ''}{safe}]")
            i = end + 1
        else:
            out.append(re.escape(ch))
    return "".join(out)


def globs_regex(patterns: Iterable[str]) -> str | None:
    """One anchored alternation, so a row is matched once whatever the list length."""
    parts = [glob_regex(p) for p in patterns]
    return r"(?s)\A(?:" + "|".join(parts) + r")\z" if parts else None


def excluded(path: Column | str, patterns: Iterable[str]) -> Column:
    regex = globs_regex(patterns)
    return F.lit(False) if regex is None else F.rlike(_col(path), F.lit(regex))


def has_ext(path: Column | str, ext: str) -> Column:
    """Case-insensitive ``%.ext``; leading dots of the argument do not count."""
    suffix = "." + ext.lstrip(".").lower()
    return F.endswith(F.lower(_col(path)), F.lit(suffix))


def has_prefix(path: Column | str, prefix: str) -> Column:
    """Case-insensitive prefix without a separator boundary; no wildcards."""
    return F.startswith(F.lower(_col(path)), F.lit(prefix.lower()))


def contains_text(path: Column | str, term: str) -> Column:
    return F.contains(F.lower(_col(path)), F.lit(term.lower()))


def under_root(path: Column | str, root: Column | str) -> Column:
    """True for the root itself and for anything below it (boundary-aware)."""
    p, r = _col(path), _col(root)
    return (p == r) | F.startswith(p, F.concat(r, F.lit("/")))


def in_scope(path: Column | str, roots: Iterable[str]) -> Column:
    cond = F.lit(False)
    for root in roots:
        base = root.rstrip("/")
        cond = cond | (under_root(path, F.lit(base)) if base else F.startswith(_col(path), F.lit("/")))
    return cond


def remap_prefix(path: Column | str, mapping: Mapping[str, str]) -> Column:
    """First mapping whose old prefix ends at a path boundary wins."""
    p = _col(path)
    out = p
    for old, new in reversed(list(mapping.items())):
        old, new = old.rstrip("/"), new.rstrip("/")
        moved = F.concat(F.lit(new), F.substring(p, F.lit(len(old) + 1), F.length(p)))
        out = F.when(under_root(p, F.lit(old)), moved).otherwise(out)
    return out


def ancestors(path: Column | str) -> Column:
    """The path and every prefix of it that ends right before a ``/``."""
    p = _col(path)
    parts = F.split(p, "/")
    steps = F.sequence(F.lit(1), F.size(parts))
    return F.transform(steps, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))

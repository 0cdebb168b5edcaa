"""Text functions: tokens, query cleaning, truncation, human-readable figures."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: letters folded to their base form by the tokeniser -----------------------------------
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśşšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorssstuuuzzz"


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """Case-folded runs of letters and digits, diacritics removed; an unsegmented CJK run is one token."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sanitize_query(c: Column) -> Column:
    """Letters and digits kept, every other run one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{Nd}]+", " "))


def normalize_term(c: Column) -> Column:
    """Lower case, '_' and '-' as spaces, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "_-", "  "), r"\s+", " "))


def quote_term(c: Column) -> Column:
    """A term as it stands in a match expression: quoted if it holds white space or '-', inner quotes doubled."""
    return F.when(c.rlike(r"[ \t\n-]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _glob(pattern: str) -> str:
    """Regular expression of a path glob: * and ? stay within one path element, ** crosses them."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def path_wanted(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Exclusions first, then inclusions (none means all); a pattern applies as a glob or as a prefix."""
    hit = lambda patterns: reduce(lambda a, b: a | b, [path.rlike(_glob(p)) | path.startswith(p) for p in patterns], F.lit(False))
    return ~hit(exclude) & (hit(include) if include else F.lit(True))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def first_lines(c: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(c, "\n"), 1, n), "\n")


def numbered(line_no: Column, text: Column) -> Column:
    return F.format_string("%4d\t%s", line_no, text)


def _one_digit(x: Column) -> Column:
    """One decimal, halves to the even digit."""
    return F.format_string("%.1f", F.rint(x * 10) / 10)


def human_bytes(n: Column) -> Column:
    units = ("KB", "MB", "GB", "TB", "PB", "EB")
    value = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        value = F.when(n >= 1024**k, F.concat(_one_digit(n / F.lit(float(1024**k))), F.lit(f" {unit}"))).otherwise(value)
    return value


def human_age(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit(" seconds")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" minutes")))
        .when(seconds < 86400, F.concat(_one_digit(seconds / F.lit(3600.0)), F.lit(" hours")))
        .when(seconds.isNotNull(), F.concat(_one_digit(seconds / F.lit(86400.0)), F.lit(" days")))
    )


def repo_file_name(root: Column) -> Column:
    """Store name of a repository: its last path element, odd characters as '_', and 12 digits of the root's SHA-1."""
    last = F.regexp_replace(F.element_at(F.split(F.regexp_replace(root, r"/+$", ""), "/"), -1), r"[^A-Za-z0-9._-]", "_")
    return F.concat(F.when(F.trim(last) == "", F.lit("repo")).otherwise(last), F.lit("-"), F.substring(F.sha1(root.cast("binary")), 1, 12))


def comment_source(text: Column) -> Column:
    """A comment as lines of source: each line trimmed and marked, an empty one as a bare mark, but for an empty last one."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[\s\x0b]+|[\s\x0b]+$", ""))
    marked = F.transform(lines, lambda x, i: F.when(x != "", F.concat(F.lit("// "), x)).when(i < F.size(lines) - 1, F.lit("//")))
    return F.array_join(F.array_compact(marked), "\n")


def insertion_diff(lines: Column, at: Column, added: Column) -> Column:
    """A short unified diff of ``added`` lines inserted behind line ``at`` (from 0) of ``lines``, with two lines of context before and after."""
    start, end = F.greatest(at - 2, F.lit(0)), F.least(at + 3, F.size(lines))
    head = F.format_string("--- <original>\n+++ <modified>\n@@ -%d,%d +%d,%d @@\n", start + 1, end - start, start + 1, end - start + F.size(added))
    part = lambda a, b: F.transform(F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))), lambda x: F.concat(F.lit(" "), x, F.lit("\n")))
    plus = F.transform(added, lambda x: F.concat(F.lit("+"), x, F.lit("\n")))
    return F.concat(head, F.array_join(F.concat(part(start, F.least(at + 1, F.size(lines))), plus, part(F.least(at + 1, end), end)), ""))

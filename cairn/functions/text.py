"""Column helpers for text: LIKE as SQLite has it, dotted suffixes, compaction, words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Latin letters with marks and their plain letters (fixed values), for folding in the JVM.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďēęěğīłńňōőřśšťūůűźżžș"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccdeeegilnnoorsstuuuzzzs"


def ascii_lower(col: Column | str) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(col, _UPPER, _LOWER)


def sqlite_like(col: Column, pattern: str) -> Column:
    """SQLite's LIKE: `%` and `_` are wildcards, letter case of ASCII is ignored, nothing escapes."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in pattern)
    return ascii_lower(col).like(low.replace("\\", "\\\\"))


def dotted_suffixes(ref: Column) -> Column:
    """All dotted suffixes of a reference, itself first: a.b.C -> [a.b.C, b.C, C]."""
    parts = F.split(ref, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def compact(col: Column, most: int) -> Column:
    """Trimmed text of at most `most` characters, with a mark where it was cut."""
    text = F.regexp_replace(col, r"^\s+|\s+$", "")
    mark = F.when(text.contains("\n"), F.lit("\n... (truncated)")).otherwise(F.lit(" ... (truncated)"))
    cut = F.regexp_replace(F.substring(text, F.lit(1), F.lit(most) - F.length(mark)), r"\s+$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, mark))


def words(col: Column) -> Column:
    """Words as the full-text index has them: runs of letters or digits, folded, without Latin marks."""
    return F.regexp_extract_all(F.translate(F.lower(col), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def finite(df):
    """`df` with NULL where a floating-point number is none or has no bound."""
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in wide})


def path_domain(path: Column) -> Column:
    """The first directory with its slash, or (root)."""
    return F.when(F.instr(path, "/") > 1, F.concat(F.substring_index(path, "/", 1), F.lit("/"))).otherwise(F.lit("(root)"))


def glob_regex(glob: str) -> str:
    """A file-name glob (`*` and `?` don't cross `/`) as an anchored regular expression."""
    out = ""
    for part in re.findall(r"\[[^\]]*\]|.", glob):
        out += "[^/]*" if part == "*" else "[^/]" if part == "?" else part if part[0] == "[" and len(part) > 1 else re.escape(part)
    return f"^{out}$"


# The words that a free-text query loses.
STOP_WORDS = frozenset("a an the and or in of to is it for on at by with from that this are be as was not but if we".split())


def query_terms(query: str) -> list[str]:
    """Terms of a free-text query: trimmed, of 3 bytes or more, no stop words, once each in their order."""
    terms = (w.strip(".,;:!?\"'()") for w in query.lower().split())
    return list(dict.fromkeys(t for t in terms if len(t.encode()) >= 3 and t not in STOP_WORDS))


def escape_fts(query: str) -> str:
    """A query without the full-text grammar's own marks."""
    return " ".join(re.sub(r"[-+]", " ", re.sub(r'["*():^~{}|]', "", query)).split())

"""Identifier keys: one bare form for every way an id is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that, as a whole id, say only that there is no id.
MISSING_WORDS = (
    "NA", "NAN", "NAT", "NIL", "NONE", "NULL", "UNKNOWN", "UNK", "NOID", "NODATA", "MISSING", "UNDEFINED", "UNSPECIFIED",
    "UNASSIGNED", "NOTAVAILABLE", "NOTAPPLICABLE", "NOTKNOWN", "NOTSET", "EMPTY", "BLANK", "TBD", "TBA",
)


def id_key(col: Column | str) -> Column:
    """Upper-case letters and digits of an id; null where it is no id.

    Letter case, blanks and punctuation do not count. Null, blank, marks only
    (``-``, ``??``) and the words in MISSING_WORDS give null.
    """
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")
    return F.when((bare != "") & ~bare.isin(*MISSING_WORDS), bare)


def id_key_sql(expression: str) -> str:
    """The same key as a DuckDB expression."""
    bare = f"regexp_replace(upper({expression}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    words = ", ".join(f"'{w}'" for w in MISSING_WORDS)
    return f"(CASE WHEN {bare} <> '' AND {bare} NOT IN ({words}) THEN {bare} END)"


def spread(*cols: Column | str) -> Column:
    """A deterministic 64-bit spread of the given columns."""
    return F.xxhash64(*cols)

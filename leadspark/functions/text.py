"""Text for comparing and for display."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


_RANGE = [chr(c) for c in range(0xC0, 0x250)]
_ONE = [(c, _plain(c)) for c in _RANGE if len(_plain(c)) == 1 and _plain(c) != c]
_MORE = [(c, _plain(c)) for c in ["ª", "º", "²", "³", "¹", "¼", "½", "¾", "™", *_RANGE] if _plain(c) != c and (len(_plain(c)) > 1 or c not in _RANGE)]


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks, for Latin text up to U+024F and some symbols. ASCII stays as it is, at the cost of one look."""
    plain = F.regexp_replace(F.translate(c, "".join(a for a, _ in _ONE), "".join(b for _, b in _ONE)), r"\p{Mn}", "")
    rest = reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), _MORE, plain)
    return F.when(~c.rlike(r"[^\x00-\x7F]"), c).when(plain.rlike("[" + "".join(a for a, _ in _MORE) + "]"), rest).otherwise(plain)


def trim(c: Column) -> Column:
    """Without white space of any kind at the ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normalize_key(c: Column) -> Column:
    """Comparison key: trimmed, lower case, no accents, single spaces; '' for null."""
    return F.coalesce(collapse(strip_accents(F.lower(trim(c)))), F.lit(""))


def clean_display(c: Column) -> Column:
    """Trimmed, single spaces; null if nothing is left."""
    return F.nullif(collapse(trim(c)), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def display_name(c: Column) -> Column:
    """Words in all capitals or all lower case get a capital at their start and after ' and -; mixed case stays."""
    def part(x: Column, mark: str) -> Column:
        return F.array_join(F.transform(F.split(x, mark), lambda y: F.concat(F.upper(F.substring(y, 1, 1)), F.substring(y, 2, 10_000))), mark)

    def word(x: Column) -> Column:
        return F.when((x == F.upper(x)) | (x == F.lower(x)), part(part(F.lower(x), "-"), "'")).otherwise(x)

    return F.array_join(F.transform(F.split(clean_display(c), " "), word), " ")


def normalize_for_match(c: Column) -> Column:
    """No accents, lower case, punctuation as spaces, single spaces."""
    return F.coalesce(trim(collapse(F.regexp_replace(F.lower(strip_accents(c)), r"(?U)[^\w\s]", " "))), F.lit(""))


def contains_ci(c: Column, needle: Column) -> Column:
    return F.contains(F.lower(c), F.lower(needle))


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """table[key], as a literal map."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, default)

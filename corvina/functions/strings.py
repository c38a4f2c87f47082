"""String expressions with the semantics of the catalogue tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def after_first(s: Column, needle: str) -> Column:
    """What follows the first occurrence; null where there is none."""
    at = F.instr(s, needle)
    return F.when(at > 0, F.substring(s, at + len(needle), F.length(s)))


def before_last(s: Column, needle: str) -> Column:
    """What precedes the last occurrence; null where there is none."""
    n = F.size(F.split(s, "\\Q" + needle + "\\E", -1))
    return F.when(n > 1, F.substring(s, F.lit(1), F.length(s) - F.length(F.substring_index(s, needle, -1)) - len(needle)))


def after_last(s: Column, needle: str) -> Column:
    """What follows the last occurrence; the whole text where there is none."""
    return F.substring_index(s, needle, -1)


def until_first(s: Column, needle: str) -> Column:
    """What precedes the first occurrence; the whole text where there is none."""
    return F.substring_index(s, needle, 1)


def last_path_segment(uri: Column) -> Column:
    """The decoded last segment; a stray percent sign stands for itself."""
    return F.try_url_decode(F.regexp_replace(F.substring_index(uri, "/", -1), "%(?![0-9A-Fa-f]{2})", "%25"))


def reasonable(s: Column) -> Column:
    """The text without format, control, private and unassigned characters; newline and tab stay."""
    return F.regexp_replace(s, r"[\p{Cf}\p{Cc}\p{Co}\p{Cn}&&[^\n\t]]", "")

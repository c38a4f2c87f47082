"""Prose expressions: wiki markup, English sentences and their grade, path escaping. All but nested markup run in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as markup, as a sentence and as a word of either kind.
MARKUP_DROPPED = (
    r"(?ism)''+|<!--.*?-->|<(?:math|ref|small).*?(?:/>|</(?:math|ref|small)>)|^#redirect.*?$|^\*+|^=+|(?<=&)amp;|&n(?:bsp|dash);|=+ *$"
)
MARKUP_REPLACED = (
    r"(?s)\{\|.*?\|\}|\{\{.*?\}\}"
    r"|\[\[[^\[:|\]]+:(?:[^\[\]]++|\[\[[^\[\]]*+\]\])*+\]\]"
    r"|\[\[(:[^\[\]]*)\]\]|\[\[([^\[\]:|]*)\]\]|\[\[[^\[\]:|]*\|([^\[\]]*)\]\]|\[[^ \[\]]+(?: ([^\[\]]*))?\]"
    r"|</?[a-zA-Z]+(?: [^>]*?)?/?>"
)
ABBREVIATIONS = r"[Ss]t|Mrs?|dr|ed|c|v(?:s|ol)?|et al"
# Two characters that Unicode keeps out of texts stand for a full stop that ends nothing, and for the end of white
# space longer than a look-behind may be. So sentences are runs of one character class, of any length.
STOP, GAP = "\ufdd0", "\ufdd1"
BRACKET_STOP = r"(\(\w+)\."
OTHER_STOP = rf"(?m)(?<= (?:{ABBREVIATIONS}))\.|(?<=[A-Z])(?<!(?:^|[?!]\s{{1,8}})[(\"]?[A-Z])\.(?= )|\.(?= (?:\w\.|[a-z]))|(?<=[.{STOP}] \w)\.|\.(?=\w)"
LONG_SPACE = rf"(?<=[.?!{STOP}])\s{{9,}}"
SENTENCE = rf"(?m)(?:(?<=[.?!{STOP}]\s{{1,8}}|{GAP})|^)" + r"([(\"]?(?=[A-Z][^.\n?!])(?:[^.\n?!]++[.?!\n]|[^.\n?!]*" + STOP + r")[)\"]?)(?=\s|$)"
WORD_CHARACTER = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
CAPITAL_WORD = r"(^| )[^ a-zA-Z_0-9]*[A-Z]\S*"


def strip_markup(text: Column) -> Column:
    """Text without wiki markup: emphasis, comments, references, templates and tables go, links leave their caption."""
    return F.regexp_replace(F.regexp_replace(text, F.lit(MARKUP_DROPPED), F.lit("")), F.lit(MARKUP_REPLACED), F.lit("$1$2$3$4"))


# The marks that open and close templates, and tables.
NESTED = (("{{", "}}"), ("{|", "|}"))
NESTED_MARK = re.compile(r"\{\{|\}\}|\{\||\|\}")


def nested_spans(text: str) -> list[tuple[int, int]]:
    """Spans of templates and tables, from an opening mark at depth zero to the mark that closes it, in order and disjoint.

    Marks are read from the left. Each kind has a depth of its own; a closing mark at depth zero, and an opening one that
    nothing closes, are text. What either kind covers is one span where they overlap.
    """
    open_at: dict[str, list[int]] = {close: [] for _, close in NESTED}
    closed_by = dict(NESTED)
    spans = []
    for m in NESTED_MARK.finditer(text):
        if m[0] in closed_by:
            open_at[closed_by[m[0]]].append(m.start())
        elif open_at[m[0]]:
            spans.append((open_at[m[0]].pop(), m.end()))
    joined: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if joined and a < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


@F.pandas_udf(T.StringType())
def _without_nested(text: pd.Series) -> pd.Series:
    def cut(t: str | None) -> str | None:
        if t is None:
            return None
        at, out = 0, []
        for a, b in nested_spans(t):
            out.append(t[at:a])
            at = b
        return "".join([*out, t[at:]])

    return text.map(cut)


def strip_nested_markup(text: Column) -> Column:
    """strip_markup for templates and tables that hold others: they go as a whole, then the rest of the markup.

    Only texts that hold an opening mark leave the JVM.
    """
    marked = F.contains(text, F.lit("{{")) | F.contains(text, F.lit("{|"))
    return strip_markup(F.when(marked, _without_nested(F.when(marked, text))).otherwise(text))


def sentences(text: Column) -> Column:
    """The English sentences of a text, in order, of any length.

    A sentence begins with a capital at the start of a line or after an end mark and white space. It runs to the first
    mark that is no abbreviation, initial or stop before lower case; where that mark ends nothing, to the last stop
    before it. U+FDD0 and U+FDD1, which Unicode reserves for use within programs, are taken out.
    """
    stops = F.regexp_replace(F.regexp_replace(F.translate(text, STOP + GAP, ""), F.lit(BRACKET_STOP), F.lit("$1" + STOP)), F.lit(OTHER_STOP), F.lit(STOP))
    found = F.regexp_extract_all(F.regexp_replace(stops, F.lit(LONG_SPACE), F.lit("$0" + GAP)), F.lit(SENTENCE), F.lit(1))
    return F.transform(found, lambda s: F.translate(s, STOP + GAP, "."))


def grade(sentence: Column, known_words: Column | None = None) -> Column:
    """Higher for sentences of many plain words; null without a word.

    `known_words` counts the words found in a dictionary, where there is one.
    """
    words = F.regexp_count(sentence, F.lit(r"\S+"))
    capital_words = F.regexp_count(sentence, F.lit(CAPITAL_WORD))
    plain = F.regexp_count(sentence, F.lit(WORD_CHARACTER)) - F.regexp_count(sentence, F.lit("[0-9]")) - F.regexp_count(sentence, F.lit("[A-Z]"))
    rate = F.when(words == 1, 0.5).otherwise(F.try_divide((capital_words - 1).cast("double"), words - 1))
    score = F.try_divide(plain.cast("double"), F.length(sentence)) + 0.3 * F.least(words - capital_words, F.lit(6)) - rate
    return F.when(words > 0, score if known_words is None else score + (2 * known_words - words) / words)


def escape_path(path: Column) -> Column:
    """A path with forward slashes; controls and the characters that servers mistake become `!` and two hex digits."""
    flat = F.regexp_replace(path, F.lit(r"\\"), F.lit("/"))
    escaped = F.transform(F.split(flat, ""), lambda c: F.when(c.rlike(r"^[%*&+:!\p{Cc}]$"), F.concat(F.lit("!"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))).otherwise(c))
    return F.array_join(escaped, "")

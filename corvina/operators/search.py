"""Keyword search and sort specifications."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_terms(query: str) -> tuple[list[str], list[str]]:
    """Terms that must and must not occur, as typed: single or double quotes group words, a leading minus negates."""
    wanted, unwanted = [], []
    for minus, double, single, plain in re.findall(r"""(-?)(?:"([^"]*)"?|'([^']*)(?:'|$)|(\S+))""", query):
        term = double or single or plain.strip("'\"")
        if term:
            (unwanted if minus else wanted).append(term)
    return wanted, unwanted


def parse_query(query: str) -> tuple[list[str], list[str]]:
    """query_terms in lower case, without white space around them."""
    return tuple([t for t in (x.strip().lower() for x in terms) if t] for terms in query_terms(query))


def keyword_filter(text: Column, query: str) -> Column:
    """True where every wanted term, and no unwanted one, is a substring; the longest term is tried first."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted, unwanted = parse_query(query)
    tests = [F.contains(low, F.lit(t)) for t in sorted(wanted, key=len, reverse=True)]
    tests += [~F.contains(low, F.lit(t)) for t in sorted(unwanted, key=len)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


class SortSpec:
    """Signed column names: `SortSpec(["p_size", "-p_name"])`; empty strings sort last ascending, first descending."""

    def __init__(self, keys: list[str]) -> None:
        seen: dict[str, str] = {}
        for k in keys:
            seen.setdefault(k.lstrip("-"), k)
        self.keys = list(seen.values())

    @classmethod
    def parse(cls, text: str) -> SortSpec:
        return cls([k for k in text.split(",") if k.strip("-")])

    def toggle(self, name: str) -> SortSpec:
        """To the front: descending if it led in ascending order, else ascending."""
        return SortSpec([f"-{name}" if self.keys[:1] == [name] else name, *self.keys])

    def append(self, key: str) -> SortSpec:
        return SortSpec([*self.keys, key])

    def columns(self, df: DataFrame) -> list[Column]:
        out = []
        for k in self.keys:
            name, down = k.lstrip("-"), k.startswith("-")
            if dict(df.dtypes)[name] == "string":
                blank = F.coalesce(F.col(name), F.lit("")) == ""
                out.append(blank.desc() if down else blank.asc())
            out.append(F.col(name).desc() if down else F.col(name).asc())
        return out


def search(df: DataFrame, text: Column, query: str, spec: SortSpec, limit: int | None = None) -> DataFrame:
    """Rows whose text matches, in the order of the specification."""
    found = df.where(keyword_filter(text, query)).orderBy(*spec.columns(df))
    return found.limit(limit) if limit is not None else found

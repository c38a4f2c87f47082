"""URL filters: listed rules, and per host a tree of path templates judged by smoothed labelled purity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import Scratch, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The contract's rules: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: A node with more different children than this, or mostly singletons, has a variable segment.
FANOUT, SINGLETONS, FEW = 32, 0.5, 8
#: Children whose labelled rate is within so many standard errors of their siblings' merge with them.
SIMILAR = 1.96
#: Of children without labels, the chance of holding two equal shares of pages for different ones (Hoeffding's bound).
ALPHA = 0.05
#: Weight, in pages, of the corpus rate in a template's purity, the purity that rejects, and the labels it takes.
PRIOR, PURITY, SUPPORT = 4.0, 0.8, 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without ://."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, or nulls: a host and its subdomains, by path prefix."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _kind(segment: Column) -> Column:
    """Segments that are variable by their looks: numbers, also with an extension, and long hexadecimal names."""
    return segment.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$") | segment.rlike(r"^[0-9a-fA-F-]{12,}$")


def templates(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, path, template, n, bad, good) for (host, path, n, bad, good): counts of pages, and of those labelled so.

    Level by level, each node's children are counted. A segment that looks variable becomes `*`, and
    so do all children of a node with many or mostly single ones. Of the others, those that are statistically like
    the node as a whole are merged into `*` too: with labels, by their share of bad ones; without any, by the
    shares of their pages that end there and that go on with a variable segment. A path that shares its
    node with no other is done, so rounds end with the deepest node that several paths share.
    """
    rows = paths.withColumn("segs", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("node", F.lit(""))
    done, d = [], 0
    own = lambda c: F.when(_kind(c), "*").otherwise(c)
    while True:
        part, after = F.coalesce(F.get("segs", F.lit(d)), F.lit("")), F.get("segs", F.lit(d + 1))
        rows = rows.withColumn("child", own(part))
        share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
        kids = rows.groupBy("host", "node", "child").agg(
            F.sum("n").alias("c_n"), F.sum("bad").alias("c_bad"), F.sum("good").alias("c_good"), F.count("*").alias("c_paths"),
            share(after.isNull()).alias("c_end"), share(F.coalesce(_kind(after), F.lit(False))).alias("c_var"),
        )
        nodes = kids.groupBy(F.col("host").alias("h"), F.col("node").alias("p")).agg(
            F.count("*").alias("kids"), F.sum((F.col("c_n") == 1).cast("int")).alias("single"),
            *[F.sum(f"c_{c}").alias(c) for c in ("n", "bad", "good", "paths", "end", "var")],
        )
        labelled, seen = F.col("bad") + F.col("good"), F.col("c_bad") + F.col("c_good")
        rate = (F.col("bad") + 0.5) / (labelled + 1)
        error = F.sqrt(rate * (1 - rate) / F.greatest(seen, F.lit(1)))
        by_label = F.abs(F.col("c_bad") / F.greatest(seen, F.lit(1)) - rate) <= SIMILAR * error
        reach = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / F.sqrt("c_n") + 1 / F.sqrt("n"))
        by_shape = (F.abs(F.col("c_end") / F.col("c_n") - F.col("end") / F.col("n")) <= reach) & (F.abs(F.col("c_var") / F.col("c_n") - F.col("var") / F.col("n")) <= reach)
        alike = F.when(seen > 0, by_label).otherwise(by_shape & (labelled > 0))
        variable = (F.col("kids") > FANOUT) | ((F.col("kids") >= FEW) & (F.col("single") >= SINGLETONS * F.col("kids")))
        step = F.when(F.col("child") == "", "").when(variable | alike, "*").otherwise(F.col("child"))
        decided = kids.join(nodes, (F.col("host") == F.col("h")) & (F.col("node") == F.col("p"))).select("host", "node", "child", step.alias("step"), (F.col("paths") == 1).alias("lone"))
        rest = F.array_join(F.concat(F.array(F.lit("")), F.transform(F.slice("segs", d + 1, F.greatest(F.size("segs") - d, F.lit(0))), own)), "/")
        node = F.when(F.col("lone"), F.concat("node", rest)).when(F.col("step") == "", F.col("node")).otherwise(F.concat("node", F.lit("/"), "step"))
        level = scratch.keep(rows.join(decided, ["host", "node", "child"]).select("host", "path", node.alias("node"), "n", "bad", "good", "segs", (F.col("lone") | (F.size("segs") <= d + 1)).alias("last")))
        done.append(level.where("last"))
        rows, d = level.where("not last").drop("last"), d + 1
        if rows.isEmpty():
            return reduce(DataFrame.union, done).select("host", "path", F.col("node").alias("template"), "n", "bad", "good")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template, purity.

    Pages that a rule fits are labelled by it, and take its verdict. The others are blocked where the
    template of their path has a smoothed share of blocked pages of PURITY or more, from SUPPORT labels
    at least, else allowed. Pages without a label count at the rate of blocked pages in the whole table, so a few labels
    never speak for a template that is mostly without. A null url, or one without ://, has an empty host and path, and is allowed.
    A path may be of any length and depth.
    Repeated rows come back as given. Paths are counted before anything is joined, so that a hot host
    weighs no more than its different paths.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    ruled = named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    count = lambda v: F.sum((F.coalesce(F.col("ruled"), F.lit("")) == v).cast("long"))
    paths = scratch.keep(ruled.groupBy("host", "path").agg(F.count("*").alias("n"), count("block").alias("bad"), count("allow").alias("good")))
    total = paths.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    prior = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    tree = scratch.keep(templates(paths, scratch))
    sums = tree.groupBy("host", "template").agg(F.sum("n").alias("t_n"), F.sum("bad").alias("t_bad"), F.sum("good").alias("t_good"))
    seen = F.col("t_bad") + F.col("t_good")
    purity = (F.col("t_bad") + (PRIOR + F.col("t_n") - seen) * prior) / (F.col("t_n") + PRIOR)
    rated = sums.select("host", "template", F.round(purity, 6).alias("purity"), ((purity >= PURITY) & (seen >= SUPPORT)).alias("reject"))
    by_path = materialise(tree.select("host", "path", "template").join(rated, ["host", "template"]))
    scratch.release()
    method = F.when(F.col("reject"), "block").otherwise("allow")
    return ruled.join(by_path, ["host", "path"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")

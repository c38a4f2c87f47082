"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that give them away.

Everything is built-in functions. A context is a line. For a kind K of protected entity and a term t,
PMI(t; K) = log2(p(t, K) / (p(t) p(K))) says how many of the IC(K) = -log2 p(K) bits that an entity's
presence carries the term discloses; a term that discloses DISCLOSURE of them, and does so beside
MIN_ENTITIES different entities, is generalised, and one that discloses REMOVAL of them removed. The
same is asked of each single entity beside which a term stands in MIN_LINES different texts. A term
so rated goes wherever it stands, with an entity beside it or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import bitmap, flagged, materialise, possible

#: Share of an entity's information that a term may disclose at most before it is generalised, or removed.
DISCLOSURE, REMOVAL = 0.9, 0.98
#: Different entities, and lines beside them, that a term must be seen with.
MIN_ENTITIES, MIN_LINES = 3, 5

# A run of local-part characters or digits is entered at its start, or where the last match ended
# (\G), which is where the leftmost match begins; possessive loops cannot change a match here, and
# keep long runs linear.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

_SPAN = "array<struct<start:int,end:int,hit:string>>"


def find_all(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches as (start, end, hit), in code points.

    The text between matches and the matches themselves come from the same regular expression, so
    their lengths add up to places.
    """
    pattern = F.lit(pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    empty = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))).cast(_SPAN)
        return F.struct(end.alias("at"), F.concat(acc["spans"], span).alias("spans"))

    def locate(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])

    one = F.transform(F.array(hits), lambda found: F.when(F.size(found) > 0, locate(found)).otherwise(empty))
    return F.get(one, F.lit(0))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    reverse = F.reverse(_digits(hit))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(reverse)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """email, ip, card and phone spans, as (kind, start, end, hit) by kind, then start; failing matches are dropped."""
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?"
    count = lambda h: F.length(_digits(h))
    found = {
        "email": F.when(F.contains(text, F.lit("@")), find_all(text, EMAIL)),
        "ip": F.filter(find_all(text, IP), lambda s: s["hit"].rlike(rf"^{part}(?:\.{part}){{3}}$")),
        "card": F.filter(find_all(text, CARD), lambda s: count(s["hit"]).between(13, 19) & F.when(count(s["hit"]).between(13, 19), _luhn(s["hit"])).otherwise(False)),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(find_all(text, PHONE), lambda s: count(s["hit"]).between(9, 15))),
    }

    def of_kind(k: str) -> Column:
        return F.transform(
            F.coalesce(found[k], F.array().cast(_SPAN)),
            lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")),
        )

    return F.concat(*[of_kind(k) for k in KINDS])


def _terms(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"\P{L}+"), lambda w: F.length(w) >= 3)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, print, text, spans, n_lines) of every row, in a table, so that no text is searched twice."""
    lone = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("string").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    found = lone.select("row", "doc", F.xxhash64("text").alias("print"), base_spans(F.col("text")).alias("spans"), F.size(_lines(F.col("text"))).alias("n_lines"))
    return materialise(found).withColumn("text", F.coalesce(F.col("row")[text_col], F.lit("")))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def _line_terms(line: Column) -> Column:
    """The different terms of a line, but for those within e-mail addresses."""
    return F.array_distinct(_terms(F.regexp_replace(line, EMAIL, " ")))


def _entity_lines(held: DataFrame) -> DataFrame:
    """(key, line start, line, spans in it) of the lines that hold base spans."""
    lines = held.select("doc", "print", "spans", F.explode(find_all(F.col("text"), r"[^\n]+")).alias("line"))
    inside = F.filter("spans", lambda s: (s["start"] >= F.col("line.start")) & (s["start"] < F.col("line.end")))
    return lines.select("doc", "print", "line", F.explode(F.array(inside)).alias("spans")).where(F.size("spans") > 0)


def _disclosed(lines: str) -> Column:
    """PMI over information, of a term in `lines` lines, n of them beside what stands in a share p of all lines."""
    return (F.log2(F.col("n") / F.col(lines)) - F.log2("p")) / -F.log2("p")


def evidence(lines: DataFrame, whole: int, min_entities: int = MIN_ENTITIES, min_lines: int = MIN_LINES) -> DataFrame:
    """(term, n, p, near): each term with each kind, or single entity, that it is seen beside often enough.

    lines are those of _entity_lines, whole is the number of all lines; n lines hold the term beside it, a share p of
    all lines holds it, and near lines hold the term beside anything: the term stands in no fewer.
    """
    beside = lines.select(F.explode(_line_terms(F.col("line.hit"))).alias("term"), "print", "spans")
    near = beside.groupBy("term").agg(F.count("*").alias("near")).where(F.col("near") >= min_lines)
    kinds = lambda d, *more: d.select(*more, F.explode(F.array_distinct(F.transform("spans", lambda s: s["kind"]))).alias("kind"))
    own = lambda d, *more: d.select(*more, F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["hit"].alias("hit"))))).alias("e"))
    seldom = (F.col("held") >= min_lines) & (F.col("held") < whole)
    entities = own(beside, "term").distinct().groupBy("term", F.col("e.kind").alias("kind")).agg(F.count("*").alias("entities")).where(F.col("entities") >= min_entities)
    by_kind = kinds(beside, "term").groupBy("term", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= min_lines).join(entities, ["term", "kind"])
    of_kind = by_kind.join(F.broadcast(kinds(lines).groupBy("kind").agg(F.count("*").alias("held"))), "kind")  # four rows
    # Copies of one text are one witness.
    by_one = own(beside, "term", "print").groupBy("term", "e").agg(F.count("*").alias("n"), F.countDistinct("print").alias("texts")).where(F.col("texts") >= min_lines)
    of_one = by_one.join(own(lines).groupBy("e").agg(F.count("*").alias("held")).where(seldom), "e")
    both = of_kind.where(seldom).select("term", "n", "held").union(of_one.select("term", "n", "held"))
    return both.join(near, "term").select("term", "n", (F.col("held") / F.lit(whole)).alias("p"), "near")


def candidates(lines: DataFrame, whole: int, disclosure: float = DISCLOSURE, min_entities: int = MIN_ENTITIES, min_lines: int = MIN_LINES) -> DataFrame:
    """The evidence that can reach `disclosure`: what would reach it if its term stood in no line but those near entities.

    A term's frequency in the corpus is at least `near` and its disclosure falls as it grows, so none is lost, and only
    the words of what is left are counted.
    """
    return materialise(evidence(lines, whole, min_entities, min_lines).where(_disclosed("near") >= disclosure))


def disclosures(found: DataFrame, marked: DataFrame) -> DataFrame:
    """(term, disclosed): the largest share of an entity's information, or a kind's, that each term of `found` gives away.

    Its lines in all texts are counted; only counts of terms are shuffled.
    """
    lines = marked.select(F.explode(_lines(F.col("text"))).alias("line"))
    words = possible(lines.select(F.explode(_line_terms(F.col("line"))).alias("term")), "term", bitmap(found.select("term")))
    often = words.groupBy("term").agg(F.count("*").alias("lines"))
    return found.join(often, "term").groupBy("term").agg(F.max(_disclosed("lines")).alias("disclosed"))


def _rated(marked: DataFrame, terms: DataFrame) -> DataFrame:
    """Per document the rated terms it holds anywhere: (doc, print, rated)."""
    words = marked.select("doc", "print", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    held = possible(words, "term", bitmap(terms.select("term"))).join(terms, "term")
    return held.groupBy("doc", "print").agg(F.collect_set(F.struct("term", "remove")).alias("rated"))


def _term_spans() -> Column:
    """The spans of a row's rated terms in its text, outside its base spans."""
    words = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.sort_array(F.transform("rated", lambda t: t["term"])), "|"), F.lit(r")(?!\p{L})"))
    free = F.filter(find_all(F.col("text"), words), lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])))
    gone = F.transform(F.filter("rated", lambda t: t["remove"]), lambda t: t["term"])
    return F.transform(free, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.array_contains(gone, F.lower(w["hit"])).alias("remove")))


def find_private(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    disclosure: float = DISCLOSURE,
    removal: float = REMOVAL,
    min_entities: int = MIN_ENTITIES,
    min_lines: int = MIN_LINES,
) -> DataFrame:
    """(row, text, spans, more): base spans, and the spans of disclosing terms anywhere in the text.

    A null text reads as empty and has no spans. Rows are told apart by id and text, so a null id or
    repeated rows are served like any others, and every column of the input stays in `row`. Repeated
    documents count as often as they are there, but as one text where a single entity is rated. Texts of any
    length are searched whole; a term exactly at a threshold reaches it. Texts are not shuffled, but for those
    that a filter over the rated rows lets through.
    """
    marked = _marked(docs, id_col, text_col)
    lines = materialise(_entity_lines(marked.where(F.size("spans") > 0)))
    whole = marked.agg(F.sum("n_lines")).first()[0] or 0
    found = candidates(lines, whole, disclosure, min_entities, min_lines)
    none = F.array().cast("array<struct<start:int,end:int,remove:boolean>>").alias("more")
    if found.isEmpty():
        return marked.select("row", "text", "spans", none)
    over = disclosures(found, marked).where(F.col("disclosed") >= disclosure)
    terms = materialise(over.select("term", (F.col("disclosed") >= removal).alias("remove")))
    if terms.isEmpty():
        return marked.select("row", "text", "spans", none)
    key = F.xxhash64("doc", "print").alias("key")
    rated = materialise(_rated(marked, terms).select(key, F.col("doc").alias("_doc"), F.col("print").alias("_print"), "rated"))
    keyed = flagged(marked.select("row", "doc", "print", "text", "spans", key), "key", bitmap(rated.select("key")))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("print") == F.col("_print"))
    doubtful = keyed.where("maybe").join(rated.drop("key"), same, "left")
    more = F.when(F.col("rated").isNotNull(), _term_spans()).otherwise(none)
    served = doubtful.select("row", "text", "spans", F.explode(F.array(more)).alias("more"))
    return served.union(keyed.where("not maybe").select("row", "text", "spans", none))


def _named(kind: Column, s: Column) -> Column:
    return F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """Per document: counts by kind, a digest of the base spans, and all spans as text."""
    found = find_private(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", **thresholds)
    base = F.transform("spans", lambda s: _named(s["kind"], s))
    more = F.transform("more", lambda s: _named(F.lit("term"), s))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "row.doc_id", *[count(k) for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans")
    )


def sanitised_text() -> Column:
    """The text of find_private's rows with spans replaced; where spans overlap, the first one's mark stands for all."""

    def label(kind: Column) -> Column:
        out = F.lit("")
        for k in KINDS:
            out = F.when(kind == k, PLACEHOLDER[k]).otherwise(out)
        return out

    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s["kind"]).alias("mark")))
    more = F.transform("more", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["remove"], "").otherwise("[TERM]").alias("mark")))
    marks = F.sort_array(F.concat(base, more))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, s["mark"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(marks, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return F.when(F.size("spans") + F.size("more") > 0, whole).otherwise(F.col("text"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, **thresholds) -> DataFrame:
    """The documents with personal data masked, in their own columns; size_col, if given, follows the new length.

    Rows without spans stay as they are, nulls included.
    """
    found = find_private(docs, id_col, text_col, **thresholds).select("row", "spans", "more", F.explode(F.array(sanitised_text())).alias("clean"))
    touched = (F.size("spans") + F.size("more")) > 0
    out = []
    for c in docs.columns:
        own = F.col("row")[c]
        if c == text_col:
            own = F.when(touched, F.col("clean")).otherwise(own)
        elif c == size_col:
            own = F.when(touched, F.length("clean").cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return found.select(*out)

"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages served (fixed values).
STOP_WORDS = tuple(
    sorted(
        set(
            """
            a an and are as at be by for from has have he in is it its not of on or that the this to was were which with
            au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour que qui se son sur un une
            als auf aus bei das dem den der des die ein eine er es für im in ist mit nicht sich sie sind und von war zu
            al como con de del el en es esta la las lo los más no para pero por que se su sus un una y
            """.split()
        )
    )
)


@dataclass(frozen=True)
class Rule:
    """Documents keep while low * of <= metric <= high * of; a missing bound does not bind."""

    name: str
    metric: str
    of: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0  # shorter documents are not judged by this rule


#: The base rules: ten words at least; at most a fifth of the words in repeated 5-word windows.
BASE_RULES = (
    Rule("too few words", "n_words", "one", low=10),
    Rule("repeated windows", "n_repeat_words", "n_words", high=0.2),
)

#: Length, symbol, stop-word and line ratios.
METHOD_RULES = (
    Rule("word length", "word_chars", "n_words", low=1.5, high=14),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("stop words", "n_stop_words", "n_words", low=0.02, from_words=50),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=0.5, from_words=50),
    Rule("shouting", "n_loud_words", "n_words", high=0.5, from_words=20),
)


def compile_rules(rules: tuple[Rule, ...], column=F.col) -> Column:
    """True where a document breaks one of the rules; exact for integer counts below 2^53."""
    broken = F.lit(False)
    for rule in rules:
        value, of = column(rule.metric).cast("double"), F.lit(1.0) if rule.of == "one" else column(rule.of).cast("double")
        fails = F.lit(False)
        if rule.low is not None:
            fails = fails | (value * 1000 < of * round(rule.low * 1000))
        if rule.high is not None:
            fails = fails | (value * 1000 > of * round(rule.high * 1000))
        if rule.from_words:
            fails = fails & (column("n_words") >= rule.from_words)
        broken = broken | fails
    return broken


def _has_word(line: Column) -> Column:
    return F.length(F.trim(F.translate(line, "\t\x0b\x0c\r", "    "))) > 0


def with_metrics(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules use; every step is a projection over one row."""
    one = texts.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    one = one.withColumn("_w", F.filter(F.split("_t", WORD_BREAK), lambda w: w != ""))
    one = one.withColumn("_lines", F.filter(F.split("_t", "\n"), _has_word)).withColumn("n_words", F.size("_w").cast("long"))
    # Hashes of the 5-word windows; sorted with their places only where one occurs twice.
    window = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_words") - 4, F.lit(1)).cast("int")), lambda i: F.xxhash64(F.slice("_w", i, 5)))
    one = one.withColumn("_h", F.when(F.col("n_words") >= 5, window))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    one = one.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    size = F.size("_s")

    def again(k: Column) -> Column:
        own = F.get(F.col("_s"), k)["h"]
        return ((k > 0) & (F.get(F.col("_s"), k - 1)["h"] == own)) | ((k < size - 1) & (F.get(F.col("_s"), k + 1)["h"] == own))

    places = F.transform(F.filter(F.sequence(F.lit(0), size - 1), again), lambda k: F.get(F.col("_s"), k)["i"])
    one = one.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(places)))
    # Each repeated window covers its five words, or those up to the next one's start.
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get(F.col("_p"), k + 1) - p, F.lit(5)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    stop = [w for s in STOP_WORDS for w in (s, s[:1].upper() + s[1:])]
    return one.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
            "n_stop_words": F.size(F.filter("_w", lambda w: w.isin(stop))).cast("long"),
            "n_loud_words": F.size(F.filter("_w", lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w)))).cast("long"),
        }
    ).drop("_t", "_w", "_lines", "_h", "_s", "_p")


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_loud_words")


def judge(docs: DataFrame, text_col: str = "text", base=BASE_RULES, method=METHOD_RULES) -> DataFrame:
    """(row, metrics, base_failed, kept): row is the whole input row, so clashing columns stay apart.

    A null or blank text has no words and fails the base rules. Counts are over the whole text; ties
    and repeated rows are judged one by one.
    """
    lone = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("_text"))
    measured = with_metrics(lone, "_text").select("row", F.struct(*METRICS).alias("m"))
    # A generator between counts and verdict, so that a filter on the verdict does not count again.
    once = measured.select("row", F.explode(F.array("m")).alias("m")).select("row", "m.*")
    return once.withColumn("base_failed", compile_rules(base)).withColumn("kept", ~F.col("base_failed") & ~compile_rules(method))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics and verdict per document; see judge for edge cases."""
    out = judge(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_loud_words")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass, with their own columns."""
    return judge(docs, text_col).where("kept").select("row.*")

"""Chat formatting: a finite-state machine over roles and a declarative template, in built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """What the template puts around a role's text, and whether the text counts towards the loss."""

    role: str
    before: str
    after: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """Parts by role, a part for any other role, and the machine's moves.

    Control strings start with `[` or `<`, which texts never show bare: `escape` stands before each of
    them and before itself, so that a control string in a text is never taken for the template's.
    """

    parts: tuple[Part, ...]
    other: Part
    escape: str
    specials: str
    start: str
    moves: tuple[tuple[str, str, str], ...]  # state, role, next state
    final: tuple[str, ...]


INSTRUCT = Template(
    parts=(
        Part("system", "<<SYS>>", "<</SYS>>", False),
        Part("user", "<s>[INST]", "[/INST]", False),
        Part("assistant", "[OUT]", "</s>", True),
    ),
    other=Part("", "[ROLE]", "[/ROLE]", False),
    escape="\\",
    specials="[<",
    start="open",
    moves=(
        ("open", "system", "briefed"),
        ("open", "user", "asked"),
        ("briefed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    ),
    final=("asked", "answered"),
)


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c for c in chars) + "]"


def escape(text: Column, t: Template = INSTRUCT) -> Column:
    return F.regexp_replace(text, f"({_class(t.escape + t.specials)})", "\\\\" + "$1" if t.escape == "\\" else t.escape + "$1")


def unescape(text: Column, t: Template = INSTRUCT) -> Column:
    return F.regexp_replace(text, f"{_class(t.escape)}({_class(t.escape + t.specials)})", "$1")


def _by_role(t: Template, role: Column, pick) -> Column:
    out = None
    for p in t.parts:
        out = F.when(role == p.role, pick(p)) if out is None else out.when(role == p.role, pick(p))
    return out.otherwise(pick(t.other))


def segment(role: Column, text: Column, t: Template = INSTRUCT) -> Column:
    """One turn as text segments with loss flags: marks are never under the loss.

    A role outside the template is written, escaped and ended by a bar, before the text.
    """
    named = F.concat(escape(role, t), F.lit("<|>"), escape(text, t))
    known = role.isin([p.role for p in t.parts])
    return F.array(
        F.struct(_by_role(t, role, lambda p: F.lit(p.before)).alias("text"), F.lit(False).alias("loss")),
        F.struct(F.when(known, escape(text, t)).otherwise(named).alias("text"), _by_role(t, role, lambda p: F.lit(p.loss)).alias("loss")),
        F.struct(_by_role(t, role, lambda p: F.lit(p.after)).alias("text"), F.lit(False).alias("loss")),
    )


def final_state(roles: Column, t: Template = INSTRUCT) -> Column:
    """The machine's state after the roles; 'invalid' once a move is missing."""

    def step(state: Column, role: Column) -> Column:
        out = F.lit("invalid")
        for a, r, b in reversed(t.moves):
            out = F.when((state == a) & (role == r), b).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(t.start), step)


def format_conversations(rows: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """Per conversation: conv_id, formatted, segments (text, loss), state, valid, n_turns.

    Input columns conv_id, turn, role, text. Turns are ordered by turn, ties by role and text, and
    repeated rows stay repeated; a null text or role reads as empty, a null turn comes first, and a
    null conv_id is a conversation of its own. Turns that break the machine are formatted all the
    same and make the conversation invalid. A conversation is one output value, so its turns meet
    in one task; they are gathered already escaped, and no conversation is cut.
    """
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        final_state(F.col("turns.role"), t).alias("state"),
        F.flatten(F.transform("turns", lambda x: segment(x["role"], x["text"], t))).alias("segments"),
    )
    return parts.select(
        "conv_id",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
        "state",
        F.col("state").isin(list(t.final)).alias("valid"),
        "n_turns",
    )


def read_back(formatted: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """The turns (role, text, loss) parsed from `formatted` alone.

    A text is a run of plain characters and escape pairs, so the first bare special character ends it.
    """
    special = _class(t.escape + t.specials)
    body = f"(?:[^{special[1:-1]}]++|{_class(t.escape)}{special})*+"
    q = lambda s: "\\Q" + s + "\\E"
    opened = "|".join(q(p.before) for p in (*t.parts, t.other))
    closed = "|".join(q(p.after) for p in (*t.parts, t.other))
    turn = f"(?:{opened}){body}(?:{q('<|>')}{body})?(?:{closed})"
    found = formatted.withColumn("_turns", F.regexp_extract_all("formatted", F.lit(turn), F.lit(0)))

    def one(x: Column) -> Column:
        out = None
        for p in t.parts:
            inner = F.substring(x, F.lit(len(p.before) + 1), F.length(x) - (len(p.before) + len(p.after)))
            value = F.struct(F.lit(p.role).alias("role"), unescape(inner, t).alias("text"), F.lit(p.loss).alias("loss"))
            hit = F.startswith(x, F.lit(p.before))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        o = t.other
        inner = F.substring(x, F.lit(len(o.before) + 1), F.length(x) - (len(o.before) + len(o.after)))
        role = F.regexp_extract(inner, f"^({body}){q('<|>')}", 1)
        text = F.regexp_extract(inner, f"^{body}{q('<|>')}({body})$", 1)
        return out.otherwise(F.struct(unescape(role, t).alias("role"), unescape(text, t).alias("text"), F.lit(o.loss).alias("loss")))

    return found.withColumn("turns", F.transform("_turns", one)).drop("_turns")


def digest(formatted: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """Per conversation what the formatted text gives back: turns, loss text and lengths."""
    back = read_back(formatted, t)
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )

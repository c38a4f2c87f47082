"""Main-text extraction by wrappers: union-free regular expressions inferred from the pages of one host.

The pages of a host are aligned into one wrapper. On how many pages each text stands in each of its text slots is counted
in tables beside it.
A text that recurs at its place in the wrapper is template, one that varies is what a page says.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import Scratch, materialise
from corvina.llm.urls import host_and_path

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)

#: Elements whose content is never text of the page.
SILENT = frozenset("head title script style noscript template svg iframe object canvas audio video select button textarea".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that make up a slot's path, and elements that only break blocks.
CONTAINERS = frozenset("body div section article main nav header footer aside form fieldset ul ol dl table figure details dialog blockquote menu".split())
BREAKS = CONTAINERS | frozenset("html p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption pre address hr br legend summary center hgroup option".split())
#: Page furniture by element, and by word of a class or id.
FURNITURE = frozenset("nav header footer aside form fieldset dialog menu".split())
FURNITURE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side rail menu nav navbar
    navigation breadcrumb breadcrumbs toolbar masthead header footer notice notices cookie cookies consent gdpr alert popup modal
    overlay newsletter subscribe subscription signup login form share sharing social related recommended comment comments
    reply replies discussion disqus respond widget pagination pager copyright legal""".split()
)
MAIN_WORDS = frozenset("main article".split())
#: Words that also name parts of articles: they count only where they are the whole class, or stand before one of the others.
COMMON_WORDS = frozenset("side rail legal related social form discussion share sharing alert copyright response promotion banner reply".split())
LISTS = frozenset("posts articles stories links content items pages bar bars box buttons icons widget widgets panel".split())


def _label(name: str, rest: str) -> tuple[str, bool]:
    """An element's name in paths, with its classes, id and role in lower case, words joined by '-', and whether it is hidden."""
    words, hidden = [], False
    for key, a, b, c in NAMED.findall(rest) if rest else ():
        value, key = a or b or c, key.lower()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif key != "aria-hidden":
            spelt = [re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) for token in value.split()]
            words += ["-".join(token) for token in spelt if token]
    return ".".join([name, *sorted(set(words))]), hidden


def events(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """('text', text, path), ('break', element, path), ('open' or 'close', label, path) in page order.

    The path holds the labels of the open containers. End tags close the nearest open container
    of their name; unclosed paragraphs and inline elements do not matter to it.
    """
    path: list[str] = []
    silent: list[str] = []
    at = 0
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at and not silent:
            yield "text", html.unescape(page[at:stop]), tuple(path)
        if not m:
            return
        at = m.end()
        if m.group(0).startswith("<![CDATA["):
            if not silent:
                yield "text", m.group(0)[9:].removesuffix("]]>"), tuple(path)
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing, rest = (m["end"] or m["end2"]) == "/", m["rest"] or m["rest2"] or ""
        if silent:
            if name == silent[-1] and closing:
                silent.pop()
            elif name == silent[0] and not closing and name not in RAW:
                silent.append(name)
            elif silent[0] == "head" and name == "body":
                silent.clear()
            if silent or name != "body":
                continue
        if name in SILENT:
            if closing or rest.endswith("/"):
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            else:
                silent.append(name)
            continue
        label, hidden = _label(name, rest) if not closing else (name, False)
        if hidden and name not in VOID:
            label += ".hidden"
        if name in CONTAINERS or (hidden and name not in VOID and not closing):
            if not closing:
                path.append(label)
                yield "open", label, tuple(path)
            else:
                depth = next((i for i in range(len(path) - 1, -1, -1) if path[i].split(".")[0] == name), None)
                if depth is not None:
                    for gone in reversed(path[depth:]):
                        yield "close", gone, tuple(path)
                    del path[depth:]
        elif closing and any(p.split(".")[0] == name and "hidden" in p.split(".") for p in path):
            depth = max(i for i, p in enumerate(path) if p.split(".")[0] == name)
            del path[depth:]
        if name in BREAKS:
            yield "break", "/" + name if closing else name, tuple(path)


# A wrapper is a list of nodes. A string is an element: its start, or '<x' and '>x' for container x. A list whose
# first item is '+' is a repeated group, with its nodes. Any other list is a text slot: '#' and its path, the pages that
# have it, and its members: on a page the texts (by block_hash), in a wrapper the slots of layouts that it joins, as
# [layout, number]. What fewer pages have than the wrapper is optional.

#: Nodes of a wrapper that takes more pages; a host that needs more has several wrappers, whose counts are added by text.
NODES = 20_000
#: Comparisons that an alignment may take in one piece; longer ones are first cut at tokens that both sides have.
CELLS = 250_000


def key(node) -> str | tuple:
    """What an alignment compares: an element, a slot's path, or a group's keys."""
    if isinstance(node, str):
        return node
    return ("+", tuple(map(key, node[1]))) if node[0] == "+" else node[0]


def combine(a, b, one_page: bool):
    """Two nodes of the same key as one: of one page, whose repeats count once, or of different pages."""
    if isinstance(a, str):
        return a
    if a[0] == "+":
        return ["+", [combine(x, y, one_page) for x, y in zip(a[1], b[1], strict=True)]]
    if one_page:
        return [a[0], 1, list(dict.fromkeys(a[2] + b[2]))]
    return [a[0], a[1] + b[1], a[2] + b[2]]


def fold(nodes: list) -> list:
    """Replace adjacent equal groups of one page by one repeated group, short groups first."""
    for width in range(1, 13):
        keys = [key(n) for n in nodes]
        out, i = [], 0
        while i < len(nodes):
            n = 1
            while len(keys[i : i + width]) == width and keys[i + n * width : i + (n + 1) * width] == keys[i : i + width]:
                n += 1
            group = nodes[i : i + width]
            for more in range(1, n):
                group = [combine(x, y, True) for x, y in zip(group, nodes[i + more * width :], strict=False)]
            if n > 1 and not (width == 1 and group[0][0] == "+"):
                group = [["+", group]]
            out += group
            i += n * width
        nodes = out
    return nodes


def skeleton(page: str) -> list:
    """A page's nodes: container starts and ends, block starts, and text slots, with repeats folded."""
    out: list = []
    for path, what in blocks(page, True):
        if path is None:
            out.append(what)
        elif what.strip():
            slot = ["#" + path, 1, [block_hash(path, what)]]
            if out and key(out[-1]) == slot[0]:
                out[-1] = combine(out[-1], slot, True)
            else:
                out.append(slot)
    return fold(out)


def _marks(a: list, b: list) -> list[tuple[int, int]]:
    """The longest run of places, ascending on both sides, of what stands once in either; without such, of equal occurrences.

    It is empty only where the sides have nothing in common.
    """
    once_a, once_b = Counter(a), Counter(b)
    place = {k: j for j, k in enumerate(b) if once_b[k] == 1}
    marks = [(i, place[k]) for i, k in enumerate(a) if once_a[k] == 1 and k in place]
    if not marks:
        seen: Counter = Counter()
        place = {}
        for j, k in enumerate(b):
            place[k, seen[k]] = j
            seen[k] += 1
        seen = Counter()
        for i, k in enumerate(a):
            if (k, seen[k]) in place:
                marks.append((i, place[k, seen[k]]))
            seen[k] += 1
    tails: list[int] = []
    last, before = [], [-1] * len(marks)
    for m, (_, j) in enumerate(marks):
        at = bisect_left(tails, j)
        before[m] = last[at - 1] if at else -1
        tails[at : at + 1], last[at : at + 1] = [j], [m]
    chain, m = [], last[-1] if last else -1
    while m >= 0:
        chain.append(marks[m])
        m = before[m]
    return chain[::-1]


def opcodes(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """How a becomes b, as difflib tells it; long inputs are cut at marks until the pieces are short or have nothing in common."""
    out = []
    todo: list[tuple[int, int, int, int | None]] = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if m is None:
            out.append(("equal", i, j, k, k + 1))
        elif (j - i) * (m - k) <= CELLS:
            out += [(op, i + p, i + q, k + r, k + t) for op, p, q, r, t in SequenceMatcher(None, a[i:j], b[k:m], autojunk=False).get_opcodes()]
        elif marks := _marks(a[i:j], b[k:m]):
            pieces, x, y = [], i, k
            for p, q in marks:
                pieces += [(x, i + p, y, k + q), (i + p, i + p + 1, k + q, None)]
                x, y = i + p + 1, k + q + 1
            todo += reversed([*pieces, (x, j, y, m)])
        else:
            out.append(("replace", i, j, k, m))
    return out


def align(a: list, b: list) -> list:
    """A wrapper for all that a or b matches.

    Texts at one place are one slot. Mismatches, and what only one side
    has, become optional: they stand one after the other. Where a repeated group stands against anything else, the
    alignment goes on inside it, and the result repeats.
    """
    out: list = []
    keys_a, keys_b = [key(n) for n in a], [key(n) for n in b]
    if keys_a == keys_b:
        return [combine(x, y, False) for x, y in zip(a, b, strict=True)]
    for op, i, j, k, m in opcodes(keys_a, keys_b):
        left, right = a[i:j], b[k:m]
        x, y = (part[0][1] if len(part) == 1 and part[0][0] == "+" else part for part in (left, right))
        if op == "equal":
            out += [combine(x, y, False) for x, y in zip(left, right, strict=True)]
        elif x and y and (x is not left or y is not right):
            out.append(["+", align(x, y)])
        else:
            out += left + right
    return out


def slots(nodes: list) -> Iterator[list]:
    """A wrapper's text slots, in order."""
    for n in nodes:
        if not isinstance(n, str):
            yield from slots(n[1]) if n[0] == "+" else [n]


#: Pages of different texts that a template text must stand on, and the share of those with its slot.
MIN_PAGES, REPEATED = 3, 0.5


def _marks_furniture(token: str, inside: bool) -> bool:
    """Whether a class says furniture: as a whole, or by its first word, or outside an article by any word."""
    if token in FURNITURE_WORDS:
        return True
    words = token.split("-")
    if words[0] in COMMON_WORDS and len(words) == 2 and words[1] in LISTS:
        return True
    return bool(FURNITURE_WORDS.difference(COMMON_WORDS) & set(words[:1] if inside else words))


def _furniture(label: str, inside: bool) -> bool:
    name, *tokens = label.split(".")
    if name == "body":  # holds the whole page, whatever its class says of its parts
        return "hidden" in tokens
    if name in MAIN_WORDS:
        tokens = [t for t in tokens if not MAIN_WORDS & set(t.split("-"))]
    marked = any(_marks_furniture(t, inside) for t in tokens if not (name == "header" and inside and t == "header"))
    return marked or "hidden" in tokens or (name in FURNITURE and not (name == "header" and inside))


def is_main(path: tuple[str, ...], has_article: bool) -> bool:
    """Whether a slot belongs to the article: inside the article if the page has one, and in no furniture."""
    inside = False
    for label in path:
        name, *tokens = label.split(".")
        if _furniture(label, inside):
            return False
        inside = inside or name in MAIN_WORDS or any("main" in t.split("-") for t in tokens)
    return inside or not has_article


def blocks(page: str, structure: bool = False) -> Iterator[tuple[str | None, str]]:
    """(slot path, text) of the runs of text between breaks in one container, and (None, ' ') at breaks.

    With structure, the nodes of elements and containers come in place of the breaks' spaces.
    """
    at, run = None, []
    for kind, what, path in events(page):
        if kind == "text":
            here = "/".join(path)
            if run and here != at:
                yield at, "".join(run)
                run = []
            at = here
            run.append(what)
            continue
        if kind == "break" or structure:
            if run:
                yield at, "".join(run)
                run = []
        if not structure:
            if kind == "break":
                yield None, " "
        elif kind != "break":
            yield None, ("<" if kind == "open" else ">") + what
        elif what[0] != "/" and what not in CONTAINERS and what not in VOID:
            yield None, what
    if run:
        yield at, "".join(run)


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def block_hash(path: str, text: str) -> int:
    """A text in its slot, white space aside."""
    return _hash(path, " ".join(text.split()))


#: Characters of template text that may go from one place even where they outweigh what varies on the page.
SHORT = 280


def _dropped(found: list[tuple[str, str]], fixed: set[int], article: bool) -> set[int]:
    """Which of a page's main blocks (path, text) are template around what the page says, by index.

    Texts of the host's template stay where they stand between varying texts of the same place: the article, or one
    container of a page that has none. They go before and behind them, and where nothing varies, unless that
    would take a long text that outweighs all that varies on the page, or a whole article.
    """
    template = [block_hash(path, text) in fixed for path, text in found]
    if not any(template) or (article and all(t for t, (_, text) in zip(template, found, strict=True) if text.strip())):
        return set()
    varying = sum(len(text) for t, (_, text) in zip(template, found, strict=True) if not t)
    places: dict[str, list[int]] = {}
    for i, (path, text) in enumerate(found):
        if text.strip():
            places.setdefault("" if article else path, []).append(i)
    gone: set[int] = set()
    for own in places.values():
        data = [i for i in own if not template[i]]
        outside = [i for i in own if template[i] and not (data and data[0] < i < data[-1])]
        size = sum(len(found[i][1]) for i in outside)
        if size < max(SHORT, varying):
            gone.update(outside)
    return gone


def main_text(page: str, fixed: set[int]) -> str:
    """The text of a page's main slots: white space as one space, blocks joined by one space.

    A page that has an article gives what is inside it, one that has none what stands in no furniture. Blocks in
    `fixed` are the host's template; those around the page's own text go.
    """
    parts = list(blocks(page))
    paths = {path: tuple(path.split("/")) for path, text in parts if path is not None}
    inner = {path for path, labels in paths.items() if is_main(labels, True)}
    article = any(path in inner and text.strip() for path, text in parts)
    keep = inner if article else {path for path, labels in paths.items() if is_main(labels, False)}
    kept = [(path, text) for path, text in parts if path is None or path in keep]
    if fixed:
        named = [i for i, (path, _) in enumerate(kept) if path is not None]
        gone = {named[i] for i in _dropped([kept[i] for i in named], fixed, article)}
        kept = [x for i, x in enumerate(kept) if i not in gone]
    return " ".join("".join(text for _, text in kept).split())


READ = "host string, main long, layout long, shape string, texts array<array<long>>"
LEVEL = "host string, id long, weight long, open boolean, wrapper string"


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [t.as_py() or "" for t in batch.column(1)]
        made = [skeleton(p) for p in pages]
        main = [_hash(main_text(p, set())) for p in pages]
        shapes = [json.dumps([key(n) for n in nodes]) for nodes in made]
        layouts = [_hash(shape) for shape in shapes]
        texts = [[s[2] for s in slots(nodes)] for nodes in made]
        columns = [batch.column(0), pa.array(main, pa.int64()), pa.array(layouts, pa.int64()), pa.array(shapes, pa.string()), pa.array(texts, pa.list_(pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays(columns, ["host", "main", "layout", "shape", "texts"])


def _built(keys: list, layout: int, pages: int, number: Iterator[int]) -> list:
    """A layout's wrapper from its keys."""
    out: list = []
    for k in keys:
        if isinstance(k, str):
            out.append([k, pages, [[layout, next(number)]]] if k[0] == "#" else k)
        else:
            out.append(["+", _built(k[1], layout, pages, number)])
    return out


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        made = [json.dumps(_built(json.loads(shape), layout, pages, count())) for _, layout, pages, shape in rows]
        columns = [*batch.columns[:3], pa.array([True] * len(made)), pa.array(made, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "id", "weight", "open", "wrapper"])


def _size(nodes: list) -> int:
    return sum(1 if isinstance(n, str) or n[0] != "+" else _size(n[1]) for n in nodes)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The wrappers of a group as one, layouts of many pages first, and which slots went into which.

    Where it would have more than NODES nodes it is closed, and a further one begins.
    """
    made = []

    def give(out: list, first: int, still: bool) -> None:
        moves = []
        for slot in slots(out):
            moves += [[*member, *slot[2][0]] for member in slot[2][1:]]
            slot[2] = slot[2][:1]
        made.append((pdf["host"].iloc[0], first, max((s[1] for s in slots(out)), default=0), still, json.dumps(out), moves))

    out, first = None, 0
    for row in pdf.sort_values(["weight", "id"], ascending=[False, True]).itertuples():
        nodes = json.loads(row.wrapper)
        both = nodes if out is None else align(out, nodes)
        if out is not None and _size(both) > NODES:
            give(out, first, False)
            both, out = nodes, None
        first = int(row.id) if out is None else first
        out = both
    give(out, first, True)
    return pd.DataFrame(made, columns=["host", "id", "weight", "open", "wrapper", "moves"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(h, *s[2][0], s[1]) for h, w in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True) for s in slots(json.loads(w))]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["host", "layout", "slot", "pages"])


#: Wrappers that one task aligns before their result goes to the next round.
ALIGN = 64


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, fixed) from (host, html): hashes of the texts that are template, those that recur at their place in the wrapper.

    Pages of one main text, such as mirrors and print versions, count once: one of them takes part. Pages of one layout share
    their slots; layouts are aligned in rounds, dealt into groups of about ALIGN, so a host with many layouts takes more
    rounds but no larger group. Wrappers hold no texts. How many pages have a text in a slot is counted over all pages, and
    the counts follow their slots into those that they are joined with. Where NODES keeps wrappers of a host apart, a text's
    pages are also added over all slots that have it.
    """
    one = pages.mapInArrow(_skeletons, READ).groupBy("host", "main").agg(F.min(F.struct("layout", "shape", "texts")).alias("x"))
    once = scratch.keep(one.select("host", "x.*"))
    place = ["host", "layout", "slot"]
    found = once.select("host", "layout", F.posexplode("texts").alias("slot", "texts")).select("host", "layout", F.col("slot").cast("long").alias("slot"), F.explode("texts").alias("text"))
    texts = found.groupBy(*place, "text").agg(F.count("*").alias("n"))
    shapes = once.groupBy("host", "layout").agg(F.count("*").alias("pages"), F.min("shape").alias("shape"))
    level = scratch.keep(shapes.mapInArrow(_opened, LEVEL))
    ends = None
    while True:
        several = scratch.keep(level.where("open").groupBy("host").agg(F.count("*").alias("n")).where("n > 1"))
        if several.isEmpty():
            break
        known = level.join(several, "host", "left")
        dealt = known.where("open and n > 1").withColumn("deal", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / ALIGN)))
        merged = scratch.keep(dealt.groupBy("host", "deal").applyInPandas(_merge, LEVEL + ", moves array<array<long>>"))
        level = scratch.keep(merged.drop("moves").union(known.where("n is null or not open").drop("n")))
        moved = merged.select("host", F.explode("moves").alias("m")).select("host", *[F.col("m")[i].alias(c) for i, c in enumerate(("layout", "slot", "to_layout", "to_slot"))])
        if ends is not None:
            on = moved.select("host", F.col("layout").alias("to_layout"), F.col("slot").alias("to_slot"), F.col("to_layout").alias("l"), F.col("to_slot").alias("s"))
            onward = ends.join(on, ["host", "to_layout", "to_slot"], "left")
            moved = moved.union(onward.select(*place, F.coalesce("l", "to_layout"), F.coalesce("s", "to_slot")))
        ends = scratch.keep(moved)
    if ends is not None:
        at = texts.join(ends, place, "left").select("host", F.coalesce("to_layout", "layout").alias("layout"), F.coalesce("to_slot", "slot").alias("slot"), "text", "n")
        texts = at.groupBy(*place, "text").agg(F.sum("n").alias("n"))
    recurs = f"n >= {MIN_PAGES} and n >= {REPEATED} * pages"
    places = level.mapInArrow(_places, "host string, layout long, slot long, pages long")
    fixed = texts.where(f"n >= {MIN_PAGES}").join(places, place).where(recurs).select("host", "text")
    apart = scratch.keep(level.groupBy("host").agg(F.count("*").alias("wrappers")).where("wrappers > 1"))
    if not apart.isEmpty():
        spread = texts.join(apart.select("host"), "host", "left_semi").join(places, place)
        fixed = fixed.union(spread.groupBy("host", "text").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages")).where(recurs).select("host", "text"))
    return fixed.groupBy("host").agg(F.sort_array(F.collect_set("text")).alias("fixed"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, held, texts = 0, 0, []
        for i in range(batch.num_rows):
            page = batch.column(2)[i].as_py() or ""
            texts.append(main_text(page, set(batch.column(3)[i].as_py() or ())))
            held += len(page)
            if held > 4_000_000 or i + 1 == batch.num_rows:
                ids, urls = batch.column(0).slice(start, i + 1 - start), batch.column(1).slice(start, i + 1 - start)
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string())], ["page_id", "url", "text"])
                start, held, texts = i + 1, 0, []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    A null page reads as empty and gives the empty text; pages with a null or hostless url share the
    empty host. Truncated pages and unclosed elements are read as far as they go. Every main text of a host
    takes part in its wrapper, by one of its pages, and every page is extracted whole, however long or deeply nested;
    repeated rows come back as given. Columns other than the three named are not read.
    """
    scratch = Scratch(pages.sparkSession)
    host, _ = host_and_path(F.col(url_col))
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    keep = materialise(templates(named.select("host", "html"), scratch))
    scratch.release()
    texts = named.join(keep, "host", "left").select("page_id", "url", "html", "fixed").mapInArrow(_extract, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))

"""Near-duplicate grouping with SuperMinHash signatures, banding, verification and union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import Scratch, bitmap, document_chunks, materialise, mix, possible

#: Banding of the signature. At a similarity of 0.75 a pair shares no band with probability
#: (1 - 0.75^4)^32 = 5e-6, and less above it.
BANDS, ROWS = 32, 4
#: Documents compared with one hub in one group, at most about; more are dealt into several.
GROUP = 256
#: Counters of the frequency sketch that orders shingles. Any order gives the same links; a sharper one gives
#: fewer candidates.
COUNTERS = 1 << 18
#: Documents of one shingle that a join group takes from its rarer components, at most about.
SPLIT = 1024

_COEFF = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _salt(i: int, factor: int) -> np.uint64:
    return np.uint64(int(i) * factor % 2**64)


def shingle_sets(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents of a chunk, and each document's first position in them."""
    w, docs = words.hashes, words.docs
    counts = np.diff(docs)
    n = len(w)
    acc = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for i in range(k):
        acc += w[i : n - k + 1 + i] * _COEFF[i] if n >= k else 0
    acc = mix(acc)
    parts, sizes = [], np.zeros(len(counts), dtype=np.int64)
    for d in range(len(counts)):
        c = counts[d]
        if c >= k:
            s = np.sort(acc[docs[d] : docs[d + 1] - k + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif c:
            head = w[docs[d] : docs[d + 1]]
            s = mix((head * _COEFF[:c]).sum(dtype=np.uint64, keepdims=True) + _salt(c, 0x8CB92BA72F3D8DD7))
        else:
            continue
        parts.append(s)
        sizes[d] = len(s)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def superminhash(flat: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (documents x m) of the given sets.

    Element e visits the m slots in the order of its own random permutation (Fisher-Yates driven
    by its hash) and offers slot p_j the value j + r_j, 0 <= r_j < 1; a slot keeps its minimum. All
    elements take step j together: once every slot of a document is filled, its later steps can
    only offer larger values, so the document stops there.
    """
    docs = len(first) - 1
    sig = np.full(docs * m, np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(docs), np.diff(first))
    draw = mix(flat + np.uint64(0x9E3779B97F4A7C15))
    slot = ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
    np.minimum.at(sig, owner * m + slot, draw >> np.uint64(32))
    full = (sig.reshape(docs, m).max(axis=1) != np.iinfo(np.uint64).max) if docs else np.zeros(0, dtype=bool)
    todo = np.flatnonzero(~full & (np.diff(first) > 0))
    row = 0
    while row < len(todo):  # documents in groups of at most about 16,000 elements
        size, end = 0, row
        while end < len(todo) and (end == row or size < 16_000):
            size += int(first[todo[end] + 1] - first[todo[end]])
            end += 1
        _later_steps(flat, first, todo[row:end], sig, m)
        row = end
    return sig.reshape(docs, m)


def _later_steps(flat: np.ndarray, first: np.ndarray, group: np.ndarray, sig: np.ndarray, m: int) -> None:
    take = np.concatenate([np.arange(first[d], first[d + 1]) for d in group])
    e = flat[take]
    owner = np.repeat(group, first[group + 1] - first[group])
    order = np.empty((len(e), m), dtype=np.uint16)
    order[:] = np.arange(m, dtype=np.uint16)
    rows = np.arange(len(e))
    table = sig.reshape(-1, m)
    for j in range(m):
        draw = mix(e + _salt(j + 1, 0x9E3779B97F4A7C15))
        k = j + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(m - j)).astype(np.int64)
        slot = order[rows, k].astype(np.int64)
        order[rows, k] = order[rows, j]
        order[rows, j] = slot
        if j:
            np.minimum.at(sig, owner * m + slot, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
            open_docs = table[group].max(axis=1) == np.iinfo(np.uint64).max
            if not open_docs.any():
                return
            if open_docs.mean() < 0.7:
                keep = np.isin(owner, group[open_docs])
                e, owner, order, group = e[keep], owner[keep], order[keep], group[open_docs]
                rows = np.arange(len(e))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per document and band."""
    cut = sig.reshape(len(sig), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xE7037ED1A0B428DB)
    for i in range(rows):
        key = mix(key + cut[:, :, i] * _COEFF[i])
    return key


SKETCH_SCHEMA = "doc_id long, n_shingles long, fp binary, bands array<long>"


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, words in document_chunks(batch.column(1), lower=True):
                flat, first = shingle_sets(words, k)
                sizes = np.diff(first)
                prints = [
                    hashlib.blake2b(flat[first[i] : first[i + 1]].tobytes(), digest_size=16).digest() if sizes[i] else None
                    for i in range(b - a)
                ]
                keys = band_keys(superminhash(flat, first, bands * rows), bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)), pa.array(keys.reshape(-1))
                )
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(sizes), pa.array(prints, pa.binary()), lists],
                    ["doc_id", "n_shingles", "fp", "bands"],
                )

    return run


def _confirm(k: int, num: int, den: int):
    """Rows (b, deal, a, text), each group's hub b (a null) before its others, as the pairs (a, b) whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for batch in batches:
            good = []
            groups = list(zip(batch.column("b").to_pylist(), batch.column("deal").to_pylist(), strict=True))
            others = batch.column("a").to_pylist()
            for start, end, words in document_chunks(batch.column("text"), lower=True):
                flat, first = shingle_sets(words, k)
                for i in range(start, end):
                    own = flat[first[i - start] : first[i - start + 1]]
                    if groups[i] != at:
                        at, hubs = groups[i], []
                    if others[i] is None:
                        hubs.append(own.copy())
                    elif any(alike(own, hub, num, den) for hub in hubs):
                        good.append((others[i], at[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in good], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets, given as sorted hashes, have the similarity num / den or more."""
    if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
        return False
    both = np.sort(np.concatenate((x, y)))
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(x) + len(y) - common)


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: each node that is not its set's smallest, linked to the smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    Union-find inside each partition leaves a forest of stars; then every node moves to its smallest
    neighbour and links are rewritten to the new ends, until none joins two nodes. Composing the
    moves gives the component: the smallest node never moves.
    """
    keep = (scratch or Scratch(edges.sparkSession)).keep
    links = keep(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_union_find, "a long, b long"))
    moves = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        moves.append(move)
        ends = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        other = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = keep(
            links.join(ends, "a")
            .join(other, "b")
            .where("x <> y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
            .distinct()
            .mapInArrow(_union_find, "a long, b long")
        )
    if not moves:
        return edges.select(F.col("a").cast("long").alias("node"), F.col("a").cast("long").alias("component")).limit(0)
    out = moves[0].select("node", F.col("to").alias("component"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("component"), "to")
        out = out.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return keep(out)


def _size_fits(n: Column, other: Column, num: int, den: int) -> Column:
    """Sets whose sizes differ too much cannot reach the similarity."""
    return F.least(n, other) * den >= F.greatest(n, other) * num


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    num: int = 75,
    den: int = 100,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A document's set is
    its distinct k-word shingles; with fewer words, the whole sequence as one. Documents are linked
    when intersection / union >= num / den, on full sets; component_id is the smallest doc_id
    reachable and kept tells whether it is the document's own.

    Null or blank texts have an empty set and are linked with nothing. A null id cannot be named: its
    row gets a null component and is kept. Rows repeated as a whole come back as often as given; rows
    of one doc_id with different texts are one document that holds all their sets, so each text's links
    are the document's. Very long texts are read whole, about CHUNK bytes of documents at a time.

    Copies with equal sets are collapsed before banding. In each bucket the smallest id is verified against
    the rest; where that leaves a bucket's members in different components, they go through an exact prefix
    filter, so that no bucket is expanded into all its pairs. Texts are shuffled only for documents of shared
    buckets, which a filter of fixed size picks where the texts are read.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = scratch.keep(base.mapInArrow(_sketch(k, bands, rows), SKETCH_SCHEMA))
    live = sketch.where("fp is not null and doc_id is not null")
    reps = scratch.keep(
        live.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands"))
    )
    keyed = reps.select("doc", F.explode("bands").alias("key"))
    buckets = scratch.keep(
        keyed.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("top")).where("hub < top").select("key", "hub")
    )
    shared = scratch.keep(possible(keyed, "key", bitmap(buckets)).join(buckets, "key").where("doc > hub"))
    ids = shared.select("doc").union(shared.select("hub"))
    texts = possible(base.where("text is not null"), "doc_id", bitmap(ids))
    crowd = scratch.keep(texts.dropDuplicates(["doc_id", "text"]))
    sizes = reps.select("doc", "n")
    pairs = (
        shared.select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()
        .join(sizes.select(F.col("doc").alias("a"), F.col("n").alias("n_a")), "a")
        .join(sizes.select(F.col("doc").alias("b"), F.col("n").alias("n_b")), "b")
        .where(_size_fits(F.col("n_a"), F.col("n_b"), num, den))
        .select("a", "b").distinct()
    )
    edges = scratch.keep(_confirmed(pairs, crowd, k, num, den, scratch).union(_same_id(live, reps)))
    comp = components(edges, scratch)

    # What is left: members of one bucket, neither its hub, in different components.
    label = comp.select(F.col("node").alias("doc"), "component")
    members = shared.join(label, "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = scratch.keep(members.join(mixed, "key").select("doc", "component").distinct())
    if not left.isEmpty():
        more = scratch.keep(_confirmed(_prefix_pairs(crowd, left, k, num, den, scratch), crowd, k, num, den, scratch))
        if not more.isEmpty():
            comp = components(edges.union(more), scratch)

    named = reps.join(comp, reps["doc"] == comp["node"], "left").select("fp", F.coalesce("component", "doc").alias("component"))
    out = sketch.where("fp is not null").join(named, "fp", "left").select("doc_id", "n_shingles", "component")
    blank = sketch.where("fp is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    result = materialise(
        out.union(blank)
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    scratch.release()
    return result


def _same_id(live: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between the copies that one id stands for, where its texts differ."""
    named = live.select("doc_id", "fp").join(reps.select("fp", "doc"), "fp").select("doc_id", "doc")
    several = named.groupBy("doc_id").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("doc_id", "lo")
    return named.join(several, "doc_id").where("doc > lo").select(F.col("doc").alias("a"), F.col("lo").alias("b")).distinct()


def _confirmed(pairs: DataFrame, crowd: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are alike.

    A hub's text goes once to each group of about GROUP partners, so a hub with many is dealt over many groups.
    """
    pairs = scratch.keep(pairs)
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).alias("deal"))
    asked = dealt.select(F.col("a").alias("doc_id"), "b", "deal", "a").union(
        dealt.select(F.col("b").alias("doc_id"), "b", "deal", F.lit(None).cast("long").alias("a")).distinct()
    )
    texts = asked.join(crowd, "doc_id").select("b", "deal", "a", "text")
    near = texts.repartition("b", "deal").sortWithinPartitions("b", "deal", F.col("a").asc_nulls_first())
    return near.mapInArrow(_confirm(k, num, den), "a long, b long").distinct()


def _slots(shingles: np.ndarray, counters: int) -> np.ndarray:
    return (shingles % np.uint64(counters)).astype(np.int64)


def _count(k: int, counters: int):
    """How many documents hold a shingle of each counter, summed over one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, dtype=np.int64)
        for batch in batches:
            for _, _, words in document_chunks(batch.column("text"), lower=True):
                total += np.bincount(_slots(shingle_sets(words, k)[0], counters), minlength=counters)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    return run


HEADS = "doc long, n long, component long, pos long, shingle long"


def _heads(k: int, num: int, den: int, counts: np.ndarray):
    """The first shingles of each document that another one may hold too, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, comps = batch.column("doc").to_pylist(), batch.column("component").to_pylist()
            for start, end, words in document_chunks(batch.column("text"), lower=True):
                flat, first = shingle_sets(words, k)
                often = counts[_slots(flat, len(counts))]
                parts = []
                for i in range(end - start):
                    own, seen = flat[first[i] : first[i + 1]], often[first[i] : first[i + 1]]
                    n = len(own)
                    length = n - -(-n * num // den) + 1
                    order = np.lexsort((own, seen))[:length]
                    pos = np.flatnonzero(seen[order] > 1)
                    parts.append((np.full(len(pos), docs[start + i]), np.full(len(pos), n), np.full(len(pos), comps[start + i]), pos, own[order[pos]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)], HEADS.replace(" long", "").split(", "))

    return run


def _prefix_pairs(crowd: DataFrame, left: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of the documents left (doc, component), in different components, that may reach the similarity.

    Two sets of n shingles with the similarity asked for share one of the n - ceil(n * num / den) + 1
    first in any common order. The order is by an estimate of how many documents hold a shingle, from a table of
    COUNTERS counts, then by its hash: what nobody shares comes first and is not listed at all, a passage that
    many share comes last. The first shingle that two sets share, at positions p and q, leaves room for
    min(n - p, m - q) in common, so a pair with the similarity keeps at least that row. Of a shingle's
    holders only those outside its smallest component look for partners, so that a large component is not
    compared with itself, and a shingle with many of them is split.
    """
    texts = scratch.keep(left.join(crowd, F.col("doc") == F.col("doc_id")).select("doc", "component", "text"))
    table = texts.mapInArrow(_count(k, COUNTERS), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[table["slot"].to_numpy()] = table["n"].to_numpy()
    heads = scratch.keep(texts.mapInArrow(_heads(k, num, den, counts), HEADS))
    lowest = heads.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("holders")).where("lo < hi")
    open_heads = scratch.keep(heads.join(lowest.select("shingle", "lo", F.ceil(F.col("holders") / SPLIT).alias("splits")), "shingle"))
    seeking = open_heads.where("component > lo").withColumn("split", F.pmod(F.xxhash64("doc"), F.col("splits")))
    other = open_heads.select(
        "shingle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("split"), F.col("doc").alias("b"), F.col("n").alias("n_b"),
        F.col("component").alias("c_b"), F.col("pos").alias("pos_b"),
    )
    room = F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b"))
    return (
        seeking.join(other, ["shingle", "split"])
        .where((F.col("component") > F.col("c_b")) & _size_fits(F.col("n"), F.col("n_b"), num, den))
        .where(room * (num + den) >= (F.col("n") + F.col("n_b")) * num)
        .select(F.col("doc").alias("a"), "b")
        .distinct()
    )

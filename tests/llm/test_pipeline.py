"""The pipeline's stages hold what they promise, each on its own input."""

import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from corvina.llm import minhash, mixing, pii, rules
from corvina.llm.common import BATCH, document_chunks, materialise
from tests.llm.test_operators import plain_topics
from tests.llm.test_pii import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], sf_dir)))
    start, good, once, clean, mixed, encoded = seen
    assert all(d.columns == columns for d in (good, once, clean, mixed))
    verdict = {r.doc_id for r in rules.quality_rules(start).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == verdict
    assert once.count() == minhash.near_duplicates(good).where("kept").count()  # no id is repeated there
    assert clean.count() == once.count() and pii.span_report(clean).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert 0 < mixed.count() <= clean.count() and encoded.count() == mixed.count()
    assert encoded.where("n_tokens <> size(ids)").count() == 0


def test_dedup_rows_of_one_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a", None), (1, text, "b", 2), (1, "another one", "a", 3), (2, text + " x", "c", 4), (None, text, "d", 5), (None, None, None, None), (4, None, "e", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, maybe int")
    got = corpus_pipeline.dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([r for r in rows if r not in (rows[1], rows[3])], key=repr)
    assert corpus_pipeline.dedup(spark, docs.limit(0), "").count() == 0


def plainly_masked(text):
    marks = sorted((int(a), int(b), pii.PLACEHOLDER[k]) for k, a, b in (s.split(":") for s in brute(text)))
    out, at = "", 0
    for start, end, mark in marks:
        if start >= at:
            out += text[at:start] + mark
        at = max(at, end)
    return out + text[at:]


def test_whole_run_on_odd_rows(spark, sf_dir, tmp_path):
    """All stages over null and repeated ids, null texts and columns named like the stages' own."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    names = ["row", "doc", "print", "spans", "maybe", "keep", "tokens", "topic", "rated"]
    rows = [tuple(r) for r in table.collect()]
    at = table.columns.index
    change = lambda r, **new: tuple(new.get(c, v) for c, v in zip(table.columns, r, strict=True))
    rows += [rows[0], change(rows[1], doc_id=None), change(rows[2], doc_id=rows[3][at("doc_id")])]
    rows += [change(rows[4], doc_id=90_001, text=None), change(rows[4], doc_id=90_002, text=""), change(rows[5], doc_id=90_003, lang=None, source=None, text=rows[5][at("text")] + " more")]
    docs = spark.createDataFrame(rows, table.schema).selectExpr("*", *[f"'{n}' as `{n}`" for n in names])
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    came = {(r[at("doc_id")], digest(plainly_masked(r[at("text")] or ""))) for r in rows}
    went = [(r.doc_id, r.decoded_sha256) for r in got]  # what the ids decode to is a text as masked
    assert got and set(went) <= came and len(went) == len(set(went))
    assert not {90_001, 90_002} & {i for i, _ in went} and all(r.n_tokens == len(r.ids) for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_mixing_stage_draws_by_topics_of_all_documents(spark):
    """More documents than any sample held: the stage keeps what topics found on all of them in memory would keep."""
    rng = random.Random(9)
    words, shared = [[f"{s}{i}" for i in range(60)] for s in "abcdefghijk"], [f"z{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(shared if rng.random() < 0.6 else words[i % 11]) for _ in range(8 + i % 9)), "en", "web" if i % 4 else "news") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marks = {r.doc_id: (r.p, r.u) for r in docs.select("doc_id", F.xxhash64("text").alias("p"), mixing.uniform(F.col("doc_id")).alias("u")).collect()}
    centres = plain_topics([(marks[i][0], text) for i, text, *_ in rows])
    stratum, cells = {}, {}
    for a, b, found in document_chunks(pa.array([r[1] for r in rows]), lower=True):
        for i, topic in zip(range(a, b), mixing.nearest(*mixing.bags(found), centres), strict=True):
            stratum[i] = (rows[i][3], "en", f"topic {topic}")
            cells[stratum[i]] = cells.get(stratum[i], 0.0) + len(rows[i][1].split())
    raked = mixing.rake(spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens double"), None, mixing.BUDGET)
    keep = {(r.source, r.lang, r.topic): r.weight / r.tokens for r in raked.collect()}
    want = {i for i in stratum if marks[i][1] < keep[stratum[i]]}
    assert {r.doc_id for r in corpus_pipeline.mix(spark, docs, "").collect()} == want


def test_stages_hand_texts_to_workers_in_small_batches(spark, monkeypatch):
    """A task's texts reach its worker by BATCH bytes, not all at once, and every row comes."""
    key, texts = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 3000, 1, 1).selectExpr("id", "repeat(concat('word', id, ' '), 1000) as text")
    given, few = spark.conf.get(key), texts.selectExpr("id as doc_id", "text", "'en' as lang", "'web' as source", "length(text) as n_chars").limit(3)
    monkeypatch.setattr(minhash, "near_duplicates", lambda docs: docs.selectExpr("doc_id", "true as kept"))
    monkeypatch.setattr(mixing, "sample", lambda docs: docs)

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    try:
        for stage in (corpus_pipeline.dedup, corpus_pipeline.mix, corpus_pipeline.encode):
            spark.conf.set(key, given)
            assert stage(spark, few, "").count() == 3
            rows, most = texts.mapInArrow(measure, "rows long, bytes long").agg(F.sum("rows"), F.max("bytes")).first()
            assert rows == 3000 and most < 1.1 * BATCH
    finally:
        spark.conf.set(key, given)

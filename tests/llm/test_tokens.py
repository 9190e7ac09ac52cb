"""Unigram counting, encoding and decoding against the library itself."""

import itertools
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
import test_corpus
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

import corpus_pipeline
from vistaq.llm import counts, pieces, secrets, unigram
from vistaq.llm.queries import VOCABULARY, queries


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.Vocabulary.load(VOCABULARY)


@pytest.fixture(scope="module")
def library(vocabulary):
    """The library's own unigram tokenizer on the same pieces and scores."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(VOCABULARY, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece, score in zip(model.pieces, vocabulary.scores, strict=True):
        if score is not None:
            piece.score = score / unigram.SCALE
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


@pytest.fixture(scope="module")
def texts(sf):
    rng = random.Random(11)
    found = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()]
    odd = ["".join(rng.choice("ab \n▁ñ梦x<s>0😀\t") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return found + odd + ["", None, " ", "   ", "\n", "▁", "x" * 900, "a" + " " * 40 + "b"]


def test_ids_counts_and_texts_equal_the_library(vocabulary, library, texts):
    encoder, counter = pieces.Encoder(vocabulary), counts.Counter(vocabulary)
    for text in texts:
        want = library.encode(text or "")
        ids = np.frombuffer(encoder.ids(text), np.int32).tolist()
        assert ids == want
        assert counter.count(text) == len(want)
        assert unigram.decode(ids, vocabulary) == library.decode(want) == (text or "").replace("▁", " ")


@pytest.mark.parametrize("size", [1, 3, 17, 40, 333])
def test_chunks_equal_the_whole(vocabulary, texts, size):
    rng = random.Random(size)
    encoder = pieces.Encoder(vocabulary)
    solid = "".join(rng.choice("theradnoing") for _ in range(700))
    for text in [t for t in texts if t][-250:] + [solid]:
        assert pieces.encode_giant(text, encoder, size) == encoder.ids(text)


def test_transfer_matrices_combine_associatively(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    a, b, c = (pieces.Chunk(*x, encoder).matrix() for x in pieces.cuts(unigram.normalise("theratingandthe other one" * 2)[:60], 20))
    left, right = pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c))
    assert (left == right).all()


@pytest.mark.parametrize("fan", [pieces.FAN, 2])
def test_encoding_on_spark(spark, vocabulary, library, texts, fan):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, chunk string")
    got = pieces.encode(rows.repartition(3), vocabulary, ["doc_id"], giant=150, fan=fan).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, np.int32).tolist() == library.encode(text)
        assert r.same == ("▁" not in text)
    assert pieces.encode(rows.limit(0), vocabulary, ["doc_id"]).count() == 0


def test_counting_on_spark(spark, vocabulary, library, texts):
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_chars, r.n_tokens) for r in counts.count_tokens(rows, vocabulary).collect()}
    assert got == {i: (len(t or ""), len(library.encode(t or ""))) for i, t in enumerate(texts)}
    assert counts.count_tokens(rows.limit(0), vocabulary).count() == 0


def test_near_duplicates_go_by_row_where_doc_id_is_no_key(spark, sf):
    rows = [(4, "a b c d e f", 0), (4, "another text, a clean one", 1), (2, "a b c d e f", 2), (7, "one text twice here", 3), (7, "one text twice here", 4)]
    rows += [(None, "without an id at all", 5), (None, "without an id at all", 6), (None, None, 7), (None, None, 8), (9, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    single = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert single.columns == docs.columns
    found = sorted((r.doc_id, r.text, r.n) for r in single.where("doc_id is not null").collect())
    assert [(i, n) for i, _, n in found if i != 7] == [(2, 2), (4, 1), (9, 9)] and [i for i, _, _ in found].count(7) == 1
    assert sorted(str(r.text) for r in single.where("doc_id is null").collect()) == ["None", "None", "without an id at all"]


def test_pipeline_stages_keep_their_promises(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    q = queries()
    by_id = lambda name: {r.doc_id: r for r in q[name](spark, sf).collect()}
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in by_id("op8_quality_rules").items() if r.kept}
    single = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert {r.doc_id for r in single.collect()} == {i for i, r in by_id("op9_near_dedup").items() if r.kept}
    clean = corpus_pipeline.decontamination(spark, docs, sf)
    assert {r.doc_id for r in clean.collect()} == {i for i, r in by_id("op1_decontamination").items() if not r.contaminated}
    masked = {r.doc_id: r for r in corpus_pipeline.secret_masking(spark, docs, sf).collect()}
    found = by_id("op6_secret_scan")
    before = {r.doc_id: r.text for r in docs.collect()}
    assert {i for i, r in masked.items() if r.text != before[i]} == {i for i, r in found.items() if r.spans}
    assert all(r.n_chars == len(r.text) for r in masked.values())


def brute_force(rows, bench, library):
    """doc_id to ids of what the five stages leave, each restated in plain Python on what the one before kept."""
    rows = [r for r, (kept, margin) in zip(rows, test_corpus.verdicts([(r.text, r.lang) for r in rows])) if kept]
    rows.sort(key=lambda r: r.doc_id)
    rows = [r for i, (r, (_, root)) in enumerate(zip(rows, test_corpus.component_ids([r.text for r in rows]))) if i == root]
    rows = [r for r, (*_, bad) in zip(rows, test_corpus.contamination([r.text for r in rows], bench)) if not bad]
    spans, owners = {}, defaultdict(set)
    for r in rows:
        own = secrets.base_spans(r.text)
        more = secrets.candidate_spans(r.text, own)
        spans[r.doc_id] = [(s, e, None) for s, e, *_ in own] + [(s, e, v) for s, e, _, v in more]
        for *_, v in [*own, *more]:
            owners[v].add(r.source)
    out = {}
    for r in rows:
        gone = [False] * len(r.text)
        for s, e, v in spans[r.doc_id]:
            if v is None or len(owners[v]) < secrets.SHARED_OWNERS:
                gone[s:e] = [True] * (e - s)
        text = "".join(secrets.MASK if hidden else "".join(c for c, _ in run) for hidden, run in itertools.groupby(zip(r.text, gone), lambda x: x[1]))
        out[r.doc_id] = library.encode(text)
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_pipeline_equals_brute_force(spark, library, size):
    folder = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {r.doc_id: np.frombuffer(r.ids, np.int32).tolist() for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == brute_force(rows, bench, library)


def test_stages_take_repeated_rows_clashing_names_and_long_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.limit(40).collect()
    long = " ".join(r.text for r in rows) * 3
    frame = spark.createDataFrame([*rows, *rows[:5], (9001, long, "en", "src1", len(long))], docs.schema)
    for name in ("n_words", "kept", "base", "__hit", "__row", "component_id", "items", "chunk"):
        frame = frame.withColumn(name, F.lit("own"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, sf)
        assert out.columns == frame.columns and {r.n_words for r in out.select("n_words").distinct().collect()} <= {"own"}
        if name == "near_dedup":
            found = Counter(r.doc_id for r in out.collect())
            assert max(found.values()) == 1 and 9001 in found
        if name == "secret_scan":
            assert out.count() == frame.count()
    assert corpus_pipeline.encoding(spark, frame, sf).where("round_trip").count() == frame.count()


def test_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and all(r.round_trip for r in out)
    assert len({r.doc_id for r in out}) == len(out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "sentencepiece"]


def test_every_stage_takes_an_empty_table_and_nulls(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for odd in (docs.limit(0), docs.limit(2).unionByName(spark.createDataFrame([(None, None, None, None, None)] * 2, docs.schema))):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, odd, sf)
            assert out.count() <= odd.count()

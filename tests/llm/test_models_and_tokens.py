"""Token files, packing, sharding and the learned models."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratacast.llm.language import confident, fit_ftrl, fit_temperature, languages, softmax, Penalty
from stratacast.llm.packing import packed, sequence_ids, sum_of_squares
from stratacast.llm.sharding import number_at, permuted, sharded
from stratacast.llm.token_files import TokenFile, file_bytes, from_planes, new_root, read_token_files, to_planes, write_token_files
from stratacast.llm.tokens import Encoder
from stratacast.llm.toxicity import toxicity

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("path", "spaced"), [(BYTES, True), (WORDS, False)])
def test_chunked_ids_are_those_of_the_whole_text(path, spaced, texts):
    rng = random.Random(3)
    listed = [t[:20_000] for t in texts.values()] + ["", " ", "\n", "a \n", "  a\n\n\tb  ", "it's 'll\x01x \x1c y", "<|endoftext|> a"]
    listed += ["".join(rng.choice(" \n\t\r\x0bab'sé1., İΣǅ") for _ in range(50)) for _ in range(400)]
    found = []
    encoder = Encoder(path, spaced)
    for _ in range(2):  # the second time from the memo
        found = [ids[places[row]:places[row + 1]].tolist()
                 for first, stop, ids, places in encoder.encode(pa.array(listed)) for row in range(stop - first)]
    assert found == library(path)(listed)


@pytest.mark.parametrize("kind", ["bytes", "bits"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(0)
    for count in (1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)
        assert (from_planes(to_planes(ids, kind), kind, count) == ids).all()
    ids = rng.integers(0, 50_000, 200_000).astype(np.uint32)
    documents = np.array([(5, 0, 150_000, 0), (9, 150_000, 0, 0), (0, 150_000, 50_000, 1)])
    raw = file_bytes(documents, ids, kind)
    file = TokenFile(lambda at, size: raw[at:at + size])
    assert (file.ids(65_530, 20) == ids[65_530:65_550]).all() and not len(file.ids(3, 0))
    read = list(file.sequences())
    assert [(d, s, len(i)) for d, s, i in read] == [(5, 0, 150_000), (9, 150_000, 0), (None, 150_000, 50_000)]
    assert (np.concatenate([i for *_, i in read]) == ids).all()
    damaged = bytearray(raw)
    damaged[-1] ^= 1
    with pytest.raises(Exception):
        list(TokenFile(lambda at, size: bytes(damaged[at:at + size])).sequences())


def test_token_files_against_the_library(spark, frame, odd_rows):
    root = new_root(spark)
    write_token_files(frame(odd_rows), root, BYTES)
    got = sorted(read_token_files(spark, root).collect(), key=lambda r: r.start)
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for row, (doc_id, _), ids in zip(got, rows, library(BYTES)([t or "" for _, t in rows]), strict=True):
        whole = np.array([*ids, 2], "<u4")
        assert tuple(row) == (doc_id, start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)


def test_token_files_of_an_empty_table(spark, frame):
    root = new_root(spark)
    write_token_files(frame([]), root, BYTES)
    assert read_token_files(spark, root).count() == 0


def test_packing_places_every_piece_once(frame, odd_rows, spark):
    got = packed(frame(odd_rows), WORDS).collect()
    want = collections.Counter()
    for (doc_id, _), ids in zip(odd_rows, library(WORDS)([t or "" for _, t in odd_rows]), strict=True):
        whole = np.array([*ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(whole), 2048)):
            part = whole[start:start + 2048]
            want[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packed(frame([]), WORDS).count() == 0
    few = [(i, t) for i, t in odd_rows if i is not None and 26 <= i < 40]
    placed = packed(frame(few), WORDS).cache()
    sequences = {r.sequence_id: r.ids for r in sequence_ids(placed, frame(few), WORDS).collect()}
    for r in placed.collect():
        part = np.array(sequences[r.sequence_id][r.offset:r.offset + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32


def test_sum_of_squares_is_near_the_least_possible():
    lengths = np.random.default_rng(4).integers(1, 1500, 5000)
    sequence, offset = sum_of_squares(lengths, 2048, 0.3)
    ends = collections.defaultdict(int)
    for at in np.lexsort((offset, sequence)):
        assert offset[at] == ends[sequence[at]]
        ends[sequence[at]] += lengths[at]
    assert max(ends.values()) <= 2048 and len(ends) <= 1.01 * lengths.sum() / 2048 + 1


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1013, 5000])
def test_permutation_covers_all_places_and_inverts(spark, n):
    rows = spark.range(n).select("id", permuted(F.col("id"), n, 7).alias("place")).withColumn(
        "back", number_at((F.col("place") % 8).cast("int"), F.floor(F.col("place") / 8), n, 8, 7)
    ).collect()
    assert sorted(r.place for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n > 1000:
        moved = [r.place for r in sorted(rows)]
        assert abs(np.corrcoef(np.arange(n), moved)[0, 1]) < 0.1


def test_sharding_law(frame, odd_rows):
    got = sharded(frame(odd_rows)).collect()
    text = {i: t or "" for i, t in odd_rows}
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            raw = text[r.doc_id].encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert len(got) == len(odd_rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharded(frame(odd_rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharded(frame([])).count() == 0


def test_ftrl_learns_sparse_weights_and_temperature_helps():
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(300):
        label = int(rng.integers(0, 3))
        places = np.unique(np.append(rng.integers(100, 400, 20), label * 10))
        rows.append((label, places, np.full(len(places), len(places) ** -0.5)))
    weights = fit_ftrl(rows, 3, Penalty())
    assert np.mean([int((weights[:, p] @ v).argmax()) == y for y, p, v in rows]) > 0.98
    assert np.mean(weights == 0) > 0.98
    scores = np.array([[4.0, 0, 0]] * 6 + [[0, 4.0, 0]] * 4)
    temperature = fit_temperature(scores, np.zeros(10, int))
    assert abs(softmax(scores[0] / temperature)[0] - 0.6) < 0.15


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_on_held_out_documents(corpus):
    got = languages(corpus).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == corpus.count() and all(r.held_out == held(r.doc_id) for r in got)
    mine = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in mine]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(frame, odd_rows):
    got = languages(frame(odd_rows + [(400, "123 456 !"), (401, "½ ² 😀")])).collect()
    assert len(got) == len(odd_rows) + 2
    for r in got:
        if r.doc_id in (18, 19, 100, 400, 401):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    untaught = languages(frame(odd_rows).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}
    docs = frame(odd_rows)
    kept = confident(docs, 0.4)
    assert kept.columns == docs.columns and not {18, 19, 100} & {r.doc_id for r in kept.collect()}
    assert languages(frame([])).count() == 0 and confident(frame([]), 0.4).count() == 0


def test_toxicity_on_held_out_documents(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in toxicity(corpus, labels).collect()}
    assert len(got) == corpus.count() and all(r.held_out == held(i) for i, r in got.items())
    mine = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = ([s for s, t in mine if t == k] for k in (0, 1))
    wins = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert wins > 0.8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_toxicity_of_odd_rows(spark, frame, odd_rows):
    rng = random.Random(9)
    plain = [(500 + i, " ".join(rng.choice("lo mi kere sato vizu nuba".split()) for _ in range(60))) for i in range(80)]
    toxic = [(700 + i, t.replace("kere", "you badword")) for i, (_, t) in enumerate(plain)]
    labels = spark.createDataFrame(
        [(i, 0) for i, _ in plain] + [(i, 1) for i, _ in toxic] + [(None, 1), (3, None), (999_999, 1)], "doc_id long, toxic int"
    )
    rows = odd_rows + plain + toxic
    got = toxicity(frame(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == (r.doc_id >= 700) for r in got if (r.doc_id or 0) >= 500]) > 0.95
    none = toxicity(frame(odd_rows), labels.limit(0)).collect()
    assert len(none) == len(odd_rows) and {r.score for r in none} == {0.0}
    assert toxicity(frame([]), labels).count() == 0


def test_pipeline_keeps_columns_and_acts(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    kept = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/secrets").select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))

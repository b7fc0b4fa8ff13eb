"""Held-out accuracy, coverage of whole texts, gradients, odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfrank.llm import byte_cnn as bc, queries

SF = "/root/testdata/sf0.01"


def plain_maxima(net, raw):
    """Chunk by chunk, window by window."""
    data = list(raw)
    n = max(1, -(-(len(data) - bc.WIDTH) // bc.STRIDE) + 1)
    data += [bc.PAD] * ((n - 1) * bc.STRIDE + bc.WIDTH - len(data))
    answers = np.array([np.concatenate([net.embed[b] for b in data[i * bc.STRIDE : i * bc.STRIDE + bc.WIDTH]]) @ net.filters for i in range(n)])
    blocks = -(-n // bc.BLOCK)
    starts = range(0, max(1, blocks - (bc.CHUNK - bc.STEP)), bc.STEP)
    return np.array([np.maximum(answers[s * bc.BLOCK : (s + bc.CHUNK) * bc.BLOCK].max(0) + net.shift, 0) for s in starts])


def test_chunks_cover_the_whole_text():
    net = bc.ByteCNN(1)
    draw = random.Random(2)
    for size in (0, 1, 7, 8, 9, 255, 1027, 1028, 1029, 2500, 9001):
        raw = bytes(draw.randrange(256) for _ in range(size))
        want = plain_maxima(net, raw)
        got = net.chunk_maxima(np.frombuffer(raw, np.uint8).astype(np.int16))
        assert got.shape == want.shape and np.allclose(got, want, atol=1e-4)
        gathered = net.gathered(raw)
        assert np.allclose(gathered[: bc.FILTERS], want.mean(0), atol=1e-4) and np.allclose(gathered[bc.FILTERS :], want.max(0), atol=1e-4)


def test_long_texts_in_parts_give_the_same_answer():
    net = bc.ByteCNN(1)
    raw = random.Random(4).randbytes(600_001)
    want = plain = net.chunk_maxima(np.frombuffer(raw, np.uint8).astype(np.int16))
    got = net.gathered(raw)
    assert np.allclose(got[: bc.FILTERS], want.mean(0), atol=1e-4) and np.allclose(got[bc.FILTERS :], plain.max(0), atol=1e-5)


def test_training_learns_a_pattern_anywhere():
    draw = random.Random(3)
    texts, labels = [], []
    for i in range(400):
        body = bytearray(draw.choice(b"abcdefgh ") for _ in range(draw.randint(20, 3000)))
        if i % 2:
            for _ in range(1 + len(body) // 100):
                at = draw.randrange(len(body))
                body[at:at] = b"#$%"
        texts.append(bytes(body))
        labels.append(i % 2)
    net = bc.train(texts[:300], labels[:300], epochs=30)
    right = sum((net.score(t) >= 0.5) == bool(y) for t, y in zip(texts[300:], labels[300:]))
    assert right >= 90


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_byte_cnn(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    known = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    for label in (0, 1):
        mine = [p for y, p in known if y == label]
        assert sum(p == label for p in mine) >= 0.85 * len(mine)


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = queries.quality_network(docs, labels), queries.quality_network(docs, flipped)
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("embed", "filters", "shift", "weights", "bias"))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (None, "", 0.1), (2, "a" * 300000, None), (2, "a" * 300000, None)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 1), (2, 1, 0), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    # One label only: its smoothed share among the documents learnt from.
    known = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in (1, 2))
    net = queries.quality_network(docs, labels)
    got = bc.scored(docs, net).collect()
    assert known and len(got) == 4 and all(abs(r.score - (known + 1) / (known + 2)) < 1e-6 for r in got)
    none = queries.quality_network(docs.filter(F.lit(False)), labels)
    assert abs(none.score(b"any") - 0.5) < 1e-6
    assert bc.scored(docs.filter(F.lit(False)), net).count() == 0

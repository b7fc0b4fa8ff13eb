"""Counts against plain Python, verdicts on texts made to fail."""

import base64
import random
import re
from collections import Counter

import zstandard
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfrank.llm import compression_bands as cb, queries

SF = "/root/testdata/sf0.001"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    repeated = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=list("ab #\n\té\x85\xa0\x1c|  "), max_size=60))
def test_counts(text):
    assert cb.counts(text.encode()) == plain(text)


def test_counts_of_many_distinct_words():
    words = [str(i).encode() for i in range(3000)] * 2
    assert cb.repeated_words(words) == 6000 and cb.repeated_words(words[:3000]) == 0


def test_query_matches_plain_python(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op1_compression_bands(spark, SF).collect()
    pack = zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        raw = (texts[r.doc_id] or "").encode()
        assert r.kept == (not r.base_failed and cb.band_verdict(raw, pack)[3])


def test_clean_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = queries.op1_compression_bands(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("quality = 1 AND NOT base_failed")
    assert judged.filter("NOT kept").count() <= 0.01 * judged.count()


def test_bands_reject_repeats_and_noise():
    draw = random.Random(5)
    pack = zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 9)))
    prose = " ".join(word() for _ in range(3000))
    noise = base64.b85encode(draw.randbytes(9000)).decode()
    verdict = lambda text: cb.band_verdict(text.encode(), pack)[3]
    assert verdict(prose) and not verdict("buy it now. " * 900) and not verdict(noise)
    # Fair as a whole, bad in half of its chunks.
    ratio, n, share, fits = cb.band_verdict((prose[:9000] + "again and again " * 600).encode(), pack)
    assert 0.2 < ratio < 0.7 and share > 0.25 and not fits


def test_chunks_cover_all_bytes():
    for size in (1, 2047, 2048, 2049, 3071, 3072, 5000):
        raw = bytes(i % 251 for i in range(size))
        pieces = list(cb.chunks(raw, 2048))
        assert b"".join(pieces) == raw and all(1024 <= len(p) < 3072 or size < 1024 for p in pieces)


def test_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, True), (None, "", True), (3, "word " * 200000, False), (4, "one two", None), (4, "one two", None)], "doc_id bigint, text string, kept boolean")
    got = sorted(cb.quality_rules(frame).collect(), key=lambda r: (r.id is None, r.id))
    assert [(r.id, r.n_words, r.kept, r.base_failed) for r in got] == [(1, 0, False, True), (3, 200000, False, True), (4, 2, False, True), (4, 2, False, True), (None, 0, False, True)]
    assert got[0].ratio is None and got[1].n_repeat_words == 200000
    assert cb.quality_rules(frame.filter(F.lit(False))).count() == 0

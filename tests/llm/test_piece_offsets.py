"""Pieces, spans and decoding against the library, and the compiled character map on a model made for it."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfrank.llm import piece_offsets as po, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
DATA = open(PATH, "rb").read()
ODD = ["a", "b", " ", "  ", "e", "T", po.MARK, "\n", "\t", ".", "é", "漢字", "🎈", "\0", "<s>", "</s>", "<0x41>", "the", "ing", "　", "​", "ﬁ", "Å", "ab"]


@pytest.fixture(scope="module")
def own():
    return po.Model(DATA)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(ODD), max_size=25).map("".join)))
def test_like_the_library(own, library, text):
    raw = text.encode("utf-8", "replace")
    text = raw.decode()
    ids, begins, ends = (x.tolist() for x in own.encode(raw))
    assert ids == library.encode(text)
    assert own.decode(ids).decode() == library.decode(ids)
    # Spans follow each other and cover all bytes.
    assert begins == [0, *ends[:-1]][: len(ids)] and (not ids or ends[-1] == len(raw))


def test_any_ids_decode_like_the_library(own, library):
    draw = random.Random(1)
    for _ in range(3000):
        ids = [draw.choice((draw.randrange(700), draw.randrange(32000))) for _ in range(draw.randint(1, 6))]
        assert own.decode(ids).decode() == library.decode(ids)


def test_parts_of_long_texts(own, library):
    draw = random.Random(2)
    text = "".join(draw.choice(ODD) for _ in range(30000))
    norm = own.normalize(text.encode())[0].decode()
    for size in (1, 7, 100):
        assert "".join(own.parts(norm, size)) == norm
        assert [i for p in own.parts(norm, size) for i in own.merger.encode(p)] == library.encode(text)


def trie(rules):
    """A double array and its replacements for some rules, in the format of the model file."""
    text, places, tree = b"", {}, {}
    for key, value in rules.items():
        places[key] = len(text)
        text += value + b"\0"
        node = tree
        for byte in key:
            node = node.setdefault(byte, {})
        node["end"] = places[key]
    units, taken = {0: 0}, {0}
    work = [(0, tree)]
    while work:
        at, node = work.pop()
        labels = [0 if b == "end" else b for b in node]
        base = 1
        while any(((at ^ base) ^ b) in taken for b in labels) or base >= 1 << 21:
            base += 1
        units[at] = units.get(at, 0) | base << 10 | (1 << 8 if "end" in node else 0)
        for b, child in node.items():
            place = (at ^ base) ^ (0 if b == "end" else b)
            taken.add(place)
            if b == "end":
                units[place] = child | 1 << 31
            else:
                units[place] = b
                work.append((place, child))
    # A whole number of kilobytes.
    size = (max(units) // 256 + 2) * 256
    blob = b"".join(units.get(i, 0).to_bytes(4, "little") for i in range(size))
    return len(blob).to_bytes(4, "little") + blob + text


RULES = {"ﬁ".encode(): b"fi", "Å".encode(): "Å".encode(), "A".encode(): b"a", "AB".encode(): b"<ab>", "　".encode(): b" ", b"\t": b" ", "​".encode(): b"", "½".encode(): b" 1/2"}


@pytest.mark.parametrize("prefix,squeeze", [(1, 0), (0, 0), (1, 1), (0, 1)])
def test_character_map_like_the_library(prefix, squeeze):
    spec = po._field(1, b"made") + po._field(2, trie(RULES)) + bytes([3 << 3, prefix, 4 << 3, squeeze, 5 << 3, 1])
    data = b"".join(po._field(n, v) for n, v in po.fields(DATA) if n != po.NORMALIZER) + po._field(po.NORMALIZER, spec)
    own, library = po.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    draw = random.Random(5)
    for _ in range(1500):
        text = "".join(draw.choice([*ODD, "A", "AB", "½", "B", " "]) for _ in range(draw.randint(0, 14)))
        raw = text.encode()
        ids, begins, ends = (x.tolist() for x in own.encode(raw))
        assert ids == library.encode(text), text
        assert own.decode(ids).decode() == library.decode(ids)
        proto = library.encode(text, return_type="proto")
        spans = [(p.begin, p.end) for p in proto.pieces]
        # The library gives a character's byte pieces one span at the last of them.
        bytes_of = set(own.bytes.values())
        assert [(b, e) for i, b, e in zip(ids, begins, ends) if i not in bytes_of] == [s for i, s in zip(ids, spans) if i not in bytes_of], text


def test_replacements_keep_their_source():
    spec = po._field(2, trie(RULES)) + bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 1])
    own = po.Model(b"".join(po._field(n, v) for n, v in po.fields(DATA) if n != po.NORMALIZER) + po._field(po.NORMALIZER, spec))
    norm, source = own.normalize("xABﬁ　".encode())
    assert norm.decode() == "x<ab>fi▁" and source.tolist() == [0, 1, 1, 1, 1, 3, 3, 6, 6, 6, 9]


def test_query_like_the_library(spark, library):
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    got = {r.doc_id: r[1:] for r in queries.op8_piece_offsets(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {}
    for d in docs:
        ids = library.encode(d.text or "")
        want[d.doc_id] = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
    assert got == want


def test_odd_rows(spark, library):
    frame = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "word " * 100000, 3), (2, "word " * 100000, 3), (3, "é" * 20000, 4)], "doc_id bigint, text string, ids int")
    got = po.encoded(frame, DATA, decode=True).collect()
    assert [(r.id, len(r.ids), r.decoded) for r in got if r.id in (1, None)] == [(1, 0, ""), (None, 0, "")]
    for r in got:
        if r.id in (2, 3):
            text = "word " * 100000 if r.id == 2 else "é" * 20000
            assert r.ids == library.encode(text) and r.decoded == text and r.ends[-1] == len(text.encode())
    assert len(got) == 5 and po.encoded(frame.filter(F.lit(False)), DATA).count() == 0

"""SentencePiece encoding that keeps offsets, and decoding.

The model file is read here: pieces with scores, and the normaliser with its compiled
character map, a double-array trie of replacements. At each place of a text the longest
prefix found in the trie is replaced, or one character is copied, and for each normalised
byte the source byte it came from is recorded. The library merges the normalised text into pieces behind
an empty normaliser, and their ends are projected through that record to spans of the
original bytes.

No merge crosses from another character to a following space mark when no piece holds a mark
after another character. Then a long text is merged in parts, cut at such places.
"""

import re
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from shelfrank.llm.common import pick, ship

# Kinds of pieces, the space mark, the answer to an unknown piece, field numbers of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK, MARK_BYTES = "▁", "▁".encode()
UNKNOWN_TEXT = " ⁇ ".encode()
PIECES, TRAINER, NORMALIZER = 1, 2, 3
BPE = 2
# Characters the library merges at once; a cut lies between another character and a mark.
BLOCK = 4096
# Pieces a worker gathers before it hands them on.
BATCH = 200_000
CUT = re.compile(f"[^{MARK}](?={MARK})")


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; numbers as integers, the rest as bytes."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


def _field(number: int, value: bytes) -> bytes:
    """One field of bytes of a protocol buffer message."""
    size, out = len(value), bytearray([number << 3 | 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes([*out, size]) + value


class CharacterMap:
    """The compiled map: a double-array trie over source bytes, followed by the zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units, self.text = [], b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
            self.text = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix at ``at`` that has a replacement, and the replacement."""
        if not self.units:
            return None
        found, place = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(self.units):
                break
            unit = self.units[place]
            if unit & 0x800000FF != data[i]:
                break
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[place] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.text[found[1] : self.text.index(b"\0", found[1])]


def _character(first: int) -> int:
    """Bytes of the UTF-8 character that starts with ``first``."""
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Model:
    """A BPE model file: pieces, merges, normaliser and decoder."""

    def __init__(self, data: bytes):
        parts = list(fields(data))
        trainer = dict(x for n, v in parts if n == TRAINER for x in fields(v))
        norm = dict(x for n, v in parts if n == NORMALIZER for x in fields(v))
        if trainer.get(3, 1) != BPE or trainer.get(24, 0):
            raise ValueError("only BPE models with the space mark before a word can be read")
        self.map = CharacterMap(norm.get(2, b""))
        self.prefix, self.squeeze, self.escape = norm.get(3, 1), norm.get(4, 1), norm.get(5, 1)
        self.sizes: np.ndarray
        self.bytes: dict[int, int] = {}
        self.decoded: list[bytes] = []
        self.unknown, self.marked, self.by_parts, sizes = 0, set(), True, []
        for i, piece in enumerate(v for n, v in parts if n == PIECES):
            p = dict(fields(piece))
            text, kind = p[1].decode(), p.get(3, NORMAL)
            plain = text.replace(MARK, " ").encode()
            if kind == BYTE:
                plain = bytes([int(text[3:5], 16)])
                self.bytes[plain[0]] = i
            elif kind == UNKNOWN:
                self.unknown, plain = i, UNKNOWN_TEXT
            elif kind == CONTROL:
                plain = b""
            elif kind in (USER, UNUSED):
                raise ValueError("models with user-defined or unused pieces can't be read")
            else:
                if text.startswith(MARK):
                    self.marked.add(i)
                self.by_parts &= MARK not in text.lstrip(MARK)
            self.decoded.append(plain)
            sizes.append(1 if kind == BYTE else len(p[1]))
        self.sizes = np.array(sizes, np.int64)
        # The same pieces behind a normaliser that leaves normalised text as it is: no prefix, no squeezing, marks for spaces.
        as_is = b"".join(bytes([number << 3, value]) for number, value in ((3, 0), (4, 0), (5, self.escape)))
        pieces = b"".join(_field(n, v) for n, v in parts if n != NORMALIZER)
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=pieces + _field(NORMALIZER, as_is))

    def normalize(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the source byte it starts at."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        space = MARK_BYTES if self.escape else b" "
        if not self.map.units and not self.squeeze:
            return self._escaped(raw, space)
        out, source, at = bytearray(), array("q"), 0
        if self.squeeze:
            while at < len(raw):
                size, text = self._next(raw, at)
                if text != b" ":
                    break
                at += size
            if at == len(raw):
                return b"", np.zeros(1, np.int64)
        if self.prefix:
            out += space
            source.extend([at] * len(space))
        after_space = bool(self.squeeze)
        while at < len(raw):
            size, text = self._next(raw, at)
            while after_space and text.startswith(b" "):
                text = text[1:]
            if text:
                text, after_space = text.replace(b" ", space), text.endswith(b" ") and bool(self.squeeze)
                out += text
                source.extend([at] * len(text))
            elif not self.squeeze:
                after_space = False
            at += size
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = source[len(out)]
                del source[len(out) :]
        source.append(at)
        return bytes(out), np.frombuffer(source, np.int64).copy()

    def _next(self, raw: bytes, at: int) -> tuple[int, bytes]:
        return self.map.longest(raw, at) or ((n := _character(raw[at])), raw[at : at + n])

    def _escaped(self, raw: bytes, space: bytes) -> tuple[bytes, np.ndarray]:
        """``normalize`` where the map is empty: characters are copied, spaces are marked."""
        data = np.frombuffer(raw, np.uint8)
        wide = np.where(data == 32, len(space), 1)
        head = len(space) if self.prefix else 0
        source = np.concatenate([np.zeros(head, np.int64), np.repeat(np.arange(len(raw)), wide), [len(raw)]])
        return (space if self.prefix else b"") + raw.replace(b" ", space), source

    def parts(self, text: str, size: int = BLOCK):
        """The normalised text in parts of about ``size`` characters, cut where no merge can cross; whole where merges might."""
        at = 0
        while self.by_parts and len(text) - at > size and (cut := CUT.search(text, at + size)):
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:]

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends) of a whole text; spans are in its own bytes."""
        norm, source = self.normalize(raw)
        if not norm:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = list(self.parts(norm.decode()))
        ids = np.concatenate([np.array(self.merger.encode(p, num_threads=1), np.int32) for p in parts])
        sizes = self.sizes[ids]
        if not self.bytes and (ids == self.unknown).any():
            sizes = np.array([len(x.encode()) for p in parts for x in self.merger.encode(p, out_type=str, num_threads=1)], np.int64)
        ends = np.cumsum(sizes)
        return ids, source[ends - sizes], source[ends]

    def decode(self, ids) -> bytes:
        """The text of some ids: marks become spaces, the first piece's leading one goes if the normaliser adds one, and all leading ones if it squeezes spaces."""
        table = self.decoded
        texts = [table[i] for i in ids]
        if self.prefix or self.squeeze:
            for at, i in enumerate(ids):
                if i in self.marked:
                    texts[at] = texts[at][1:]
                if texts[at] or i in self.marked and not self.squeeze:
                    break
        out = b"".join(texts)
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return _valid(out)


def _valid(data: bytes) -> bytes:
    """Each byte that starts no character becomes the replacement character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                data[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(data[at : at + size])
            at += size
            break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


def encoded(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, ids, begins, ends) of every row: the pieces of the whole text and their spans in its UTF-8 bytes.

    ``model`` is the model file's content (some hundred kilobytes, sent along with the job). No begin or end ids, no
    sampling. With ``decode``, ``decoded`` is the text the ids decode to. A null text is
    encoded as an empty one: no pieces. Pieces made by the normaliser alone have empty spans;
    of a character in byte pieces each piece has its byte. Repeated rows are encoded each.
    """
    kind = "id " + dict(df.dtypes)[id_col] + ", ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decode
    names = ["id", "ids", "begins", "ends", "decoded"][: 4 + decode]

    def batch_of(keys, made):
        cuts = pa.array(np.concatenate([[0], np.cumsum([len(m[0]) for m in made])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([m[i] for m in made]).astype(np.int32))) for i in range(3)]
        return pa.RecordBatch.from_arrays([keys, *lists] + [pa.array([m[3] for m in made], pa.string())] * decode, names)

    def run(batches):
        read = Model(model)
        for batch in batches:
            keys, texts, made, first, held = batch.column(0), batch.column(1), [], 0, 0
            for row in range(len(texts)):
                ids, begins, ends = read.encode(texts[row].as_py() or b"")
                made.append((ids, begins, ends, read.decode(ids.tolist()).decode() if decode else None))
                held += len(ids)
                # Results go back in batches of bounded size.
                if held >= BATCH or row == len(texts) - 1:
                    yield batch_of(keys.slice(first, len(made)), made)
                    made, first, held = [], row + 1, 0

    return pick(df, id=id_col, text=text_col).select("id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, kind)


def joined_ids(ids: Column) -> Column:
    """Ids as decimals joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


ship(__name__)

"""Quality rules: compression ratios against bands that depend on the length, beside counts of words, lines and repeats.

Repetitive text compresses too well, random or encoded text hardly at all, and both limits
move with the length, since a compressor needs some text to find repeats in. Each text is
judged as a whole and in fixed chunks: a long text with a stuffed middle has a fair ratio
as a whole, but bad chunks.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from shelfrank.llm.common import pick, ship, utf8


@dataclass(frozen=True)
class Band:
    """Ratios of compressed to plain bytes allowed for texts from ``from_bytes`` on, up to the next band."""

    from_bytes: int
    low: float
    high: float


# Prose in Latin letters lies 0.06 or more inside these limits at zstandard level 3.
BANDS = (
    Band(0, 0.30, 8.00),
    Band(100, 0.40, 1.30),
    Band(300, 0.36, 0.95),
    Band(600, 0.34, 0.85),
    Band(1200, 0.30, 0.80),
    Band(2500, 0.27, 0.75),
    Band(5000, 0.24, 0.72),
    Band(10000, 0.20, 0.70),
)
CHUNK_BYTES = 2048
BAD_SHARE = 0.25
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
MADE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_bytes bigint, ratio double, n_chunks bigint, bad_share double, in_band boolean"


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more, each word counted once."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key, values = numbers[:n], len(ids)
    for at in range(1, size):
        if values * len(ids) >= 2**62:
            seen, key = np.unique(key, return_inverse=True)
            values = len(seen)
        key = key * len(ids) + numbers[at : at + n]
        values *= len(ids)
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[place] > 1
    inside = np.zeros(len(words), bool)
    for at in range(size):
        inside[at : at + n] |= again
    return int(inside.sum())


def counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines and words in repeated windows of one text."""
    words = raw.split()
    letters = raw.translate(None, SPACE)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(letters.decode("utf-8", "replace")),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def chunks(raw: bytes, size: int):
    """Consecutive pieces of ``size`` bytes; a rest of less than half joins the piece before."""
    cuts = [*range(0, len(raw), size)]
    if len(cuts) > 1 and len(raw) - cuts[-1] < size // 2:
        cuts.pop()
    return (raw[i:j] for i, j in zip(cuts, [*cuts[1:], len(raw)]))


def band_verdict(raw: bytes, pack, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE):
    """(ratio, chunks, share of bytes in chunks outside their band, verdict) of one text; an empty one fails."""
    if not raw:
        return None, 0, 0.0, False
    starts = [b.from_bytes for b in bands]

    def ratio_of(piece):
        ratio = len(pack(piece)) / len(piece)
        band = bands[int(np.searchsorted(starts, len(piece), "right")) - 1]
        return ratio, band.low <= ratio <= band.high

    whole, fits = ratio_of(raw)
    if len(raw) <= chunk_bytes:
        return whole, 1, 0.0 if fits else 1.0, fits
    n = bad = 0
    for piece in chunks(raw, chunk_bytes):
        n += 1
        bad += 0 if ratio_of(piece)[1] else len(piece)
    return whole, n, bad / len(raw), fits and bad <= bad_share * len(raw)


def verdict_udf(bands=BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE, level: int = 3):
    """A column function from the bytes of a text to its counts, ratio, chunk figures and verdict."""

    @F.pandas_udf(MADE)
    def judge(texts: pd.Series) -> pd.DataFrame:
        pack = zstandard.ZstdCompressor(level=level, write_content_size=False).compress
        made = [(*counts(raw), len(raw), *band_verdict(raw, pack, bands, chunk_bytes, bad_share)) for raw in texts]
        return pd.DataFrame(made, columns=[c.split()[0] for c in MADE.split(", ")]).astype({"ratio": "float64"})

    return judge


def base_failed(made: Column, least_words: int = 50, most_repeated: float = 0.5) -> Column:
    """Few words, or too many of them in repeated windows."""
    return (made["n_words"] < least_words) | (100 * made["n_repeat_words"] > 100 * most_repeated * made["n_words"])


def kept_by(made: Column, **limits) -> Column:
    """Passed by the base rules and by the bands."""
    return ~base_failed(made, **limits) & made["in_band"]


def compression_bands(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row (id, counts, ratio, chunk figures, in_band) for each row of ``df``, over whole texts.

    ``in_band`` holds where the whole text's ratio lies in the band of its length and at
    most ``bad_share`` of its bytes lie in chunks outside theirs. A null text counts as
    empty: no words, null ratio, not in band. Repeated rows are judged each; other columns
    are not carried; an empty table gives no rows. ``limits`` are those of ``verdict_udf``.
    """
    judge = verdict_udf(**limits)
    return pick(df, id=id_col, text=text_col).select("id", judge(utf8(F.col("text"))).alias("made")).select("id", "made.*", "made")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``compression_bands`` with two more verdicts: ``base_failed`` and ``kept``."""
    judged = compression_bands(df, id_col, text_col, **limits)
    return judged.withColumns({"base_failed": base_failed(F.col("made")), "kept": kept_by(F.col("made"))}).drop("made")


ship(__name__)

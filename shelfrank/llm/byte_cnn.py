"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes become small learned vectors. Learned filters see windows of 8 bytes, each 4 bytes
after the one before. Windows are gathered into chunks that overlap by a quarter and cover
the whole text; each chunk keeps every filter's largest answer. The mean and the maximum
of these over the chunks meet in one logistic unit.

The network is trained on a bounded sample of labelled rows on the driver; texts are
scored where they lie.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfrank.llm.common import pick, ship, utf8

WIDTH, STRIDE, FILTERS, EMBED = 8, 4, 32, 4
# A block is 64 windows; a chunk is 4 blocks, and the next one starts 3 blocks later.
BLOCK, CHUNK, STEP = 64, 4, 3
PAD = 256


class ByteCNN:
    """Weights of the network; ``score`` gives the probability of label 1."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.embed = draw.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        self.filters = draw.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.weights = np.zeros(2 * FILTERS, np.float32)
        self.bias = np.zeros(1, np.float32)

    def windows(self, raw: np.ndarray) -> np.ndarray:
        """(windows, width * embed) of some bytes; the last window is filled up with padding."""
        n = max(1, -(-(len(raw) - WIDTH) // STRIDE) + 1)
        room = (n - 1) * STRIDE + WIDTH
        if room > len(raw):
            raw = np.concatenate([raw, np.full(room - len(raw), PAD, raw.dtype)])
        vectors = self.embed[raw]
        return np.lib.stride_tricks.as_strided(vectors, (n, WIDTH * EMBED), (STRIDE * vectors.strides[0], vectors.strides[1]))

    def chunk_maxima(self, raw: np.ndarray) -> np.ndarray:
        """(chunks, filters): each filter's largest answer in each chunk."""
        answers = self.windows(raw) @ self.filters
        blocks = np.maximum.reduceat(answers, np.arange(0, len(answers), BLOCK), axis=0)
        starts = np.arange(0, max(1, len(blocks) - (CHUNK - STEP)), STEP)
        pairs = np.stack([starts, np.minimum(starts + CHUNK, len(blocks))], 1).ravel()
        over = np.concatenate([blocks, blocks[-1:]])
        return np.maximum(np.maximum.reduceat(over, pairs, axis=0)[::2] + self.shift, 0)

    def gathered(self, raw: bytes) -> np.ndarray:
        """Mean and maximum over all chunks; long texts go through in parts of whole chunks, so memory is bounded."""
        data = np.frombuffer(raw, np.uint8).astype(np.int16)
        step = BLOCK * STEP * STRIDE
        part = 256 * step
        reach = BLOCK * (CHUNK - STEP) * STRIDE + WIDTH - STRIDE
        total, most, n = np.zeros(FILTERS, np.float64), np.zeros(FILTERS, np.float32), 0
        for at in range(0, max(1, len(data)), part):
            if at and len(data) - at <= reach:
                break
            found = self.chunk_maxima(data[at : at + part + reach])
            total += found.sum(0)
            most = np.maximum(most, found.max(0))
            n += len(found)
        return np.concatenate([(total / n).astype(np.float32), most])

    def score(self, raw: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.gathered(raw) @ self.weights + self.bias[0], -30, 30))))


def train(texts: list[bytes], labels: list[int], epochs: int = 8, batch: int = 64, rate: float = 0.01, most_chunks: int = 12, seed: int = 7) -> ByteCNN:
    """Fits the network by Adam on the labelled texts; of a long text ``most_chunks`` evenly spread chunks are taken, the same in all epochs.

    The two labels weigh the same in sum. With one label only, or none, the network answers that label's smoothed share.
    """
    net = ByteCNN(seed)
    target = np.asarray(labels, np.float32)
    good = float(target.sum())
    share = (good + 1) / (len(target) + 2)
    if good in (0, len(target)):
        net.bias[0] = np.log(share / (1 - share))
        return net
    draw = np.random.default_rng(seed)
    weight = np.where(target == 1, len(target) / (2 * good), len(target) / (2 * (len(target) - good))).astype(np.float32)
    size = BLOCK * CHUNK
    reach = (size - 1) * STRIDE + WIDTH
    step = BLOCK * STEP * STRIDE
    sheets, owners = [], []
    for i, raw in enumerate(texts):
        data = np.frombuffer(raw, np.uint8).astype(np.int16)
        starts = np.arange(0, max(1, len(data) - (reach - step)), step)
        if len(starts) > most_chunks:
            starts = starts[np.linspace(0, len(starts) - 1, most_chunks).round().astype(int)]
        for at in starts:
            sheet = np.full(reach, PAD, np.int16)
            sheet[: len(data[at : at + reach])] = data[at : at + reach]
            sheets.append(sheet)
            owners.append(i)
    sheets, owners = np.stack(sheets), np.asarray(owners)
    first = np.searchsorted(owners, np.arange(len(texts) + 1))
    names = ("embed", "filters", "shift", "weights", "bias")
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names}
    offsets = np.arange(WIDTH)
    t = 0
    for epoch in range(epochs):
        order = draw.permutation(len(texts))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            counts = first[docs + 1] - first[docs]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), counts)
            data = sheets[rows]
            vectors = net.embed[data]
            view = np.lib.stride_tricks.as_strided(vectors, (len(rows), size, WIDTH * EMBED), (vectors.strides[0], STRIDE * vectors.strides[1], vectors.strides[2]))
            flat = np.ascontiguousarray(view).reshape(-1, WIDTH * EMBED)
            answers = (flat @ net.filters).reshape(len(rows), size, FILTERS)
            # Windows of padding alone stay out, but for the first.
            filled = np.maximum(1, -(-((data != PAD).sum(1) - WIDTH) // STRIDE) + 1)
            answers[np.arange(size)[None, :] >= filled[:, None]] = -np.inf
            where = answers.argmax(1)
            top = np.take_along_axis(answers, where[:, None, :], 1)[:, 0] + net.shift
            found = np.maximum(top, 0)
            bounds = np.concatenate([[0], np.cumsum(counts)[:-1]])
            mean = np.add.reduceat(found, bounds, axis=0) / counts[:, None]
            most = np.maximum.reduceat(found, bounds, axis=0)
            inputs = np.concatenate([mean, most], 1)
            p = 1 / (1 + np.exp(-np.clip(inputs @ net.weights + net.bias[0], -30, 30)))
            error = ((p - target[docs]) * weight[docs] / len(docs)).astype(np.float32)
            back = error[:, None] * net.weights[None, :]
            is_most = found == most[own]
            ties = np.add.reduceat(is_most.astype(np.float32), bounds, axis=0)
            down = back[own, :FILTERS] / counts[own, None] + back[own, FILTERS:] * is_most / ties[own]
            down *= top > 0
            chosen = flat.reshape(len(rows), size, -1)[np.arange(len(rows))[:, None], where]
            grads = {
                "filters": np.einsum("rf,rfk->kf", down, chosen, optimize=True),
                "shift": down.sum(0),
                "weights": inputs.T @ error + 1e-4 * net.weights,
                "bias": error.sum(keepdims=True),
            }
            spread = (down[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            seen = data[np.arange(len(rows))[:, None, None], (where * STRIDE)[:, :, None] + offsets].ravel()
            grads["embed"] = np.stack([np.bincount(seen, spread[:, e], 257) for e in range(EMBED)], 1)
            grads["embed"][PAD] = 0
            t += 1
            pace = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs)) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
            for k in names:
                m, v = moments[k]
                g = grads[k].astype(np.float32)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(net, k)[...] -= pace * m / (np.sqrt(v) + 1e-8)
    return net


def labelled_sample(df: DataFrame, labels: DataFrame, learn: Column, most_rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_bytes: int = 2**20) -> DataFrame:
    """At most ``most_rows`` labelled rows (raw, label), those of the smallest id hashes where ``learn`` holds.

    Ids with a null label are left out; of several labels of an id the smallest counts, and of
    several texts one. At most ``most_rows`` ids are sent to the scan of the texts, and texts
    over ``most_bytes`` are not trained on, so the driver gets a bounded number of bytes.
    """
    known = pick(labels, id=id_col, label=label_col).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    drawn = known.filter(learn).groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = pick(df, id=id_col, text=text_col).join(F.broadcast(drawn), "id").select("id", "label", utf8(F.col("text")).alias("raw"))
    return texts.filter(F.octet_length("raw") <= most_bytes).groupBy("id").agg(F.min(F.struct("label", "raw")).alias("one")).orderBy("id").select("one.raw", "one.label")


def fit(sample: DataFrame, **how) -> ByteCNN:
    """The network trained on a bounded sample (raw, label)."""
    rows = sample.collect()
    return train([bytes(r.raw) for r in rows], [r.label for r in rows], **how)


def scored(df: DataFrame, net: ByteCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row over its whole text. Null and empty texts get the score of one padded window; repeated rows are scored each."""
    return pick(df, id=id_col, text=text_col).select("id", scorer(net)(utf8(F.col("text"))).alias("score"))


def scorer(net: ByteCNN):
    """A column function from the bytes of a text to its score."""

    @F.pandas_udf("double")
    def score(raw: pd.Series) -> pd.Series:
        return pd.Series([net.score(x) for x in raw], dtype="float64")

    return score


ship(__name__)

"""A byte-level convolutional network in numpy that tells good documents from bad ones.

A text's UTF-8 bytes are cut into chunks that overlap by a filter's width, so that the filters pass over every byte of
the whole document. Bytes are embedded, each filter looks at ``width`` bytes at every place (while it is trained, at every
``stride``-th place from a start drawn anew each time), and its rectified responses are max-pooled within the chunk. The chunk vectors are pooled again over the document, by their
maximum and their mean, and combined into one probability. Embedding, filters and output are learned by gradient
descent (Adam) on a bounded labelled sample; labels are weighed by their true shares. The cut with the best F1 for the
rarer label becomes ``THRESHOLD`` of the score.

A null text counts as empty; empty texts get the score of a document whose filters never respond. With only one
label to learn from, every score is 1. Equal texts get equal scores; outputs replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import label_counts, labelled_texts
from .shared import once, small_batches

THRESHOLD = 0.3
OUTPUTS = ("score", "n_chunks")


@dataclass
class ByteCnn:
    embedding: np.ndarray  # 256 x d
    filters: np.ndarray  # (width * d) x f
    bias: np.ndarray  # f
    out: np.ndarray  # 2f: for the maximum over chunks, then for the mean
    shift: float
    width: int
    stride: int
    chunk: int
    cut: float = 0.5

    def windows(self, raw: np.ndarray) -> np.ndarray:
        """places x (width * d): what each filter sees, at every stride-th byte."""
        d = self.embedding.shape[1]
        seen = self.embedding[raw]
        places = (len(raw) - self.width) // self.stride + 1
        return np.lib.stride_tricks.as_strided(seen, (places, self.width * d), (self.stride * seen.strides[0], seen.strides[1]))

    def pooled(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Maximum and mean over chunks of the chunks' max-pooled responses, and how many chunks there are."""
        if len(raw) < self.width:
            raw = np.concatenate((raw, np.zeros(self.width - len(raw), np.uint8)))
        per_chunk = max(1, self.chunk // self.stride)  # places of a chunk
        block = per_chunk * 64
        highest, total, chunks = np.zeros(len(self.bias), np.float32), np.zeros(len(self.bias), np.float64), 0
        places = (len(raw) - self.width) // self.stride + 1
        for at in range(0, places, block):  # bounded memory for texts of any length
            n = min(block, places - at)
            piece = raw[at * self.stride : (at + n - 1) * self.stride + self.width]
            answers = self.windows(piece) @ self.filters
            tops = np.maximum.reduceat(answers, np.arange(0, n, per_chunk), axis=0) + self.bias
            np.maximum(tops, 0, out=tops)
            np.maximum(highest, tops.max(0), out=highest)
            total += tops.sum(0)
            chunks += len(tops)
        return highest, (total / max(1, chunks)).astype(np.float32), chunks

    def probability(self, text: str | None) -> tuple[float, int]:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        highest, mean, chunks = self.pooled(raw)
        z = float(np.concatenate((highest, mean)) @ self.out + self.shift)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), chunks

    def score(self, text: str | None) -> tuple[float, int]:
        p, chunks = self.probability(text)
        return float(THRESHOLD * p / self.cut if p < self.cut else THRESHOLD + (1 - THRESHOLD) * (p - self.cut) / (1 - self.cut)), chunks


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", key: str = "doc_id", per_class: int = 1500, max_bytes: int = 16 << 20, d: int = 8, f: int = 32, width: int = 8, stride: int = 2, chunk: int = 512, epochs: int = 12, seed: int = 5) -> ByteCnn | None:
    """Learns from whole texts of at most ``per_class`` rows and ``max_bytes`` bytes of each label."""
    counts = label_counts(labels, label)
    rows = labelled_texts(docs, labels, label=label, key=key, text=text, per_class=per_class, max_bytes=max_bytes)
    y = np.array([r["label"] for r in rows], np.float32)
    if len({*y.tolist()}) < 2:
        return None
    raws = [np.frombuffer(r["text"].encode("utf-8", "surrogatepass"), np.uint8) for r in rows]
    return train(raws, y, counts, d=d, f=f, width=width, stride=stride, chunk=chunk, epochs=epochs, seed=seed)


def train(raws: list[np.ndarray], y: np.ndarray, counts: dict[int, int], *, d: int, f: int, width: int, stride: int, chunk: int, epochs: int, seed: int) -> ByteCnn:
    rng = np.random.default_rng(seed)
    net = ByteCnn(rng.normal(0, 0.5, (256, d)).astype(np.float32), rng.normal(0, 1 / np.sqrt(width * d), (width * d, f)).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, 0.1, 2 * f).astype(np.float32), 0.0, width, stride, chunk)
    share = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum()))
    share = (share / share.mean()).astype(np.float32)
    share = np.sqrt(share)  # between the true shares and even ones, so that the rarer label is learned as well
    names = ("embedding", "filters", "bias", "out")
    first, second, step = {n: 0.0 for n in (*names, "shift")}, {n: 0.0 for n in (*names, "shift")}, 0
    per_chunk = max(1, chunk // stride)
    for epoch in range(epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(raws))
        for at in range(0, len(order), 32):
            grads = {n: np.zeros_like(getattr(net, n)) for n in names} | {"shift": 0.0}
            own = order[at : at + 32]
            for i in own:
                raw = raws[i] if len(raws[i]) >= width else np.concatenate((raws[i], np.zeros(width - len(raws[i]), np.uint8)))
                start = int(rng.integers(0, max(1, stride)))  # so that the filters see every alignment
                raw = raw[start:] if len(raw) - start >= width else raw
                seen = net.windows(raw)
                answers = seen @ net.filters
                starts = np.arange(0, len(answers), per_chunk)
                where = np.stack([a + answers[a : a + per_chunk].argmax(0) for a in starts])  # chunks x f
                tops = np.maximum(np.take_along_axis(answers, where, 0) + net.bias, 0)
                best, mean = tops.argmax(0), tops.mean(0)
                highest = tops[best, np.arange(f)]
                z = float(np.concatenate((highest, mean)) @ net.out + net.shift)
                error = float(share[i]) * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - float(y[i])) / len(own)
                grads["out"] += error * np.concatenate((highest, mean))
                grads["shift"] += error
                back = np.repeat((error * net.out[f:] / len(tops))[None, :], len(tops), 0)
                back[best, np.arange(f)] += error * net.out[:f]
                back = np.where(tops > 0, back, 0)
                grads["bias"] += back.sum(0)
                places, inverse = np.unique(where, return_inverse=True)
                slope = np.zeros((len(places), f), np.float32)
                np.add.at(slope, (inverse.reshape(where.shape), np.broadcast_to(np.arange(f), where.shape)), back)
                used = seen[places]
                grads["filters"] += used.T @ slope
                into = (slope @ net.filters.T).reshape(len(places) * width, -1)
                np.add.at(grads["embedding"], raw[(places[:, None] * stride + np.arange(width)).ravel()], into)
            step += 1
            for n, g in grads.items():
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                move = rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                new = getattr(net, n) - move
                setattr(net, n, float(new) if n == "shift" else new.astype(np.float32))
    net.stride = 1
    guess = np.array([1 / (1 + np.exp(-np.clip(float(np.concatenate(net.pooled(r)[:2]) @ net.out + net.shift), -30, 30))) for r in raws])
    weight = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum()))
    rare = 0 if counts[0] <= counts[1] else 1
    order = np.argsort(guess if rare == 0 else -guess, kind="stable")
    hits, taken = np.cumsum((weight * (y == rare))[order]), np.cumsum(weight[order])
    best = int(np.argmax(2 * hits / (taken + (weight * (y == rare)).sum())))
    after = guess[order][min(best + 1, len(order) - 1)]
    net.cut = float(np.clip((guess[order][best] + after) / 2, 0.02, 0.98))
    return net


def scored(df: DataFrame, net: ByteCnn | None, *, text: str = "text") -> DataFrame:
    """``df`` with score (0 to 1; THRESHOLD and more: label 1) and n_chunks."""
    from .byte_bpe import unpacked

    small_batches(df.sparkSession)
    key = hashlib.sha256(b"".join(x.tobytes() for x in (net.embedding, net.filters, net.out)) if net else b"").hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(net)  # some ten thousand numbers

    @F.arrow_udf("struct<score: double, n_chunks: bigint>")
    def run(texts: pa.Array) -> pa.Array:
        own = once(("byte_cnn", key), lambda: sent.value)
        rows = [(1.0, 0) if own is None else own.score(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.float64(), pa.int64()))], names=list(OUTPUTS))

    return unpacked(df, run(F.col(text)), OUTPUTS)

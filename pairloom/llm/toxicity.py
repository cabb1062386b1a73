"""Toxicity by compression distance.

Two Zstandard dictionaries are trained (by the library's cover algorithm, with entropy tables) on a bounded labelled
sample. The ordinary one is trained on windows of ordinary documents. A toxic document is ordinary text for the most
part, so the toxic one is trained on its passages: stretches from a word's beginning whose bytes stand in more toxic
than ordinary documents than chance explains. It holds the ordinary dictionary's content as well, after its own, so that
ordinary text is compressed alike by both and a difference in length tells of toxic text.

A text is lower-cased and cut into overlapping windows of ``window`` bytes, whatever their words; all are compressed
with both dictionaries, and a window's gain is by how many bytes the toxic form is shorter. How many windows reach each
of some gains, the largest gain and the mean are weighed by a logistic model with each label's true weight. It is
fitted, and its cut chosen (by the F measure that counts recall twice), on gains of rows that the dictionaries which gave them had not seen:
each of ``folds`` parts of the sample is scored by dictionaries of the others. The cut becomes ``THRESHOLD`` of the score.

All windows of a text are counted. Nulls and texts that are empty have no window. With only one label to
learn from, every score is 0. Equal texts get equal scores; outputs replace input columns of the same name. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import label_counts, labelled_texts
from .shared import give_back, once, small_batches

THRESHOLD = 0.7
OUTPUTS = ("score", "max_gain", "n_windows")
#: Bytes of the ASCII letters in lower case and of all that is not ASCII count as letters.
NOT_LETTERS = re.compile(rb"[^a-z\x80-\xff]+")
IS_LETTER = np.array([97 <= c < 123 or c >= 128 for c in range(256)])
#: How many bytes of a word's beginning are looked at, the blank before it included.
LENGTHS = (5, 6, 7, 8, 10, 12)
GAINS = (1, 2, 3, 4, 5, 6, 8)
#: Gains are counted from LEAST to MOST; those beyond count as these.
LEAST, MOST = -1, 24
#: What a trained dictionary begins with (a fixed value of the format).
MAGIC = (0xEC30A437).to_bytes(4, "little")
#: Where the content of a dictionary begins: after its three first offsets, which the library always sets so.
OFFSETS = b"".join(x.to_bytes(4, "little") for x in (1, 4, 8))


def prepared(text: str) -> bytes:
    return f" {text.lower()} ".encode("utf-8", "surrogatepass")


def windows(size: int, window: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths; the last one ends with the text, as long as the others (short ones would be stored as they are)."""
    starts = np.minimum(np.arange(0, max(1, size - window + step), step), max(0, size - window))
    return starts, np.minimum(window, size - starts)


@dataclass
class Toxicity:
    """What is learned: two dictionaries and the weights of the features."""

    ordinary: bytes = b""
    toxic: bytes = b""
    window: int = 40
    step: int = 24
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    cut: float = 0.5


class Gains:
    """Window gains of texts by a pair of dictionaries."""

    def __init__(self, model: Toxicity):
        self.window, self.step = model.window, model.step
        self.presses = [self._press(d) for d in (model.ordinary, model.toxic)]

    def _press(self, dictionary: bytes) -> zstandard.ZstdCompressor:
        # binary trees find the longest match; a greedy search differs between dictionaries by more than a word saves
        how = zstandard.ZstdCompressionParameters.from_level(
            12, source_size=self.window, dict_size=len(dictionary), strategy=zstandard.STRATEGY_BTLAZY2, search_log=5, target_length=16, min_match=5,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        if len(dictionary) < 8:
            return zstandard.ZstdCompressor(compression_params=how)
        known = zstandard.ZstdCompressionDict(dictionary)
        known.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(compression_params=how, dict_data=known)

    def of(self, raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        cuts = zstandard.BufferWithSegments(raw, np.stack((starts, sizes), 1).astype("<u8").tobytes())
        plain, toxic = (press.multi_compress_to_buffer(cuts) for press in self.presses)
        n = len(starts)
        return np.fromiter((len(plain[i]) - len(toxic[i]) for i in range(n)), np.int64, n)

    def counts(self, texts: Iterable[str | None], at_once: int = 1 << 18) -> Iterator[np.ndarray]:
        """For each text how many windows have each gain from LEAST to MOST. About ``at_once`` bytes are held."""
        held, size = [], 0
        for text in texts:
            raw = prepared(text) if text else b""
            held.append(raw)
            size += len(raw)
            if size >= at_once:
                yield from self._counts(held, at_once)
                held, size = [], 0
        yield from self._counts(held, at_once)

    def _counts(self, raws: list[bytes], at_once: int) -> np.ndarray:
        kinds = MOST - LEAST + 1
        total = np.zeros(len(raws) * kinds, np.int64)
        jobs: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # (row, where it starts in the joint text, windows)
        base = 0
        for row, raw in enumerate(raws):
            if raw:
                jobs.append((row, base, *windows(len(raw), self.window, self.step)))
            base += len(raw)
        if jobs:
            joint = b"".join(raws)
            starts = np.concatenate([s + b for _, b, s, _ in jobs])
            sizes = np.concatenate([z for *_, z in jobs])
            rows = np.repeat([r for r, *_ in jobs], [len(s) for *_, s, _ in jobs])
            most = max(1, at_once // self.step)
            for at in range(0, len(starts), most):  # one very long text has many
                gains = np.clip(self.of(joint, starts[at : at + most], sizes[at : at + most]), LEAST, MOST)
                total += np.bincount(rows[at : at + most] * kinds + gains - LEAST, minlength=len(total))
        return total.reshape(len(raws), kinds)


def features(counts: np.ndarray) -> np.ndarray:
    """Of each row of counts by gain; zeros where there is no window."""
    gains = np.arange(LEAST, MOST + 1)
    n = counts.sum(1).astype(float)
    largest = np.where(counts > 0, gains, 0).max(1)
    reached = np.stack([counts[:, gains >= g].sum(1) for g in GAINS], 1)
    x = np.c_[largest, counts @ np.maximum(gains, 0) / np.maximum(n, 1), np.log1p(reached), np.log((reached + 0.3) / (n + 3)[:, None]), np.log1p(n)]
    return np.where(n[:, None] > 0, x, 0.0)


# -- learning


def beginnings(raw: bytes) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Where words begin (their blank), and for each of LENGTHS the hash of as many bytes from there (0: past the end)."""
    own = np.frombuffer(raw, np.uint8)
    letter = IS_LETTER[own]
    at = np.flatnonzero(~letter[:-1] & letter[1:])
    padded = np.concatenate((own, np.zeros(max(LENGTHS), np.uint8))).astype(np.uint64)
    hashes, total = {}, np.zeros(len(at), np.uint64)
    for i in range(max(LENGTHS)):
        total = (total ^ (padded[at + i] if i else np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
        if i + 1 in LENGTHS:
            hashes[i + 1] = np.where(at + i < len(own), total, 0)
    return at, hashes


class Sample:
    """A labelled sample: prepared texts with their beginnings and words, so that folds don't make them again."""

    def __init__(self, texts: list[str], y: np.ndarray):
        self.raws, self.y = [*map(prepared, texts)], y
        self.begins = [beginnings(raw) for raw in self.raws]
        self.words = [{*NOT_LETTERS.split(raw)} for raw in self.raws]

    def passages(self, rows: np.ndarray, surprise: float, times: float) -> list[bytes]:
        """Words of toxic rows whose beginning is surprisingly frequent there, and at least ``times`` as frequent as in ordinary ones."""
        kinds = [rows[self.y[rows] == k] for k in (0, 1)]
        n, p = map(len, kinds)
        chosen = {i: np.zeros(len(self.begins[i][0]), bool) for i in kinds[1]}
        for length in LENGTHS:
            (plain, b), (toxic, a) = (np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(self.begins[i][1][length]) for i in own)]), return_counts=True) for own in kinds)
            place = np.searchsorted(plain, toxic)
            b = np.where(np.append(plain, 0)[place] == toxic, np.append(b, 0)[place], 0)
            share = (a + b) / (p + n)
            unlikely = (a / p - b / n) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / p + 1 / n))
            found = toxic[(unlikely >= surprise) & (a >= 3) & (a / p > times * (b + 0.5) / n) & (toxic != 0)]
            for i, marks in chosen.items():
                marks |= np.isin(self.begins[i][1][length], found)
        toxic_in, plain_in = Counter(), Counter()
        for counter, own in ((plain_in, kinds[0]), (toxic_in, kinds[1])):
            for i in own:
                counter.update(self.words[i])
        out = []
        for i, marks in chosen.items():
            for at in self.begins[i][0][marks].tolist():
                word = NOT_LETTERS.split(self.raws[i][at + 1 : at + 65], maxsplit=1)[0]
                if toxic_in[word] / p > times * (plain_in[word] + 0.5) / n:
                    out.append(b" " + word + b" ")
        return out

    def dictionaries(self, rows: np.ndarray, model: Toxicity, ordinary_bytes: int, toxic_bytes: int, surprise: float, times: float) -> Toxicity:
        rng = np.random.default_rng(7)
        plain = [self.raws[i] for i in rows if self.y[i] == 0]
        pieces = [raw[at : at + model.window] for raw in plain for at in range(0, len(raw), model.window)]
        pieces = [pieces[i] for i in rng.permutation(len(pieces))[: ordinary_bytes]]
        ordinary = trained(pieces, ordinary_bytes)
        passages = self.passages(rows, surprise, times)
        toxic = content(trained(passages, toxic_bytes, 128))
        cut = [p for p, _ in Counter(passages).most_common()[::-1] if p not in toxic]  # the trainer takes segments, which end within words
        toxic = b"".join(cut)[-toxic_bytes:] + toxic
        head = len(ordinary) - len(content(ordinary))
        return Toxicity(ordinary, ordinary[:head] + toxic + ordinary[head:], model.window, model.step)


def trained(samples: list[bytes], size: int, segment: int = 32) -> bytes:
    """A dictionary of the samples, made of segments of about so many bytes; of too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, level=16).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def content(dictionary: bytes) -> bytes:
    """What a dictionary holds besides its header and entropy tables; raw content has neither."""
    if not dictionary.startswith(MAGIC):
        return dictionary
    return dictionary[dictionary.index(OFFSETS) + len(OFFSETS) :]


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "toxic", key: str = "doc_id", per_class: int = 1600, max_bytes: int = 16 << 20, window: int = 40, step: int = 24, ordinary_bytes: int = 1 << 16, toxic_bytes: int = 1 << 14, surprise: tuple[float, ...] = (4.5, 6.0), times: float = 3.0, folds: int = 6) -> Toxicity:
    """Learns from whole texts of at most ``per_class`` rows and ``max_bytes`` bytes of each label (1: toxic).

    Of the values of ``surprise``, by how many standard deviations a passage must stand out, the one is taken whose cut
    does best on rows that its dictionaries had not seen: where texts are copied often, chance finds are many.
    """
    weights = label_counts(labels, label)
    rows = labelled_texts(docs, labels, label=label, key=key, text=text, per_class=per_class, max_bytes=max_bytes)
    shape = Toxicity(window=window, step=step)
    return learned([r["text"] for r in rows], np.array([r["label"] for r in rows], int), weights, shape, (ordinary_bytes, toxic_bytes), surprise, times, folds)


def learned(texts: list[str], y: np.ndarray, weights: dict[int, int], shape: Toxicity, sizes: tuple[int, int], surprise: tuple[float, ...], times: float, folds: int) -> Toxicity:
    if min((y == 0).sum(), (y == 1).sum()) < 1:
        return Toxicity(window=shape.window, step=shape.step)
    sample = Sample(texts, y)
    fold = np.zeros(len(y), int)
    for k in (0, 1):
        fold[y == k] = np.arange((y == k).sum()) % folds
    share = np.where(y == 1, weights[1] / (y == 1).sum(), weights[0] / (y == 0).sum())  # each row stands for so many
    share = share / share.mean()
    best = None
    for least in surprise:
        x = np.zeros((len(y), features(np.zeros((1, MOST - LEAST + 1), int)).shape[1]))
        for f in range(folds):
            rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len({*y[rest].tolist()}) == 2 and len(own):
                gains = Gains(sample.dictionaries(rest, shape, *sizes, least, times))
                x[own] = features(np.stack([*gains.counts(texts[i] for i in own)]))
        found = weighed(x, y, share)
        if best is None or found[0] > best[0]:
            best = (*found, least)
    _, mean, scale, w, cut, least = best
    model = sample.dictionaries(np.arange(len(y)), shape, *sizes, least, times)
    model.mean, model.scale, model.weights, model.cut = mean.tolist(), scale.tolist(), w.tolist(), cut
    return model


def weighed(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float]:
    """How good the best cut is, the features' means and scales, the logistic weights, and the cut."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        guess = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = x.T @ (x * (share * guess * (1 - guess))[:, None]) + np.eye(len(w))
        move = np.linalg.solve(curve, x.T @ (share * (y - guess)) - w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    guess = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    order = np.argsort(-guess, kind="stable")
    hits, taken = np.cumsum((share * y)[order]), np.cumsum(share[order])
    measure = 3 * hits / (taken + 2 * (share * y).sum())
    best = int(np.argmax(measure))
    low = guess[order][best + 1] if best + 1 < len(order) else 0.0
    return float(measure[best]), mean, scale, w, float(np.clip((guess[order][best] + low) / 2, 0.05, 0.95))


def scores(model: Toxicity, counts: np.ndarray) -> np.ndarray:
    """0 to 1; the model's cut is at THRESHOLD."""
    if not model.weights:
        return np.zeros(len(counts))
    x = np.c_[(features(counts) - model.mean) / model.scale, np.ones(len(counts))]
    p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
    p = np.where(counts.sum(1) > 0, p, np.minimum(p, model.cut / 2))  # nothing was seen that could be toxic
    return np.where(p < model.cut, THRESHOLD * p / model.cut, THRESHOLD + (1 - THRESHOLD) * (p - model.cut) / (1 - model.cut))


def scored(df: DataFrame, model: Toxicity, *, text: str = "text") -> DataFrame:
    """``df`` with score (0 to 1; THRESHOLD and more: toxic), max_gain and n_windows."""
    from .byte_bpe import unpacked

    small_batches(df.sparkSession)
    key = hashlib.sha256(repr(model).encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(model)  # both dictionaries, some ten thousand bytes

    @F.arrow_udf("struct<score: double, max_gain: int, n_windows: bigint>")
    def run(texts: pa.Array) -> pa.Array:
        gains = once(("toxicity", key), lambda: Gains(sent.value))
        counts = np.stack([*gains.counts(x.as_py() for x in texts)]) if len(texts) else np.zeros((0, MOST - LEAST + 1), int)
        largest = np.where(counts > 0, np.arange(LEAST, MOST + 1), 0).max(1)
        give_back()
        return pa.StructArray.from_arrays([pa.array(scores(sent.value, counts)), pa.array(largest.astype(np.int32)), pa.array(counts.sum(1))], names=list(OUTPUTS))

    return unpacked(df, run(F.col(text)), OUTPUTS)

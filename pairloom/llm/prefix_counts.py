"""Exact token counts of every prefix of a text, by dynamic programming.

For a BPE model with an end-of-word mark, a word's encoding is the only sequence of tokens in which each neighbouring
pair is the encoding of its own concatenation. So the last token of a prefix, and the count, follow from shorter
prefixes: try the vocabulary's tokens that end there, and take the one that fits after the last token of what stands
before it. Each prefix of each word is solved once in a worker and remembered (in bounded tables), both unmarked (the
word goes on) and marked (the prefix ends the text). Texts are joined from the solved pieces.

The table of a text holds one signed byte for each code point: by how much the count changes when the prefix takes it
in. Its running sum answers every question on truncation and budgets without another encoding.

A null text counts as empty; equal rows get equal results; an empty table gives an empty one; outputs replace input
columns of the same name.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_table, unpacked
from .shared import WHITE, WORD_PIECE, ChunkTable, PieceCache, once, read_bytes, small_batches, splits_at_blanks

TYPES = {"n_tokens": ("bigint", pa.int64()), "prefix_deltas": ("binary", pa.binary())}
NEVER = 1 << 30
#: Solved prefixes that a worker remembers at most.
REMEMBERED = 600_000


class PrefixCounter:
    def __init__(self, description: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(description)
        model, (split, spelling) = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or spelling["type"] != "ByteLevel":
            raise ValueError("prefix counts need a BPE model with an end-of-word mark over lower-cased words")
        self.mark, self.vocab = model["end_of_word_suffix"], {*model["vocab"]}
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.parts = {a + b: (a, b, i) for (a, b), i in self.rank.items()}
        self.reach: dict[str, dict[str, int]] = {"": {}, self.mark: {}}  # length of the longest token by its last three characters
        for t in self.vocab:
            bare = t.removesuffix(self.mark)
            own = self.reach[t[len(bare) :]]
            own[bare[-3:]] = max(own.get(bare[-3:], 0), len(bare))
        self.edges: dict[tuple[str, int], list[tuple[str, int]] | None] = {}
        self.longest = max(len(t.removesuffix(self.mark)) for t in self.vocab)
        if self.longest > 100:
            raise ValueError("a token of over 100 bytes could change a count by more than a signed byte holds")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.spell, self.white = byte_table(), regex.compile(f"[{WHITE}]*")
        self._new_root()
        pieces = PieceCache(lambda pieces: [self._word_piece(p) if WORD_PIECE.fullmatch(p) else self.deltas_of(p).tobytes() for p in pieces], limit=500_000)
        self.tables = ChunkTable(pieces, "i1", lead=False, blank=b"\x00", most=48 << 20, slice_bytes=8 << 20)

    # -- one word, spelt in the library's characters

    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best, at = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == NEVER:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _edge(self, token: str, side: int) -> list[tuple[str, int]] | None:
        """What stands at the token's right (1) or left (0) edge while it is merged, each with the rank that ends it.

        None if the token isn't its own encoding.
        """
        key = (token, side)
        if key not in self.edges:
            start = [*token[: -len(self.mark) - 1], token[-len(self.mark) - 1 :]] if token.endswith(self.mark) else [*token]
            found, part = [], token
            if self._merged(start) != [token]:
                found = None
            else:
                while part in self.parts:
                    *pair, rank = self.parts[part]
                    part = pair[side]
                    found.append((part, rank))
                found = [*found[::-1], (token, NEVER)]
            self.edges[key] = found
        return self.edges[key]

    def _fit(self, before: str, token: str) -> bool:
        """Whether ``before`` and ``token`` are the encoding of their concatenation; with nothing before, whether ``token`` is its own.

        They are unless, while both are merged, what stands on either side of the border merges first. Merges of one
        rank go from left to right.
        """
        a, b = self._edge(before, 1) if before else [("", NEVER)], self._edge(token, 0)
        if a is None or b is None:
            return False
        i = j = 0
        while True:
            (left, left_ends), (right, right_ends) = a[i], b[j]
            across = self.rank.get((left, right), NEVER)
            if across < left_ends and across <= right_ends and across < NEVER:
                return False
            if left_ends == right_ends == NEVER:
                return True
            if left_ends <= right_ends:
                i += 1
            else:
                j += 1

    def _last(self, spelt: str, end: int, nodes: list[list], mark: str) -> tuple[str, int]:
        """Last token and count of ``spelt[:end]``, marked or not, from the nodes of its shorter prefixes."""
        vocab = self.vocab
        for i in range(max(0, end - self.reach[mark].get(spelt[max(0, end - 3) : end], 2)), end):
            token = spelt[i:end] + mark
            if token in vocab:
                node = nodes[i]
                fits = node[4]
                fit = fits.get(token)
                if fit is None:
                    if len(fits) > 20_000:
                        fits.clear()
                    fit = fits[token] = self._fit(node[1], token)
                if fit:
                    return token, node[2] + 1
        raise ValueError(f"no token ends {spelt[:end]!r}")

    def _new_root(self) -> None:
        """A node has the next nodes by character, last token and count of its prefix unmarked, its count marked, and what fits after the last token."""
        self.fits: dict[str, dict[str, bool]] = {"": {}}
        self.root, self.nodes = [None, "", 0, None, self.fits[""]], 0

    def word_counts(self, word: str) -> list[int]:
        """The count of each prefix, by characters, of a normalized word."""
        if word.isascii() and word.isprintable():
            spelt, ends = word, range(1, len(word) + 1)
        else:
            raw = [c.encode("utf-8", "surrogatepass") for c in word]
            spelt, ends = "".join(self.spell[b] for c in raw for b in c), np.cumsum([len(c) for c in raw]).tolist()
        if self.nodes > REMEMBERED:
            self._new_root()
        node, nodes = self.root, [self.root]
        keep = len(spelt) <= 64  # longer ones are not met again: nothing of them is remembered
        known = 0
        for c in spelt:
            after = node[0].get(c) if node[0] else None
            if after is None:
                break
            nodes.append(after)
            node = after
            known += 1
        for c in spelt[known:]:
            after = [None, None, 0, None, None]
            if keep:
                if node[0] is None:
                    node[0] = {c: after}
                else:
                    node[0][c] = after
                self.nodes += 1
            nodes.append(after)
            node = after
        for e in range(max(1, known), len(spelt)):  # the last one known need not be solved, those before it are
            node = nodes[e]
            if node[1] is None:
                node[1], node[2] = self._last(spelt, e, nodes, "")
                fits = self.fits.get(node[1])
                if fits is None:
                    fits = self.fits[node[1]] = {}
                node[4] = fits
        counts = []
        for e in ends:
            node = nodes[e]
            if node[3] is None:
                node[3] = self._last(spelt, e, nodes, self.mark)[1]
            counts.append(node[3])
        return counts

    def _word_deltas(self, word: str) -> bytes:
        before, out = 0, []
        for count in self.word_counts(word):
            out.append(count - before & 0xFF)
            before = count
        return bytes(out)

    def _pretoken_counts(self, word: str) -> list[int]:
        """As word_counts, for a match of the pattern: what is not yet a contraction is an apostrophe and a letter."""
        counts = self.word_counts(word)
        if len(word) == 3 and word[0] == "'" and word[1].isalpha():
            counts[1] = self.word_counts("'")[0] + self.word_counts(word[1])[0]
        return counts

    def _word_piece(self, piece: str) -> bytes:
        """The deltas of one word after a blank or none; Latin letters are NFC, and but for one keep their number in lower case."""
        word = piece.lstrip(" ").lower()
        if len(word) != len(piece) - (piece[0] == " "):
            return self.deltas_of(piece).tobytes()
        return (b"\x00" if piece[0] == " " else b"") + self._word_deltas(word)

    # -- pieces and texts

    def _total(self, normal: str) -> int:
        return sum(self.word_counts(m[0])[-1] for m in self.words.finditer(normal))

    def _run_counts(self, run: str) -> list[int]:
        """The count of each prefix of a run without white space or special strings."""
        if not run.isascii() and not unicodedata.is_normalized("NFC", run):
            return [self._total("".join(c.lower() for c in unicodedata.normalize("NFC", run[: k + 1]))) for k in range(len(run))]
        if run.isascii():
            normal, ends = run.lower(), range(1, len(run) + 1)
        else:
            lowered = [c.lower() for c in run]
            normal, ends = "".join(lowered), np.cumsum([len(x) for x in lowered]).tolist()
        counts, base = [0] * (len(normal) + 1), 0
        at = 0
        for m in self.words.finditer(normal):
            a, b = m.span()
            counts[at + 1 : a + 1] = [base] * (a - at)
            counts[a + 1 : b + 1] = [base + x for x in self._pretoken_counts(m[0])]
            base, at = counts[b], b
        counts[at + 1 :] = [base] * (len(normal) - at)
        return [counts[e] for e in ends]

    def deltas_of(self, piece: str) -> np.ndarray:
        lead = self.white.match(piece).end()
        run = piece[lead:]
        counts, base, at = [0] * lead, 0, 0
        for m in self.specials.finditer(run):
            before = self._run_counts(run[at : m.end() - 1])  # up to its last character it is ordinary text
            counts += [base + x for x in before]
            base += (self._run_counts(run[at : m.start()])[-1] if m.start() > at else 0) + 1
            counts.append(base)
            at = m.end()
        if at < len(run):
            counts += [base + x for x in self._run_counts(run[at:])]
        return np.diff(np.array(counts, np.int64), prepend=0).astype(np.int8)

    def table(self, text: str | None) -> bytes:
        return next(self.tables.each(pa.array([text], pa.string()))).tobytes()


def counts_in(table: bytes) -> np.ndarray:
    """The count of every prefix: item k is that of the first k code points."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)))


def with_prefix_counts(df: DataFrame, text: str = "text", *, model_path: str, outputs: tuple[str, ...] = ("n_tokens", "prefix_deltas")) -> DataFrame:
    """``df`` with ``prefix_deltas``, the table of its text, and ``n_tokens``, what the table says of the whole text."""
    small_batches(df.sparkSession)
    description = read_bytes(model_path).decode()
    if not splits_at_blanks(description):
        raise ValueError("prefix counts need the preparation of texts that word_bpe_49k.json has")
    key = hashlib.sha256(description.encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(description)  # a vocabulary's size

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {TYPES[n][0]}" for n in outputs) + ">")
    def run(texts: pa.Array) -> pa.Array:
        counter = once(("prefix_counts", key), lambda: PrefixCounter(sent.value))
        columns: dict[str, list] = {n: [] for n in outputs}
        for table in counter.tables.each(texts):
            if "prefix_deltas" in columns:
                columns["prefix_deltas"].append(table.tobytes())
            if "n_tokens" in columns:
                columns["n_tokens"].append(int(table.sum(dtype=np.int64)))
        return pa.StructArray.from_arrays([pa.array(columns[n], TYPES[n][1]) for n in outputs], names=list(outputs))

    return unpacked(df, run(F.col(text)), outputs)


def tokens_in_prefix(df: DataFrame, chars: str, *, table: str = "prefix_deltas", output: str = "prefix_tokens") -> DataFrame:
    """``df`` with the exact count of the first ``chars`` code points (more than there are: all; null: null)."""

    @F.arrow_udf("bigint")
    def run(tables: pa.Array, lengths: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None or n.as_py() is None else int(counts_in(t.as_py()[: max(0, n.as_py())])[-1]) for t, n in zip(tables, lengths, strict=True)], pa.int64())

    return df.withColumn(output, run(F.col(table), F.col(chars).cast("bigint")))


def cut_to_budget(df: DataFrame, budget: int, *, text: str = "text", table: str = "prefix_deltas", output: str = "cut_text") -> DataFrame:
    """``df`` with the longest prefix of the text that has at most ``budget`` tokens."""

    @F.arrow_udf("bigint")
    def run(tables: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None else int(np.flatnonzero(counts_in(t.as_py()) <= budget)[-1]) for t in tables], pa.int64())

    return df.withColumn(output, F.substring(F.col(text), F.lit(1), run(F.col(table)).cast("int")))

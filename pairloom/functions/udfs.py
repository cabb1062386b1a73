"""What Catalyst has no expression for: Unicode normal form, difflib's edits, canonical JSON. Arrow batches throughout."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())


def mass_of(codes: list) -> int:
    return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in codes if tag != "equal")


@F.arrow_udf(T.LongType())
def edit_mass(a: pa.Array, b: pa.Array) -> pa.Array:
    """Characters that difflib's opcodes (with its default heuristics) insert, delete or replace: the larger span of each."""
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([mass_of(difflib.SequenceMatcher(None, x or "", y or "").get_opcodes()) for x, y in pairs], pa.int64())


HULL = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("a_start", "a_end", "b_start", "b_end")]))


def hulls_of(codes: list, gap: int = 12) -> list[dict]:
    found: list[list[int]] = []
    for tag, i1, i2, j1, j2 in codes:
        if tag == "equal":
            continue
        if found and i1 - found[-1][1] <= gap and j1 - found[-1][3] <= gap:
            found[-1][1], found[-1][3] = i2, j2
        else:
            found.append([i1, i2, j1, j2])
    return [{"a_start": h[0], "a_end": h[1], "b_start": h[2], "b_end": h[3]} for h in found]


@F.arrow_udf(HULL)
def edit_hulls(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edits between two normal forms, joined where at most 12 characters lie between them on both sides."""
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("a_start", "a_end", "b_start", "b_end")]))
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([hulls_of(difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).get_opcodes()) for x, y in pairs], kind)


DATE_LIKE = re.compile(r"\d{1,4}[-./:]\d{1,2}([-./:]\d{1,4})?")


def token_counts(codes: list, p: list[str], q: list[str], marks: tuple[str, ...]) -> dict[str, int]:
    counts = {"razor": 0, "envelope": 0, "other": 0}
    for tag, i1, i2, j1, j2 in codes:
        if tag == "equal":
            continue
        near = " ".join(p[max(0, i1 - 4) : i2 + 4] + q[max(0, j1 - 4) : j2 + 4])
        if any(m in near for m in marks):
            counts["envelope"] += 1
        elif all(any(c.isdigit() for c in t) for t in p[i1:i2] + q[j1:j2]):
            counts["razor"] += 1
        else:
            counts["other"] += 1
    return counts


@F.arrow_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("razor", "envelope", "other")]))
def token_edits(a: pa.Array, b: pa.Array, markers: pa.Array) -> pa.Array:
    """How many differing token spans change facts, lie within four tokens of an envelope marker, or are others."""
    out = []
    for x, y, marks in zip(a.to_pylist(), b.to_pylist(), markers.to_pylist(), strict=True):
        p, q = (x or "").split(), (y or "").split()
        out.append(token_counts(difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes(), p, q, tuple(marks or ())))
    return pa.array(out, pa.struct([(n, pa.int32()) for n in ("razor", "envelope", "other")]))


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@F.arrow_udf(T.StringType())
def canonical_json(rows: pa.Array) -> pa.Array:
    """Sorted keys, no blanks, nulls kept, Python's spelling of doubles."""
    return pa.array([None if r is None else canonical(r) for r in rows.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def canonical_sha256(rows: pa.Array) -> pa.Array:
    return pa.array([None if r is None else hashlib.sha256(canonical(r).encode()).hexdigest() for r in rows.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def blake2b_256(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else hashlib.blake2b(t.encode(), digest_size=32).hexdigest() for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def digit_cipher(texts: pa.Array) -> pa.Array:
    """Digits inside spans of digits change and keep their number: 0 becomes 7, others 0."""
    table = {ord(c): "7" if c == "0" else "0" for c in "0123456789"}
    return pa.array([None if t is None else t.translate(table) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def cut_by_units(texts: pa.Array, tokens: pa.Array) -> pa.Array:
    """Whole paragraphs, then whole lines, as long as the count of words and marks stays within ``tokens``."""
    count = lambda s: len(re.findall(r"\w+|[^\w\s]", s))
    out = []
    for text, most in zip(texts.to_pylist(), tokens.to_pylist(), strict=True):
        if text is None or count(text) <= most:
            out.append(text)
            continue
        left, kept = most, []
        for paragraph in text.split("\n\n"):
            if count(paragraph) <= left:
                kept.append(paragraph)
                left -= count(paragraph)
                continue
            lines = []
            for line in paragraph.split("\n"):
                if count(line) > left:
                    break
                lines.append(line)
                left -= count(line)
            if lines:
                kept.append("\n".join(lines))
            break
        out.append("\n\n".join(kept))
    return pa.array(out, pa.string())

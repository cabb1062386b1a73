"""Language identification by compression.

For each language the lower-cased pieces of a bounded sample, drawn over whole texts, are a raw-content dictionary of
Zstandard. A text is
compressed with every language's dictionary, in windows that cover all of it; the language whose dictionary leaves the
fewest bytes is chosen. ``margin`` is by what share the next best needs more; below ``min_margin`` the choice counts as
rejected, though the best language is still told. Of languages that tie, the one with more learned rows wins.

Texts that are null or have no letter are ``und`` with score 0, and so are all when nothing could be learned. Equal
texts get equal results; an empty table gives an empty one; outputs replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import unpacked
from .learning import labelled_windows
from .shared import once, small_batches

OUTPUTS = ("lang_pred", "score", "margin", "rejected")


def fit(df: DataFrame, *, lang: str = "lang", text: str = "text", per_lang: int = 256, windows: int = 4, chars: int = 128, dict_bytes: int = 1 << 17) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of rows, from ``windows`` pieces of ``chars`` characters of at most
    ``per_lang`` rows each. Of equal texts with several languages each counts for its own."""
    frequent = {r[lang]: r["count"] for r in df.where(F.col(lang).isNotNull()).groupBy(lang).count().collect()}  # a row for each language
    texts: dict[str, list[bytes]] = {}
    for r in labelled_windows(df, label=lang, text=text, per_class=per_lang, windows=windows, chars=chars):
        texts.setdefault(r["label"], []).extend(x.lower().encode("utf-8", "replace") for x in r["pieces"])
    order = sorted(texts, key=lambda x: (-frequent.get(x, 0), x))
    return [(x, b"\n".join(texts[x])[:dict_bytes]) for x in order if len(b"\n".join(texts[x])) >= 8]


class Languages:
    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int, window: int):
        self.names, self.window, self.presses = [n for n, _ in dictionaries], window, []
        for _, raw in dictionaries:
            how = zstandard.ZstdCompressionParameters.from_level(level, source_size=window, dict_size=len(raw), min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            self.presses.append(zstandard.ZstdCompressor(compression_params=how, dict_data=known).compress)

    def sizes(self, text: str) -> list[int]:
        raw = memoryview(text.lower().encode("utf-8", "replace"))
        windows = [raw[i : i + self.window] for i in range(0, len(raw), self.window)]
        return [sum(len(press(w)) for w in windows) for press in self.presses]

    def choose(self, text: str | None, min_margin: float) -> tuple[str, float, float, bool]:
        if not self.names or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        more = min(rest) - sizes[best] if rest else sizes[best]
        margin = more / max(1, sizes[best])
        return self.names[best], 1.0 - 0.5 * math.exp(-more / 8), margin, margin < min_margin


def identified(df: DataFrame, dictionaries: list[tuple[str, bytes]], *, text: str = "text", level: int = 6, window: int = 4096, min_margin: float = 0.01) -> DataFrame:
    """``df`` with lang_pred, score (0.5 at a tie, to 1 as the byte margin grows), margin and rejected."""
    small_batches(df.sparkSession)
    key = hashlib.sha256(repr((dictionaries, level, window)).encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(dictionaries)  # dict_bytes a language

    @F.arrow_udf("struct<lang_pred: string, score: double, margin: double, rejected: boolean>")
    def run(texts: pa.Array) -> pa.Array:
        model = once(("langid", key), lambda: Languages(sent.value, level, window))
        rows = [model.choose(x.as_py(), min_margin) for x in texts]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(OUTPUTS))

    return unpacked(df, run(F.col(text)), OUTPUTS)

"""Text expressions: normal forms, n-grams, scripts, digits. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm1(text: Column) -> Column:
    """Runs of white space become one blank, the ends are trimmed, letters lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")))


def norm2(text: Column) -> Column:
    """norm1 after every character that is no letter, number, underscore or white space became a blank."""
    return norm1(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s]", " "))


def feature_text(title: Column, body: Column) -> Column:
    return norm1(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))))


def char_grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters; none if the text is shorter. The text is split once, so places cost the same."""
    none = F.array().cast("array<string>")
    run = lambda c, i: F.concat(*[F.element_at(c, i + k) for k in range(n)])
    return let(F.split(text, ""), lambda c: F.when(F.length(text) < n, none).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: run(c, i)))))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def word_grams(text: Column, low: int, high: int) -> Column:
    """Distinct word n-grams of orders ``low`` to ``high`` of norm1."""
    none = F.array().cast("array<string>")

    def order(w: Column, n: int) -> Column:
        return F.when(F.size(w) < n, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))

    return let(words(norm1(text)), lambda w: F.array_distinct(F.flatten(F.array(*[order(w, n) for n in range(low, high + 1)]))))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).otherwise(common / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Intersection over the smaller set: 1 if both are empty, 0 if one is."""
    least = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def token_count(text: Column) -> Column:
    """Words and single marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")) + F.regexp_count(text, F.lit(r"(?U)[^\p{L}\p{N}_\s]"))


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def script(text: Column, other: str = r"\p{IsCyrillic}", names: tuple[str, str] = ("ru", "en")) -> Column:
    """The script that more than 0.7 of the letters are of, ``mixed``, or ``none`` without letters."""
    n, own = letters(text), F.regexp_count(text, F.lit(other))
    own = F.least(own, n)
    share = F.greatest(own, n - own) / F.when(n > 0, n)
    return F.when(n == 0, F.lit("none")).when(share <= 0.7, F.lit("mixed")).when(own > n - own, F.lit(names[0])).otherwise(F.lit(names[1]))


def digit_fraction(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit("[0-9]")) / F.length(text)).otherwise(F.lit(0.0))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))


def lost_digit_runs(a: Column, b: Column) -> Column:
    return F.array_except(digit_runs(a), digit_runs(b))


def fact_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[:.\-_/][0-9]+)*"), F.lit(0))


def digit_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(norm1(text), F.lit(r"[0-9]+(?:[.,:][0-9]+)*"), F.lit(0)))


def digit_direction(a: Column, b: Column) -> Column:
    """1 if a's digit set holds b's, -1 if it lies in it, else 0; 0 if one is empty."""
    x, y = digit_set(a), digit_set(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0).when(F.size(F.array_except(y, x)) == 0, 1).when(F.size(F.array_except(x, y)) == 0, -1).otherwise(0)


def numeric_razor(a: Column, b: Column) -> Column:
    """As many tokens on both sides, some differ, and where they do both have a digit."""
    x, y = words(norm1(a)), words(norm1(b))
    digit = lambda t: t.rlike("[0-9]")
    pairs = F.zip_with(x, y, lambda p, q: F.when(p == q, 0).when(digit(p) & digit(q), 1).otherwise(2))
    return (F.size(x) == F.size(y)) & ~F.exists(pairs, lambda v: v == 2) & F.exists(pairs, lambda v: v == 1)


def fact_token(token: Column) -> Column:
    """A digit, or 8 to 64 hexadecimal letters."""
    return token.rlike("[0-9]") | F.lower(token).rlike("^[a-f]{8,64}$")


def sentence_ok(text: Column) -> Column:
    t = F.trim(text)
    return F.length(t).between(10, 300) & ~F.lower(t).rlike("http|www\\.|@|<") & (letters(t) >= 0.6 * F.length(t))


def text_ok(text: Column, low: int = 40, high: int = 4000, tokens: int = 256) -> Column:
    return F.length(text).between(low, high) & (token_count(text) <= tokens)


def swap_case(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")


def skeleton(text: Column, n: int = 20) -> Column:
    """Script, length, and the shape of the first characters: d for digits, w for letters, . for others."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text.substr(1, n), r"[^\p{L}0-9]", "."), r"\p{L}", "w"), "[0-9]", "d")
    return F.concat(F.lit("<"), script(text), F.lit(" len="), F.length(text).cast("string"), F.lit(" shape="), shape, F.lit(">"))


def corridor(base: Column, title: Column, body: Column) -> Column:
    """Why a candidate is refused: empty, length, identical; null if it isn't."""
    low = F.greatest(F.lit(30.0), 0.35 * F.length(base))
    long = ~F.length(title).between(3, 150) | (F.length(body) < low) | (F.length(body) > 3 * F.length(base))
    return F.when((F.trim(title) == "") | (F.trim(body) == ""), "empty").when(long, "length").when(norm1(base) == norm1(body), "identical")


def near_copy(a: Column, b: Column, least: float = 0.9) -> Column:
    x, y = F.array_distinct(words(norm1(a))), F.array_distinct(words(norm1(b)))
    return (norm1(a) == norm1(b)) | (jaccard(x, y) >= least)


def text_hash(text: Column) -> Column:
    """sha256 of the lower-cased text with single blanks; give text in NFC (``udfs.nfc``) for canonical equality."""
    return F.sha2(norm1(text), 256)


#: Marks and their plain forms (fixed values).
PLAIN_MARKS = {"«": '"', "»": '"', "“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "–": "-", "‐": "-"}


def plain_marks(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit("…"), F.lit("...")), "".join(PLAIN_MARKS), "".join(PLAIN_MARKS.values()))

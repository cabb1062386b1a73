"""Deterministic changes to records, and training pairs made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import text as T


def shuffle_tags(tags: Column, seed: Column | int) -> Column:
    """Tags in the order of their hashes with the seed."""
    s = F.lit(seed) if isinstance(seed, int) else seed
    return F.transform(F.array_sort(F.transform(tags, lambda t: F.struct(F.xxhash64(t, s).alias("h"), t.alias("t")))), lambda x: x.t)


def collapse_body(body: Column) -> Column:
    return F.trim(F.regexp_replace(body, r"(?U)[\s\x1c-\x1f]+", " "))


def next_of(value: Column, domain: list[str]) -> Column:
    """The value after this one in the domain, cyclically; null and foreign values stay."""
    out = value
    for a, b in zip(domain, [*domain[1:], domain[0]], strict=True):
        out = F.when(value == a, F.lit(b)).otherwise(out)
    return out


def donors(records: DataFrame, field: str = "body", seed: int = 0, takers: DataFrame | None = None) -> DataFrame:
    """id, donor, donor_<field>: for each taker (all records, if none are given) a record whose field differs; only where
    no record's does it has none.

    Within a block of (language, record_type) each value takes the next one in hash order; a block with one value takes
    one of two from the whole table.
    """
    key = F.sha2(F.to_json(F.struct(field)), 256)
    order = F.struct(F.xxhash64(F.lit(seed), "_key").alias("h"), "_key", "_id")
    block = Window.partitionBy("language", "record_type")
    w = block.orderBy(F.xxhash64(F.lit(seed), "_key"), "_key")
    values = records.groupBy("language", "record_type", key.alias("_key")).agg(F.min(F.struct(F.xxhash64(F.lit(seed), "id").alias("h"), "id"))["id"].alias("_id"))
    one = values.agg(F.min(order).alias("_a"))
    other = values.crossJoin(F.broadcast(one)).where("_key <> _a._key").agg(F.min(order).alias("_b"))
    following = F.when(F.count("*").over(block) > 1, F.coalesce(F.lead("_id").over(w), F.first("_id").over(w)))
    anywhere = F.when(F.col("_key") != F.col("_a._key"), F.col("_a._id")).otherwise(F.col("_b._id"))
    found = values.withColumn("donor", following).crossJoin(F.broadcast(one)).crossJoin(F.broadcast(other))
    found = found.select(F.col("language").alias("_l"), F.col("record_type").alias("_t"), F.col("_key").alias("_k"), F.coalesce("donor", anywhere).alias("donor"))
    x = (records if takers is None else takers).select("id", "language", "record_type", key.alias("_key"))
    x = x.join(found, F.col("language").eqNullSafe(F.col("_l")) & F.col("record_type").eqNullSafe(F.col("_t")) & (F.col("_key") == F.col("_k")))
    return x.select("id", "donor").join(records.select(F.col("id").alias("donor"), F.col(field).alias(f"donor_{field}")), "donor").select("id", "donor", f"donor_{field}")


def pretrain_pairs(records: DataFrame, *, languages: list[str], types: list[str], seed: int = 0) -> DataFrame:
    """id, label, strategy, title, body, tags, language, record_type: a weak positive of each record and a hard negative,
    unless that would need a donor and there is none."""
    pick = lambda k, salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(k))
    pos = records.withColumn("_p", pick(3, 1)).select(
        "id", F.lit(1).alias("label"), F.element_at(F.array(F.lit("collapse"), F.lit("plain-marks"), F.lit("swap-case")), (F.col("_p") + 1).cast("int")).alias("strategy"),
        F.when(F.col("_p") == 2, T.swap_case(F.col("title"))).otherwise(F.col("title")).alias("title"),
        F.when(F.col("_p") == 0, collapse_body(F.col("body"))).when(F.col("_p") == 1, T.plain_marks(F.col("body"))).otherwise(F.col("body")).alias("body"), "tags", "language", "record_type",
    )
    picked = records.withColumn("_p", pick(5, 2))
    negative = lambda x, strategy, **new: x.select("id", F.lit(0).alias("label"), strategy.alias("strategy"), *[new.get(c, F.col(c)).alias(c) for c in ("title", "body", "tags", "language", "record_type")])
    out = pos.unionByName(negative(
        picked.where("_p IN (1, 2)"), F.when(F.col("_p") == 1, "flip-language").otherwise("flip-type"),
        language=F.when(F.col("_p") == 1, next_of(F.col("language"), languages)).otherwise(F.col("language")), record_type=F.when(F.col("_p") == 2, next_of(F.col("record_type"), types)).otherwise(F.col("record_type")),
    ))
    for p, field, strategy in ((0, "body", "substitute"), (3, "title", "substitute-title"), (4, "tags", "substitute-tags")):
        own = picked.where(F.col("_p") == p)
        out = out.unionByName(negative(own.join(donors(records, field, seed, own), "id"), F.lit(strategy), **{field: F.col(f"donor_{field}")}))
    return out


def swap_sentences(body: Column) -> Column:
    """The first two sentences change places."""
    s = F.split(body, r"(?<=[.!?])\s+")
    return F.when(F.size(s) < 2, body).otherwise(F.array_join(F.concat(F.array(F.element_at(s, 2), F.element_at(s, 1)), F.slice(s, 3, F.greatest(F.size(s) - 2, F.lit(0)))), " "))


def envelope_date(body: Column, day: Column) -> Column:
    return F.concat(F.lit("date: "), day, F.lit("\n"), body)


def cyclic_words(body: Column, words: list[str]) -> Column:
    """Each word of the list becomes the one after it (fact edits of months or weekdays)."""
    return F.array_join(F.transform(F.split(body, " "), lambda w: next_of(w, words)), " ")


def title_suffix(title: Column, n: Column, suffixes: tuple[str, ...] = (".", "!", " -", ":")) -> Column:
    return F.concat(title, F.element_at(F.array(*map(F.lit, suffixes)), (F.pmod(n, F.lit(len(suffixes))) + 1).cast("int")))


def both_directions(pairs: DataFrame, a: str, b: str) -> DataFrame:
    swapped = pairs.withColumns({a: F.col(b), b: F.col(a)})
    return pairs.withColumn("direction", F.lit("forward")).unionByName(swapped.withColumn("direction", F.lit("reverse")))


def combinations(slots: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` combinations of a template's slot values (slot, value): slots are few and values listed by hand."""
    grid = slots.groupBy("slot").agg(F.array_sort(F.collect_list("value")).alias("options"))
    lists = grid.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "options"))), lambda x: x.options).alias("l"))
    total = F.aggregate("l", F.lit(1).cast("bigint"), lambda n, x: n * F.size(x))
    rows = lists.select("l", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(total, F.lit(limit).cast("bigint")) - 1)).alias("i"))
    first = F.aggregate("l", F.struct(F.col("i").alias("rest"), F.array().cast("array<string>").alias("picked")), lambda s, x: F.struct(F.floor(s.rest / F.size(x)).cast("bigint").alias("rest"), F.concat(s.picked, F.array(F.element_at(x, (s.rest % F.size(x) + 1).cast("int")))).alias("picked")))
    return rows.select("i", first.picked.alias("values"))


def strip_markers(text: Column, markers: tuple[str, ...] = ("```", "TITLE:", "BODY:")) -> Column:
    """Lines without protocol markers and their number: struct(text, stripped)."""
    lines = F.split(text, "\n")
    hit = lambda l: F.exists(F.array(*map(F.lit, markers)), lambda m: F.trim(l).startswith(m))  # noqa: E731, E741
    kept = F.filter(lines, lambda l: ~hit(l))  # noqa: E741
    return F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("stripped"))


def title_and_body(text: Column) -> Column:
    """The first line that isn't blank, and the rest: struct(title, body); nulls when either is empty."""
    lines = F.filter(F.split(text, "\n"), lambda l: ~F.trim(l).startswith("```"))  # noqa: E741
    full = F.filter(lines, lambda l: F.trim(l) != "")  # noqa: E741
    rest = F.trim(F.array_join(F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))), "\n"))
    return F.struct(F.when(F.size(full) > 0, F.trim(F.get(full, 0))).alias("title"), F.when(rest != "", rest).alias("body"))


def first_json(text: Column, schema: str, array: bool = True) -> Column:
    found = F.regexp_extract(text, r"(?s)\[.*\]" if array else r"(?s)\{.*\}", 0)
    return F.when(found != "", F.from_json(found, schema))


def clean_translation(text: Column) -> Column:
    """Without fences, an echoed label and wrapping quotes."""
    t = F.regexp_replace(F.trim(text), r"(?s)^```[a-z]*\n?|```$", "")
    t = F.regexp_replace(F.trim(t), r"(?i)^(translation|translated text)\s*:\s*", "")
    return F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r'^"(.*)"$', "$1")

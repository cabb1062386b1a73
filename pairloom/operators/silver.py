"""Silver labels of pairs and classes of clusters, from predicates alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.functions.udfs import token_edits


def census_class(a_title, a_body, b_title, b_body, tags_eq, type_eq, lang_eq, names=("ru", "en")) -> Column:
    """quarantine (sure but different scripts), silver-dup, notdup-metadata-T2, notdup-razor-numeric-T3, disputed."""
    la, lb = T.script(a_body, names=names), T.script(b_body, names=names)
    body, title, meta = T.norm1(a_body) == T.norm1(b_body), T.norm1(a_title) == T.norm1(b_title), tags_eq & type_eq & lang_eq
    return (
        F.when(la.isin(*names) & lb.isin(*names) & (la != lb), "quarantine").when(body & title & meta, "silver-dup")
        .when(body & title, "notdup-metadata-T2").when(~body & T.numeric_razor(a_body, b_body), "notdup-razor-numeric-T3").otherwise("disputed")
    )


def sift(pairs: DataFrame, markers: tuple[str, ...] = ("date", "created", "updated")) -> DataFrame:
    """``pairs`` (a_title, a_body, b_title, ..., tags_eq, type_eq, lang_eq) with the counts of token edits and a verdict."""
    marks = F.array(*map(F.lit, markers))
    x = pairs.withColumn("edits", token_edits(T.norm1(F.col("a_body")), T.norm1(F.col("b_body")), marks))
    la, lb = T.script(F.col("a_body")), T.script(F.col("b_body"))
    e, meta = F.col("edits"), F.col("tags_eq") & F.col("type_eq") & F.col("lang_eq")
    total = e.razor + e.envelope + e.other
    verdict = (
        F.when(la.isin("ru", "en") & lb.isin("ru", "en") & (la != lb), "disputed-crosslang").when((total == 0) & ~meta, "not-dup-metadata").when((total == 0) | ((e.envelope > 0) & (e.razor + e.other == 0)), "dup-silver")
        .when((e.razor > 0) & (e.other == 0), "not-dup-razor").when(e.razor > 0, "not-dup-razor+disputed").otherwise("disputed")
    )
    return x.withColumn("verdict", verdict)


def flags(a: dict[str, Column], b: dict[str, Column], eps: float = 0.01) -> list[Column]:
    """Seven signs that nothing is shared: body tokens, body 5-grams, title tokens, tags, digits, language, type."""
    tokens = lambda s: F.array_distinct(T.words(T.norm1(s)))
    grams = lambda s: T.char_grams(T.norm1(s), 5)
    differ = lambda x, y: ~x.eqNullSafe(y)
    return [
        T.jaccard(tokens(a["body"]), tokens(b["body"])) <= eps, T.jaccard(grams(a["body"]), grams(b["body"])) <= eps, F.size(F.array_intersect(tokens(a["title"]), tokens(b["title"]))) <= eps,
        T.jaccard(F.array_distinct(a["tags"]), F.array_distinct(b["tags"])) <= eps, F.size(F.array_intersect(T.digit_set(a["body"]), T.digit_set(b["body"]))) == 0, differ(a["language"], b["language"]), differ(a["record_type"], b["record_type"]),
    ]


def zeps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    total = F.lit(0)
    for f in flags(a, b):
        total = total + f.cast("int")
    return total


def zone(cos: Column, c5: Column, z: Column) -> Column:
    return ((cos <= 0.85) & (c5 <= 0.05)) | ((z >= 3) & (c5 <= 0.20))


def cluster_class(members: DataFrame, declarations: DataFrame | None = None) -> DataFrame:
    """cluster, class of members (cluster, title, body, tags, record_type, language): CH-0 equal in all, CH-5 equal but
    for spelling, CH-2 equal but for metadata, then CH-4 and CH-3 by a declared mode, else undefined."""
    n = lambda c: F.count_distinct(F.coalesce(c.cast("string"), F.lit("\0")))
    tags = F.array_join(F.array_sort(F.array_distinct("tags")), "\1")
    facts = members.groupBy("cluster").agg(n(F.sha2("body", 256)).alias("bodies"), n(T.norm1(F.col("body"))).alias("norms"), n(F.col("title")).alias("titles"), n(tags).alias("tagsets"), n(F.col("record_type")).alias("types"), n(F.col("language")).alias("languages"))
    facts = facts.join(declarations, "cluster", "left") if declarations is not None else facts.withColumn("mode", F.lit(None).cast("string"))
    f = F.col
    meta = (f("tagsets") > 1) | (f("types") > 1) | (f("languages") > 1)
    cls = (
        F.when((f("bodies") == 1) & (f("titles") == 1) & ~meta, "CH-0").when((f("bodies") > 1) & (f("norms") == 1), "CH-5").when((f("norms") == 1) & (f("titles") == 1) & meta, "CH-2")
        .when(f("mode") == "conflict", "CH-4").when(f("mode").isin("insert", "replace", "chain"), "CH-3").otherwise("undefined")
    )
    return facts.select("cluster", cls.alias("class"))


def near_misses(scored: DataFrame, *, classes: tuple[str, ...], cos: float = 0.9, containment: float = 0.9, cut: float = 0.5) -> DataFrame:
    """Positive probes that look alike in every way and yet score below the cut."""
    same = (F.col("title_len_delta") == 0) & (F.col("tag_count_delta") == 0) & (F.col("type_match") == 1) & (F.col("lang_match") == 1)
    return scored.where(F.col("class").isin(*classes) & (F.col("cos_target") >= cos) & (F.col("char5_containment") >= containment) & same & (F.col("p") < cut))


def quota_violations(rows: DataFrame, quotas: DataFrame, key: str = "class") -> DataFrame:
    """Classes of ``quotas`` (class, least) with fewer rows, also those with none."""
    have = rows.groupBy(key).agg(F.count("*").alias("have"))
    return quotas.join(have, key, "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < least")


def direction_gaps(rows: DataFrame, required: DataFrame) -> DataFrame:
    """For classes of ``required`` (class, directions), the directions that no row has."""
    have = rows.groupBy("class").agg(F.collect_set("direction").alias("have"))
    return required.join(have, "class", "left").select("class", F.array_except("directions", F.coalesce("have", F.array().cast("array<string>"))).alias("missing")).where(F.size("missing") > 0)


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """name, bad, ok: how many rows break each rule; one pass."""
    sums = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in rules)
    return sums.selectExpr(f"stack({len(rules)}, {pairs}) AS (name, bad)").withColumn("ok", F.col("bad") == 0)


def registry(df: DataFrame, statuses: tuple[str, ...], key: str) -> DataFrame:
    """``df`` if its keys are unique and its statuses known; else the query fails."""
    from pyspark.sql import Window

    seen = F.count("*").over(Window.partitionBy(key))
    ok = (seen == 1) & F.col("status").isin(*statuses)
    return df.withColumn(key, F.when(ok, F.col(key)).otherwise(F.raise_error(F.lit("registry row refused")).cast(df.schema[key].dataType)))

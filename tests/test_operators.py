import unicodedata
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pairloom.operators import candidates, clusters, corpus, features, fingerprints, graph, hygiene, metrics, retrieval, silver, transforms

SIDE = "id long, title string, body string, tags array<string>, language string, record_type string"


def pair(spark, a, b, similarity=0.9312):
    records = spark.createDataFrame([(1, *a), (2, *b)], SIDE)
    return features.pair_features(spark.createDataFrame([(1, 2, similarity)], "a long, b long, similarity double"), records).first()


def test_pair_features_by_hand(spark):
    same = ("A title", "a body text", ["x", "y"], "ru", "note")
    r = pair(spark, same, same)
    assert r.cos_target == 0.9312 and all(r[c] == 1.0 for c in features.CORE[1:8]) and all(r[c] == 0 for c in features.CORE[8:11]) and r.type_match == r.lang_match == 1.0
    r = pair(spark, ("a" * 40, "b" * 40, ["t1"], "ru", "note"), ("c" * 40, "d" * 40, ["t2"], "en", "fact"))
    assert all(r[c] == 0.0 for c in features.CORE[1:8]) and r.type_match == r.lang_match == 0.0 and r.title_len_delta == 0
    r = pair(spark, ("t", "тело", [], None, None), ("t", "тело!!", [], None, None))
    assert r.char3_containment == 1.0 and r.char3_jaccard < 1.0 and r.tag_jaccard == 1.0 and r.type_match == r.lang_match == 0.0
    r = pair(spark, ("Привет Мир", "Body текст", [], "ru", None), ("привет мир", "BODY ТЕКСТ", [], "ru", "note"))
    assert r.char3_jaccard == 1.0 and r.lang_match == 1.0 and r.type_match == 0.0
    r = pair(spark, ("t", "b", ["x", "y", "z"], "ru", "note"), ("tt", "b", ["z", "y", "x", "w"], "ru", "note"))
    assert (r.tag_jaccard, r.title_len_delta, r.tag_count_delta) == (0.75, 1, 1)
    a, b = ("one title", "some body here", ["p"], "ru", "note"), ("other", "some body there", ["p", "q"], None, "fact")
    assert [pair(spark, a, b)[c] for c in features.CORE] == [pair(spark, b, a)[c] for c in features.CORE]
    for bad in (1.5, -1.01, float("nan")):
        with pytest.raises(Exception, match="cosine"):
            pair(spark, a, b, bad)
    assert spark.range(1).select(features.feature_digest()).first()[0] == "dd86228f8c634f28d8a15b2d8279da1b99735d68e309be02d30f1c24698fa6af"


def test_graph_by_hand(spark):
    names = {n: i for i, n in enumerate(["a", "b", "c", "d", "secret", "nofed", "noemb", "x"])}
    raw = [("a", "b", "relates_to"), ("b", "c", "relates_to"), ("c", "d", "supersedes"), ("a", "secret", "relates_to"), ("b", "nofed", "relates_to"), ("c", "noemb", "relates_to"), ("secret", "nofed", "relates_to")]
    e = spark.createDataFrame([(names[s], names[t], k) for s, t, k in raw], "src long, dst long, kind string")
    pool = spark.createDataFrame([(names[n], i) for i, n in enumerate("abcd")], "id long, created long")
    assert graph.edge_coverage(e, pool).first() == Row(total=7, inside=3, partial=3, absent=1)
    got = {(r.a, r.b): (r.common, r.jaccard) for r in graph.common_neighbors(e).collect()}
    assert got[names["a"], names["c"]] == (1, 0.25)
    assert {r.id for r in graph.one_hop(e, pool.where("id = 0").select("id")).collect()} == {names["a"], names["b"], names["secret"]}
    assert {r.component for r in graph.connected_components(e).collect()} == {0}
    assert {r.pair_id for r in graph.silver_edges(e.union(e), pool).collect()} == {f"{a}--{b}--{k}{s}" for a, b, k in ((0, 1, "relates_to"), (1, 2, "relates_to"), (2, 3, "supersedes")) for s in ("", "#2")}
    two = spark.createDataFrame([(5, 9, "k"), (9, 7, "k"), (1, 2, "k")], "src long, dst long, kind string")
    assert {r.id: r.number for r in graph.numbered_components(two).collect()} == {1: 1, 2: 1, 5: 2, 7: 2, 9: 2}


def test_hygiene_chain(spark):
    u = [1.0] + [0.0] * 3
    rows = [
        (1, "t", "fine " * 20, ["python"], u, "p", "h", None), (2, "t", "key AKIA" + "A" * 16, [], u, "p", "h", None), (3, "t", "b", ["no-federate:x"], None, None, None, "q"), (4, "t", "b", [], u, "p", "h", "danger"),
        (5, "t", "b", [], None, "p", "h", None), (6, "t", "b", [], u, None, "h", None), (7, "t", "b", [], u, "p", None, None), (8, "t", "b", [], [0.5, 0.5], "p", "h", None), (9, "t", "b", [], [0.9, 0.0, 0.0, 0.0], "p", "h", None),
    ]
    df = spark.createDataFrame(rows, "id long, title string, body string, tags array<string>, v array<double>, pinned string, content_hash string, quarantine string")
    got = {r.id: r.reasons for r in hygiene.exclusion_reasons(df, dim=4).collect()}
    assert got == {1: [], 2: ["secret:aws-key"], 3: ["no-federate"], 4: ["quarantine"], 5: ["missing-embedding"], 6: ["unpinned-embedding"], 7: ["missing-content-hash"], 8: ["bad-vector-size"], 9: ["bad-vector-norm"]}
    assert sum(r.n for r in hygiene.exclusion_counts(hygiene.exclusion_reasons(df, dim=4)).collect()) == 8


def test_quality_scores(spark):
    codes = list(hygiene.PENALTIES)
    v = spark.createDataFrame([(1, codes[0]), *[(2, c) for c in codes], (3, codes[1]), (3, codes[1])], "id long, code string")
    r = spark.createDataFrame([(i, i != 9) for i in (1, 2, 3, 4, 9)], "id long, in_scope boolean")
    assert {x.id: x.score for x in hygiene.quality(v, r).collect()} == {1: 0.75, 2: 0.0, 3: 0.5, 4: 1.0, 9: None}
    with pytest.raises(Exception, match="unknown violation"):
        hygiene.quality(spark.createDataFrame([(1, "NEW")], "id long, code string"), r).collect()


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(True, 0.9, "a"), (False, 0.2, "a"), (True, 0.4, "b"), (False, 0.6, "b")], "y boolean, p double, class string")
    r = metrics.binary_metrics(df).first()
    assert (r.sensitivity, r.specificity, r.balanced_accuracy, r.brier) == (0.5, 0.5, 0.5, 0.1925)
    only = metrics.binary_metrics(df.where("y")).first()
    assert only.specificity == 0.0
    b = {x["class"]: x for x in metrics.class_breakdown(df.where("y OR class = 'b'")).collect()}
    assert b["a"].specificity is None and b["b"].fp == 1
    ladder = spark.createDataFrame([("g", 1.0, 0.9), ("g", 0.9, 0.8), ("g", 0.5, 0.85), ("h", 1.0, 0.1)], "grp string, cos double, p double")
    got = {x.grp: (x.steps, x.ok) for x in metrics.monotone(ladder, "grp", [F.col("cos").desc()], "p").collect()}
    assert got == {"g": (2, False), "h": (0, True)}
    assert metrics.monotone(ladder, "grp", [F.col("cos").desc()], "p", zone=F.col("cos") > 0.95).where("NOT ok").count() == 0


def test_splits_and_samples(spark):
    df = spark.createDataFrame([(f"mem-{n:04d}--mem-{n + 100:04d}", s) for s, n in [("P2", 1), ("N1", 2), ("N1", 3)]], "pair_id string, stratum string")
    got = {r.pair_id[4:8]: r.split for r in corpus.head_split(df, ["stratum"], ["pair_id"], 0.3).collect()}
    assert got == {"0001": "holdout", "0002": "holdout", "0003": "train"}
    rows = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(40)], "id long, g string, v double").repartition(3)
    assert sorted(r.id for r in corpus.every_nth(rows, ["id"], 4).collect()) == list(range(0, 40, 4))
    assert [r.id for r in corpus.round_robin(rows, "g", "id", 5).orderBy("turn", "g").collect()] == [0, 1, 2, 3, 4]
    assert corpus.capped_quota(rows, "g", 3, 10, ["id"]).count() == 10
    picked = corpus.even_spread(rows, "g", ["id"], 3).collect()
    assert sorted(r.id for r in picked if r.g == "a") == [0, 20, 38]
    spaced = sorted(r.v for r in corpus.spaced_pick(rows, "g", "v", 4, 6.0).collect() if r.g == "a")
    assert spaced == [0, 6, 12, 18]
    gaps = sorted(r.v for r in corpus.largest_gap_pick(rows, "g", "v", 3).collect() if r.g == "a")
    assert gaps[0] == 0 and gaps[-1] == 38 and len(gaps) == 3
    with pytest.raises(Exception, match="short"):
        corpus.first_per_class(rows, "g", "id", 30).collect()
    assert corpus.injection(80, 20, 10, 0.2) == 13
    notes = corpus.packed_notes(spark.createDataFrame([("g", i, "x" * 150) for i in range(7)], "grp string, position long, text string"), "grp").collect()
    assert [n.note for n in sorted(notes, key=lambda n: n.position)] == [0, 0, 1, 1, 2, 2, 3]


def test_decontamination(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words[10:17])), (3, "nothing here")], "id long, body string")
    banned = spark.createDataFrame([(" ".join(words[5:15]).upper(),)], "text string")
    assert [r.id for r in corpus.gram_hits(docs, banned).collect()] == [1]
    words = "café ä b c d e f g h"
    for made, sought in ((words, unicodedata.normalize("NFD", words)), (unicodedata.normalize("NFD", words), words)):
        assert corpus.gram_hits(spark.createDataFrame([(7, made)], "id long, body string"), spark.createDataFrame([(sought,)], "text string")).count() == 1
    assert sorted(r.id for r in corpus.decontaminated(docs, banned).collect()) == [2, 3]


def test_candidates_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(90, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if 0.3 <= x[i] @ x[j] < 0.8}
    for block in (4096, 20):
        assert {(r.a, r.b) for r in candidates.cosine_pairs(df, 0.3, 0.8, block=block).collect()} == want
    near = {r.id: r.distance for r in retrieval.knn_distance(df, 3).collect()}
    assert near[0] == pytest.approx(1 - np.sort(np.delete(x @ x[0], 0))[-3:].mean(), abs=1e-5)
    with pytest.raises(Exception, match="separator"):
        spark.range(1).select(candidates.pair_id(F.lit("a--b"), F.lit("c"))).collect()


def test_clusters(spark):
    rows = [
        ("c0", 1, "t", "Same body", ["x"], "note", "en", 5, 0.9), ("c0", 2, "t", "Same body", ["x"], "note", "en", 3, 0.2), ("c2", 3, "t", "b", ["x"], "note", "en", 1, 0.9), ("c2", 4, "t", "b", ["y"], "note", "en", 2, 0.1),
        ("c5", 5, "t", "B  b", ["x"], "note", "en", 9, 0.5), ("c5", 6, "u", "b b", ["x"], "note", "en", 8, 0.5), ("cm", 7, "t", "one", ["x"], "note", "en", 1, 0.8), ("cm", 8, "t", "two", ["x"], "note", "en", 2, 0.3),
    ]
    m = spark.createDataFrame(rows, "cluster string, member long, title string, body string, tags array<string>, record_type string, language string, created long, score double")
    assert {r.cluster: r["class"] for r in silver.cluster_class(m).collect()} == {"c0": "CH-0", "c2": "CH-2", "c5": "CH-5", "cm": "undefined"}
    zones = spark.createDataFrame([("cm", 0.9, 0.5, 1)], "cluster string, cos double, c5 double, z int")
    got = {r.cluster: (r.leg, r.verdict, r.member) for r in clusters.arbitrate(m, zones, 0.6, 0.1).collect()}
    assert got == {"c0": ("keep-oldest", "keep", 2), "c2": ("metadata", "abstain", None), "c5": ("keep-oldest", "keep", 6), "cm": ("model", "keep", 7)}
    low = spark.createDataFrame([("cm", 0.8, 0.01, 1)], zones.schema)
    assert {r.cluster: r.leg for r in clusters.arbitrate(m, low, 0.6, 0.1).collect()}["cm"] == "zone"


def test_fingerprints(spark):
    df = spark.createDataFrame([("b", "2"), ("a", "1")], "pair_id string, digest string")
    lines = fingerprints.manifest_lines(df)
    raw = fingerprints.manifest_bytes(lines)
    assert raw == b"a 1\nb 2\n"
    import hashlib

    assert lines.transform(fingerprints.manifest_sha256).first().fingerprint == hashlib.sha256(raw).hexdigest()
    assert fingerprints.blake2b_hex(b"") == hashlib.blake2b(b"", digest_size=32).hexdigest()
    assert fingerprints.labels_fingerprint(df, "pair_id", "digest") == hashlib.blake2b(b'{"a":"1","b":"2"}', digest_size=32).hexdigest()
    one, two = (fingerprints.chained_digest(df.repartition(n), F.sha2("pair_id", 256)).first()[0] for n in (1, 2))
    assert one == two
    with pytest.raises(ValueError, match="beside"):
        fingerprints.isolated_labels("/x/pairs.jsonl", "/x/labels.csv")
    fingerprints.isolated_labels("/x/pairs.jsonl", "/y/labels.csv")


def test_donors_are_missing_only_where_none_exists(spark):
    schema = "id long, title string, body string, tags array<string>, language string, record_type string"
    rows = [(i, f"T{i % 7}", "copied" if i % 3 else f"Body {i}", [f"t{i % 4}"], [None, "en"][i % 2], "note") for i in range(90)]
    rows += [(100, "T0", "copied", ["t0"], "fr", "fact"), (101, "T1", "only here", ["t1"], "es", "snippet"), (102, "T2", None, ["t2"], "es", "fact")]
    r = spark.createDataFrame(rows, schema)
    by_id = {x[0]: dict(zip(r.columns, x, strict=True)) for x in rows}
    for field in ("title", "body", "tags"):
        found = transforms.donors(r, field).collect()
        assert sorted(x.id for x in found) == sorted(by_id)
        assert all(x[f"donor_{field}"] == by_id[x.donor][field] != by_id[x.id][field] for x in found)
        assert all(by_id[x.donor]["language"] == by_id[x.id]["language"] for x in found if x.id < 100)
    out = [x for x in transforms.pretrain_pairs(r, languages=["en", "fr"], types=["note", "fact"]).collect() if x.label == 0]
    assert sorted(x.id for x in out) == sorted(by_id)
    changed = {"substitute": "body", "substitute-title": "title", "substitute-tags": "tags"}
    assert {x.strategy for x in out} == {*changed, "flip-language", "flip-type"}
    for x in out:
        if x.strategy in changed:
            assert [f for f in changed.values() if x[f] != by_id[x.id][f]] == [changed[x.strategy]]
    same = spark.createDataFrame([(i, "T", "same", ["t"], "en", "note") for i in range(5)], schema)
    assert transforms.donors(same).count() == 0


def test_transforms(spark):
    r = spark.createDataFrame([(i, f"T{i}", f"Body number {i}. Second one!", ["a", "b", "c"], ["en", "de"][i % 2], ["note", "fact"][i % 2]) for i in range(30)], "id long, title string, body string, tags array<string>, language string, record_type string")
    out = transforms.pretrain_pairs(r, languages=["de", "en"], types=["note", "fact"]).collect()
    assert sum(x.label for x in out) == 30 and len(out) <= 60 and {x.strategy for x in out} >= {"substitute", "flip-language", "flip-type"}
    assert all(x.body != f"Body number {x.id}. Second one!" for x in out if x.strategy == "substitute")
    one = lambda c: r.limit(1).select(c).first()[0]
    assert sorted(one(transforms.shuffle_tags(F.col("tags"), 3))) == ["a", "b", "c"]
    assert one(transforms.swap_sentences(F.lit("One. Two! Three?"))) == "Two! One. Three?"
    assert one(transforms.title_and_body(F.lit("```\nTitle\n\nrest of it\n```"))) == Row(title="Title", body="rest of it")
    assert one(transforms.strip_markers(F.lit("TITLE: x\nkeep"))) == Row(text="keep", stripped=1)
    assert one(transforms.clean_translation(F.lit('```\nTranslation: "hola"\n```'))) == "hola"
    assert one(transforms.first_json(F.lit('x [{"a": 1}] y'), "array<struct<a: int>>"))[0].a == 1
    slots = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "x"), ("s2", "y"), ("s2", "z")], "slot string, value string")
    assert len({tuple(x["values"]) for x in transforms.combinations(slots, 10).collect()}) == 6
    assert transforms.both_directions(spark.createDataFrame([(1, 2)], "a int, b int"), "a", "b").count() == 2


def test_neighbours_leave_a_task_only_if_they_rank(spark):
    """Several blocks, copies that tie, and products below -1: every row has its k best, ties to the smaller id."""
    import numpy as np

    x = np.random.default_rng(3).normal(size=(60, 4)).round(1)
    x[40:50] = x[3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<float>")
    dots = x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T
    want = {i: [j for _, j in sorted((-round(float(dots[i, j]), 6), j) for j in range(60) if j != i)[:3]] for i in range(60)}
    for block in (7, 1000):
        got = {}
        for r in candidates.knn(df, 3, block=block).orderBy("src", "rank").collect():
            got.setdefault(r.src, []).append(r.dst)
        assert got == want
    apart = spark.createDataFrame([(1, [2.0, 0.0]), (2, [-2.0, 0.0])], "id long, v array<double>")
    assert {r.id: r.best for r in retrieval.best_distractor(apart).collect()} == {1: -4.0, 2: -4.0}


def test_bucketed_cosines_in_blocks(spark):
    df = spark.createDataFrame([(i, [1.0 if i % 2 else 0.5, 0.0], i % 3 if i < 28 else None) for i in range(30)], "id long, v array<double>, label int")
    want = {(i, j) for i in range(28) for j in range(i + 1, 28) if i % 3 == j % 3 and not (i % 2 and j % 2) and (i % 2 or j % 2)}
    for block in (4, 100):
        got = [(r.a, r.b) for r in candidates.cosine_pairs(df, 0.3, 0.5, by="label", closed=True, block=block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_half_up_rounds_as_spark_does(spark):
    import numpy as np

    x = np.concatenate((np.arange(-2000, 2000) / 128, np.random.default_rng(1).normal(size=2000), [0.5000005, 1 / 640, -1e-9]))
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert candidates.half_up(x, 6).tolist() == want


def test_keyed_pairs_are_those_of_joined_rows(spark):
    """Blocks of any size, short and empty texts, nulls, letters beyond 16 bits: each pair once, its facts as from joined rows."""
    import random

    from pairloom.functions import text as T
    from pairloom.operators import keyed_pairs

    rng = random.Random(4)
    words = ["ab", "abc", "Ж1", "x9", "9.5", "zz", "café", "\U0001d54f\U0001d54f", "q"]
    rows = [(i, f"T {i % 3}" if i % 11 else None, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 12]))), rng.choice([["a", "b"], ["b", None], [], ["b", "a"]]), rng.choice(["ru", None, "en"]), rng.choice(["note", None]), "s" if i % 13 else None) for i in range(60)]
    df = spark.createDataFrame(rows, SIDE + ", source string").repartition(3)
    keys = [T.norm1(F.col("title")), F.col("source")]
    p = candidates.pairs_by_key(df.withColumn("ws", F.array_distinct(T.words(T.norm1(F.col("body"))))), keys, ["ws"])
    p = p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(T.jaccard(F.col("a_ws"), F.col("b_ws")), 4).alias("similarity"))
    x = features.pair_features(p, df).withColumns({"tags_eq": F.array_sort("a_tags") == F.array_sort("b_tags"), "type_eq": F.col("a_record_type") == F.col("b_record_type"), "lang_eq": F.col("a_language").eqNullSafe(F.col("b_language"))})
    side = lambda s: {n: F.col(f"{s}_{n}") for n in ("title", "body", "tags", "language", "record_type")}
    c5 = T.jaccard(T.char_grams(T.norm1(F.col("a_body")), 5), T.char_grams(T.norm1(F.col("b_body")), 5))
    x = x.withColumns({c: F.round(c, 6) for c in features.CORE if "jaccard" in c or "containment" in c}).withColumns({"class": silver.census_class(*map(F.col, ("a_title", "a_body", "b_title", "b_body", "tags_eq", "type_eq", "lang_eq"))), "zeps": silver.zeps(side("a"), side("b")), "c5": c5})
    wanted = ("a", "b", "similarity", *features.CORE, "class", "zeps", "c5")
    want = sorted(map(tuple, x.select(*wanted).collect()))
    assert len(want) > 300
    for most in (3, 1000):
        assert sorted(map(tuple, keyed_pairs.pair_facts(df, keys, wanted, most_rows=most).collect())) == want


def test_distinct_values_and_frequent_grams(spark, monkeypatch):
    """Values of a feature are counted by value, whatever tasks they come from; lists and matrix of grams count the same."""
    from pairloom.operators import keyed_pairs

    df = spark.createDataFrame([(i, "t", "abcdefgh"[: i % 7 + 1] * 3, ["x"], "en", "note") for i in range(20)], SIDE)
    made = []
    for share, most in ((0.0, 1000), (2.0, 4)):
        monkeypatch.setattr(keyed_pairs, "SHARE", share)
        rows = keyed_pairs.pair_facts(df, [F.col("title")], features.CORE, reduce=keyed_pairs.values_of, schema="feature string, value double", most_rows=most)
        made.append({r.feature: (r.n_distinct, r.constant) for r in metrics.distinct_by_name(rows).collect()})
    assert made[0] == made[1] and made[0]["tag_jaccard"] == (1, True) and made[0]["char3_jaccard"][0] > 2 and len(made[0]) == 13

import difflib
import itertools

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from pairloom.operators import models
from pairloom.plans.queries import ORACLE, QUERIES
from pairloom.sources import tables
from pairloom.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIGHT = ["hygiene_reasons", "metadata_states", "quality_score", "cosine_band_pairs", "edge_kinds_between", "connected_components", "graph_evidence", "first_seen_dedup", "stride_split", "largest_remainder", "shared_cap_quota", "binary_metrics", "gap_continuity", "manifest_reconcile", "revision_segments", "retrieval_rank", "arbitrate_clusters"]


def rows(found):
    return sorted((tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", LIGHT)
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE[name]})").fetchall()
    assert rows(tuple(r) for r in found.select(*names).collect()) == rows(want)


def test_edits_of_every_pair(spark, tmp_path):
    """Pairs of long and of quite different bodies have their rows, too; difflib on every pair is the plain version."""
    head = "One title that is forty characters long."
    bodies = [head, f"{head} short end", f"{head} short and", f"{head} " + "quite another text of many words " * 12, f"{head} " + "zebra, 12345! " * 40]
    docs = [(i, b, "en", "web", len(b)) for i, b in enumerate(bodies)] + [(9, "Alone", "en", "web", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    mass, hulls = {}, {}
    for a, b in itertools.combinations(range(len(bodies)), 2):
        edits = lambda x, y, junk: [c[1:] for c in difflib.SequenceMatcher(None, x, y, autojunk=junk).get_opcodes() if c[0] != "equal"]
        key = f"{a}--{b}"
        mass[key] = sum(max(i2 - i1, j2 - j1) for i1, i2, j1, j2 in edits(bodies[a], bodies[b], True))
        x, y = (" ".join(t.split()).lower() for t in (bodies[a], bodies[b]))
        found = edits(x, y, False)
        hulls[key] = sum(k == 0 or e[0] - found[k - 1][1] > 12 or e[2] - found[k - 1][3] > 12 for k, e in enumerate(found))
    assert {r.pair_id: r.mass for r in QUERIES["edit_mass"](spark, str(tmp_path)).collect()} == mass
    assert {r.pair_id: r.hulls for r in QUERIES["edit_hulls"](spark, str(tmp_path)).collect()} == hulls


def test_entry(spark):
    assert {"flagship_pairs"} <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_unordered_sql_is_complete():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 100


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(i, f"2024-01-01 0{i % 5}:10:00", ["a", "b"][i % 2], float(i)) for i in range(20)], "k long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = lambda: spark.readStream.schema(schema).parquet(source)

    def run(df, mode="append"):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{id(df)}")).start()
        q.processAllAvailable()
        q.stop()
        return spark.table("out").collect()

    assert sum(r.n for r in run(ingest.telemetry(stream()), "complete")) == 20
    assert len(run(ingest.unique_log(stream().withColumn("k", F.col("k") % 7), "k", "ts"))) == 7
    assert sum(r.n for r in run(ingest.sessions(stream().withColumnRenamed("k", "user_id")), "complete")) == 20


def test_ingest_decisions(spark, tmp_path):
    store = spark.createDataFrame([(1, "Hello  world"), (2, "other")], "id long, body string")
    new = spark.createDataFrame([(10, "hello WORLD"), (11, "new text")], "id long, body string")
    got = {r.id: (r.match, r.duplicate) for r in ingest.decisions(new, store, ingest.same_text).collect()}
    assert got == {10: (1, True), 11: (None, False)}
    new.write.parquet(str(tmp_path / "new"))
    q = ingest.watch(spark.readStream.schema(new.schema).parquet(str(tmp_path / "new")), store, ingest.same_text, str(tmp_path / "out"), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).where("duplicate").count() == 1


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([("x", 1, None), ("y", 2, "z")], "b string, a int, c string")
    tables.write_json_lines(df, f"{p}/j")
    assert sorted(r.value for r in spark.read.text(f"{p}/j").collect())[0] == '{"a":1,"b":"x","c":null}'
    assert tables.read_json_lines(spark, f"{p}/j", df.schema).count() == 2
    (tmp_path / "bad.jsonl").write_text("not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_json_lines(spark, f"{p}/bad.jsonl", df.schema).collect()
    tables.write_csv(df, f"{p}/csv")
    assert tables.read_csv(spark, f"{p}/csv", df.schema).count() == 2
    (tmp_path / "ids.txt").write_text("a1\n\n b2 \n")
    assert [r.id for r in tables.read_ids(spark, f"{p}/ids.txt").collect()] == ["a1", "b2"]
    (tmp_path / "wrong.txt").write_text("a--b\n")
    with pytest.raises(Exception, match="separator"):
        tables.read_ids(spark, f"{p}/wrong.txt").collect()
    log = spark.createDataFrame([("c1", 1), ("c2", 2), ("c1", 3)], "fingerprint string, n int")
    assert tables.append_log(log.limit(1), f"{p}/log", "fingerprint") == 0 and tables.append_log(log.where("n < 3"), f"{p}/log", "fingerprint") == 1
    assert spark.read.parquet(f"{p}/log").count() == 2
    blob = spark.sql("SELECT unhex('0000803F00000040') AS b").select(tables.float_vector("b").alias("v")).first().v
    assert blob == [1.0, 2.0]
    nested = spark.createDataFrame([('{"a": ["x", {"b": "y"}], "n": 1}',), ("bad",)], "j string")
    assert sorted(r.value for r in tables.strings_of_json(nested, "j").collect()) == ["x", "y"]
    with pytest.raises(ValueError, match="mode=ro"):
        tables.store_tables(uri="file:/x?mode=rw")
    both = tables.collect_sources({"one": df.select("a"), "two": df.select("a", "b")})
    assert both.groupBy("source_name").count().count() == 2


def test_models(spark, tmp_path):
    import numpy as np

    from pairloom.operators.features import CORE

    rng = np.random.default_rng(0)
    data = [(f"p{i:03d}", bool(i % 2), *[float(rng.normal(i % 2, 0.7)) for _ in CORE]) for i in range(80)]
    df = spark.createDataFrame(data, T.StructType([T.StructField("pair_id", T.StringType()), T.StructField("y", T.BooleanType())] + [T.StructField(c, T.DoubleType()) for c in CORE])).persist()
    model, a, b = models.train(df, trees=3, depth=2)
    scored = models.score(df, model, a, b)
    means = {r.y: r.m for r in scored.groupBy("y").agg(F.avg("p").alias("m")).collect()}
    assert a > 0 and means[True] > means[False] + 0.3
    manifest = models.save(model, str(tmp_path / "m"), name="pair", version="1", fingerprint="f", a=a, b=b)
    again, found = models.load(spark, str(tmp_path / "m"))
    assert found == manifest and abs(models.score(df, again, a, b).agg(F.sum("p")).first()[0] - scored.agg(F.sum("p")).first()[0]) < 1e-9
    assert models.fit_perceptron(df).transform(models.assembled(df)).count() == 80


def sift_documents(spark, path):
    head = "One title that is forty characters long."
    ends = ["", " a 1 b", " a 2 b", " a b", " a 1 2 b", " c date 5 d", " c date 6 d", " c updated then d", " plain words only", " plain other only", " a 1 b plain words", " 7", " a 1", " " + " ".join(map(str, range(70))), " всё это по-русски и совсем другое длинное дело, вот так и так"]
    bodies = [head + x for x in ends] + [head + "  A 1 B"]
    docs = [(i, b, ["en", "de"][i % 2], "web", len(b)) for i, b in enumerate(bodies)] + [(99, "Alone", "en", "web", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")


def test_verdicts_are_those_of_difflib(spark, tmp_path):
    """Pairs whose verdict needs no difflib have the same as by it, and no texts are joined to pairs."""
    from pairloom.operators import silver
    from pairloom.plans.queries import census

    sift_documents(spark, tmp_path)
    found = QUERIES["sift_pairs"](spark, str(tmp_path))
    want = silver.sift(census(spark, str(tmp_path))).select("pair_id", "verdict")
    got = {r.pair_id: r.verdict for r in found.collect()}
    assert got == {r.pair_id: r.verdict for r in want.collect()} and len(got) == 120
    assert {"disputed", "dup-silver", "not-dup-razor", "not-dup-metadata", "not-dup-razor+disputed"} <= set(got.values())
    assert "a_body" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["edit_mass", "edit_hulls"])
def test_edits_join_no_texts_to_pairs(spark, tmp_path, name):
    sift_documents(spark, tmp_path)
    found = QUERIES[name](spark, str(tmp_path))
    assert found.count() == 120 and "a_body" not in found._jdf.queryExecution().toString()


def test_scores_of_pairs_join_no_texts(spark, sf_dir, monkeypatch):
    taken = []
    monkeypatch.setattr(models, "train", lambda x, **options: taken.append(x) or (None, 1.0, 0.0))
    monkeypatch.setattr(models, "score", lambda x, *a: x.withColumn("p", F.lit(0.5)))
    QUERIES["gbt_scores"](spark, sf_dir)
    assert "a_body" not in taken[0]._jdf.queryExecution().toString()
    taken[0].unpersist()


def sequences(rng):
    """Texts that differ much, little and not at all, over few and many characters; some long enough for popular ones."""
    out = []
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz " * 6 + "ABCD0123.,", "aab c e t \U0001d54f9"):
        made = ["".join(rng.choices(letters, k=n)) for n in (0, 1, 30, 150, 199, 200, 420)]
        for _ in range(6):
            x = rng.choice(made)
            p = rng.randrange(len(x) + 1)
            made.append(x[:p] + rng.choice(["", "".join(rng.choices(letters, k=9)), x[:p]]) + x[p + rng.randrange(20) :])
        out.append([*made, made[-1]])
    return out


@pytest.mark.parametrize("mode", ["mass", "hulls", "verdict"])
def test_edits_in_the_jvm_are_those_of_difflib(spark, mode):
    """Runs of any least length, and difflib's own search where a pair has too many, in one block and between two."""
    import random

    from pairloom.functions import native, udfs

    groups = sequences(random.Random(5))
    if mode == "verdict":
        groups = [[" ".join(random.Random(len(t)).choices(["a", "b", "c", "1", "x9²", "date", "updated:", *t.split()], k=len(t) // 4)) for t in g] for g in groups]
    rows = [(g, i, i % 2, t, 1, None if i % 3 else "m") for g, texts in enumerate(groups) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g int, id long, own int, text string, script int, meta string").groupBy("g").agg(F.collect_list(F.struct("id", "own", "text", "script", "meta")).alias("rows"))
    want = {}
    for g, texts in enumerate(groups):
        for i, j in itertools.combinations(range(len(texts)), 2):
            p, q = (x.split() if mode == "verdict" else x for x in (texts[i], texts[j]))
            found = difflib.SequenceMatcher(None, p, q, autojunk=mode == "mass").get_opcodes()
            n = udfs.token_counts(found, p, q, native.MARKERS) if mode == "verdict" else {}
            verdict = lambda: (2 if i % 3 or j % 3 else 1) if p == q else 3 + (n["razor"] > 0) + 2 * (n["other"] > 0)  # noqa: B023, E731
            want[g, i, j] = udfs.mass_of(found) if mode == "mass" else len(udfs.hulls_of(found)) if mode == "hulls" else verdict()
    for run, most, within in ((native.RUN, native.MOST, True), (2, native.MOST, False), (8, native.MOST, True), (4, 10, True), (5, 0, False)):
        made = df.select("g", F.inline(native.edits(spark, mode, F.col("rows"), F.lit(within), run=run, most=most)))
        assert {(r.g, r.a, r.b): r.value for r in made.collect()} == {k: v for k, v in want.items() if within or k[1] % 2 != k[2] % 2}


def test_a_group_of_long_texts_has_its_hulls_in_seconds(spark, tmp_path):
    """2,016 pairs of 3,000 characters: about a second a pair by difflib."""
    import random
    import time

    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 7))) for _ in range(300)]
    docs = [(i, "One title that is forty characters long. " + " ".join(rng.choices(words, k=540)), "en", "web", 0) for i in range(64)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = {r.pair_id: r.hulls for r in QUERIES["edit_hulls"](spark, str(tmp_path)).collect()}
    assert len(got) == 2016 and time.time() - began < 120
    x, y = (" ".join(docs[i][1].split()).lower() for i in (3, 50))
    from pairloom.functions import udfs

    assert got["3--50"] == len(udfs.hulls_of(difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()))


def test_verdicts_of_equal_texts_go_by_metadata(spark):
    """Tags in any order are the same, no tags are as null, null languages are equal and null types are not; blocks of any size."""
    from pairloom.operators import keyed_pairs

    sides = [(["a", "b"], "en", "note"), (["b", "a"], "en", "note"), (["b", None], "en", "note"), ([None, "b"], "en", "note"), ([], None, "note"), (None, None, "note"), ([], "", "note"), ([], None, None), ([], None, None), (["a"], "en", "fact")]
    rows = [(i, "t", ["One two", "one  TWO"][i % 2], *s) for i, s in enumerate(sides)] + [(None, "t", "one two", [], "en", "note")]
    df = spark.createDataFrame(rows, "id long, title string, body string, tags array<string>, language string, record_type string")
    for most in (2, 100):
        made = keyed_pairs.pair_edits(df, [F.col("title")], "verdict", most_rows=most).collect()
        assert len(made) == 45 and {(r.a, r.b) for r in made if r.verdict == "dup-silver"} == {(0, 1), (2, 3), (4, 5)}
        assert {r.verdict for r in made} == {"dup-silver", "not-dup-metadata"}

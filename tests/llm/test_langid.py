from pairloom.llm import langid
from pairloom.llm.learning import remainder
from pairloom.llm.queries import QUERIES


def test_frames(spark):
    rows = [(i, t, lang, "x") for i in range(40) for lang, t in (("aa", "the quick brown fox jumps over the lazy dog and runs home " * 2), ("bb", "el perro come la comida en la casa grande de mi amigo bueno " * 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df, per_lang=32)
    tests = [(1, "the brown dog runs over the fox " * 4, "aa"), (2, "LA COMIDA DE MI AMIGO EN LA CASA " * 4, "bb"), (3, None, "und"), (4, "", "und"), (5, "12 .,! 34", "und"), (6, "the lazy dog jumps " * 30_000, "aa"), (1, "the brown dog runs over the fox " * 4, "aa")]
    got = langid.identified(spark.createDataFrame([(i, t, "q") for i, t, _ in tests], "doc_id long, text string, score string").coalesce(1), model).collect()
    assert [r.lang_pred for r in got] == [x for _, _, x in tests]
    assert all(0 <= r.score <= 1 for r in got) and got[0] == got[-1] and not got[0].rejected and got[2].rejected
    empty = df.limit(0)
    assert langid.fit(empty) == [] and langid.identified(empty, []).count() == 0
    assert {r.lang_pred for r in langid.identified(df, []).collect()} == {"und"}


def plain_choice(dictionaries, text):
    if text is None or not any(c.isalpha() for c in text):
        return "und"
    raw, sizes = text.lower().encode(), []
    for name, dictionary in dictionaries:
        press = langid.Languages([(name, dictionary)], 6, 4096).presses[0]
        total, at = 0, 0
        while at < len(raw):
            total += len(press(raw[at : at + 4096]))
            at += 4096
        sizes.append(total)
    return dictionaries[sizes.index(min(sizes))][0]


def test_learns_from_the_end_of_long_texts(spark):
    junk = "0123456789 " * 900
    rows = [(i, junk + t * 60, lang) for i in range(60) for lang, t in (("aa", "the quick brown fox jumps over the lazy dog "), ("bb", "el perro come la comida en la casa grande "))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    tests = [(1, "a lazy brown dog jumps over the fox " * 3), (2, "la casa grande come en la comida " * 3)]
    assert [r.lang_pred for r in langid.identified(spark.createDataFrame(tests, "doc_id long, text string").coalesce(1), model).collect()] == ["aa", "bb"]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("out", remainder("doc_id", 4) == 2)
    model = langid.fit(docs.where("NOT out"))
    got = {r.doc_id: r for r in QUERIES["op10_langid"](spark, sf_dir).collect()}
    docs = docs.collect()
    assert len(got) == len(docs) and all(got[d.doc_id].held_out == d.out for d in docs)
    assert all(got[d.doc_id].lang_pred == plain_choice(model, d.text) for d in docs)
    out = [d for d in docs if d.out]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in out) >= 0.95 * len(out)

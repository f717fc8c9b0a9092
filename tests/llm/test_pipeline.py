"""The pipeline's stages over a small corpus."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

SYLLABLES = "ba de lo mi nu ra si to ve ka".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    good = [sentence(rng, 90) for _ in range(60)]
    junk = [" ".join(f"{w.upper()}!!" for w in sentence(rng, 80).split()) for _ in range(40)]
    passage, item = sentence(rng, 70), sentence(rng, 40)
    texts = good + junk + [good[0], good[1] + " more", sentence(rng, 40) + " " + passage, sentence(rng, 40) + " " + passage, f"{sentence(rng, 30)} {item} {sentence(rng, 30)}"]
    docs = spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(100)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now, kept = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    clean = set(range(60))
    assert clean <= kept["quality"] and not kept["quality"] & set(range(60, 100))
    assert kept["near_duplicates"] == kept["quality"] - {100, 101}
    assert kept["suffix_repeats"] == kept["near_duplicates"] and kept["decontamination"] == kept["suffix_repeats"] - {104} and kept["sentencepiece"] == kept["decontamination"]
    cut = spark.read.parquet(f"{tmp_path}/stage2")
    second = cut.where("doc_id = 103").first()
    assert passage not in second.text and second.n_chars == len(second.text) < 400
    assert cut.where("doc_id = 102").first().text == texts[102] and now.where(F.size("ids") != F.col("n_pieces")).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["sentencepiece"])


def test_near_duplicates_between_the_thresholds(spark):
    words = [f"w{k}" for k in range(28)]  # 24 shingles
    rows = [(1, words), (2, words[:26] + ["x", "y"]), (3, words[:13] + ["x"] + words[14:])]  # 22 of 26 = 0.846 and 19 of 29 = 0.66
    docs = spark.createDataFrame([(k, " ".join(w), "en", "s", 1) for k, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").orderBy("doc_id").collect()] == [1, 3]
    assert {r.kept for r in corpus_pipeline.near_duplicates(docs).collect()} == {True}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_with_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c, d = (sentence(rng, 60) for _ in range(4))
    near_a = " ".join(a.split()[:-1] + ["changed"])
    rows = [(7, a), (7, a), (9, b), (9, a), (9, ""), (None, c), (None, c), (None, d), (11, None), (7, near_a), (12, near_a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).withColumns({x: F.lit(x) for x in ("id", "row", "document", "kept", "first", "node")})
    out = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    of_a = [(i, t) for i, t in got if t in (a, near_a)]
    assert len(of_a) == 1 and of_a[0][0] == 7
    assert sorted(str(x) for x in got if x not in of_a) == sorted(str(x) for x in [(9, b), (9, ""), (None, c), (None, d), (11, None)])


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    rng = random.Random(4)
    item = sentence(rng, 30)
    texts = [sentence(rng, 90) for _ in range(12)] + [f"{sentence(rng, 30)} {item} {sentence(rng, 30)}", None, ""]
    clash = {x: F.lit(x) for x in ("ids", "document", "id", "row", "doc", "tie", "spans", "score", "predicted", "words", "h", "n_pieces", "_text")}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA).withColumns(clash)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "sentencepiece":
            assert now.columns == docs.columns
    assert {r.doc_id for r in now.collect()} == {*range(12), 13, 14} and now.columns == ["doc_id", "lang", "source", "n_pieces", "ids"]
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("1 = 0").write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_intermediate_tables_can_be_dropped(spark):
    import os

    from gridloom.llm import common

    kept = common.shared_table(spark.range(3))
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(folder)
    common.drop_shared_tables(spark)
    assert not os.path.isdir(folder)

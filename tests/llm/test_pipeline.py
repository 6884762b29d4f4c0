import os
import random

import pytest

import corpus_pipeline
from tidewell.llm import language_id, quality
from tidewell.llm.shared import in_arrow

LETTERS = {"aa": "abcdefg", "bb": "uvwxyzé"}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out, docs, labels = random.Random(6), str(tmp_path_factory.mktemp("sf")), [], []
    for i in range(240):
        lang = rng.choice(["aa", "bb"])
        text = words(rng, lang, rng.randrange(30, 120))
        good = i % 5 != 0
        docs.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), lang, "s", 1))
        labels.append((i, int(good), 0))
    docs += [(300, None, "aa", None, None), (301, "", None, "s", 0), (302, "123 456", "bb", "s", 1)]
    docs += [(310 + k, docs[7][1] + " " * k, "aa", "s", 1) for k in range(3)]  # copies, the longest stays
    long = words(rng, "aa", 3000)
    docs += [(320, long, "aa", "s", 1), (321, long + " tail", "aa", "s", 1)]  # a near copy
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == corpus_pipeline.COLUMNS
        path = os.path.join(folder, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"] for r in docs.collect()}
    assert not kept["language"] & {300, 301, 302} and len(kept["language"]) >= 240
    assert sum(i % 5 == 0 for i in kept["quality"] if i < 240) <= 4 and sum(i % 5 != 0 for i in kept["quality"] if i < 240) >= 188
    assert kept["quality"] - kept["exact_dedup"] == {7, 310, 311} & kept["quality"] and 312 in kept["exact_dedup"]
    assert kept["exact_dedup"] - kept["near_dedup"] == {321}


def test_run_packs_what_the_stages_keep(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in found}
    assert 320 in ids and not ids & {300, 301, 302, 321, 310, 311}
    for i in ids:
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in found if r["doc_id"] == i)
        assert [a for a, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]


def test_repeated_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id in (1, 2, 3)")
    twice = docs.unionByName(docs).unionByName(docs.limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", "'alone' AS text", "lang", "source", "n_chars"))
    got = sorted(str(r["doc_id"]) for r in corpus_pipeline.without_copies(spark, twice, folder).collect())
    assert got == ["1", "2", "3", "None"]
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.without_near_copies(spark, docs.limit(0), folder).collect()) == []


def test_five_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "exact_dedup", "near_dedup", "packing"]


def test_stages_with_odd_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:  # empty tables, extra columns with names that operators use, no n_chars
        clashing = docs.drop("n_chars").selectExpr("*", "'x' AS node", "1 AS fp", "'y' AS quality_score", "2 AS lang_score", "'z' AS digest", "3 AS tokens", "4 AS _id")
        got = stage(spark, clashing.limit(0), folder)
        assert got.collect() == [] and (name == "packing" or got.columns == corpus_pipeline.COLUMNS)
    rows = [(1, None), (1, ""), (2, "one two"), (None, "abc def"), (3, "long " * 60_000), (3, "long " * 60_000)]
    odd = spark.createDataFrame([(i, t, "aa", "s", 1, "n", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, fp int")
    near = corpus_pipeline.without_near_copies(spark, odd, folder).collect()
    assert sorted(str(r["doc_id"]) for r in near) == ["1", "1", "2", "3", "3", "None"]
    exact = corpus_pipeline.without_copies(spark, odd, folder).collect()
    assert sorted(str(r["doc_id"]) for r in exact) == ["1", "2", "3", "None"]
    packed = corpus_pipeline.packed(spark, odd, folder).collect()
    assert sum(r["length"] for r in packed if r["start"] + r["length"] == r["doc_tokens"]) > 0 and {r["doc_id"] for r in packed} == {1, 2, 3, None}
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, odd, folder).collect()} <= {2, 3, None}
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.good_quality(spark, odd, str(tmp_path)).count() == 6  # without labels all stay


@pytest.mark.parametrize("module", [language_id, quality])
def test_carried_texts_are_sent_to_python_once(spark, monkeypatch, module):
    rows = [(1, "der Hund und die Katze", "de", 1), (2, "the dog and the cat", "en", 0), (3, None, "en", 0), (4, "", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    model = language_id.ByteGRU.start(["de", "en"]) if module is language_id else quality.fit(df.drop("quality"), df)
    sent = []
    monkeypatch.setattr(module, "in_arrow", lambda frame, run, schema: sent.append(frame.columns) or in_arrow(frame, run, schema))
    scored = module.predict if module is language_id else module.with_scores
    name = "lang_score" if module is language_id else "quality_score"
    plain, carried = scored(df, model).collect(), scored(df, model, ("doc_id", "text", "lang")).collect()
    assert sum("text" in c for c in sent[1]) == 1 and sum("text" in c for c in sent[0]) == 1
    assert {r["doc_id"]: r[name] for r in plain} == {r["doc_id"]: r[name] for r in carried} and {r["text"] for r in carried} == {r[1] for r in rows}

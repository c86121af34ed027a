import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_near_dup import brute, mutated

from tessera.llm import langid, pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog while children were watching from their window in the house".split()
DE = "der schnelle braune fuchs springt über den faulen hund während die kinder aus dem fenster schauten".split()


def fixture():
    rng = random.Random(6)
    texts = []
    for words, lang in ((EN, "en"), (DE, "de")):
        for _ in range(12):
            base = [rng.choice(words) for _ in range(rng.randint(20, 90))]
            texts += [(mutated(rng, base, rng.randint(0, 2)), lang) for _ in range(rng.randint(1, 4))]
    texts += [(None, "en"), ("", "en"), ("12 + 34 !", "de"), ("漢字漢字", "en"), (" ".join(EN) + " j [at] b [dot] com", "en"),
              (" ".join(DE) + " ruf +49 (30) 1234567 an", None), (" ".join(EN * 2000) + " a@b.cd", "en")]
    rng.shuffle(texts)
    rows = [(i, t, x, rng.choice(["s", None]), len(t or "")) for i, (t, x) in enumerate(texts)]
    return rows + [rows[3], (None, " ".join(EN[::-1] * 3), "en", "s", 1)]


def test_each_stage_against_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.dtypes == spark.createDataFrame([], COLUMNS).dtypes, name
        kept[name] = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame(kept[name], COLUMNS)
    spoken = [r for r in rows if r[1] and any(w.isalpha() and w.isascii() for w in r[1].split())]
    assert sorted(kept["language_id"], key=str) == sorted(spoken, key=str)
    stays = {d for d, _, _, own in brute([(r[0], r[1]) for r in spoken]) if own and d is not None}
    once = {r[0]: r for r in spoken if r[0] in stays}
    assert sorted(kept["near_dedup"], key=str) == sorted(
        [*once.values(), *(r for r in spoken if r[0] is None)], key=str)
    want = [(i, t, x, s, len(t)) for i, u, x, s, _ in kept["near_dedup"] for t in [pii.redact(u)]]
    assert sorted(kept["pii"], key=str) == sorted(want, key=str)
    assert sum("[EMAIL]" in t for _, t, *_ in kept["pii"]) == 2 and sum("[PHONE]" in t for _, t, *_ in kept["pii"]) == 1
    out = corpus_pipeline.run(spark, str(tmp_path))
    words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert words == {i: len(t.split()) for i, t, *_ in kept["pii"]}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rejection_uses_only_the_text(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, COLUMNS)
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id")))
    a = docs.select("doc_id", langid.identify(docs, model).alias("f"))
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    b = other.select("doc_id", langid.identify(other, model).alias("f"))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))

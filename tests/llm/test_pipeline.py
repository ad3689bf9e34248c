"""The pipeline's stages on a given table: every stage's decisions follow from its operator and take effect."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mistgrove.llm.common import clear, documents, stored
from mistgrove.llm.decontaminate import find_leaks
from mistgrove.llm.jaccard import jaccard_groups

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = documents(spark, FOLDER), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = stored(stage(spark, docs, FOLDER), f"test-{name}")
    return [*out, docs]


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(results):
    assert all(r.columns == results[0].columns for r in results[:-1])
    assert {"doc_id", "text", "shard", "slot"} <= set(results[-1].columns)


def test_toxic_texts_go_and_clean_ones_stay(spark, results):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    insults = "loser|idiot|pathetic|scum|worthless|moron|trash|clown|disgusting|stupid"
    plain = results[0].join(labels.where("toxic = 0"), "doc_id").where(~F.lower("text").rlike(insults))
    kept = results[1].join(plain.select("doc_id"), "doc_id").count()
    assert kept >= 0.9 * plain.count()
    assert results[1].count() < results[0].count()


def test_one_of_each_group_stays(results):
    groups = jaccard_groups(results[1], width=5, percent=80).where("n_shingles > 0")
    assert ids(results[2].join(groups, "doc_id")) == Counter({r[0]: 1 for r in groups.select("component_id").distinct().collect()})


def test_no_item_is_left(spark, results):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert find_leaks(results[3], items).count() == 0
    assert ids(results[2]) - ids(results[3]) == Counter(dict.fromkeys((r[0] for r in find_leaks(results[2], items).select("doc_id").collect()), 1))


def test_mixture_and_places(results):
    assert max(ids(results[4]).values()) <= 2 and ids(results[5]) == ids(results[4])
    for j in range(8):
        slots = [r["slot"] for r in results[5].where(F.col("shard") == j).collect()]
        assert sorted(slots) == list(range(len(slots)))


def test_run_is_its_stages(spark, results):
    out = corpus_pipeline.run(spark, FOLDER)
    assert Counter(map(str, out.select(*results[5].columns).collect())) == Counter(map(str, results[5].collect()))
    clear(spark)


def test_near_copies_by_five_words_and_four_fifths(spark):
    made = random.Random(9)
    texts = []
    for _ in range(8):
        base = [f"w{made.randrange(500)}" for _ in range(100)]
        texts.append(base)
        for changed in ([50], [30, 70], [20, 50, 80], [10, 35, 60, 85]):  # the second: under 0.9 by three words, over 0.8 by five
            texts.append([f"x{made.random()}" if i in changed else w for i, w in enumerate(base)])
    made.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min(i for i, x in enumerate(group) if x == g) for g in group}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert ids(corpus_pipeline.one_of_each_group(spark, docs, FOLDER)) == Counter(least.values())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder whose documents have clashing extra columns, null and repeated ids, and no label."""
    folder = str(tmp_path_factory.mktemp("odd"))
    made = random.Random(4)
    words = [f"word{k}" for k in range(400)]
    texts = [" ".join(made.choices(words, k=60)) for _ in range(30)]
    item = " ".join(made.choices(words, k=40))
    rows = [(i, t, "en", "ab"[i % 2], 1) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "a", 1), (None, "alone " + texts[1][::-1], "en", "a", 1), (2, "other " + " ".join(made.choices(words, k=50)), "en", "b", 1)]
    rows += [(None, f"{texts[3][:100]} {item} {texts[4][:100]}", "en", "a", 1), (77, None, None, None, None), (78, "", "en", "a", 0), (78, "", "en", "a", 0)]
    extra = "row long, gone long, size long, shard int, slot long, old_shard int, text_crc32 long, _id long, _text string, _score double, toxicity double, key long, part int, home int"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    filled = [(*r, 1, 2, 3, 4, 5, 6, 7, 8, "t", 0.5, 0.6, 9, 10, 11) for r in rows]
    spark.createDataFrame(filled, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, item


def test_odd_tables(spark, odd, tmp_path):
    folder, rows, item = odd
    docs = documents(spark, folder)
    assert corpus_pipeline.without_toxic(spark, docs, folder).count() == len(rows)
    once = corpus_pipeline.one_of_each_group(spark, docs, folder)
    assert once.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in once.collect()) == Counter((r[0], r[1]) for r in rows) - Counter([(None, rows[0][1])])
    clean = corpus_pipeline.without_leaks(spark, docs, folder)
    assert Counter(r["text"] for r in clean.collect()) == Counter(r[1] for r in rows if not (r[1] and item in r[1]))
    corpus_pipeline.run(spark, folder).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {"shard", "slot", "_shard", "_slot", "_size", "_text", "__text"} - set(out.columns) == {"__text"}
    assert {r["_shard"] for r in out.collect()} == {4}


def test_empty_corpus(spark, odd, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{odd[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_equal_texts_share_a_shard(results):
    sizes = {r["text_crc32"]: r["s"] for r in results[5].groupBy("text_crc32").agg(F.sum("size").alias("s")).collect()}
    parted = [r["text_crc32"] for r in results[5].groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").collect()]
    assert all(sizes[c] > sum(sizes.values()) // (8 * 512) for c in parted)

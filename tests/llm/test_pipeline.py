"""The pipeline's stages, each alone and in a row."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from cohortspark.llm import mixing, simhash
from cohortspark.llm.common import documents

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_survive_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, rank string"
    pick = random.Random(1)
    word = lambda letters: "".join(pick.choice(letters) for _ in range(4))
    rows = [(i, " ".join(word("abcd" if i % 2 else "wxyz") for _ in range(40)), "aa" if i % 2 else "bb", f"s{i % 3}", 199, 0.5, "r") for i in range(60)]
    rows += [rows[5], rows[5], (70, rows[6][1], "bb", "s0", 199, 0.1, None), (None, rows[7][1], None, None, None, None, None), (80, None, "aa", "s1", 0, 0.0, "r"), (81, "", "aa", None, 0, 0.0, "r")]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, docs, SMALL)
            if name != "packing":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), schema)
            else:
                assert (out.count() > 0) == bool(table)
            if table and name == "language_id":
                assert docs.count() == len(table) - 2
            if table and name == "near_duplicates":
                kept = [r["doc_id"] for r in docs.collect()]
                assert kept.count(5) == 1 and 70 not in kept and 6 in kept and kept.count(None) == 1


def planted(pick):
    """Long texts with few edits, chains of edits, exact copies, short texts and texts without words."""
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(5))
    texts = []
    for n in (50, 400, 3000):
        for edits in (0, 1, 2, 3):
            first = [word() for _ in range(n)]
            other = list(first)
            for at in pick.sample(range(n), edits):
                other[at] = word()
            texts += [" ".join(first), "  ".join(other).upper()]
    many = [word() for _ in range(1500)]
    for copy in range(40):
        texts.append(" ".join(many))
        many[pick.randrange(1500)] = word()
    return [*texts, "Just three words", "just  three WORDS", "three other words", "", " \n", "one", "One two"]


def test_near_copies_match_brute_force(spark):
    texts = planted(random.Random(5))
    bits = [simhash.fingerprint(t, 3, 42) for t in texts]
    root = list(range(len(texts)))
    near = 0
    for i in range(len(texts)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 2:
                near += bits[i] != bits[j]
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert near > 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_rows_of_one_id_keep_the_representative_of_each_group(spark):
    copy, clean = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(1, copy), (2, copy), (2, clean), (2, clean), (3, clean.upper())], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert sorted(map(tuple, kept.collect())) == [(1, copy), (2, clean)]


def test_a_rare_source_reaches_its_target_beside_a_large_one(spark):
    """200 documents of 10 words and a source of one word, whatever the number of shards."""
    pick = random.Random(2)
    rare = [(i, " ".join(str(pick.randrange(99)) for _ in range(10)), "b") for i in range(200)]
    large = [(1000 + i, "word " * 400, "a") for i in range(300)]
    docs = spark.createDataFrame([*rare, *large, (5000, "word", "c")], "doc_id long, text string, source string")
    for shard_words in (400, 4000, 1 << 22):
        found = mixing.mix_sources(docs, shard_words=shard_words)
        sums = {r["source"]: (r["taken"], r["target"]) for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
        assert sums["c"][0] == 3 and all(abs(taken - target) <= 10 for taken, target in sums.values()), sums
        assert found.filter("taken > 3 * size").count() == 0
        mixed = mixing.take_words(docs, shard_words=shard_words).groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n"))
        assert {r["source"]: r["n"] for r in mixed.collect()} == {s: taken for s, (taken, _) in sums.items()}


def test_rows_alike_share_a_quota_exactly(spark):
    """1 000 equal rows, by ids or without any, with other columns that differ."""
    for doc_id in (7, None):
        rows = [(doc_id, "a b c d e f", "s", i) for i in range(1000)] + [(100 + i, "x y z " * 9, "t", i) for i in range(82)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, i int").repartition(5)
        want = {r["source"]: r["taken"] for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
        mixed = mixing.take_words(docs)
        got = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()}
        assert got == want and got["s"] % 6 and mixed.groupBy("source", "i").agg(F.sum(mixing.word_count("text")).alias("n")).filter("source = 's'").agg(F.max("n")).first()[0] <= 18


def test_mixing_moves_no_texts(spark):
    from helpers import plan

    docs = spark.createDataFrame([(i, f"w{i} " * 9, "ab"[i % 2]) for i in range(100)], "doc_id long, text string, source string")
    text = plan(mixing.take_words(docs))
    exchanges = [part for part in text.split("\n\n") if ") Exchange" in part]
    assert not any("row#" in part.replace("numbered", "") and "part#" not in part for part in exchanges)


def test_run_packs_what_the_stages_keep(spark):
    pieces = corpus_pipeline.run(spark, SMALL)
    ids = documents(spark, SMALL).select("doc_id")
    assert pieces.select("doc_id").subtract(ids).count() == 0
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.filter("n <> end or n > 1024").count() == 0

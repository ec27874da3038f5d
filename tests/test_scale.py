"""Skew handling, exact distributed ranks, vector search, plan shapes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from mailglass.functions.join import broadcast_limit, lookup_join
from mailglass.functions.ranking import dense_index, hash_cut
from mailglass.operators import behavior, corpus, models, monitor, similarity, urls
from mailglass.plans.bindings import view


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def same(a, b):
    b = b.select(a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_join_with_hot_and_missing_keys(spark, no_broadcast):
    facts = spark.range(6000).select("id", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"))
    dim = spark.range(450).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for hot_rows in (50, 10**6):
        same(lookup_join(facts, dim, ["k"], "id", hot_rows=hot_rows), facts.join(dim, ["k"], "left"))


def test_hot_pairs_give_the_same_history(spark):
    rows = [(i, "s", "r" if i % 3 else "q", dt.datetime(2024, 1, 1) + dt.timedelta(hours=(i * i) % 997), int(i % 41 == 0)) for i in range(600)]
    history = spark.createDataFrame(rows, "id long, sender string, recipient string, timestamp timestamp, is_phishing int")
    same(behavior.pair_history(history), behavior.pair_history(history, hot_rows=10))


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in (5, 9, 1000000, 7, 2)], "id long")
    assert [(r.id, r.at) for r in dense_index(df, "id", "at").orderBy("id").collect()] == [(2, 0), (5, 1), (7, 2), (9, 3), (1000000, 4)]


def test_split_shares_are_exact_and_repeatable(spark):
    df = spark.range(1003).select("id", (F.col("id") % 7 == 0).cast("int").alias("is_phishing"))
    parts = corpus.split(df)
    counts = {(r.is_phishing, r.split): r["count"] for r in parts.groupBy("is_phishing", "split").count().collect()}
    assert counts == {(0, "test"): 172, (0, "validation"): 86, (0, "train"): 601, (1, "test"): 29, (1, "validation"): 15, (1, "train"): 100}
    same(parts, corpus.split(df.repartition(5)))
    assert corpus.balance(df).groupBy("is_phishing").count().collect()[0]["count"] == 144
    assert corpus.sample_at_most(df, 100).count() == 100 and corpus.sample_at_most(df, 5000).count() == 1003


def test_deduplicate_keeps_the_first_and_is_idempotent(spark):
    rows = [(1, 5, "a"), (1, 3, "a"), (2, 1, "a"), (1, 9, "b"), (2, 2, None), (1, 8, None)]
    df = spark.createDataFrame(rows, "source_ord int, id long, body string")
    once = corpus.deduplicate(df)
    assert sorted((r.source_ord, r.id) for r in once.collect()) == [(1, 3), (1, 8), (1, 9)]
    same(once, corpus.deduplicate(once))


@pytest.mark.parametrize("threshold", [-2.0, 0.4, 0.9])
def test_block_search_is_exact(spark, threshold):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    base = centres[rng.integers(0, 6, 400)] + 0.4 * rng.normal(size=(400, 16))
    base[100:240] = base[100]  # a third of the rows are copies of one vector
    base[399] = 0.0
    asked = base[rng.integers(0, 399, 60)] + 0.1 * rng.normal(size=(60, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "id long, embedding array<double>")
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    sims = np.round(unit(asked) @ unit(base).T, 9)
    expected = set()
    for q in range(60):
        order = np.lexsort((np.arange(400), -sims[q]))[:5]
        expected |= {(q, int(i)) for i in order if sims[q, i] >= threshold}
    for options in ({}, {"broadcast_rows": 0, "block_rows": 32}):
        got = {(r.query_id, r.id) for r in similarity.search_similar(table, queries, 5, threshold, **options).collect()}
        assert got == expected


def test_vote_is_the_same_with_many_examples(spark):
    rng = np.random.default_rng(5)
    examples = spark.createDataFrame([(i, rng.normal(size=8).tolist(), i % 3 == 0) for i in range(30)], "id long, embedding array<double>, is_phishing boolean")
    queries = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(50)], "id long, embedding array<double>")
    short = {r.query_id: (round(r.phishing_probability, 6), round(r.confidence, 6)) for r in similarity.knn_vote(examples, queries).collect()}
    long = {r.query_id: (round(r.phishing_probability, 6), round(r.confidence, 6)) for r in similarity.knn_vote(examples, queries, broadcast_rows=5).collect()}
    assert short == long and len(short) == 50
    assert {(r.phishing_probability, r.confidence) for r in similarity.knn_vote(examples.limit(0), queries).collect()} == {(0.5, 0.0)}


def test_auc_agrees_with_the_evaluator(spark):
    df = spark.range(2000).select(((F.col("id") * 7919) % 101 / 100.0).alias("s"), ((F.col("id") * 31) % 7 < 3).cast("int").alias("y"))
    ours = models.roc_auc(df, "s").first().auc
    theirs = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(df)
    assert ours == pytest.approx(theirs, abs=1e-6)


def test_encoder_hook_sees_whole_texts_in_batches(spark):
    df = spark.createDataFrame([(i, "x" * (i * 500)) for i in range(40)], "id long, body string").coalesce(1)
    out = models.embed(df, lambda texts: np.array([[len(t), len(texts)] for t in texts]), batch=16).collect()
    assert {r.id: int(r.embedding[0]) for r in out} == {i: i * 500 for i in range(40)}
    assert max(r.embedding[1] for r in out) <= 16


def test_filters_and_columns_reach_the_scan(spark, data):
    df = spark.read.parquet(f"{data}/events.parquet").selectExpr("event_id AS id", "ts AS timestamp", "event_type = 'error' AS is_phishing", "value")
    plan = monitor.phishing_detected(df)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan
    assert "ReadSchema: struct<event_type:string>" in plan


def test_link_rules_need_no_shuffle(spark, data):
    plan = plan_of(urls.score_structure_and_domain(urls.mail_links(spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id AS mail_id", "text AS raw"))))
    assert "Exchange" not in plan


def test_no_product_joins(spark, data):
    import __spark_entry__ as entry

    for name in ("u10_mail_link_rollup", "n11_sender_score", "b2_geographic_origin", "b5_behavior_score", "c9_typo_candidates", "m2_tfidf", "d5_split"):
        plan = plan_of(entry.queries()[name](spark, data))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_rollup_keeps_mails_without_links(spark, data):
    mails = view(spark, data, "mail").select("mail_id", F.when(F.col("mail_id") % 2 == 0, F.lit("no link")).otherwise(F.col("raw")).alias("raw"))
    rows = urls.roll_up_links(urls.link_verdicts(urls.mail_links(mails, keep_empty=True)))
    assert rows.count() == mails.count()
    assert rows.filter("mail_id % 2 = 0 AND (total_urls > 0 OR url_risk > 0)").count() == 0


def test_dense_index_with_outlier(spark):
    df = spark.range(20000).unionByName(spark.createDataFrame([(10**13,)], "id long"))
    rows = dense_index(df, "id", "at")
    assert rows.filter("id < 20000 AND id <> at").count() == 0 and rows.filter("at = 20000").first().id == 10**13
    assert dense_index(df.filter("id < 0"), "id", "at").count() == 0


def test_cut_with_many_classes(spark):
    df = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 1500 END AS label")
    out = hash_cut(df, "id", 1, {"keep": F.lit(2)}, group="label", alias="part")
    assert out.groupBy("label").count().filter("count <> 2").count() == 0
    assert out.count() == 2 * 1001


def test_broadcast_limit_in_any_unit(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        for text, size in (("256k", 262144), ("10MB", 10485760), ("10485760b", 10485760), ("1g", 1 << 30), ("-1", -1)):
            spark.conf.set(key, text)
            assert broadcast_limit(spark.range(1)) == size
    finally:
        spark.conf.set(key, before)


def test_forest_grows_deep_trees(spark):
    from mailglass.operators import models

    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"word{k}" for k in np.flatnonzero(rng.random(12) < 0.5)), int(rng.integers(2))) for i in range(300)]
    model = models.fit_forest(spark.createDataFrame(rows, "id long, body string, y int"), trees=3)
    assert max(tree.depth for tree in model.stages[-1].trees) > 5


def test_forest_partitions_are_bounded(spark):
    from mailglass.operators import models

    rows = spark.range(1000).coalesce(1)
    assert models.in_parts(rows, 40_000_000, 8_000_000).rdd.getNumPartitions() == 5
    assert models.in_parts(rows, 40_000_000).rdd.getNumPartitions() == 1
    assert models.in_parts(rows.repartition(7), 40_000_000, 8_000_000).rdd.getNumPartitions() == 7


@pytest.mark.parametrize("most, parts", [(10_000, 16), (2_000, 8)])
def test_forest_learns_from_bounded_partitions(spark, monkeypatch, most, parts):
    """300 rows of two terms are 2,400 bytes, read twice where nodes are kept."""
    from mailglass.operators import models

    monkeypatch.setattr(models.in_parts, "__defaults__", (300,))
    monkeypatch.setattr(models, "KEPT_BYTES", most)
    seen = []
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, rows: seen.append((rows.rdd.getNumPartitions(), rows.count(), self.getCacheNodeIds())))
    train = spark.createDataFrame([(i, "good" if i % 2 else "bad", i % 2) for i in range(300)], "id long, body string, y int").coalesce(1)
    models.fit_forest(train, trees=2)
    assert seen == [(parts, 300, parts == 16)]


def test_token_windows_are_made_one_batch_at_a_time(spark):
    """A row is one string until its windows are due; means are those over all its tokens."""
    import numpy as np
    import pandas as pd

    from mailglass.operators import models

    windows = models._windows(pd.Series(["a b c", "", "d"]), 2)
    assert iter(windows) is windows and list(windows) == [(0, ["a", "b"]), (0, ["c"]), (2, ["d"])]
    df = spark.createDataFrame([(1, "one three  fünf"), (2, None), (3, "!"), (4, "xx " * 300)], "id long, body string")
    got = models.embed_tokens(df, lambda: lambda lists: [np.array([[len(t), 1.0] for t in x]) for x in lists], batch=2, window=7)
    assert {r.id: r.embedding for r in got.collect()} == {1: [4.0, 1.0], 2: None, 3: None, 4: [2.0, 1.0]}


def test_embeddings_are_of_whole_texts(spark, monkeypatch):
    """The mean is over all tokens of a text, however long it is."""
    import numpy as np

    from mailglass.plans import queries_models

    words = ["aa"] * 300 + ["bb"] * 500
    corpus = spark.createDataFrame([(1, " ".join(words)), (2, "aa bb")], "id long, body string")
    monkeypatch.setattr(queries_models, "view", lambda spark, sf_dir, name: corpus)
    got = {(r.id, r.k): r.value for r in queries_models.m10(spark, "").collect()}
    a, b = (x[0] for x in queries_models.md5_encoder()([["aa"], ["bb"]]))
    assert got == {(i, k + 1): round(float(v), 6) for i, mean in ((1, np.array(a) * 3 / 8 + np.array(b) * 5 / 8), (2, (np.array(a) + np.array(b)) / 2)) for k, v in enumerate(mean)}

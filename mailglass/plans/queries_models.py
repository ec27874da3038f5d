"""Model and evaluation queries (M rows)."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mailglass import rules
from mailglass.operators import corpus, models
from mailglass.plans.bindings import view
from mailglass.plans.oracle_base import block, build, in_list
from mailglass.plans.registry import query, r6
from mailglass.session import materialize, shared_folder

block("words", rf"SELECT id, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM corpus", "corpus")
block("terms", f"SELECT id, term FROM words WHERE term NOT IN {in_list(rules.STOP_WORDS)}", "words")
block("vocab", "SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM terms GROUP BY term ORDER BY n DESC, term LIMIT 10000", "terms")


@query("m1_vocabulary", build("SELECT term, n FROM vocab", "vocab"))
def m1(spark, sf_dir):
    return models.vocabulary(models.tokens(view(spark, sf_dir, "corpus")))


@query("m2_tfidf", build(
    "SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS tfidf FROM ("
    "SELECT t.id, t.term, count(*) * (ln((1.0::DOUBLE + (SELECT count(*) FROM corpus)) / (1.0::DOUBLE + any_value(v.df))) + 1) AS w FROM terms t JOIN vocab v ON v.term = t.term GROUP BY t.id, t.term)",
    "corpus", "terms", "vocab"))
def m2(spark, sf_dir):
    return models.tfidf(view(spark, sf_dir, "corpus")).withColumn("tfidf", r6("tfidf"))


def parts(spark, sf_dir):
    """Train and test halves of the labelled corpus, written once."""
    df = view(spark, sf_dir, "corpus").select("id", "body", F.col("is_phishing").alias("y"))
    df = materialize(corpus.split(df, test=0.3, validation=0.0, label="y"))
    return df.filter("split = 'train'").drop("split"), df.filter("split = 'test'").drop("split")


# the fit again: sums of training weights by class and term, smoothed by one, and each test row's likelihoods
block("halves", "SELECT r.id, c.body, r.is_phishing AS y, rk <= ceil(round(total * CAST(0.3 AS DOUBLE), 6)) AS test FROM ranked r JOIN corpus c ON c.id = r.id", "ranked", "corpus")
block("half_terms", f"SELECT * FROM (SELECT id, y, test, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM halves) WHERE term NOT IN {in_list(rules.STOP_WORDS)}", "halves")
block("half_counts", "SELECT id, y, test, term, count(*) AS tf FROM half_terms GROUP BY ALL", "half_terms")
block("half_vocab", "SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM halves WHERE NOT test)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM half_counts WHERE NOT test GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000", "half_counts", "halves")
block("half_weights", "SELECT id, y, test, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT c.*, tf * idf AS w FROM half_counts c JOIN half_vocab v ON v.term = c.term)", "half_counts", "half_vocab")
block("half_sums", "SELECT y, term, sum(w) AS s FROM half_weights WHERE NOT test GROUP BY y, term", "half_weights")
block("half_classes", "SELECT y, ln(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)) AS prior, (SELECT count(*) FROM half_vocab) + coalesce((SELECT sum(s) FROM half_sums x WHERE x.y = h.y), 0) AS bottom FROM halves h WHERE NOT test GROUP BY y", "halves", "half_vocab", "half_sums")
block("bayes", """
SELECT id, y, p1 / (p0 + p1) AS probability, CAST(CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM (
  SELECT *, exp(s0 - greatest(s0, s1)) AS p0, exp(s1 - greatest(s0, s1)) AS p1 FROM (
    SELECT id, y, max(s) FILTER (c = 0) AS s0, max(s) FILTER (c = 1) AS s1 FROM (
      SELECT h.id, h.y, k.y AS c, k.prior + coalesce(sum(w.w * (ln(coalesce(x.s, 0) + 1) - ln(k.bottom))), 0) AS s
      FROM halves h CROSS JOIN half_classes k LEFT JOIN half_weights w ON w.id = h.id LEFT JOIN half_sums x ON x.y = k.y AND x.term = w.term WHERE h.test GROUP BY h.id, h.y, k.y, k.prior)
    GROUP BY id, y))""", "halves", "half_classes", "half_weights", "half_sums")
_BAYES = "SELECT id, y, round(probability, 6) AS probability, prediction FROM bayes"


@query("m3_naive_bayes", build(_BAYES, "bayes"))
def m3(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return models.fit_bayes(train).transform(test).select("id", "y", r6("probability").alias("probability"), "prediction")


def _scored(model, test):
    return model.transform(test).select("id", "y", r6(vector_to_array("probability")[1]).alias("probability"), F.col("prediction").cast("int").alias("prediction"))


@query("m4_random_forest")
def m4(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return _scored(models.fit_forest(train), test)


@query("m5_logistic_regression")
def m5(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return _scored(models.fit_regression(train), test)


block("decided", "SELECT *, CAST(CASE WHEN nb > 0.9 AND rf > 0.7 THEN 1 WHEN nb < 0.1 AND rf < 0.3 THEN 0 WHEN lr > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM prob", "prob")


@query("m6_two_stage_decision", build("SELECT id, y, prediction FROM decided", "decided"))
def m6(spark, sf_dir):
    return models.decide(view(spark, sf_dir, "prob")).select("id", "y", "prediction")


_RATIO = "coalesce({0} / nullif(CAST({1} AS DOUBLE), 0), 0)"
block("by_class", f"""
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (
SELECT c, support, tp, {_RATIO.format('tp', 'guessed')} AS precision, {_RATIO.format('tp', 'support')} AS recall FROM (
  SELECT c, count(*) FILTER (WHERE y = c) AS support, count(*) FILTER (WHERE prediction = c) AS guessed, count(*) FILTER (WHERE y = c AND prediction = c) AS tp
  FROM decided, (SELECT unnest([0, 1]) AS c) GROUP BY c))""", "decided")


@query("m7_report", build("""
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
SELECT CAST(c AS VARCHAR) AS name, precision, recall, f1, CAST(support AS BIGINT) AS support FROM by_class
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM by_class
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM by_class
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM by_class)""", "by_class"))
def m7(spark, sf_dir):
    rows = models.report(models.confusion(models.decide(view(spark, sf_dir, "prob"))))
    return rows.select("name", *[r6(m).alias(m) for m in ("precision", "recall", "f1")], "support")


@query("m7_confusion_matrix", build(
    "SELECT y, count(*) FILTER (WHERE prediction = 0) AS predicted_0, count(*) FILTER (WHERE prediction = 1) AS predicted_1 FROM decided GROUP BY y", "decided"))
def m7_matrix(spark, sf_dir):
    return models.confusion_matrix(models.confusion(models.decide(view(spark, sf_dir, "prob"))))


def _auc(score):
    return (f"SELECT '{score}' AS model, round((sum(CASE WHEN y = 1 THEN r END) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))), 6) AS auc "
            f"FROM (SELECT y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS r FROM decided)")


@query("m8_roc_auc", build(" UNION ALL ".join(_auc(s) for s in ("nb", "rf", "lr", "prediction")), "decided"))
def m8(spark, sf_dir):
    df = models.decide(view(spark, sf_dir, "prob"))
    out = None
    for name in ("nb", "rf", "lr", "prediction"):
        row = models.roc_auc(df.withColumn("_s", F.col(name).cast("double")), "_s").select(F.lit(name).alias("model"), r6("auc").alias("auc"))
        out = row if out is None else out.union(row)
    return out


# all three models and the metrics go out and come back; what is loaded says the same
@query("m9_save_load", build(
    "SELECT id, y, round(probability, 6) AS probability, true AS same_forest, true AS same_regression, CAST(5 AS BIGINT) AS metrics FROM bayes", "bayes"))
def m9(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    folder = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model = models.train_two_stage(train, trees=5)
    before = materialize(model.probabilities(test).select("id", "y", "nb", "rf", "lr"))
    model.save(folder, models.report(models.confusion(models.decide(before))))
    loaded = models.TwoStageModel.load(spark, folder)
    after = loaded.probabilities(test).select("id", "y", r6("nb").alias("probability"), F.col("rf").alias("_rf"), F.col("lr").alias("_lr"))
    kept = before.select("id", "rf", "lr")
    measured = models.TwoStageModel.load_metrics(spark, folder).agg(F.count("*")).scalar()
    return after.join(kept, "id").select("id", "y", "probability", (F.abs(F.col("rf") - F.col("_rf")) < 1e-12).alias("same_forest"),
                                         (F.abs(F.col("lr") - F.col("_lr")) < 1e-12).alias("same_regression"), measured.alias("metrics"))


def md5_encoder():
    """Eight numbers per token, four digits each of its MD5, over a prime so that no mean is a tie."""
    return lambda texts: [np.frombuffer(b"".join(hashlib.md5(t.encode()).digest() for t in tokens), ">u2").reshape(-1, 8) / 65521 for tokens in texts]


@query("m10_embeddings", build(
    "SELECT id, CAST(k AS INTEGER) AS k, round(avg(CAST('0x' || substr(md5(term), CAST(4 * k - 3 AS INTEGER), 4) AS INTEGER) / 65521.0::DOUBLE), 6) AS value FROM ("
    "SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}_]{2,}')) AS term FROM corpus), (SELECT unnest(range(1, 9)) AS k) GROUP BY id, k", "corpus"))
def m10(spark, sf_dir):
    df = models.embed_tokens(view(spark, sf_dir, "corpus").select("id", "body"), md5_encoder, window=100)
    return df.select("id", F.posexplode("embedding").alias("k", "value")).select("id", (F.col("k") + 1).alias("k"), r6("value").alias("value"))


@query("m11_train_and_evaluate")
def m11(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    scored = materialize(models.decide(models.train_two_stage(train).probabilities(test)).select("id", "y", "nb", "rf", "lr", "prediction"))
    return models.evaluate(scored).select("name", *[r6(m).alias(m) for m in ("precision", "recall", "f1")], "support")

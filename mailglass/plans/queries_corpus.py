"""Corpus queries (D rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailglass.operators import corpus as ops
from mailglass.plans.bindings import view
from mailglass.plans.oracle_base import block, build, lit
from mailglass.plans.registry import query

block("all_corpora", """
SELECT 1 AS source_ord, id, body, is_phishing, source, lang FROM corpus
UNION ALL SELECT 2, conv_id * 1000 + turn, text, NULL, 'conversations', NULL FROM conversations
UNION ALL SELECT 3, item_id, text, 0, 'benchmark', NULL FROM benchmark""", "corpus")


def all_corpora(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return ops.union_all([
        view(spark, sf_dir, "corpus").withColumn("source_ord", F.lit(1)),
        read("conversations").select(F.lit(2).alias("source_ord"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("body"), F.lit("conversations").alias("source")),
        read("benchmark").select(F.lit(3).alias("source_ord"), F.col("item_id").alias("id"), F.col("text").alias("body"), F.lit(0).alias("is_phishing"), F.lit("benchmark").alias("source")),
    ]).select("source_ord", "id", "body", "is_phishing", "source", "lang")


@query("d1_union", build("SELECT * FROM all_corpora", "all_corpora"))
def d1(spark, sf_dir):
    return all_corpora(spark, sf_dir)


@query("d2_deduplicate", build(
    "SELECT source_ord, id, body, is_phishing, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY source_ord, id) AS rn FROM all_corpora) WHERE rn = 1", "all_corpora"))
def d2(spark, sf_dir):
    return ops.deduplicate(all_corpora(spark, sf_dir))


block("ranked", "SELECT id, is_phishing, source, row_number() OVER (PARTITION BY is_phishing ORDER BY md5(id || ':42'), id) AS rk, count(*) OVER (PARTITION BY is_phishing) AS total, "
      "row_number() OVER (ORDER BY md5(id || ':42'), id) AS pos FROM corpus", "corpus")


@query("d3_balance", build("SELECT id, is_phishing, source FROM ranked WHERE rk <= (SELECT min(total) FROM ranked)", "ranked"))
def d3(spark, sf_dir):
    return ops.balance(view(spark, sf_dir, "corpus").select("id", "is_phishing", "source"))


@query("d4_shuffle", build("SELECT id, is_phishing, pos - 1 AS position FROM ranked", "ranked"))
def d4(spark, sf_dir):
    return ops.with_position(view(spark, sf_dir, "corpus").select("id", "is_phishing"))


@query("d5_split", build(
    "SELECT id, is_phishing, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + ceil(round((total - t) * CAST(0.125 AS DOUBLE), 6)) THEN 'validation' ELSE 'train' END AS split "
    "FROM (SELECT *, ceil(round(total * CAST(0.2 AS DOUBLE), 6)) AS t FROM ranked)", "ranked"))
def d5(spark, sf_dir):
    return ops.split(view(spark, sf_dir, "corpus").select("id", "is_phishing"))


@query("d6_class_counts", build("SELECT is_phishing, count(*) AS n FROM corpus GROUP BY is_phishing", "corpus"))
def d6(spark, sf_dir):
    return ops.class_counts(view(spark, sf_dir, "corpus"))


@query("d7_sample", build("SELECT id, is_phishing FROM ranked WHERE pos <= 500", "ranked"))
def d7(spark, sf_dir):
    return ops.sample_at_most(view(spark, sf_dir, "corpus").select("id", "is_phishing"), 500)


@query("d8_render_feed",
       "SELECT page_id, 'phishing' AS label, concat('Subject: Important Information', chr(10), chr(10), 'Dear User,', chr(10), chr(10), 'Please click on the following link to update your information:', chr(10), url, "
       "chr(10), chr(10), 'Regards,', chr(10), 'The Team') AS text FROM pages")
def d8(spark, sf_dir):
    return ops.render_feed(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "label", "text")


def _draw(part: str, n) -> str:
    return f"(CAST('0x' || substr(md5(c.id || ':{part}:42'), 1, 7) AS BIGINT) % {n})"


def _drawn(table: str, key: str, part: str) -> str:
    """Join of the row drawn for each row of the corpus c."""
    n = f"(SELECT max({key}) + 1 FROM {table})"
    return f" LEFT JOIN {table} t_{part} ON t_{part}.{key} = {_draw(part, n)}"


def _table(spark, sf_dir, name, key, **columns):
    """A template or filler table made from a given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(key).alias("idx"), *[F.expr(e).alias(c) for c, e in columns.items()])


# the same expressions serve both engines
LURE = {"subject": "concat('Notice: ', substr(text, 1, 40))",
        "body": "concat('To {user}:', chr(10), text, chr(10), '{url}', chr(10), 'Case {number}, {amount}, {company}')"}
KIND = {"type": "concat(lower(n_name), '_notification')", "sender": "concat('news@', lower(n_name), '.example')",
        "subject": "concat('{name}: {topic} in ', n_name)", "body": "concat('{name} has {topic} for {percent}% less.', chr(10), '{link}', chr(10), n_name)",
        "link": "concat('https://', lower(n_name), '.example/{slug}')", "discounted": "n_nationkey % 3 = 0"}
_USER, _COMPANY, _URL = ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("pages", "page_id", "url")
_TOPIC = ("part", "p_partkey", "p_name")


def _of(table: str, expression: str) -> str:
    """An expression over the drawn row of a table, columns qualified."""
    for column in ("n_nationkey", "n_name", "text"):
        expression = expression.replace(column, f"{table}.{column}")
    return expression


def _filled(expression: str, values: dict[str, str]) -> str:
    for name, value in values.items():
        expression = f"replace({expression}, {lit('{' + name + '}')}, {value})"
    return expression


_BODY = _filled(_of("t_template", LURE["body"]), {
    "number": f"lpad(CAST({_draw('number', 100000000)} AS VARCHAR), 8, '0')", "amount": f"'$' || ({_draw('amount', 900)} + 100) || '.00'",
    "user": "t_user.c_name", "company": "t_company.s_name", "url": "t_url.url"})


@query("d9_synthetic_lures", build(
    f"SELECT c.id, 'Subject: ' || {_of('t_template', LURE['subject'])} || chr(10) || chr(10) || {_BODY} AS text, 'phishing' AS label FROM corpus c"
    + _drawn("benchmark", "item_id", "template") + _drawn("customer", "c_custkey", "user") + _drawn("supplier", "s_suppkey", "company")
    + _drawn("pages", "page_id", "url"), "corpus"))
def d9(spark, sf_dir):
    fillers = {part: _table(spark, sf_dir, name, key, value=value) for part, (name, key, value) in
               {"user": _USER, "company": _COMPANY, "url": _URL}.items()}
    return ops.synthetic_lures(view(spark, sf_dir, "corpus"), _table(spark, sf_dir, "benchmark", "item_id", **LURE), fillers)


def _kinds(spark, sf_dir):
    """Kinds, names and topics of marketing mails."""
    (n, nk, nv), (t, tk, tv) = _COMPANY, _TOPIC
    return _table(spark, sf_dir, "nation", "n_nationkey", **KIND), _table(spark, sf_dir, n, nk, value=nv), _table(spark, sf_dir, t, tk, value=tv)


_PERCENT, _SLUG = f"(({_draw('percent', 9)} + 1) * 5)", "substr(md5(c.id || ':slug:42'), 1, 12)"
_OWN = {"name": "t_name.s_name", "topic": "t_topic.p_name", "percent": f"CAST({_PERCENT} AS VARCHAR)", "slug": _SLUG}
_LINK = f"({_filled(_of('t_kind', KIND['link']), _OWN)} || '#t=' || substr(sha1(CAST(c.id AS VARCHAR)), 1, 8))"


@query("d10_marketing_mails", build(
    f"SELECT c.id, {_filled(_of('t_kind', KIND['subject']), _OWN)} AS subject, {_filled(_of('t_kind', KIND['body']), {**_OWN, 'link': _LINK})} AS body, "
    f"{_of('t_kind', KIND['sender'])} AS sender, {_of('t_kind', KIND['type'])} AS type, true AS is_marketing, "
    f"""'{{"name":"' || t_name.s_name || '","topic":"' || t_topic.p_name || '","tracking_id":"' || {_SLUG} || '"' || """
    f"""CASE WHEN {_of('t_kind', KIND['discounted'])} THEN ',"promotion":{{"discount":' || {_PERCENT} || '}}' ELSE '' END || '}}' AS metadata, """
    "'2024-02-01' AS generation_date, 'generated' AS source FROM corpus c"
    + _drawn("nation", "n_nationkey", "kind") + _drawn("supplier", "s_suppkey", "name") + _drawn("part", "p_partkey", "topic"), "corpus"))
def d10(spark, sf_dir):
    return ops.marketing_mails(view(spark, sf_dir, "corpus"), *_kinds(spark, sf_dir), "2024-02-01")


@query("d11_enlarge", build(
    "SELECT source, is_phishing, count(*) AS n FROM corpus GROUP BY source, is_phishing UNION ALL SELECT 'generated', 0, CAST(floor(round(count(*) * 0.2, 6)) AS BIGINT) FROM corpus", "corpus"))
def d11(spark, sf_dir):
    df = ops.enlarge(view(spark, sf_dir, "corpus"), *_kinds(spark, sf_dir), "2024-02-01")
    return df.groupBy("source", "is_phishing").agg(F.count("*").alias("n"))

"""Registered queries of the operators, on the driver's tables, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass.llm import bpe, chosen_path, conversation_repair, filter_audit, gru_lm, hnsw, imatch, language_id, mixing, packing, quality, token_counts, warc
from mailglass.llm.shared import fold, new_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50256
LEVELS = ["domain", "lang", "source"]
#: Target weights of the tree's nodes; others weigh 1.
WEIGHTS = [("domain", "a", 4), ("domain", "b", 3), ("domain", "c", 2), ("domain", "d", 1), ("lang", "en", 3), ("lang", "de", 2), ("lang", "fr", 2), ("lang", "es", 2)]
MAX_EPOCHS = 4
ACCEPT = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def wrap(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return wrap


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, then their lengths by the separator scan."""
    where = token_counts.write_token_files(table(spark, sf_dir, "documents"), VOCABULARY, SEPARATOR)
    folder = where.select("file").first()
    if folder is None:
        return where.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    files = token_counts.token_files(spark, folder[0].rsplit("/", 1)[0]).join(where.select(F.col("file")).distinct().select(F.substring_index("file", "/", -1).alias("name")), F.substring_index("file", "/", -1) == F.col("name"), "left_semi")
    counts = token_counts.count_tokens(files, SEPARATOR).withColumn("name", F.substring_index("file", "/", -1))
    return where.withColumn("name", F.substring_index("file", "/", -1)).join(counts.select("name", "ordinal", "n_tokens"), ["name", "ordinal"]).select("doc_id", "n_tokens")


def held_out(folds: int, left: int):
    return fold("doc_id", folds) == left


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = quality.fit(documents, labels, ~held_out(4, 2))
    scored = quality.score(documents, weights, keep=["doc_id"])
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"))


@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out(5, 1))


OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""


@query("op4_warc", OP4)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_warc(warc.records_of(table(spark, sf_dir, "pages")), folder, compress=True)
    return warc.page_index(spark, folder)


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(documents, ~held_out(4, 2))
    named = language_id.identify(documents, model, keep=["doc_id"])
    return named.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def domain():
    """Four domains; which one a source belongs to is a column of the caller's, here a digit of its MD5."""
    digit = F.conv(F.left(F.md5(F.coalesce("source", F.lit("")).cast("binary")), F.lit(1)), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, "abcd")), digit % 4 + 1)


def weight_table(spark: SparkSession, top: str) -> DataFrame:
    return spark.createDataFrame([(top if level == LEVELS[0] else level, node, w) for level, node, w in WEIGHTS], "level string, node string, weight long")


def _share_out_sql(depth: int) -> str:
    level, on = LEVELS[depth], LEVELS[:depth]
    keys = "".join(f"{c}, " for c in on)
    join = " AND ".join([f"c.{c} = p.{c}" for c in on] or ["true"])
    part = "PARTITION BY " + ", ".join([*on, "one"])
    values = ", ".join(f"('{n}', {w})" for k, n, w in WEIGHTS if k == level) or "('', 1)"
    return f"""
c{depth} AS (SELECT {keys}{level}, 1 AS one, sum(tokens) * {MAX_EPOCHS} AS capacity, any_value(coalesce(w.weight, 1)) AS weight
    FROM leaves LEFT JOIN (VALUES {values}) w(node, weight) ON w.node = {level} GROUP BY {keys}{level}),
r{depth} AS (SELECT *, coalesce(sum(capacity) OVER ({part} ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER ({part} ORDER BY capacity / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM c{depth}),
f{depth} AS (SELECT c.*, p.budget AS b, (CAST(p.budget AS HUGEINT) - used) * weight >= CAST(capacity AS HUGEINT) * weights AS is_full FROM r{depth} c JOIN b{depth} p ON {join}),
e{depth} AS (SELECT *, min(CASE WHEN NOT is_full THEN {{'q': capacity / weight, 'n': {level}, 'u': used, 'w': weights}} END) OVER ({part}) AS edge FROM f{depth}),
b{depth + 1} AS (SELECT {keys}{level}, CAST(CASE WHEN is_full THEN capacity ELSE least((CAST(b AS HUGEINT) - edge.u) * weight // edge.w, capacity) END AS BIGINT) AS budget FROM e{depth})"""


def _op6_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, substr('abcd', CAST('0x' || substr(md5(coalesce(source, '')), 1, 1) AS INTEGER) % 4 + 1, 1) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n FROM documents),
leaves AS (SELECT domain, lang, source, sum(n) AS tokens FROM d GROUP BY ALL),
b0 AS (SELECT CAST(floor(sum(tokens) * {MAX_EPOCHS} * 3 / 20) AS BIGINT) AS budget FROM leaves),""" + ",".join(_share_out_sql(k) for k in range(3)) + """,
q AS (SELECT *, budget // tokens AS whole, budget % tokens AS rest FROM leaves JOIN b3 USING (domain, lang, source) WHERE tokens > 0 AND budget > 0),
o AS (SELECT d.doc_id, domain, lang, source, n, whole, rest, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5(doc_id || ':' || CAST(whole AS INTEGER) || ':1') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
    FROM d JOIN q USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(n AS BIGINT) AS n_tokens, CAST(whole + (begun < rest)::INTEGER AS INTEGER) AS copies FROM o WHERE whole + (begun < rest)::INTEGER > 0
"""


def mixed(spark: SparkSession, documents: DataFrame, budget, top: str = LEVELS[0]) -> DataFrame:
    """``top`` is the column of the tree's first level."""
    return mixing.mix(documents, weight_table(spark, top), [top, *LEVELS[1:]], budget, MAX_EPOCHS)


@query("op6_mixing", _op6_sql())
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("domain", domain())
    return mixed(spark, documents, F.floor(F.col("capacity") * 3 / 20)).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


@query("op7_imatch")
def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
REACH = """
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
"""
OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({FOLD}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(words[i:i+4], ' ')) AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b, c = p.n AND c = q.n AS same FROM both_in JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c * 5 >= (p.n + q.n - c) * 4),
{REACH}
m AS (SELECT node, min(other) AS least FROM reach GROUP BY node),
k AS (SELECT a, count(*) AS n_links, min(CASE WHEN same THEN b END) AS copy FROM links GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(copy, d.doc_id)) AS class_id, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links,
       d.doc_id = least(d.doc_id, coalesce(m.least, d.doc_id)) AS kept
FROM documents d LEFT JOIN m ON m.node = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""


@query("op9_chosen_path", OP9)
def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


OP10 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{REACH}
m AS (SELECT node, min(other) AS least FROM reach GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, least(v.vec_id, coalesce(m.least, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m.least, v.vec_id)) AS kept
FROM v LEFT JOIN m ON m.node = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""


@query("op10_hnsw", OP10)
def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_bpe")
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary, ["doc_id"]), vocabulary)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by the CRC of their key."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text = F.coalesce("text", F.lit(" "))
    kind = F.col("kind")
    return conversations.withColumn("kind", F.crc32(key.cast("binary")) % 20).filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _plus(cell: str, cost: str, edit: str) -> str:
    return f"lpad(CAST(CAST(left({cell}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({cell}, 10) || {edit}"


def _op12_sql() -> str:
    """Row by row: the cheapest (cost, audit) up to each state, costs as nine digits before the letters."""
    def kept(cell, role):
        return f"CASE WHEN i = '{role}' THEN {_plus(cell, 'e', chr(39) + 'K' + chr(39))} END"

    def given(cell):
        return f"CASE WHEN NOT gone THEN {_plus(cell, '2 + e', chr(39) + 'R' + chr(39))} END"

    def lost(cell):
        return _plus(cell, "3", "'D'")

    into = {"c0": lost("c0"), "c1": f"least({lost('c1')}, {kept('c0', 's')})",
            "c2": f"least({lost('c2')}, " + ", ".join(f"{kept(c, 'u')}, {given(c)}" for c in ("c0", "c1", "c3")) + ")",
            "c3": f"least({lost('c3')}, {kept('c2', 'a')}, {given('c2')})"}
    one, two = (lambda c: _plus(c, "2", "'I'")), (lambda c: _plus(c, "4", "'II'"))
    close = f"c0, c1, least(c2, {one('c0')}, {one('c1')}, {one('c3')}) AS c2, least(c3, {one('c2')}, {two('c0')}, {two('c1')}) AS c3"
    return f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM kinds)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS i,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged),
faulty AS MATERIALIZED (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM numbered),
plain AS MATERIALIZED (SELECT conv_id, n, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE i END AS i, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS e FROM faulty),
cells AS (SELECT conv_id, 0 AS n, '000000000' AS c0, CAST(NULL AS VARCHAR) AS c1, '000000002I' AS c2, '000000004II' AS c3 FROM (SELECT DISTINCT conv_id FROM plain)
    UNION ALL SELECT conv_id, n, {close} FROM (SELECT p.conv_id, p.n, {', '.join(f'{x} AS {c}' for c, x in into.items())} FROM cells JOIN plain p ON p.conv_id IS NOT DISTINCT FROM cells.conv_id AND p.n = cells.n + 1)),
best AS (SELECT conv_id, CAST(left(c, 9) AS BIGINT) AS cost, substr(c, 10) AS audit FROM (SELECT conv_id, least(c0, c3) AS c FROM cells QUALIFY n = max(n) OVER (PARTITION BY conv_id))),
letters AS (SELECT conv_id, item, substr(audit, item, 1) AS edit, length(replace(substr(audit, 1, item), 'I', '')) AS n, length(replace(substr(audit, item + 1), 'D', '')) % 2 AS early
    FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS item FROM best)),
lines AS (SELECT l.conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN f.role ELSE CASE early WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE f.text END, chr(10) ORDER BY item)) AS sha
    FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n WHERE edit <> 'D' GROUP BY l.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op12_conversation_repair", _op12_sql())
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def repaired(conversations: DataFrame) -> DataFrame:
    found, edits = conversation_repair.repair(damaged(conversations))
    shas = conversation_repair.digests(edits)
    original = conversations.select("conv_id").distinct()
    out = original.join(found, original["conv_id"].eqNullSafe(found["conv_id"]), "left").drop(found["conv_id"])
    out = out.join(shas, out["conv_id"].eqNullSafe(shas["conv_id"]), "left").drop(shas["conv_id"])
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: Letter to failure condition, as the contract names them.
FILTERS = {
    "A": lambda text: filter_audit.too_short(text, 100),
    "B": lambda text: filter_audit.repetitive(text, 80),
    "C": lambda text: filter_audit.shouting(text, 10),
    "D": lambda text: filter_audit.holds_any(text, "#$%&*|"),
    "E": filter_audit.REPEATED,
}

OP13 = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT '' AS p UNION ALL SELECT p || letter FROM o JOIN x ON NOT contains(p, letter)),
s AS (SELECT p AS filter_order, step, letter, bit, coalesce((SELECT sum(y.bit) FROM x y WHERE contains(left(p, step - 1), y.letter)), 0) AS done
    FROM (SELECT p, unnest(range(1, 6)) AS step FROM o WHERE length(p) = 5) JOIN x ON letter = substr(p, step, 1)),
m AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
    count(*) FILTER (mask & done::INT = 0 AND mask & bit = 0) AS kept, count(*) FILTER (mask & done::INT = 0 AND mask & bit <> 0) AS removed,
    count(*) FILTER (mask & done::INT <> 0 AND mask & bit <> 0) AS redundant, count(*) FILTER (mask = bit) AS unique_fails,
    count(*) FILTER (mask & done::INT = 0 AND mask & bit <> 0 AND good = 1) AS good_lost, count(*) FILTER (mask & done::INT = 0 AND mask & bit <> 0 AND toxic = 1) AS toxic_lost
    FROM f, s GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM m
"""


@query("op13_filter_audit", OP13)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), FILTERS)

"""Portable views that bind the operators to the driver tables.

The driver tables hold no mail, so each view derives one from whole driver
tables with SQL that Spark and DuckDB both accept. The Spark side reads the
views through :func:`view`; the check SQL inlines the same text as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from mailglass.functions.url import BUILT_IN
from mailglass.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_DOMAIN = """CASE {k} % 8
    WHEN 0 THEN 'amazon.com' WHEN 1 THEN 'paypa1.com'
    WHEN 2 THEN 'secure-login-bank.tk' WHEN 3 THEN 'gmail.com'
    WHEN 4 THEN 'arnazon.com' WHEN 5 THEN 'legittech.news'
    WHEN 6 THEN 'a.b.c.d.example.co.uk' ELSE 'microsoft.com' END"""

# some header lines are folded, some values are encoded words, and the lines of some mails end in CRLF
MAIL = f"""
SELECT mail_id, sender, domain, recipient, sent_at, subject, phrase, url, is_phishing,
  CASE WHEN mail_id % 13 = 5 THEN replace(written, chr(10), concat(chr(13), chr(10))) ELSE written END AS raw
FROM (SELECT mail_id, sender, domain, recipient, sent_at, subject, phrase, url, is_phishing,
  concat(
    'Received: from mx.example.com [203.0.113.9] by inbox.example.com', chr(10),
    repeat(concat('Received: from hop.example.org by relay.example.org', chr(10)),
           CAST(CASE WHEN mail_id % 9 = 3 THEN 8 ELSE 0 END AS INT)),
    CASE WHEN mail_id % 11 = 4 THEN '' ELSE
      concat('Received: from host', CAST(mail_id % 50 AS STRING), '.', domain, ' ([', origin_ip, ']) by relay.example.net', chr(10)) END,
    CASE mail_id % 6
      WHEN 0 THEN concat('Return-Path: <bounce@', domain, '>', chr(10))
      WHEN 1 THEN concat('Return-Path: <bounce@mailer.example.org>', chr(10))
      WHEN 2 THEN concat('Reply-To: <', sender, '>', chr(10))
      WHEN 3 THEN concat('Reply-To:', CASE WHEN mail_id % 4 = 3 THEN concat(chr(10), chr(9)) ELSE ' ' END, 'help@other.example.com', chr(10))
      WHEN 4 THEN concat('Return-Path: <', sender, '>', chr(10), 'Reply-To: ', sender, chr(10))
      ELSE '' END,
    CASE WHEN mail_id % 5 < 2 THEN
      concat('DKIM-Signature: v=1; a=rsa-sha256; d=', domain, '; s=sel', CAST(mail_id % 3 AS STRING), '; bh=abc', chr(10))
      ELSE '' END,
    'From: ', CASE WHEN mail_id % 15 = 6 THEN concat('=?windows-1252?Q?Gr=FC=DFe_=80=99s?=', chr(10), ' <', sender, '>')
      WHEN mail_id % 3 = 0 THEN concat('"User" <', sender, '>') ELSE sender END, chr(10),
    CASE WHEN mail_id % 10 = 9 THEN '' WHEN mail_id % 8 = 2 THEN concat('To:', chr(10), chr(9), recipient, chr(10))
      WHEN mail_id % 8 = 5 THEN concat('To: =?iso-8859-1?q?Jos=E9_P=E9rez?=', chr(10), '  <', recipient, '>', chr(10)) ELSE concat('To: ', recipient, chr(10)) END,
    'Subject: ', CASE WHEN mail_id % 12 = 3 THEN concat('=?UTF-8?B?R8O8bnN0aWc6IA==?=', chr(10), ' =?ISO-8859-1?Q?f=FCr_Sie?= ', subject, ' =?utf-8?b?4oKs?=') ELSE subject END, chr(10),
    CASE WHEN mail_id % 4 = 3 THEN '' ELSE
      concat('Date: Mon, ', CAST(1 + mail_id % 28 AS STRING), ' Jan 2024 ', CAST(10 + mail_id % 14 AS STRING), ':05:09 ',
             CASE mail_id % 4 WHEN 0 THEN '+0200' WHEN 1 THEN '-0500' ELSE '+0000' END, chr(10)) END,
    CASE WHEN mail_id % 7 = 6 THEN concat('X-Mailer: BulkSend 2.1', chr(10)) ELSE '' END,
    chr(10),
    '<p>', phrase, '</p><a href="', url, '">go</a> ',
    CASE WHEN mail_id % 3 = 0 THEN concat('see ', second_url, ' or http://free-gift.top/a or ', CASE mail_id % 4
      WHEN 0 THEN 'https://google.cm/x' WHEN 1 THEN 'http://a.b.k12.ca.us/p' WHEN 2 THEN 'http://www.shop.co.ck/' ELSE 'http://www.ck/y' END,
      ' or ', url, ' now') ELSE '' END,
    chr(10), text) AS written
FROM (
  SELECT d.doc_id AS mail_id, d.text AS text,
    concat('u', CAST(d.doc_id % 40 AS STRING), '@', {_DOMAIN.format(k='d.doc_id')}) AS sender,
    {_DOMAIN.format(k='d.doc_id')} AS domain,
    concat('r', CAST(d.doc_id % 5 AS STRING), '@example.com') AS recipient,
    concat(CASE d.doc_id % 5 WHEN 0 THEN '5' WHEN 1 THEN '41' WHEN 2 THEN '101' WHEN 3 THEN '196' ELSE '8' END,
           '.', CAST(d.doc_id % 256 AS STRING), '.', CAST((d.doc_id * 7) % 256 AS STRING),
           '.', CAST(1 + d.doc_id % 200 AS STRING)) AS origin_ip,
    coalesce(e.ts, TIMESTAMP '2024-01-01 00:00:00') AS sent_at,
    CASE d.doc_id % 7
      WHEN 0 THEN 'Please verify your login' WHEN 1 THEN 'Invoice and shipping update'
      WHEN 2 THEN 'Security notice' WHEN 3 THEN 'Re: you have won'
      WHEN 4 THEN 'Payment problem' WHEN 5 THEN 'Welcome aboard' ELSE 'Meeting notes' END AS subject,
    CASE d.doc_id % 7
      WHEN 0 THEN 'URGENT ACTION: verify your account within 24 hours or your account will be suspended'
      WHEN 1 THEN 'Your order has shipped, tracking and receipt inside'
      WHEN 2 THEN 'We detected unauthorized access. Legal action will follow'
      WHEN 3 THEN 'CONGRATULATIONS YOU HAVE WON a prize!! Claim your prize NOW!! Costs $0'
      WHEN 4 THEN 'Dear valued customer, we were unable to process your payment. Click here to confirm your password'
      WHEN 5 THEN 'Welcome to the team, see you on Thursday'
      ELSE 'Notes of the meeting are attached' END AS phrase,
    CASE d.doc_id % 9
      WHEN 0 THEN 'https://www.amazon.com/orders?id=3&b=2&a=1#top'
      WHEN 1 THEN 'http://bit.ly/2x4fGhY'
      WHEN 2 THEN 'http://192.0.2.7/login'
      WHEN 3 THEN 'http://secure-banking-verification.com/restore.php'
      WHEN 4 THEN 'https://a.b.c.d.example.xyz:8443/x//y?redirect=http%3A%2F%2Fe.com'
      WHEN 5 THEN 'https://payment-update-portal.net/form.php?id=67890'
      WHEN 6 THEN 'http://my-very-long-name.top/%41%42%43%44%25'
      WHEN 7 THEN 'http://Login.PayPal-Support.example.com:80/Account?b=&goto=x&goto=a'
      ELSE 'https://accounts.google.com/reset' END AS url,
    coalesce(p.url, 'http://loop-a.example.org/start') AS second_url,
    coalesce(l.toxic, 0) AS is_phishing
  FROM documents d
  LEFT JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN pages p ON p.page_id = d.doc_id
) base) mails"""

HISTORY = f"""
SELECT event_id AS id,
  concat('u', CAST(user_id % 40 AS STRING), '@', {_DOMAIN.format(k='(user_id % 40)')}) AS sender,
  concat('r', CAST(event_id % 5 AS STRING), '@example.com') AS recipient,
  ts AS timestamp,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_phishing
FROM events"""

DETECTIONS = f"""
SELECT event_id AS id, ts AS timestamp,
  concat('u', CAST(user_id % 40 AS STRING), '@', {_DOMAIN.format(k='(user_id % 40)')}) AS email_from,
  event_type IN ('error', 'click') AS is_phishing,
  least(CAST(1.0 AS DOUBLE), value / CAST(100.0 AS DOUBLE)) AS confidence
FROM events"""

# feedback on every detection an hour later
FEEDBACK = """
SELECT event_id AS id, event_id AS detection_id, ts + INTERVAL '1' HOUR AS timestamp,
  CASE event_id % 3 WHEN 0 THEN 'False Positive' WHEN 1 THEN 'False Negative' ELSE 'Other' END AS issue_type
FROM events"""

CORPUS = """
SELECT d.doc_id AS id, d.text AS body, coalesce(l.toxic, 0) AS is_phishing, d.source AS source, d.lang AS lang
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

VECTORS = """
SELECT v.vec_id AS id, v.embedding, (v.label % 2 = 1) AS is_phishing, v.label, coalesce(d.text, 'no text') AS content,
  CAST(1704067200 + v.vec_id * 60 AS BIGINT) AS added_at
FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id"""

PROB = """
SELECT d.doc_id AS id, coalesce(l.toxic, 0) AS y,
  CAST((d.doc_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS nb,
  CAST((d.doc_id * 104729) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS rf,
  CAST((d.doc_id * 1299709) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lr
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

# up to three images per mail, with the text an OCR step would have read
IMAGES = """
SELECT doc_id AS image_id, doc_id - doc_id % 3 AS mail_id,
  CAST(5 + (doc_id * 7) % 60 AS INT) AS width, CAST(8 + (doc_id * 11) % 50 AS INT) AS height,
  CASE WHEN doc_id % 10 = 5 THEN 'netflix' END AS logo_brand,
  CASE doc_id % 8
    WHEN 0 THEN concat('PayPal: sign in at http://paypa1.com/login today. ', text)
    WHEN 1 THEN concat('Amazon offer at https://www.amazon.com/deal and shop.example.org now. ', text)
    WHEN 2 THEN concat('visit paypal-secure.com or https://paypal.example.net/x ', text)
    WHEN 3 THEN concat('http://free-prizes.xyz/win is open. ', text)
    WHEN 4 THEN concat('Microsoft account https://micros0ft.com/a and https://www.micr', chr(246), 'soft.com/b ', text)
    WHEN 5 THEN concat('Your Netflix plan. ', text)
    WHEN 6 THEN ''
    ELSE text END AS ocr_text
FROM documents"""

# pages with inline images, one linked image and one tracking pixel added
HTML = """
SELECT page_id,
  concat(html,
    CASE page_id % 4
      WHEN 0 THEN concat('<img alt="a" src="https://img.example.com/', CAST(page_id AS STRING), '.png">')
      WHEN 1 THEN concat('<img src="data:image/png;base64,', CASE WHEN page_id % 8 = 1 THEN 'aGVsbG8=' ELSE 'd29ybGQh' END, '">')
      WHEN 2 THEN '<img src="data:image/gif;base64,R0lGODlhAQ=="><img src="https://img.example.com/pixel">'
      ELSE '' END) AS html
FROM pages"""

# every distinct address seen in pages and mails
URLS = f"""
SELECT url FROM pages UNION SELECT url FROM ({MAIL}) m
UNION SELECT concat('http://h', CAST(page_id % 50 AS STRING), CASE page_id % 9
  WHEN 0 THEN '.google.cm/x' WHEN 1 THEN '.shop.pl/' WHEN 2 THEN '.b.se' WHEN 3 THEN '.c.store/a'
  WHEN 4 THEN '.x.city.kawasaki.jp/' WHEN 5 THEN '.y.other.kawasaki.jp/' WHEN 6 THEN '.school.k12.ca.us/p'
  WHEN 7 THEN '.www.ck/' ELSE '.a.b.pvt.k12.ma.us/q' END) FROM pages"""

# rules as the public list writes them: the engine's own short table and some of each other kind
SUFFIX_RULES = [*BUILT_IN.plain, "k12.ca.us", "pvt.k12.ma.us", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck"]
SUFFIXES = "SELECT suffix FROM (VALUES " + ", ".join(f"('{r}')" for r in SUFFIX_RULES) + ") AS s(suffix)"

# redirect hops: a fixed seed plus one hop from each page, to the next page or out
REDIRECTS = """
SELECT src, dst, kind, ssl_ok FROM (
  SELECT 'http://bit.ly/2x4fGhY' AS src, 'http://hop1.example.tk/a' AS dst, 'http' AS kind, true AS ssl_ok
  UNION ALL SELECT 'http://hop1.example.tk/a', 'https://secure-banking-verification.com/restore.php?x=1', 'http', true
  UNION ALL SELECT 'http://192.0.2.7/login', 'http://loop-a.example.org/start', 'http', true
  UNION ALL SELECT 'http://loop-a.example.org/start', 'http://loop-b.example.org/go.php', 'http', true
  UNION ALL SELECT 'http://loop-b.example.org/go.php', 'http://loop-a.example.org/start', 'http', true
  UNION ALL SELECT 'https://payment-update-portal.net/form.php?id=67890', 'http://c1.example.net/', 'meta', true
  UNION ALL SELECT 'http://c1.example.net/', 'http://c2.example.net/', 'http', true
  UNION ALL SELECT 'http://c2.example.net/', 'http://c3.example.net/', 'http', true
  UNION ALL SELECT 'http://c3.example.net/', 'http://c4.example.net/', 'http', true
  UNION ALL SELECT 'http://c4.example.net/', 'http://c5.example.net/', 'http', true
  UNION ALL SELECT 'http://c5.example.net/', 'http://c6.example.net/', 'http', true
  UNION ALL SELECT 'http://secure-banking-verification.com/restore.php', 'https://www.amazon.com/', 'http', false
  UNION ALL SELECT 'https://accounts.google.com/reset', 'https://www.google.com/account', 'http', true
  UNION ALL
  SELECT p.url, CASE WHEN p.page_id % 4 = 3 THEN 'https://www.amazon.com/end' ELSE coalesce(q.url, 'http://last.example.org/') END,
    CASE WHEN p.page_id % 5 = 2 THEN 'meta' ELSE 'http' END, p.page_id % 13 <> 6
  FROM (SELECT url, max(page_id) AS page_id FROM pages GROUP BY url) p
  LEFT JOIN pages q ON q.page_id = p.page_id + 1
) hops"""

MX = """
SELECT domain FROM (
  SELECT 'amazon.com' AS domain UNION ALL SELECT 'gmail.com' UNION ALL SELECT 'microsoft.com'
  UNION ALL SELECT 'legittech.news' UNION ALL SELECT 'arnazon.com') mx"""

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"

WHOIS = """
SELECT domain, creation_dates, registrar, ok FROM (
  SELECT 'amazon.com' AS domain, array(TIMESTAMP '1994-11-01 05:00:00', TIMESTAMP '2001-01-01 00:00:00') AS creation_dates,
         'MarkMonitor' AS registrar, true AS ok
  UNION ALL SELECT 'paypa1.com', array(TIMESTAMP '2024-01-22 12:00:00'), 'CheapReg', true
  UNION ALL SELECT 'secure-login-bank.tk', array(TIMESTAMP '2023-12-03 00:00:00'), 'FreeReg', true
  UNION ALL SELECT 'gmail.com', array(TIMESTAMP '1995-08-13 04:00:00'), 'MarkMonitor', true
  UNION ALL SELECT 'arnazon.com', array(TIMESTAMP '2023-10-04 00:00:00'), 'CheapReg', true
  UNION ALL SELECT 'legittech.news', CAST(NULL AS {ts_array}), 'NewsReg', true
  UNION ALL SELECT 'microsoft.com', CAST(NULL AS {ts_array}), CAST(NULL AS STRING), false) w"""

DNS_TXT = """
SELECT name, ord, txt, status FROM (
  SELECT 'amazon.com' AS name, 1 AS ord, '"google-site-verification=x"' AS txt, 'NOERROR' AS status
  UNION ALL SELECT 'amazon.com', 2, '"v=spf1 include:spf1.amazon.com ip4:192.0.2.0/24 -all"', 'NOERROR'
  UNION ALL SELECT 'gmail.com', 1, '"v=spf1 include:_spf.google.com ~all"', 'NOERROR'
  UNION ALL SELECT 'microsoft.com', 1, '"v=spf1 mx ?all"', 'NOERROR'
  UNION ALL SELECT 'paypa1.com', 1, '"v=spf1 a +all"', 'NOERROR'
  UNION ALL SELECT 'arnazon.com', 1, '"v=spf1 -all mx ~all"', 'NOERROR'
  UNION ALL SELECT 'legittech.news', 1, '"v=spf1 ip4:300.1.1.1 ip6:2001:db8::1 -all"', 'NOERROR'
  UNION ALL SELECT 'secure-login-bank.tk', 1, CAST(NULL AS STRING), 'NXDOMAIN'
  UNION ALL SELECT '_dmarc.amazon.com', 1, '"v=DMARC1; p=quarantine; sp=reject; pct=90; rua=mailto:d@amazon.com; ruf=mailto:f@amazon.com"', 'NOERROR'
  UNION ALL SELECT '_dmarc.gmail.com', 1, '"v=DMARC1; p=none; rua=mailto:r@google.com"', 'NOERROR'
  UNION ALL SELECT '_dmarc.microsoft.com', 1, '"v=DMARC1; p=reject; pct=100"', 'NOERROR'
  UNION ALL SELECT '_dmarc.paypa1.com', 1, '"unrelated"', 'NOERROR'
  UNION ALL SELECT '_dmarc.arnazon.com', 1, CAST(NULL AS STRING), 'ERROR') t"""

REPUTATION = """
SELECT domain, reputation_score, blacklisted, blacklist_count, sources, ord FROM (
  SELECT 'paypa1.com' AS domain, CAST(0.05 AS DOUBLE) AS reputation_score, true AS blacklisted, 4 AS blacklist_count, 'listA,listB' AS sources, 1 AS ord
  UNION ALL SELECT 'paypa1.com', CAST(0.9 AS DOUBLE), false, 0, 'listC', 2
  UNION ALL SELECT 'secure-login-bank.tk', CAST(0.2 AS DOUBLE), true, 1, 'listA', 1
  UNION ALL SELECT 'legittech.news', CAST(0.7 AS DOUBLE), false, 0, 'listB', 1
  UNION ALL SELECT 'amazon.com', CAST(0.1 AS DOUBLE), false, 0, 'ignored', 1) r"""

# outcome of the signature check; only that of signed mails is ever used
DKIM = """
SELECT doc_id AS mail_id, doc_id % 3 <> 0 AS verified, doc_id % 10 = 5 AS error
FROM documents"""

IP_GEO = """
SELECT lo, hi, country FROM (
  SELECT CAST(83886080 AS BIGINT) AS lo, CAST(92274687 AS BIGINT) AS hi, 'Russia' AS country
  UNION ALL SELECT CAST(92274688 AS BIGINT), CAST(100663295 AS BIGINT), 'Germany'
  UNION ALL SELECT CAST(687865856 AS BIGINT), CAST(704643071 AS BIGINT), 'Nigeria'
  UNION ALL SELECT CAST(1694498816 AS BIGINT), CAST(1702887423 AS BIGINT), 'China'
  UNION ALL SELECT CAST(134217728 AS BIGINT), CAST(150994943 AS BIGINT), 'United States') g"""

VIEWS = {
    "mail": MAIL, "history": HISTORY, "detections": DETECTIONS, "feedback": FEEDBACK,
    "corpus": CORPUS, "vectors": VECTORS, "prob": PROB, "images": IMAGES, "html": HTML,
    "urls": URLS, "redirects": REDIRECTS, "mx": MX, "whois": WHOIS, "dns_txt": DNS_TXT,
    "suffixes": SUFFIXES, "reputation": REPUTATION, "dkim": DKIM, "ip_geo": IP_GEO,
}


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose driver tables of ``sf_dir`` under their own names."""
    for name in names:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name in ("documents", "pages"):  # long texts, often in a single split
            df = spread(df)
        df.createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named portable view over the tables of ``sf_dir``."""
    text = VIEWS[name]
    register_tables(spark, sf_dir, [t for t in TABLES if re.search(rf"(?:FROM|JOIN)\s+{t}\b", text)])
    return spark.sql(text.replace("{ts_array}", "ARRAY<TIMESTAMP>"))


def cte(name: str) -> str:
    """The same view as a CTE body for the check engine."""
    text = VIEWS[name].replace("{ts_array}", "TIMESTAMP[]")
    return text.replace("array(TIMESTAMP", "list_value(TIMESTAMP")

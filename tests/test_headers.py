"""Header values as expressions against the standard library's reading of the same header."""

import base64
from email.header import decode_header, make_header

import pytest
from pyspark.sql import functions as F

from mailglass.functions import headers as H
from mailglass.operators import mail, senders


def words(text, charset, kind):
    data = text.encode(charset)
    if kind in "Bb":
        return f"=?{charset}?{kind}?{base64.b64encode(data).decode()}?="
    return f"=?{charset}?{kind}?{''.join('_' if b == 32 else chr(b) if chr(b).isalnum() and b < 128 else f'={b:02X}' for b in data)}?="


CASES = [
    "plain text", "a =? b ?= c", words("Grüße, 字!", "utf-8", "B"), words("Grüße, 字!", "UTF-8", "q"), words("Café crème", "iso-8859-1", "Q"), words("naïve – “x” €", "windows-1252", "Q"),
    words("Привет мир", "koi8-r", "B"), words("Привет", "windows-1251", "q"), words("Łódź", "iso-8859-2", "b"), words("ab", "us-ascii", "q"),
    "Re: " + words("one", "utf-8", "B") + " " + words("two", "iso-8859-1", "Q") + " end", words("x", "utf-8", "b") + "\t  " + words("y", "utf-8", "b"),
]


def test_encoded_words_like_the_standard_library(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "i int, v string").withColumn("d", H.decode_words(F.col("v"))).collect()
    assert {r.i: r.d for r in rows} == {i: str(make_header(decode_header(v))) for i, v in enumerate(CASES)}


@pytest.mark.parametrize("value, want", [
    (None, None), ("", ""), ("=?utf-8?B?!!!?= x", "=?utf-8?B?!!!?= x"), ("=?shift_jis?B?g2U=?=", "=?shift_jis?B?g2U=?="), ("=?utf-8*en?Q?a=20b?=", "a b"), ("=?utf-8?Q?=FFx?=", "�x"), ("=?utf-8?Q??=", "")])
def test_odd_words(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(H.decode_words(F.col("v"))).first()[0] == want


RAW = ("Received: from relay.example.net\r\n\t([192.0.2.9]) by inbox\r\nFrom: =?utf-8?q?J=C3=B6rg?=\r\n <joerg@firm.example.com>\r\nTo:\r\n\tanna@example.org\r\nReply-To:\r\n help@other.example.com\r\n"
       "Subject: =?UTF-8?B?R3LDvMOfZQ==?=\r\n =?ISO-8859-1?Q?_f=FCr_Sie?= now\r\nDate: Mon,\r\n 8 Jan 2024 10:05:09 +0200\r\n\r\nBody\r\nTo: nobody\r\n")


def test_folded_and_encoded_mail(spark):
    df = spark.createDataFrame([(1, RAW, "joerg@firm.example.com")], "mail_id long, raw string, sender string")
    row = mail.extract_headers(df).first()
    assert (row.header_from, row.header_to, row.header_subject, row.header_date) == ("joerg@firm.example.com", "anna@example.org", "Grüße für Sie now", "Mon, 8 Jan 2024 10:05:09 +0200")
    meta = mail.header_metadata(df).first()
    assert (meta.local_hour, meta.zone, meta.reply_to, meta.origin_ip) == (10, "+0200", "help@other.example.com", "192.0.2.9")
    assert senders.alignment(df).first().misaligned_headers == ["Reply-To: other.example.com"]
    assert mail.first_header_line(df, "From:", "x").first().x == "=?utf-8?q?J=C3=B6rg?="
    parts = mail.split_parts(df).first()
    assert parts.part_subject == "Grüße für Sie now" and "\r" not in parts.headers and parts.part_body.startswith("Body\nTo: nobody")

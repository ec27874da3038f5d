"""CRLF mails, folded headers, nested ranges, and the shared folder's rule."""

import pytest


from mailglass.operators.behavior import locate_ips
from mailglass.operators.mail import split_parts
from mailglass.operators.senders import dkim
from mailglass.session import shared_folder

RAW = "From: A <a@b.com>\r\nDKIM-Signature: v=1; a=rsa;\r\n\td=b.com; s=k1;\r\n h=from\r\nSubject: Hi\r\n\r\nBody\r\nSubject: no\r\n"


def test_crlf_and_folding(spark):
    mail = spark.createDataFrame([(1, RAW)], "mail_id long, raw string")
    row = split_parts(mail).first()
    assert row.part_subject == "Hi" and row.part_body.startswith("Body") and "\r" not in row.headers
    signed = dkim(mail, spark.createDataFrame([(1, True, False)], "mail_id long, verified boolean, error boolean")).first()
    assert (signed.dkim_domain, signed.dkim_selector) == ("b.com", "k1")


def test_narrowest_range(spark):
    ranges = spark.createDataFrame([(0, 2**32 - 1, "China"), (16777216, 16777471, "Germany")], "lo long, hi long, country string")
    got = locate_ips(spark.createDataFrame([("1.0.0.9",), ("9.9.9.9",)], "origin_ip string"), ranges).collect()
    assert {r.origin_ip: r.origin_country for r in got} == {"1.0.0.9": "Germany", "9.9.9.9": "China"}


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())

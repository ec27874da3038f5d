"""Hand-checked expectations on small mails."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailglass.functions import url as U
from mailglass.operators import behavior, content, mail, models, senders, urls, verdict
from mailglass.sources import readers

BANK = ("From: a@bank.example\nSubject: URGENT: access suspended\n\n<p>Please verify: <a href=\"http://secure-banking-verification.com/restore.php\">"
        "http://secure-banking-verification.com/restore.php</a></p>")
PAY = "From: b@pay.example\nSubject: Update\n\n<a href=\"https://payment-update-portal.net/form.php?id=67890\">here</a>"
NEWS = "From: c@legittech.news\nSubject: News\n\n<a href=\"https://legittech.news/weekly\">https://legittech.news/weekly</a>"
SHOP = "From: d@amazon.com\nSubject: Order\n\n<a href=\"https://www.amazon.com/orders\">orders</a>"


def one(df):
    return df.collect()[0]


def scored_urls(spark, *links, compat=False):
    df = spark.createDataFrame([(x,) for x in links], "raw_url string")
    df = U.with_parts(U.with_normalized(df, "raw_url", "url"))
    return {r.raw_url: r for r in U.structure_rules(U.domain_rules(df, compat), compat=compat).collect()}


def test_published_link_risks(spark):
    mails = spark.createDataFrame(list(enumerate([BANK, PAY, NEWS, SHOP])), "mail_id long, raw string")
    rows = urls.roll_up_links(urls.link_verdicts(urls.mail_links(mails, keep_empty=True))).collect()
    assert {r.mail_id: r.url_risk for r in rows} == {0: 0.6, 1: 0.0, 2: 0.0, 3: 0.0}


def test_domain_rules(spark):
    rows = scored_urls(spark, "https://www.amazon.com/x", "http://192.0.2.7/login", "http://bit.ly/a", "http://x.tk/", "http://a.b.c.d.example.com/",
                       "http://example.com:8443/", "http://a-b-c-d.com/", "http://paypa1.com/", "http://AMAZON.example.com/%41%42%43%44")
    assert (rows["https://www.amazon.com/x"].dom_suspicious, rows["https://www.amazon.com/x"].dom_risk) == (False, 0.1)
    assert rows["http://192.0.2.7/login"].dom_risk == 0.9
    assert rows["http://bit.ly/a"].dom_risk == 0.6
    assert rows["http://x.tk/"].dom_reasons == ["Suspicious TLD: .tk"]
    assert rows["http://a.b.c.d.example.com/"].dom_reasons == ["Excessive number of subdomains"]
    assert rows["http://example.com:8443/"].dom_reasons == ["Unusual port: 8443"]
    assert rows["http://a-b-c-d.com/"].dom_reasons == ["Excessive hyphens in domain"]
    assert rows["http://paypa1.com/"].dom_reasons == ["Possible typosquatting of paypal.com"]
    mixed = rows["http://AMAZON.example.com/%41%42%43%44"]
    assert mixed.str_reasons == ["Excessive URL encoding (4 instances)", "Mixed case in domain"]
    # the literal form compares 'paypa1' with 'paypal.com'
    assert scored_urls(spark, "http://paypa1.com/", compat=True)["http://paypa1.com/"].dom_risk == 0.0


def test_normalize(spark):
    cases = {
        "HTTP.example.com": "http://http.example.com", "http://EX.com:80/A?b=2&a=1&a=0#f": "http://ex.com/a?a=0,1&b=2",
        "https://ex.com:443/%7Eu+v": "https://ex.com/~u+v", "http://ex.com/%zz?x=&y=1": "http://ex.com/%zz?y=1"}
    rows = scored_urls(spark, *cases)
    assert {k: rows[k].url for k in cases} == cases


def test_host_split(spark):
    rows = scored_urls(spark, "http://a.b.example.co.uk/x", "http://localhost/x", "http://10.0.0.1/")
    r = rows["http://a.b.example.co.uk/x"]
    assert (r.subdomain, r.domain, r.suffix, r.registered_domain) == ("a.b", "example", "co.uk", "example.co.uk")
    assert rows["http://localhost/x"].registered_domain == ""
    assert rows["http://10.0.0.1/"].registered_domain == ""


def test_extract_links_order_and_distinct(spark):
    text = "see http://b.example/1 <a href='http://a.example/2'>x</a> http://b.example/1"
    df = spark.createDataFrame([(1, text), (2, "none")], "mail_id long, raw string")
    assert [r.raw_url for r in urls.mail_links(df).orderBy("pos").collect()] == ["http://a.example/2", "http://b.example/1"]
    assert urls.mail_links(df, keep_empty=True).filter("mail_id = 2").count() == 1


def test_redirect_chain_rules(spark):
    hops = [("http://a.example/", "http://b.example/", "http", True), ("http://b.example/", "http://a.example/", "http", True),
            ("https://s.example/", "https://t.example/", "http", False),
            *[(f"http://c.example/{i}", f"http://c.example/{i + 1}", "http", True) for i in range(8)]]
    edges = urls.prepare_hops(spark.createDataFrame(hops, "src string, dst string, kind string, ssl_ok boolean"))
    starts = spark.createDataFrame([("http://a.example/",), ("https://s.example/",), ("http://c.example/0",), ("http://c.example/7",), ("http://none.example/",)], "url string")
    rows = {r.url: r for r in urls.redirect_chains(starts, edges).collect()}
    assert "Redirect loop detected" in rows["http://a.example/"].red_reasons and rows["http://a.example/"].red_risk == 0.8
    assert rows["https://s.example/"].red_risk == 0.9
    assert rows["http://c.example/0"].chain_length == 6
    assert rows["http://c.example/0"].red_reasons[-1] == "Maximum redirect chain length exceeded"
    assert rows["http://c.example/7"].red_suspicious is False
    assert "http://none.example/" not in rows


def test_look_alikes(spark):
    df = spark.createDataFrame([("paypa1.com",), ("arnazon.com",), ("gmail.com",), ("unrelated.example",)], "domain string")
    rows = {r.domain: r for r in senders.look_alike(df).collect()}
    assert (rows["paypa1.com"].similar_to, rows["paypa1.com"].typo_risk, round(rows["paypa1.com"].similarity, 6)) == ("paypal.com", 0.9, 0.9)
    assert (rows["arnazon.com"].similar_to, rows["arnazon.com"].edit_distance, rows["arnazon.com"].typo_risk) == ("amazon.com", 2, 0.7)
    assert rows["gmail.com"].typo_suspicious is False and rows["gmail.com"].typo_risk == 0.0
    assert rows["unrelated.example"].similar_to is None


def test_typo_table_agrees_with_edit_distance(spark):
    df = spark.createDataFrame([("paypa1.com",), ("aple.com",), ("chasee.com",), ("amazno.com",), ("arnazon.com",)], "domain string")
    found = {(r.domain, r.similar_to) for r in content.match_typos(df, senders.rules.SENDER_TRUSTED).collect()}
    assert found == {("paypa1.com", "paypal.com"), ("aple.com", "apple.com"), ("chasee.com", "chase.com"), ("amazno.com", "amazon.com")}
    near = {(r.domain, r.similar_to) for r in senders.look_alike(df).filter("edit_distance = 1").collect()}
    assert near <= found  # transpositions are one step in the table and two edits


def test_compat_sender_score(spark):
    """Old, trusted domain; quarantine policy; no signature; SPF read literally."""
    mails = spark.createDataFrame([(1, "d@amazon.com", SHOP)], "mail_id long, sender string, raw string")
    whois = spark.createDataFrame([("amazon.com", [dt.datetime(1994, 11, 1)], "r", True)], "domain string, creation_dates array<timestamp>, registrar string, ok boolean")
    dns = spark.createDataFrame([("amazon.com", 1, '"v=spf1 include:x.com -all"', "NOERROR"), ("_dmarc.amazon.com", 1, '"v=DMARC1; p=quarantine"', "NOERROR")],
                                "name string, ord int, txt string, status string")
    reputation = spark.createDataFrame([], "domain string, reputation_score double, blacklisted boolean, blacklist_count int, sources string, ord int")
    dkim = spark.createDataFrame([], "mail_id long, verified boolean, error boolean")
    score = lambda compat: one(senders.score_senders(mails, whois, dns, reputation, dkim, F.lit(dt.datetime(2024, 1, 1)), compat)).sender_risk
    assert score(True) == pytest.approx(0.18)
    assert score(False) == pytest.approx(0.13)  # the record is in fact valid and strict


@pytest.mark.parametrize("record, valid", [
    ("v=spf1 -all", True), ("v=spf1 mx", False), ("v=spf1 -all ~all", False), ("v=spf1 ip4:300.0.0.1 -all", False),
    ("v=spf1 ip4:192.0.2.0/24 ip6:2001:db8::/32 include:a.b -all", True), ("v=spf1 bogus -all", False), ("v=spf1 ip6:1::2::3 -all", False)])
def test_spf_validity(spark, record, valid):
    tokens = spark.createDataFrame([(record.split()[1:],)], "m array<string>")
    assert one(tokens.select(senders.spf_is_valid(F.col("m")).alias("ok"))).ok is valid


def test_sending_time(spark):
    history = spark.createDataFrame([("s", dt.datetime(2024, 1, d, 10)) for d in (1, 2)], "sender string, timestamp timestamp")
    mails = spark.createDataFrame([(1, "s", 10, 5), (2, "s", 23, 0), (3, "s", 10, 0), (4, "s", 11, 0), (5, "new", 11, 0), (6, "s", None, None)],
                                  "mail_id long, sender string, local_hour int, local_weekday int")
    rows = {r.mail_id: r.time_risk for r in behavior.sending_time(mails, history).collect()}
    assert rows == {1: 0.5, 2: 0.7, 3: 0.0, 4: 0.6, 5: 0.0, 6: None}


def test_header_dates_keep_the_senders_clock(spark):
    raw = "Received: from a.example [192.0.2.1]\nReceived: from b.example (mail [198.51.100.2])\nDate: Mon, 5 Jun 2023 23:23:45 -0500\nFrom: x@y.example\n\nbody"
    row = one(mail.header_metadata(spark.createDataFrame([(1, raw)], "mail_id long, raw string")))
    assert (row.local_hour, row.local_weekday, row.local_date, row.zone) == (23, 0, "2023-06-05", "-0500")
    assert row.received_domains == ["a.example", "b.example"]
    assert row.sent_utc == dt.datetime(2023, 6, 6, 4, 23, 45)


def test_pair_history(spark):
    rows = [(i, "s", "r", dt.datetime(2024, 1, 1 + 2 * i), int(i == 4)) for i in range(6)]
    df = behavior.pair_history(spark.createDataFrame(rows, "id long, sender string, recipient string, timestamp timestamp, is_phishing int"))
    got = {r.id: r for r in df.collect()}
    assert got[0].history_risk == 0.6 and got[3].history_risk == pytest.approx(0.2) and got[5].history_risk == 0.9
    assert got[3].average_interval_days == 2.0 and got[1].average_interval_days is None


def test_lexicon(spark):
    df = spark.createDataFrame([(1, "unauthorized access, legal action"), (2, "unauthorized access to your account, legal action")], "mail_id long, raw string")
    rows = {r.mail_id: r.content_risk for r in content.lexicon_score(df).collect()}
    assert rows[1] == pytest.approx(0.6) and rows[2] == pytest.approx(0.4)


def test_ensemble(spark):
    df = spark.createDataFrame([(0.4, 0.6, None), (None, None, None)], "sender double, url double, image double")
    got = [r.c for r in df.select(verdict.ensemble({n: F.col(n) for n in ("sender", "url", "image")}, verdict.rules.ENSEMBLE_WEIGHTS).alias("c")).collect()]
    assert got == [pytest.approx(0.5), 0.5]
    flipped = [r.c for r in df.select(verdict.ensemble({n: F.col(n) for n in ("image", "url", "sender")}, verdict.rules.ENSEMBLE_WEIGHTS).alias("c")).collect()]
    assert flipped == [pytest.approx(0.5), 0.5]
    assert one(df.limit(1).select(verdict.band(F.lit(0.1) + F.lit(0.2) + F.lit(0.2)).alias("b"))).b == "medium"


def test_report_from_published_counts(spark):
    counts = spark.createDataFrame([(0, 0, 1299), (0, 1, 22), (1, 0, 24), (1, 1, 696)], "y int, prediction int, n long")
    rows = {r.name: r for r in models.report(counts).collect()}
    assert rows["accuracy"].f1 == pytest.approx(0.977462, abs=1e-6)
    assert rows["1"].precision == pytest.approx(0.96936, abs=1e-5) and rows["1"].recall == pytest.approx(0.96667, abs=1e-5)
    assert rows["1"].f1 == pytest.approx(0.968011, abs=1e-6) and rows["0"].f1 == pytest.approx(0.982602, abs=1e-6)


def test_canonical_columns(spark):
    assert readers.resolve_columns(["Email Text", "Email Type", "from_addr", "Sent Date"]) == {"body": "Email Text", "sender": "from_addr", "date": "Sent Date"}
    table = spark.createDataFrame([("x", 0), ("y", 1)], "text string, label int")
    assert [r.is_phishing for r in readers.to_canonical(table, True).orderBy("body").collect()] == [0, 1]
    assert [r.is_phishing for r in readers.to_canonical(table, True, compat=True).collect()] == [1, 1]
    with pytest.raises(ValueError):
        readers.require_columns(table, "text", "verdict")


def test_user_component_and_settings(spark):
    settings = verdict.Config.from_dict({"confidence_threshold": 0.45, "component_weights": {"sender": 1.0}})
    assert settings.confidence_threshold == 0.45 and settings.high_confidence_threshold == 0.8
    rows = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.8), (1, "unknown", 1.0), (2, "a", None)], "mail_id long, component string, score double")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "component string, weight double")
    assert [(r.mail_id, round(r.confidence, 6)) for r in verdict.ensemble_long(rows, weights).collect()] == [(1, 0.65)]


def test_suffix_table(spark):
    table = spark.createDataFrame([("com",), ("jp",), ("*.kawasaki.jp",), ("!city.kawasaki.jp",), ("pvt.k12.ma.us",), ("it's",), (" ",), (None,)], "suffix string")
    known = U.suffix_rules(table)
    want = {"a.b.com": "com", "x.city.kawasaki.jp": "kawasaki.jp", "x.other.kawasaki.jp": "other.kawasaki.jp", "kawasaki.jp": "jp",
            "s.a.pvt.k12.ma.us": "pvt.k12.ma.us", "google.cm": "cm", "shop.it's": "it's", "localhost": "", "com": "com", "": ""}
    rows = spark.createDataFrame([(h,) for h in want], "host string").withColumn("suffix", U.suffix_of("host", known)).collect()
    assert {r.host: r.suffix for r in rows} == want


def test_unlisted_suffixes(spark):
    mails = spark.createDataFrame([(1, "http://a.pl/x http://b.se/x http://c.store/x"), (2, "https://google.cm/x")], "mail_id long, raw string")
    rows = {r.mail_id: r for r in urls.roll_up_links(urls.link_verdicts(urls.mail_links(mails))).collect()}
    assert rows[1].unique_domains == 3 and rows[2].url_suspicious

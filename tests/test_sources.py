"""Readers and MIME bodies on files as they arrive."""

from pyspark.sql import functions as F

from mailglass.plans import queries_io
from mailglass.sources import mime, readers, writers


def test_mail_files_drop_bad_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.eml").write_bytes(b"From: x@y.example\n\ncaf\xc3\xa9 \xff end")
    (tmp_path / "in" / "skip.bin").write_bytes(b"zz")
    rows = readers.read_mail_files(spark, str(tmp_path)).collect()
    assert [r.raw for r in rows] == ["From: x@y.example\n\ncafé  end"]


def test_mbox(spark, tmp_path):
    text = "From a Mon\nSubject: 1\n\none\n>From here\nFrom b Tue\nSubject: 2\n\ntwo\n"
    (tmp_path / "x.mbox").write_text(text)
    rows = sorted(r.raw for r in readers.read_mbox(spark, str(tmp_path)).collect())
    assert rows == ["Subject: 1\n\none\nFrom here", "Subject: 2\n\ntwo\n"]


def test_labelled_folders(spark, tmp_path):
    for box, text in (("spam", "caf\xe9"), ("easy_ham", "ok"), ("other", "no")):
        (tmp_path / box).mkdir()
        (tmp_path / box / "1").write_bytes(text.encode("latin-1"))
    rows = readers.read_labelled_folders(spark, str(tmp_path), {"spam": "phishing", "easy_ham": "legitimate"}).collect()
    assert sorted((r.label, r.raw) for r in rows) == [("legitimate", "ok"), ("phishing", "café")]


def test_examples_and_old_history(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"examples": [\n {"content": "c", "is_phishing": true, "explanation": "e"}]}')
    assert [tuple(r) for r in readers.read_examples(spark, str(tmp_path / "e.json")).collect()] == [("c", True, "e")]
    (tmp_path / "h.csv").write_text("sender,recipient,subject,timestamp,is_phishing\na@x,b@y,hi,2023-06-01 09:15:00,0\n")
    row = readers.read_history(spark, str(tmp_path / "h.csv")).first()
    assert row.origin_ip is None and row.timestamp.hour == 9 and row.is_phishing == 0


def test_mime_bodies(spark):
    multi = ("MIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=B\n\n--B\nContent-Type: text/plain\n\nplain\n--B\n"
             "Content-Type: text/html\nContent-Transfer-Encoding: base64\n\nPGI+aHRtbDwvYj4=\n--B--\n")
    df = spark.createDataFrame([(1, multi), (2, "Subject: s\n\n<p>one</p>  two\n"), (3, None)], "mail_id long, raw string")
    assert {r.mail_id: r.body for r in mime.mime_bodies(df).collect()} == {1: "plain html", 2: "one two", 3: ""}
    assert {r.mail_id: r.body for r in mime.mime_bodies(df, plain_only=True).collect()}[1] == "plain"


def test_files_in_folders_that_grow_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "PER_FOLDER", 50)
    df = spark.createDataFrame([(i, None if i == 7 else f"caf\u00e9 {i}\nend\r") for i in range(1000)] + [(3, "again")], "id long, body string")
    assert writers.write_files(df, str(tmp_path / "out"), F.concat(F.lit("id="), "id", F.lit(".txt")), F.col("body")) == 1000
    assert len(list((tmp_path / "out").iterdir())) <= 21
    back = {r.path.rpartition("=")[2]: r.raw for r in readers.read_mail_files(spark, str(tmp_path / "out")).collect()}
    assert len(back) == 1000 and back["7.txt"] == "\n" and back["12.txt"] == "caf\u00e9 12\nend\r\n"
    assert sorted(back["3.txt"].split("\n")) == sorted(["caf\u00e9 3", "end\r", "again", ""])


def test_mail_and_corpus_files_come_back(spark, monkeypatch):
    tables = {"mail": spark.createDataFrame([(5, "a\n\nb\n"), (6, None), (None, "c")], "mail_id long, raw string"),
              "corpus": spark.createDataFrame([(1, "\u00e9", 1), (2, "x\n", 0), (None, "", 0)], "id long, body string, is_phishing int")}
    monkeypatch.setattr(queries_io, "view", lambda spark, sf_dir, name: tables[name])
    assert {r.mail_id: r.raw for r in queries_io.s1(spark, "").collect()} == {5: "a\n\nb\n", 6: "", None: "c"}
    assert {r.id: (r.label, r.n_chars) for r in queries_io.s3(spark, "").collect()} == {1: ("phishing", 2), 2: ("legitimate", 2), None: ("legitimate", 0)}


def test_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path):
    """The same files as Spark's own source, of trees with odd names, without a listing on the driver."""
    for name in ("a.eml", "b.txt", "c.bin", ".hid.eml", "_hid.eml", "_x=1.eml", "deep/er/d.eml", "_skip/e.eml", ".skip/f.eml", "g=1/h i%20é.eml", "empty.txt", "x.eml._COPYING_"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "empty.txt" else name.encode())
    (tmp_path / "nothing").mkdir()
    for path, pattern in ((str(tmp_path), "*.{eml,txt}"), (str(tmp_path), "*"), (str(tmp_path / "*e*"), "[!x]*"), (str(tmp_path / "a.eml"), "*"), (str(tmp_path / "nothing"), "*")):
        want = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
        assert sorted(map(tuple, readers.read_files(spark, path, pattern).collect())) == sorted(map(tuple, want.collect()))
    found = readers.read_mail_files(spark, str(tmp_path))
    assert found.count() == 5 and not any(f.endswith((".eml", ".txt")) for f in found.inputFiles())

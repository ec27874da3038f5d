"""Rows that must not get lost: shared ids, weights of nothing, archives in gzip, pages without an id."""

import gzip

from pyspark.sql import functions as F

from mailglass.llm import mixing, warc
from mailglass.llm.shared import new_folder, open_folder


def test_one_text_of_an_id_goes_and_the_other_stays(spark, small, make):
    import corpus_pipeline

    a, b = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    rows = [(1, a, "en", "x"), (1, b, "en", "x"), (0, b, "en", "y"), (2, "  ", "en", "x"), (2, "  ", "en", "x"), (None, a, "en", "x"), (3, a.replace("alpha7 ", "gamma "), "en", "x"), (0, b, "en", "y")]
    docs = make(rows, "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.keep_one_of_each(spark, docs, small)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, make([rows[0], rows[2], rows[3], rows[5]], docs.schema).collect()))


def test_pipeline_on_an_empty_table(spark, small, make):
    import corpus_pipeline

    assert corpus_pipeline.keep_one_of_each(spark, make([], "doc_id long, text string, lang string, source string"), small).collect() == []


def test_budget_passes_a_weight_of_zero(make):
    leaves = make([("a", "x", 1, 100), ("a", "y", 1, 10), ("b", "x", 1, 200)], "p string, q string, n_docs long, tokens long")
    weights = make([("q", "x", 1), ("q", "y", 1)], "level string, node string, weight long")
    zero = weights.unionByName(make([("p", "c", 5)], weights.schema))
    dead = make([("a", "z", 1, 100), ("a", "y", 1, 10), ("b", "x", 1, 200)], leaves.schema)
    none = make([("q", "z", 0)], weights.schema)
    got = {(r.p, r.q): r.budget for r in mixing.leaf_budgets(dead, none, ["p", "q"], 100, 1).collect()}
    assert got == {("a", "z"): 0, ("a", "y"): 10, ("b", "x"): 90}
    got = {(r.p, r.q): r.budget for r in mixing.leaf_budgets(leaves, zero, ["p", "q"], 100, 1).collect()}
    assert got == {("a", "x"): 40, ("a", "y"): 10, ("b", "x"): 50}
    root = make([("p", "a", 0)], weights.schema)
    got = {(r.p, r.q): r.budget for r in mixing.leaf_budgets(leaves, root, ["p", "q"], 1000, 1).collect()}
    assert got == {("a", "x"): 0, ("a", "y"): 0, ("b", "x"): 200}


def test_archives_in_gzip(spark, make):
    pages = make([(k, f"http://h/{k}", f"<p>{k}</p>" * (k * 40)) for k in range(1, 40)], "page_id long, url string, html string")
    plain, zipped = new_folder(spark, "warc"), new_folder(spark, "warc")
    warc.write_warc(warc.records_of(pages), plain)
    system, path = open_folder(plain)
    from pyarrow import fs

    _, out = open_folder(zipped)
    system.create_dir(out, recursive=True)
    for n, info in enumerate(f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".warc")):
        with system.open_input_file(info.path) as source:
            data = source.read()
        cut = len(data) // 3  # members need not end where records do
        with system.open_output_stream(f"{out}/{n}.warc.gz", compression=None) as sink:
            sink.write(gzip.compress(data[:cut]) + gzip.compress(data[cut:]))
    for payload in (True, False):
        both = [sorted((r.record_id, r.record_type, r.payload_bytes, r.payload and bytes(r.payload)) for r in warc.read_warc(spark, folder, payload=payload).collect()) for folder in (plain, zipped)]
        assert both[0] == both[1] and len(both[0]) == 39
    one = warc.read_warc(spark, zipped).filter(F.col("record_id") == "<urn:x-page:7>").collect()
    assert len(one) == 1 and bytes(one[0].payload).decode() == "<p>7</p>" * 280


def test_pages_without_an_id_revisit(make):
    html = "<p>same</p>" * 20
    rows = warc.records_of(make([(None, "u", html), (3, "u", html), (5, "u", html), (None, "u", "short")], "page_id long, url string, html string")).collect()
    assert sorted((r.record_type, str(r.record_id), str(r.refers_to)) for r in rows) == [
        ("response", "<urn:x-page:3>", "None"), ("response", "None", "None"), ("revisit", "<urn:x-page:5>", "<urn:x-page:3>"), ("revisit", "None", "<urn:x-page:3>")]


def test_window_reads_on_without_reading_again():
    class Source:
        def __init__(self, data):
            self.data, self.read = data, 0

        def read_at(self, n, at):
            assert at >= self.read
            self.read = at + n
            return self.data[at : at + n]

    data = bytes(range(256)) * 40
    window = warc._Window(Source(data), 1 << 62, chunk=100)
    assert [window.bytes(a, n) for a, n in ((0, 50), (60, 90), (149, 2), (1000, 300))] == [data[a : a + n] for a, n in ((0, 50), (60, 90), (149, 2), (1000, 300))]
    assert window.bytes(len(data) - 3, 10) == data[-3:] and window.size == len(data) and window.bytes(len(data), 1) == b""

"""The audit against a walk through every order, document by document."""

import itertools

import pytest
from pyspark.sql import functions as F

from mailglass.llm import filter_audit
from mailglass.llm.queries import FILTERS

BLANK = " \t\n\x0b\x0c\r"


def fails(rows):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, part in rows:
        t = text or ""
        words = t.translate({ord(c): " " for c in BLANK}).split(" ")
        words = [w for w in words if w]
        bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
               "D": any(c in t for c in "#$%&*|"), "E": i is not None and i > first[t]}
        yield i, part or "", {k for k, v in bad.items() if v}


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    known = list(fails(rows))
    out = {}
    for part in {p for _, p, _ in known}:
        mine = [(i, bad) for i, p, bad in known if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            gone = [False] * len(mine)
            for step, letter in enumerate(order, 1):
                here = [k for k, (_, bad) in enumerate(mine) if letter in bad and not gone[k]]
                late = sum(letter in bad and gone[k] for k, (_, bad) in enumerate(mine))
                for k in here:
                    gone[k] = True
                shapley[letter] += len(here)
                out[part, "".join(order), step] = [letter, gone.count(False), len(here), late, sum(bad == {letter} for _, bad in mine), sum(mine[k][0] in good for k in here), sum(mine[k][0] in toxic for k in here)]
        for (p, _, _), row in out.items():
            if p == part:
                row.append(shapley[row[0]])
    return out


def sample():
    words = [f"w{k}" for k in range(400)]
    clean = " ".join(words[:150])
    texts = [clean, clean, " ".join(words[:99]), " ".join(words[:10] * 20), clean.upper(), clean + " #", "A B" * 20, None, "", " \t\x0b ", "Ünï 字 " * 120, clean + "\n" * 9, "a$" * 100_000, " ".join(words * 50), "one two"]
    rows = [(k, t, ("en", "de", None, "")[k % 4]) for k, t in enumerate(texts)]
    rows += [(0, clean, "en"), (0, "other text", "de"), (None, clean, "en"), (None, clean, "en"), (None, None, None), (50, "one two", "fr"), (51, "one two", "fr")]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (2, None, 1), (5, 1, None), (12, 0, 1), (50, 1, 1), (None, 1, 1), (99, 1, 1)]
    return rows, labels


def test_every_order(make):
    rows, labels = sample()
    docs = make(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("part", "mask", "n", "digest", "quality", "first", "step")})
    marks = make(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("clash") for c in ("text", "lang", "n", "good")})
    got = filter_audit.audit(docs, marks, FILTERS).collect()
    names = ("letter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    want = brute(rows, labels)
    assert len(got) == len(want) and {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == want


def test_other_filters_and_parts(make):
    docs = make([(1, "ab", 7), (2, "ab", 7), (3, "b", 8)], "doc_id string, text string, kind int")
    marks = make([], "doc_id string, quality int, toxic int")
    got = filter_audit.audit(docs, marks, {"x": lambda t: t.contains("a"), "y": filter_audit.REPEATED}, "kind").collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in got} == {
        ("7", "xy", 1): (0, 2, 0, 3), ("7", "xy", 2): (0, 0, 1, 1), ("7", "yx", 1): (1, 1, 0, 1), ("7", "yx", 2): (0, 1, 1, 3),
        ("8", "xy", 1): (1, 0, 0, 0), ("8", "xy", 2): (1, 0, 0, 0), ("8", "yx", 1): (1, 0, 0, 0), ("8", "yx", 2): (1, 0, 0, 0)}


def test_empty_and_too_many(make):
    docs = make([], "doc_id long, text string, lang string")
    marks = make([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, marks, FILTERS).collect() == []
    with pytest.raises(ValueError, match="letters"):
        filter_audit.audit(docs, marks, {c: FILTERS["A"] for c in "ABCDEFG"})

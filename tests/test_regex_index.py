"""Regular-expression search by trigrams against a scan."""

import random
import re

import pytest

from recolake.operators import regex_index as RX


def test_required_literals_hold_in_every_match():
    cases = {"abc": ["abc"], "ab.cd": ["ab", "cd"], "ab?c": ["a", "c"], "ab+c": ["ab", "c"], "a|b": [], "x(ab|c)y": ["x", "y"], r"a\.b\d+c": ["a.b", "c"],
             "[abc]de[]x]f": ["de", "f"], "(?i)abc": [], "ab{2,3}c": ["a", "c"], "ab*?c": ["a", "c"], "^abc$": ["abc"], "": [], "(abc)+d": ["d"], "a(?:b)c": ["a", "c"]}
    assert {p: RX.required_literals(p) for p in cases} == cases
    r = random.Random(1)
    parts = ["a", "b", "ab", "abc", ".", "b?", "c*", "a+", "[ab]", "(a|bc)", "(?:ab)?", r"\.", r"\w", "a{2}", "b{0,1}", "(ab)*", "^", "c"]
    checked = 0
    for _ in range(4000):
        pattern = "".join(r.choices(parts, k=r.randrange(1, 6)))
        text = "".join(r.choices("abc.", k=r.randrange(0, 12)))
        found = re.search(pattern, text)
        if found:
            checked += 1
            assert all(x in found[0] for x in RX.required_literals(pattern)), (pattern, text)
    assert checked > 500


SCHEMA = "item_id string, title string, description string, features array<string>"
WORDS = ["red", "Ring", "box", "größe", "STRASSE", "Straße", "x.y", "(a)", "Kelvin K", "ſet"]


@pytest.mark.parametrize("scan", [1, 1000])
def test_matches_equal_a_scan(spark, monkeypatch, scan):
    monkeypatch.setattr(RX, "SCAN_PATTERNS", scan)
    r = random.Random(2)
    rows = [(f"i{i:03}", r.choice([None, " ".join(r.choices(WORDS, k=2))]), r.choice([None, "", " ".join(r.choices(WORDS, k=9))]),
             r.choice([None, [], [None, r.choice(WORDS)], r.choices(WORDS, k=2)])) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    patterns = ["red ring", "r.d", "BOX$", "^red", "größe", "GRÖSSE", "strasse", r"x\.y", "x.y", "zzzz", "", "re", "a|b", "ring.*red", "(", "set", "kelvin k", "[", r"\(a\)", "red ?box"]
    asked = spark.createDataFrame([(p,) for p in [*patterns, "red", "red", None]], "query string")
    report = {}
    got = {(x.query, x.item_id) for x in RX.regex_matches(docs, asked, report=report).collect()}
    want = set()
    for p in [*patterns, "red"]:
        try:
            c = re.compile(p, re.IGNORECASE)
        except re.error:
            continue
        want |= {(p, i) for i, t, d, f in rows if any(c.search(x) for x in [t, d, *(f or [])] if x is not None)}
    assert got == want and report["verified"] < 12 * len(rows)
    assert {x.query for x in RX.bad_patterns(asked).collect()} == {"(", "["}
    first = RX.regex_search(docs, asked, 3, literal=True).filter("query = 'x.y'").collect()
    assert sorted(x.item_id for x in first) == sorted(i for i, t, d, f in rows if any("x.y" in x.lower() for x in [t, d, *(f or [])] if x))[:3]


def test_nothing_to_match(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([("red",), (".",)], "query string")
    assert RX.regex_search(none, asked).count() == 0
    docs = spark.createDataFrame([("a", "red", None, None)], SCHEMA)
    assert RX.regex_search(docs, asked.limit(0)).count() == 0


def test_pairs_beyond_the_wanted_matches_are_not_verified(spark, monkeypatch):
    """A pattern with enough matches among its smallest ids is done; one without goes on to all; rows of one id stay together."""
    monkeypatch.setattr(RX, "FIRST_PAIRS", 2)
    rows = [(f"i{i:04}", "large box" if i % 2 else "boxer large", None, None) for i in range(1000)] + [("i0003", "large box", None, None)] * 2
    rows += [("i0990", "large large box", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = spark.createDataFrame([("large",), ("large.*large",), ("nothing",)], "query string")
    report = {}
    got = RX.regex_search(docs, asked, 4, literal=False, report=report).collect()
    by = lambda q: [r.item_id for r in sorted(got, key=lambda r: r["rank"]) if r.query == q]
    # rows of an id count by the square, as the pairs and the texts have each of them
    assert by("large") == ["i0000", "i0001", "i0002", "i0003"] and by("large.*large") == ["i0990"] * 2 and by("nothing") == []
    # 1003 pairs of "large.*large", few of "large"
    assert report["verified"] < 1100

import random

import pytest

from sievework.operators.patterns import Offset, Pattern, PatternError, parse_offset, tokenize

CASES = [
    ("41??43", [b"AQC", b"AzC", b"AQCZ"], [b"AC"]),
    ("4?41", [b"AA", b"JA"], [b"\x5aA"]),
    ("?141", [b"1A", b"qA"], [b"2A"]),
    ("41{2}42", [b"AxxB"], [b"AxxxB"]),
    ("4141*4242", [b"AAhelloBB", b"AABB"], [b"AA"]),
    ("41{1-3}42", [b"AxB", b"AxxxB"], [b"AxxxxB", b"AB"]),
    ("41{-2}42", [b"AB", b"AxxB"], [b"AxxxB"]),
    ("41{2-}42", [b"AxxB", b"AxxxxxB"], [b"AxB"]),
    ("41(42|43)44", [b"ABD", b"ACD"], [b"AED"]),
    ("41(42|4243)44", [b"ABD"], [b"ABCD"]),
    ("64[4-4]61616161", [b"d\x01\x02\x03\x04aaaa"], [b"daaaa"]),
    ("4141(W)4242", [b"AA-BB"], [b"AAxBB", b"AABB"]),
    ("41!(42|43)44", [b"AXD"], [b"ABD", b"ACD", b"AD"]),
    ("4142(B)43", [], [b"ABC"]),
    ("4120(B)43", [b"A C"], []),
    ("41(L)42", [b"A\nB", b"A\r\nB", b"A\rB"], [b"AB"]),
]


@pytest.mark.parametrize("pattern,yes,no", CASES)
def test_matches(pattern, yes, no):
    p = Pattern.parse(pattern)
    assert all(p.matches_at(x, 0) for x in yes) and not any(p.matches_at(x, 0) for x in no)


@pytest.mark.parametrize("text", ["", "4", "4g", "41{3-1}42", "41{", "41(4", "41()", "41(4?)", "!(B)", "?", "41{x}"])
def test_rejects(text):
    with pytest.raises(PatternError):
        tokenize(text)


def test_anchor():
    p = Pattern.parse("41??424344{2}4546")
    assert (p.anchor, p.anchor_off, p.min_len) == (b"BCD", 2, 9)
    assert Pattern.parse("41*42424242").anchor_off is None
    assert Pattern.parse("414243", wide=True).anchor == b"A\0B\0C\0"


def test_offsets():
    assert parse_offset("10,5") == Offset("absolute", 10, 5)
    assert parse_offset("EOF-8") == Offset("eof", 8)
    assert parse_offset("EP+16") == Offset("ep", 16) and parse_offset("EP-2") == Offset("ep", -2)
    assert parse_offset("S0+0") == Offset("section", 0, 0, 0) and parse_offset("SE1") == Offset("section", 0, 0, 1)
    assert parse_offset("SL+4") == Offset("last", 4) and parse_offset(" * ") == Offset()
    for bad in ("VI", "x", "-1", "1,x", ""):
        with pytest.raises(PatternError):
            parse_offset(bad)


def by_anchor(p, offset, data):
    """Whether a rule is found, and its hit count, by the anchor search itself."""
    count, at = 0, data.find(p.anchor)
    while at >= 0:
        start = 0 if p.anchor_off is None else max(at - p.anchor_off, 0)
        count += offset.allows(start, len(data), None) and p.matches_at(data, start)
        at = data.find(p.anchor, at + 1)
    return count


def test_native_regexes(spark):
    """The JVM's regexes find and count what the anchor search does."""
    from pyspark.sql import functions as F

    from sievework.operators import scan

    rnd = random.Random(1)
    pieces = ["4141", "424142", "??", "4?", "?2", "{1}", "{0-2}", "{-2}", "{1-}", "*", "(41|4241)", "!(41|42)", "(B)", "(L)", "(W)"]
    offsets = ["*", "0", "1,2", "EOF-3", "EOF-4,2"]
    data = [bytes(rnd.choice(b"AAAB\n -") for _ in range(rnd.randrange(14))) for _ in range(150)]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "content binary").cache()
    for _ in range(25):
        p = Pattern.parse("".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 4))) + "4141")
        o = parse_offset(rnd.choice(offsets))
        c = F.col("content")
        found = df.select("content", scan.matches(c, p, 0, o).alias("m"), scan.hit_count(c, p).alias("n")).collect()
        for r in found:
            d = bytes(r.content)
            assert r.m == (by_anchor(p, o, d) > 0), (p.tokens, o, d)
            assert r.n == by_anchor(p, Offset(), d), (p.tokens, d)

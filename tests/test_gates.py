"""The look for beginnings and pieces lets no match of a pattern by."""
import random
import re._constants as C
import re._parser as parser

from pyspark.sql import functions as F

from triagegrid.functions.pieces import KEYS, PIECES, key_of
from triagegrid.functions.text import add_folded, has_match, may_match

CLASSES = {C.CATEGORY_DIGIT: "0123456789", C.CATEGORY_SPACE: " \t\n", C.CATEGORY_WORD: "abcxyzÉß_7", C.CATEGORY_NOT_SPACE: "ab,#é", C.CATEGORY_NOT_WORD: " .,;-", C.CATEGORY_NOT_DIGIT: "ab ,"}


def sample(nodes, rng):
    """A text that a parsed pattern matches, boundaries and looks ahead aside."""
    out = ""
    for op, value in nodes:
        if op in (C.LITERAL,):
            out += chr(value)
        elif op is C.NOT_LITERAL:
            out += "q" if chr(value) != "q" else "z"
        elif op is C.ANY:
            out += rng.choice("ab .,")
        elif op is C.IN:
            negated = value[0][0] is C.NEGATE
            kind, v = rng.choice(value[1:] if negated else value)
            if negated:
                out += "q"
            else:
                out += chr(v) if kind is C.LITERAL else chr(rng.randint(*v)) if kind is C.RANGE else rng.choice(CLASSES[v])
        elif op is C.BRANCH:
            out += sample(rng.choice(value[1]), rng)
        elif op is C.SUBPATTERN:
            out += sample(value[-1], rng)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = value
            for _ in range(rng.randint(least, min(most, least + 2))):
                out += sample(inner, rng)
    return out


def test_no_match_is_missed(spark):
    rng = random.Random(11)
    texts = []
    for regex in PIECES:
        for _ in range(60):
            found = sample(parser.parse(regex), rng)
            cased = "".join(rng.choice([c, c.upper(), c.lower()]) for c in found)
            texts.append(rng.choice(["", "x", "_", "“", "é", "-", "a b ", "ſ", "İ", "\n"]) + cased + rng.choice(["", "s", " now", ".", "»", "9"]))
    df = add_folded(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string"))
    checks = [(has_match(F.col("text"), regex).alias(f"m{i}"), may_match("_low", regex).alias(f"g{i}")) for i, regex in enumerate(PIECES)]
    rows = df.select("text", *[c for pair in checks for c in pair]).collect()
    matched = 0
    for r in rows:
        for i, regex in enumerate(PIECES):
            matched += bool(r[f"m{i}"])
            assert not r[f"m{i}"] or r[f"g{i}"], (regex, r["text"])
    assert matched > 30 * len(PIECES)


def test_beginnings_of_words():
    assert key_of("sql injection", True) == "sql" and key_of("sql injection", False) == "inj" and key_of(" officer", False) == "off"
    assert key_of("bug", True) == "bug" and key_of("bug", False) is None and key_of("vp", True) is None and key_of("is down", True) == "is"
    assert key_of("$", True) is None and sum(map(len, KEYS.values())) > 150

"""Recall of random strings per encoding and length, and natural strings of letters left alone."""

import random

import pytest

from chronospan.llm import secrets

LOWER = "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = {
    "base36": LOWER + "0123456789", "BASE36": LOWER.upper() + "0123456789", "base32lower": LOWER + "234567", "base32": LOWER.upper() + "234567",
    "base62": LOWER + LOWER.upper() + "0123456789", "base64": LOWER + LOWER.upper() + "0123456789+/", "letters": LOWER + LOWER.upper(), "lower": LOWER, "UPPER": LOWER.upper(),
}
WORDS = "internationalization responsibility configuration environment understanding characteristics verbindung gesellschaft wirtschaft entwicklung administration philosophique extraordinaire gouvernement the other summer holiday photo album winter and notes from".split()


@pytest.mark.parametrize("length", [24, 32, 40, 64, 128])
def test_random_strings_of_every_encoding_are_found(spark, length):
    rng = random.Random(length)
    rows, kinds = [], {}
    for kind, symbols in SYMBOLS.items():
        for _ in range(60):
            kinds[len(rows)] = kind
            rows.append((len(rows), "the key is " + "".join(rng.choice(symbols) for _ in range(length)) + " here"))
    for _ in range(600):
        words = [rng.choice(WORDS) for _ in range(rng.randint(3, 8))]
        rows.append((len(rows), "see " + rng.choice(["", "-", "_", "/"]).join(words) + " and " + "".join(w.capitalize() for w in words) + " and " + "".join(words).upper()))
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = {r["doc_id"] for r in found if "random" in r["spans"]}
    recall = {kind: sum(kinds[i] == kind for i in hit if i in kinds) / 60 for kind in SYMBOLS}
    false = len([i for i in hit if i not in kinds])
    print(length, recall, false)
    assert all(share >= (0.8 if length == 24 else 0.9) for share in recall.values())
    assert false <= 6

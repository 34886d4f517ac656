"""Small inputs with the cases every operator must bear, and plain versions to hold results against."""

import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"word{i % 97}x{i}" for i in range(600))
PROSE = "The quick brown fox jumps over the lazy dog while the old grey cat sleeps near the warm stove and dreams of fish in the blue river"
DOCS = [
    (1, PROSE + "\nA shared line that stands in several documents of the set\nunique one", "a"),
    (2, PROSE.upper() + "\nA shared line that stands in several documents of the set\nunique one", "a"),
    (3, PROSE + "\nA shared line that stands in several documents of the set\nunique two here", "b"),
    (4, None, None),
    (5, "", "a"),
    (6, " \n\t\n...", "a"),
    (7, "Ünïcode wörds ÉTÉ été naïve 日本語 テキスト 🎉 mixed", "c"),
    (8, "short", "c"),
    (9, "short", "c"),
    (10, LONG, "a"),
    (11, LONG + " extra tail", "a"),
    (12, "completely different text about licenses: Licensed under the Apache License, Version 2.0. Nothing else", "d"),
    (13, "tab\tand nul\x00 and  double  spaces ▁ marker nbsp", "d"),
    (None, "a row without an id", "d"),
    (14, "a row repeated whole", "d"),
    (14, "a row repeated whole", "d"),
]
SCHEMA = "doc_id long, text string, source string"


def documents(spark, rows=DOCS):
    """With extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("*", "'x' as node", "1 as row_key", "'y' as held_out", "2 as bucket", "'z' as words")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

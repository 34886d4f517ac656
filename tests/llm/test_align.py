"""Cross-tokenizer alignment against plain encodings of whole texts."""

import hashlib
import random
from collections import Counter
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowsmith.llm import align
from rowsmith.llm.queries import op12_cross_tokenizer_alignment, table, tokenizer

from .helpers import DOCS, documents, empty

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
ODD = [
    "a  b   c\n\n d\t e   ",
    " begins with blanks",
    "<|endoftext|> and </s> <s> <0x41> as text",
    "naïve 日本語テキスト 🎉🎉  nbsp　wide ᠎ x y",
    "it's we'll they'd I'm don't 'quoted' 12345 3.14 foo.bar(baz)",
    "has ▁ a marker",
    "\x00nul \x1c sep",
    "x" * 3000,
    "日本" * 2500,
    " ",
    "\n",
    "word " * 4000,
]


def plain(rows):
    """{(doc_id, text): row} by whole encodings, byte offsets in sets and one count over all."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = {c: x for x, c in zip(range(256), map(chr, range(256)), strict=True) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174}
    chars |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in chars.values())}
    found = []
    for doc_id, text in rows:
        full = " " + (text or "")
        x = a.encode(full, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        ax = [bytes(chars[c] for c in a.id_to_token(i)) for i in x]
        by = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        if b"".join(ax) != full.encode() or b"".join(by) != full.encode():
            x, y, ax, by = [], [], [], []
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 500 else list(__import__("itertools").accumulate(map(len, parts)))
        ea, eb = ends(ax), ends(by)
        at_a, at_b = dict(zip(ea, x, strict=True)), dict(zip(eb, y, strict=True))
        both = sorted(set(ea) & set(eb))
        groups, low = [], 0
        ia = ib = 0
        for e in both:
            ga, gb = [], []
            while ia < len(ea) and ea[ia] <= e:
                ga.append(x[ia])
                ia += 1
            while ib < len(eb) and eb[ib] <= e:
                gb.append(y[ib])
                ib += 1
            groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
            low = e
        assert low in (0, len(full.encode()))
        found.append((doc_id, len(x), len(y), len(both), [(at_a[e], at_b[e]) for e in both], hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = Counter(p for f in found for p in f[4])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((d, na, nb, ng, len(ln), sum(count[p] == best[p[1]] for p in ln), sum(count[p] for p in ln), sha) for d, na, nb, ng, ln, sha in found), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("chunk", [40, 1000, align.CHUNK])
def test_equals_whole_encodings(spark, chunk):
    rows = [(i, t, s) for i, t, s in DOCS] + [(100 + k, t, "o") for k, t in enumerate(ODD)] + [(100, ODD[0], "o"), (107, ODD[7], "o")]
    out = align.align(documents(spark, rows), A, B, chunk)
    assert got(out) == plain([r[:2] for r in rows])


def test_query_equals_whole_encodings(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text").collect()
    assert got(op12_cross_tokenizer_alignment(spark, data)) == plain([tuple(r) for r in docs])


def test_no_rows(spark):
    assert align.align(empty(spark), A, B).collect() == []
    assert got(align.align(documents(spark, [(1, None, None), (2, "", "")]), A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


TEXT = st.text(st.sampled_from("ab é日🎉'.,1 \n\t") | st.characters(codec="utf-8"), min_size=1, max_size=120)


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(1, 30), st.integers(0, 5))
def test_composing_is_associative(text, chunk, seed):
    p = align.pair(A, B)
    units = align.Units(p)
    whole = next(units.fragments([text], [(0, None)]))
    cuts = align.cuts_of(text, p, chunk)
    parts = list(units.fragments([c[0] for c in cuts], [c[1:] for c in cuts]))
    say = lambda f: align.finished(f, p.size_b)
    join = lambda x, y: align.compose(x, y, p.size_b)
    assert say(reduce(join, parts)) == say(whole)
    pick = random.Random(seed)
    while len(parts) > 1:  # any grouping of neighbours
        k = pick.randrange(len(parts) - 1)
        parts[k : k + 2] = [join(parts[k], parts[k + 1])]
    assert say(parts[0]) == say(whole)
    assert join(align.NOTHING, whole) == whole

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rowsmith.llm import chat, decontam, licenses, pieces, quality, queries, tokens
from tests.conftest import assert_same
from tests.llm.helpers import DOCS, documents, empty, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op5_embedding_near_dedup", "op9_chat_formatting", "op10_decontamination"])
def test_sql(name, spark, duck, data):
    assert_same(queries.queries()[name](spark, data), duck, queries.oracle_sql()[name])


def test_pieces_equal_the_library(spark, data):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()] + [r[:2] for r in DOCS]
    rows += [(-1, "  two  spaces   three"), (-2, "▁▁ literal ▁marks"), (-3, " "), (-4, "\n\n"), (-5, "</s><s>[INST]"), (-6, "a" * 5000), (-7, "é̂ ﬁ Å")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_digests(df, MODEL).collect()]
    assert sorted(got) == sorted(want)
    full = {r.doc_id: r for r in pieces.encode(df.filter("doc_id < 0"), MODEL).collect()}
    assert list(full[-1].ids) == sp.encode("  two  spaces   three", add_eos=True) and full[-1].decoded == "  two  spaces   three"
    assert pieces.encode_digests(empty(spark), MODEL).count() == 0


def test_piece_table_begins_anew(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_CHUNKS", 3)
    table = pieces.ChunkTable(MODEL)
    texts = ["a b c d e f g", "h i j", "a b"]
    assert [n for n, _, _ in table.encode(texts)] == [8, 4, 3]
    assert [t for _, _, t in table.encode(["x y z w v", "a"])] == ["x y z w v", "a"]


def spans(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).offsets


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_of_sections(spark, rule):
    rows = [r for r in DOCS if r[0] != 10] + [(50, "a\n\n\n\nb\n \n  c\n", "x\ny"), (51, "日\n本\n🎉\n\n", None)]
    got = {}
    for r in tokens.attribute(documents(spark, rows), ["source", "text"], RANKS, public_tokenizers.PATTERN, rule).collect():
        got.setdefault(r.doc_id, []).append((r.field, r.section, r.n_chars, round(r.n_tokens, 6), r.n_crossing))
    for i, text, source in rows:
        if i == 14:
            continue
        fields = [("source", source or ""), ("text", text or "")]
        sections, whole = [], "\n".join(f for _, f in fields)
        for name, f in fields:
            sections += [[name, k, len(line) + 1, 0.0, 0] for k, line in enumerate(f.split("\n"))]
        sections[-1][2] -= 1
        owner = [k for k, s in enumerate(sections) for _ in range(s[2])]
        for a, b in spans(whole):
            own = owner[a:b]
            for k in set(own):
                sections[k][4] += len(set(own)) > 1
            if rule == "start":
                sections[own[0]][3] += 1
            elif rule == "majority":
                sections[max(sorted(set(own)), key=own.count)][3] += 1
            else:
                for k in own:
                    sections[k][3] += 1 / len(own)
        assert sorted(got[i]) == sorted((n, k, c, round(x, 6), y) for n, k, c, x, y in sections), i
    assert len(got[14]) == 2 * 2
    with pytest.raises(ValueError):
        tokens.attribute(empty(spark), ["text"], RANKS, public_tokenizers.PATTERN, "none")
    assert tokens.attribute(empty(spark), ["text"], RANKS, public_tokenizers.PATTERN).count() == 0


PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}


def test_license_base_against_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()] + [(5000 + k, r[1]) for k, r in enumerate(DOCS)]
    rows += [(-1, "CC-BY-NC cc by nc-sa under THE mit License under the mit licensed"), (-2, "apache license version 2.0 apache license version 22"), (-3, "xunder the mit license")]
    want = {}
    for i, t in rows:
        w = words(t)
        hits = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        at = [k for k, _ in hits]
        want[i] = (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))
    got = licenses.summaries(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels.split(",") == sorted(set(r.labels.split(",")))
    assert licenses.summaries(empty(spark)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", {"gpl"}),
        ("Released under the GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("License: CC BY-NC-SA 4.0", {"cc-by-nc-sa"}),
        ("Licensed under the Mozilla Public License, v. 2.0", {"mpl-2"}),
        ("we permit this apache tribe to submit", set()),
        ("Copyright (c) 2020 X. All rights reserved.", {"copyright", "proprietary"}),
    ],
)
def test_license_rules(text, labels):
    found = {f[2] for f in licenses.scan(text.encode())[2]}
    assert labels <= found and (labels or not found)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("This is MIT licensed.", {"mit"}),
        ("GPLv3+", {"gpl-3"}),
        ("a library under the LGPL", {"lgpl"}),
        ("under MIT or Apache-2.0", {"mit", "apache-2"}),
        ("Licensed under either of Apache-2.0 or MIT", {"apache-2", "mit"}),
        ("distributed under the GPLv2", {"gpl-2"}),
        ("the AGPL licensed server", {"agpl"}),
        ("released under the MPL and BSD", {"mpl", "bsd"}),
        ("he studied at Harvard and MIT", set()),
        ("an apache helicopter", set()),
    ],
)
def test_license_phrasings(text, labels):
    assert {f[2] for f in licenses.scan(text.encode())[2]} == labels


def license_examples(parsed):
    """Texts that an expression matches, in which each of its alternatives and options stands at least once."""
    from re import _constants as C

    out = [""]
    for kind, value in parsed:
        if kind is C.LITERAL:
            each = [chr(value)]
        elif kind is C.IN:
            each = [chr(v if k is C.LITERAL else v[0]) for k, v in value if k is not C.NEGATE] if value[0][0] is not C.NEGATE else ["x"]
        elif kind is C.NOT_LITERAL:
            each = ["x"]
        elif kind is C.SUBPATTERN:
            each = license_examples(value[3])
        elif kind is C.BRANCH:
            each = [x for part in value[1] for x in license_examples(part)]
        elif kind is C.MAX_REPEAT:
            one = license_examples(value[2])
            each = [x * max(value[0], 1) for x in one] + ([""] if value[0] == 0 else [])
        elif kind is C.ASSERT and value[0] < 0:  # what has to stand before
            each = ["x" + x for x in license_examples(value[1])]
        else:
            each = [""]
        out = [a + each[0] for a in out] + [out[0] + x for x in each[1:]]
    return out


def test_license_gates_leave_nothing_out():
    from re import _parser

    n = 0
    for label, _, _, _, own in licenses.rules():
        for text in map(str.encode, license_examples(_parser.parse(own.pattern))):
            assert own.search(text), (label, text)
            every = [(m.start(), m.end(), p, k, x, c) for k, (x, p, c, _, e) in enumerate(licenses.rules()) for m in e.finditer(text)]
            assert licenses.scan(text)[2] == [(s, e, x, c) for s, e, _, _, x, c in licenses.settle(every)], text
            n += 1
    assert n > len(licenses.rules())


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc"),
        ("Released under the MPL 2.0", "mpl-2"),
        ("under the BSD 3-Clause", "bsd-3-clause"),
        ("distributed under the AGPL v3", "agpl-3"),
        ("Altered source versions must be plainly marked as such", "zlib"),
        ("All advertising materials mentioning features or use of this software must display", "bsd-4-clause"),
        ("Neither the name of Acme nor the names of its contributors", "bsd-3-clause"),
        ("Unauthorized copying of this file", "proprietary"),
        ("Proprietary and confidential", "proprietary"),
        ("for non-commercial use only", "non-commercial"),
        ("CC0 1.0", "cc0"),
        ("Available subject to GPL 3", "gpl-3"),
        ("released under Apache 2.0", "apache-2"),
        ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
        ("You may not use this file except in compliance with the License", "apache-2"),
    ],
)
def test_license_names_need_no_stem(text, label):
    assert label in {f[2] for f in licenses.scan(text.encode())[2]}


def test_license_overlaps_are_settled():
    assert len(licenses.rules()) > 200
    finds = [(0, 10, 50, 1, "a", 1.0), (2, 8, 99, 0, "b", 1.0), (0, 10, 60, 2, "c", 1.0), (9, 15, 1, 3, "d", 1.0), (20, 25, 1, 4, "e", 1.0), (20, 25, 1, 5, "f", 1.0)]
    assert [f[4] for f in licenses.settle(finds)] == ["c", "e"]
    assert [f[4] for f in licenses.settle([(0, 10, 10, 1, "a", 1.0), (8, 20, 60, 2, "b", 1.0), (19, 30, 20, 3, "c", 1.0), (40, 41, 1, 0, "d", 1.0)])] == ["b", "d"]


def test_license_scan_is_linear():
    import time

    phrase = b"Under the MIT license, CC BY-NC and apache license version 2. "
    began = time.time()
    n, base, _ = licenses.scan(phrase * 40_000)
    assert n == 12 * 40_000 and len(base) == 3 * 40_000 and base[0] == (0, "mit")
    assert time.time() - began < 30


def brute_hits(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(size, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add("" if item is None else str(item))
    lengths = {len(x) for x in windows}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for s in range(len(w) - k + 1):
                own = windows.get(tuple(w[s : s + k]))
                if own:
                    hit |= set(range(s, s + k))
                    found |= own
        out.append((str(i), len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("most", [100_000, 0])
def test_contamination_against_brute_force(spark, data, most):
    read = lambda t, i: [(r[0], r[1]) for r in spark.read.parquet(f"{data}/{t}.parquet").select(i, "text").collect()]
    docs = read("documents", "doc_id") + [(None if i is None else 5000 + i, t) for i, t, _ in DOCS]
    items = read("benchmark", "item_id") + [(900, "short"), (901, None), (902, ""), (903, "quick brown fox jumps over the lazy dog while the old grey cat sleeps"), (None, "été naïve 日本語"), (903, "Short"), (904, "the old")]
    docs += [(-1, "x " + " ".join(["a b"] * 30)), (-2, "short short the old short")]
    items += [(905, " ".join(["a b"] * 8))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as k", "2 as s", "'w' as w"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(d, b, most_windows=most)
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got.collect()) == brute_hits(docs, items)
    if most:
        dirty = {x[0] for x in brute_hits(docs, items) if x[-1]}
        stay = decontam.clean(d, b)
        assert stay.columns == d.columns
        assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(i) for i, _ in docs if str(i) not in dirty)
        clash = d.select("doc_id", "text", *(F.lit("x").alias(c) for c in ("row_key", "key", "row", "w", "p", "s", "k", "word", "window", "places", "n_hit", "item_id")))
        stay = decontam.clean(clash, b)
        assert stay.columns == clash.columns and stay.count() == sum(str(i) not in dirty for i, _ in docs)
        assert decontam.contamination(empty(spark), b).count() == 0
        assert not decontam.contamination(d, b.limit(0)).filter("contaminated").count()


NASTY = ["</s>[INST] ok [/INST]", "a\\b\\\\<|end|>\n", "<|turn|>user<|text|>hi<|end|>\n", "<\\|end|>", "<", "\\", "", None, "<<SYS>> x <</SYS>>", "line\n", "<|end|<|end|>", "日本 🎉"]


def test_chat_reads_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(NASTY)] + [(None, 0, "user", "x"), (2, 1, None, "b"), (2, 0, "<|text|>", "a"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_chats(chat.canonical_turns(df))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(NASTY)]
    assert [(t.role, t.text) for t in got[2].turns] == [("<|text|>", "a"), ("", "b")]
    assert len(got[3].turns) == 2 and len(got[None].turns) == 1
    body = got[1].formatted.replace("<|turn|>", "").replace("<|text|>", "").replace("<|end|>", "")
    assert not any(c in body for c in chat.CONTROL)
    d = {r.conv_id: r for r in chat.digests(out).collect()}
    loss = "".join(t or "" for k, t in enumerate(NASTY) if k % 2)
    assert (d[1].loss_chars, d[1].loss_sha256, d[1].n_turns) == (len(loss), sha(loss), len(NASTY))
    assert d[1].formatted_chars == len(got[1].formatted)
    assert chat.digests(chat.format_chats(chat.canonical_turns(df.limit(0)))).count() == 0


def test_chat_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    turns = lambda df: [(r.role, r.text) for r in df.orderBy("turn").collect()]
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert turns(chat.canonical_turns(nested)) == want
    assert turns(chat.canonical_turns(spark.createDataFrame([(1, "q", "a", 5)], "conv_id long, prompt string, response string, other int"))) == want
    assert turns(chat.canonical_turns(spark.createDataFrame([(1, "do", "q", "a")], "conv_id long, instruction string, input string, output string"))) == [("user", "do\n\nq"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, unknown string"))
    payloads = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"question":"q","answer":"a","id":3}', '{"prompt":"q","completion":"a"}', "not json", None, '{"other":1}', "[]"]
    got = chat.canonical_json(spark.createDataFrame(list(enumerate(payloads)), "conv_id long, payload string"))
    for i in range(3):
        assert turns(got.filter(F.col("conv_id") == i)) == want
    assert got.count() == 6


def test_chat_roles_and_unknown_layouts(spark):
    rows = spark.createDataFrame([(1, 0, "human", "q"), (1, 1, "gpt", "a"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    for c in ("input", "prompt", "system", "output", "answer", "instruction", "response", "formatted", "segments", "turns", "t", "payload", "paths"):
        rows = rows.withColumn(c, F.lit("extra"))
    got = chat.canonical_turns(rows).orderBy("turn").collect()
    assert [(r.role, r.text) for r in got] == [("human", "q"), ("gpt", "a"), ("assistant", "b")]
    assert chat.digests(chat.format_chats(chat.canonical_turns(rows))).head().loss_chars == 1
    payloads = [
        '{"prompt":"q","response":"a","text":"t"}',
        '{"messages":[]}',
        '{"messages":[{"role":"user","content":"q","text":"t"}]}',
        '{"instruction":"q","response":"a","context":"c"}',
        '{"prompt":"q","completion":"a","system":"s"}',
        "null",
        '{"conversations":[{"from":"human","value":"q"}]}',
    ]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "conv_id long, payload string, turns string")
    kept, rejected = chat.canonical_json(df), {r.conv_id: r.reason for r in chat.rejected_json(df).collect()}
    assert rejected == {1: "no layout", 3: "no layout", 5: "no layout"}
    assert {r.conv_id for r in kept.select("conv_id").collect()} | set(rejected) == set(range(len(payloads)))
    said = {(r.conv_id, r.turn): (r.role, r.text) for r in kept.collect()}
    assert said[0, 0] == ("user", "q") and said[0, 1] == ("assistant", "a") and said[2, 0] == ("user", "q") and said[6, 0] == ("user", "q")


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.labelled_sample(docs, labels.filter("doc_id % 4 <> 0")))
    assert (model["thresholds"][1:] > model["thresholds"][:-1]).all()
    scored = quality.score(docs, model).join(labels.filter("doc_id % 4 = 0"), "doc_id").withColumn("grade", quality.grade_of(F.col("quality"), F.col("toxic")))
    mean = {r.grade: r for r in scored.groupBy("grade").agg(F.avg("expected_grade").alias("e"), F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert mean[2].e > mean[1].e and mean[2].e > mean[0].e
    assert mean[2].k > 0.95 and mean[1].k < 0.5


def test_quality_likelihood_and_gradient():
    """The loss against one written out for each row, the gradient against differences of the loss."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows, places, grades, decay = 12, 5, 4, 0.01
    there = rng.random((rows, places)) < 0.5
    doc, column = np.nonzero(there)
    y = rng.integers(0, grades, rows)
    theta = rng.standard_normal(places + grades - 1)
    got, gradient = quality.loss_and_gradient(theta, doc, column, y, places, grades, decay)
    cuts = [theta[places]]
    for g in theta[places + 1 :]:
        cuts.append(cuts[-1] + np.exp(g))
    chance = lambda k, s: 0.0 if k < 0 else 1.0 if k >= grades - 1 else 1 / (1 + np.exp(s - cuts[k]))
    want = 0.0
    for i in range(rows):
        s = sum(theta[j] for j in range(places) if there[i, j])
        want -= np.log(chance(y[i], s) - chance(y[i] - 1, s)) / rows
    want += decay / 2 * sum(w * w for w in theta[:places])
    assert got == pytest.approx(want)
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-6
        up, down = (quality.loss_and_gradient(theta + x, doc, column, y, places, grades, decay)[0] for x in (step, -step))
        assert gradient[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_quality_sample_is_bounded_and_stable(spark):
    rows = [(i, f"word{i % 7} common text number {i}", i % 3) for i in range(60)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    a, b = (quality.fit(x, sample=40, least_docs=1, steps=3) for x in (df, df.repartition(7)))
    assert (a["known"] == b["known"]).all() and (a["weights"] == b["weights"]).all()
    small = quality.fit(df, least_docs=1, steps=1, most_places=300)
    assert 0 < len(small["known"]) <= 300


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (7, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark)
    assert quality.labelled_sample(docs, labels).count() == 3
    model = quality.fit(quality.labelled_sample(docs, labels), least_docs=1)
    got = quality.score(docs, model)
    assert got.count() == len(DOCS) and got.filter("p_top_grade is null or expected_grade is null").count() == 0
    stay = quality.select(docs, model)
    assert stay.columns == docs.columns and stay.count() == got.filter("kept").count()
    none = quality.fit(quality.labelled_sample(docs, labels.limit(0)))
    assert quality.score(docs, none).filter("kept").count() == len(DOCS)
    assert quality.score(empty(spark), model).count() == 0

"""Token counts of the sections of documents, from one encoding of each whole document.

A document's fields are joined into one text and encoded once. The lengths of the tokens' bytes give the span of
characters that each token covers, and a join of these spans with the spans of the sections, both in order, gives
the section of each token. Sections are the lines of the fields, each with its line break, so that they cover the
text without gaps; the break between two fields belongs to the last section of the first. A token that covers
characters of several sections is allocated by ``rule``:

- ``majority``: to the section with most of its characters, of equals the first (the default);
- ``start``: to the section of its first character;
- ``share``: to each section in proportion to its characters, so that counts are fractions.

A token that holds a part of a character's bytes covers that character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("majority", "start", "share")
#: Rows of a batch that a task returns.
ROWS = 50_000
OUT = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("section", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())])


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """(tiktoken encoding, bytes of each token id) of a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("documents", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token of the text."""
    bpe, lengths = encoding(path, pattern)
    ends = np.cumsum(lengths[np.array(bpe.encode_ordinary(text), dtype=np.int64)])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    if len(ends) and ends[-1] != len(text):  # not ASCII only: from bytes to characters
        at = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        starts, ends = at[starts], at[ends - 1] + 1
    return starts, ends


def section_ends(fields: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(joined text, end of each section in characters, number of sections of each field)."""
    text = "\n".join(fields)
    parts = [f.split("\n") for f in fields]
    n = np.array([len(p) for p in parts])
    ends = np.cumsum([len(x) + 1 for p in parts for x in p])
    ends[-1] -= 1  # no break behind the last
    return text, ends, n


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section by the rule, tokens that touch the section and another one)."""
    first, last = np.searchsorted(sections, starts, side="right"), np.searchsorted(sections, ends - 1, side="right")
    crossing = np.flatnonzero(first != last)
    tokens = np.bincount(first, minlength=len(sections)).astype(np.float64)
    touched = np.zeros(len(sections), np.int64)
    for i in crossing:
        reach = np.arange(first[i], last[i] + 1)
        lows = np.maximum(np.concatenate([[0], sections])[reach], starts[i])
        part = np.minimum(sections[reach], ends[i]) - lows
        touched[reach[part > 0]] += 1
        if rule == "majority":
            tokens[first[i]] -= 1
            tokens[reach[np.argmax(part)]] += 1
        elif rule == "share":
            tokens[first[i]] -= 1
            tokens[reach] += part / part.sum()
    return tokens, touched


def attribution_task(names: Sequence[str], path: str, pattern: str, rule: str):
    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        ids, fields, numbers, chars, tokens, crossing = zip(*held, strict=True)
        sizes = [len(n) for n in numbers]
        return pa.record_batch(
            [
                pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), sizes))),
                pa.array(np.array(names, dtype=object)[np.concatenate(fields)], pa.string()),
                *(pa.array(np.concatenate(x)) for x in (numbers, chars, tokens, crossing)),
            ],
            schema=OUT,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            columns = [batch.column(i + 1) for i in range(len(names))]
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                text, sections, n = section_ends([c[k].as_py() or "" for c in columns])
                starts, ends = token_spans(text, path, pattern)
                tokens, touched = allocate(starts, ends, sections, rule)
                number = np.arange(len(sections)) - np.repeat(np.cumsum(n) - n, n)
                held.append((doc_id, np.repeat(np.arange(len(n)), n), number, np.diff(sections, prepend=0), tokens, touched))
                rows += len(sections)
                if rows >= ROWS:
                    yield batch_of(held)
                    held, rows = [], 0
        if held:
            yield batch_of(held)

    return run


def attribute(docs: DataFrame, fields: Sequence[str], ranks_path: str, pattern: str, rule: str = "majority") -> DataFrame:
    """A row for each section of each row of ``docs``: its field, its number in the field, characters and tokens.

    Null fields are empty, and an empty field has one empty section; a document's counts sum to the tokens of its
    joined text. ``n_crossing`` counts the tokens that a section shares with others. Repeated rows and null ids are
    counted each. Columns other than ``doc_id`` and ``fields`` are not read. Work and memory go with one document
    at a time; nothing is shuffled.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f).cast("string").alias(f"field_{i}") for i, f in enumerate(fields)))
    ddl = "doc_id long, field string, section long, n_chars long, n_tokens double, n_crossing long"
    return picked.mapInArrow(attribution_task(list(fields), ranks_path, pattern, rule), ddl)

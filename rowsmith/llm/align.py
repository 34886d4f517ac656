"""Alignment of two tokenizers over the same texts: groups of tokens between the bytes at which both have a token end.

What two tokenizers make of a range of bytes is a fragment: an open prefix (tokens up to the first byte at which both end),
closed groups, and an open suffix (tokens behind the last such byte). Fragments of ranges that lie side by side compose:
the suffix of the left one and the prefix of the right one are one group. Composing is associative, so that a text's
fragments may be composed in any grouping. A document of more than ``CHUNK`` bytes is cut at multiples of
``CHUNK``, wherever these fall among its tokens; its fragments are made by different tasks and composed by a tree of
shuffles, ``FAN`` neighbours at a time. A shorter document is one fragment.

Within a fragment the text falls into units: a space behind a character that is no white space begins one, as neither
tokenizer has a token that reaches over such a place. Each task encodes a distinct unit once and holds what it has aligned
in a table of bounded size. A unit on an end of the range is encoded by both neighbours, each of which keeps the tokens
that end in its own range; of the cuts that fall into one unit only the first is made, so that no unit is encoded more
than twice. With tokenizers that reach over such places the unit is the whole text.

How often two ids are linked in the corpus is counted from each document's distinct pairs, with a partial sum in each task, stored
as sorted arrays in the shared folder, by shards of bounded size, and looked up in memory-mapped files.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import map_array, put_array, row_key, shared_path, written
from rowsmith.llm.pieces import MARK, falls_into_chunks, processor

#: Bytes of a range of a long document, and fragments that are composed in one step.
CHUNK, FAN = 1 << 16, 16
#: Units, and characters in them, that a task's table holds before it is begun anew.
MOST_UNITS, MOST_CHARS = 300_000, 10_000_000
#: Pairs of ids that a task counts before it sends the sums, and pairs of a stored shard.
MOST_PAIRS, SHARD = 1 << 20, 1 << 20

#: A unit begins with a space behind a character that is no white space (U+180E is, to some tables of characters).
CUT = re.compile(r"(?<=[^\s᠎]) ")
BLANKS = re.compile(r"[\s᠎] ")


# --- the two tokenizers -----------------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = processor(b_path)
        byte_of = _byte_of()
        added = set(self.a.get_added_tokens_decoder())
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [b"" if i in added else bytes(byte_of[c] for c in self.a.id_to_token(i)) for i in range(size)]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.size_b = len(self.b_bytes)
        self.lengths = tuple(np.array(x, np.int64) for x in (self.a_len, self.b_len))
        said = [str(k) for k in range(max(len(self.a_len), self.size_b))]
        self.within, self.behind_a, self.behind_b = (np.array([x + mark for x in said], dtype=object) for mark in ",|;")
        made = json.loads(self.a.to_str())
        before = made["pre_tokenizer"] or {}
        self.cuts = not made["normalizer"] and before.get("type") == "ByteLevel" and bool(before.get("use_regex", True)) and not before.get("add_prefix_space") and falls_into_chunks(b_path)

    def units(self, text: str) -> list[str]:
        """The text's units, each without the space before it."""
        if not self.cuts:
            return [text]
        return CUT.split(text) if text[:1] == " " or BLANKS.search(text) else text.split(" ")

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of A and of B for each unit with a space before it, and whether both have exactly its bytes."""
        if not units:
            return [], [], []
        full = [" " + u for u in units]
        first = [e.ids for e in self.a.encode_batch_fast(full, add_special_tokens=False)]
        second = self.b.encode(units, num_threads=1)
        second = [i or [self.b.piece_to_id(MARK)] for i in second]  # a space by itself
        of_a, of_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        ok = [b"".join(map(of_a, x)) == (raw := u.encode()) == b"".join(map(of_b, y)) for u, x, y in zip(full, first, second, strict=True)]
        return first, second, ok

    def align(self, units: list[str]) -> list[tuple]:
        """For each unit (whether its bytes are kept, groups as text, tokens of A, of B, groups, links): all units at once, as arrays."""
        first, second, ok = self.encode(units)
        fine = [k for k, x in enumerate(ok) if x]
        out: list[tuple] = [(False, "", 0, 0, 0, b"")] * len(units)
        if not fine:
            return out
        n_a, n_b = ([len(side[k]) for k in fine] for side in (first, second))
        a, b = (np.fromiter(chain.from_iterable(side[k] for k in fine), np.int64, sum(n)) for side, n in ((first, n_a), (second, n_b)))
        end_a, end_b = (np.cumsum(lengths[ids]) for lengths, ids in zip(self.lengths, (a, b), strict=True))
        at_b = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at_b] == end_a)  # both end at the end of each unit, so that none is past the last
        last_b = at_b[last_a]
        links = a[last_a] * self.size_b + b[last_b]
        is_last_a, is_last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        is_last_a[last_a], is_last_b[last_b] = True, True
        # A token of A stands behind the tokens of B of the groups before, one of B behind those of A up to its own group.
        of_a, of_b = np.cumsum(is_last_a) - is_last_a, np.cumsum(is_last_b) - is_last_b
        said = np.empty(len(a) + len(b), dtype=object)
        said[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[of_a]] = np.where(is_last_a, self.behind_a[a], self.within[a])
        said[np.arange(len(b)) + (last_a + 1)[of_b]] = np.where(is_last_b, self.behind_b[b], self.within[b])
        said = said.tolist()
        raw = links.astype("<i8").tobytes()
        groups = np.concatenate([[0], np.cumsum(is_last_a)])[np.cumsum(n_a)].tolist()
        at = done = 0
        for k, x, y, g in zip(fine, n_a, n_b, groups, strict=True):
            out[k] = (True, "".join(said[at : at + x + y])[:-1], x, y, g - done, raw[8 * done : 8 * g])
            at, done = at + x + y, g
        return out


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Pair(a_path, b_path)


def common_ends(a: list[int], b: list[int], a_len: list[int], b_len: list[int]) -> list[tuple[int, int, int]]:
    """(tokens of A, tokens of B, byte) up to each byte at which tokens of both end."""
    found, i, j = [], 0, 0
    if not a or not b:
        return found
    x, y = a_len[a[0]], b_len[b[0]]
    while True:
        if x == y:
            i, j = i + 1, j + 1
            found.append((i, j, x))
            if i == len(a) or j == len(b):
                return found
            x, y = x + a_len[a[i]], y + b_len[b[j]]
        elif x < y:
            i += 1
            if i == len(a):
                return found
            x += a_len[a[i]]
        else:
            j += 1
            if j == len(b):
                return found
            y += b_len[b[j]]


# --- fragments ----------------------------------------------------------------------------------------


class Fragment(NamedTuple):
    """What lies in a range of bytes. Without a common end in it (``shut`` false) all its tokens are in the prefix."""

    ok: bool  # the tokens have the text's bytes
    shut: bool
    n_a: int
    n_b: int
    pre_a: tuple
    pre_b: tuple
    text: str  # closed groups
    n: int  # how many
    links: bytes  # the pair of ids at the end of each, as int64
    post_a: tuple
    post_b: tuple


NOTHING = Fragment(True, False, 0, 0, (), (), "", 0, b"", (), ())


def group_text(a, b) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def code(a: int, b: int, size_b: int) -> bytes:
    return (a * size_b + b).to_bytes(8, "little")


def fragment(a: list[int], b: list[int], p: Pair, lo: int = 0, hi: int | None = None, ok: bool = True) -> Fragment:
    """Of tokens that begin at byte 0, what ends behind ``lo`` and up to ``hi``."""
    ends = [e for e in common_ends(a, b, p.a_len, p.b_len) if e[2] > lo and (hi is None or e[2] <= hi)]

    def kept(ids: list[int], lengths: list[int]) -> tuple[int, int]:
        at, first, last = 0, len(ids), len(ids)
        for k, t in enumerate(ids):
            at += lengths[t]
            if at > lo:
                first = min(first, k)
            if hi is not None and at > hi:
                last = k
                break
        return min(first, last), last

    (a0, a1), (b0, b1) = kept(a, p.a_len), kept(b, p.b_len)
    n = (a1 - a0, b1 - b0)
    if not ends:
        return Fragment(ok, False, *n, tuple(a[a0:a1]), tuple(b[b0:b1]), "", 0, b"", (), ())
    texts, links = [], []
    for (i, j, _), (k, m, _) in zip(ends, ends[1:], strict=False):
        texts.append(group_text(a[i:k], b[j:m]))
        links.append(code(a[k - 1], b[m - 1], p.size_b))
    (i, j, _), (k, m, _) = ends[0], ends[-1]
    return Fragment(ok, True, *n, tuple(a[a0:i]), tuple(b[b0:j]), ";".join(texts), len(texts), b"".join(links), tuple(a[k:a1]), tuple(b[m:b1]))


def compose(left: Fragment, right: Fragment, size_b: int) -> Fragment:
    """The fragment of both ranges, which lie side by side; associative, ``NOTHING`` is neutral."""
    if not left.ok or not right.ok:
        return NOTHING._replace(ok=False)
    ok, n_a, n_b = True, left.n_a + right.n_a, left.n_b + right.n_b
    if not left.shut:
        return right._replace(ok=ok, n_a=n_a, n_b=n_b, pre_a=left.pre_a + right.pre_a, pre_b=left.pre_b + right.pre_b)
    if not right.shut:
        return left._replace(ok=ok, n_a=n_a, n_b=n_b, post_a=left.post_a + right.pre_a, post_b=left.post_b + right.pre_b)
    a, b = left.post_a + right.pre_a, left.post_b + right.pre_b
    text = ";".join(x for x in (left.text, group_text(a, b), right.text) if x)
    return Fragment(ok, True, n_a, n_b, left.pre_a, left.pre_b, text, left.n + 1 + right.n, left.links + code(a[-1], b[-1], size_b) + right.links, right.post_a, right.post_b)


def finished(whole: Fragment, size_b: int) -> tuple[int, int, int, str, bytes]:
    """(tokens of A, of B, groups, groups as text, links) of a whole text's fragment: its prefix is the first group."""
    if not whole.ok or not whole.shut:
        return 0, 0, 0, "", b""
    text = ";".join(x for x in (group_text(whole.pre_a, whole.pre_b), whole.text) if x)
    return whole.n_a, whole.n_b, whole.n + 1, text, code(whole.pre_a[-1], whole.pre_b[-1], size_b) + whole.links


class Units(dict):
    """Unit to (whether its bytes are kept, closed groups as text, tokens of A, of B, groups, links)."""

    def __init__(self, p: Pair):
        self.pair, self.chars = p, 0

    def learn(self, units: set[str]) -> None:
        """Align the units that the table lacks; a table that has grown too long is begun anew."""
        new = [u for u in units if u not in self]
        if len(self) + len(new) > MOST_UNITS or self.chars > MOST_CHARS:
            self.clear()
            self.chars, new = 0, list(units)
        self.chars += sum(map(len, new))
        self.update(zip(new, self.pair.align(new), strict=True))

    def runs(self, cut: list[list[str]]) -> Iterator[tuple]:
        """Of each run of whole units, what the table has of one: its groups are the groups of its units."""
        self.learn({u for units in cut for u in units})
        for units in cut:
            if not units:
                yield True, "", 0, 0, 0, b""
                continue
            ok, said, n_a, n_b, n, links = zip(*map(self.__getitem__, units), strict=True)
            yield (True, ";".join(said), sum(n_a), sum(n_b), sum(n), b"".join(links)) if all(ok) else (False, "", 0, 0, 0, b"")

    def fragments(self, texts: list[str], ranges: list[tuple[int, int | None]]) -> Iterator[Fragment]:
        """Of each text of whole units, with a space before it, the fragment of its bytes behind ``lo`` and up to ``hi``."""
        cut = [self.pair.units(t) for t in texts]
        first, second, ok = self.pair.encode([u for units in cut for u in ((units[0], units[-1]) if len(units) > 1 else units)])
        at = 0
        for units, text, (lo, hi), inner in zip(cut, texts, ranges, self.runs([units[1:-1] for units in cut]), strict=True):
            out = fragment(first[at], second[at], self.pair, lo, hi, ok[at])
            at += 1
            if len(units) > 1:
                if inner[4] or not inner[0]:  # the first unit ends in the range, so that whole groups follow it
                    fine, said, n_a, n_b, n, links = inner
                    out = out._replace(ok=out.ok and fine, n_a=out.n_a + n_a, n_b=out.n_b + n_b, text=";".join(x for x in (out.text, said) if x), n=out.n + n, links=out.links + links)
                behind = None if hi is None else hi - len(text.encode()) + len(units[-1].encode())
                out = compose(out, fragment(first[at], second[at], self.pair, 0, behind, ok[at]), self.pair.size_b)
                at += 1
            yield out


# --- tasks ---------------------------------------------------------------------------------------------

ROWS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
ROWS_DDL = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary"
PARTS = pa.schema([("uid", pa.binary()), ("seq", pa.int64()), ("ok", pa.bool_()), ("shut", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("pre_a", pa.binary()), ("pre_b", pa.binary()), ("text", pa.string()), ("n", pa.int64()), ("links", pa.binary()), ("post_a", pa.binary()), ("post_b", pa.binary())])
PARTS_DDL = "uid binary, seq long, ok boolean, shut boolean, n_a long, n_b long, pre_a binary, pre_b binary, text string, n long, links binary, post_a binary, post_b binary"


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: of sorted numbers, long equal runs."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).view(kind).ravel()


def row_of(doc_id: int | None, n_a: int, n_b: int, n: int, text: str, links: bytes) -> tuple:
    pairs, times = np.unique(np.frombuffer(links, np.int64), return_counts=True)
    return doc_id, n_a, n_b, n, hashlib.sha256(text.encode()).hexdigest() if n else "", planes(pairs), planes(times.astype(np.int32))


def runs_of(batch: pa.RecordBatch, column: str, chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    run, held, at = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        run.append(t.as_py() or "")
        held += len(run[-1])
        if held >= chars:
            yield at, run
            run, held, at = [], 0, i + 1
    if run:
        yield at, run


def whole_task(a_path: str, b_path: str):
    """mapInArrow: documents of one fragment each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        units = Units(p)
        for batch in batches:
            for at, texts in runs_of(batch, "text"):
                ids = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                found = units.runs([p.units(t) if t else [] for t in texts])
                rows = [row_of(i, n_a, n_b, n, said, links) for i, (_, said, n_a, n_b, n, links) in zip(ids, found, strict=True)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)

    return run


CUTS = pa.schema([("uid", pa.binary()), ("seq", pa.int64()), ("part", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())])


def cuts_of(text: str, p: Pair, chunk: int) -> list[tuple[str, int, int]]:
    """(whole units without the first space, lo, hi) of the text's ranges of ``chunk`` bytes, bytes counted from the space before these units."""
    units = p.units(text)
    begins = np.cumsum([0, *(len(u.encode()) + 1 for u in units)])  # of the text with a space before it
    marks = np.arange(chunk, begins[-1], chunk)
    unit = np.searchsorted(begins, marks, side="left") - 1  # the one with begin < mark <= end
    marks = marks[np.flatnonzero(np.diff(unit, prepend=-1))]
    edges = [0, *marks.tolist(), int(begins[-1])]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        first = int(np.searchsorted(begins, lo, side="right")) - 1  # begin <= lo < end
        last = int(np.searchsorted(begins, hi, side="left")) - 1
        out.append((" ".join(units[first : last + 1]), lo - int(begins[first]), hi - int(begins[first])))
    return out


def cut_task(a_path: str, b_path: str, chunk: int):
    """mapInArrow: long texts to ranges with the whole units that they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        for batch in batches:
            for uid, text in zip(batch.column("uid"), batch.column("text"), strict=True):
                parts = cuts_of(text.as_py(), p, chunk)
                for at in range(0, len(parts), 64):
                    own = parts[at : at + 64]
                    texts, lo, hi = zip(*own, strict=True)
                    yield pa.record_batch([pa.array([uid.as_py()] * len(own), pa.binary()), pa.array(range(at, at + len(own)), pa.int64()), pa.array(texts, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], schema=CUTS)

    return run


def as_rows(keys: list[tuple], parts: list[Fragment]) -> pa.RecordBatch:
    packed = [x._replace(**{c: np.array(getattr(x, c), np.int32).tobytes() for c in ("pre_a", "pre_b", "post_a", "post_b")}) for x in parts]
    columns = [*zip(*keys, strict=True), *zip(*packed, strict=True)]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PARTS, strict=True)], schema=PARTS)


def from_row(row: dict) -> Fragment:
    return Fragment(**{k: tuple(np.frombuffer(row[k], np.int32).tolist()) if k in ("pre_a", "pre_b", "post_a", "post_b") else row[k] for k in Fragment._fields})


def part_task(a_path: str, b_path: str):
    """mapInArrow: ranges to fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        units = Units(p)
        for batch in batches:
            lo, hi = batch.column("lo").to_pylist(), batch.column("hi").to_pylist()
            for at, texts in runs_of(batch, "part"):
                own = slice(at, at + len(texts))
                keys = list(zip(batch.column("uid").slice(at, len(texts)).to_pylist(), batch.column("seq").slice(at, len(texts)).to_pylist(), strict=True))
                yield as_rows(keys, list(units.fragments(texts, list(zip(lo[own], hi[own], strict=True)))))

    return run


def compose_task(size_b: int):
    """applyInArrow: a run of neighbours to one fragment."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [from_row(r) for r in table.sort_by("seq").to_pylist()]
        whole = reduce(lambda x, y: compose(x, y, size_b), parts)
        return pa.Table.from_batches([as_rows([(key[0].as_py(), key[1].as_py())], [whole])])

    return run


def finish_task(size_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                n_a, n_b, n, text, links = finished(from_row(row), size_b)
                made = row_of(row["doc_id"], n_a, n_b, n, text, links)
                for _ in range(row["copies"]):
                    yield pa.record_batch([pa.array([c], f.type) for c, f in zip(made, ROWS, strict=True)], schema=ROWS)

    return run


def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: documents' pairs to (pair, n), summed within the task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, kept = 0, 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pairs, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)

    def sent(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(pairs), 1 << 17):
            yield pa.record_batch([pa.array(pairs[k : k + (1 << 17)]), pa.array(n[k : k + (1 << 17)])], names=["pair", "n"])

    for batch in batches:
        for x, n in zip(batch.column("pairs"), batch.column("times"), strict=True):
            held.append((from_planes(x.as_py(), np.int64), from_planes(n.as_py(), np.int32)))
            size += len(held[-1][0])
            if size - kept > 2 * MOST_PAIRS:
                held = [merged()]
                kept = size = len(held[0][0])
                if size > MOST_PAIRS:
                    yield from sent(*held[0])
                    held, kept, size = [], 0, 0
    if held:
        yield from sent(*merged())


def store_task(uri: str):
    """applyInArrow of one shard: its pairs in order, how often each is linked, and whether that is most for its id of B."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pairs = table.column("pair").to_numpy()
        order = np.argsort(pairs)
        at = f"{uri}/{key[0].as_py()}"
        put_array(f"{at}-pair.npy", pairs[order])
        put_array(f"{at}-n.npy", table.column("n").to_numpy()[order])
        put_array(f"{at}-best.npy", table.column("best").to_numpy(zero_copy_only=False)[order])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "held": pa.array([len(order)], pa.int64())})

    return run


OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def look_up_task(uri: str, shards: int):
    """mapInArrow: documents' pairs to sums of the corpus's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, tuple] = {}

        def counts(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
            shard = pairs % shards
            for s in np.unique(shard).tolist():
                if s not in opened:
                    opened[s] = tuple(map_array(f"{uri}/{s}-{x}.npy") for x in ("pair", "n", "best"))
                keys, all_n, all_best = opened[s]
                own = np.flatnonzero(shard == s)
                at = np.searchsorted(keys, pairs[own])
                n[own], best[own] = all_n[at], all_best[at]
            return n, best

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = batch.slice(at, 512)
                pairs = [from_planes(x.as_py(), np.int64) for x in own.column("pairs")]
                times = [from_planes(x.as_py(), np.int32) for x in own.column("times")]
                distinct, where = np.unique(np.concatenate(pairs), return_inverse=True)
                n, best = counts(distinct)
                n, best, t = n[where], best[where], np.concatenate(times).astype(np.int64)
                bounds = np.cumsum([0, *map(len, pairs)])
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])  # noqa: B023, E731
                yield pa.record_batch([*(own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), pa.array(total(t)), pa.array(total(t * best)), pa.array(total(t * n)), own.column("groups_sha256")], schema=OUT)

    return run


def align(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """A row for each row of ``docs``: tokens, groups and links of two tokenizers, and sums of the corpus's counts of links.

    A (``a_path``, a byte-level tokenizer's JSON) sees a space and the text, B (``b_path``, a SentencePiece model that adds
    this space) the text. Links are pairs of tokens that end at the same byte, one for each group; an id pair's count is
    the number of links in the corpus that hold it. ``n_best`` counts the links whose pair is linked as often as any other of the same B id,
    ties included; ``count_sum`` sums the counts over the links. ``groups_sha256`` is the digest of the groups as
    `a1,a2|b1;a3|b2,b3`. Texts that are null, empty or not given back byte by byte (U+2581 becomes a space) have zeros
    and an empty digest. Repeated rows and null ids count each; columns other than ``doc_id`` and ``text`` are not read.
    No task holds more than a batch and, at the root of the tree, what one document gives.
    """
    spark = docs.sparkSession
    size_b = pair(a_path, b_path).size_b
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    out = rows.filter(~long).mapInArrow(whole_task(a_path, b_path), ROWS_DDL)

    longs = rows.filter(long).withColumn("uid", row_key(F.col("doc_id"), F.col("text"))).groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    longs = written(longs, "long")
    ranges = longs.select("uid", "text").mapInArrow(cut_task(a_path, b_path, chunk), "uid binary, seq long, part string, lo long, hi long")
    parts = written(ranges.repartition("uid", "seq").mapInArrow(part_task(a_path, b_path), PARTS_DDL), "fragments")
    most = parts.agg(F.max("seq")).first()[0]
    if most is not None:
        while most > 0:
            near = parts.withColumn("at", F.expr(f"seq div {FAN}"))
            parts = written(near.groupBy("uid", "at").applyInArrow(compose_task(size_b), PARTS_DDL), "fragments")
            most //= FAN
        out = out.union(parts.join(longs.select("uid", "doc_id", "copies"), "uid").mapInArrow(finish_task(size_b), ROWS_DDL))
    out = written(out, "aligned")

    sums = out.select("pairs", "times").mapInArrow(count_task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    sums = written(sums.withColumn("b", F.col("pair") % size_b), "pairs")
    most_of = written(sums.groupBy("b").agg(F.max("n").alias("most")), "best")  # a row for each id of B
    shards = max(1, -(-sums.count() // SHARD))
    uri = shared_path(spark, "counts")
    counted = sums.join(most_of, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), (F.col("pair") % shards).alias("shard"))
    counted.groupBy("shard").applyInArrow(store_task(uri), "shard long, held long").agg(F.sum("held")).collect()
    return out.mapInArrow(look_up_task(uri, shards), OUT_DDL)

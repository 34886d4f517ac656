"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model has a white-space marker behind another character, a text falls into chunks, each a run of
markers and the characters up to the next marker, and merges never cross from one chunk into the next. First each task
sends its distinct words, a list for each shard of hashes; a shard's task segments each word that more than one task has
once and stores ids and text as sorted hash arrays in the shared folder. Then the texts' tasks map the arrays and join
ids back by position; what no other task has, and chunks of several markers, a task segments itself, once. A
task's own table of looked-up chunks has a bounded size and is begun anew at its bound, from the arrays. With a model
that has other pieces or normalises text, a chunk is a whole text and there is no table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import U64, map_array, put_array, released, shared_path, text_bytes, tidy, words_of

MARK = "\u2581"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks, and characters in them, that a task's table holds before it is begun anew.
MOST_CHUNKS, MOST_CHARS = 200_000, 20_000_000

OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
FULL = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


@lru_cache(maxsize=4)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def falls_into_chunks(path: str) -> bool:
    """Whether the model neither changes text nor has a piece that reaches over a marker."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    free = all(p.type != p.USER_DEFINED and MARK not in p.piece.lstrip(MARK) for p in model.pieces)
    return plain and free and model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix


#: For ``words_of``: every byte counts, none separates.
EVERY = np.arange(1, 257, dtype=U64)


def word_hashes(words: pa.Array) -> np.ndarray:
    data, bounds = text_bytes(words)
    return words_of(data, bounds, EVERY)[0]


def distinct_task(shards: int):
    """mapInArrow: texts to a list of distinct words for each shard; words over ``MOST_CHARS`` characters in all, in parts."""

    def flush(words: set[str]) -> pa.RecordBatch:
        column = pa.array(sorted(words), pa.string())
        shard = word_hashes(column) % U64(shards)
        order = np.argsort(shard, kind="stable")
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(shard[order], np.arange(shards + 1)).astype(np.int32)), column.take(pa.array(order)))
        words.clear()
        return pa.record_batch([pa.array(np.arange(shards, dtype=np.int32)), lists], names=["shard", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[str] = set()
        chars = 0  # of the texts since the words were sent: no fewer than the words have
        for batch in batches:
            for _, texts in _texts(batch):
                for t in texts:
                    words.update(t.split(" "))
                    chars += len(t)
                words.discard("")
                if len(words) > MOST_CHUNKS or chars > MOST_CHARS and sum(map(len, words)) > MOST_CHARS:
                    yield flush(words)
                    chars = 0
        if words:
            yield flush(words)

    return run


def store_task(path: str, uri: str):
    """applyInArrow of one shard: words of more than one list, segmented once and stored by hash."""

    def put(name: str, texts: list[bytes]) -> None:
        put_array(f"{name}-bytes.npy", np.frombuffer(b"".join(texts), np.uint8))
        put_array(f"{name}-ends.npy", np.cumsum([0, *map(len, texts)], dtype=np.int64))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        counts = pa.compute.value_counts(pa.chunked_array([c.flatten() for c in table.column("words").chunks]))
        words = counts.field("values").filter(pa.compute.and_(pa.compute.greater(counts.field("counts"), 1), pa.compute.invert(pa.compute.match_substring(counts.field("values"), MARK))))
        h = word_hashes(words)
        order = np.argsort(h, kind="stable")
        plain = words.take(pa.array(order)).to_pylist()
        sp = processor(path)
        ids = sp.encode(plain, num_threads=1) if plain else []
        at = f"{uri}/{key[0].as_py()}"
        put_array(f"{at}-key.npy", h[order])
        put(f"{at}-word", [w.encode() for w in plain])
        put(f"{at}-ids", [" ".join(map(str, i)).encode() for i in ids])
        put(f"{at}-text", [t.encode() for t in (sp.decode(ids) if ids else [])])
        n = len(plain)
        del counts, words, h, order, plain, ids
        released()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64())})

    return run


def build(docs: DataFrame, model_path: str, shards: int | None = None) -> dict | None:
    """The stored table of the words that several tasks have; None for a model whose texts don't fall into chunks."""
    if not falls_into_chunks(model_path):
        return None
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = shared_path(spark, "pieces")
    lists = _input(docs).select("text").mapInArrow(tidy(distinct_task(shards)), "shard int, words array<string>")
    stored = lists.groupBy("shard").applyInArrow(store_task(model_path, uri), "shard int, n long").collect()  # a short row for each shard
    return {"uri": uri, "shards": shards, "stored": {r.shard for r in stored if r.n}}


class Stored:
    """Looks words up in the stored table."""

    def __init__(self, table: dict):
        self.table, self.opened = table, {}

    def _open(self, shard: int) -> tuple:
        if shard not in self.opened:
            at = f"{self.table['uri']}/{shard}"
            column = lambda name: self._column(map_array(f"{at}-{name}-ends.npy"), map_array(f"{at}-{name}-bytes.npy"))
            self.opened[shard] = (map_array(f"{at}-key.npy"), column("word"), column("ids"), column("text"))
        return self.opened[shard]

    @staticmethod
    def _column(ends: np.ndarray, data: np.ndarray) -> pa.Array:
        return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))

    def look_up(self, words: list[str]) -> dict[str, tuple[str, str]]:
        """Word to (ids as text, decoded text), for those that are there; the words' own bytes decide."""
        column = pa.array(words, pa.string())
        h, out = word_hashes(column), {}
        shard = (h % U64(self.table["shards"])).astype(np.int64)
        for s in np.unique(shard).tolist():
            if s in self.table["stored"]:
                keys, *columns = self._open(s)
                own = np.flatnonzero(shard == s)
                at = np.searchsorted(keys, h[own])
                hit = keys[np.minimum(at, len(keys) - 1)] == h[own]
                found = zip(*(c.take(pa.array(at[hit])).to_pylist() for c in columns), strict=True)
                out.update((w, (ids, text)) for k, (w, ids, text) in zip(own[hit].tolist(), found, strict=True) if w == words[k])
        return out


class ChunkTable(dict):
    """Chunk to (number of ids, ids as text, decoded text with its leading space)."""

    def __init__(self, path: str, table: dict | None = None):
        self.sp, self.chunked, self.chars = processor(path), falls_into_chunks(path), 0
        self.end = self.sp.eos_id()
        self.stored = Stored(table) if table else None

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        return CHUNK.findall(MARK + text.replace(" ", MARK)) if self.chunked else [MARK + text]

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks that the table lacks; a table that has grown too long is begun anew."""
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > MOST_CHUNKS or self.chars > MOST_CHARS:
            self.clear()
            self.chars, new = 0, list(chunks)
        self.chars += sum(map(len, new))
        if self.stored:
            found = self.stored.look_up([c[1:] for c in new if len(c) > 1 and c[1] != MARK])
            for word, (ids, text) in found.items():
                self[MARK + word] = (ids.count(" ") + 1, ids, " " + text)
            new = [c for c in new if c not in self]
        plain = [c[1:].replace(MARK, " ") if self.chunked else c[1:] for c in new]
        ids = self.sp.encode(plain, num_threads=1)
        ids = [i or [self.sp.piece_to_id(MARK)] for i in ids]  # a marker by itself
        for c, i, text in zip(new, ids, self.sp.decode(ids), strict=True):
            self[c] = (len(i), " ".join(map(str, i)), " " + text)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text, the number of its ids with the end id, the ids as text, and the text that they decode to."""
        rows = [self.cut(t) for t in texts]
        self.learn({c for row in rows for c in row})
        for row in rows:
            n, ids, text = zip(*map(self.__getitem__, row), strict=True) if row else ((), (), ())
            yield sum(n) + 1, " ".join((*ids, str(self.end))), "".join(text)[1:]


def _texts(batch: pa.RecordBatch, chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about a million characters, with the first row of each."""
    run, held, at = [], 0, 0
    for i, t in enumerate(batch.column("text").to_pylist()):
        run.append(t or "")
        held += len(run[-1])
        if held >= chars:
            yield at, run
            run, held, at = [], 0, i + 1
    if run:
        yield at, run


def digest_task(path: str, stored: dict | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path, stored)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for at, texts in _texts(batch):
                n, ids, decoded = zip(*((n, sha(i), sha(t)) for n, i, t in table.encode(texts)), strict=True)
                yield pa.record_batch([batch.column("doc_id").slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], schema=OUT)

    return run


def full_task(path: str, stored: dict | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path, stored)
        for batch in batches:
            for at, texts in _texts(batch):
                rows = [([int(x) for x in i.split()], t) for _, i, t in table.encode(texts)]
                yield pa.record_batch([batch.column("doc_id").slice(at, len(texts)), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())], schema=FULL)

    return run


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids with the end id, decoded text) of every row's whole text.

    One row per row, repeated rows and null ids included; a null text is empty and has the end id only. Other
    columns are not read. ``model_path`` must be there on every executor, as installed packages are.
    """
    return _input(docs).mapInArrow(tidy(full_task(model_path, build(docs, model_path))), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """As ``encode``, with the SHA-256 of the ids (decimal, one space between) and of the decoded text."""
    return _input(docs).mapInArrow(tidy(digest_task(model_path, build(docs, model_path))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

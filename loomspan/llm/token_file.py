"""Token ids in fixed-width bit-packed files.

A file is the image of one run of documents: a header, the document table,
the offset of every block, and the payload. A block packs ``BLOCK`` ids in the
fewest bits that hold the vocabulary, most significant bit first, and begins at
a byte bound, so numpy unpacks any block alone. A data set is a Parquet folder
with one image to a row, which any store that Spark writes can hold and whose
writes Spark's committer makes safe against lost executors; ``Image`` reads the
bytes of one row or of the same bytes in a plain file.

    "BPK1" | bits u32 | block u32 | docs u32 | ids u64 | first u64
    doc_id i64[docs] | known u8[docs] | offset u64[docs + 1]
    block offset u64[blocks + 1] | payload

``first`` counts the ids of the same part that come before the image.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import scratch

BLOCK = 4096
HEAD = struct.Struct("<4sIIIQQ")
MAGIC = b"BPK1"
CUT = re.compile(r"(?<=\S) (?=\S)")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits each, padded to a byte."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    wide = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(raw, ">u2", n).astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def image(doc_ids: list, texts: list[np.ndarray], bits: int, first: int = 0) -> bytes:
    """The file of some documents: their ids (a None counts as unknown) and their token arrays."""
    flat = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    ends = np.cumsum([0, *map(len, texts)], dtype="<u8")
    blocks = [pack(flat[i : i + BLOCK], bits) for i in range(0, len(flat), BLOCK)]
    at = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    known = np.array([d is not None for d in doc_ids], dtype="u1")
    return b"".join([HEAD.pack(MAGIC, bits, BLOCK, len(texts), len(flat), first), names.tobytes(), known.tobytes(), ends.tobytes(), at.tobytes(), *blocks])


class Image:
    """Random access to the documents of one image."""

    def __init__(self, raw: bytes) -> None:
        magic, self.bits, self.block, n, self.ids, self.first = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a bit-packed token file")
        self.raw, at = memoryview(raw), HEAD.size
        names = np.frombuffer(raw, "<i8", n, at)
        known = np.frombuffer(raw, "u1", n, at := at + 8 * n)
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known, strict=True)]
        self.offsets = np.frombuffer(raw, "<u8", n + 1, at := at + n).astype(np.int64)
        count = -(-self.ids // self.block)
        self.blocks = np.frombuffer(raw, "<u8", count + 1, at := at + 8 * (n + 1)).astype(np.int64)
        self.payload = at + 8 * (count + 1)

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids at positions start to end; only their blocks are unpacked."""
        if end <= start:
            return np.zeros(0, np.uint32)
        low, high = start // self.block, (end - 1) // self.block
        parts = [unpack(self.raw[self.payload + self.blocks[b] : self.payload + self.blocks[b + 1]], self.bits, min(self.block, self.ids - b * self.block)) for b in range(low, high + 1)]
        return np.concatenate(parts)[start - low * self.block : end - low * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.offsets[k]), int(self.offsets[k + 1]))


def cuts_hold(path: str) -> bool:
    """Whether a tokenizer file has the pattern on which WordCache relies."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    added = spec.get("added_tokens") or []
    quiet = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"[\s,.]", t["content"]) for t in added)
    return bool(plain and quiet and spec.get("normalizer") is None and not spec.get("truncation"))


class WordCache:
    """Encodes whole texts with a byte-level tokenizer, remembering its words.

    The tokenizer's pattern never lets a token hold a space or a line feed
    after other characters, nor a letter together with a comma or full stop. So
    a cut before a single space between words, on either side of a single line
    feed between words, and between a letter and a last comma or full stop
    leaves every token whole. The library encodes each part once; the two
    newest generations of ``limit`` parts are kept. All this holds for the
    byte-level pattern without a normaliser; with any other tokenizer file whole
    texts go to the library.
    """

    def __init__(self, path: str, limit: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_part = cuts_hold(path)
        self.limit = limit
        self.parts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        words = text.split()
        spaced = "\0" not in text and len(" ".join(words)) == len(text)
        if spaced and text.count(" ") + text.count("\n") == len(words) - 1:  # every gap is one space or line feed
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        first, *rest = CUT.split(text)
        return [first, *[" " + p for p in rest]]

    def _learn(self, parts: set[str]) -> None:
        known, old = self.parts, self.old
        tails = {p for p in parts if len(p) > 1 and p[-1] in ",." and p[-2].isalpha()}
        need = set()
        for p in {p[:-1] if p in tails else p for p in parts} | {",", "."}:
            if p in old:
                known[p] = old[p]
            elif p not in known:
                need.add(p)
        need = list(need)
        for i in range(0, len(need), 4096):
            some = need[i : i + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[p] = array("I", e.ids).tobytes()
        known.update((p, known[p[:-1]] + known[p[-1]]) for p in tails)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_part:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cuts = [self.cut(t) if t else [] for t in texts]
        if len(self.parts) > self.limit:
            self.old, self.parts = self.parts, {}
        self._learn(set().union(*cuts).difference(self.parts))
        get = self.parts.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), "<u4") for c in cuts]


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """The worker's cache for a tokenizer; it outlives a task."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, vocabulary: int | None = None, text: str = "text", key: str = "doc_id", parts: int | None = None, ids_a_file: int = 1 << 20) -> None:
    """Encode every whole text, append end_id, and write the images in ascending key order.

    Range partitioning by key gives the global order; within a part the rows
    are sorted and streamed, so a task holds one image and not its part. Rows
    of one key are ordered by text. A null text is the empty text; a null key
    sorts first; keys are whole numbers (others fail the cast); extra columns
    are ignored; an empty table writes no image.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer_path)
        bits = bits_for(vocabulary or max(cache.tokenizer.get_vocab_size(), (end_id or 0) + 1))
        tail = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        names: list = []
        held: list[np.ndarray] = []
        part, number, first, size = TaskContext.get().partitionId(), 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([image(names, held, bits, first)], pa.binary())], names=["part", "number", "n_ids", "image"])

        for b in it:
            for i in range(0, b.num_rows, 256):
                piece = b.slice(i, 256)
                for name, ids in zip(piece.column(0).to_pylist(), cache.encode([t or "" for t in piece.column(1).to_pylist()]), strict=True):
                    names.append(name)
                    held.append(np.concatenate([ids, tail]))
                    size += len(held[-1])
                    if size >= ids_a_file:
                        yield row()
                        names, held, number, first, size = [], [], number + 1, first + size, 0
        if names:
            yield row()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    rows.mapInArrow(batches, "part int, number int, n_ids long, image binary").write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark, path: str, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document in the images under path.

    start counts the ids of all documents before it. Images know what comes
    before them in their part; only the parts' totals meet, one row a part.
    """
    files = spark.read.schema("part int, number int, n_ids long, image binary").parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row for each part
    base, starts = 0, {}
    for r in sorted(totals):
        starts[r.part] = base
        base += r.n
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = Image(raw.as_py())
                tokens = [x.document(k) for k in range(len(x.doc_ids))]
                cols = [
                    pa.array(x.doc_ids, pa.int64()),
                    pa.array(x.offsets[:-1] + (x.first + starts[part])),
                    pa.array(np.diff(x.offsets)),
                    pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64()),
                ]
                yield pa.record_batch(cols + [pa.array([t.astype(np.int32) for t in tokens], pa.list_(pa.int32()))] * ids, names=[key, "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    return files.select("part", "image").mapInArrow(batches, schema)


def op2_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path)

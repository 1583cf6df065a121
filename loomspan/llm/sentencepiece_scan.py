"""SentencePiece encoding and decoding with a max-plus parallel scan.

A text's best segmentation is a longest path, so a stretch of it is a linear
map in the max-plus semiring. A giant document is cut into chunks. The state at
a boundary is how far the piece that crosses it reaches; a chunk's transfer
matrix gives the best score from each entry state to each exit state. The
matrices combine associatively, which yields the scores of the states at every
boundary; each chunk then tells which entry state each exit state comes from,
these small maps compose from the end, and every chunk is backtraced on its
own. Documents of one chunk need no boundary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.piece_model import LOWEST, PieceModel, model as loaded
from loomspan.llm.textops import lean
from loomspan.session import written

CHUNK = 16_384


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), LOWEST)


def _narrow(m: PieceModel, s: str, n: int) -> tuple[int, list[str], int] | None:
    """(head, units, tail) of a chunk: all paths pass the unit bounds head and tail and take the units between them; None if there are no two such bounds.

    Entry states lie before head; the last unit, from tail, may go on beyond n.
    """
    if not m.by_word:
        return None
    units = m.units(s[:n])
    head = k = 0
    while k < len(units) and head < m.longest - 1:
        head += len(units[k])
        k += 1
    if k >= len(units) - 1:
        return None
    m.remember(set(units[k:-1]))
    return head, units[k:-1], n - len(units[-1])


def transfer(m: PieceModel, s: str, n: int) -> np.ndarray:
    """The matrix of a chunk of n characters; s holds what pieces may reach beyond it too."""
    size = m.longest
    out = np.full((size, size), LOWEST, np.int64)
    if (bounds := _narrow(m, s, n)) is not None:
        head, units, tail = bounds
        middle = m.units_score(units)
        best, _, _ = m.lattice(s[tail:], n - tail, {0: 0})
        right = np.array((best[n - tail :] + [LOWEST] * size)[:size])
        for i in range(min(size, head + 1)):
            left = m.lattice(s[:head], head, {i: 0})[0][head]
            if left > LOWEST:
                out[i] = np.where(right > LOWEST, left + middle + right, LOWEST)
        return out
    for i in range(size):
        if i <= len(s):
            best, _, _ = m.lattice(s, n, {i: 0})
            out[i] = (best[n:] + [LOWEST] * size)[:size]
    return out


def prefix_states(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Scores of the entry states of each chunk: row 0 of the products of all matrices before it, by a two-sweep scan."""
    n = len(matrices)
    if n == 1:
        start = np.full(len(matrices[0]), LOWEST, np.int64)
        start[0] = 0
        return [start]
    pairs = [product(matrices[i], matrices[i + 1]) if i + 1 < n else matrices[i] for i in range(0, n, 2)]
    out: list[np.ndarray] = []
    for k, v in enumerate(prefix_states(pairs)):
        out.append(v)
        if 2 * k + 1 < n:
            out.append(np.maximum((v[:, None] + matrices[2 * k]).max(axis=0), LOWEST))
    return out


def _local(m: PieceModel, s: str, n: int, states: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    return m.lattice(s, n, {i: int(v) for i, v in enumerate(states) if v > LOWEST})


def entry_map(m: PieceModel, s: str, n: int, states: np.ndarray) -> list[int]:
    """For each exit state the entry state of its best path; -1 where none leads."""
    if (bounds := _narrow(m, s, n)) is not None:
        head, _, tail = bounds
        _, start, piece = _local(m, s[:head], head, states)
        entry = m.trace(s, start, piece, head)[1]
        best, _, _ = m.lattice(s[tail:], n - tail, {0: 0})
        return [entry if n - tail + j < len(best) and best[n - tail + j] > LOWEST else -1 for j in range(m.longest)]
    best, start, piece = _local(m, s, n, states)
    return [m.trace(s, start, piece, n + j)[1] if n + j < len(best) and best[n + j] > LOWEST else -1 for j in range(m.longest)]


def chunk_ids(m: PieceModel, s: str, n: int, states: np.ndarray, leave: int) -> bytes:
    """The ids of the pieces that start in the chunk on the best path to exit state leave."""
    pack = lambda ids: np.array(ids, "<u4").tobytes()
    if (bounds := _narrow(m, s, n)) is not None:
        head, units, tail = bounds
        _, start, piece = _local(m, s[:head], head, states)
        left = m.trace(s, start, piece, head)[0]
        _, start, piece = m.lattice(s[tail:], n - tail, {0: 0})
        right = m.trace(s[tail:], start, piece, n - tail + leave)[0]
        return pack(left) + b"".join([m.unit(u) for u in units]) + pack(right)
    _, start, piece = _local(m, s, n, states)
    return pack(m.trace(s, start, piece, n + leave)[0])


def scan_encode(m: PieceModel, text: str, chunk: int) -> bytes:
    """Encode one text by the scan alone (the same steps as the distributed form)."""
    s = m.normalize(text)
    if not s:
        return b""
    parts = [(s[i : i + chunk + m.longest - 1], min(chunk, len(s) - i)) for i in range(0, len(s), chunk)]
    states = prefix_states([transfer(m, p, n) for p, n in parts])
    leave, out = 0, []
    for (p, n), v in reversed(list(zip(parts, states, strict=True))):
        out.append(chunk_ids(m, p, n, v, leave))
        leave = entry_map(m, p, n, v)[leave]
    return m.merged(b"".join(reversed(out)))


#: What encode() returns beside the key, and what summary() does.
IDS = "ids binary"
DIGEST = "n_pieces long, ids array<int>, n_chars long, text_crc32 long"


def _ids_batch(m: PieceModel, keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([keys, pa.array(ids, pa.binary())], names=["key", "ids"])


def _digest_batch(m: PieceModel, keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    ids = [np.frombuffer(x, "<u4") for x in ids]
    texts = [m.decode(x.tolist()) for x in ids]
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)))
    cols = [keys, pa.array(list(map(len, ids)), pa.int64()), lists, pa.array(list(map(len, texts)), pa.int64()), pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64())]
    return pa.record_batch(cols, names=["key", "n_pieces", "ids", "n_chars", "text_crc32"])


def _giants(docs: DataFrame, model, chunk: int, kind: str, parts: int, finish, shape: str) -> DataFrame:
    """The rows of documents longer than a chunk, as finish makes them."""

    @lean
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = model(), 0
        uid = TaskContext.get().partitionId() << 40
        for b in it:
            for i, text in enumerate(b.column(1).to_pylist()):
                s = m.normalize(text)
                row += 1
                for k in range(0, len(s), chunk):
                    yield pa.record_batch([pa.array([uid + row], pa.int64()), b.column(0).slice(i, 1), pa.array([k // chunk], pa.int32()), pa.array([min(chunk, len(s) - k)], pa.int32()), pa.array([s[k : k + chunk + m.longest - 1]], pa.string())], names=["uid", "key", "k", "n", "s"])

    @lean
    def matrices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in it:
            raw = [transfer(m, s, n).tobytes() for s, n in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["uid", "k", "matrix"])

    def scanned(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        size = model().longest
        states = prefix_states([np.frombuffer(x, np.int64).reshape(size, size) for x in t.column("matrix").to_pylist()])
        return pa.table({"uid": t.column("uid"), "k": t.column("k"), "states": pa.array([v.tobytes() for v in states], pa.binary())})

    @lean
    def maps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in it:
            rows = zip(*[b.column(i).to_pylist() for i in (2, 3, 4)], strict=True)
            raw = [np.array(entry_map(m, s, n, np.frombuffer(v, np.int64)), np.int16).tobytes() for n, s, v in rows]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["uid", "k", "came"])

    def leaving(t: pa.Table) -> pa.Table:
        t = t.sort_by([("k", "descending")])
        state, out = 0, []
        for raw in t.column("came").to_pylist():
            out.append(state)
            state = int(np.frombuffer(raw, np.int16)[state])
        return pa.table({"uid": t.column("uid"), "k": t.column("k"), "leave": pa.array(out, pa.int32())})

    @lean
    def traced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in it:
            rows = zip(*[b.column(i).to_pylist() for i in (3, 4, 5, 6)], strict=True)
            raw = [chunk_ids(m, s, n, np.frombuffer(v, np.int64), j) for n, s, v, j in rows]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(raw, pa.binary())], names=["uid", "key", "k", "ids"])

    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        m = model()
        ids = m.merged(b"".join(t.column("ids").to_pylist()))
        return pa.Table.from_batches([finish(m, t.column("key").slice(0, 1).combine_chunks(), [ids])])

    chunks = written(docs.mapInArrow(cut, f"uid long, key {kind}, k int, n int, s string").repartition(parts, "uid", "k"), "piece-chunks")
    states = chunks.select("uid", "k", "n", "s").mapInArrow(matrices, "uid long, k int, matrix binary").groupBy("uid").applyInArrow(scanned, "uid long, k int, states binary")
    held = written(chunks.join(states, ["uid", "k"]), "piece-states")
    leave = held.select("uid", "k", "n", "s", "states").mapInArrow(maps, "uid long, k int, came binary").groupBy("uid").applyInArrow(leaving, "uid long, k int, leave int")
    ids = held.join(leave, ["uid", "k"]).select("uid", "key", "k", "n", "s", "states", "leave").mapInArrow(traced, f"uid long, key {kind}, k int, ids binary")
    return ids.groupBy("uid").applyInArrow(joined, f"key {kind}, {shape}")


def _encoded(docs: DataFrame, model, text: str, key: str, chunk: int, finish, shape: str) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    @lean
    def small(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in it:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield finish(m, part.column(0), m.encode_many(part.column(1).to_pylist()))

    # a little below the chunk: normalising adds a mark
    one = rows.where(F.length("text") < chunk).mapInArrow(small, f"key {kind}, {shape}")
    many = _giants(rows.where(F.length("text") >= chunk), model, chunk, kind, int(spark.conf.get("spark.sql.shuffle.partitions")), finish, shape)
    return one.unionByName(many).withColumnRenamed("key", key)


def encode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", chunk: int = CHUNK, byte_pair_as_unigram: bool = False) -> DataFrame:
    """(key, ids binary): the best segmentation of every whole text, as little-endian unsigned 32-bit ids.

    A null or empty text has no ids. Repeated rows give repeated results, null
    keys stay, extra columns are ignored, an empty table gives an empty result.
    A document's chunk matrices (one for ``chunk`` characters, smaller than the
    text) meet in one task; its text never does before the final ids. Of equally
    good segmentations the piece that starts first stays, as in the library.
    A byte-pair file raises ValueError unless byte_pair_as_unigram says that its
    pieces are to be read as a unigram vocabulary, whose ids are not its merges.
    """
    loaded(model_path, byte_pair_as_unigram)
    return _encoded(docs, partial(loaded, model_path, byte_pair_as_unigram), text, key, chunk, _ids_batch, IDS)


def encode_summary(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", chunk: int = CHUNK, byte_pair_as_unigram: bool = False) -> DataFrame:
    """``summary`` of ``encode``, made in one pass of the workers."""
    loaded(model_path, byte_pair_as_unigram)
    return _encoded(docs, partial(loaded, model_path, byte_pair_as_unigram), text, key, chunk, _digest_batch, DIGEST)


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids", byte_pair_as_unigram: bool = False) -> DataFrame:
    """(key, text) of id sequences; null ids give a null text. Repeated rows and null keys stay; an empty table gives an empty result."""
    kind = encoded.schema[key].dataType.simpleString()
    model = partial(loaded, model_path, byte_pair_as_unigram)

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in it:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                texts = [None if x is None else m.decode(np.frombuffer(x, "<u4").tolist()) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(batches, f"key {kind}, text string").withColumnRenamed("key", key)


def summary(encoded: DataFrame, model_path: str, key: str = "doc_id", byte_pair_as_unigram: bool = False) -> DataFrame:
    """(key, n_pieces, ids, n_chars, text_crc32): the ids as an array, and the length and crc32 of their decoded text; null ids count as none."""
    kind = encoded.schema[key].dataType.simpleString()
    model = partial(loaded, model_path, byte_pair_as_unigram)

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in it:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                yield _digest_batch(m, part.column(0), [x or b"" for x in part.column(1).to_pylist()])

    return encoded.select(F.col(key).alias("key"), "ids").mapInArrow(batches, f"key {kind}, {DIGEST}").withColumnRenamed("key", key)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The public file is a byte-pair one: its pieces are read as a unigram vocabulary, by request."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_summary(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, byte_pair_as_unigram=True)

"""A SentencePiece model file as a unigram vocabulary, and best segmentations under it."""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np

NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Scores are whole multiples of 1/SCALE, so that sums are exact and associative.
SCALE = 64
LOWEST = -(1 << 60)
#: Units that a worker remembers in each of two generations, some 15 MB each.
KEPT = 70_000
MARK = "▁"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        value |= (c & 127) << shift
        i, shift = i + 1, shift + 7
        if c < 128:
            return value, i


def proto_fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """Pieces, scores and normalisation of a model file.

    A unigram file's scores are its own. A byte-pair file has ranks in their
    place. It is turned away unless byte_pair_as_unigram is set: then its pieces
    are a unigram model under Zipf's law, the piece of rank r having the log
    probability -ln(r + 2), and the ids are not the merges of that file.
    """

    def __init__(self, path: str, byte_pair_as_unigram: bool = False) -> None:
        with open(path, "rb") as f:
            raw = f.read()
        self.path, self.pieces = path, []
        trainer: dict = {}
        normal: dict = {}
        for number, value in proto_fields(raw):
            if number == 1:
                p = dict(proto_fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(proto_fields(value))
            elif number == 3:
                normal = dict(proto_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.prefix = bool(normal.get(3, 1))
        self.plain = not normal.get(2, b"") and not normal.get(4, 1) and bool(normal.get(5, 1))
        own = [i for i, p in enumerate(self.pieces) if p[2] == NORMAL]
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"{path}: neither a unigram nor a byte-pair model")
        if self.kind == BPE:
            if not byte_pair_as_unigram:
                raise ValueError(f"{path} is a byte-pair model, whose merges are no longest path; byte_pair_as_unigram reads its pieces as a unigram vocabulary")
            ranked = sorted(own, key=lambda i: (-self.pieces[i][1], i))
            score = {i: round(-math.log(r + 2) * SCALE) for r, i in enumerate(ranked)}
        else:
            score = {i: round(self.pieces[i][1] * SCALE) for i in own}
        low, high = (min(score.values()), max(score.values())) if score else (0, 0)
        self.unknown_score = low - 10 * SCALE
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        for i, (text, _, kind) in enumerate(self.pieces):
            if kind == USER_DEFINED:
                score[i] = len(text) * high - SCALE // 10
        self.scores = score
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(self.pieces) if p[2] == BYTE}
        self.longest = max((len(self.pieces[i][0]) for i in score), default=1)
        self.root: dict = {}
        for i, s in score.items():
            node = self.root
            for c in self.pieces[i][0]:
                node = node.setdefault(c, {})
            node[""] = (i, s)
        #: Words are independent if no piece goes on into another mark after other characters, nor holds a line feed.
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}|\n", self.pieces[i][0]) for i in score)
        #: Marks that no piece joins to a letter before them.
        self.apart = {c for c in ",.!?" if not any(re.search(rf"[^\W\d_]{re.escape(c)}", self.pieces[i][0]) for i in score)}
        self.table = [self._raw(p) for p in self.pieces]
        self._units: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self.id_scores = np.array([self.scores.get(i, 0) for i in range(len(self.pieces))], np.int64)
        if self.pieces:
            self.id_scores[self.unknown] = self.unknown_score
        for value, i in self.bytes.items():  # an unknown character counts at its first byte piece
            self.id_scores[i] = self.unknown_score if value < 0x80 or value >= 0xC0 else 0
        self._library = self._engine = None

    def _raw(self, piece: tuple[str, float, int]) -> bytes:
        text, _, kind = piece
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == 3 else text.replace(MARK, " ").encode()

    def normalize(self, text: str) -> str:
        if self.plain:
            marked = text.replace(" ", MARK)
            return MARK + marked if self.prefix and text else marked
        if self._library is None:
            from sentencepiece import SentencePieceProcessor

            self._library = SentencePieceProcessor(model_file=self.path)
        return self._library.normalize(text)

    def units(self, text: str) -> list[str]:
        """Stretches that every best segmentation respects, in order."""
        if not self.by_word:
            return [text]
        return re.findall(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n", text)

    def lattice(self, s: str, n: int, entry: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
        """Best scores, last starts and last pieces of paths from the entry states to each position.

        Pieces start before n and may reach beyond it. On ties the piece that
        starts first stays, as in the library; an entry state has start -1, an
        unknown character piece -1.
        """
        size = len(s)
        best, start, piece = [LOWEST] * (size + 1), [-1] * (size + 1), [-2] * (size + 1)
        for i, v in entry.items():
            if i <= size:
                best[i] = v
        root, low = self.root, self.unknown_score
        for p in range(n):
            here = best[p]
            if here <= LOWEST:
                continue
            node, e, single = root, p, False
            while e < size:
                node = node.get(s[e])
                if node is None:
                    break
                e += 1
                got = node.get("")
                if got is not None:
                    single |= e == p + 1
                    v = here + got[1]
                    if v > best[e]:
                        best[e], start[e], piece[e] = v, p, got[0]
            if not single and here + low > best[p + 1]:
                best[p + 1], start[p + 1], piece[p + 1] = here + low, p, -1
        return best, start, piece

    def trace(self, s: str, start: list[int], piece: list[int], end: int) -> tuple[list[int], int]:
        """The ids of the best path to end, and the entry state that it comes from."""
        out: list[list[int]] = []
        while start[end] >= 0:
            begin = start[end]
            if piece[end] >= 0:
                out.append([piece[end]])
            elif self.bytes:
                out.append([self.bytes[b] for b in s[begin:end].encode()])
            else:
                out.append([self.unknown])
            end = begin
        return [i for part in reversed(out) for i in part], end

    def _proto(self) -> bytes:
        """The vocabulary as a unigram model file without normalisation: the marks are in the text already."""

        def varint(x: int) -> bytes:
            out = bytearray()
            while x > 127:
                out.append(x & 127 | 128)
                x >>= 7
            return bytes([*out, x])

        field = lambda n, raw: varint(n << 3 | 2) + varint(len(raw)) + raw
        flag = lambda n, v: varint(n << 3) + varint(v)
        piece = lambda i, p: field(1, p[0].encode()) + varint(2 << 3 | 5) + struct.pack("<f", self.scores.get(i, 0) / SCALE) + flag(3, p[2])
        body = b"".join(field(1, piece(i, p)) for i, p in enumerate(self.pieces))
        return body + field(2, flag(3, UNIGRAM) + flag(35, 1)) + field(3, field(1, b"identity") + flag(3, 0) + flag(4, 0) + flag(5, 1))

    def units_score(self, units: list[str]) -> int:
        """The sum of the scores of the units' best segmentations."""
        ids = np.frombuffer(b"".join([self.unit(u) for u in units]), "<u4")
        return int(self.id_scores[ids].sum())

    def remember(self, units: set[str]) -> None:
        """Have the best segmentations of units at hand, the two newest generations of them.

        Short units of a vocabulary with byte pieces go through the library's own
        search in one call; others through lattice().
        """
        known, old = self._units, self._old
        if len(known) > KEPT:
            known, old = {}, known
            self._units, self._old = known, old
        need = []
        for u in units.difference(known, ("",)):
            got = old.get(u)
            if got is not None:
                known[u] = got
            elif u[-1] in self.apart and len(u) > 2 and u[-2].isalpha():
                need += [u[:-1], u[-1]]
            else:
                need.append(u)
        need = [u for u in set(need) if u not in known]
        if self.bytes:
            if self._engine is None:
                from sentencepiece import SentencePieceProcessor

                self._engine = SentencePieceProcessor(model_proto=self._proto())
            short = [u for u in need if len(u) <= 64 and "\0" not in u]
            for u, ids in zip(short, self._engine.encode(short, num_threads=1), strict=True):
                known[u] = array("I", ids).tobytes()
        for u in units:
            if u and u not in known:
                known[u] = self._searched(u)

    def _searched(self, u: str) -> bytes:
        if u[-1] in self.apart and len(u) > 2 and u[-2].isalpha():
            return self.unit(u[:-1]) + self.unit(u[-1])
        _, start, piece = self.lattice(u, len(u), {0: 0})
        return array("I", self.trace(u, start, piece, len(u))[0]).tobytes()

    def unit(self, u: str) -> bytes:
        """The ids of a unit as little-endian unsigned 32-bit integers."""
        return self._units.get(u) or self._searched(u)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        cuts = []
        for text in texts:
            if not text:
                cuts.append([])
            elif self.plain and self.prefix and self.by_word and text[0] != " " and "  " not in text and MARK not in text and "\0" not in text:
                cuts.append((MARK + text).replace(" ", "\0" + MARK).replace("\n", "\0\n\0").split("\0"))
            else:
                cuts.append(self.units(self.normalize(text)))
        self.remember(set().union(*cuts))
        get = self._units.__getitem__
        return [self.merged(b"".join([get(u) for u in cut if u])) for cut in cuts]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def merged(self, ids: bytes) -> bytes:
        """Without byte pieces a run of unknown characters is one piece."""
        if self.bytes:
            return ids
        a = array("I", ids)
        return array("I", [x for i, x in enumerate(a) if x != self.unknown or not i or a[i - 1] != x]).tobytes()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.table.__getitem__, ids))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_MODELS: dict[tuple[str, bool], PieceModel] = {}


def model(path: str, byte_pair_as_unigram: bool = False) -> PieceModel:
    """The worker's model; it outlives a task."""
    name = (path, byte_pair_as_unigram)
    if name not in _MODELS:
        _MODELS[name] = PieceModel(path, byte_pair_as_unigram)
    return _MODELS[name]

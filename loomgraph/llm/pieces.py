"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The model file's pieces and scores are read as they are. Blanks become the
marker U+2581, with one put before the text. The best segmentation is the one
with the greatest sum of scores; of equals, at each place the longest last
piece. A character without a piece costs the least score minus 10 and is
written as its UTF-8 bytes' pieces. Decoding joins pieces, turns markers into
blanks and drops the one that encoding had put first.

No piece has a marker after another character, or certain signs after a letter
(both looked up when the model is loaded), so the best segmentation of a text
is that of its words, each with its markers before it, and of a word that of
its letters and the signs after them. Words are kept in a bounded cache.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_WHOLE = re.compile(".+", re.S)
UNKNOWN_PENALTY = 10.0
#: Bytes of the longest words that are segmented in step, and how many at once.
IN_STEP, AT_ONCE = 48, 1 << 14
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class DoubleArray:
    """A trie of byte strings in two arrays: the child of node s by byte b is base[s] + b + 1 if check there is s; the child by 0 - 1 holds a key's value."""

    def __init__(self, keys: list[bytes]):
        tree: dict = {}
        for value, key in enumerate(keys):
            node = tree
            for b in key:
                node = node.setdefault(b + 1, {})
            node[0] = value
        size = 1 << 16
        base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        todo, first = [(0, tree)], 1
        while todo:
            s, node = todo.pop()
            codes = np.array(sorted(node), np.int64)
            while check[first] != -1:
                first += 1
            at = max(1, first - int(codes[0]))
            while True:
                if at + 600 > len(base):
                    base = np.concatenate([base, np.zeros(len(base), np.int64)])
                    check = np.concatenate([check, np.full(len(check), -1, np.int64)])
                if (check[at + codes] == -1).all():
                    break
                at += 1
            base[s] = at
            check[at + codes] = s
            for c in codes.tolist():
                if c:
                    todo.append((at + c, node[c]))
                else:
                    base[at] = node[0]
        self.base, self.check = base.tolist(), check.tolist()

    def prefixes(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of the keys that begin at start, shortest first."""
        base, check, s = self.base, self.check, 0
        for end in range(start, len(data)):
            t = base[s] + data[end] + 1
            if check[t] != s:
                return
            s = t
            if check[base[s]] == s:
                yield end + 1, base[base[s]]


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of a protocol buffer message's fields."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 2:
            size, at = number(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = np.frombuffer(raw[at : at + size], "<f4" if size == 4 else "<f8")[0], at + size
        yield key >> 3, value


class Model:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        normal = [(i, p.encode(), s) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
        self.ids = [i for i, _, _ in normal]
        self.scores = [float(s) for _, _, s in normal]
        self.trie = DoubleArray([p for _, p, _ in normal])
        self.arrays = np.array(self.trie.base), np.array(self.trie.check), np.array(self.scores)
        self.id_of = np.array(self.ids, "<u4")
        self.unknown = min(self.scores, default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        kinds = {i: kind for i, (_, _, kind) in enumerate(pieces)}
        self.surface = [bytes([int(p[3:5], 16)]) if kinds[i] == BYTE else b"" if kinds[i] == CONTROL else p.encode() for i, (p, _, _) in enumerate(pieces)]
        split = not any(MARK in p.lstrip(MARK) for p, _, _ in pieces)
        # signs that no piece has after a letter: there, too, a word's best segmentation is that of its parts
        held = {b for p, _, _ in pieces for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        self.signs = "".join(c for c in ".,!?;:#*$%&|<>" if c not in held)
        self.words = tokens.WordCache((_WORDS if split else _WHOLE).findall, self._encode_words)

    @classmethod
    def load(cls, path: str) -> Model:
        def make() -> Model:
            out = []
            with open(path, "rb") as f:
                for number, raw in _fields(f.read()):
                    if number == 1:
                        x = dict(_fields(raw))
                        out.append((x[1].decode(), float(x.get(2, 0.0)), x.get(3, NORMAL)))
            return cls(out)

        return tokens.loaded(("pieces", path), make)

    def viterbi(self, text: str) -> list[int]:
        data = text.encode()
        n = len(data)
        best: list[float | None] = [None] * (n + 1)
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0.0
        base, check, scores, at = self.trie.base, self.trie.check, self.scores, 0
        while at < n:
            lead = data[at]
            char = at + (1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4)
            so_far, s, single = best[at], 0, False
            for end in range(at, n):
                t = base[s] + data[end] + 1
                if check[t] != s:
                    break
                s = t
                leaf = base[s]
                if check[leaf] == s:
                    value = base[leaf]
                    total = so_far + scores[value]
                    if best[end + 1] is None or total > best[end + 1]:
                        best[end + 1], came[end + 1] = total, (at, value)
                    single = single or end + 1 == char
            if not single and (best[char] is None or so_far + self.unknown > best[char]):
                best[char], came[char] = so_far + self.unknown, (at, -1)
            at = char
        out: list[int] = []
        while n:
            at, value = came[n]
            if value >= 0:
                out.append(self.ids[value])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(data[at:n])]
            else:
                out.append(self.unknown_id)
            n = at
        return out[::-1]

    def viterbi_many(self, texts: list[str]) -> list[bytes]:
        """The same for many texts, those of a length in step with each other; as little-endian 4-byte ids."""
        out: list[bytes] = [b""] * len(texts)
        raw = [t.encode() for t in texts]
        by_size: dict[int, list[int]] = {}
        for i, data in enumerate(raw):
            if data:
                by_size.setdefault(len(data), []).append(i)
        for n, own in by_size.items():
            if n > IN_STEP or len(own) < 16:
                for i in own:
                    out[i] = array("I", self.viterbi(texts[i])).tobytes()
                continue
            for first in range(0, len(own), AT_ONCE):
                some = own[first : first + AT_ONCE]
                for i, ids in zip(some, self._in_step(np.frombuffer(b"".join([raw[i] for i in some]), np.uint8).reshape(len(some), n)), strict=True):
                    out[i] = array("I", self.viterbi(texts[i])).tobytes() if ids is None else ids
        return out

    def _in_step(self, data: np.ndarray) -> Iterator[bytes | None]:
        """Ids of each row's text; None where a character has no piece."""
        base, check, scores = self.arrays
        w, n = data.shape
        starts = (data & 0xC0) != 0x80
        size = np.where(data < 128, 1, np.where(data < 224, 2, np.where(data < 240, 3, 4)))
        best = np.full((n + 1, w), -np.inf)
        came, value = np.zeros((n + 1, w), np.int32), np.full((n + 1, w), -1, np.int32)
        best[0] = 0
        for at in range(n):
            rows = np.flatnonzero(starts[:, at])
            stop, single = at + size[rows, at], np.zeros(len(rows), bool)
            live, s, so_far = np.arange(len(rows)), np.zeros(len(rows), np.int64), best[at, rows]
            for end in range(at, n):
                t = base[s] + data[rows[live], end] + 1
                ok = np.flatnonzero(check[t] == s)
                live, s = live[ok], t[ok]
                if not len(live):
                    break
                leaf = base[s]
                ended = np.flatnonzero(check[leaf] == s)
                i, v = live[ended], base[leaf[ended]]
                single[i[stop[i] == end + 1]] = True
                total = so_far[i] + scores[v]
                better = np.flatnonzero(total > best[end + 1, rows[i]])
                r = rows[i[better]]
                best[end + 1, r], came[end + 1, r], value[end + 1, r] = total[better], at, v[better]
            for i in np.flatnonzero(~single):
                r, to, total = rows[i], stop[i], so_far[i] + self.unknown
                if total > best[to, r]:
                    best[to, r], came[to, r], value[to, r] = total, at, -1
        at, steps, odd = np.full(w, n, np.int64), [], np.zeros(w, bool)
        every = np.arange(w)
        while at.any():
            v = np.where(at > 0, value[at, every], 0)
            odd |= v < 0
            steps.append(np.where(at > 0, v, -1))
            at = np.where(at > 0, came[at, every], 0)
        v = np.stack(steps[::-1], 1)
        used = v >= 0
        flat, ends = self.id_of[v[used]].tobytes(), (4 * np.cumsum(used.sum(1))).tolist()
        for begin, end, x in zip([0, *ends[:-1]], ends, odd.tolist(), strict=True):
            yield None if x else flat[begin:end]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        cut: list[tuple[str, str]] = []
        for w in words:
            core = w.rstrip(self.signs)
            cut.append((core, w[len(core) :]) if core and len(core) < len(w) and core[-1].isalpha() else (w, ""))
        parts = list({p for pair in cut for p in pair if p})
        ids = dict(zip(parts, self.viterbi_many(parts), strict=True))
        ids[""] = b""
        return [ids[a] + ids[b] for a, b in cut]

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; none for a null or empty text."""
        for ids in self.words([MARK + t.replace(" ", MARK) if t else None for t in texts]):
            yield np.frombuffer(ids, "<u4")

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray | list[int]) -> str:
        surface = self.surface
        raw = b"".join([surface[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids; a null or empty text has none. Rows keep their place: nothing is shuffled."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(path)
        for batch in batches:
            ids = [x.astype("i4") for x in model.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of doc_id and ids; no ids, or null, give the empty text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(path)
        for batch in batches:
            texts = [model.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: n_pieces, n_bytes_fallback, ids_crc32 (little-endian unsigned 32-bit ids), and whether decoding gives the text again (markers in it as blanks).

    A null text is empty. Rows that repeat an id or a text have a row each;
    columns other than doc_id and text are not read.
    """
    path = path or model_path()
    schema = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(path)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.bytes.values())] = True
        for batch in batches:
            rows = []
            texts = batch.column(1).to_pylist()
            for doc, text, ids in zip(batch.column(0).to_pylist(), texts, model.encode_all(texts), strict=True):
                rows.append((doc, len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.tobytes()), model.decode(ids) == (text or "").replace(MARK, " ")))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.bool_()), strict=True)], schema.replace(" long", "").replace(" boolean", "").split(", "))

    return docs.select("doc_id", "text").mapInArrow(run, schema)

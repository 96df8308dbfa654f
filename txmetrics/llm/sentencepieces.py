"""SentencePiece encoding with the source position of every piece, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map. Every byte of
the normalised text keeps the byte of the source it came from, so that each piece can be projected
to a span of the source's UTF-8 bytes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txmetrics.llm.frames import map_texts, pick

SPACE = "▁".encode()
#: Distinct words whose ids a task remembers; the memory is emptied when full.
REMEMBERED = 200_000
BPE, NORMAL_ID, USER_DEFINED, BYTE = 2, 1, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a serialised message: number and value."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[i : i + size]
        i += size


@dataclass
class CharacterMap:
    """The compiled map of a model: a double-array trie over byte strings, and their replacements."""

    blob: bytes = b""
    units: list[int] = field(default_factory=list)
    strings: bytes = b""

    def __post_init__(self) -> None:
        if self.blob:
            (size,) = struct.unpack_from("<I", self.blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", self.blob, 4))
            self.strings = self.blob[4 + size :]
        first = bytes(b for b in range(1, 256) if self.units and self._child(0, b) is not None)
        #: A run of bytes that begin no entry, or one byte that may.
        self.run = re.compile(b"[^" + re.escape(first) + b"]+", re.DOTALL) if first else None

    def _child(self, node: int, byte: int) -> int | None:
        unit = self.units[node]
        at = node ^ self._offset(unit) ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest entry at ``start``, and what replaces it."""
        node, found = 0, None
        for i in range(start, len(data)):
            node = self._child(node, data[i])
            if node is None:
                break
            unit = self.units[node]
            if unit >> 8 & 1:
                at = self.units[node ^ self._offset(unit)] & 0x7FFFFFFF
                found = i + 1 - start, self.strings[at : self.strings.index(b"\0", at)]
        return found

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Mapped bytes, and for each the start and the end of its source bytes."""
        if self.run is None:
            at = np.arange(len(data), dtype=np.int64)
            return data, at, at + 1
        out, begins, ends = [], [], []
        i = 0
        while i < len(data):
            found = None
            if plain := self.run.match(data, i):
                size = plain.end() - i
                # an entry never starts inside a character, so a run may end only before one
                while i + size < len(data) and data[i + size] & 0xC0 == 0x80:
                    size += 1
            elif found := self.longest(data, i):
                size = found[0]
            else:
                size = 1
                while i + size < len(data) and data[i + size] & 0xC0 == 0x80:
                    size += 1
            new = data[i : i + size] if found is None else found[1]
            out.append(new)
            if found is None:
                begins.append(np.arange(i, i + size))
                ends.append(begins[-1] + 1)
            else:
                begins.append(np.full(len(new), i))
                ends.append(np.full(len(new), i + size))
            i += size
        empty = np.zeros(0, np.int64)
        return b"".join(out), np.concatenate([empty, *begins]), np.concatenate([empty, *ends])


class PieceModel:
    """A SentencePiece model file: its normaliser is read here, its merges are the library's."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            raw = file.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1], piece.get(3, NORMAL_ID)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.map = CharacterMap(normaliser.get(2, b""))
        self.prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.suffix = bool(trainer.get(24, 0))
        self.size = np.array([1 if kind == BYTE else len(text) for text, kind in pieces], np.int64)
        #: The same for a source in which every space mark was one byte.
        self.source_size = self.size - np.array([0 if kind == BYTE else 2 * text.count(SPACE) for text, kind in pieces], np.int64)
        self.unknown = int(trainer.get(40, 0))
        #: Pieces never cross from a word into the space after it, so words can be encoded one by one.
        self.by_word = (
            trainer.get(3) == BPE
            and self.prefix
            and not (self.squeeze or self.suffix or self.map.units)
            and not any(kind == USER_DEFINED or re.search("[^▁]▁", text.decode()) for text, kind in pieces)
        )
        self.known: dict[str, list[int]] = {}

    def normalise(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and the start and end of the source bytes of each."""
        data, begin, end = self.map.apply(text.encode())
        values = np.frombuffer(data, np.uint8)
        if self.squeeze:
            space = values == 32
            keep = ~space | np.concatenate([[False], ~space[:-1]]) if len(space) else space
            while len(keep) and (kept := np.flatnonzero(keep)).size and space[kept[-1]]:
                keep[kept[-1]] = False
            values, begin, end = values[keep], begin[keep], end[keep]
        if self.prefix and len(values):
            if self.suffix:
                values = np.append(values, np.uint8(32))
                begin, end = np.append(begin, end[-1]), np.append(end, end[-1])
            else:
                values = np.insert(values, 0, 32)
                begin, end = np.insert(begin, 0, 0), np.insert(end, 0, 0)
        width = np.where(values == 32, len(SPACE), 1)
        normal = values.tobytes().replace(b" ", SPACE)
        return normal, np.repeat(begin, width), np.repeat(end, width)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Exactly the ids that the library gives for each text."""
        if not self.by_word:
            return self.library.encode(texts)
        cut = [re.findall("[ ▁]*[^ ▁]+|[ ▁]+", " " + t) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list({w for words in cut for w in words if w not in known})
        # the library puts back the one space that is left off here, but not before nothing
        known.update(zip(fresh, self.library.encode([w[1:] for w in fresh]), strict=True))
        known[" "] = known["▁"] = [self.library.piece_to_id("▁")]
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte in the source of every piece; an added space has an empty span."""
        if self.by_word and "▁" not in text:
            # bytes stand for themselves here, but for the space in front: no need to look at each
            stop = np.cumsum(self.source_size[ids]) - 1
            if len(ids) and stop[-1] != len(text.encode()):
                raise ValueError("pieces do not cover the text")
            return np.maximum(stop - self.source_size[ids], 0), stop
        normal, begin, end = self.normalise(text)
        size = self.size[ids]
        if (lost := ids == self.unknown).any():
            size = self._unknown_sizes(text, ids, normal, size, lost)
        stop = np.cumsum(size)
        if len(ids) and stop[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        if not len(ids):
            return stop, stop
        return begin[stop - size], np.maximum(end[stop - 1], begin[stop - size])

    def _unknown_sizes(self, text, ids, normal, size, lost):
        """Lengths of unknown pieces, from the library's own pieces."""
        size = size.copy()
        size[lost] = [len(p.encode()) for p, x in zip(self.library.encode(text, out_type=str), lost, strict=True) if x]
        return size


@cache
def _model(path: str) -> PieceModel:
    """One model for all tasks of a Python worker, so that the words it knows stay known."""
    return PieceModel(path)


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids, byte spans and decoded text of every document.

    Returns ``doc_id``, ``ids`` array<int>, ``starts`` and ``ends`` array<int> (UTF-8 bytes of the
    source, end exclusive; the space that the normaliser puts in front has an empty span at 0) and
    ``decoded`` string. One row per input row, whatever its id, so repeated rows and null ids stay.
    A null or empty text has no pieces and decodes to the empty string. Columns other than id and
    text are not read. The model file must be readable at ``model_path`` on every executor.
    """

    def each(doc_ids, texts, model: PieceModel):
        texts = [t or "" for t in texts]
        lists = model.ids(texts)
        arrays = [np.array(x, np.int32) for x in lists]
        spans = [model.spans(t, a) for t, a in zip(texts, arrays, strict=True)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32))
        nested = lambda parts: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts).astype(np.int32)))
        return {
            "doc_id": doc_ids,
            "ids": nested(arrays),
            "starts": nested([s for s, _ in spans]),
            "ends": nested([e for _, e in spans]),
            "decoded": pa.array(model.library.decode(lists), pa.string()),
        }

    schema = "doc_id, ids array<int>, starts array<int>, ends array<int>, decoded string"
    return map_texts(pick(docs, id_column, text_column), schema, each, lambda: _model(model_path))

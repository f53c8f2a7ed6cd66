"""Exact byte-level BPE ids with the tokenizers library, remembered by space-delimited chunk.

In a text whose only white space is single spaces and single line ends between other characters, the
pre-tokenizer never lets a token cross such a place, so the ids of the text are those of its chunks in order.
Any other text is encoded whole. The chunks of a slice are found, compared by 64-bit hash and put together with
numpy; those not seen before go to the tokenizer in one call.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from mentora.llm.words import BLANK, mix, text_slices, word_hashes

#: Bytes of which a white-space character other than space and line end is made or begins with.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[:32] = _SUSPECT[127] = True
_SUSPECT[10] = False
_SUSPECT[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_AT_START, _AFTER_SPACE, _AFTER_LINE = 0, 1, 2


class ChunkEncoder:
    """``remember`` bounds the chunks kept between slices, some 30 bytes each; the results don't depend on it."""

    def __init__(self, path: str, remember: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.line_end = self.whole("\n")
        self.remember = remember
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _joined(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _ids_of(self, chunks: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new chunks one after another, and how many each has."""
        counts = np.zeros(len(chunks), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(chunks)
        inner = np.flatnonzero(kinds == _AFTER_SPACE)
        if len(inner):
            ids = self._joined(" " + " ".join([chunks[i] for i in inner]))
            for i, part in zip(inner.tolist(), np.split(ids, np.flatnonzero(self.spaced[ids])[1:]), strict=True):
                parts[i] = part
        head = np.flatnonzero(kinds != _AFTER_SPACE)
        if len(head):
            ids = self._joined("\n".join([chunks[i] for i in head]))
            cut = np.flatnonzero(ids == self.line_end[0])
            for i, a, b in zip(head.tolist(), [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)], strict=True):
                parts[i] = ids[a:b] if kinds[i] == _AT_START else np.concatenate([self.line_end, ids[a:b]])
        counts[:] = [len(x) for x in parts]
        return np.concatenate(parts), counts

    def _irregular(self, data: np.ndarray, at: np.ndarray) -> list[int]:
        """Rows that must be encoded whole."""
        blank = BLANK[data]
        bad = np.zeros(len(data), bool)
        bad[1:] = blank[1:] & blank[:-1]
        if len(data):
            edges = np.concatenate([at[:-1], at[1:] - 1])
            edges = edges[(edges >= 0) & (edges < len(data))]
            bad[edges] |= blank[edges]
        bad |= _SUSPECT[data]
        out = []
        for row in np.unique(np.searchsorted(at, np.flatnonzero(bad), "right") - 1).tolist():
            text = data[at[row] : at[row + 1]].tobytes().decode()
            if not all(x.isprintable() and x and x[0] != " " and x[-1] != " " and "  " not in x for x in text.split("\n")):
                out.append(row)
        return out

    def slice_ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the row offsets."""
        odd = self._irregular(data, at)
        hashes, first, starts, ends = word_hashes(data, at, BLANK, fold=False, places=True)
        if not len(hashes):
            ids, offsets = np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        else:
            kinds = np.where(data[starts - 1] == 32, _AFTER_SPACE, _AFTER_LINE)
            kinds[first[:-1][np.diff(first) > 0]] = _AT_START
            seen, which = np.unique(hashes ^ mix(kinds.astype(np.uint64) + np.uint64(77)), return_inverse=True)
            place = np.searchsorted(self.keys, seen)
            known = np.zeros(len(seen), bool)
            inside = place < len(self.keys)
            known[inside] = self.keys[place[inside]] == seen[inside]
            begin, count = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
            begin[known], count[known] = self.begin[place[known]], self.count[place[known]]
            pool = self.pool
            if not known.all():
                example = np.empty(len(seen), np.int64)
                example[which] = np.arange(len(which))
                new = np.flatnonzero(~known)
                example = example[new]
                raw = data.tobytes()
                chunks = [raw[a:b].decode() for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
                got, sizes = self._ids_of(chunks, kinds[example])
                begin[new], count[new] = len(pool) + np.cumsum(sizes) - sizes, sizes
                pool = np.concatenate([pool, got])
                if len(self.keys) < self.remember:
                    self.keys, self.begin, self.count = np.insert(self.keys, place[new], seen[new]), np.insert(self.begin, place[new], begin[new]), np.insert(self.count, place[new], count[new])
                    self.pool = pool
            length = count[which]
            end = np.cumsum(length)
            ids = pool[np.repeat(begin[which] - (end - length), length) + np.arange(end[-1])]
            offsets = np.concatenate([[0], end])[first]
        if odd:
            parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            for row in odd:
                parts[row] = self.whole(data[at[row] : at[row + 1]].tobytes().decode())
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, offsets

    def column_ids(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) by slices of an Arrow text column."""
        for first, end, data, at in text_slices(column):
            yield first, end, *self.slice_ids(data, at)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

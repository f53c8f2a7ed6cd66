"""Unigram token counts with dynamic programming shared along a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentora.llm.words import BLANK, text_slices, word_hashes

#: Score below the least frequent piece for each byte of a character that no piece covers.
BYTE_PENALTY = 10.0


class UnigramCounter:
    """Tokens of the best segmentation of a pre-token under a unigram model.

    Pieces come from a vocabulary file; the log-probability of a piece is -ln(rank + 10), rank 0 being the first.
    A character outside the vocabulary counts as its UTF-8 bytes. Of equal segmentations the one with the longer
    last piece counts.
    """

    def __init__(self, path: str, remember: int = 2_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.score = {x: -math.log(rank + 10) for rank, x in enumerate(names)}
        self.longest = max(map(len, names))
        self.byte_score = -math.log(len(names) + 10) - BYTE_PENALTY
        self.remember = remember
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count_sorted(self, pretokens: list[str]) -> list[int]:
        """Counts of distinct pre-tokens in ascending order.

        In this order a depth-first walk of their trie meets them one after another: ``best`` and ``tokens`` hold the
        forward scores of the nodes on the path to the current one, and a prefix shared with the one before is kept.
        """
        best, tokens, path, out = [0.0], [0], "", []
        score, longest = self.score, self.longest
        for word in pretokens:
            shared = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, n = -math.inf, 0
                for begin in range(max(0, end - longest), end):
                    own = score.get(word[begin:end])
                    if own is not None and best[begin] + own > top:
                        top, n = best[begin] + own, tokens[begin] + 1
                if word[end - 1] not in score:
                    size = len(word[end - 1].encode())
                    if (x := best[end - 1] + size * self.byte_score) > top:
                        top, n = x, tokens[end - 1] + size
                best.append(top)
                tokens.append(n)
            path = word
            out.append(tokens[-1])
        return out

    def slice_counts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of every row."""
        hashes, first, starts, ends = word_hashes(data, at, BLANK, fold=False, places=True)
        seen, which = np.unique(hashes, return_inverse=True)
        place = np.searchsorted(self.keys, seen)
        inside = place < len(self.keys)
        known = np.zeros(len(seen), bool)
        known[inside] = self.keys[place[inside]] == seen[inside]
        counts = np.zeros(len(seen), np.int64)
        counts[known] = self.counts[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            example = np.empty(len(seen), np.int64)
            example[which] = np.arange(len(which))
            raw = data.tobytes()
            words = sorted(("▁" + raw[starts[e] : ends[e]].decode(), i) for e, i in zip(example[new].tolist(), new.tolist(), strict=True))
            counts[[i for _, i in words]] = self.count_sorted([w for w, _ in words])
            if len(self.keys) < self.remember:
                self.keys, self.counts = np.insert(self.keys, place[new], seen[new]), np.insert(self.counts, place[new], counts[new])
        running = np.concatenate([[0], np.cumsum(counts[which])])
        return np.diff(first), np.diff(running[first])


_COUNTERS: dict[str, UnigramCounter] = {}


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, pieces: str | None = None) -> DataFrame:
    """Pre-tokens (words between white space) and unigram tokens of every text of ``docs`` (doc_id, text).

    Returns doc_id, n_pretokens, n_tokens. A null, empty or blank text has none; rows with equal doc_id are counted
    each; a null doc_id stays null; other columns are ignored. No shuffle: every task keeps its own bounded memory
    of counts.
    """
    path = pieces or default_pieces()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = UnigramCounter(path)
        for batch in batches:
            for first, end, data, at in text_slices(batch.column("text")):
                pretokens, tokens = _COUNTERS[path].slice_counts(data, at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(pretokens.astype(np.int64)), pa.array(tokens.astype(np.int64))], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")

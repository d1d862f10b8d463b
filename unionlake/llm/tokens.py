"""Whole texts to token ids by a public tokenizer, batch-wise.

A text is cut before white space that follows other characters, and between ASCII letters or digits and ASCII punctuation.
At such a place both vocabularies' splitting patterns start a new piece, so the text's ids are those of its cuts in
a row; each different cut of a batch is encoded once.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from unionlake.llm.arrowtext import SPACE, text_bytes

WORDY = np.zeros(256, bool)
WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: ASCII punctuation beside which a text may be cut: not the marks of special tokens.
MARK = np.zeros(256, bool)
MARK[[c for c in range(0x21, 0x7F) if not WORDY[c] and chr(c) not in "<|>"]] = True
#: After an apostrophe a contraction may follow, so there is no cut.
OPEN = MARK.copy()
OPEN[0x27] = False


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary, one for all tasks of a worker."""
    return Encoder(path)


class Encoder:
    """path: a file of the tokenizers library.  keep: cuts whose ids are kept from batch to batch."""

    def __init__(self, path: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.known = Tokenizer.from_file(path), keep, {}
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(data)
        gap = SPACE[data]
        plain = ~gap & ((data < 0x1C) | (data > 0x1F))
        # the character before must not be white space of Unicode: none of these starts with another byte
        plain[1:] &= (data[1:] < 0x80) | (data[:-1] != 0xC2)
        plain[2:] &= (data[2:] < 0x80) | (data[:-2] < 0xE1) | (data[:-2] > 0xE3)
        cut = np.zeros(n + 1, bool)
        cut[1:n] = (gap[1:] & plain[:-1]) | (MARK[data[1:]] & WORDY[data[:-1]]) | (WORDY[data[1:]] & OPEN[data[:-1]])
        cut[offsets] = True
        return np.flatnonzero(cut[:n])

    def _coded(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some cuts in a row, and how many each has."""
        coded = self.tokenizer.encode(cuts, is_pretokenized=True, add_special_tokens=False)
        return np.array(coded.ids, np.uint32), np.bincount(np.array(coded.word_ids, np.int64), minlength=len(cuts))

    def _places(self, cuts: list[str]) -> tuple[np.ndarray, pa.ListArray]:
        """The row of each cut in a list of ids: those kept from earlier batches, then the new ones."""
        places = list(map(self.known.get, cuts))
        new = [i for i, x in enumerate(places) if x is None]
        ids, sizes, rows = [self.ids], [self.sizes], len(self.sizes)
        for at in range(0, len(new), 50_000):
            mine, n = self._coded([cuts[i] for i in new[at : at + 50_000]])
            ids.append(mine)
            sizes.append(n)
        for row, i in enumerate(new, rows):
            places[i] = row
        flat, n = np.concatenate(ids), np.concatenate(sizes)
        ends = np.append(0, np.cumsum(n))
        room = min(len(new), max(0, self.keep - rows))
        if room:
            self.known.update((cuts[i], places[i]) for i in new[:room])
            self.sizes, self.ids = n[: rows + room], flat[: ends[rows + room]].copy()
        return np.array(places, np.int64), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's start and the last's end; null is empty."""
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        cuts = self._cuts(data, offsets)
        bounds = np.append(cuts, len(data))
        pieces = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        places, known = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        lists = known.take(pa.array(places[coded.indices.to_numpy(zero_copy_only=False)]))
        ends = lists.offsets.to_numpy()
        return lists.values.to_numpy()[ends[0] : ends[-1]], (ends[np.searchsorted(bounds, offsets)] - ends[0]).astype(np.int64)

"""Token ids of whole columns through a bounded table of distinct words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

from treeline.llm.shared import ragged
from treeline.llm.vocab import ByteLevelRule

#: Distinct words that a worker remembers; beyond it the table starts anew (speed only, never results).
TABLE_WORDS = 600_000


class WordTable:
    """Encodings of distinct words, kept across batches of one Python worker.

    ``encode_words`` gets new distinct words (bytes) and returns one id
    sequence for each.  Memory is bounded by :data:`TABLE_WORDS` plus the
    distinct words of one slice.
    """

    def __init__(self, rule: ByteLevelRule, encode_words: Callable[[list[bytes]], Sequence[Sequence[int]]]):
        self.rule, self.encode_words = rule, encode_words
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.used_ids = 0

    def _codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > TABLE_WORDS:
            self.clear()
        known = list(map(self.index.get, words))
        new = [w for w, k in zip(words, known, strict=True) if k is None]
        if new:
            encoded = self.encode_words(new)
            base = len(self.index)
            self.index.update(zip(new, range(base, base + len(new)), strict=True))
            sizes = np.fromiter(map(len, encoded), np.int32, len(new))
            total = int(sizes.sum())
            self.start = _room(self.start, base, len(new))
            self.size = _room(self.size, base, len(new))
            self.ids = _room(self.ids, self.used_ids, total)
            self.start[base : base + len(new)] = self.used_ids + np.cumsum(sizes) - sizes
            self.size[base : base + len(new)] = sizes
            self.ids[self.used_ids : self.used_ids + total] = np.fromiter((i for e in encoded for i in e), np.uint32, total)
            self.used_ids += total
            known = list(map(self.index.__getitem__, words))
        return np.fromiter(known, np.int64, len(words))

    def _pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, rows = self.rule.pieces(column)
        coded = words.dictionary_encode()
        codes = self._codes(coded.dictionary.to_pylist())
        return codes[coded.indices.to_numpy(zero_copy_only=False)] if len(codes) else np.zeros(0, np.int64), rows

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows back to back, offsets of the rows) for a binary column without nulls."""
        codes, rows = self._pieces(column)
        sizes = self.size[codes]
        ids = self.ids[ragged(self.start[codes], sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[rows]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each row."""
        codes, rows = self._pieces(column)
        running = np.concatenate([[0], np.cumsum(self.size[codes], dtype=np.int64)])
        return running[rows[1:]] - running[rows[:-1]]


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    grown = np.zeros(max(2 * len(array), used + more, 1024), array.dtype)
    grown[:used] = array[:used]
    return grown


_tables: dict[tuple, WordTable] = {}


def kept_table(key: tuple, make: Callable[[], WordTable]) -> WordTable:
    """One table per worker process and key, reused by the tasks that the worker runs."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = make()
    return _tables[key]


def library_table(path: str) -> WordTable | None:
    """A table whose words the tokenizers library encodes; None if the file's rule is not plain byte-level."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import json

    from tokenizers import Tokenizer

    from treeline.llm.vocab import is_plain_byte_level

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if not is_plain_byte_level(spec):
        return None

    def make() -> WordTable:
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()

        def encode(words: list[bytes]) -> list[list[int]]:
            found = []
            for k in range(0, len(words), 4096):
                part = [w.decode() for w in words[k : k + 4096]]
                found += [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)]
            return found

        return WordTable(ByteLevelRule(tuple(t["content"] for t in spec["added_tokens"])), encode)

    return kept_table(("library", path), make)

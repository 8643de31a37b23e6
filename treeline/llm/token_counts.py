"""Token counts of whole texts; huge documents by overlap resynchronisation.

Texts up to ``chunk_chars`` are counted by the library (byte-level files: through a
table of distinct words).  A longer text is encoded in overlapping chunks with
offsets.  Two neighbouring chunks are spliced at a boundary that is proven
stable: a position where both start a pre-token, after which pre-tokens follow
from the text to their right alone, and which lies before the last whole pre-token and
any cut special string of the left chunk.  Without such a boundary the overlap is
widened, in the end to the whole text.  Memory is that of one text and two chunks.

Null text counts as empty; every input row gives one row; an empty table none.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeline.llm.shared import filled, flat, slices
from treeline.llm.wordtable import library_table

CHUNK_CHARS, OVERLAP_CHARS = 1 << 14, 1 << 9


class ChunkedCounter:
    """Counts the tokens of one text by overlapping chunks of a tokenizers file."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunk, self.overlap = chunk, overlap
        #: Characters at the end of a chunk that may belong to a special string cut there.
        self.margin = max((len(t.content) for t in self.library.get_added_tokens_decoder().values()), default=0)
        self.widened = 0

    def _chunk(self, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(start of each token in the text, indices of the tokens that start a pre-token)."""
        encoding = self.library.encode(text[begin:end], add_special_tokens=False)
        starts = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(encoding)) + begin
        word = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
        return starts, np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (word[1:] < 0)) if len(word) else np.zeros(0, bool))

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.library.encode(text, add_special_tokens=False))
        total, at, size = 0, 0, self.chunk  # ``at``: a proven boundary; all before it is counted
        starts, heads = self._chunk(text, at, at + size)
        first = 0  # index of the token at ``at``
        end = at + size
        while end < len(text):
            # boundaries of the left chunk that cannot change with more text
            fixed = heads[(starts[heads] > at) & (starts[heads] <= end - self.margin)][:-1]
            overlap, spliced = self.overlap, False
            while not spliced and overlap < end - at:
                right, right_heads = self._chunk(text, end - overlap, end - overlap + self.chunk + overlap)
                common = np.intersect1d(starts[fixed], right[right_heads[1:]])
                if spliced := len(common) > 0:
                    cut = int(common[-1])
                    total += int(fixed[np.searchsorted(starts[fixed], cut)]) - first
                    first = int(right_heads[np.searchsorted(right[right_heads], cut)])
                    starts, heads, at, end = right, right_heads, cut, end + self.chunk
                else:
                    overlap *= 4
                    self.widened += 1
            if not spliced:  # no boundary at all: one larger chunk from the last proven boundary
                end = at + 2 * (end - at)
                starts, heads = self._chunk(text, at, end)
                first = 0
                self.widened += 1
        return total + len(starts) - first


_counters: dict[tuple, ChunkedCounter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, n_bytes, n_tokens, over_limit`` of each whole text.

    ``path`` names a tokenizers ``.json`` or a sentencepiece ``.model`` file; the latter
    gives no pre-token offsets, so that its texts are counted in one piece.
    No begin, end or other added token is counted; a special string inside a
    text counts as the library's default has it.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            table, long = None, lambda t: len(pieces.encode(t, num_threads=1))
        else:
            table = library_table(path)
            key = (path, chunk_chars, overlap_chars)
            if key not in _counters:
                _counters[key] = ChunkedCounter(*key)
            long = _counters[key].count
        for batch in batches:
            for part, text in slices(batch.rename_columns(["id", "text"]), "text"):
                size = np.diff(flat(text)[1])
                if table is None:
                    counts = np.array([long(t.decode()) for t in text.to_pylist()], np.int64)
                else:
                    huge = size > chunk_chars
                    counts = np.zeros(len(size), np.int64)
                    counts[~huge] = table.counts(text.filter(pa.array(~huge)))
                    counts[huge] = [long(t.decode()) for t in text.filter(pa.array(huge)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size.astype(np.int64)), pa.array(counts), pa.array(counts > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_column, text_column).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)

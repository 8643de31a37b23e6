"""Byte-pair encoding by a prefix-sharing trie of distinct words, and decoding.

The encoding of every prefix of a word is fixed by its last token: the token
``t`` is last for the prefix of length ``d`` iff ``t`` ends there and stands
validly after the last token of the prefix of length ``d - len(t)``.  Two tokens are
valid neighbours iff merging their bytes from scratch never joins the seam
between them.  Distinct words, sorted, are a trie in depth-first order: a word
shares the states of its common prefix with the word before it, so each trie
node is computed once, and a word's ids are read back from its last state.

Results: null text encodes as empty; a special string inside a text is its
special id; very long texts are handled in whole; every input row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeline.llm.shared import filled, ragged, slices
from treeline.llm.vocab import ByteLevelRule, Vocabulary
from treeline.llm.wordtable import WordTable, kept_table

NEVER = 1 << 30


class TrieEncoder:
    """Encodes distinct words of a byte-level BPE vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.token = v.to_id
        self.length = {i: len(b) for b, i in v.to_id.items()}
        self.rank = {pair: k for k, pair in enumerate(v.merges)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for b, i in v.to_id.items():
            if len(b) == 1:
                self.right[i] = self.left[i] = [(i, NEVER)]
        #: Tokens whose own bytes encode to them; no other can occur in an encoding.
        self.sound = {i for b, i in v.to_id.items() if len(b) == 1}
        for k, (a, b) in enumerate(v.merges):
            whole = v.to_id[v.bytes_of[a] + v.bytes_of[b]]
            if whole in self.left or a not in self.sound or b not in self.sound or not self._seam_holds(a, b, k):
                continue
            self.right[whole] = [*self.right[b][:-1], (b, k), (whole, NEVER)]
            self.left[whole] = [*self.left[a][:-1], (a, k), (whole, NEVER)]
            self.sound.add(whole)
        self.token = {b: i for b, i in v.to_id.items() if i in self.sound}
        self.longest = max(self.length[i] for i in self.sound)
        self.seams: dict[tuple[int, int], bool] = {}

    def _seam_holds(self, a: int, b: int, joined: int = NEVER) -> bool:
        """Whether no merge crosses the seam while ``a`` and ``b`` grow from their bytes.

        ``joined``: the rank of the merge of ``a`` and ``b`` themselves, which may come last.
        """
        up, down = self.right[a], self.left[b]
        i = k = 0
        while True:
            x, next_x = up[i]
            y, next_y = down[k]
            cross = self.rank.get((x, y), NEVER)
            if cross < next_x and cross <= next_y and cross != NEVER:
                return cross == joined and next_x == next_y == NEVER
            if next_x == next_y == NEVER:
                return True
            if next_x <= next_y:
                i += 1
            else:
                k += 1

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; the words' trie is walked depth first."""
        order = sorted(range(len(words)), key=words.__getitem__)
        token, length, seams, holds, longest = self.token, self.length, self.seams, self._seam_holds, self.longest
        if len(seams) > 2_000_000:
            seams.clear()
        last: list[int] = [-1]  # last token of each prefix on the path from the root
        before = b""
        found: list[list[int]] = [[]] * len(words)
        for at in order:
            word = words[at]
            shared = _common(before, word)
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for begin in range(max(0, end - longest), end):
                    t = token.get(word[begin:end])
                    if t is None:
                        continue
                    if begin == 0:
                        break
                    pair = (last[begin], t)
                    ok = seams.get(pair)
                    if ok is None:
                        ok = seams[pair] = holds(*pair)
                    if ok:
                        break
                last.append(t)
            ids, end = [], len(word)
            while end:
                t = last[end]
                ids.append(t)
                end -= length[t]
            ids.reverse()
            found[at] = ids
            before = word
        return found


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while a[low] == b[low]:
        low += 1
    return low


class TrieCodec:
    """Column-wise encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        if not vocabulary.plain:
            raise ValueError("the trie encoder takes plain byte-level BPE vocabularies")
        trie, special = TrieEncoder(vocabulary), {s.encode(): [i] for s, i in vocabulary.special.items()}

        def encode(words: list[bytes]) -> list[list[int]]:
            ids = trie.encode(words)
            return [special.get(w, e) for w, e in zip(words, ids, strict=True)]

        self.table = WordTable(ByteLevelRule(tuple(vocabulary.special)), encode)
        pieces = [vocabulary.bytes_of.get(i, b"") for i in range(vocabulary.size)]
        self.piece_size = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.table.encode(column)

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> list[bytes]:
        """UTF-8 text of each row's ids; invalid bytes become U+FFFD as in the library."""
        sizes = self.piece_size[ids]
        data = self.piece_bytes[ragged(self.piece_start[ids], sizes)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(sizes)])[rows].tolist()
        return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(cuts, cuts[1:], strict=False)]


def codec(path: str) -> TrieCodec:
    return kept_table(("trie", path), lambda: TrieCodec(path))


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", digests_only: bool = False) -> DataFrame:
    """Encode each text, then decode its ids.

    Returns ``id_column, n_tokens, ids, decoded`` for every row; with
    ``digests_only`` the two large columns are replaced by
    ``ids_sha256, decoded_sha256`` (ids as little-endian unsigned 32-bit integers).
    Null text counts as empty.  Repeated rows stay; an empty table gives none.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part, text in slices(batch.rename_columns(["id", "text"]), "text"):
                ids, rows = tool.encode(text)
                decoded = tool.decode(ids, rows)
                cols = [part.column("id"), pa.array(np.diff(rows), pa.int64())]
                if digests_only:
                    raw, cuts = memoryview(ids.astype("<u4").tobytes()), (rows * 4).tolist()
                    cols.append(pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)], pa.string()))
                    cols.append(pa.array([hashlib.sha256(t).hexdigest() for t in decoded], pa.string()))
                else:
                    cols.append(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids.astype(np.int32))))
                    cols.append(pa.array(decoded, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", *(c.split()[0] for c in tail.split(", "))])

    out = docs.select(id_column, text_column).mapInArrow(run, f"id {kind}, n_tokens long, {tail}")
    return out.withColumnRenamed("id", id_column)


def recoded(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """All columns of ``docs``, each text replaced by what its ids decode to (null stays null)."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            plain = batch.rename_columns(names)
            for part, text in slices(plain, names[at]):
                ids, rows = tool.encode(text)
                null = part.column(at).is_null().to_numpy(zero_copy_only=False)
                decoded = pa.array(tool.decode(ids, rows), pa.binary(), mask=null).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], decoded, *part.columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

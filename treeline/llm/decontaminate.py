"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size: class ``U`` has the items of more than ``U / 2`` and at
most ``U`` shingles.  For each class a document is cut into blocks of ``U``
shingles, and two neighbouring blocks are a window, so that an item's copy lies
within a window of at most four times its size.  An item and a window that agree in one of
``HASHES`` MinHash values are a candidate (a containment of 0.8 gives a Jaccard
similarity of 0.19 at least, found with a probability over 0.9999).  A candidate is verified by exact
shingle containment of the item in the whole document.

The items are the stated query set: blocks of at most about ``BLOCK_SHINGLES`` item shingles are
broadcast (checked; more items make more blocks, each a pass over the documents).  No
document is shuffled.  Words are lower-cased and stripped of all but letters and
numbers; shingles are five words.  Items under five words and null texts match
nothing; repeated items and documents give repeated evidence only, one row for each
document row and item id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.shared import slices
from treeline.llm.words import shingle_hashes, word_hashes

HASHES = 48
THRESHOLD = 0.8
BLOCK_SHINGLES = 1 << 20
_random = np.random.default_rng(20240229)
_XOR = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)
_ODD = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


class Items:
    """MinHash values and shingles of a block of items, by size class."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        by_class: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            by_class.setdefault(1 << max(0, math.ceil(math.log2(len(s)))), []).append(i)
        self.classes: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]] = []
        for size, members in sorted(by_class.items()):
            flat = np.concatenate([sets[i] for i in members])
            cuts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in members])[:-1]])
            tables = []
            for k in range(HASHES):
                low = np.minimum.reduceat((flat ^ _XOR[k]) * _ODD[k], cuts)
                order = np.argsort(low, kind="stable")
                tables.append((low[order], np.array(members)[order]))
            self.classes.append((size, tables))

    def candidates(self, shingles: np.ndarray, rows: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that agree in a MinHash value of a window."""
        count = np.diff(rows)
        found: set[tuple[int, int]] = set()
        layout = []
        for size, tables in self.classes:
            blocks = -(-count // size)
            first = np.concatenate([[0], np.cumsum(blocks)])
            owner = np.repeat(np.arange(len(count)), blocks)
            starts = rows[:-1][owner] + (np.arange(first[-1]) - first[:-1][owner]) * size
            joined = owner[1:] == owner[:-1]  # a block and the next one of the same row
            layout.append((starts, owner, joined, tables))
        for k in range(HASHES):
            values = (shingles ^ _XOR[k]) * _ODD[k]
            for starts, owner, joined, tables in layout:
                low = np.minimum.reduceat(values, starts)
                low[:-1] = np.where(joined, np.minimum(low[:-1], low[1:]), low[:-1])
                wanted, members = tables[k]
                left = np.searchsorted(wanted, low)
                hit = np.flatnonzero(wanted[np.minimum(left, len(wanted) - 1)] == low)
                for h in hit:
                    stop = np.searchsorted(wanted, low[h], side="right")
                    found.update((int(owner[h]), int(m)) for m in members[left[h] : stop])
        return found

    def matches(self, text: pa.Array, threshold: float) -> list[tuple[int, int, int, int]]:
        """(row, item id, shared shingles, item shingles) of verified pairs of a text column."""
        shingles, rows = shingle_hashes(*word_hashes(text, normal=True), short=False)
        if not len(shingles) or not self.classes:
            return []
        best: dict[tuple[int, int], tuple[int, int]] = {}
        own, sorted_own = -1, None
        for row, item in sorted(self.candidates(shingles, rows)):
            if row != own:
                own, sorted_own = row, np.sort(shingles[rows[row] : rows[row + 1]])
            wanted = self.sets[item]
            at = np.minimum(np.searchsorted(sorted_own, wanted), len(sorted_own) - 1)
            shared = int((sorted_own[at] == wanted).sum())
            if shared >= threshold * len(wanted):
                key = (row, self.ids[item])
                if key not in best or shared * best[key][1] > best[key][0] * len(wanted):
                    best[key] = (shared, len(wanted))
        return [(row, item, *n) for (row, item), n in best.items()]


def item_blocks(items: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> Iterator[Items]:
    """The items in blocks of at most about ``block_shingles`` shingles, split by the hash of their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch, "text"):
                shingles, rows = shingle_hashes(*word_hashes(text, normal=True), short=False)
                sets = [np.unique(shingles[a:b]).view(np.int64).tolist() for a, b in zip(rows, rows[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    plain = items.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    sets = plain.mapInArrow(run, "id long, set array<long>").where("size(set) > 0")
    total = sets.agg(F.sum(F.size("set"))).first()[0] or 0
    blocks = max(1, -(-total // block_shingles))
    for k in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()  # about block_shingles numbers
        yield Items([r.id for r in rows], [np.array(r.set, np.int64).view(np.uint64) for r in rows])


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles``: documents that hold an item, ``n_shared / n_shingles >= threshold``."""
    spark, out = docs.sparkSession, None
    for block in item_blocks(items, block_shingles):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, text in slices(batch, "text"):
                    found = held.value.matches(text, threshold)
                    take = pa.array([m[0] for m in found], pa.int64())
                    cols = [part.column("doc_id").take(take), *(pa.array([m[i] for m in found], pa.int64()) for i in (1, 2, 3))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "n_shared", "n_shingles"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, n_shared long, n_shingles long")
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no item."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for block in item_blocks(items, block_shingles):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = [f"c{i}" for i in range(batch.num_columns)]
                for part, text in slices(batch.rename_columns(names), names[at]):
                    keep = np.ones(len(text), bool)
                    keep[[m[0] for m in held.value.matches(text, threshold)]] = False
                    yield part.filter(pa.array(keep)).rename_columns(batch.schema.names)

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles.

1. Five-word shingles of whole texts are hashed; their corpus frequency is estimated over all documents
   from ``SKETCH_ROWS`` rows of ``SKETCH_WIDTH`` counters: the least of a shingle's counters, each less the
   mean of the row's others.  Frequent shingles so have their frequency and all rare ones about the same
   small one, whatever the input's size.  A shingle weighs its count in the text times
   ``1 + ln(T / n) / ln T`` (``n``: its frequency, ``T``: all counts), between 1 and 2
   for one occurrence, so very common passages weigh least.
2. Improved consistent weighted sampling (Ioffe, 2010) draws ``BANDS * ROWS`` samples for each
   text; two texts agree in one with the probability of their weighted Jaccard
   similarity.  ``ROWS`` samples make a band.  Equal texts collapse to their least id first.
3. Texts that agree in a band are candidates; each candidate is verified by the exact
   weighted Jaccard similarity of the two texts.  In a bucket, however large, the least member is
   held against each other one (in one of at most ``SMALL`` members each), and verified links are joined to components.
4. A larger bucket that still holds several components is split without loss: texts with a similarity of the threshold
   share one of the rarest shingles that make up the rest of their weight (a prefix filter, Chaudhuri et al., 2006),
   so only members that share such a shingle still have to meet.  Groups of one family overlap, so those with the same least
   member become one where that sends fewer rows.  In each group the members outside its largest
   component are held in blocks (an index from shingles to members) against all its members, streamed by in slices;
   nothing is emitted but links that join components.  Strangers that share a frequent passage
   are so told apart without being compared, and members that are nearly alike without a row for each pair.
5. A document's class is the least id of its component.

Finding a pair is probabilistic: at a similarity of 0.8 a band agrees with a probability of 0.33
and one of all bands with 0.998; at 0.9 with over 0.9999.

Null and wordless texts are classes of their own; a text under five words has one
shingle; repeated ids share one class (of several texts of an id that agree with others in a band, the least is
compared); ids are cast to long, and rows whose id is null or no number have a null class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.components import components
from treeline.llm.shared import beside, mix, ragged, slices, staged
from treeline.llm.words import shingle_hashes, word_hashes

BANDS, ROWS = 16, 5
THRESHOLD = 0.8
SKETCH_ROWS, SKETCH_WIDTH = 3, 1 << 18
#: Members of a bucket that are all held against each other at once.
SMALL = 16
#: Bytes of text that a task holds of a group, and members of the group that stream by it, both about.
BLOCK_BYTES, SLICE_ROWS = 2 << 20, 4096
#: A leader's candidates are verified in groups of about this many.
GROUP = 64
#: Places of the bitmap that thins texts out before they are shuffled (2 MiB; a prime).
PLACES = 16_777_213


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of the Gamma(2, 1) law at 2**16 even steps, their reciprocals and logarithms."""
    x = np.linspace(0, 40, 1 << 18)
    cdf = 1 - (1 + x) * np.exp(-x)
    gamma = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), cdf, x)
    return gamma.astype(np.float32), (1 / gamma).astype(np.float32), np.log(gamma).astype(np.float32)


GAMMA, INVERSE, LOG_GAMMA = _tables()
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def counted(shingles: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of each row, their counts, offsets of the rows)."""
    owner = np.repeat(np.arange(len(rows) - 1, dtype=np.int64), np.diff(rows))
    order = np.lexsort((shingles, owner))
    s, o = shingles[order], owner[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    return s[at], np.diff(np.append(at, len(s))), np.searchsorted(o[at], np.arange(len(rows)))


def counters(shingles: np.ndarray, width: int = SKETCH_WIDTH) -> np.ndarray:
    """The counter of each shingle in each row, as places in one table."""
    bits = np.uint64(width - 1)
    return np.stack([((shingles >> np.uint64(20 * row)) & bits).astype(np.int64) + row * width for row in range(SKETCH_ROWS)])


def idf(shingles: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The weight of one occurrence; ``sketch`` has that of each counter, the largest is that of the least count."""
    return sketch[counters(shingles, len(sketch) // SKETCH_ROWS)].max(axis=0)


def weights(shingles: np.ndarray, counts: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return counts * idf(shingles, sketch)


def samples(shingles: np.ndarray, log_weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One row of ``BANDS * ROWS`` sample hashes for each non-empty row: the drawn shingle and its level."""
    starts = rows[:-1]
    out = np.empty((len(starts), len(SEEDS)), np.uint64)
    log_weight = log_weight.astype(np.float32)
    mask = np.uint64(0xFFFF)
    with np.errstate(over="ignore"):
        for k, seed in enumerate(SEEDS):
            x = (shingles ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            r_at = (x >> np.uint64(48)).astype(np.int32)
            beta = ((x >> np.uint64(32)) & mask).astype(np.float32) * np.float32(1 / 65536)
            level = np.floor(log_weight * INVERSE[r_at] + beta)
            cost = LOG_GAMMA[((x >> np.uint64(16)) & mask).astype(np.int32)] - GAMMA[r_at] * (level - beta + np.float32(1))
            bits = cost.view(np.uint32)
            ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
            tag = (shingles * np.uint64(0x9E3779B97F4A7C15) + level.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
            out[:, k] = np.minimum.reduceat((ordered << np.uint64(32)) | tag, starts) & np.uint64(0xFFFFFFFF)
    return out


def idf_table(docs: DataFrame) -> np.ndarray:
    """The weight of one occurrence for each counter, counted over all documents.

    A task sends one dense vector (fixed size, in segments); the result has ``SKETCH_ROWS * SKETCH_WIDTH`` numbers.
    """
    segments, size = 64, SKETCH_ROWS * SKETCH_WIDTH
    width = size // segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, text in slices(batch, "text"):
                shingles, _ = shingle_hashes(*word_hashes(text))
                total += np.bincount(counters(shingles).ravel(), minlength=size)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(segments)), pa.array([total[i * width : (i + 1) * width].astype("<i8").tobytes() for i in range(segments)])], names=["segment", "n"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for raw in batch.column("n").to_pylist():
                total += np.frombuffer(raw, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.astype("<i8").tobytes()])], names=["segment", "n"])

    parts = docs.select("text").mapInArrow(run, "segment long, n binary").groupBy("segment").applyInArrow(add, "segment long, n binary").collect()
    counts = np.zeros(size)
    for p in parts:
        counts[p.segment * width : (p.segment + 1) * width] = np.frombuffer(p.n, "<i8")
    occurrences = counts.sum() / SKETCH_ROWS
    total = max(3.0, occurrences)
    others = (occurrences - counts) / (SKETCH_WIDTH - 1)
    return (1 + np.log(total / np.maximum(counts - others, 1)) / np.log(total)).astype(np.float32)


def signatures(docs: DataFrame, sketch) -> DataFrame:
    """``(doc, copy, bands)``: id, hash of the text and one hash for each band (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch, "text", 1 << 20):
                s, n, rows = counted(*shingle_hashes(*word_hashes(text)))
                has = np.diff(rows) > 0
                bands = np.zeros((len(text), BANDS), np.uint64)
                if has.any():
                    log_weight = np.log(weights(s, n, sketch.value))
                    drawn = samples(s, log_weight, np.append(rows[:-1][has], len(s)))
                    with np.errstate(over="ignore"):
                        mixed = np.zeros((len(drawn), BANDS), np.uint64)
                        for r in range(ROWS):
                            mixed = mix(mixed * np.uint64(0x9E3779B97F4A7C15) + drawn[:, r::ROWS])
                    bands[has] = mixed
                cuts = pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]), pa.int32())
                lists = pa.ListArray.from_arrays(cuts, pa.array(bands[has].ravel().view(np.int64)))
                copy = pa.array([xxhash.xxh3_128_digest(t) for t in text.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc"), copy, lists], names=["doc", "copy", "bands"])

    return docs.mapInArrow(run, "doc long, copy binary, bands array<long>")


def thinned(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc`` may be in ``wanted``: all that are, and few others.

    A bitmap of fixed size is broadcast as a table of words; with very many wanted ids it only passes more rows on.
    """
    place = F.pmod("doc", F.lit(PLACES))
    word, bit = F.shiftright(place, 6).alias("word"), (place.bitwiseAND(F.lit(63))).cast("int")
    words = wanted.select(word, bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    placed = docs.select(*docs.columns, word, bit.alias("bit")).join(F.broadcast(words), "word")  # at most PLACES / 64 rows
    return placed.where(F.getbit("bits", F.col("bit")) == 1).select(*docs.columns)


def verified(pairs: DataFrame, texts: DataFrame, sketch, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` of ``a, b, n`` whose weighted Jaccard similarity is at least ``threshold``.

    A leader ``a`` meets its partners (about ``n`` of them) in groups of bounded expected size: rows are sorted
    by (leader, group) with the leader's text first, and compared as they stream by.
    """
    share = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP)))
    sized = pairs.select("a", "b", share.alias("part"))
    leaders = sized.select("a", "part").distinct().join(texts, F.col("a") == F.col("doc")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    members = sized.join(texts, F.col("b") == F.col("doc")).select("a", "part", "b", "text")
    rows = leaders.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for part, text in slices(batch, "text"):
                s, n, cuts = counted(*shingle_hashes(*word_hashes(text)))
                w = weights(s, n, sketch.value)
                out_a, out_b, score = [], [], []
                for i, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                    own = s[cuts[i] : cuts[i + 1]], w[cuts[i] : cuts[i + 1]]
                    if b is None:
                        held = own
                    else:
                        value = similarity(held, own)
                        if value >= threshold:
                            out_a.append(a)
                            out_b.append(b)
                            score.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    return rows.mapInArrow(run, "a long, b long, similarity double")


def similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted (shingles, weights)."""
    (s, v), (t, w) = left, right
    if not len(s) or not len(t):
        return 0.0
    at = np.minimum(np.searchsorted(s, t), len(s) - 1)
    both = s[at] == t
    low = float(np.minimum(v[at][both], w[both]).sum(dtype=np.float64))
    return low / (float(v.sum(dtype=np.float64)) + float(w.sum(dtype=np.float64)) - low)


def rarest(shingles: np.ndarray, weight: np.ndarray, rarity: np.ndarray, rows: np.ndarray, threshold: float) -> np.ndarray:
    """Places of each row's rarest shingles, until what is left weighs less than ``threshold`` of the row.

    Two rows whose least common shingle, in the order of falling ``rarity`` and then of the hash, is among
    neither's places have less than ``threshold`` of the heavier one's weight in common, and so a lower similarity.
    """
    owner = np.repeat(np.arange(len(rows) - 1, dtype=np.int64), np.diff(rows))
    order = np.lexsort((shingles, -rarity, owner))
    value = weight[order].astype(np.float64)
    before = np.concatenate([[0.0], np.cumsum(value)])
    total = before[rows[1:]] - before[rows[:-1]]
    passed = before[:-1] - np.repeat(before[rows[:-1]], np.diff(rows))
    return order[passed <= np.repeat(total, np.diff(rows)) * (1 - threshold + 1e-6)]


def split(docs: DataFrame, texts: DataFrame, sketch, threshold: float) -> DataFrame:
    """``(bucket, doc)``: the documents ``doc`` of ``docs`` by their rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch, "text"):
                s, n, rows = counted(*shingle_hashes(*word_hashes(text)))
                at = np.sort(rarest(s, weights(s, n, sketch.value), idf(s, sketch.value), rows, threshold))
                doc = np.repeat(part.column("doc").to_numpy(zero_copy_only=False), np.diff(rows))
                yield pa.RecordBatch.from_arrays([pa.array(s[at].view(np.int64)), pa.array(doc[at])], names=["bucket", "doc"])

    return _shared(staged(texts.join(docs, "doc", "left_semi").mapInArrow(run, "bucket long, doc long"), "rarest"))


def _shared(members: DataFrame) -> DataFrame:
    """The rows of ``(bucket, doc)`` whose bucket has others."""
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return beside(members, shared, "bucket").drop("n")


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``(bucket, doc, root)``: members with the least id of their component so far."""
    if roots is None:
        return members.withColumn("root", F.col("doc"))
    return members.join(roots, members["doc"] == roots["node"], "left").select("bucket", "doc", F.coalesce("root", "doc").alias("root"))


def _several(members: DataFrame) -> DataFrame:
    """``(bucket, doc, root, n)`` of the buckets that hold several components; ``n``: members of the bucket."""
    members = staged(members, "members")
    parts = members.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    several = parts.groupBy("bucket").agg(F.sum("size").alias("n"), F.count("*").alias("k")).where("k > 1").select("bucket", "n")
    return beside(members, several, "bucket")


def _first_meetings(members: DataFrame) -> DataFrame:
    """``(a, b, n)``: the least member of each bucket with all others; in a bucket of at most ``SMALL`` all with all."""
    sized = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc").alias("least"))
    placed = staged(beside(members, sized, "bucket"), "placed")  # read three times
    led = placed.where(f"n > {SMALL} and doc <> least").select(F.col("least").alias("a"), F.col("doc").alias("b"), "n")
    small = placed.where(f"n <= {SMALL}").select("bucket", F.col("doc").alias("b"), "n")
    pairs = small.select("bucket", F.col("b").alias("a")).join(small, "bucket").where("a < b").select("a", "b", "n")
    return led.unionByName(pairs).groupBy("a", "b").agg(F.max("n").alias("n"))


def _cut(members: DataFrame) -> DataFrame:
    """``members`` with the ``largest`` component of their bucket and the ``blocks`` and ``slices`` that it is dealt into."""
    parts = members.groupBy("bucket", "root").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
    facts = parts.groupBy("bucket").agg(F.max(F.struct("size", "root", "bytes")).alias("top"), F.sum("bytes").alias("bytes"), F.sum("size").alias("n"))
    blocks = F.ceil((F.col("bytes") - F.col("top.bytes")) / BLOCK_BYTES).alias("blocks")
    facts = facts.select("bucket", "n", F.col("top.root").alias("largest"), blocks, F.ceil(F.col("n") / SLICE_ROWS).alias("slices"))
    return beside(members, facts, "bucket").drop("n")


def _placed(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """``(bucket, merged, doc, root, largest, blocks, slices)``: the groups with several components, overlapping ones as one.

    The groups of a family of texts have nearly the same members.  All groups with the same least member become one,
    unless its blocks would send more rows than theirs; members of a group so still meet.
    """
    several = _several(groups).select("bucket", "doc", "root").join(texts.select("doc", F.octet_length("text").alias("bytes")), "doc")
    several = staged(several, "groups")
    apart = beside(several, several.groupBy("bucket").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "bucket").drop("n")
    apart = staged(apart, "groups")
    merged = apart.select(F.col("least").alias("bucket"), "doc", "root", "bytes", "least").distinct()
    apart, merged = staged(_cut(apart), "groups"), staged(_cut(merged), "groups")
    sent = F.sum(F.col("blocks") + F.when(F.col("root") != F.col("largest"), F.col("slices")).otherwise(0))
    costs = apart.groupBy("least").agg(sent.alias("apart")).join(merged.groupBy("least").agg(sent.alias("merged")), "least")
    cheaper = staged(costs.where("merged <= apart").select("least"), "merged")
    kept = merged.join(cheaper, "least", "left_semi").withColumn("merged", F.lit(True))
    return kept.unionByName(apart.join(cheaper, "least", "left_anti").withColumn("merged", F.lit(False)))


def settled(groups: DataFrame, texts: DataFrame, sketch, threshold: float) -> DataFrame:
    """Links ``(a, b)`` that join the components of each group of ``(bucket, doc, root)``, exactly.

    A group's members outside its largest component are dealt into blocks of about ``BLOCK_BYTES`` of text, all its
    members into slices of about ``SLICE_ROWS``; a task holds a block and compares it with a slice as it streams by.
    """
    placed = staged(_placed(groups, texts), "placed")  # read twice
    dealt = lambda k: F.pmod(F.xxhash64("doc"), F.col(k)).alias(k[:-1])
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1)).alias(k[:-1])
    held = placed.where("root <> largest").select("merged", "bucket", dealt("blocks"), each("slices"), F.lit(0).alias("side"), "doc", "root")
    passing = placed.select("merged", "bucket", each("blocks"), dealt("slices"), F.lit(1).alias("side"), "doc", "root")
    at = ["merged", "bucket", "block", "slice"]
    rows = held.unionByName(passing).join(texts, "doc").select(*at, "side", "doc", "root", "text")
    rows = rows.repartition(*at).sortWithinPartitions(*at, "side", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, Block()
        for batch in batches:
            for part, text in slices(batch, "text"):
                s, n, cuts = counted(*shingle_hashes(*word_hashes(text)))
                w = weights(s, n, sketch.value)
                links = []
                for i, (*place, side, doc, root) in enumerate(zip(*(part.column(c).to_pylist() for c in (*at, "side", "doc", "root")), strict=True)):
                    if place != now:
                        now, block = place, Block()
                    own = s[cuts[i] : cuts[i + 1]], w[cuts[i] : cuts[i + 1]]
                    if side == 0:
                        block.hold(doc, root, *own)
                    else:
                        links += [(a, doc) for a in block.links(root, *own, threshold)]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


class Block:
    """Texts of a group as an index from shingles to texts, and the components that their links have joined so far."""

    def __init__(self):
        self.docs, self.roots, self.sets, self.index, self.parent = [], [], [], None, {}

    def hold(self, doc: int, root: int, shingles: np.ndarray, weight: np.ndarray) -> None:
        self.docs.append(doc)
        self.roots.append(root)
        self.sets.append((shingles, weight.astype(np.float64)))

    def _indexed(self) -> tuple[np.ndarray, ...]:
        if self.index is None:
            s, w = (np.concatenate(x) for x in zip(*self.sets, strict=True))
            owner = np.repeat(np.arange(len(self.sets)), [len(x) for x, _ in self.sets])
            order = np.argsort(s, kind="stable")
            self.index = s[order], w[order], owner[order], np.array([x.sum() for _, x in self.sets])
            self.sets = []
        return self.index

    def _root(self, x: int) -> int:
        while self.parent.get(x, x) != x:
            x = self.parent[x]
        return x

    def links(self, root: int, shingles: np.ndarray, weight: np.ndarray, threshold: float) -> list[int]:
        """The held texts that are alike a text of component ``root`` and join it to another component."""
        if not self.docs:
            return []
        s, w, owner, total = self._indexed()
        low = np.searchsorted(s, shingles, side="left")
        size = np.searchsorted(s, shingles, side="right") - low
        at, weight = ragged(low, size), weight.astype(np.float64)
        common = np.bincount(owner[at], weights=np.minimum(w[at], np.repeat(weight, size)), minlength=len(total))
        found = []
        for k in np.flatnonzero(common >= threshold * (total + weight.sum() - common)):
            a, b = self._root(self.roots[k]), self._root(root)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                found.append(self.docs[k])
        return found


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, class_id`` for every row of ``docs``."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_column).try_cast("long").alias("doc"), F.col(text_column).alias("text"))
    sketch = spark.sparkContext.broadcast(idf_table(plain))  # a sketch of fixed size
    signed = staged(signatures(plain.where("doc is not null"), sketch), "signatures")
    alike = signed.where("size(bands) > 0").groupBy("copy").agg(F.min("doc").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    alike = staged(alike, "copies")
    band = alike.select("rep", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), F.col("rep").alias("doc"))
    members = staged(_shared(band), "buckets")
    wanted = members.select("doc").distinct()
    # Inner, as Spark would move a semi join below the bitmap and so shuffle all texts.
    texts = thinned(plain, wanted).join(wanted, "doc").groupBy("doc").agg(F.min("text").alias("text"))
    texts = staged(texts, "candidate-texts")
    pairs = staged(_first_meetings(members), "pairs")
    links = staged(verified(pairs, texts, sketch, threshold).select("a", "b"), "links")
    roots = None if links.isEmpty() else staged(components(links), "roots")
    unsettled = staged(_several(_rooted(members, roots)).where(f"n > {SMALL}").select("doc").distinct(), "unsettled")
    if not unsettled.isEmpty():
        groups = staged(split(unsettled, texts, sketch, threshold), "groups")
        more = staged(settled(_rooted(groups, roots), texts, sketch, threshold), "links")
        if not more.isEmpty():
            roots = staged(components(links.unionByName(more)), "roots")
    of_rep = alike.select("copy", "rep", "n")
    if roots is not None:
        of_rep = of_rep.join(roots, F.col("rep") == F.col("node"), "left").select("copy", F.coalesce("root", "rep").alias("class_id"), "n")
    else:
        of_rep = of_rep.withColumnRenamed("rep", "class_id")
    classes = beside(signed.where("size(bands) > 0").select("doc", "copy"), of_rep, "copy").groupBy("doc").agg(F.min("class_id").alias("class_id"))
    out = docs.select(F.col(id_column).alias("id"), F.col(id_column).try_cast("long").alias("doc")).join(classes, "doc", "left")
    return out.select(F.col("id").alias(id_column), F.coalesce("class_id", "doc").alias("class_id"))


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose id is that of their class; rows with a null id stay, of repeated rows of a kept id that with the least hash."""
    kept = near_duplicate_classes(docs, threshold).where("doc_id is not null and doc_id <> class_id").select("doc_id").distinct()
    rest = docs.join(kept, "doc_id", "left_anti")
    apart = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    row = F.struct(*docs.columns)
    once = rest.select("doc_id", apart.alias("_apart"), row.alias("_row")).groupBy("doc_id", "_apart").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return once.select("_row.*")

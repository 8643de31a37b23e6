"""Log-bilinear language model, trained with noise-contrastive estimation, and scores of whole texts.

1. Training words are counted over all documents: tasks count first, then one row a word and task is
   shuffled.  Words are 64-bit hashes whose lowest byte is a hash of the word's ending.
2. The model's symbols are the end of a text, every word with a count of ``MIN_COUNT`` or more (with
   very many of them those above the least count that leaves at most ``MAX_WORDS``, the bound of what is
   broadcast), and ``ENDINGS`` symbols that all rarer words share by their ending.  The vocabulary
   so follows the corpus until it reaches that bound; counts of words are never bounded.
3. Texts become codes and are dealt into blocks of about ``BLOCK_TOKENS`` tokens by a hash of id and
   text, in the order of ids and hashes: blocks depend on the table alone, not on its partitions.
4. The predicted vector is the sum of the vectors of the ``CONTEXT`` symbols before, weighted by place.
   Symbols in order of frequency form classes of equal size; a symbol's probability is that of its class
   times that within the class, both proportional to the exponent of an inner product plus a bias.
   Every training token is used once.  Blocks train one after another in rounds of 1, 1, 2, 4, 8 ..
   blocks; those of a round start from the same parameters, and each row of parameters then moves
   by the mean of the changes of the blocks that have its symbol.  Changes are summed as integers, so that
   neither partitions nor retries move a score.  The number of rounds grows with the input.
5. Matrix products give all scores of a class, and so the exact normalisers.  A rare word is
   weighted by its add-one share of its ending.  Counts of the ``NEAR_WORDS`` most frequent words are
   broadcast; those of all others are joined by word.

Null text is empty and holds its end alone; texts of any length are scored in whole; every row, repeated or
with a null id, gives one row; an empty table none.  Other columns are ignored.  Documents whose id's
crc32 (as text; null: empty text) has remainder 2 by 7 are held out of all counts and training.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.shared import filled, flat, mix, shared_dir, slices, staged
from treeline.llm.words import words

MAX_WORDS, MIN_COUNT, ENDINGS, NEAR_WORDS = 40_000, 4, 256, 1 << 19
WIDTH, CONTEXT = 16, 3
CLASS_NOISE, WORD_NOISE = 32, 2
BLOCK_TOKENS, BATCH_TOKENS, RATE, START = 1 << 21, 3072, 0.1, 0.05
#: Changes of parameters are summed in steps of this.
STEP = 2.0**-20
#: Logarithms of counts that come from joins are summed in steps of this.
LOG_STEP = 2.0**-40
#: Distinct words that a task counts before it sends them on.
TASK_WORDS = 1 << 20
SEGMENTS = 64
#: Bytes of text that are split into words at a time.
SLICE = 4 << 20
#: Tokens that are scored at a time, and rows of one matrix product.
SCORED_TOKENS, PRODUCT_ROWS = 1 << 17, 1024
_zstd = lambda raw: pa.Codec("zstd", 1).compress(raw, asbytes=True)
_unzstd = lambda raw, size: pa.Codec("zstd").decompress(raw, size, asbytes=True)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def endings(words: pa.Array) -> np.ndarray:
    """A hash below ``ENDINGS`` of the last three bytes of each word before at most three bytes of closing punctuation."""
    data, offsets = flat(words)
    start, end = offsets[:-1], offsets[1:].copy()
    closing = np.isin(np.arange(256), list(b".,;:!?"))
    for _ in range(3):
        end -= (end - start > 1) & closing[data[np.maximum(end - 1, 0)]] if len(data) else 0
    tail = np.zeros(len(words), np.uint64)
    for k in range(1, 4):
        tail = tail * np.uint64(256) + np.where(end - k >= start, data[np.maximum(end - k, 0)], 0).astype(np.uint64) if len(data) else tail
    return mix(tail) % np.uint64(ENDINGS)


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def hash_words(words: pa.Array, step: int = 1 << 16) -> np.ndarray:
    """64-bit hashes of words, polynomials of their bytes from running sums; the lowest byte tells the ending."""
    out = np.empty(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(words), step):
            data, cuts = flat(words.slice(a, step))
            up, down = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:-1])])
            found = (running[cuts[1:]] - running[cuts[:-1]]) * down[cuts[:-1]]
            out[a : a + step] = mix(found) // np.uint64(ENDINGS) * np.uint64(ENDINGS) + endings(words.slice(a, step))
    return out


def hashed_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words of A-Z lower-cased texts, the place of each word among them, offsets of the rows' words)."""
    found, rows = words(filled(pc.ascii_lower(text.cast(pa.string()))))
    if not len(found):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), rows
    coded = found.dictionary_encode()
    return hash_words(coded.dictionary.cast(pa.binary())), np.asarray(coded.indices), rows


def word_counts(docs: DataFrame) -> DataFrame:
    """``(h, n)``: all words of the training texts and their counts; ``h`` null: texts, their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(h)).astype(np.int64)

        def rows(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for batch in batches:
            keep = pa.array([not held_out(i) for i in batch.column("id").to_pylist()], pa.bool_())
            for _, text in slices(batch.filter(keep), "text", SLICE):
                h, at, _ = hashed_words(text)
                held.append((h, np.bincount(at, minlength=len(h))))
                size, ends = size + len(h), ends + len(text)
                if size > 2 * TASK_WORDS:
                    held = [added()]
                    size = len(held[0][0])
                    if size > TASK_WORDS:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*added())
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([ends], pa.int64())], names=["h", "n"])

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Symbols:
    """The model's symbols, in order of falling count, and the codes of words.

    A code is a place in ``words`` (hashes by falling count, hash), or beyond them the ending of
    any other word.  The first ``modelled`` words are symbols of their own.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, modelled: int, ends: int, tokens: int, distinct: int, endings: np.ndarray):
        """``endings``: (tokens, words) of the words that are not modelled, by ending."""
        self.words, self.counts, self.tokens, self.distinct = words, counts.astype(np.int64), tokens, distinct
        own = np.concatenate([[ends], counts[:modelled], endings[:, 0]]).astype(np.int64)  # end, words, endings
        order = np.argsort(-own, kind="stable")
        self.symbol_counts = own[order]
        place = np.empty(len(own), np.int32)
        place[order] = np.arange(len(own))
        self.end = int(place[0])
        self.end_count = ends
        rest = place[1 + modelled :]
        self.symbol_of = np.concatenate([place[1 : 1 + modelled], rest[(words[modelled:] & np.uint64(ENDINGS - 1)).astype(np.int64)], rest]).astype(np.uint16)
        self.share = np.concatenate([np.zeros(modelled), -np.log10(endings.sum(axis=1) + 1.0)])  # of a word not modelled: log10(c + 1) is added
        self.modelled = modelled
        self.per_class = math.ceil(math.sqrt(len(own)))
        self.by_hash = np.argsort(words)
        self.sorted = words[self.by_hash]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        n = len(self.words)
        far = n + (hashes & np.uint64(ENDINGS - 1)).astype(np.int64)
        if not n:
            return far
        at = np.minimum(np.searchsorted(self.sorted, hashes), n - 1)
        return np.where(self.sorted[at] == hashes, self.by_hash[at], far)

    def word_share(self, codes: np.ndarray) -> np.ndarray:
        """What a word that shares a symbol adds to its log10 probability, but for far words' log10(c + 1)."""
        own = codes < self.modelled
        near = codes < len(self.words)
        place = np.where(own, 0, self.modelled + np.where(near, (self.words[np.minimum(codes, len(self.words) - 1)] & np.uint64(ENDINGS - 1)).astype(np.int64) if len(self.words) else 0, codes - len(self.words)))
        return np.where(own, 0.0, self.share[np.minimum(place, len(self.share) - 1)] + np.where(near, self.log_count(codes), 0.0))

    def log_count(self, codes: np.ndarray) -> np.ndarray:
        """log10(c + 1), 0 for far words."""
        table = np.append(np.log10(self.counts + 1.0), 0.0)
        return table[np.minimum(codes, len(self.words))]


def symbols(counts: DataFrame) -> Symbols:
    """The symbols of the counted words; what comes to the driver is bounded by ``NEAR_WORDS``."""
    words = counts.where("h is not null")
    level = F.floor(F.log2("n") * 64).cast("int")
    sizes = dict(words.groupBy(level.alias("level")).count().collect())  # 64 rows for each doubling of the largest count

    def least_level(most: int, at_least: int) -> int:
        total, low = 0, max(sizes, default=0) + 1
        for found in sorted(sizes, reverse=True):
            total += sizes[found]
            if total > most or 2 ** (found / 64) < at_least - 1e-9:
                break
            low = found
        return low

    near, own = least_level(NEAR_WORDS, 1), least_level(MAX_WORDS, MIN_COUNT)
    leveled = words.withColumn("level", level)
    rows = leveled.where(F.col("level") >= near).select("h", "n", (F.col("level") >= own).alias("own")).toArrow()  # at most NEAR_WORDS rows
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.lexsort((h, -n))
    rest = leveled.where(F.col("level") < own).groupBy(F.col("h").bitwiseAND(F.lit(ENDINGS - 1)).alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    endings = np.zeros((ENDINGS, 2), np.int64)
    for r in rest:
        endings[r.ending] = r.n, r.k
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0)), F.count("*")).first()
    return Symbols(h[order], n[order], pc.sum(rows["own"]).as_py() or 0, total[1], total[0], total[2], endings)


def blocks_of(docs: DataFrame, held, n_blocks: int) -> DataFrame:
    """``(block, round, ids, sizes, tokens, codes, far)``: blocks of whole texts, a row each.

    ``codes`` are those of all words, without the ends; ``far`` has the hashes of the words that are not near.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch, "text", SLICE):
                distinct, at, rows = hashed_words(text)
                codes, h = held.value.codes(distinct)[at], distinct[at]
                far = codes >= len(held.value.words)
                far_rows = np.concatenate([[0], np.cumsum(far)])[rows]
                binary = lambda x, cuts, width: pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((cuts * width).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("deal"), part.column("id"), part.column("key"), binary(codes.astype("<i4"), rows, 4), binary(h[far].astype("<u8"), far_rows, 8)], names=["deal", "id", "key", "codes", "far"])

    def emit(deal: int, part: int, ids: list, codes: list[bytes], far: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(c) // 4 for c in codes], "<i4")
        raw = b"".join(codes)
        columns = [pa.array([deal << 24 | part]), pa.array([deal.bit_length()], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tobytes()]), pa.array([len(raw) // 4]), pa.array([_zstd(raw)]), pa.array([b"".join(far)])]
        return pa.RecordBatch.from_arrays(columns, names=["block", "round", "ids", "sizes", "tokens", "codes", "far"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, ids, codes, far, n = None, 0, [], [], [], 0
        for batch in batches:
            for deal, i, c, f in zip(*(batch.column(x).to_pylist() for x in ("deal", "id", "codes", "far")), strict=True):
                if ids and (deal != now or n > 8 * BLOCK_TOKENS):  # as bytes: twice a block, if many rows are alike
                    yield emit(now, part, ids, codes, far)
                    part, ids, codes, far, n = part + 1 if deal == now else 0, [], [], [], 0
                now, n = deal, n + len(c)
                ids.append(i)
                codes.append(c)
                far.append(f)
        if ids:
            yield emit(now, part, ids, codes, far)

    key = F.xxhash64("text")
    dealt = docs.select(F.pmod(F.xxhash64("id", key), F.lit(n_blocks)).alias("deal"), "id", key.alias("key"), "text")
    coded = dealt.mapInArrow(encode, "deal long, id long, key long, codes binary, far binary")
    tasks = min(n_blocks, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = coded.repartitionById(tasks, F.pmod("deal", F.lit(tasks)).cast("int")).sortWithinPartitions("deal", "id", "key")
    return ordered.mapInArrow(gather, "block long, round int, ids array<long>, sizes binary, tokens long, codes binary, far binary")


def _blocks(batch: pa.RecordBatch) -> Iterator[dict]:
    for row in range(batch.num_rows):
        value = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
        value["codes"] = np.frombuffer(_unzstd(value["codes"], 4 * value["tokens"]), "<i4")
        value["sizes"] = np.frombuffer(value["sizes"], "<i4").astype(np.int64)
        yield value


class Model:
    """One matrix of parameters: rows of symbols, of classes and of places; columns context vector, target vector, bias.

    ``target`` has the target vectors and biases of symbols and classes; a predicted vector has a last column of ones for them.
    """

    def __init__(self, n: int, per_class: int, matrix: np.ndarray):
        self.n, self.per_class, self.classes = n, per_class, -(-n // per_class)
        self.matrix = matrix
        self.context = np.ascontiguousarray(matrix[:n, :WIDTH])
        self.target = np.ascontiguousarray(matrix[: n + self.classes, WIDTH:])
        self.place = np.ascontiguousarray(matrix[n + self.classes :, :WIDTH])

    @classmethod
    def start(cls, counts: np.ndarray, per_class: int) -> Model:
        n, classes = len(counts), -(-len(counts) // per_class)
        random = np.random.default_rng(7)
        matrix = random.normal(0, 0.1, (n + classes + CONTEXT, 2 * WIDTH + 1)).astype(np.float32)
        total = np.add.reduceat(counts + 1.0, np.arange(0, n, per_class))
        matrix[:n, -1] = np.log((counts + 1) / np.repeat(total, per_class)[:n])
        matrix[n : n + classes, -1] = np.log(total / total.sum())
        matrix[n + classes :, :WIDTH] = 1
        return cls(n, per_class, matrix)

    def as_matrix(self) -> np.ndarray:
        out = self.matrix.copy()
        out[: self.n, :WIDTH], out[: self.n + self.classes, WIDTH:], out[self.n + self.classes :, :WIDTH] = self.context, self.target, self.place
        return out

    def predicted(self, before: np.ndarray) -> np.ndarray:
        out = np.ones((before.shape[1], WIDTH + 1), np.float32)
        out[:, :WIDTH] = sum(self.context[before[k]] * self.place[k] for k in range(CONTEXT))
        return out

    def log_probabilities(self, w: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural logarithm of the normalised probability of each symbol after its context."""
        out = np.zeros(len(w))
        for a in range(0, len(w), SCORED_TOKENS):
            own = w[a : a + SCORED_TOKENS].astype(np.int64)
            q = self.predicted(before[:, a : a + SCORED_TOKENS])
            c = own // self.per_class
            found = out[a : a + SCORED_TOKENS]
            for b in range(0, len(own), PRODUCT_ROWS):
                found[b : b + PRODUCT_ROWS] = self._log_softmax(q[b : b + PRODUCT_ROWS], self.n, self.n + self.classes, c[b : b + PRODUCT_ROWS])
            order = np.argsort(c.astype(np.uint16), kind="stable")
            cuts = np.searchsorted(c[order], np.arange(self.classes + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                low, high = k * self.per_class, min(self.n, (k + 1) * self.per_class)
                for b in range(cuts[k], cuts[k + 1], PRODUCT_ROWS):
                    rows = order[b : min(b + PRODUCT_ROWS, cuts[k + 1])]
                    found[rows] += self._log_softmax(q[rows], low, high, own[rows] - low)
        return out

    def _log_softmax(self, q: np.ndarray, low: int, high: int, at: np.ndarray) -> np.ndarray:
        s = q @ self.target[low:high].T
        own = s[np.arange(len(s)), at]
        if s.max() > 60:  # beyond this exponents leave the range of 32 bits
            top = s.max(axis=1)
            own -= top
            s -= top[:, None]
        return own - np.log(np.exp(s, out=s) @ np.ones(high - low, np.float32))


def in_context(codes: np.ndarray, sizes: np.ndarray, known: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all tokens with their ends, the ``CONTEXT`` symbols before each, offsets of the texts); ends stand before a text."""
    ends = np.cumsum(sizes + 1)
    w = np.full(int(ends[-1]) if len(ends) else 0, known.end, np.uint16)
    is_word = np.ones(len(w), bool)
    is_word[ends - 1] = False
    w[is_word] = known.symbol_of[codes]
    before = np.full((CONTEXT, len(w)), known.end, np.uint16)
    first = ends - sizes - 1
    for k in range(CONTEXT):
        before[k, k + 1 :] = w[: -(k + 1)]
        for j in range(k + 1):  # the first places of a text
            spots = (first + j)[sizes + 1 > j]
            before[k, spots] = known.end
    return w, before, first


def _moved(table: np.ndarray, memory: np.ndarray, at: np.ndarray, order: np.ndarray, rows: np.ndarray) -> None:
    """An Adagrad step of the rows of ``table`` by the sums of ``rows`` with the same index; ``order`` sorts ``at``, ``rows`` are in that order."""
    ordered = at[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    where = ordered[first]
    total = np.add.reduceat(rows, first, axis=0)
    held = memory[where]
    held += total * total
    memory[where] = held
    total *= RATE
    total /= np.sqrt(held, out=held)
    table[where] += total


def train_block(model: Model, w: np.ndarray, before: np.ndarray, counts: np.ndarray, seed: int) -> None:
    """One pass of noise-contrastive estimation over a block's training tokens: classes, then symbols of the class."""
    random = np.random.default_rng(seed)
    n, size = model.n, model.per_class
    total = np.add.reduceat(counts + 1.0, np.arange(0, n, size))
    law = np.cumsum(total)
    shift = np.log(CLASS_NOISE * total / law[-1]).astype(np.float32)
    classes, symbols = model.target[n:], model.target[:n]
    memory = Model(n, size, np.full_like(model.matrix, START))
    for a in range(0, len(w), BATCH_TOKENS):
        own, past = w[a : a + BATCH_TOKENS], before[:, a : a + BATCH_TOKENS]
        c = own // np.uint16(size)
        q = model.predicted(past)
        # classes, against noise that the batch shares
        noise = np.searchsorted(law, random.random(CLASS_NOISE) * law[-1], side="right").clip(max=model.classes - 1).astype(np.uint16)
        t, t_noise = classes[c], classes[noise]
        good = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, t) - shift[c]))
        bad = -1 / (1 + np.exp(shift[noise] - q @ t_noise.T))
        dq = good[:, None] * t
        dq += bad @ t_noise
        at = np.concatenate([c, noise])
        order = np.argsort(at, kind="stable")
        _moved(classes, memory.target[n:], at, order, np.concatenate([good[:, None] * q, bad.T @ q])[order])
        # symbols, against others of their class
        low = c * np.uint16(size)
        width = np.minimum(size, n - low.astype(np.int32))
        others = low + (random.random((WORD_NOISE, len(own)), np.float32) * width).astype(np.uint16)
        np.minimum(others, (low + (width - 1).astype(np.uint16)), out=others)
        log_noise = np.log(np.float32(WORD_NOISE) / width, dtype=np.float32)
        at = np.concatenate([own, others.ravel()])
        target = symbols[at].reshape(1 + WORD_NOISE, len(own), WIDTH + 1)
        odds = np.einsum("ij,kij->ki", q, target)
        odds -= log_noise
        np.exp(odds, out=odds)
        odds += 1
        np.reciprocal(odds, out=odds)  # 1 - probability that it is no noise
        odds[1:] -= 1
        dq += np.einsum("ki,kij->ij", odds, target)
        order = np.argsort(at, kind="stable")
        _moved(symbols, memory.target[:n], at, order, odds.ravel()[order][:, None] * q[order % len(own)])
        # contexts
        step = np.stack([np.einsum("ij,ij->j", dq[:, :WIDTH], model.context[past[k]]) for k in range(CONTEXT)]) / len(own)
        at = past.ravel()
        order = np.argsort(at, kind="stable")
        rows = dq[order % len(own), :WIDTH]
        rows *= model.place[order // len(own)]
        _moved(model.context, memory.context, at, order, rows)
        memory.place += step * step
        model.place += 0.1 * RATE * step / np.sqrt(memory.place)


def changes(rows: DataFrame) -> DataFrame:
    """``(segment, at, touches, change)`` summed over all tasks: rows of the parameter matrix, by ranges of the row."""
    width = 2 * WIDTH + 1

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        total, touches = np.zeros((0, width), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for at, n, change in zip(*(batch.column(c).to_pylist() for c in ("at", "touches", "change")), strict=True):
                at = np.frombuffer(at, "<i4")
                if len(at) and at[-1] >= size:
                    size = int(at[-1]) + 1
                    total, touches = np.pad(total, ((0, size - len(total)), (0, 0))), np.pad(touches, (0, size - len(touches)))
                total[at] += np.frombuffer(change, "<i8").reshape(-1, width)
                touches[at] += np.frombuffer(n, "<i4")
        at = np.flatnonzero(touches).astype("<i4")
        columns = [[key[0].as_py()], [at.tobytes()], [touches[at].astype("<i8").tobytes()], [total[at].tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["segment", "at", "touches", "change"])

    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.groupBy("segment").applyInArrow(add, "segment long, at binary, touches binary, change binary")


def train(blocks: DataFrame, rounds: list[int], held) -> Model:
    """The model after all rounds; the driver holds one matrix of parameters, bounded by ``MAX_WORDS``."""
    known: Symbols = held.value
    counts = known.symbol_counts
    model = Model.start(counts, known.per_class)
    spark = blocks.sparkSession

    for number in rounds:
        start = spark.sparkContext.broadcast(model.as_matrix())  # bounded by MAX_WORDS

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            total = touches = None
            known = held.value
            for batch in batches:
                for block in _blocks(batch):
                    w, before, _ = in_context(block["codes"], block["sizes"], known)
                    kept = np.repeat([not held_out(i) for i in block["ids"]], block["sizes"] + 1)
                    if not kept.any():
                        continue
                    own = Model(len(known.symbol_counts), known.per_class, start.value)
                    train_block(own, w[kept], before[:, kept], known.symbol_counts, block["block"])
                    change = np.rint((own.as_matrix() - start.value) / np.float32(STEP)).astype(np.int64)
                    if total is None:
                        total, touches = np.zeros_like(change), np.zeros(len(change), np.int32)
                    total += change
                    touches += change.any(axis=1)
            if total is not None:
                at = np.flatnonzero(touches)
                for segment, part in enumerate(np.split(at, np.searchsorted(at, np.arange(1, SEGMENTS) * -(-len(touches) // SEGMENTS)))):
                    if len(part):
                        columns = [part.astype("<i4").tobytes(), touches[part].astype("<i4").tobytes(), total[part].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], names=["segment", "at", "touches", "change"])

        sent = blocks.where(F.col("round") == number).drop("far").mapInArrow(run, "segment long, at binary, touches binary, change binary")
        matrix = model.as_matrix().astype(np.float64)
        for r in changes(sent).collect():  # one row for each segment
            at = np.frombuffer(r.at, "<i4")
            matrix[at] += np.frombuffer(r.change, "<i8").reshape(len(at), -1) * STEP / np.frombuffer(r.touches, "<i8")[:, None]
        model = Model(len(counts), known.per_class, matrix.astype(np.float32))
        start.unpersist()
    return model


def scored(blocks: DataFrame, held, model) -> DataFrame:
    """A row for each text: ``block, place, doc_id, held_out, n_tokens, n_known, base_score, score, far``; far words' counts are still to be added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parameters = held.value, model.value
        lm = Model(len(known.symbol_counts), known.per_class, parameters)
        for batch in batches:
            for block in _blocks(batch):
                codes, sizes = block["codes"], block["sizes"]
                w, before, first = in_context(codes, sizes, known)
                logs = lm.log_probabilities(w, before) / math.log(10)
                n = sizes + 1
                words = np.concatenate([[0], np.cumsum(sizes)])
                in_text = lambda x: np.array([x[a:b].sum() for a, b in zip(words, words[1:], strict=False)])
                base = in_text(known.log_count(codes)) + math.log10(known.end_count + 1) - n * math.log10(known.tokens + known.distinct + 1)
                score = np.add.reduceat(logs, first) + in_text(known.word_share(codes))
                near = codes < len(known.words)
                far = np.frombuffer(block["far"], "<i8")
                cuts = np.concatenate([[0], np.cumsum(~near)])[words]
                columns = [
                    pa.array(np.full(len(n), block["block"])), pa.array(np.arange(len(n)), pa.int64()), pa.array(block["ids"], pa.int64()), pa.array([held_out(i) for i in block["ids"]], pa.bool_()),
                    pa.array(n), pa.array(in_text(near.astype(np.int64)).astype(np.int64) + (known.end_count > 0)), pa.array(base), pa.array(score),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(far)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "far"])

    schema = "block long, place long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, far array<long>"
    return blocks.mapInArrow(run, schema)


def fitted(docs: DataFrame) -> tuple[DataFrame, DataFrame, Symbols, Model]:
    """(counts, blocks, symbols, model) of ``docs`` with the columns ``id, text``."""
    spark = docs.sparkSession
    counts = staged(word_counts(docs), "lm-counts")
    known = symbols(counts)
    held = spark.sparkContext.broadcast(known)  # bounded by NEAR_WORDS
    path = shared_dir(spark, "lm-blocks")
    made = blocks_of(docs, held, max(1, math.ceil(known.tokens / BLOCK_TOKENS)))
    made.write.partitionBy("round").parquet(path)
    blocks = spark.read.schema(made.schema).parquet(path)
    rounds = [r["round"] for r in blocks.select("round").distinct().orderBy("round").collect()]  # grows with the logarithm of the input
    return counts, blocks, known, train(blocks, rounds, held)


def lm_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``base_score``: log10 probability under the add-one unigram law; ``score``: under the model.
    """
    context = docs.sparkSession.sparkContext
    counts, blocks, known, model = fitted(docs.select(F.col("doc_id").cast("long").alias("id"), "text"))
    rows = staged(scored(blocks, context.broadcast(known), context.broadcast(model.as_matrix())), "lm-scores")
    # counts of far words, joined by word; sums of integers don't depend on their order
    entries = rows.where("size(far) > 0").select("block", "place", F.explode("far").alias("h")).groupBy("block", "place", "h").agg(F.count("*").alias("k"))
    least = int(known.counts[-1]) if len(known.counts) else 1
    found = entries.join(counts.where(F.col("h").isNotNull() & (F.col("n") < least)), "h")
    logs = F.round(F.log10(F.col("n") + 1) / LOG_STEP).cast("long") * F.col("k")
    far = found.groupBy("block", "place").agg(F.sum("k").alias("far_known"), (F.sum(logs.cast("decimal(38,0)")).cast("double") * LOG_STEP).alias("far_log"))
    joined = rows.drop("far").join(far, ["block", "place"], "left")
    add = lambda name, more: (F.col(name) + F.coalesce(F.col(more), F.lit(0))).alias(name)
    return joined.select("doc_id", "held_out", "n_tokens", add("n_known", "far_known"), F.lit(known.tokens).cast("long").alias("train_tokens"), add("base_score", "far_log"), add("score", "far_log"))

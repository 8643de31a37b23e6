"""Line dedup, quality rules, near-dedup, decontamination and language model against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeline.llm import components, decontaminate, lbl, line_dedup, near_dedup, quality, shared

WORD = re.compile(r"[^\x20\x09-\x0d]+")
VOCABULARY = [f"{a}{b}" for a in "bcdfghkl" for b in ("an", "ore", "ium", "est", "ing", "é")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_line_dedup(spark):
    hot, pair, short = "This Line is everywhere, truly", "only in two documents at all", "short"
    texts = {i: "\n".join([prose(8, i), hot if i % 2 else f"  {hot.upper()}\t", short, "Ünïcode line with ä é í ó ú"] + [pair] * (i in (3, 4)) + [hot] * (i == 5)) for i in range(12)}
    texts |= {20: None, 21: "", 22: "\n\n", 23: hot}
    rows = list(texts.items())
    docs = spark.createDataFrame([(i, t, "x") for i, t in [*rows, rows[2]]], "doc_id long, text string, h string")
    keys = collections.defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in (t or "").split("\n"):
            keys[key(line)].add(i)
    got = line_dedup.dedup_lines(docs, digests_only=True).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        lines = (texts[r.doc_id] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(keys[key(x)]) < 3 or max(keys[key(x)]) == r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    full = line_dedup.dedup_lines(docs)
    assert full.columns == docs.columns and full.where("doc_id = 20").first().text is None
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_null_ids(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(None, line), (1, line), (2, line), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(docs).collect()) == [(0, ""), (0, "x"), (1, ""), (2, line)]


@pytest.fixture(scope="module")
def judged(spark):
    texts = [(i, prose(60 + i, i)) for i in range(30)] + [(100 + i, " | ".join(f"Z{k % 7}{i}" for k in range(80))) for i in range(5)]
    texts += [(200, None), (201, ""), (202, " \n "), (203, "a b c " * 40), (204, "#$ %& " + prose(60, 5)), (205, "one\ntwo\none\n\n\ntwo"), (None, prose(70, 9)), (1, prose(61, 1))]
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100, 0, 0), (None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, quality.judge_quality(docs, labels)


def test_base_counts(judged):
    docs, _, out = judged
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = r.text or ""
        w = WORD.findall(t)
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)


def test_scores_and_verdicts_recomputed(spark, judged):
    docs, labels, out = judged
    hashed = docs.select("doc_id", quality._ngrams(F.col("_words")).alias("grams")) if "_words" in docs.columns else quality.with_words(docs).select("doc_id", "text", quality._ngrams(F.col("_words")).alias("grams"), quality.fold(F.col("doc_id")).alias("fold"))
    given = hashed.collect()
    trusted = {r.doc_id for r in quality.trusted_ids(labels).collect()}
    assert trusted == set(range(20)) - {5}
    raw = collections.Counter(b for r in given for b in r.grams)
    n = sum(raw.values())
    target = {k: collections.Counter(b for r in given if r.doc_id in trusted and r.fold != k for b in r.grams) for k in range(2)}

    def score(r):
        own, total, out = target[r.fold], sum(target[r.fold].values()), 0.0
        for b in r.grams:
            p = (raw[b] + 1) / (n + quality.BUCKETS)
            out += math.log((own[b] + quality.PRIOR * quality.BUCKETS * p) / (total + quality.PRIOR * quality.BUCKETS) / p)
        return out / len(r.grams) if r.grams else 0.0

    want = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", round(score(r), 5)) for r in given)
    rows = out.collect()
    assert want == sorted((r.doc_id is None, r.doc_id or 0, r.text or "", round(r.score, 5)) for r in rows)
    cut = np.quantile([r.score for r in rows if r.doc_id in trusted and not r.base_failed], 1 - quality.KEPT_TRUSTED)
    assert all(r.kept == (not r.base_failed and r.score >= cut - 1e-12) for r in rows)
    assert len({r.fold for r in given if r.doc_id in trusted}) == 2


def test_quality_of_a_very_long_text(spark, judged):
    docs, labels, _ = judged
    long = prose(200_000, 8)
    r = quality.judge_quality(docs.unionByName(spark.createDataFrame([(900, long, 0)], docs.schema)), labels).where("doc_id = 900").first()
    assert (r.n_words, r.word_chars) == (200_000, len(long) - 199_999)


def test_junk_scores_lower(judged):
    rows = {r.doc_id: r.score for r in judged[2].collect()}
    assert max(rows[100 + i] for i in range(1, 5)) < min(rows[i] for i in range(20, 30))


def test_quality_of_empty_tables(spark, judged):
    docs, labels, _ = judged
    assert quality.judge_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.judge_quality(docs, labels.limit(0)).collect()} == {0.0}


def test_every_trusted_row_counts(spark, judged):
    docs, _, _ = judged
    many = spark.range(150_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    held = docs.where("doc_id is not null").select("doc_id").distinct().selectExpr("doc_id", "1 as quality", "0 as toxic")
    assert quality.fitted(docs, many) == quality.fitted(docs, held)


def test_trusted_ids_beyond_the_bitmap(spark, judged, monkeypatch):
    docs, labels, _ = judged
    want = quality.fitted(docs, labels)
    monkeypatch.setattr(quality, "MAX_WORDS", 0)
    assert quality.fitted(docs, labels) == want
    named, by_name = (t.withColumn("doc_id", F.col("doc_id").cast("string")) for t in (docs, labels))
    assert sum(r.trusted for r in quality.marker(by_name)(named).collect()) == 20
    low = spark.createDataFrame([(-(1 << 63),), (-65,), (-1,), (0,), (63,), ((1 << 63) - 1,)], "doc_id long")
    monkeypatch.undo()
    marked = quality.marker(low.where("doc_id <> -1").selectExpr("doc_id", "1 as quality", "0 as toxic"))(low.unionByName(spark.range(1, 5).toDF("doc_id")))
    assert {r.doc_id for r in marked.where("trusted").collect()} == {-(1 << 63), -65, 0, 63, (1 << 63) - 1}


@pytest.mark.parametrize("bins", [2, 3, 4096])
def test_percentile_is_exact(spark, monkeypatch, bins):
    monkeypatch.setattr(quality, "BINS", bins)
    values = [0.1 * (i * i % 37) - 1 for i in range(200)] + [-1e6] * 3 + [0.3] * 90 + [None]
    df = spark.createDataFrame([(x,) for x in values], "score double")
    for share in (0.0, 0.010000000000000009, 0.013, 0.5, 0.77, 1.0):
        assert quality.percentile(df, "score", share) == df.agg(F.percentile("score", F.lit(share))).first()[0]
    assert quality.percentile(df.limit(0), "score", 0.5) is None


def test_trusted_bound(spark):
    labels = spark.range(1000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert quality.trusted_ids(labels, 2000).count() == 1000
    assert 50 <= quality.trusted_ids(labels, 100).count() <= 160


def near_fixture():
    r, texts = random.Random(4), {}
    for g in range(12):
        words = prose(120, 1000 + g).split()
        for k in range(r.randint(1, 9)):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 4, 12])):
                own[r.randrange(len(own))] = r.choice(VOCABULARY) + "x"
            texts[len(texts) * 3] = " ".join(own)
    boiler = prose(60, 77)
    for k in range(40):
        texts[1000 + k] = boiler + " " + prose(90, 5000 + k)
    return texts | {2000: "too short", 2001: "too short", 2002: "", 2003: None, 2004: " ", 2005: prose(30000, 3)}


def shingles(t):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicate_classes(spark):
    texts = near_fixture()
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(0, texts[0], 1), (None, texts[0], 2)], "doc_id long, text string, class_id int")
    got = near_dedup.near_duplicate_classes(docs).collect()
    assert len(got) == docs.count() and [r.class_id for r in got if r.doc_id is None] == [None]
    cls, sets = {r.doc_id: r.class_id for r in got if r.doc_id is not None}, {i: shingles(t) for i, t in texts.items()}
    near = missed = 0
    for a, b in itertools.combinations(texts, 2):
        j = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
        if j >= 0.85:
            near += 1
            missed += cls[a] != cls[b]
        elif not sets[a] & sets[b]:
            assert cls[a] != cls[b]
    assert near > 20 and missed == 0
    assert len({cls[1000 + k] for k in range(40)}) == 40  # a shared passage alone joins nothing
    assert cls[2000] == cls[2001] and len({cls[2002], cls[2003], cls[2004]}) == 3
    assert all(cls[c] == c for c in set(cls.values()))
    kept = near_dedup.one_of_each_class(docs.where("doc_id is not null")).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(cls.values()))
    assert near_dedup.near_duplicate_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block, piece, hot", [(2 << 20, 4096, 1024), (20_000, 300, 4)])
def test_large_bucket_led_by_strangers(spark, monkeypatch, block, piece, hot):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(near_dedup, "SLICE_ROWS", piece)
    monkeypatch.setattr(shared, "HOT", hot)
    texts, want = {k: prose(60, 9000 + k) for k in range(25)}, {k: k for k in range(25)}  # strangers have the least ids
    for g, n in enumerate([1000, *[2] * 20]):
        least = len(texts)
        for _ in range(n):
            want[len(texts)] = least
            texts[len(texts)] = f"{prose(100, 700 + g)} own{len(texts)}"
    chain, least = prose(300, 5).split(), len(texts)
    places = random.Random(2).sample(range(30), 30)
    for k in range(30):  # only neighbours in the chain are alike
        want[least + k] = least
        texts[least + k] = " ".join(chain[6 * places[k] : 6 * places[k] + 100])
    one_bucket = lambda docs, idf: docs.select("doc", F.unhex(F.md5("text")).alias("copy"), F.array(F.lit(1).cast("long")).alias("bands"))
    monkeypatch.setattr(near_dedup, "signatures", one_bucket)
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {x.doc_id: x.class_id for x in got.collect()} == want


def test_rarest_shingles_of_similar_texts_meet():
    r = np.random.default_rng(5)
    sketch = r.choice([1.0, 1.3, 1.7, 2.0], near_dedup.SKETCH_ROWS << 8).astype(np.float32)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = []
    for _ in range(150):
        own = np.unique(np.concatenate([base[r.random(40) < r.uniform(0.8, 1)], r.integers(0, 1 << 63, r.integers(0, 6), dtype=np.uint64)]))
        sets.append((own, (1 + (own % 7 == 0) * r.integers(0, 2, len(own))) * near_dedup.idf(own, sketch)))
    rows = np.concatenate([[0], np.cumsum([len(s) for s, _ in sets])])
    s, w = np.concatenate([s for s, _ in sets]), np.concatenate([w for _, w in sets])
    at = near_dedup.rarest(s, w, near_dedup.idf(s, sketch), rows, 0.8)
    first = [set(s[at[(at >= a) & (at < b)]].tolist()) for a, b in itertools.pairwise(rows)]
    alike = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if near_dedup.similarity(sets[i], sets[j]) >= 0.8]
    assert alike and all(first[i] & first[j] for i, j in alike)
    assert np.mean([len(f) / len(x) for f, (x, _) in zip(first, sets, strict=True)]) < 0.4


def test_strangers_of_one_bucket_are_not_compared(spark, monkeypatch):
    boiler = prose(90, 3)
    texts = {k: f"{boiler} {prose(70, 40_000 + k)}" for k in range(300)} | {900: f"{boiler} {prose(70, 40_007)} end", 901: None}
    compared = []
    for name in ("verified", "settled"):
        check = getattr(near_dedup, name)
        monkeypatch.setattr(near_dedup, name, lambda rows, *rest, check=check: (compared.append(rows.count()), check(rows, *rest))[1])
    monkeypatch.setattr(near_dedup, "signatures", lambda docs, sketch: docs.select("doc", F.unhex(F.md5("text")).alias("copy"), F.when(F.col("text").isNotNull(), F.array(F.lit(1).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("bands")))
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {k: 7 if k == 900 else k for k in texts}
    assert sum(compared) < 1000  # of 45,150 pairs


def test_overlapping_groups_become_one_where_that_sends_less(spark, monkeypatch):
    groups = {10: [*range(10)], 11: [0, *range(5, 15)], 12: [3, 4], 13: [20, 21]}
    rows = spark.createDataFrame([(b, d, min(d, 20)) for b, docs in groups.items() for d in docs], "bucket long, doc long, root long")
    texts = spark.createDataFrame([(d, "word") for d in range(30)], "doc long, text string")
    whole, apart = ({(r.bucket, r.merged): {x.doc for x in got if x.bucket == r.bucket} for r in got} for got in map(_placed_at(monkeypatch, rows, texts), (1 << 20, 1)))
    assert whole == {(0, True): set(range(15)), (3, True): {3, 4}}  # 20 and 21 are one component already
    assert apart == {(10, False): set(groups[10]), (11, False): set(groups[11]), (3, True): {3, 4}}


def _placed_at(monkeypatch, rows, texts):
    def placed(size):
        monkeypatch.setattr(near_dedup, "BLOCK_BYTES", size)
        return near_dedup._placed(rows, texts).collect()

    return placed


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_hot_keys_join_like_others(spark, n):
    rows = spark.range(n).selectExpr("id as v", "if(id % 3 = 0, -1, id % 1500) as k")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("k <> 7")
    key = ["k", "v", "n", "least"]
    got = shared.beside(rows, facts, "k").select(key).collect()
    assert sorted(got) == sorted(rows.join(facts, "k").select(key).collect()) and len(got) >= n // 3


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("7", "same words"), ("x", "same words"), (None, "same words"), ("9", "same words")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.class_id) for r in near_dedup.near_duplicate_classes(docs).collect()) == [("7", 7), ("9", 7), ("None", None), ("x", None)]


def test_repeated_id_with_other_texts_keeps_a_defined_row(spark):
    docs = spark.createDataFrame([(1, prose(30, k)) for k in range(5)] + [(2, prose(40, 9))], "doc_id long, text string")
    kept = {tuple(sorted((r.doc_id, r.text) for r in near_dedup.one_of_each_class(docs.repartition(n)).collect())) for n in (1, 3)}
    assert len(kept) == 1 and [i for i, _ in kept.pop()] == [1, 2]


def test_samples_agree_with_the_similarity():
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 600, dtype=np.uint64)
    weight = r.uniform(1, 4, 600)
    agree = []
    for trial in range(60):
        a, b = pool[trial : trial + 100], pool[trial + 20 : trial + 120]
        wa, wb = weight[trial : trial + 100], weight[trial + 20 : trial + 120]
        drawn = [near_dedup.samples(s, np.log(w), np.array([0, 100])) for s, w in ((a, wa), (b, wb))]
        both = wa[20:].sum()
        agree.append(((drawn[0] == drawn[1]).mean(), both / (wa.sum() + wb.sum() - both)))
    got, want = np.mean(agree, axis=0)
    assert abs(got - want) < 0.03


@pytest.mark.parametrize(("n", "joins"), [([1] * 3000, 1), ([1, 1, 1], 1), ([5000] + [1] * 200, 3), ([], 1)])
def test_beside_has_one_join_unless_some_keys_are_hot(spark, n, joins):
    facts = spark.createDataFrame([(k, x) for k, x in enumerate(n)], "k long, n long")
    rows = spark.range(4000).select((F.col("id") % 3500).alias("k"), F.col("id").alias("at"))
    found = shared.beside(rows, facts, "k")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == joins
    assert sorted((r.k, r["at"], r.n) for r in found.collect()) == sorted((i % 3500, i, n[i % 3500]) for i in range(4000) if i % 3500 < len(n))


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root)}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == y for x, y in want.items())


def test_decontamination(spark):
    items = {i: prose(n, 300 + i) for i, n in enumerate([14, 20, 36, 59, 8, 5, 200])}
    texts = {0: prose(500, 1), 1: prose(300, 2) + " " + items[0] + " " + prose(4000, 3), 2: items[1].upper().replace(" ", ", "), 3: None, 4: "", 5: " ".join(items[2].split()[:10]), 6: items[5], 7: prose(50, 4) + "\n" + items[6] + "\n" + items[3], 8: items[4]}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(None, items[0], 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items.items(), (1, items[1]), (90, None), (91, "a b"), (None, items[0])], "item_id long, text string")
    norm = lambda t: [x for x in (re.sub(r"\W", "", w) for w in WORD.findall((t or "").lower())) if x]
    sets = lambda t: {tuple(w[i : i + 5]) for w in [norm(t)] for i in range(len(w) - 4)}
    want = {(d, i) for d, t in texts.items() for i, q in items.items() if sets(q) and len(sets(q) & sets(t)) >= 0.8 * len(sets(q))}
    for block in (1 << 20, 40):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, block_shingles=block).collect()}
        assert got == want | {(None, 0)}
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(texts) - {d for d, _ in want})
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.fixture(scope="module")
def spoken():
    """Texts of a first-order chain of words, and odd ones."""
    r = random.Random(6)
    chain = {w: r.sample(VOCABULARY, 3) for w in VOCABULARY}

    def walk(n):
        w, out = r.choice(VOCABULARY), []
        for _ in range(n):
            out.append(w)
            w = r.choice(chain[w])
        return " ".join(out)

    texts = {i: walk(r.randint(20, 400)).title() + f" rare{i % 40}ly Once{i}." for i in range(200)} | {500: None, 501: "", 502: "never seen words", 503: "\x0b\t", 504: walk(30000)}
    return [*((i, t, 0) for i, t in texts.items()), (None, "bore", 0), (3, "twice", 0), (4, "same", 0), (4, "same", 0)]


def spoken_tokens(t):
    return WORD.findall(lower(t or "")) + [None]


def is_held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def told(rows):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows)


@pytest.mark.parametrize("bounds", [(65_000, 1 << 20, 1 << 21), (20, 60, 4000)])
def test_language_model(spark, spoken, monkeypatch, bounds):
    for name, value in zip(("MAX_WORDS", "NEAR_WORDS", "BLOCK_TOKENS"), bounds, strict=True):
        monkeypatch.setattr(lbl, name, value)
    docs = spark.createDataFrame(spoken, "doc_id long, text string, score int")
    rows = lbl.lm_scores(docs).collect()
    c = collections.Counter(x for i, t, _ in spoken if not is_held(i) for x in spoken_tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i is not None, i or 0, is_held(i), len(spoken_tokens(t)), sum(c[x] > 0 for x in spoken_tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in spoken_tokens(t)), 5)) for i, t, _ in spoken)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)
    assert got == want
    test = [r for r in rows if r.held_out and r.n_tokens < 1000]
    gain = sum(r.score - r.base_score for r in test) / sum(r.n_tokens for r in test)
    assert gain > (0.3 if bounds[0] > 100 else 0.01)
    # neither partitions nor order move a score
    for tasks in (1, 7, 32):
        assert told(lbl.lm_scores(docs.repartition(tasks).orderBy(F.rand(tasks))).collect()) == told(rows)


def test_scores_recomputed_in_plain_python(spark, spoken, monkeypatch):
    monkeypatch.setattr(lbl, "MAX_WORDS", 20)
    monkeypatch.setattr(lbl, "NEAR_WORDS", 60)
    monkeypatch.setattr(lbl, "BLOCK_TOKENS", 4000)
    docs = spark.createDataFrame(spoken, "doc_id long, text string, score int")
    rows = told(lbl.lm_scores(docs).collect())
    counts, _, known, model = lbl.fitted(docs.select(F.col("doc_id").alias("id"), "text"))
    assert known.modelled == 20 and 20 < len(known.words) <= 60 < counts.count()
    c = collections.Counter(x for i, t, _ in spoken if not is_held(i) for x in spoken_tokens(t))
    own = set(known.words[: known.modelled].tolist())
    hash_of = lambda w: int(lbl.hash_words(pa.array([w.encode()], pa.binary()))[0])
    ending = lambda w: hash_of(w) % lbl.ENDINGS
    rare = collections.Counter()
    for w, k in c.items():
        if w is not None and hash_of(w) not in own:
            rare[ending(w)] += k + 1
    place = {int(h): int(s) for h, s in zip(known.words[: known.modelled], known.symbol_of, strict=False)}

    def symbol(w):
        if w is None:
            return known.end
        return place.get(hash_of(w), int(known.symbol_of[len(known.words) + ending(w)]))

    m, classes = model.matrix.astype(float), model.classes
    target, bias, n = m[:, lbl.WIDTH : -1], m[:, -1], model.n

    def log_softmax(q, low, high, at):
        s = [float(target[k] @ q + bias[k]) for k in range(low, high)]
        top = max(s)
        return s[at - low] - top - math.log(sum(math.exp(x - top) for x in s))

    for has_id, i, _, _, _, score in random.Random(1).sample([r for r in rows if r[2] < 200], 25):
        text = next(t for j, t, _ in spoken if (j is not None, j or 0) == (has_id, i)) if i not in (3, 4) else None
        if text is None:
            continue
        want, past = 0.0, [known.end] * lbl.CONTEXT
        for w in spoken_tokens(text):
            s = symbol(w)
            q = sum(m[past[k], : lbl.WIDTH] * m[n + classes + k, : lbl.WIDTH] for k in range(lbl.CONTEXT))
            k = s // model.per_class
            want += (log_softmax(q, n, n + classes, n + k) + log_softmax(q, k * model.per_class, min(n, (k + 1) * model.per_class), s)) / math.log(10)
            if w is not None and hash_of(w) not in own:
                want += math.log10((c[w] + 1) / (rare[ending(w)] + 1))
            past = [s, *past[:-1]]
        assert abs(want - score) < 1e-3 * max(1, abs(want))


def test_language_model_without_rows(spark, spoken):
    docs = spark.createDataFrame(spoken, "doc_id long, text string, score int")
    assert lbl.lm_scores(docs.limit(0)).count() == 0
    held = lbl.lm_scores(docs.where("doc_id = 1")).collect()  # nothing to train from
    assert is_held(1) and [(r.doc_id, r.n_known, r.train_tokens) for r in held] == [(1, 0, 0)]


def test_model_is_normalised():
    counts = np.array([50, 40, 30, 12, 9, 5, 2])
    model = lbl.Model.start(counts, 3)
    r = np.random.default_rng(1)
    w = r.integers(0, 7, 4000).astype(np.uint16)
    before = np.stack([np.roll(w, k + 1) for k in range(lbl.CONTEXT)])
    lbl.train_block(model, w, before, counts, 3)
    past = np.repeat(before[:, 5:6], 7, axis=1)
    assert abs(np.exp(model.log_probabilities(np.arange(7, dtype=np.uint16), past)).sum() - 1) < 1e-5

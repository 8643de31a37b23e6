"""Golden cases and invariants of the operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from treeline.functions import content, formats, globs, hashing, paths
from treeline.operators import cache, chunks, diff, graph, index, logs, merge3, rollup, stats
from treeline.sources import files, sinks


def one(spark, column, *values):
    """The values of an expression over single strings."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_size_buckets(spark):
    sizes = [0, 255, 256, 1023, 1024, 4095, 4096, 16383, 16384, 65535, 65536, 262143, 262144, 1048575, 1048576, 4194303, 4194304, 16777215, 16777216]
    rows = spark.createDataFrame([(s,) for s in sizes], "size long").select("size", content.bucket_index(F.col("size")).alias("b")).collect()
    assert [r.b for r in sorted(rows)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9]


def test_histogram(spark):
    sizes = spark.createDataFrame([(100,), (200,), (2000000,), (20000000,)], "size long")
    assert [(r.label, r["count"], r.bytes) for r in stats.size_histogram(sizes).orderBy("bucket").collect()] == [("<256B", 2, 300), ("1-4MB", 1, 2000000), (">16MB", 1, 20000000)]
    assert stats.size_histogram(sizes.limit(0)).count() == 0
    assert {r.bytes_pct for r in stats.size_histogram(spark.createDataFrame([(0,)], "size long")).collect()} == {0.0}


def test_parse_size(spark):
    given = ["1K", "100K", "1M", "2G", "1k", "7", "10MBx", "1GB", "", "K", "-1", "1.5M", " 10", "9223372036854775807", "9223372036854775808", "9007199254740992K", "99999999999999999999"]
    want = [1024, 102400, 1 << 20, 2 << 30, 1024, 7, *[None] * 7, 2**63 - 1, None, None, None]
    assert one(spark, formats.parse_size, *given) == want


def test_log_lines(spark):
    good = "[app L7 sto ]    +1.234s     s3 put_object(delta_index): end (1230ms)"
    bad = ["[app L9 xxx ] +1.0s x", "[app L1 cmd ] NaNs x", "[app L1 cmd ] infs x", "plain", "[app L1 cmd ] +1.0s "]
    rows = logs.parse_lines(spark.createDataFrame([(x,) for x in [good, *bad]], "line string")).collect()
    assert [(r.layer, r.elapsed_secs, r.depth, r.text) for r in rows] == [("L7", 1.234, 2, "s3 put_object(delta_index): end (1230ms)")]


def lines(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "file long, line_no long, label string, layer string, depth int, kind string, micros long")


def test_spans(spark):
    found = logs.spans(lines(spark, ("a", "L1", 0, "start", 0), ("a", "L1", 0, "end", 5), ("a", "L1", 0, "start", 10), ("a", "L1", 0, "end", 18), ("b", "L1", 0, "end", 20), ("c", "L1", 0, "start", 21))).collect()
    assert sorted((r.label, r.end_micros - r.start_micros) for r in found) == [("a", 5), ("a", 8)]
    nested = logs.spans(lines(spark, ("a", "L1", 0, "start", 0), ("a", "L1", 1, "start", 1), ("a", "L1", 1, "end", 2), ("a", "L1", 0, "end", 9))).collect()
    assert sorted((r.depth, r.start_micros, r.end_micros) for r in nested) == [(0, 0, 9), (1, 1, 2)]


def test_spans_equal_a_stack(spark):
    random.seed(3)
    rows = [(random.choice("ab"), "L1", 0, random.choice(["start", "end"]), i) for i in range(300)]
    stacks, want = {"a": [], "b": []}, []
    for label, _, _, kind, at in rows:
        if kind == "start":
            stacks[label].append(at)
        elif stacks[label]:
            want.append((label, stacks[label].pop(), at))
    assert sorted((r.label, r.start_micros, r.end_micros) for r in logs.spans(lines(spark, *rows)).collect()) == sorted(want)


def test_layer_totals(spark):
    spans = spark.createDataFrame([("ls", "L1", 0, 0, 10), ("scan", "L1", 1, 0, 3), ("store", "L7", 1, 0, 1)], "label string, layer string, depth int, start_micros long, end_micros long")
    assert [(r.layer, r.total_micros, r.share_pct) for r in logs.layer_totals(spans).collect()] == [("L1", 10, 100.0), ("L7", 1, 10.0)]


@pytest.mark.parametrize(
    ("rule", "hits", "misses"),
    [
        ("target/", ["target", "sub/target", "a/b/target"], ["targets"]),
        ("/target", ["target"], ["sub/target"]),
        ("**/*.pyc", ["sub/foo.pyc", "foo.pyc"], ["foo.py"]),
        ("*.log", ["a.log", "x/b.log"], ["a.logs"]),
        ("\\#x", ["#x"], ["x"]),
        ("\\!x", ["!x"], ["x"]),
        ("foo?ar", [], ["foobar"]),
        ("foo[ab]", [], ["fooa"]),
    ],
)
def test_patterns(spark, rule, hits, misses):
    assert one(spark, lambda p: globs.section_matches(p, [rule]), *hits, *misses) == [True] * len(hits) + [False] * len(misses)


def test_negation_and_pruning(spark):
    rules = ["logs/", "!logs/keep.log"]
    assert one(spark, lambda p: globs.section_matches(p, rules), "logs", "logs/keep.log") == [True, False]
    assert one(spark, lambda p: globs.is_pruned(p, {"": rules}), "logs", "logs/keep.log", "x") == [True, True, False]
    assert one(spark, lambda p: globs.rules_match(p, {"a": ["/x"]}), "a/x", "x", "b/a/x") == [True, False, False]
    assert set(globs.rules_in_scope({"": [], "a": [], "a/b": [], "c": []}, "a")) == {"", "a", "a/b"}


def test_paths(spark):
    assert one(spark, lambda p: paths.normalise(p, "w/x"), "../y", "../../..", "/a/./b/", "", ".") == ["w/y", None, "a/b", "w/x", "w/x"]
    assert one(spark, lambda p: paths.in_scope(p, ["foo"]), "foo", "foo/a", "foo.txt", "foobar") == [True, True, False, False]
    assert one(spark, lambda p: paths.in_scope_range(p, "foo"), "foo", "foo/a", "foo.txt", "foobar") == [True, True, False, False]
    assert one(spark, paths.ancestors, "a/b/c", "a") == [["", "a", "a/b"], [""]]
    assert one(spark, paths.parent, "a/b", "a") == ["a", ""]


def test_content_types(spark):
    samples = {"jpeg": b"\xff\xd8\xff1", "png": b"\x89PNG\r\n\x1a\n", "webp": b"RIFF1234WEBP", "gzip": b"\x1f\x8b", "zlib": b"\x78\x5e", "text": "é\n".encode(), "binary": b"a\x00"}
    rows = [(k, v) for k, v in samples.items()] + [("binary", "a".encode() * 1023 + "é".encode()), ("text", b""), ("text", b"\t\n\r"), ("binary", b"\x0e")]
    found = spark.createDataFrame(rows, "want string, content binary").select("want", content.content_type(F.col("content")).alias("got")).collect()
    assert all(r.want == r.got for r in found), found


def test_hashes(spark):
    row = spark.range(1).select(hashing.empty_tree_hash().alias("h"), hashing.hash_prefix(F.lit("ff" * 32), 10).alias("p")).first()
    import hashlib

    assert row.h == hashlib.sha256(b'\xed\xf1{"kind":"normal","entries":[]}').hexdigest()
    assert row.p == 1023 and hashing.optimal_bits(100_000, 0.01) == 958506


def test_bloom_bits_wrap(spark):
    given = "ff" * 32
    want = [((2**64 - 1) * (1 + i)) % 2**64 % 958506 for i in range(7)]
    assert spark.range(1).select(hashing.bloom_bits(F.lit(given), 958506).alias("b")).first().b == want


def test_bloom_bits_of_any_size(spark):
    hashes = [random.Random(i).randbytes(32).hex() for i in range(50)]
    for m in (63, 958506, 2**32 + 15, 2**47):
        for given, bits in zip(hashes, one(spark, lambda h, m=m: hashing.bloom_bits(h, m), *hashes), strict=True):
            h1, h2 = (int.from_bytes(bytes.fromhex(given)[k : k + 8], "little") for k in (0, 8))
            assert bits == [(h1 + i * h2) % 2**64 % m for i in range(7)]


def test_bloom_filter_in_place(spark):
    hashes = [random.Random(i).randbytes(32).hex() for i in range(400)]
    size = {"n": 100, "p": 0.3}  # small: many hashes that were not inserted pass
    m = hashing.optimal_bits(**size)
    places = {h: {(int.from_bytes(bytes.fromhex(h)[:8], "little") + i * int.from_bytes(bytes.fromhex(h)[8:16], "little")) % 2**64 % m for i in range(7)} for h in hashes}
    held = set().union(*(places[h] for h in hashes[:30]))
    wanted = spark.createDataFrame([(h,) for h in [*hashes, None]], "hash string")
    bits = index.bloom_table(spark.createDataFrame([(h,) for h in [*hashes[:30], hashes[0]]], "hash string"), **size)
    assert sorted(r.bit for r in bits.collect()) == sorted(held)
    found = index.may_contain(wanted, bits, **size)
    want = sorted(h for h in hashes if places[h] <= held)
    assert 30 < len(want) < 400 and sorted(r.hash for r in found.collect()) == want
    assert not index.may_contain(wanted, bits.limit(0), **size).count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(hash" not in plan and "hashpartitioning(bit" not in plan  # no row for each bit is shuffled


SNAP = "path string, kind string, hash string, size long, mode string, mtime_secs long, target string"


def snap(spark, *rows):
    return spark.createDataFrame([(p, k, h, 1, m, 0, t) for p, k, h, m, t in rows], SNAP)


def test_diff_kinds(spark):
    base = snap(spark, ("a", "blob", "1", None, None), ("b", "blob", "1", None, None), ("c", "symlink", None, None, "x"), ("d", "blob", "1", None, None))
    target = snap(spark, ("a", "blob", "1", None, None), ("b", "blob", "1", "755", None), ("c", "symlink", None, None, "y"), ("d", "symlink", None, None, "z"), ("e", "blob", "2", None, None))
    assert sorted((r.path, r.change) for r in diff.diff(base, target).collect()) == [("b", "M"), ("c", "M"), ("d", "M"), ("e", "A")]
    assert diff.diff(base, base).count() == 0
    after = diff.apply_changes(base, diff.diff(base, target))
    assert diff.diff(after, target).count() == 0


def test_diff_of_empty(spark):
    base = snap(spark, ("a", "blob", "1", None, None))
    assert [r.change for r in diff.diff(base, base.limit(0)).collect()] == ["D"]
    assert [r.change for r in diff.diff(base.limit(0), base).collect()] == ["A"]


def test_rollups_agree(spark):
    leaves = spark.createDataFrame([("a/x", "1" * 64, 3, None, 5), ("a/b/y", "2" * 64, 4, "755", None), ("z", "3" * 64, 5, None, 9)], "path string, hash string, size long, mode string, mtime_secs long")
    totals = {r.path: (r["size"], r.blob_count, r.mtime_secs) for r in rollup.directory_totals(leaves).collect()}
    assert totals == {"": (12, 3, 9), "a": (7, 2, 5), "a/b": (4, 1, None)}
    tree = {r.path: (r.hash, r["size"]) for r in rollup.merkle(leaves).collect()}
    assert {p: s for p, (_, s) in tree.items()} == {p: v[0] for p, v in totals.items()}
    moved = {r.path: r.hash for r in rollup.merkle(leaves.withColumn("size", F.col("size") + F.when(F.col("path") == "z", 1).otherwise(0))).collect()}
    assert moved["a"] == tree["a"][0] and moved[""] != tree[""][0]


def test_git_context(spark):
    rows = spark.createDataFrame([("a/.git/config",), ("a/x/y",), ("b/z",), ("c/.gitx",)], "path string")
    assert sorted(r.path for r in diff.git_context(rows).collect()) == ["a/.git/config", "a/x/y"]


def test_reachability_stops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "e"), ("c", "a")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "hash string")
    assert sorted(r.hash for r in graph.reachable(roots, edges).collect()) == ["a", "b", "c", "d", "e"]
    assert sorted(r.hash for r in graph.reachable(roots, edges, spark.createDataFrame([("d",)], "hash string")).collect()) == ["a", "b", "c"]


def test_racy_rows_never_hit(spark):
    now = 1000
    files_ = spark.createDataFrame([("old", 5, 900, 0), ("new", 5, 998, 0)], "path string, size long, mtime_secs long, mtime_nanos int")
    scanned = files_.withColumn("hash", F.lit("h")).withColumn("cache_hit", F.lit(False))
    rows = cache.refreshed(scanned, now)
    assert {r.path: r.is_unsafe for r in rows.collect()} == {"old": False, "new": True}
    assert {r.path: r.cached_hash for r in cache.cache_hits(files_, rows).collect()} == {"old": "h", "new": None}


def test_cache_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("foo", 1, 0, 1, "h", False), ("foo/a", 1, 0, 1, "h", False), ("foo.txt", 1, 0, 1, "h", False)], files.STAT_SCHEMA)
    empty = files.stat_cache(spark, str(tmp_path / "none"))
    assert empty.count() == 0
    assert sinks.write_cache_if_dirty(empty, rows, str(tmp_path / "c"))
    back = files.stat_cache(spark, str(tmp_path / "c"))
    assert not sinks.write_cache_if_dirty(back, rows, str(tmp_path / "d"))
    assert sorted(r.path for r in files.stat_cache(spark, str(tmp_path / "c"), "foo").collect()) == ["foo", "foo/a"]


def test_later_entry_wins(spark):
    entries = spark.createDataFrame([("h", 0, "inline", 1), ("h", 2, "pack", 5), ("h", 1, "pack", 7)], "hash string, generation int, kind string, length long")
    assert [(r.kind, r.length) for r in index.latest_entries(entries).collect()] == [("pack", 5)]


def test_resolve(spark):
    entries = spark.createDataFrame([("a", "inline", b"xy", None, None, None), ("b", "pack", None, "p", 2, 3), ("c", "standalone", None, None, None, None)], files.INDEX_SCHEMA.replace(", generation bigint", ""))
    packs = spark.createDataFrame([("p", b"\xed\xe10123456")], "pack_hash string, bytes binary")
    assert {r.hash: r.bytes and bytes(r.bytes) for r in index.resolve(entries, packs).collect()} == {"a": b"xy", "b": b"234", "c": None}


def test_working_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"")
    rows = {r.path: r for r in files.working_tree(spark, str(tmp_path)).unionByName(files.empty_files(spark, str(tmp_path))).collect()}
    import hashlib

    assert set(rows) == {"d/a.txt", "b.txt"} and rows["d/a.txt"].hash == hashlib.sha256(b"\xed\xf0hello").hexdigest() and rows["d/a.txt"]["size"] == 5
    assert [r.path for r in files.working_tree(spark, str(tmp_path), scopes=["d"]).collect()] == ["d/a.txt"]
    assert {(r.path, r["size"]) for r in files.object_listing(spark, str(tmp_path)).collect()} == {("d/a.txt", 5)}


def test_io_records(spark, tmp_path):
    path = tmp_path / "io.jsonl"
    path.write_text('{"ts":"t1","cmd":"push","writes":1}\n\nbroken\n{"ts":"t2","cmd":"pull","writes":2}\n{bad\n')
    assert sorted(r.cmd for r in files.io_records(spark, str(path)).where("cmd is not null").collect()) == ["pull", "push"]
    assert [r.cmd for r in files.recent_io_records(spark, str(path), 2).collect()] == ["pull"]
    assert [r.line_no for r in files.numbered_lines(spark, str(path)).orderBy("line_no").collect()] == [1, 2, 3, 4, 5]


def test_stubs(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt.snap-stub").write_text('{"hash":"1","size":5}')
    (tmp_path / "d/.snap-stub").write_text('{"target_type":"tree","hash":"2","size":9,"blob_count":3}')
    (tmp_path / "d/in.snap-stub").write_text('{"hash":"3","size":1}')
    found = {r.path: (r.target_type, r.blob_count) for r in files.stubs(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": ("blob", 0), "d": ("tree", 3)}


def text(*lines_):
    return "".join(f"{x}\n" for x in lines_).encode()


@pytest.mark.parametrize(
    ("base", "local", "remote", "want"),
    [
        (text("a"), text("a", "x"), text("a", "y"), text("a", "x", "y")),
        (text("a"), text("l"), text("r"), None),
        (text("a"), text("l"), text("a"), text("a", "l")),
        (text(1, 2, 3), text(2, 3, "x"), text(1, 2, 3, "y"), text(1, 2, 3, "x", "y")),
        (text(1, 2, 3), text(2, 3), text(2, 3), text(2, 3)),
        (text("a"), text("a", "a"), text("a"), text("a", "a")),
        (b"", b"", text("a", "b", "c"), text("a", "b", "c")),
        (None, None, None, b""),
        (text(": 100:0;a", ": 400:0;b"), text(": 100:0;a", ": 400:0;b", ": 200:0;c"), text(": 100:0;a", ": 400:0;b", ": 300:0;d"), text(": 100:0;a", ": 200:0;c", ": 300:0;d", ": 400:0;b")),
    ],
)
def test_merge(base, local, remote, want):
    assert merge3.merge(base, local, remote) == want


def test_matching_is_longest():
    random.seed(1)
    for _ in range(500):
        a, b = ([bytes([random.choice(b"abc")]) for _ in range(random.randint(0, 9))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for k, y in enumerate(b):
                table[i + 1][k + 1] = table[i][k] + 1 if x == y else max(table[i][k + 1], table[i + 1][k])
        pairs = merge3.matching(a, b)
        assert len(pairs) == table[-1][-1] and all(a[i] == b[k] for i, k in pairs)


def test_chunks_resynchronise():
    data = random.Random(5).randbytes(200_000)
    ends = chunks.cut_points(data, 256, 1024, 4096)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(s <= 4096 for s in sizes) and all(s > 256 for s in sizes[:-1])
    shifted = {e - 3 for e in chunks.cut_points(b"abc" + data, 256, 1024, 4096)}
    assert len(shifted & set(ends)) > 0.9 * len(ends)
    assert chunks.cut_points(b"", 256, 1024, 4096) == [] and chunks.cut_points(b"x", 256, 1024, 4096) == [1]


def test_streams(spark, tmp_path):
    from treeline.streaming import live

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"ts":"2024-01-01T00:10:00Z","cmd":"push","writes":1}\n{"ts":"2024-01-01T00:20:00Z","cmd":"push","writes":2}\n')
    totals = live.running_io_totals(live.io_stream(spark, str(tmp_path / "in")))
    run = totals.writeStream.outputMode("complete").format("memory").queryName("io_totals").start()
    run.processAllAvailable()
    run.stop()
    assert [(r.cmd, r.runs, r.writes) for r in spark.table("io_totals").collect()] == [("push", 2, 3)]


def test_numbered_over_partitions(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 as k").repartition(5)
    ranked = stats.numbered(rows, F.desc("k")).collect()
    assert sorted((r["rank"], r.k) for r in ranked) == [(i + 1, 999 - i) for i in range(1000)]
    assert stats.newest_half(rows.limit(0), "k").count() == 0
    assert sorted(r.k for r in stats.newest_half(rows.where("k < 5"), "k").collect()) == [2, 3, 4]


def test_three_way_of_symlinks_and_empty_directories(spark):
    base = snap(spark, ("l", "symlink", None, None, "x"), ("m", "symlink", None, None, "x"), ("f", "blob", "1", None, None))
    local = snap(spark, ("l", "symlink", None, None, "y"), ("m", "symlink", None, None, "y"), ("f", "symlink", None, None, "z"), ("d", "empty_dir", None, None, None), ("n", "symlink", None, None, "p"), ("k", "empty_dir", None, None, None))
    remote = snap(spark, ("l", "symlink", None, None, "y"), ("m", "symlink", None, None, "w"), ("d", "empty_dir", None, None, None), ("n", "symlink", None, None, "p"), ("k", "symlink", None, None, "p"))
    got = {r.path: r.outcome for r in diff.three_way(base, local, remote).collect()}
    assert got == {"l": "clean", "m": "conflict", "f": "conflict", "d": "clean", "n": "clean", "k": "conflict"}
    assert {r.path: r.action for r in diff.restore_plan(base, local).collect()} == {"l": "restore", "m": "restore", "f": "restore", "d": "delete", "n": "delete", "k": "delete"}


def test_base_hash_needs_the_whole_time_and_a_blob(spark):
    base = spark.createDataFrame([(p, k, 5, 100, n, p * 2) for p, k, n in (("a", "blob", 7), ("b", "blob", 8), ("c", "symlink", 7))], "path string, kind string, size long, mtime_secs long, mtime_nanos long, hash string")
    files = spark.createDataFrame([(p, 5, 100, 7) for p in "abc"], "path string, size long, mtime_secs long, mtime_nanos long")
    rows = spark.createDataFrame([], "path string, mtime_secs long, mtime_nanos long, fs_size long, hash string, is_unsafe boolean")
    assert sorted((r.path, r.source, r.hash) for r in cache.hash_source(files, rows, base, 1000).collect()) == [("a", "base", "aa"), ("b", "read", None), ("c", "read", None)]


def test_escape_only_at_the_very_start():
    assert [globs.parse_pattern(x).glob for x in ("\\#a", "\\!a", "!\\#a", "!a")] == ["#a", "!a", "\\#a", "a"]


def test_compression_methods(spark):
    import zstandard

    frame = zstandard.ZstdCompressor().compress(b"plain text")
    rows = [(b"\xed\xde" + frame, "dict_zstd", "unknown", None), (b"\xed\xdf" + frame, "plain_zstd", "blob", "text"), (b"\xed\xdfbroken", "plain_zstd", "unknown", None), (b"\xed\xd0\xed\xf1{}", "escaped_raw", "tree", None)]
    rows += [(frame, "raw", "blob", "zstd"), (b"", "raw", "blob", "text"), (b"\xed", "raw", "blob", "binary"), (b"\xed\xdf" + zstandard.ZstdCompressor().compress(b"\xed\xf3abc"), "plain_zstd", "chunk", None)]
    objects = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, content binary")
    got = {r.i: (r.method, r.kind, r.content_type) for r in stats.classified(objects).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}


def test_tree_json_escapes_names(spark):
    import json

    names = ['a"b', "back\\slash", "tab\tnew\nline", "ünïcode", "plain"]
    leaves = spark.createDataFrame([(n, "1" * 64, 3, None) for n in names], "name string, hash string, size long, mode string")
    got = [json.loads(r.j)["name"] for r in leaves.select(rollup.entry_json("blob").alias("j")).collect()]
    assert got == names

"""Tokenisation operators against the tokenizers library and a Python fold."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from treeline.llm import bpe_trie, token_counts, token_files, vocab
from treeline.llm.queries import vocabulary_path

PATH = vocabulary_path()
ODD = ["a", "s", "'", "'s", "'re", " the", "ing", " ", "  ", "\n", "\t", "12", "é", "ñ", "中", "!", "...", "\u00a0", "\u3000", "😀", "<|endoftext|>", "<|endof", "𠀀", "____", "\r\n", "\x1c", "\x85", "aaaa"]
TEXTS = [None, "", " ", "\n", "word", "a" * 30000, "<|endoftext|>", "x<|endoftext|>y  <|endoftext|>", "tie", "tie", " lead", "trail  ", "á́", "\u200b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def mixed(n, seed=2):
    random.seed(seed)
    return ["".join(random.choices(ODD, k=random.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i) for i, t in enumerate([*TEXTS, *mixed(200)])] + [(3, "repeated id", 0), (None, "no id", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def test_pieces_are_the_librarys():
    rule, given = vocab.ByteLevelRule(), mixed(5000)
    words, rows = rule.pieces(pa.array([t.encode() for t in given], pa.binary()))
    words, wanted = words.to_pylist(), pre_tokenizers.ByteLevel(add_prefix_space=False)
    for i, t in enumerate(given):
        assert [w.decode() for w in words[rows[i] : rows[i + 1]]] == [t[a:b] for _, (a, b) in wanted.pre_tokenize_str(t)]


def test_trie_encodes_as_the_library(library):
    given = mixed(5000) + ["".join(chr(random.choice([random.randint(32, 126), random.randint(0xA0, 0x2FFF)])) for _ in range(60)) for _ in range(500)]
    codec = bpe_trie.TrieCodec(PATH)
    ids, rows = codec.encode(pa.array([t.encode() for t in given], pa.binary()))
    decoded = codec.decode(ids, rows)
    for i, e in enumerate(library.encode_batch_fast(given, add_special_tokens=False)):
        assert ids[rows[i] : rows[i + 1]].tolist() == e.ids and decoded[i].decode() == given[i]


def test_decoding_broken_ids(library):
    codec, ids = bpe_trie.TrieCodec(PATH), library.encode("é中😀", add_special_tokens=False).ids
    for cut in range(len(ids) + 1):
        part = np.array(ids[cut:], np.uint32)
        assert codec.decode(part, np.array([0, len(part)]))[0].decode() == library.decode(ids[cut:], skip_special_tokens=False)


def test_table_overflow_changes_nothing(monkeypatch):
    from treeline.llm import wordtable

    given = pa.array([t.encode() for t in mixed(500)], pa.binary())
    codec = bpe_trie.TrieCodec(PATH)
    want = codec.encode(given)[0]
    monkeypatch.setattr(wordtable, "TABLE_WORDS", 50)
    codec.table.clear()
    assert all((codec.encode(given)[0] == want).all() for _ in range(3))


def test_encode_decode_rows(docs, library):
    rows = bpe_trie.encode_decode(docs, PATH).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.n_tokens == len(r.ids) and library.encode(r.decoded, add_special_tokens=False).ids == r.ids
    digests = bpe_trie.encode_decode(docs, PATH, digests_only=True).where("doc_id = 4").first()
    ids = library.encode("word", add_special_tokens=False).ids
    assert (digests.ids_sha256, digests.decoded_sha256) == (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(b"word").hexdigest())
    assert bpe_trie.encode_decode(docs.limit(0), PATH).count() == 0


def test_recoded_keeps_rows(docs):
    assert sorted(map(str, bpe_trie.recoded(docs, PATH).collect())) == sorted(map(str, docs.collect()))


def test_counts(docs, library):
    rows = token_counts.token_counts(docs, PATH, limit=10, chunk_chars=40, overlap_chars=8).join(docs.select("doc_id", "text"), "doc_id").where("doc_id <> 3").collect()
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 10)
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 2), (50, 10), (200, 20)])
def test_resynchronisation(library, chunk, overlap):
    random.seed(chunk)
    counter = token_counts.ChunkedCounter(PATH, chunk, overlap)
    parts = ["a" * 50, " the", "  ", "\n\n\n", " " * 60, "<|endoftext|>", "'s", "é中", "!?" * 30, " word", "123"]
    for _ in range(150):
        given = "".join(random.choices(parts, k=random.randint(5, 120)))
        assert counter.count(given) == len(library.encode(given, add_special_tokens=False))
    assert counter.widened


def test_pack_round_trip():
    values = np.array([0, 1, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        control, data = token_files.pack(values[:n])
        assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == values[:n]).all()


def test_token_files(spark, docs, library):
    rows = token_files.token_files(docs, PATH, end_id=2).collect()
    want = sorted(((r.doc_id is not None, r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()), key=lambda x: (x[0], x[1] or 0, len(x[2])))
    at, expected = 0, []
    for _, doc, ids in want:
        expected.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected
    assert token_files.token_files(docs.limit(0), PATH).count() == 0


def test_token_file_damage():
    block = token_files._block(pa.array([1, None], pa.int64()), np.array([2, 1]), np.array([5, 0, 300], np.uint32))
    whole = token_files.MAGIC + block + token_files.END
    (ids, has, sizes, ranks), = token_files.read_blocks(io.BytesIO(whole))
    assert (ids[0], has.tolist(), sizes.tolist(), ranks.tolist()) == (1, [True, False], [2, 1], [5, 0, 300])
    for bad in (b"x" + whole, whole[:-20], whole[:30] + b"\x99" + whole[31:]):
        with pytest.raises(ValueError):
            list(token_files.read_blocks(io.BytesIO(bad)))


def test_ids_can_be_read_back(spark, library):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    from treeline.llm.shared import shared_dir

    folder = shared_dir(spark, "ids")
    rows = token_files.read_token_files(token_files.write_token_files(docs, PATH, folder, 2, shards=2), folder).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [library.encode("one two", add_special_tokens=False).ids + [2], [2]]


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 5, "b")], "doc_id long, text string, n_tokens long, ids string")
    assert bpe_trie.encode_decode(docs, PATH).select(F.sum("n_tokens")).first()[0] == 1

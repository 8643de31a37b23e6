"""Content identity: tagged SHA-256 hashes, hash prefixes, Bloom bit positions, object keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-byte type tags of stored objects.
TAG_BLOB, TAG_TREE, TAG_MANIFEST, TAG_CHUNK, TAG_PACK, TAG_STANDALONE, TAG_RAW = "EDF0", "EDF1", "EDF2", "EDF3", "EDE1", "EDE0", "EDD0"


def tag(name: str) -> Column:
    return F.unhex(F.lit(name))


def sha(content: Column) -> Column:
    """SHA-256 of bytes as lower-case hex."""
    return F.sha2(content, 256)


def blob_hash(content: Column) -> Column:
    return sha(F.concat(tag(TAG_BLOB), content))


def chunk_hash(content: Column) -> Column:
    return sha(F.concat(tag(TAG_CHUNK), content))


def empty_tree_hash() -> Column:
    return sha(F.concat(tag(TAG_TREE), F.encode(F.lit('{"kind":"normal","entries":[]}'), "UTF-8")))


def parse_hash(text: Column) -> Column:
    """Lower-case hex of exactly 64 digits of any case, else null."""
    low = F.lower(text)
    return F.when(low.rlike(r"^[0-9a-f]{64}\z"), low)


def _head(content: Column, n: int = 2) -> Column:
    return F.hex(F.substring(content, 1, n))


def needs_blob_escape(content: Column) -> Column:
    """Blob bytes that could be read as a typed object: ED F0..FF."""
    return _head(content).rlike("^EDF[0-9A-F]$")


def serialise_blob(content: Column) -> Column:
    """Plain bytes, or the blob tag and the bytes where these look like a tag."""
    return F.when(needs_blob_escape(content), F.concat(tag(TAG_BLOB), content)).otherwise(content)


def deserialise_blob(stored: Column) -> Column:
    return F.when(_head(stored) == TAG_BLOB, F.substring(stored, 3, 2147483647)).otherwise(stored)


def needs_raw_escape(stored: Column) -> Column:
    """Uncompressed bytes that look like a compression escape: ED D0..DF."""
    return _head(stored).rlike("^EDD[0-9A-F]$")


def unescape_standalone(stored: Column) -> Column:
    return F.when(_head(stored) == TAG_STANDALONE, F.substring(stored, 3, 2147483647)).otherwise(stored)


def manifest_bytes(chunk_hashes: Column) -> Column:
    """The manifest tag and the 32 bytes of each chunk hash."""
    return F.concat(tag(TAG_MANIFEST), F.unhex(F.array_join(chunk_hashes, "")))


def manifest_chunks(manifest: Column) -> Column:
    """Chunk hashes of manifest bytes, in order; null for other bytes."""
    digits = F.lower(F.hex(F.substring(manifest, 3, 2147483647)))
    count = (F.length(digits) / 64).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(digits, i * 64 + 1, F.lit(64)))
    valid = (_head(manifest) == TAG_MANIFEST) & (F.length(digits) % 64 == 0)
    return F.when(valid & (count > 0), hashes).when(valid, F.array().cast("array<string>"))


def hash_prefix(hex_hash: Column, bits: int) -> Column:
    """The first ``bits`` (0 to 32) bits of a hash as an integer."""
    if bits == 0:
        return F.lit(0).cast("bigint")
    digits = -(-bits // 4)
    value = F.conv(F.substring(hex_hash, 1, digits), 16, 10).cast("bigint")
    return F.shiftright(value, 4 * digits - bits)


def optimal_bits(n: int, p: float) -> int:
    """Bits of a Bloom filter for ``n`` elements at false-positive rate ``p``."""
    return math.ceil(-n * math.log(p) / math.log(2) ** 2)


def _little_endian(hex_hash: Column, first_byte: int) -> Column:
    """Four bytes of a hash as an integer."""
    pairs = [F.substring(hex_hash, 2 * (first_byte + i) + 1, 2) for i in reversed(range(4))]
    return F.conv(F.concat(*pairs), 16, 10).cast("bigint")


def bloom_bits(hex_hash: Column, m: int, k: int = 7) -> Column:
    """Bit positions ``(h1 + i * h2 mod 2**64) mod m``; h1 and h2 are the first two little-endian words.

    Words are added in halves and divided by 16 bits at a time, so nothing leaves a long (``m`` up to 2**47).
    """
    low1, high1, low2, high2 = (_little_endian(hex_hash, first) for first in (0, 4, 8, 12))
    size, half, short = F.lit(m).cast("bigint"), F.lit(2**32 - 1), F.lit(2**16 - 1)

    def position(i: int) -> Column:
        low = low1 + low2 * i
        high = (high1 + high2 * i + F.shiftright(low, 32)).bitwiseAND(half)
        low = low.bitwiseAND(half)
        left = high % size
        for part in (F.shiftright(low, 16), low.bitwiseAND(short)):
            left = (left * 2**16 + part) % size
        return left

    return F.array(*[position(i) for i in range(k)])


def object_key(hex_hash: Column, prefix: str = "objects") -> Column:
    """Remote object key: the hash split 2/2/2/58."""
    return F.concat_ws("/", F.lit(prefix), F.substring(hex_hash, 1, 2), F.substring(hex_hash, 3, 2), F.substring(hex_hash, 5, 2), F.substring(hex_hash, 7, 58))


def key_to_hash(key: Column, prefix: str = "objects") -> Column:
    """The inverse of :func:`object_key`; null for other keys."""
    shape = f"^{prefix}/[0-9a-f]{{2}}/[0-9a-f]{{2}}/[0-9a-f]{{2}}/[0-9a-f]{{58}}\\z"
    return F.when(key.rlike(shape), F.replace(F.substr(key, F.lit(len(prefix) + 2)), F.lit("/"), F.lit("")))

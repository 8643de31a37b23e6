"""Vectorised words and word shingles of whole Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from treeline.llm.shared import mix

SHINGLE = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: pa.Array, normal: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(all words, offsets of the rows' words) of a binary UTF-8 column without nulls.

    A word is a run of characters other than ASCII white space.  ``normal``: lower-cased, with all
    but letters and numbers removed; words that vanish are left out.
    """
    column = text.cast(pa.string())
    if normal:
        column = pc.replace_substring_regex(pc.utf8_lower(column), r"[^\pL\pN\x20\x09-\x0D]+", "")
    split = pc.ascii_split_whitespace(column)
    rows = np.asarray(split.offsets, dtype=np.int64)
    flat = split.flatten()
    rows = rows - rows[0]
    empty = np.asarray(pc.equal(pc.binary_length(flat), 0), dtype=bool) if len(flat) else np.zeros(0, bool)
    if empty.any():
        flat = flat.filter(pa.array(~empty))
        rows = np.concatenate([[0], np.cumsum(~empty)])[rows]
    return flat, rows


def word_hashes(text: pa.Array, normal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, offsets of the rows' words)."""
    flat, rows = words(text, normal)
    if not len(flat):
        return np.zeros(0, np.uint64), rows
    coded = flat.dictionary_encode()
    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return distinct[np.asarray(coded.indices)], rows


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, size: int = SHINGLE, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of ``size`` words in order, offsets of the rows' windows).

    With ``short`` a row of fewer words has one shingle of all its words, a row without words none.
    """
    n = np.diff(rows)
    n_out = np.where(n >= size, n - size + 1, ((n > 0) & short).astype(np.int64))
    out_rows = np.concatenate([[0], np.cumsum(n_out)]).astype(np.int64)
    if not out_rows[-1]:
        return np.zeros(0, np.uint64), out_rows
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(hashes), np.uint64)
        padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
        for k in range(size):
            rolled = rolled * _STEP + padded[k : k + len(hashes)]
        keep = np.zeros(len(hashes) + 1, np.int32)
        full = n >= size
        np.add.at(keep, rows[:-1][full], 1)
        np.add.at(keep, rows[1:][full] - size + 1, -1)
        mask = np.cumsum(keep[:-1]) > 0
        if short:
            for r in np.flatnonzero((n > 0) & ~full):
                a, b = rows[r], rows[r + 1]
                value = np.uint64(b - a)
                for h in hashes[a:b]:
                    value = value * _STEP + h
                rolled[a] = value
                mask[a] = True
        return mix(rolled[mask]), out_rows

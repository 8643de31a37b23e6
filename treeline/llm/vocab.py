"""Byte-level BPE vocabularies and a vectorised byte-level pre-tokeniser.

The pre-tokeniser cuts a whole Arrow column at once with numpy, so that the
number of Python steps follows the number of *distinct* words and not the
number of tokens.  It gives the pieces of the tokenizers library's ByteLevel
rule (contractions, an optional space before a run of letters, numbers or other
characters, white space with its last space left to the next piece).  Which class a
character has is asked of the library itself, once for each new character.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from tokenizers import pre_tokenizers

from treeline.llm.shared import flat

LETTER, NUMBER, OTHER, SPACE, BLANK, SPECIAL = 1, 2, 3, 4, 5, 6  # SPACE is U+0020, BLANK any other white space
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class ByteLevelRule:
    """Pieces of byte-level pre-tokenisation for whole columns."""

    def __init__(self, specials: tuple[str, ...] = ()):
        self.specials = [s.encode() for s in specials]
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.known = np.zeros(0x110000, np.uint8)
        self.learn(np.arange(128))

    def learn(self, points: np.ndarray) -> None:
        """Ask the library for the class of code points that were not seen before."""
        new = np.unique(points[self.known[points] == 0])
        if not len(new):
            return
        chars = [chr(c) for c in new]

        def joins(before: str) -> np.ndarray:
            probe = "".join(f"{before}{c}\n" for c in chars)
            spans = {a: b for _, (a, b) in self.library.pre_tokenize_str(probe)}
            return np.array([spans.get(3 * i) == 3 * i + 2 for i in range(len(chars))])

        cls = np.full(len(new), BLANK, np.uint8)
        for before, kind in (("!", OTHER), ("1", NUMBER), ("a", LETTER)):
            cls[joins(before)] = kind
        cls[new == 32] = SPACE
        cls[(new == 10) | (new == 13)] = BLANK
        self.known[new] = cls

    def pieces(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(all pieces as a binary array over the column's bytes, offsets of the rows' pieces).

        ``column`` is binary UTF-8 without nulls.  A special string is one piece of its own.
        """
        data, rows = flat(column)
        n = len(data)
        if not n:
            return pa.array([], pa.binary()), np.zeros(len(rows), np.int64)
        first = np.ones(n, bool)
        wide = data >= 0x80
        if wide.any():
            first = (data & 0xC0) != 0x80
            pos = np.flatnonzero(first)
            lead = data[pos]
            point = lead.astype(np.int64)
            for low, high, size, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
                at = np.flatnonzero((lead >= low) & (lead < high))
                if len(at):
                    value = (lead[at] & mask).astype(np.int64)
                    for k in range(1, size):
                        value = (value << 6) | (data[pos[at] + k] & 0x3F)
                    point[at] = value
            self.learn(point[lead >= 0x80])
            cls = self.known[point]
        else:
            pos = None
            cls = self.known[:256][data]
        m = len(cls)
        row_chars = rows if pos is None else np.searchsorted(pos, rows)
        begin = np.zeros(m + 1, bool)
        begin[row_chars] = True
        marks = []
        for special in self.specials:
            marks += self._mark(data, rows, special, pos, cls)
        group = np.where(cls == BLANK, SPACE, cls)
        start = np.empty(m + 1, bool)
        start[0] = start[m] = True
        np.not_equal(group[1:], group[:-1], out=start[1:m])
        start |= begin
        for a, b in marks:
            start[a] = start[b] = True
        # the last character of a white-space run that a word follows in the same row
        white = group == SPACE
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~begin[1:m] & (group[1:] != SPECIAL))
        start[last] = True
        start[last[cls[last] == SPACE] + 1] = False
        self._contractions(data, pos, cls, start, begin)
        at = np.flatnonzero(start[:m])
        if pos is not None:
            at = pos[at]
        offsets = np.append(at, n).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        return words, np.searchsorted(at, rows)

    def _mark(self, data, rows, special, pos, cls) -> list[tuple[int, int]]:
        found, raw, at = [], data.tobytes(), 0
        while (at := raw.find(special, at)) >= 0:
            end = at + len(special)
            row = int(np.searchsorted(rows, at, side="right")) - 1
            while rows[row] == rows[row + 1]:
                row += 1
            if end > rows[row + 1]:
                at = int(rows[row + 1])
                continue
            a, b = (at, end) if pos is None else map(int, np.searchsorted(pos, (at, end)))
            cls[a:b] = SPECIAL
            found.append((a, b))
            at = end
        return found

    def _contractions(self, data, pos, cls, start, begin) -> None:
        m = len(cls)
        quote = np.flatnonzero(data == 0x27)
        if pos is not None:
            quote = np.searchsorted(pos, quote)
        quote = quote[quote + 1 < m]
        quote = quote[start[quote] & (cls[quote] == OTHER) & (cls[quote + 1] == LETTER) & ~begin[quote + 1]]
        if not len(quote):
            return
        byte = (lambda i: data[np.minimum(i, m - 1)]) if pos is None else (lambda i: data[pos[np.minimum(i, m - 1)]])
        one = byte(quote + 1)
        two = np.where((quote + 2 < m) & ~begin[np.minimum(quote + 2, m)], byte(quote + 2), 0)
        for text in CONTRACTIONS:
            fits = one == ord(text[1])
            if len(text) == 3:
                fits &= two == ord(text[2])
            hit = quote[fits]
            start[hit + 1] = False
            after = hit + len(text)
            start[after[after < m]] = True


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        from_char = {c: b for b, c in enumerate(byte_chars())}
        self.bytes_of: dict[int, bytes] = {}
        for token, i in model["vocab"].items():
            self.bytes_of[i] = bytes(from_char[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        to_id = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        self.to_id = to_id
        self.merges: list[tuple[int, int]] = []
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            encode = lambda token: to_id[bytes(from_char[c] for c in token)]
            self.merges.append((encode(left), encode(right)))
        self.plain = is_plain_byte_level(spec)

    @property
    def size(self) -> int:
        return max(self.bytes_of) + 1


def is_plain_byte_level(spec: dict) -> bool:
    """Whether the pieces of :class:`ByteLevelRule` are those of the tokenizer file."""
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    model = spec["model"]
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    return (
        plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not spec.get("normalizer") and model["type"] == "BPE" and not any(model.get(k) for k in options)
    )


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]

"""Tokenising whole texts through a bounded table in each Python worker.

A text is cut into parts where no token can cross: before a run of ASCII white space, and after an ASCII or Latin-1 letter
where an ASCII character follows that is no letter.  The word-splitting tokenizers used here never join what lies on
both sides of such a place, and their normalisation (NFC, lower case) never reaches over it, because an ASCII character
doesn't compose with what stands before.  Texts with white space beyond ASCII, separators U+001C to U+001F or special
strings could break the rule and go to the library whole.

The work is done on Arrow buffers, a group of texts at a time: places are found in the bytes, the parts are dictionary-
encoded, only the distinct ones are looked up, and ids are gathered by offsets, so that no Python object is made per part.
The table lives as long as the worker, over all its tasks.  It is bounded in entries and in bytes; a full one keeps the
entries that were used most, with older uses counting less.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 4 << 20
LIMIT = 600_000
LONG_PART = 256  # bytes; longer parts are encoded anew each time
UNSAFE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PLAIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")

@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a vocabulary file, once per Python worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def texts_of(column: pa.Array) -> pa.Array:
    """A column of texts with 64-bit offsets, null as the empty text."""
    return pc.fill_null(column, "").cast(pa.large_string())


def groups(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive slices of about GROUP_BYTES, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES, "right")))
        yield texts.slice(at, to - at)
        at = to


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts (binary), and for every text the number of parts up to its end, from 0."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    # Unsigned bytes wrap around, so that one comparison tests a range.
    space, letter, ascii_ = (data == 0x20) | (data - 0x09 < 5), (data | 0x20) - 0x61 < 26, data < 0x80
    ends = letter.copy()  # the last byte of a letter; a Latin-1 letter is 0xC3 and another byte
    ends[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    begins = np.empty(len(data), bool)
    begins[0] = True
    begins[1:] = (space[1:] & ~space[:-1]) | (ends[:-1] & (ascii_ & ~letter)[1:])
    borders = offsets - first
    begins[borders[borders < len(data)]] = True
    at = np.append(np.flatnonzero(begins), len(data)).astype(np.int64)
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    return parts, np.searchsorted(at, borders)


def may_be_unsafe(data: np.ndarray, special: list[bytes]) -> bool:
    """False if no text in these bytes matches UNSAFE or holds one of the special strings; a cheap test before the exact one."""
    if len(data) < 2:
        return True
    one, two = data[:-1], data[1:]
    if (data - 0x1C < 4).any() or ((one == 0xC2) & ((two == 0x85) | (two == 0xA0))).any() or any(((one == x[0]) & (two == x[1])).any() for x in special):
        return True
    at = np.flatnonzero((one - 0xE1 < 3) & ((two == 0x9A) | (two == 0x80) | (two == 0x81)))
    three = data[np.minimum(at + 2, len(data) - 1)]
    return bool(((one[at] != 0xE2) | (three - 0x80 < 11) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF) | (three == 0x9F)).any())


class PartTable:
    """What the tokenizer gives for parts, as rows of growing arrays: keys here, values in the subclasses."""

    def __init__(self, path: str, limit: int = LIMIT):
        self.tokenizer, self.limit = load(path), limit
        self.normalises = self.tokenizer.normalizer is not None
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [(x.encode() + b"\0")[:2] for x in special]
        self.unsafe = "|".join([UNSAFE, *map(re.escape, special)])
        self.pinned = 0  # first rows, which never leave
        self.keys = pa.array([], pa.large_binary())
        self.uses = np.zeros(0, np.int64)
        self.misses = 0

    @classmethod
    @lru_cache(maxsize=4)
    def of_worker(cls, path: str):
        """The table that all tasks of this Python worker share."""
        return cls(path)

    def _store(self, found: list[list[int]]) -> None:
        """Append rows."""
        raise NotImplementedError

    def _keep(self, rows: np.ndarray) -> None:
        """Keep these rows only, in this order."""
        raise NotImplementedError

    def encoded(self, parts: list[str]) -> list[list[int]]:
        """Token ids by the library.  A plain word is one pre-token, so its BPE model is asked directly."""
        model, letters, out, rest = self.tokenizer.model, _LETTERS, [[]] * len(parts), []
        for k, p in enumerate(parts):
            if _PLAIN.fullmatch(p):
                if self.normalises:
                    p = p.lstrip(" ").lower()
                if not p.isascii():
                    p = p.encode().decode("latin-1").translate(letters)
                elif p[0] == " ":
                    p = letters[0x20] + p[1:]
                out[k] = [t.id for t in model.tokenize(p)]
            else:
                rest.append(k)
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            for j, e in zip(some, self.tokenizer.encode_batch_fast([parts[j] for j in some], add_special_tokens=False), strict=True):
                out[j] = e.ids
        return out

    def add(self, parts: pa.Array, found: list) -> None:
        self.keys = pa.concat_arrays([self.keys, parts.cast(pa.large_binary())])
        self.uses = np.concatenate([self.uses, np.zeros(len(parts), np.int64)])
        self._store(found)

    def pin(self, parts: list[bytes], found: list) -> None:
        """Enter parts whose values are given, for instance broadcast; they stay."""
        if not self.pinned and parts:
            self._only(np.zeros(0, np.int64))
            self.add(pa.array(parts, pa.large_binary()), found)
            self.pinned = len(parts)

    def _only(self, rows: np.ndarray) -> None:
        self._keep(rows)
        self.keys, self.uses = self.keys.take(pa.array(rows)), self.uses[rows]

    def _make_room(self) -> None:
        """Drop what was used least, and count older uses half."""
        if len(self.keys) > self.limit:
            order = np.argsort(-self.uses[self.pinned :], kind="stable")[: self.limit // 2] + self.pinned
            self._only(np.concatenate([np.arange(self.pinned), np.sort(order)]))
            self.uses //= 2

    def rows(self, parts: pa.Array) -> tuple[np.ndarray, int]:
        """The row of every part, and the number of rows that stay: those beyond are of long parts, to be dropped after use."""
        coded = parts.dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        self._make_room()
        at = pc.fill_null(pc.index_in(distinct, value_set=self.keys), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        self.misses += len(new)
        long_ = pc.binary_length(distinct).to_numpy()[new] > LONG_PART
        new = np.concatenate([new[~long_], new[long_]])
        at[new] = np.arange(len(self.keys), len(self.keys) + len(new))
        stay = len(self.keys) + len(new) - int(long_.sum())
        if len(new):
            unseen = distinct.take(pa.array(new))
            self.add(unseen, self.encoded(unseen.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()))
        self.uses += np.bincount(at[codes], minlength=len(self.keys))
        return at[codes], stay

    def _forget(self, stay: int) -> None:
        if stay < len(self.keys):
            self._only(np.arange(stay))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _grouped(self, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, list[int]]]:
        """Groups with the places of the texts that have to go to the library whole."""
        for group in groups(texts):
            offsets = np.frombuffer(group.buffers()[1], np.int64)[group.offset : group.offset + len(group) + 1]
            if not may_be_unsafe(np.frombuffer(group.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], self.special):
                yield group, np.zeros(0, np.int64), []
                continue
            odd = np.flatnonzero(pc.match_substring_regex(group, self.unsafe).to_numpy(zero_copy_only=False))
            if len(odd):
                mask = np.ones(len(group), bool)
                mask[odd] = False
                safe = pc.if_else(pa.array(mask), group, pa.scalar("", pa.large_string()))
                yield safe, odd, [self.whole(group[int(k)].as_py()) for k in odd]
            else:
                yield group, odd, []


def _byte_letters() -> dict[int, str]:
    """The character by which byte-level BPE writes each byte: itself if it is printable, else the next unused one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


_LETTERS = _byte_letters()


class IdTable(PartTable):
    """Token ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = LIMIT):
        super().__init__(path, limit)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _store(self, found):
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(total, len(self.ids)), "<u4")])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += total

    def _keep(self, rows):
        sizes = self.sizes[rows]
        ids = self._gather(rows)
        self.ids, self.used = np.concatenate([ids, np.zeros(1 << 16, "<u4")]), len(ids)
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.sizes[rows]
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(self.starts[rows] - before, sizes) + np.arange(int(sizes.sum()))]

    def many(self, column: pa.Array, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per group of consecutive texts: all ids, and where each text's ids end, from 0; ``end`` follows every text."""
        for group, odd, given in self._grouped(texts_of(column)):
            parts, bounds = cut(group)
            rows, size = self.rows(parts)
            ids = self._gather(rows)
            ends = np.concatenate(([0], np.cumsum(self.sizes[rows])))[bounds]
            self._forget(size)
            for k, own in zip(odd.tolist(), given, strict=True):
                at = int(ends[k])
                ids = np.concatenate([ids[:at], np.asarray(own, "<u4"), ids[at:]])
                ends[k + 1 :] += len(own)
            if end is not None:
                ids = np.insert(ids, ends[1:], end)
                ends = ends + np.arange(len(ends))
            yield ids.astype("<u4", copy=False), ends


class CountTable(PartTable):
    """Token counts."""

    def __init__(self, path: str, limit: int = LIMIT):
        super().__init__(path, limit)
        self.sizes = np.zeros(0, np.int64)

    def _store(self, found):
        self.sizes = np.concatenate([self.sizes, np.fromiter((f if isinstance(f, int) else len(f) for f in found), np.int64, len(found))])

    def _keep(self, rows):
        self.sizes = self.sizes[rows]

    def many(self, column: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        out = [np.zeros(0, np.int64)]
        for group, odd, given in self._grouped(texts_of(column)):
            parts, bounds = cut(group)
            rows, size = self.rows(parts)
            n = np.diff(np.concatenate(([0], np.cumsum(self.sizes[rows])))[bounds])
            self._forget(size)
            n[odd] = [len(x) for x in given]
            out.append(n)
        return np.concatenate(out)

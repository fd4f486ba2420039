"""Encoding of many texts by way of their distinct pre-tokens.

Byte-level vocabularies first split a text by a pattern and encode each piece on its own. A single blank between two
characters that are no white space always begins a new piece, whatever stands around it, so a text may be cut at such
blanks and its parts encoded apart. Arrow cuts the texts, numbers the distinct parts and cuts those in turn into
pre-tokens; the library sees each distinct pre-token of a slice once, and those that the worker remembers not at all; numpy
puts the ids together. Texts with other
white space next to a blank, or at their ends, are split by the pattern as they are.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

from mnemos.llm.common import trim

#: Parts and pre-tokens whose ids a Python worker remembers; it forgets half beyond, which changes nothing but speed.
CACHE_ENTRIES = 150_000
#: Hash values that tell whether a pre-token was met before.
MET_MASK = (1 << 22) - 1
#: Longer pre-tokens aren't remembered.
CACHE_CHARS = 64
# White space of Unicode, and the separators U+001C to U+001F.
_WHITE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A word with ASCII punctuation after it, and another on the next line: each group, and the line feed, is a pre-token.
SIMPLE = r"^(?P<a>\p{L}+)(?P<b>[!-/:-@\[-`{-~]*)(?:\n(?P<c>\p{L}+)(?P<d>[!-/:-@\[-`{-~]*))?$"
UNEVEN = rf"^{_WHITE}|{_WHITE}$| {_WHITE}|{_WHITE} "


def text_slices(texts: pa.Array, budget: int = 4 << 20) -> Iterator[pa.Array]:
    """Consecutive parts of a string array of about `budget` bytes each, nulls as empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + budget, side="right")))
        yield texts[start:end]
        start = end


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for all i, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    kind = np.int32 if max(ends[-1], len(flat)) < 2**31 else np.int64
    places = np.arange(ends[-1], dtype=kind)
    places += np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    return flat[places]


def byte_characters() -> list[str]:
    """A printable character for each byte: the byte itself where printable, else the next free one from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


BYTE_CHARACTERS = dict(enumerate(byte_characters()))


def byte_mapped(text: str) -> str:
    """The characters of a text's UTF-8 bytes."""
    if text.isascii() and text.isprintable():
        return text.replace(" ", BYTE_CHARACTERS[32])
    return text.encode("utf-8").decode("latin-1").translate(BYTE_CHARACTERS)


def strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def table_of(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, and where each row's begin and how many they are."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
    return np.frombuffer(b"".join(rows), "<i4"), np.cumsum(lengths) - lengths, lengths


class ChunkEncoder:
    """Ids of texts; subclasses encode lists of pre-tokens."""

    def __init__(self, pattern: str):
        self.split = regex.compile(pattern).findall
        self.simple = pattern == public_tokenizers.PATTERN
        self.seen: dict[str, bytes] = {}
        self.met = bytearray(MET_MASK + 1)

    def encode_pretokens(self, pretokens: list[str]) -> list[bytes]:
        """For each pre-token its ids as little-endian 32-bit integers."""
        raise NotImplementedError

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        parts = list(map(self.split, texts))
        known = self._known(set(chain.from_iterable(parts)))
        return [b"".join(map(known.__getitem__, own)) for own in parts]

    def _known(self, pretokens: set[str]) -> dict[str, bytes]:
        own = list(pretokens)
        return dict(zip(own, self._ids(own), strict=True))

    def _ids(self, pretokens: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens; those that other slices had too are remembered, one bit each tells."""
        seen, met = self.seen, self.met
        out = list(map(seen.get, pretokens))
        new = [i for i, ids in enumerate(out) if ids is None]
        kept = {}
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for i, ids in zip(part, self.encode_pretokens([pretokens[i] for i in part]), strict=True):
                out[i] = ids
        for i in new:
            p = pretokens[i]
            at = hash(p) & MET_MASK
            if met[at] and len(p) <= CACHE_CHARS:
                kept[p] = out[i]
            met[at] = 1
        if len(seen) + len(kept) > CACHE_ENTRIES:
            self.seen = seen = dict(islice(seen.items(), CACHE_ENTRIES // 2))  # the frequent ones came first
        seen.update(kept)
        return out

    def _parts(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """table_of() the distinct parts of texts, each after a blank.

        Arrow cuts words with punctuation into their pre-tokens, the pattern cuts other parts.
        """
        if not self.simple:
            return table_of(self.encode_whole([" " + x for x in strings(names)]))
        found = pc.extract_regex(names, SIMPLE)
        plain = pc.is_valid(found)
        first, *rest = (found.field(c).filter(plain) for c in "abcd")
        text = lambda x: pa.scalar(x, names.type)
        line = pc.if_else(pc.equal(rest[1], ""), text(""), text("\n"))
        fields = [pc.binary_join_element_wise(text(" "), first, text("")), rest[0], line, *rest[1:]]
        coded = pa.concat_arrays(fields).dictionary_encode()
        flat, starts, lengths = table_of(self._ids(strings(coded.dictionary)))
        order = coded.indices.to_numpy().astype(np.int64).reshape(len(fields), -1).T.ravel()
        sizes = lengths[order].reshape(-1, len(fields)).sum(axis=1)
        whole = gather(flat, starts[order], lengths[order])
        plain = plain.to_numpy(zero_copy_only=False)
        odd = table_of(self.encode_whole([" " + x for x in strings(names.filter(pa.array(~plain)))]))
        starts, lengths = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        starts[plain], lengths[plain] = np.cumsum(sizes) - sizes, sizes
        starts[~plain], lengths[~plain] = len(whole) + odd[1], odd[2]
        return np.concatenate([whole, odd[0]]), starts, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, their bounds by text) of a slice of non-null texts."""
        collected = gc.isenabled()
        gc.disable()  # hundreds of thousands of small lists without cycles would set it off again and again
        try:
            return self._encode(texts)
        finally:
            if collected:
                gc.enable()
            trim()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~uneven))
        lists = pc.split_pattern(even, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.zeros(len(index), bool)
        first[bounds[:-1][bounds[:-1] < bounds[1:]] - bounds[0]] = True
        names = coded.dictionary
        openers = np.unique(index[first])
        odd = strings(texts.filter(pa.array(uneven)))
        parts, lone = self._parts(names), table_of(self.encode_whole(strings(names.take(pa.array(openers))) + odd))
        index[first] = len(names) + np.searchsorted(openers, index[first])
        place = len(names) + len(openers)
        flat = np.concatenate([parts[0], lone[0]])
        starts = np.concatenate([parts[1], lone[1] + len(parts[0])])
        lengths = np.concatenate([parts[2], lone[2]])
        sizes = np.zeros(len(texts), np.int64)
        sizes[~uneven] = np.diff(bounds)
        sizes[uneven] = 1
        if len(odd):
            order = np.empty(int(sizes.sum()), np.int64)
            mark = np.repeat(uneven, sizes)
            order[~mark], order[mark] = index, place + np.arange(len(odd))
        else:
            order = index
        ids = gather(flat, starts[order], lengths[order])
        ends = np.concatenate([[0], np.cumsum(lengths[order])])
        return ids, ends[np.concatenate([[0], np.cumsum(sizes)])]


def id_lists(encoded: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """An array of integer lists."""
    parts = []
    for ids, bounds in encoded:
        if bounds[-1] >= 2**31:
            raise ValueError("more than 2^31 ids in a slice")
        parts.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

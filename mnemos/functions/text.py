"""Text functions as Column expressions: tokens, lexical scores, names, trimming. Only hit_score() and near_duplicate() run Python, over batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of the tokenisers and the range of CJK ideographs.
SEPARATORS = r"(?U)[\s,.;:!?，。；：！？、]+"
WIDE_SEPARATORS = r"(?U)[\s,.;:!?，。；：！？、/\-_()（）\[\]{}]+"
NOT_CJK = "[^一-鿿]"
HIT_SCORE_NEAR = 0.72
#: Bytes of text that a Python worker takes from an Arrow batch at a time.
SLICE_BYTES = 8 << 20


def tokens(text: Column, least: int = 1, pattern: str = SEPARATORS) -> Column:
    """Lower-cased tokens of at least `least` characters, in order, with repeats."""
    return F.filter(F.split(F.lower(text), pattern), lambda t: F.length(t) >= least)


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring CJK characters, other characters left out."""
    cjk = F.regexp_replace(text, NOT_CJK, "")
    return F.when(F.length(cjk) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(cjk) - 1, F.lit(1))), lambda i: F.substring(cjk, i, F.lit(2))))


def share(found: Column, of: Column) -> Column:
    """size(found) / size(of), 0 for none."""
    return F.when(F.size(of) == 0, F.lit(0.0)).otherwise(F.size(found) / F.greatest(F.size(of), F.lit(1)))


def _bound(values: Column, then) -> Column:
    """then(values), with the values evaluated once."""
    return F.get(F.transform(F.array(values), then), F.lit(0))


def inside(parts: Column, text: Column) -> Column:
    """The parts (repeats count) that occur in a text; each distinct one is searched once."""
    searched = _bound(F.struct(F.array_distinct(parts).alias("parts"), text.alias("text")), lambda s: F.filter(s["parts"], lambda p: F.contains(s["text"], p)))
    return _bound(F.struct(parts.alias("all"), searched.alias("found")), lambda s: F.filter(s["all"], lambda p: F.array_contains(s["found"], p)))


def lexical_similarity(content: Column, query_tokens: Column) -> Column:
    """The share of tokens (repeats count) that occur in the content; if none does, that of the distinct CJK bigrams of

    all tokens together.
    """
    hits = share(inside(query_tokens, F.lower(content)), query_tokens)
    grams = F.array_distinct(bigrams(F.array_join(query_tokens, "")))
    return _bound(F.struct(hits.alias("hits")), lambda h: F.when(h["hits"] > 0, h["hits"]).otherwise(share(inside(grams, F.lower(content)), grams)))


def query_keys(text: Column) -> Column:
    """Distinct tokens of two characters or more, each followed by its CJK bigrams."""
    return F.array_distinct(F.flatten(F.transform(tokens(text, 2), lambda t: F.concat(F.array(t), bigrams(t)))))


def hit_score(keys: Column, content: Column) -> Column:
    """The share of keys that occur in the content, searched by Python's own search, which skips ahead.

    Keys are a column of rows below a join or shuffle: Spark may miss a Python function in whose arguments lambdas are nested
    (as in query_keys), seemingly by the numbers that it gives to their variables, and the query fails.
    """

    @F.arrow_udf("double")
    def found(lists: pa.Array, texts: pa.Array) -> pa.Array:
        out: list[float | None] = []
        for parts, text in zip(lists, texts, strict=True):
            own, low = parts.as_py(), text.as_py()
            out.append(None if own is None else 0.0 if not own or low is None else sum(p is not None and p in low for p in own) / len(own))
        return pa.array(out, pa.float64())

    return found(keys, F.lower(content))


#: SEPARATORS for Python's re, whose \\s takes four control characters more.
_SEPARATED = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000,.;:!?，。；：！？、]+")
_NOT_CJK = re.compile(NOT_CJK)


def _distinct_tokens(low: str) -> set[str]:
    return {t for t in _SEPARATED.split(low) if len(t) >= 2}


def _with_bigrams(own: set[str]) -> set[str]:
    """The tokens and the CJK bigrams of each."""
    out = set(own)
    for t in own:
        if not t.isascii():
            cjk = _NOT_CJK.sub("", t)
            out.update(cjk[i : i + 2] for i in range(len(cjk) - 1))
    return out


def _mostly_inside(keys: set[str], own: set[str], least: float) -> bool:
    """Whether `least` of the keys occur in the text of these tokens. Keys that are tokens do; others are searched in them, longest first, until too many are missing."""
    n, missing, joined = len(keys), 0, " ".join(own)
    for k in sorted(keys - own, key=len, reverse=True):
        if k not in joined:
            missing += 1
            if (n - missing) / n < least:
                return False
    return n > 0


def near_duplicate(a: Column, b: Column, least: float = HIT_SCORE_NEAR) -> Column:
    """Equal but for outer white space, or most keys of each in the other; each text is cut once for both, by Python's own search.

    Texts that are equal but for outer white space have the same tokens, so others aren't compared.
    """

    @F.arrow_udf("int")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        out: list[int | None] = []
        for x, y in zip(left, right, strict=True):
            low_a, low_b = x.as_py(), y.as_py()
            if low_a is None or low_b is None:
                out.append(None)
                continue
            own_a, own_b = _distinct_tokens(low_a), _distinct_tokens(low_b)
            both = _mostly_inside(_with_bigrams(own_a), own_b, least) and _mostly_inside(_with_bigrams(own_b), own_a, least)
            out.append(1 if both else 2 if own_a == own_b else 0)
        return pa.array(out, pa.int32())

    code = alike(F.lower(a), F.lower(b))
    return F.when(code == 2, strip(a) == strip(b)).otherwise(code == 1)


def slices(texts: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts) of consecutive parts of a string array of about `budget` bytes; nulls come as ''."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(lengths):
        size += n
        if size >= budget:
            yield start, [x or "" for x in texts[start : i + 1].to_pylist()]
            start, size = i + 1, 0
    if start < len(lengths):
        yield start, [x or "" for x in texts[start:].to_pylist()]


def overlap(keys_a: Column, keys_b: Column) -> Column:
    """Jaccard similarity of key sets, 0 if either is empty."""
    either = F.size(F.array_union(keys_a, keys_b))
    return F.when((F.size(keys_a) == 0) | (F.size(keys_b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(keys_a, keys_b)) / F.greatest(either, F.lit(1)))


def normal_name(name: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(name), r"(?U)\s+", "")


def strip(text: Column, chars: str = r"\s") -> Column:
    """Without the given characters (a class' inside) at both ends; Unicode white space by default."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?U)^[{chars}]+", ""), rf"(?U)[{chars}]+$", "")


def cut(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def has_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs in the lower-cased text."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def matching(text: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Names of the groups that have a word in the text, in order."""
    return F.array_compact(F.array(*[F.when(has_any(text, words), F.lit(name)) for name, words in groups.items()])) if groups else F.array().cast("array<string>")


def stacks(text: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Technology stacks named in a text; `go` needs the word go or golang besides."""
    low = F.lower(text)
    names = []
    for name, words in groups.items():
        found = has_any(text, words)
        if name == "go":
            found = found & (~F.contains(low, F.lit("go")) | low.rlike(r"(?U)\bgo\b|golang"))
        names.append(F.when(found, F.lit(name)))
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def stack_shift(old: Column, new: Column) -> Column:
    """(the first stack that only the old text has, the first that only the new one has), null without both."""
    gone, added = F.array_except(old, new), F.array_except(new, old)
    pair = F.struct(F.array_min(gone).alias("old"), F.array_min(added).alias("new"))
    return F.when((F.size(gone) > 0) & (F.size(added) > 0), pair)

"""Secret scans: fixed patterns, and a battery of randomness tests for what no pattern knows.

Base spans come from patterns for assignments, access keys and hexadecimal runs. The battery looks at every other run of
at least `min_length` characters of the base64 alphabets (both kinds, with padding), and at the base spans' values: hyphens
and underscores that part a run into groups of four characters or more are left out, as in UUIDs, the
narrowest common encoding that holds all characters is inferred (decimal, hexadecimal, letters, base 32, 36, 62, 64, 64 for URLs, in one case or both), and four
tests ask whether they may be a uniform draw of that alphabet: chi-squared over the characters' counts, and over those of
digits, small and capital letters (cells that short runs fill, too), the number of runs above and below the alphabet's
middle, and the correlation of neighbours. The score is the least of the four p-values times four, at most 1.

How high a score has to be depends on the length. Each document gives a decoy for each class of lengths: that many
characters of its ordinary text in a row, separators left out. The share of a class's decoys that score as high, one
added above and below, is a run's p-value as ordinary text; in each class Benjamini and Hochberg's step-up over all runs of
the corpus (and one of its own over all base values, which stay in any case) keeps the share of false discoveries at `rate`,
for each family of encodings by itself: words of letters don't hide short keys with digits or of mixed case. A class with fewer than `least_decoys` takes those of the next
shorter class, which pass more easily. So a single random key in a small corpus can be found, of any length.

Null and empty texts have no spans. Texts are scanned whole; spans are code points, end exclusive. Repeated rows are scanned
alike, but count each in the corpus' estimate. An empty table stays empty.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import bound_batches, materialise, slices

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(?a:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{%d,}={0,2}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: From narrow to wide.
ENCODINGS = {
    "decimal": DIGITS,
    "hex": DIGITS + LOWER[:6],
    "hex_upper": DIGITS + UPPER[:6],
    "letters": LOWER,
    "letters_upper": UPPER,
    "base32": UPPER + "234567",
    "base32_lower": LOWER + "234567",
    "base36": DIGITS + LOWER,
    "base36_upper": DIGITS + UPPER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "base66": UPPER + LOWER + DIGITS + "+/-_",
}
_NAMES = tuple(ENCODINGS)
#: For each byte the encodings (a bit each) that have it, its place in each, and whether it is a digit or sign, small or capital.
_HOLDS = np.array([sum(1 << e for e, x in enumerate(ENCODINGS.values()) if chr(c) in x) for c in range(256)], np.uint16)
_PLACES = np.array([[max(0, x.find(chr(c))) for c in range(256)] for x in ENCODINGS.values()])
_SORTS = np.array([1 if chr(c) in LOWER else 2 if chr(c) in UPPER else 0 for c in range(256)])
_NO_TEXT = bytes(c for c in range(256) if not _HOLDS[c])
#: Classes of lengths begin at these.
LENGTH_CLASSES = (12, 16, 20, 24, 32, 40, 48, 64, 96, 128, 256, 1024)
SCORE_BINS = 200
#: Characters of a group, in runs that signs part into groups.
LEAST_GROUP = 4

#: Families of encodings: letters of one case, as in most words; one case with digits, or digits; the rest.
FAMILIES = (("letters", "letters_upper"), ("decimal", "hex", "hex_upper", "base32", "base32_lower", "base36", "base36_upper"), ("base62", "base64", "base64url", "base66"))
_FAMILY = {name: f for f, names in enumerate(FAMILIES) for name in names}

SPAN = "struct<kind: int, start: int, end: int, encoding: string, cls: int, bin: int>"
FOUND = f"struct<base: array<{SPAN}>, runs: array<{SPAN}>, decoys: array<struct<cls: int, bin: int>>>"


def base_values(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, leftmost and without overlap within a kind, by start and kind."""
    low = text.lower()
    out = []
    if any(k in low for k in KEYWORDS):
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def bare(run: str) -> bytes:
    """A run's characters without padding, and without the signs between groups if it is made of such."""
    groups = re.split("[-_]", run.rstrip("="))
    return ("".join(groups) if min(map(len, groups)) >= LEAST_GROUP else run.rstrip("=")).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return [x[:3] for x in base_values(text)]


def _two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(x) / math.sqrt(2)) for x in z.tolist()])


def _upper(stat: np.ndarray, df: int) -> np.ndarray:
    """Upper p-values of chi-squared: exact for 1 and 2 degrees of freedom, else by Wilson and Hilferty's cube root."""
    if df < 3:
        return _two_sided(np.sqrt(stat)) if df == 1 else np.exp(-stat / 2)
    z = ((stat / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z.tolist()])


def chi_squared(cells: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """P-values of rows of cells (numbers from 0 on) whose shares are given."""
    n, size = cells.shape[1], len(shares)
    counts = np.bincount((np.arange(len(cells))[:, None] * size + cells).ravel(), minlength=len(cells) * size).reshape(-1, size)
    return _upper(np.maximum((counts**2 / (shares * n)).sum(axis=1) - n, 0), size - 1)


def runs_test(above: np.ndarray) -> np.ndarray:
    """Two-sided p-values of the number of runs in rows of true and false; 0 if all are alike."""
    n, a = above.shape[1], above.sum(axis=1)
    mean = 2 * a * (n - a) / n + 1
    spread = np.sqrt(np.maximum(1e-12, (mean - 1) * (mean - 2) / (n - 1)))
    p = _two_sided((1 + (above[:, 1:] != above[:, :-1]).sum(axis=1) - mean) / spread)
    return np.where((a > 0) & (a < n), p, 0.0)


def serial_test(places: np.ndarray) -> np.ndarray:
    """Two-sided p-values of the correlation of neighbours in rows of numbers; 0 if all are equal."""
    n = places.shape[1]
    d = places - places.mean(axis=1, keepdims=True)
    total = (d**2).sum(axis=1)
    r = (d[:, 1:] * d[:, :-1]).sum(axis=1) / np.where(total > 0, total, 1)
    return np.where(total > 0, _two_sided((r + 1 / n) * math.sqrt(n)), 0.0)


def scores(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inferred encodings (their places in ENCODINGS) and scores of rows of characters of the alphabets, of equal length."""
    holds = np.bitwise_and.reduce(_HOLDS[windows], axis=1)
    encoding = np.array([(int(x) & -int(x)).bit_length() - 1 for x in holds])
    out = np.zeros(len(windows))
    for e in np.unique(encoding):
        own = encoding == e
        alphabet = np.frombuffer(ENCODINGS[_NAMES[e]].encode(), np.uint8)
        places, size = _PLACES[e][windows[own]], len(alphabet)
        sorts, shares = np.unique(_SORTS[alphabet], return_counts=True)
        cells = np.searchsorted(sorts, _SORTS[windows[own]])
        tests = [chi_squared(places, np.full(size, 1 / size)), chi_squared(cells, shares / size), runs_test(2 * places >= size), serial_test(places.astype(np.float64))]
        out[own] = np.minimum(1.0, len(tests) * np.min(tests, axis=0))
    return encoding, out


def score(run: str) -> tuple[str, float]:
    """The inferred encoding of a run without padding, and how well it passes for a uniform draw (0 to 1)."""
    encoding, p = scores(np.frombuffer(run.encode(), np.uint8)[None])
    return _NAMES[encoding[0]], float(p[0])


def _scored(runs: list[bytes]) -> list[tuple[str, int, int]]:
    """(encoding, class, bin of the score) of each run; runs of a length are scored together. Classes are those of lengths,

    family by family of encodings.
    """
    lengths = defaultdict(list)
    for i, run in enumerate(runs):
        lengths[len(run)].append(i)
    out: list = [None] * len(runs)
    for n, own in lengths.items():
        if n < 2:
            encoding, p = np.zeros(len(own), int), np.zeros(len(own))
        else:
            encoding, p = scores(np.frombuffer(b"".join(runs[i] for i in own), np.uint8).reshape(-1, n))
        cls = max(0, bisect_right(LENGTH_CLASSES, n) - 1)
        for i, e, x in zip(own, encoding.tolist(), p.tolist(), strict=True):
            out[i] = (_NAMES[e], _FAMILY[_NAMES[e]] * len(LENGTH_CLASSES) + cls, min(SCORE_BINS - 1, int(x * SCORE_BINS)))
    return out


def decoys(ordinary: bytes) -> list[bytes]:
    """For each class of lengths as many characters in a row, at a place that hangs on the text; empty where it is too short."""
    spare = [len(ordinary) - n + 1 for n in LENGTH_CLASSES]
    at = crc32(ordinary)
    return [ordinary[at % k : at % k + n] if k > 0 else b"" for n, k in zip(LENGTH_CLASSES, spare, strict=True)]


def random_runs(text: str, base: list[tuple], pattern: re.Pattern) -> tuple[list[re.Match], bytes]:
    """Runs that touch no base span, and the characters of the alphabets in all the rest of the text."""
    found, taken, k = [], [], 0
    reach = sorted((x[1], x[2]) for x in base)
    end = 0  # of the base spans that begin before the run
    for m in pattern.finditer(text):
        while k < len(reach) and reach[k][0] < m.end():
            end = max(end, reach[k][1])
            k += 1
        if m.start() >= end:
            found.append(m)
            taken.append(m.span())
    pieces, at = [], 0
    for a, b in sorted([*taken, *reach]):
        pieces.append(text[at : max(a, at)])
        at = max(at, b)
    return found, "".join([*pieces, text[at:]]).encode().translate(None, _NO_TEXT)


def scan(docs: DataFrame, text_col: str = "text", found_col: str = "found", min_length: int = LENGTH_CLASSES[0]) -> DataFrame:
    """docs with base spans, scored runs and decoys of every text; row by row, without a shuffle.

    found_col must not be a column of docs: thresholds() and spans() look for the scan there.
    """
    if found_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {found_col}")
    bound_batches(docs.sparkSession)
    pattern = re.compile(RUN % min_length)

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        spans: dict[str, list] = {"base": [], "runs": []}
        drawn: list[list[dict]] = []
        for _, part in slices(texts):
            own = [(base := base_values(text), *random_runs(text, base, pattern)) for text in part]
            values = [[re.sub("[^A-Za-z0-9+/_-]", "", v).encode() for *_, v in base] for base, _, _ in own]
            runs = [[bare(m[0]) for m in more] for _, more, _ in own]
            chances = [decoys(ordinary) for *_, ordinary in own]
            scored = iter(_scored([x for groups in (values, runs, chances) for group in groups for x in group]))
            spans["base"] += [[(k, a, b, *next(scored)) for k, a, b, _ in base] for base, _, _ in own]
            spans["runs"] += [[(3, *m.span(), *next(scored)) for m in more] for _, more, _ in own]
            drawn += [[{"cls": s[1], "bin": s[2]} for x, s in zip(group, scored, strict=False) if x] for group in chances]
        span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("cls", pa.int32()), ("bin", pa.int32())])
        lists = [pa.array([[dict(zip(span.names, x, strict=True)) for x in row] for row in spans[c]], pa.list_(span)) for c in ("base", "runs")]
        return pa.StructArray.from_arrays([*lists, pa.array(drawn, pa.list_(pa.struct([("cls", pa.int32()), ("bin", pa.int32())])))], ["base", "runs", "decoys"])

    return docs.withColumn(found_col, found(F.col(text_col).cast("string")))


def thresholds(scanned: DataFrame, found_col: str = "found", rate: float = 0.05, least_decoys: int = 200) -> tuple[list[int], list[int]]:
    """For runs and for base values: of each class of lengths the least bin of a score that counts as random (SCORE_BINS: none).

    Counts by class and bin are summed over the corpus; classes x bins x 3 rows at most come to the driver.
    """
    found = F.col(found_col)
    sets = [scanned.select(F.explode(found[c]).alias("r")).select(F.lit(k).alias("set"), F.col("r.cls").alias("cls"), F.col("r.bin").alias("bin")) for k, c in enumerate(("runs", "base", "decoys"))]
    n = len(LENGTH_CLASSES)
    table = np.zeros((3, len(FAMILIES) * n, SCORE_BINS))
    for r in sets[0].unionByName(sets[1]).unionByName(sets[2]).groupBy("set", "cls", "bin").count().collect():
        table[r["set"], r["cls"], r["bin"]] = r["count"]
    whole = table.reshape(3, len(FAMILIES), n, SCORE_BINS).sum(axis=(1, 3))

    def least(spans: int) -> list[int]:
        parts = range(0, len(FAMILIES) * n, n)
        return [x for at in parts for x in step_up(table[spans, at : at + n], table[2, at : at + n], rate, least_decoys, whole[spans], whole[2])]

    return least(0), least(1)


def step_up(runs: np.ndarray, drawn: np.ndarray, rate: float, least_decoys: int, all_runs: np.ndarray | None = None, all_drawn: np.ndarray | None = None) -> list[int]:
    """thresholds() out of the counts of one family's spans and decoys (classes of lengths x bins).

    all_runs, all_drawn: those of all families by class. A run is as likely to come into this family by chance, and to
    score as high, as a decoy of its length.
    """
    all_runs = runs.sum(axis=1) if all_runs is None else all_runs
    all_drawn = drawn.sum(axis=1) if all_drawn is None else all_drawn
    out = []
    for cls in range(len(runs)):
        enough = [c for c in range(cls + 1) if all_drawn[c] >= least_decoys]
        own = enough[-1] if enough else int(all_drawn[: cls + 1].argmax())
        passed = runs[cls][::-1].cumsum()[::-1]
        p = (drawn[own][::-1].cumsum()[::-1] + 1) / (all_drawn[own] + 1)
        good = np.flatnonzero((passed > 0) & (p * all_runs[cls] <= rate * passed))
        out.append(int(good[0]) if len(good) else SCORE_BINS)
    return out


def passes(least: list[int]):
    """Whether a scored span counts as random."""
    known = F.array(*[F.lit(x) for x in least])
    return lambda r: r["bin"] >= F.get(known, r["cls"])


def spans(found: Column, least: list[int]) -> Column:
    """All spans, base and random, by start and kind."""
    return F.array_sort(F.transform(F.concat(found["base"], F.filter(found["runs"], passes(least))), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def joined(own: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and a digest of the base spans, all spans, and base values that pass as random."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scanned = materialise(scan(docs.select("doc_id", "text")).drop("text"), "secrets")
    least, least_base = thresholds(scanned)
    all_spans = scanned.withColumn("own", spans(F.col("found"), least))
    count = lambda k: F.size(F.filter("own", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("own", lambda s: s["kind"] < 3)
    return all_spans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("own")).alias("spans"),
        F.size(F.filter(F.col("found")["base"], passes(least_base))).cast("long").alias("n_random_base"),
    )

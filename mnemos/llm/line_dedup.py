"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only.

A line of at least `min_chars` characters is dropped if an earlier line of the corpus equals it or is one edit away (one
character inserted, deleted or substituted); a shorter one of at least `exact_chars` that isn't blank, if an earlier line
equals it. Earlier: in a document with a smaller id, or higher up in the same one; where ids repeat or are null, in a row
that is read earlier. Other lines stay, as do documents that lose all their lines (their text is then empty). The queries
count every line that isn't blank.

Two lines are one edit apart just if deleting a character at the same place makes them equal (substitution) or deleting
one from the longer gives the shorter. All such variants are emitted as hashed keys, but only where a partner is possible:
a line of m characters is cut into overlapping windows, each with the hashes of what lies before it (counted from the
start) and behind it (counted from the end); an edit inside a window leaves both as they are. Only windows whose
surroundings occur with two different lines are left, shorter windows are cut out of them in the same way, and those left
then emit variants. Lines that share a variant at the same place are all one edit
apart, so the earliest is found by a minimum without pairs; equal variants of longer and shorter lines join on the key.
Each line's earliest partner is then verified by its edit distance.

Every step is an aggregation with map-side combine or an equi-join; a side is broadcast only if its written table has at
most `broadcast_rows` rows. Null texts stay null, empty texts empty; repeated rows lose their lines to the first; other
columns pass through. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import free_name, keyed, materialise, sided

#: Least characters of lines that are one edit apart. On sf0.1 571 pairs of distinct lines have 2 to 7 characters and 10 have
#: 8 or 9, mostly other words; the 10 pairs of 10 to 79 characters are copies with a comma or a letter changed.
MIN_CHARS = 10
#: Least characters of lines that the queries drop as exact repeats.
EXACT_CHARS = 1
NARROW = 16
BROADCAST_ROWS = 400_000


def _sided(table: DataFrame, most: int) -> DataFrame:
    """A written table, to be broadcast if it has at most `most` rows and they are small."""
    return sided(table, most)


def _lines(rows: DataFrame, text: str, min_chars: int, exact_chars: int) -> DataFrame:
    lines = rows.select("key", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.where((F.length("line") >= min_chars) | ((F.length("line") >= exact_chars) & F.col("line").rlike("\\S")))


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _without(window: Column, i: Column) -> Column:
    return F.concat(F.substring(window, F.lit(1), i - 1), F.substring(window, i + 1, F.length(window)))


def _cut(rows: DataFrame, size: Column) -> DataFrame:
    """Windows of `text` as the shorter or equal (longer 0) or the longer by one (1) of a pair, as okey, okey2 and window.

    With m the shorter's length and q = m div size (1 at least), window j starts after j chunks of `size` characters and
    ends q - 1 - j chunks before the end, so it has m - (q - 1) chunks of characters, one more in the longer text. okey and
    okey2 hash the group, m, j and the chunks around the window; texts that differ inside it only have them in common.
    """
    sized = rows.withColumn("m", (F.length("text") - F.col("longer")).cast("int")).withColumn("size", size.cast("int"))
    sized = sized.withColumn("q", F.greatest(F.floor(F.col("m") / F.col("size")).cast("int"), F.lit(1)))
    many = F.sequence(F.lit(1), F.col("q"))
    chunk = lambda start: F.xxhash64(F.substring("text", start.cast("int"), F.col("size")))
    fore = F.transform(many, lambda j: chunk((j - 1) * F.col("size") + 1))
    aft = F.transform(many, lambda j: chunk(F.length("text") - j * F.col("size") + 1))
    chunks = sized.withColumn("chunks", F.explode(F.array(F.struct(fore.alias("fore"), aft.alias("aft")))))
    parts = chunks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    before = F.slice("chunks.fore", F.lit(1), F.col("j"))
    behind = F.slice("chunks.aft", F.lit(1), F.col("q") - 1 - F.col("j"))
    return parts.select(
        F.xxhash64("okey", "m", "j", before, behind).alias("okey"),
        F.xxhash64("okey2", behind, "j", before, "m").alias("okey2"),
        "longer",
        "h1",
        "h2",
        "key",
        "pos",
        F.substring("text", F.col("j") * F.col("size") + 1, F.col("m") - (F.col("q") - 1) * F.col("size") + F.col("longer")).alias("text"),
    )


def _halves(lines: DataFrame) -> DataFrame:
    """The two windows of each line, as the shorter or equal (longer 0) and as the longer by one (1) of a pair.

    Of the shorter's m characters, half (rounded down) are the surroundings: the first ones if the edit comes later, else the
    last ones. Plain expressions, so the whole scan compiles to one loop.
    """
    n = F.length("line")

    def window(longer: int, late: bool) -> Column:
        m = n - longer
        half = F.expr(f"(length(line) - {longer}) DIV 2").cast("int")
        around = F.substring("line", F.lit(1), half) if late else F.substring("line", n - half + 1, half)
        return F.struct(
            F.xxhash64(m, F.lit(late), around).alias("okey"), F.xxhash64(around, F.lit(late), m).alias("okey2"), F.lit(longer).alias("longer"),
            (half + 1 if late else F.lit(1)).alias("at"), (n - half).alias("width"),
        )

    return lines.withColumn("w", F.explode(F.array(*[window(longer, late) for longer in (0, 1) for late in (False, True)])))


def _shared(windows: DataFrame, okey: str = "okey") -> DataFrame:
    """The okeys that two different lines have."""
    spread = windows.groupBy(F.col(okey).alias("okey")).agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
    return materialise(spread.where("a <> b").select("okey"), "surroundings")


def _near(lines: DataFrame, broadcast_rows: int) -> DataFrame:
    """Short windows whose surroundings two different lines have, once for each line: halves first, then short windows

    inside those that are left.
    """
    same = ["okey", "okey2", "longer", "h1", "h2"]
    once = lambda rows: rows.groupBy(*same).agg(F.min(F.struct("key", "pos")).alias("first"), F.min("text").alias("text")).select(*same, "first.key", "first.pos", "text")
    halves = _halves(lines)
    shared = _sided(_shared(halves, "w.okey"), broadcast_rows)
    wide = halves.withColumn("okey", F.col("w.okey")).join(shared, "okey").select("okey", "w.okey2", "w.longer", "h1", "h2", "key", "pos", F.substring("line", F.col("w.at"), F.col("w.width")).alias("text"))
    wide = materialise(once(wide), "windows")
    narrow = _cut(wide, F.lit(NARROW))
    return materialise(once(narrow.join(_sided(_shared(narrow), broadcast_rows), "okey")), "windows")


def _earlier(windows: DataFrame) -> DataFrame:
    """(h1, h2) of lines with a verified earlier partner.

    An earlier occurrence of a partner counts; the minimum of places is taken over all occurrences of each line.
    """
    me = F.struct("key", "pos", "h1", "h2", "okey2", "text")
    places = F.sequence(F.lit(1), F.length("text"))
    equal = windows.where("longer = 0").select("okey", me.alias("me"), F.explode(F.transform(places, lambda i: F.xxhash64(F.col("okey"), i, _without(F.col("text"), i)))).alias("v"))
    best = equal.groupBy("v").agg(F.min("me").alias("other"), F.count("*").alias("n")).where("n > 1")
    substituted = equal.join(best, "v").select("me", "other")
    longer = windows.where("longer = 1").select(me.alias("me"), F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.col("okey"), F.lit("d"), _without(F.col("text"), i))))).alias("v"))
    shorter = windows.where("longer = 0").select(me.alias("me"), F.xxhash64(F.col("okey"), F.lit("d"), F.col("text")).alias("v"))
    whole = shorter.groupBy("v").agg(F.min("me").alias("other"))
    deleted = longer.groupBy("v").agg(F.min("me").alias("other"))
    inserted = longer.join(whole, "v").select("me", "other").unionByName(shorter.join(deleted, "v").select("me", "other"))
    pairs = substituted.unionByName(inserted).where("struct(other.key, other.pos) < struct(me.key, me.pos) AND other.okey2 = me.okey2")
    near = pairs.where(F.levenshtein("me.text", "other.text", 1).between(0, 1))
    return near.select("me.h1", "me.h2").distinct()


def dropped_lines(rows: DataFrame, text: str, min_chars: int, exact_chars: int, broadcast_rows: int) -> DataFrame:
    """key and the positions (from 0) of the lines that go, for every row of unique key that loses any."""
    lines = _hashed(_lines(rows, text, min_chars, exact_chars))
    near = materialise(_earlier(_near(lines.where(F.length("line") >= min_chars), broadcast_rows)), "near-lines")
    counted = lines.groupBy("h1", "h2").agg(F.min(F.struct("key", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = counted.select("h1", "h2", "first").unionByName(near.select("h1", "h2", F.lit(None).cast(counted.schema["first"].dataType).alias("first")))
    gone = materialise(repeated.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max(F.col("first").isNull()).alias("all")), "gone-lines")
    places = lines.select("key", "pos", "h1", "h2").join(_sided(gone, broadcast_rows), ["h1", "h2"]).where("all OR key <> first.key OR pos <> first.pos")
    return places.groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dropped_col: str = "n_dropped",
    min_chars: int = MIN_CHARS,
    broadcast_rows: int = BROADCAST_ROWS,
    exact_chars: int | None = None,
) -> DataFrame:
    """docs without lines that have an earlier equal or nearly equal one, and how many went from each.

    Without exact_chars, lines of under min_chars stay.
    """
    if min_chars < 2:
        raise ValueError("min_chars has to be 2 at least")
    least = min_chars if exact_chars is None else exact_chars
    key = free_name(docs.columns, "row_key")
    rows = keyed(docs, id_col, key)
    narrow = rows.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"))
    gone = materialise(dropped_lines(narrow, "text", min_chars, least, broadcast_rows), "gone")
    lost = free_name(rows.columns, "lost")
    joined = rows.join(_sided(gone.withColumnsRenamed({"key": key, "gone": lost}), broadcast_rows), key, "left")
    parts = F.split(F.col(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    out = joined.withColumn(text_col, F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(kept))
    return out.withColumn(free_name(docs.columns, dropped_col), F.coalesce(F.size(lost), F.lit(0)).cast("long")).drop(key, lost)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """documents without repeated lines: the text that is left and how many lines went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, exact_chars=EXACT_CHARS).select("doc_id", "text", "n_dropped")

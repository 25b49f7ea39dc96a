"""Line dedup by winnowing over line hashes, on DataFrame operations alone.

A document is the sequence of its lines that have words. From each line starts a
gram: the fewest lines from there that hold ``GRAM`` words. Of the grams that start
within any ``GRAM`` words the one with the least hash is a fingerprint, so a run of
2 * ``GRAM`` words that repeats anywhere has one, at the same place of each copy.

Every fingerprint is joined with the first position, in the order of ``doc_id``,
that has it. The match is extended both ways, line by line, as far as the lines
agree within ``REACH`` words; fingerprints stand closer than that, so together they
cover the run. Lines of the later copies are deleted, the first ones stay: a line is
deleted only if an earlier one is equal, within a repeated run of ``GRAM`` words.

Each fingerprint meets one other position, never all of its copies, so what a hot
line costs grows with its copies alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.llm.common import fresh, staged

#: Words of a gram, and between fingerprints.
GRAM = 25
#: Words to either side of a fingerprint within which a match is extended.
REACH = 3 * GRAM

#: White space within a line.
_SPACES = " \t\x0b\x0c\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: All but the characters of scripts that put no spaces between words.
_SPACED_SCRIPTS = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]+"


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, pos, line (hash), words, start`` of lines that have words."""
    raw = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("pos", "said"))
    said = F.expr("trim(BOTH ' \t\r' FROM said)")
    # Words are what white space separates, each mark of it; counting needs no splitting.
    words = F.length("said") - F.length(F.translate("said", _SPACES, "")) + 1
    # Scripts without spaces have about a word in two characters.
    unspaced = F.length(F.regexp_replace("said", _SPACED_SCRIPTS, ""))
    words = words + F.when(F.octet_length("said") > F.length("said"), F.floor(unspaced / 2).cast("int")).otherwise(0)
    rows = (
        raw.withColumn("said", said)
        .filter(F.length("said") > 0)
        .select("doc_id", "mark", "pos", F.xxhash64("said").alias("line"), words.alias("words"))
        .repartition("doc_id", "mark")
        .dropDuplicates(["doc_id", "mark", "pos"])  # repeated rows are one document
    )
    before = Window.partitionBy("doc_id", "mark").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.col("words").cast("long")).over(before), F.lit(0)))


def _fingerprints(docs: DataFrame) -> DataFrame:
    """``gram, doc_id, mark, pos`` of fingerprints, with the lines ``left`` of each,
    the nearest first, and those from it on to the ``right``."""
    along = Window.partitionBy("doc_id", "mark").orderBy("start")
    ahead = along.rangeBetween(0, GRAM - 1)
    element = F.struct("line", "pos")
    grams = (
        _lines(docs)
        .withColumn("held", F.sum("words").over(ahead))
        .withColumn("gram", F.when(F.col("held") >= GRAM, F.xxhash64(F.collect_list("line").over(ahead))))
        .withColumn("left", F.reverse(F.collect_list(element).over(along.rangeBetween(-REACH, -1))))
        .withColumn("right", F.collect_list(element).over(along.rangeBetween(0, REACH)))
    )
    # Least hash, and of equal ones the last.
    least = F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", (-F.col("pos")).alias("back")))).over(ahead)
    picks = F.collect_set(-F.col("least.back")).over(along.rangeBetween(-GRAM + 1, 0))
    return (
        grams.withColumn("least", least)
        .withColumn("picks", picks)
        .filter(F.col("gram").isNotNull() & F.array_contains("picks", F.col("pos")))
        .select("gram", "doc_id", "mark", "pos", "left", "right")
    )


def _agreeing(mine: Column, other: Column) -> Column:
    """How many elements from the first on have equal lines."""
    same = F.zip_with(mine, other, lambda a, b: a["line"].eqNullSafe(b["line"]))
    miss = F.array_position(same, False)
    return F.when(miss == 0, F.size(same)).otherwise(miss - 1).cast("int")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, gone``: the numbers (from 0) of the lines to delete, in order,
    of each document that has any; ``mark`` is the hash of its text.

    Null and empty texts have no lines. Rows that share ``doc_id`` and text are one
    document; a null ``doc_id`` comes before all others. Other columns are ignored.
    """
    prints = staged(_fingerprints(docs), "fingerprints")
    place = F.struct("doc_id", "mark", "pos")
    first = prints.groupBy("gram").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    repeated = staged(prints.join(first.select("gram", "first"), "gram"), "repeated")
    is_first = (
        F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
        & (F.col("mark") == F.col("first.mark"))
        & (F.col("pos") == F.col("first.pos"))
    )
    source = repeated.filter(is_first).select("gram", F.col("left").alias("left0"), F.col("right").alias("right0"))
    match = repeated.filter(~is_first).join(source, "gram")
    gone = F.concat(
        F.slice("left", F.lit(1), _agreeing(F.col("left"), F.col("left0"))),
        F.slice("right", F.lit(1), _agreeing(F.col("right"), F.col("right0"))),
    )
    return (
        match.select("doc_id", "mark", F.explode(gone["pos"]).alias("pos"))
        .groupBy("doc_id", "mark")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )


def without_lines(docs: DataFrame, gone: DataFrame, removed: str | None = None) -> DataFrame:
    """The documents, all columns, with the lines that ``repeated_lines`` names
    deleted from their texts; the others are untouched. ``removed`` names a column
    for the number of deleted lines."""
    id_, mark, lines, kept = (fresh(docs, name) for name in ("gone_id", "gone_mark", "gone_lines", "kept_lines"))
    named = gone.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("gone").alias(lines))
    both = docs.join(named, docs["doc_id"].eqNullSafe(named[id_]) & (F.xxhash64(docs["text"]) == named[mark]), "left")
    said = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(said) - 1), F.col(lines))
    cut = F.when(F.col(lines).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col(kept), i)), "\n")
    )
    out = both.withColumn(kept, F.when(F.col(lines).isNotNull(), said))
    columns = [cut.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if removed:
        columns.append(F.coalesce(F.size(lines), F.lit(0)).alias(removed))
    return out.select(*columns)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without the later copies of repeated runs of lines."""
    return without_lines(docs, repeated_lines(docs))

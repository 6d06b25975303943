"""Threshold-scaled document sketches (operator 1): DataFrame functions only.

A text's words are lower-cased and every ``width`` words in a row are hashed to 52 bits; the sketch
keeps each hash below a fixed fraction of the range.  So the sketch of a union is the union of the
sketches, and a small text's sketch is comparable with that of a text a thousand times as long:
the share of one sketch found in the other estimates the containment of their shingle sets.

A fingerprint is text: the number of words, a 64-bit digest of them, and the kept hashes in rising
order, in hex.  Likeness is the Jaccard estimate from the kept hashes; where neither text kept any
(only short texts), it is 1 for equal digests and else 0.

Defined results: null text is empty; texts with fewer words than ``width`` are one shingle, empty
texts none, and two empty texts are alike (1).  Tables without rows give none; repeated rows are
sketched alike; other columns are kept.  Each text is sketched whole, in its own row; nothing is
gathered by group (``merge`` keeps one row a hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

WIDTH = 5
#: One hash in so many is kept.
SCALE = 8
_BITS = 52
_SEPARATORS = r"[\x20\x09-\x0D]+"


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """struct(n_words, digest, hashes): the sketch of a text."""
    words = F.filter(F.split(F.lower(text), _SEPARATORS), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.struct(
        F.size(w).alias("n_words"), F.xxhash64(w).alias("digest"), _kept(w, width, scale).alias("hashes")))[0]


def _kept(words: Column, width: int, scale: int) -> Column:
    n = F.size(words)
    hashed = F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, F.array(F.xxhash64(words))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))),
                    lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])))
    # the top bits decide, the rest is the hash that is kept
    low = F.filter(F.transform(hashed, lambda h: F.shiftrightunsigned(h, 64 - _BITS)), lambda h: h < (1 << _BITS) // scale)
    return F.sort_array(F.array_distinct(low))


def fingerprint(s: Column) -> Column:
    """A sketch as text."""
    return F.concat_ws(":", s["n_words"].cast("string"), F.lower(F.hex(s["digest"])),
                       F.array_join(F.transform(s["hashes"], lambda h: F.lower(F.hex(h))), ","))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches, 0 to 1."""
    both, either = F.size(F.array_intersect(a["hashes"], b["hashes"])), F.size(F.array_union(a["hashes"], b["hashes"]))
    same = (a["digest"] == b["digest"]) & (a["n_words"] == b["n_words"])
    return F.when(same, 1.0).when(either == 0, 0.0).otherwise(both / F.greatest(either, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimate of the share of a's shingles that b has; null if a kept none."""
    return F.size(F.array_intersect(a["hashes"], b["hashes"])) / F.nullif(F.size(a["hashes"]), F.lit(0))


def merge(df: DataFrame, key: str, column: str = "sketch") -> DataFrame:
    """The sketches of unions of texts, one row for each key and kept hash: no group is gathered."""
    return df.select(key, F.explode(f"{column}.hashes").alias("hash")).distinct()


# ---------------------------------------------------------------- each document beside the next one

def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, prev_id, prev_half): for each distinct doc_id, the id that comes before it in
    descending order (the first: the last), and half that document's longest length.

    Only ids and lengths are ordered: within slots of about equally many ids (range partitions, so
    far outliers don't crowd the others together), then over one row a slot."""
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n")).checkpoint()
    # written down, so that a task that is run again finds the same slots
    ids = ids.repartitionByRange("doc_id").withColumn("slot", F.spark_partition_id()).checkpoint()
    rising = Window.orderBy("slot")
    ends = (ids.groupBy("slot").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("low"))
            .withColumn("above", F.lead("low").over(rising))
            .withColumn("above", F.coalesce("above", F.first("low").over(rising)))
            .select("slot", "above"))
    own = F.lead(F.struct("doc_id", "n")).over(Window.partitionBy("slot").orderBy("doc_id"))
    before = F.coalesce(F.col("own"), F.col("above"))
    return (ids.withColumn("own", own).join(ends, "slot")
            .select("doc_id", before["doc_id"].alias("prev_id"), F.floor(before["n"] / 2).cast("int").alias("prev_half")))


def beside_next(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """For each document (doc_id, text): its sketch, its text with the last half replaced by the
    start of the next document's, and both other sketches.

    A text crosses the network once by its own id, and its start once more to the document before.
    Repeated ids: as next document, the greatest text of an id stands for it.  Rows with a null id
    have no next document: their last half is dropped, and ``next_sketch`` is null.
    """
    docs = docs.select("doc_id", text_of().alias("text")).withColumn("sketch", sketch(F.col("text"), width, scale))
    placed = docs.where(F.col("doc_id").isNotNull()).repartition("doc_id")
    links = neighbours(docs)
    sent = (placed.groupBy("doc_id").agg(F.max(F.struct("text", "sketch")).alias("x"))
            .join(links, "doc_id")
            .select(F.col("prev_id").alias("doc_id"), F.substring("x.text", F.lit(1), F.col("prev_half")).alias("start"),
                    F.col("x.sketch").alias("next_sketch")))
    rows = placed.join(sent, "doc_id", "left").unionByName(
        docs.where(F.col("doc_id").isNull()).withColumn("start", F.lit("")).withColumn("next_sketch", F.lit(None)), allowMissingColumns=True)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("start", F.lit("")), F.lit(1), half))
    return rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), width, scale)).drop("start")

"""Exact n-gram Jaccard self join by a size-aware heavy-light split (operator 3).

A document's set holds its distinct ``width``-word shingles.  Documents of equal sets are one class,
told by a 128-bit digest of the set; only classes are compared.

All sets are ordered by one global order: shingles that a first pass found common come last.  If two
sets reach the threshold, their first c common shingles lie within a prefix of each whose length
depends on its own size only.  So
* a light set (below the boundary) publishes every pair (c = 2) of its prefix: sets are compared only
  where two shingles meet;
* a heavy set publishes every shingle (c = 1) of its shorter prefix, and so do the light sets that are
  large enough to reach a heavy one: their inverted lists are scanned.
The boundary is the size with the least cost, from the histogram of sizes: rows to write for the
subsets against postings to write and scan.

Lists with one class are dropped.  What is asked for is the components of the links, so a list isn't
multiplied out: every class is first compared with one hub of like size from its lists, in a few
rounds; linked classes merge, and then only pairs of a list that are still in different components are compared.  Of
these only the pairs are left that share as many signatures as the threshold asks of any pair, and
whose parity sketches differ in no more bits than the two sets may differ in shingles (each shingle
flips one bit, so sets always differ in at least as many); the same test on sketches as long as the
sets leaves those that are checked on the two whole texts.  After the rounds, lists of the same members are compared
once, a pair where it meets first, and by the long sketches at once.  Nothing is dropped: a link between two classes is either found
or lies inside a component.

Defined results: null and empty texts and texts without words have empty sets, linked with nothing;
texts with fewer words than ``width`` are one shingle.  Repeated rows are equal sets.  Rows of one
doc_id count as one document.  Rows without doc_id get the component of their class if a row with an
id has the same set, else null, and start no link.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.broadcast import broadcast_if_small
from ..session import scratch_path
from ..sources.storage import remove_folder
from .common import mix64, released, shingle_set
from .graph import components

WIDTH, PERCENT = 3, 90
#: Slots of the counting table.
SLOTS = 1 << 22
#: Cost of a posting in an inverted list, in rows of subsets.
SCAN_COST = 4.0
#: Words of 64 bits of a set's parity sketch.
SKETCH = 4
#: Sets that a task remembers to have published.
SEEN = 100_000
#: Bits that a wide sketch may have beyond its set's size.
SHARP = 1 << 12
#: Bits of a wide sketch that go with a set to the lists it is compared in; stored bytes of such sketches that are broadcast.
LIST_BITS, LIST_BROADCAST = 1 << 14, 4 << 20
#: Earlier lists of a set that go with it to a list.
EARLIER = 64
#: Rounds of hubs, while the pairs left are more than so many times the postings and each round leaves at most so large a
#: part of them; tries a round.
HUB_ROUNDS, ENOUGH, LESS, TRIES = 6, 2, 0.97, 4


def least_overlap(n: np.ndarray | int, percent: int):
    """The least number of common shingles with any partner."""
    return (percent * n + 99) // 100


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, whatever the order."""
    with np.errstate(over="ignore"):
        a = int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) if s.size else 0
        b = int(mix64(s + np.uint64(0x1234567)).sum(dtype=np.uint64)) if s.size else 0
    return a - (1 << 63), b - (1 << 63)


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """``SKETCH`` words; each bit tells whether an odd number of shingles falls on it."""
    at = ((s >> np.uint64(32)) % np.uint64(64 * SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def wide_sketch(s: np.ndarray) -> bytes:
    """The set's size (8 bytes) and a parity sketch of at least as many bits as it has shingles (a power of two, 256 or more),
    and of four times as many up to ``SHARP`` bits: few differences of two sets then fall on one bit.

    A longer one folds to a shorter one's length by the exclusive or of its parts."""
    bits = max(1 << max(8, int(s.size - 1).bit_length()), min(SHARP, 1 << int(4 * s.size - 1).bit_length()))
    at = ((s >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return int(s.size).to_bytes(8, "little") + np.packbits(odd, bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, percent: int) -> bool:
    """Whether sets of these wide sketches can reach the threshold: never false for two that do."""
    n, m = int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little")
    x, y = sorted((np.frombuffer(z, dtype=np.uint8, offset=8) for z in (a, b)), key=len)
    differ = int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, x.size), axis=0)).sum())
    least = -(-percent * (n + m) // (100 + percent))
    return differ <= n + m - 2 * least


def _size_class(n: int) -> int:
    return n if n < 1000 else 1000 + int(50 * np.log2(n / 1000))


# ---------------------------------------------------------------- first pass

def _first_pass(docs: DataFrame, width: int) -> DataFrame:
    """Rows of three kinds: 0 a document (id, size, key, sketches), 1 a common slot and its count, 2 a
    class of sizes and its count."""
    bits = [f"b{i}" for i in range(SKETCH)]
    columns = ["kind", "doc_id", "n", "k1", "k2", *bits, "wide"]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, sizes, total = np.zeros(SLOTS, dtype=np.int32), {}, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                s = shingle_set((text or "").encode("utf-8"), width)
                at = (s & np.uint64(SLOTS - 1)).astype(np.int64)
                if s.size > SLOTS // 16:
                    slots += np.bincount(at, minlength=SLOTS).astype(np.int32)
                else:
                    np.add.at(slots, at, 1)
                total += s.size
                k = _size_class(s.size)
                sizes[k] = sizes.get(k, 0) + 1
                rows.append((0, None if pd.isna(doc_id) else int(doc_id), s.size, *set_key(s), *parity_sketch(s), wide_sketch(s)))
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
        mean = total / SLOTS
        common = np.flatnonzero(slots > mean + 4 * np.sqrt(mean) + 2)      # far above what chance gives
        none = dict.fromkeys(columns[3:-1], 0) | {"wide": None}
        yield pd.DataFrame({"kind": 1, "doc_id": pd.array(common, dtype="Int64"), "n": slots[common].astype(np.int64), **none})
        yield pd.DataFrame({"kind": 2, "doc_id": pd.array(list(sizes), dtype="Int64"), "n": list(sizes.values()), **none})

    return docs.select("doc_id", "text").mapInPandas(released(part), "kind int, " + ", ".join(f"{c} long" for c in columns[1:-1]) + ", wide binary")


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The least-cost boundary between light and heavy sets, from counts by size class."""
    size = lambda k: k if k < 1000 else int(1000 * 2 ** ((k - 1000) / 50))
    pairs = sorted((size(k), n) for k, n in sizes.items() if k > 1)
    if not pairs:
        return 2
    s, n = (np.array(x, dtype=np.float64) for x in zip(*pairs))
    p1 = s - least_overlap(s, percent) // 1 + 1
    p2 = p1 + 1
    light, heavy = n * p2 * (p2 - 1) / 2, n * p1 * SCAN_COST
    best, cost = 2, np.inf
    for x in [2, *(s + 1).astype(int)]:
        c = light[s < x].sum() + heavy[100 * s >= percent * x].sum()
        if c < cost:
            best, cost = int(x), c
    return best


# ---------------------------------------------------------------- postings

def signatures(s: np.ndarray, common: np.ndarray, boundary: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a set publishes: signatures, the place of each one's first shingle in the order, and
    how many shingles (1 or 2) each one stands for."""
    n = s.size
    rest = n - int(least_overlap(n, percent))
    first = min(n, rest + 2)
    freq = common[(s & np.uint64(SLOTS - 1)).astype(np.int64)]
    prefix = s[np.lexsort((s, freq))[:first]] if freq.any() else s[:first]
    sig, at, kind = [], [], []
    with np.errstate(over="ignore"):
        if n < boundary and n >= 2:
            i, j = np.triu_indices(prefix.size, 1)
            sig.append(mix64(mix64(prefix[i]) + prefix[j]))
            at.append(i)
            kind.append(np.full(i.size, 2))
        if 100 * n >= percent * boundary:
            one = prefix[:min(n, rest + 1)]
            sig.append(mix64(one ^ np.uint64(0x5DEECE66D)))
            at.append(np.arange(one.size))
            kind.append(np.ones(one.size, dtype=np.int64))
    if not sig:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(sig), np.concatenate(at), np.concatenate(kind)


def _postings(docs: DataFrame, width: int, percent: int, boundary: int, common) -> DataFrame:
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        at_slot, times = common.value
        table = np.zeros(SLOTS, dtype=np.int32)
        table[at_slot] = times
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingle_set((text or "").encode("utf-8"), width)
                key = set_key(s)
                if s.size == 0 or key in seen:
                    continue
                if len(seen) >= SEEN:               # only saves work: equal rows meet again where lists are made
                    seen.clear()
                seen.add(key)
                sig, at, kind = signatures(s, table, boundary, percent)
                if sig.size:
                    out.append(np.column_stack([sig.view(np.int64), np.full(sig.size, key[0]), np.full(sig.size, key[1]), np.full(sig.size, s.size), at, kind]))
            if out:
                yield pd.DataFrame(np.concatenate(out), columns=["sig", "k1", "k2", "n", "at", "kind"])

    return (docs.where(F.col("doc_id").isNotNull()).select("text")
            .mapInPandas(released(part), "sig long, k1 long, k2 long, n long, at long, kind long"))


# ---------------------------------------------------------------- checking pairs

def _store(df: DataFrame, path: str) -> DataFrame:
    """``df`` written and read back; the shuffle files of making it go at once."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _side_by_side(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """(u, v, a, b): the pairs with the value of both, from ``rows`` (doc_id, value).

    The pairs are narrow: where their size is below the bound they are sent to the rows, so that only
    values of u move, once a pair, to the values of v; else both sides are shuffled."""
    ends = pairs.select(F.col("v").alias("doc_id")).distinct()
    left = rows.select(F.col("doc_id").alias("u"), F.col(value).alias("a")).join(broadcast_if_small(pairs), "u")
    right = rows.select("doc_id", F.col(value).alias("b")).join(broadcast_if_small(ends), "doc_id").withColumnRenamed("doc_id", "v")
    return left.join(right, "v").select("u", "v", "a", "b")


def _checked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int, path: str) -> DataFrame:
    """Those (u, v) whose sets reach the threshold; u and v are doc_ids.

    Texts move only for the pairs that wide sketches (about a fiftieth of the texts) leave."""
    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[may_link(a, b, percent) for a, b in zip(batch["a"], batch["b"])], ["u", "v"]]

    pairs = _store(pairs, f"{path}-pairs")
    wide = sets.select(F.col("node").alias("doc_id"), "wide")
    pairs = _store(_side_by_side(pairs, wide, "wide").mapInPandas(released(alike), "u long, v long").distinct(), f"{path}-alike")
    both = _side_by_side(pairs, docs, "text")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, np.ndarray] = {}

        def set_of(text: str | None) -> np.ndarray:
            if text not in kept:
                if len(kept) >= 32:
                    kept.clear()
                kept[text] = shingle_set((text or "").encode("utf-8"), width)
            return kept[text]

        for batch in batches:
            good = []
            for a, b in zip(batch["a"], batch["b"]):
                x, y = set_of(a), set_of(b)
                common = np.intersect1d(x, y, assume_unique=True).size
                good.append(common > 0 and 100 * common >= percent * (x.size + y.size - common))
            yield batch.loc[good, ["u", "v"]]

    return _store(both.mapInPandas(released(part), "u long, v long").distinct(), f"{path}-links")


def _least_common(percent: int):
    """The least number of common shingles of sets of n and n2."""
    return F.ceil(F.lit(percent) * (F.col("n") + F.col("n2")) / (100 + percent) - F.lit(1e-9))


def _may_reach(percent: int):
    """Whether two postings (n, at and hub's n2, at2) can belong to a pair at the threshold."""
    at_most = F.least("at", "at2") + 1 + F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) - 1
    return (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (at_most >= _least_common(percent))


def _may_be_first(percent: int):
    """Whether the shingle (of a pair signature: its first one) can be the first that a linked pair has in common.

    Beyond the first common one a set has n - at - 1 shingles left, so the pair reaches the threshold for *these* two
    sizes only if both sets have at most n - least common ones before it.  Every linked pair meets in such a place."""
    least = _least_common(percent)
    return (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (F.col("at") <= F.col("n") - least) & (F.col("at2") <= F.col("n2") - least)


def _may_differ(percent: int):
    """Whether the sketches of a pair (bits and bits2) differ no more than sets at the threshold may.

    A bit differs only where the two sets differ in a shingle, and each such shingle flips one bit."""
    differ = sum(F.bit_count(F.col(f"bits.b{i}").bitwiseXOR(F.col(f"bits2.b{i}"))) for i in range(SKETCH))
    return differ <= F.col("n") + F.col("n2") - 2 * _least_common(percent)


def _enough_shared(percent: int):
    """Whether a pair that shares ``shared`` signatures of a kind can reach the threshold.

    Up to the end of the prefix that ends first in the order, every common shingle is a shared one;
    beyond it there are no more than that set's other shingles."""
    beyond = lambda n: n - F.least(n, n - F.floor((percent * n + 99) / 100) + F.col("kind"))
    shingles = F.when(F.col("kind") == 1, F.col("shared")).otherwise(F.floor((1 + F.sqrt(1 + 8 * F.col("shared"))) / 2))
    return shingles + F.greatest(beyond(F.col("n")), beyond(F.col("n2"))) >= _least_common(percent)


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, k1, k2 (its class), component_id."""
    spark = docs.sparkSession
    base = scratch_path(spark, f"jaccard-{uuid.uuid4().hex}")
    first = _store(_first_pass(docs, width), f"{base}/first")
    # a table of fixed size (SLOTS entries at most), and one of size classes
    found = first.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).toArrow()
    common = found["doc_id"].to_numpy(), np.minimum(found["n"].to_numpy(), 2**31 - 1).astype(np.int32)
    sizes = {r["doc_id"]: r["n"] for r in first.where("kind = 2").groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    boundary = choose_boundary(sizes, percent)

    rows = first.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2")
    bits = F.struct(*[f"b{i}" for i in range(SKETCH)])
    sets = _store(first.where("kind = 0 AND n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2")
                  .agg(F.min("doc_id").alias("node"), F.min(bits).alias("bits"), F.min("wide").alias("wide")), f"{base}/sets")
    classes = sets.select("k1", "k2", "node")
    sent = spark.sparkContext.broadcast(common)
    posted = _postings(docs, width, percent, boundary, sent).repartition("sig").dropDuplicates(["sig", "k1", "k2"])
    by_sig = Window.partitionBy("sig")
    live = posted.withColumn("many", (F.min("k1").over(by_sig) != F.max("k1").over(by_sig)) | (F.min("k2").over(by_sig) != F.max("k2").over(by_sig))).where("many")
    lists = _store(live.join(broadcast_if_small(classes), ["k1", "k2"]).select("sig", "node", "n", "at", "kind"), f"{base}/lists")

    comp = _components(lists, sets, docs, width, percent, base)
    out = (rows.join(classes, ["k1", "k2"], "left")
           .join(comp, "node", "left")
           .select("doc_id", "n_shingles", "k1", "k2",
                   F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node")).alias("component_id")))
    return out


def _components(lists: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int, base: str) -> DataFrame:
    """(node, component) of the links between classes that meet in lists; classes without links may be missing."""
    spark, sketches = lists.sparkSession, sets.select("node", "bits")
    comp, left, rest = None, None, None
    for round_ in range(HUB_ROUNDS):
        now = lists if comp is None else _store(_mixed(lists, comp), f"{base}/mixed-{round_}")
        if comp is not None:
            todo = now.agg(F.sum(F.when(~F.col("main"), F.col("length")).otherwise(0)), F.count("*")).first()
            if not todo[1] or todo[0] <= ENOUGH * todo[1] or (left is not None and todo[0] > LESS * left):
                rest = now
                break
            left = todo[0]
        good = _checked(_hub_pairs(now, sketches, round_, percent), docs, sets, width, percent, f"{base}/hubs-{round_}")
        comp = _store(components(_joined(good, comp)), f"{base}/components-{round_}")
        remove_folder(spark, f"{base}/mixed-{round_}")                 # its links are written
    rest = _store(_mixed(lists, comp), f"{base}/mixed") if rest is None else rest
    more = _checked(_rest_pairs(rest, sets, percent, f"{base}/rest"), docs, sets, width, percent, f"{base}/rest")
    if not more.isEmpty():
        comp = components(_joined(more, comp))
    return comp


def _joined(links: DataFrame, comp: DataFrame | None) -> DataFrame:
    """New links beside the components so far, each as a star: edges of the same components as all links found."""
    return links if comp is None else links.unionByName(comp.select(F.col("node").alias("u"), F.col("component").alias("v")))


def _alike(shared: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v, n, n2 ...) whose sketches may belong to linked sets."""
    small = broadcast_if_small(sketches)
    return (shared.join(small.withColumnRenamed("node", "u"), "u").join(small.select(F.col("node").alias("v"), F.col("bits").alias("bits2")), "v")
            .where(_may_differ(percent)).drop("bits", "bits2"))


def _hub_pairs(lists: DataFrame, sketches: DataFrame, round_: int, percent: int) -> DataFrame:
    """A few pairs a class: with hubs that most of its lists have.  A list's hub is the class of like
    size that a hash of the round puts first; odd rounds shift the classes of size.  Once lists have
    a main component, only the classes outside it look for hubs: in half of the tries one of its classes, in the others one of
    those outside, so that classes of one group find each other though none of them is linked with the main component's."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)) + 0.5 * (round_ % 2)).cast("int")
    late = "main" in lists.columns
    rows = (lists if late else lists.withColumn("c", F.col("node"))).withColumn("band", band)

    def first(k: int):
        """The hub of try ``k``."""
        rank = F.struct(F.xxhash64(F.lit(round_ if k % 2 else round_ // 2), F.lit(k), "node").alias("h"), "node", "n", "at", "c")
        return F.min(rank if not late else F.when(~F.col("main") if k % 2 else F.col("main"), rank)).alias(f"h{k}")

    tries = range(TRIES if late else 1)
    hubs = rows.groupBy("sig", "band").agg(*[first(k) for k in tries])
    near = ((rows.where("NOT main") if late else rows).select("sig", "node", "n", "at", "kind", "c", "band").join(hubs, ["sig", "band"])
            .select("node", "n", "at", "kind", "c", F.posexplode(F.array(*[f"h{k}" for k in tries])).alias("try", "hub"))
            .where("c <> hub.c").withColumn("n2", F.col("hub.n")).withColumn("at2", F.col("hub.at"))
            .where(_may_reach(percent)))
    shared = (near.groupBy(F.col("node").alias("u"), "n", "kind", F.col("hub.node").alias("v"), "n2", "try")
              .agg(F.count("*").alias("shared")).where(_enough_shared(percent)))
    best = _alike(shared, sketches, percent).groupBy("u", "try").agg(F.max_by("v", F.struct("shared", "v")).alias("v"))
    return best.select("u", "v").distinct()


def _mixed(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """The lists that hold several components, with each row's component, whether it is the list's
    main (most frequent) one, and the list's length."""
    c = (lists.join(broadcast_if_small(comp.withColumnRenamed("component", "c")), "node", "left") if comp is not None else lists.withColumn("c", F.lit(None).cast("long")))
    c = c.withColumn("c", F.coalesce("c", "node"))
    parts = c.groupBy("sig", "c").agg(F.count("*").alias("k"))
    whole = (parts.groupBy("sig").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.sum("k").alias("length"), F.count("*").alias("parts"))
             .where("parts > 1").select("sig", "most", "length"))
    return c.join(whole, "sig").withColumn("main", F.col("c") == F.col("most")).drop("most")


def _same_members(mixed: DataFrame) -> DataFrame:
    """(g1, g2, node, n, at, c, main, earlier): one list for all lists of the same members, told by 128 bits of them, and for
    each member its first lists before this one.

    Such lists give the same pairs, and have the same main component.  The order of shingles is global, so the first places
    of two members are those of one shingle, the first that the merged lists have: a pair that one of them allows is allowed."""
    members = mixed.groupBy("sig").agg(*[F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"g{i}") for i in (1, 2)])
    lists = (mixed.join(members, "sig").groupBy("g1", "g2", "node")
             .agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("c").alias("c"), F.first("main").alias("main")))
    by_place = Window.partitionBy("node").orderBy("at", "g1", "g2")
    return (lists.withColumn("place", F.row_number().over(by_place))
            .withColumn("some", F.collect_list(F.when(F.col("place") <= EARLIER, F.struct("g1", "at"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1)))
            # a list of the same place is no earlier one
            .withColumn("earlier", F.transform(F.filter("some", lambda x: x["at"] < F.col("at")), lambda x: x["g1"])).drop("place", "some"))


def _words(wide: DataFrame) -> DataFrame:
    """(node, words, half) of (node, wide): the wide sketch as 64-bit words, folded to ``LIST_BITS`` at most, and folded to
    half as many."""
    fold = lambda x, parts: np.bitwise_xor.reduce(x.reshape(parts, -1), axis=0)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [np.frombuffer(w, dtype=np.int64, offset=8) for w in batch["wide"]]
            x = [fold(w, max(1, 64 * w.size // LIST_BITS)) for w in x]
            yield pd.DataFrame({"node": batch["node"], "words": x, "half": [fold(w, 2) for w in x]})

    return wide.mapInPandas(released(part), "node long, words array<long>, half array<long>")


def _words_may_differ(percent: int):
    """Whether the sketches (words, half and words2, half2) of a pair differ no more than sets at the threshold may.

    Sets of like size have sketches of one length, or one of twice the other's, whose half is taken; what has neither
    isn't told apart here."""
    x = F.when(F.size("words") > F.size("words2"), F.col("half")).otherwise(F.col("words"))
    y = F.when(F.size("words2") > F.size("words"), F.col("half2")).otherwise(F.col("words2"))
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)
    return F.coalesce(differ <= F.col("n") + F.col("n2") - 2 * _least_common(percent), F.lit(True))


def _rest_pairs(mixed: DataFrame, sets: DataFrame, percent: int, path: str) -> DataFrame:
    """Pairs in different components that may be linked: in each list, those outside its main component with those
    others beside which the list's shingle can be their first common one.

    Lists of the same members are compared once, a pair only where it meets first, and by sketches that grow with the sets:
    sets that only have passages in common are refused where they meet, and don't become rows."""
    lists = _store(_same_members(mixed), f"{path}-lists")
    words = _store(_words(sets.join(lists.select("node").distinct(), "node", "left_semi").select("node", "wide")), f"{path}-words")
    rows = lists.join(broadcast_if_small(words, LIST_BROADCAST), "node")
    a = rows.where(~F.col("main")).drop("main")
    b = rows.select("g1", "g2", *[F.col(x).alias(f"{x}2") for x in ("node", "n", "at", "c", "main", "earlier", "words", "half")])
    near = a.join(b, ["g1", "g2"]).where((F.col("c") != F.col("c2")) & (F.col("main2") | (F.col("node") < F.col("node2")))
                                         & _may_be_first(percent) & ~F.arrays_overlap("earlier", "earlier2") & _words_may_differ(percent))
    # the outer one of a pair may be outside the main component in one list and inside it in another
    return near.select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v")).distinct()


# ---------------------------------------------------------------- one document of each group

def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (its columns) without near copies: of each component the document of the
    least doc_id, one row of it; empty documents stay.  Of rows without doc_id those go whose set a
    row with one has, and one row of each other set stays."""
    linked = link_components(docs, width, percent).checkpoint()
    kept = linked.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    with_id = (docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
               .withColumn("__row", F.row_number().over(one)).where("__row = 1").select(*docs.columns))

    @F.pandas_udf("n long, k1 long, k2 long")
    def key_of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set((t or "").encode("utf-8"), width) for t in texts]
        return pd.DataFrame([(s.size, *set_key(s)) for s in sets], columns=["n", "k1", "k2"])

    without = docs.where(F.col("doc_id").isNull()).withColumn("__key", key_of("text"))
    known = linked.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).select(F.struct(F.col("n_shingles").alias("n"), "k1", "k2").alias("__key")).distinct()
    lone = (without.where("__key.n > 0").join(known, "__key", "left_anti").dropDuplicates(["__key"])
            .unionByName(without.where("__key.n = 0")).select(*docs.columns))
    return with_id.unionByName(lone)

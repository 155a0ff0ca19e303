"""N-gram Jaccard join by size: subsets of small sets, inverted lists of parts of large ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut, release, small_batches
from .components import components
from .hashing import GOLDEN, mix
from .hashing import words as word_hashes


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the runs of ``n`` words; of all words as one if they are fewer.

    A-Z are lower-cased; words are runs without white space. Words are known by ``hashing.words``.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    inside = np.empty(len(b) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not((b == 32) | ((b >= 9) & (b <= 13)), out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    w = word_hashes(data, start, end)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h = mix(h * GOLDEN + w[i : len(w) - k + 1 + i])
    return np.unique(h)


@dataclass(frozen=True)
class Plan:
    """What a set of a size emits so that every pair with 100 * intersection >= ``share`` * union meets."""

    share: int
    ratio: float = 1.25  # of the largest size of a class to its smallest
    slack: int = 4  # one part more for so many elements that may differ: it must agree
    weak: int = 4  # a part of fewer than so many shingles counts as so many, for what it lets through

    def differ(self, a: int, b: int) -> int:
        """The most elements that are in one only of two linked sets of sizes ``a`` and ``b``."""
        return (100 - self.share) * (a + b) // (100 + self.share)

    def least(self, size: int) -> int:
        """The fewest elements that a linked set has in common with a set of ``size``."""
        return -(-self.share * size // 100)

    def subsets(self, size: int) -> int:
        return sum(comb(size, i) for i in range(size - self.least(size) + 1))

    def parts(self, top: int) -> tuple[int, int, int]:
        """Of a class whose largest size is ``top``: the parts, the empty parts that a set may have, the parts that agree.

        ``d`` elements that differ spoil ``d`` parts at most; of the others, a set without more empty parts than allowed
        has the last number at least that are not empty. (A set with more emits empty parts as well.)
        """
        d = self.differ(top, top)
        empty, agree = 2 + d // 32, 1 + d // self.slack
        return d + empty + agree, empty, agree

    @property
    def boundary(self) -> int:
        """The largest size whose subsets cost no more than its parts in the first class beyond."""
        size = 1
        while True:
            parts, *_ = self.parts(int((size + 1) * self.ratio))
            strong = (size + 1) / parts >= self.weak
            if self.subsets(size + 1) > 2 * parts * (1 if strong else self.weak):
                return size
            size += 1

    def classes(self, size: int) -> list[tuple[int, int]]:
        """(lowest, top) of the classes of larger sets that a set of ``size`` meets, from its own on; none if small."""
        low, out = self.boundary + 1, []
        while low * self.share <= size * 100:
            top = max(low, int(low * self.ratio))
            if size <= top:
                out.append((low, top))
            low = top + 1
        return out

    def signatures(self, s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """[(class, need, numbers), ...]: two linked sets have at least ``need`` numbers in common in one class.

        The numbers stand for whole subsets if the sets are small, else for the parts of a class.
        """
        size, out = len(s), []
        h = mix(s)
        if size <= self.boundary:
            whole = np.add.reduce(h)
            keys = []
            for i in range(size - self.least(size) + 1):
                gone = np.array([np.add.reduce(h[list(c)]) for c in combinations(range(size), i)], np.uint64) if i else np.zeros(1, np.uint64)
                keys.append(mix((whole - gone) * GOLDEN + np.uint64(size - i)))
            out.append((0, 1, np.unique(np.concatenate(keys))))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(h, out=total[1:])
        for low, top in self.classes(size):
            m, empty, agree = self.parts(top)
            part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            at = np.searchsorted(part, np.arange(m + 1, dtype=np.uint64))
            full = at[1:] > at[:-1]
            sums = mix((total[at[1:]] - total[at[:-1]]) ^ mix(np.arange(m, dtype=np.uint64) + np.uint64(low << 32)))
            out.append((low, agree, sums if m - int(full.sum()) > empty else sums[full]))
        return out


def linked(sets: list[np.ndarray], share: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between sets that are enough to connect all that are linked.

    Each set in turn scans the inverted lists of its elements, which gives its intersections with all others. With
    ``sides`` only sets of different sides are compared.
    """
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    _, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(n), sizes)
    keep = count[inverse] > 1
    inverse, of = inverse[keep], of[keep]
    order = np.argsort(inverse, kind="stable")
    lists, names = of[order], inverse[order]
    first = np.searchsorted(names, np.arange(len(count) + 1))
    bounds = np.searchsorted(of, np.arange(n + 1))
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, side = [], None if sides is None else np.array(sides)
    for i in range(n):
        mine = inverse[bounds[i] : bounds[i + 1]]
        if not len(mine):
            continue
        m = first[mine + 1] - first[mine]
        ends = np.cumsum(m)
        got = np.bincount(lists[np.arange(ends[-1]) + np.repeat(first[mine] - (ends - m), m)], minlength=n)
        ok = (100 + share) * got >= share * (sizes + sizes[i])
        ok[i:] = False
        if side is not None:
            ok &= side != side[i]
        for j in np.flatnonzero(ok & (got > 0)):
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def _check(rows: DataFrame, words: int, share: int, parts: int) -> DataFrame:
    """(bin, side, text) -> links (a, b) by fingerprint, each bin in one task; side is null where all are compared."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sets = None, {}

        def flush() -> pd.DataFrame:
            names = list(sets)
            side = [sets[x][1] for x in names]
            got = linked([sets[x][0] for x in names], share, None if -1 in side else side)
            return pd.DataFrame([(names[i], names[j]) for i, j in got], columns=["a", "b"]).astype("int64")

        for f in frames:
            for where, side, text in zip(f["bin"], f["side"], f["text"], strict=True):
                if where != now:
                    if len(sets) > 1:
                        yield flush()
                    now, sets = where, {}
                s = shingles(text, words)
                sets[_name(s)] = (s, int(side))
        if len(sets) > 1:
            yield flush()

    dealt = rows.repartition(parts, "bin").sortWithinPartitions("bin", "side")
    return dealt.select("bin", "side", "text").mapInPandas(run, "a long, b long")


def _name(s: np.ndarray) -> int:
    """One number for a set."""
    total = np.add.reduce(mix(s ^ GOLDEN), keepdims=True)  # as an array, which wraps without a warning
    return int(mix(total + np.array([len(s)], np.uint64) * GOLDEN).view(np.int64)[0])


def jaccard_components(docs: DataFrame, *, words: int = 4, share: int = 85, few: int = 16, block: int = 512, leaders: int = 32, broadcast_rows: int = 500_000) -> DataFrame:
    """Components of documents linked by 100 * intersection >= ``share`` * union of their sets of ``words``-word shingles.

    1. Each set emits signatures such that linked sets share enough of one kind (``Plan``); a task emits a set it has
       met once.
    2. Signatures that one set has alone are dropped, then sets with fewer left than linked sets share. A signature of
       up to ``few`` sets gives its pairs, one of more is a hub. Pairs that share enough, hubs aside, are candidates.
       Sets that could share enough by hubs alone are linked to the smallest of each hub, leaving out as many of their
       largest hubs as linked sets can spare. So candidates are at most in proportion to signatures; components of
       candidates are clusters that no true link leaves.
    3. The texts of clusters, one for each set, are compared exactly through inverted lists. A cluster beyond ``block``
       sets is dealt into blocks, each with the cluster's ``leaders``; if that doesn't connect it, all blocks are compared
       but those that are already one component. Only links that connect something are returned.

    Large sets are not looked up element by element: their inverted lists are those of parts, which linked sets share
    enough of, so that a list of a common word is never scanned. Lists of elements are scanned in the exact check.

    Returns doc_id, text_hash, n_shingles, component_id, class_id (of equal sets), first_hash (text_hash of the component's
    first document). Null and empty texts have no shingles and are components of their own; null doc_ids don't name a
    component unless all are null; rows that repeat are separate rows; an empty table gives no rows. Sets are known by
    64-bit fingerprints of shingles.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = Plan(share, slack=4 if share >= 85 else 3)

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [shingles(t, words) for t in f["text"]]
            name = pd.array([_name(s) if len(s) else None for s in got], "Int64")
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "text_hash": f["text_hash"], "n": [len(s) for s in got], "name": name})

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set = set()
        for f in frames:
            out = []
            for t in f["text"]:
                s = shingles(t, words)
                name = _name(s) if len(s) else None
                if len(s) and name not in met:
                    met.add(name)
                    out += [(name, c, need, keys.view(np.int64)) for c, need, keys in plan.signatures(s)]
            if out:
                yield pd.DataFrame(out, columns=["name", "cls", "need", "keys"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    # The text is read twice: signatures are too many to be kept beside their shuffle.
    every = cut(text.mapInPandas(sets, "doc_id long, text_hash long, n long, name long"))

    emitted = text.select("text").mapInPandas(emit, "name long, cls int, need int, keys array<long>").select("name", "cls", "need", F.explode("keys").alias("key"))
    same = Window.partitionBy("key")
    order = same.orderBy("name")
    last = F.lag("name").over(order)  # a set that several tasks have emitted counts once
    met = emitted.withColumn("last", last).where("last is null or last <> name")
    met = met.withColumn("c", F.count(F.lit(1)).over(same)).where("c > 1")
    own = Window.partitionBy("name", "cls")
    met = met.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("h", F.count(F.when(F.col("c") > few, 1)).over(own))
    met = met.withColumn("r", F.row_number().over(own.orderBy(F.col("c").desc(), "key")))  # the largest hubs first
    # Kept compressed on the executors' disks for the two uses below; what is lost with one is computed again.
    met = met.where("n >= need").select("name", "cls", "need", "key", "c", "h", "r").persist(StorageLevel.DISK_ONLY)
    small = met.where(F.col("c") <= few).withColumn("before", F.collect_list(F.struct("name", "need", "h")).over(order.rowsBetween(1 - few, -1)))
    pairs = small.select(F.col("name").alias("a"), "cls", "need", "h", F.explode("before").alias("x"))
    pairs = pairs.groupBy("a", F.col("x.name").alias("b"), "cls").agg(F.count(F.lit(1)).alias("k"), F.max(F.greatest("need", "x.need") - F.least("h", "x.h")).alias("t"))
    pairs = pairs.where("k >= t").select("a", "b")
    hubs = met.where((F.col("c") > few) & F.expr("h >= need and r >= need")).withColumn("b", F.first("name").over(order))
    hubs = hubs.where("name <> b").select(F.col("name").alias("a"), "b").distinct()
    clusters = cut(components(pairs.unionByName(hubs)).select(F.col("node").alias("name"), F.col("root").alias("cluster")))
    met.unpersist(blocking=True)
    del met, emitted, small, pairs, hubs
    release(spark)  # the signatures' shuffle is by far the largest

    # One document for each set of a cluster; a hash of the text tells rows of one doc_id apart.
    member = every.where("n > 0").select("name", "doc_id", "text_hash").join(clusters, "name")
    member = member.groupBy("cluster", "name").agg(F.min(F.struct("doc_id", "text_hash")).alias("d"))
    size = member.groupBy("cluster").count()
    member = cut(member.join(size, "cluster").select("cluster", "name", F.col("d.doc_id").alias("i"), F.col("d.text_hash").alias("h"), F.col("count").alias("size")))
    def texts(bins: DataFrame) -> DataFrame:
        """bins: i, h, bin, side -> with the text of each."""
        bins = cut(bins)
        on = text["doc_id"].eqNullSafe(bins["i"]) & (text["text_hash"] == bins["h"])
        got = text.join(F.broadcast(bins) if bins.count() <= broadcast_rows else bins, on)
        return got.select("bin", "side", "text")

    blocks = F.ceil(F.col("size") / block)
    mine = F.pmod(F.xxhash64("name"), blocks)
    lead = (F.pmod(F.xxhash64("name", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("size") / leaders))) == 0) & (blocks > 1)
    bins = member.withColumn("to", F.explode(F.when(lead, F.sequence(F.lit(0), blocks.cast("int") - 1)).otherwise(F.array(mine.cast("int")))))
    bins = bins.select("i", "h", F.xxhash64("cluster", "to").alias("bin"), F.lit(-1).alias("side"))
    true = cut(_check(texts(bins), words, share, parts))
    found = components(true)

    large = member.where(F.col("size") > block)
    if not large.isEmpty():
        part = found.withColumnRenamed("node", "name")
        state = large.join(part, "name", "left").withColumn("root", F.coalesce("root", "name"))
        each = state.groupBy("cluster", "root").count()
        main = each.groupBy("cluster").agg(F.max(F.struct("count", "root")).alias("m"), F.sum("count").alias("all"))
        main = main.select("cluster", F.col("m.root").alias("main"), F.col("m.count").alias("nm"), "all").where("nm < all")
        state = cut(state.join(main, "cluster"))
        if not state.isEmpty():
            nm, nr = F.ceil(F.col("nm") / block).cast("int"), F.ceil((F.col("all") - F.col("nm")) / block).cast("int")
            own = F.xxhash64("name", F.lit(2))
            is_main = F.col("root") == F.col("main")
            # Blocks of the main component meet those of the rest; blocks of the rest meet each other.
            b = F.when(is_main, F.pmod(own, nm)).otherwise(F.pmod(own, nr)).cast("int")
            with_rest = F.transform(F.sequence(F.lit(0), nr - 1), lambda j: F.struct(F.lit(0).alias("k"), b.alias("x"), j.alias("y"), F.lit(0).alias("side")))
            with_main = F.transform(F.sequence(F.lit(0), nm - 1), lambda j: F.struct(F.lit(0).alias("k"), j.alias("x"), b.alias("y"), F.lit(1).alias("side")))
            with_others = F.transform(F.sequence(F.lit(0), nr - 1), lambda j: F.struct(F.lit(1).alias("k"), F.least(b, j).alias("x"), F.greatest(b, j).alias("y"), F.when(b == j, -1).otherwise((b > j).cast("int")).alias("side")))
            pairs = state.withColumn("to", F.explode(F.when(is_main, with_rest).otherwise(F.concat(with_main, with_others))))
            pairs = pairs.select("i", "h", F.xxhash64("cluster", "to.k", "to.x", "to.y").alias("bin"), F.col("to.side").alias("side"))
            more = cut(_check(texts(pairs), words, share, parts))
            found = components(true.unionByName(more))

    roots = found.select(F.col("node").alias("_node"), "root")
    copies = every.where("name is not null").groupBy(F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("c"))
    roots = cut(copies.join(roots, F.col("_name") == F.col("_node"), "left").select("_name", F.coalesce("root", "_name").alias("root"), "c"))
    rows = every.select("doc_id", "text_hash", "n", "name")
    total = rows.count()
    with_set = cut(attach(rows, roots, {"name": "_name"}, "c", total))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash"))
    first = cut(with_set.groupBy(F.col("root").alias("_r")).agg(least.alias("f"), F.count(F.lit(1)).alias("c")))
    out = attach(with_set, first.select("_r", F.col("f.doc_id").alias("component_id"), F.col("f.text_hash").alias("first_hash"), "c"), {"root": "_r"}, "c", total)
    alone = rows.where("name is null").select("doc_id", "text_hash", "n", "name", F.col("doc_id").alias("component_id"), F.col("text_hash").alias("first_hash"))
    out = out.select("doc_id", "text_hash", "n", "name", F.coalesce("component_id", "doc_id").alias("component_id"), "first_hash").unionByName(alone)
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.col("name").alias("class_id"), "first_hash")


def drop_near(docs: DataFrame, *, words: int = 5, share: int = 80, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` with one document of each component; all columns as they are.

    The one with the smallest doc_id stays, null last, of those the one with the smallest hash of its text; of rows that
    repeat, one. Documents without a word stay, each. An empty table gives no rows.
    """
    found = cut(jaccard_components(docs, words=words, share=share).where("class_id is not null"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    gone = cut(found.where(~stays).select(F.col("doc_id").alias("__lekhani_i"), F.col("text_hash").alias("__lekhani_h")).distinct())
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    x = docs.withColumn("__lekhani_x", F.xxhash64("text")).withColumn("__lekhani_d", F.col("doc_id").cast("long"))
    x = x.join(gone, F.col("__lekhani_d").eqNullSafe(F.col("__lekhani_i")) & (F.col("__lekhani_x") == F.col("__lekhani_h")), "left_anti")
    twice = found.where(stays).groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("__lekhani_i"), F.col("text_hash").alias("__lekhani_h"))
    if not twice.isEmpty():  # rows that repeat, with no earlier copy: one of each stays
        again = F.col("__lekhani_d").eqNullSafe(F.col("__lekhani_i")) & (F.col("__lekhani_x") == F.col("__lekhani_h"))
        single = x.join(twice, again, "left_anti")
        x = single.unionByName(x.join(twice, again, "left_semi").dropDuplicates(["__lekhani_d", "__lekhani_x"]))
    return x.drop("__lekhani_x", "__lekhani_d")

"""Exact Jaccard self-join of word n-gram sets by universe partition and pigeonhole.

Sets are put in bands by size, each band's sizes differing by at most the threshold, so similar sets are
in one band or in two adjacent ones. In a band, sets that are similar differ in at most H tokens. The
universe of token hashes is cut into m segments. With H + 1 + e exact segments at least e + 1 are equal;
with deletion neighbourhoods (a segment matches also where one token is missing) half as many segments do.
Which of the two a band uses is decided by estimated cost from its number of sets.

A segment's signature is a bucket of sets. Where a set has at most e crowded buckets in a band, it leaves
them: a similar pair has e + 1 equal segments, crowding is a property of the segment's content, so one
equal segment remains that neither leaves. What is left are pairs from small buckets, which are verified
one by one, and groups of sets that crowded buckets connect. A group's sets are dealt out to blocks, linked
within each by a prefix filter, then one of each class of each block is linked with others, which makes one
class of a group of near copies however large. Only sets outside of a group's greatest class are compared with
all other blocks, so a set is copied as often as those fill blocks. Sets that are connected already are never
compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm import textkit
from gaugewright.llm.graph import components
from gaugewright.llm.shared import removed, written, written_at

#: Buckets of up to this many sets become pairs.
SMALL_BUCKET = 4
#: Shingles of a block of crowded sets.
BLOCK_SHINGLES = 1 << 18
#: Most ids that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1 << 20
#: Signatures of a partition of the bucket stage.
PARTITION_SIGNATURES = 2_000_000
_SEEN = 1 << 18


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its n-word shingles) for each row of a batch."""
    for lo, hi, data, offsets in textkit.chunks(batch.column("text")):
        found = textkit.words(data, offsets, textkit.NONSPACE)
        gram, first = textkit.grams(found.hash, n), found.first.tolist()
        for r in range(hi - lo):
            a, b = first[r], first[r + 1]
            if b - a >= n:
                x = np.sort(gram[a : b - n + 1])
                keep = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                yield lo + r, x[keep]
            else:
                yield lo + r, textkit.grams(found.hash[a:b], b - a) if b > a else x_none


x_none = np.zeros(0, np.uint64)


def _key(x: np.ndarray) -> int:
    """The identity of a set of token hashes, the same for equal sets."""
    return int(textkit.mix(textkit.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(x))).view(np.int64)[0])


def band_edges(percent: int, largest: int) -> list[int]:
    """Lower bounds of the bands of set sizes up to ``largest``, and one more."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * 100 // percent + 1)
    return [*edges, edges[-1] * 100 // percent + 1]


def allocation(edges: list[int], counts: dict[int, int], percent: int) -> list[tuple[int, int, int]]:
    """For each band (segments, how many of them with deletions, spare segments e); no segments: only equal sets are similar."""
    out = []
    for band, upper in enumerate(edges[1:]):
        most = (100 - percent) * (upper - 1) // percent
        if not most:
            out.append((0, 0, 0))
            continue
        near, size = sum(counts.get(band + i, 0) for i in (0, 1)), (edges[band] + upper) / 2
        spare = 4 + most // 8
        exact, deleting = most + 1 + spare, (most + 2) // 2
        # sets times signatures, and twenty times the pairs that share an empty segment by chance and may not leave it
        empty, term, few = exact * math.exp(-size / exact), 1.0, 0.0
        for k in range(spare + 1):
            few += term
            term *= empty / (k + 1)
        cost_exact = near * exact + 20 * (near * max(0.0, 1 - few * math.exp(-empty))) ** 2 * empty
        cost_deleting = near * (size + deleting) + 20 * near**2 * deleting * (1 + size / deleting) ** 2 * math.exp(-2 * size / deleting)
        out.append((exact, 0, spare) if cost_exact <= cost_deleting else (deleting, deleting - (2 * deleting - most - 1), 0))
    return out


def _signatures(x: np.ndarray, mixed: np.ndarray, total: np.ndarray, band: int, segments: int, deleting: int, cuts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Signatures of a set (sorted hashes, those mixed, their running total) in a band; the lowest byte is the band."""
    at = np.concatenate([[0], np.searchsorted(x, cuts), [len(x)]])
    sums = total[at[1:]] - total[at[:-1]] + seeds
    out = [sums]
    if deleting:
        owner = np.repeat(np.arange(segments), np.diff(at))
        some = owner < deleting
        out.append(sums[owner[some]] - mixed[some])
    return (textkit.mix(np.concatenate(out)) & np.uint64(~0xFF & (2**64 - 1))) | np.uint64(band)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (crowd 0) of small buckets and (signature, set) of larger ones (crowd 1), from all (signature, set) of a partition."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not parts:
        return
    sig, key = np.concatenate(parts, axis=1)
    del parts
    order = np.argsort(sig, kind="stable")
    sig, key = sig[order], key[order]
    twin = np.zeros(len(sig), bool)
    twin[1:] |= sig[1:] == sig[:-1]
    twin[:-1] |= twin[1:]
    sig, key = sig[twin], key[twin]
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[new], key[new]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(sig)))
    crowd, a, b = [], [], []
    for i in range(SMALL_BUCKET):
        for j in range(i + 1, SMALL_BUCKET):
            s = start[(size > j) & (size <= SMALL_BUCKET)]
            a.append(key[s + i])
            b.append(key[s + j])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    big = np.repeat(size > SMALL_BUCKET, size)
    a, b = np.concatenate([pairs[0], sig[big]]), np.concatenate([pairs[1], key[big]])
    crowd = np.concatenate([np.zeros(pairs.shape[1], np.int8), np.ones(int(big.sum()), np.int8)])
    for lo in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + 100_000]) for v in (crowd, a, b)], ["crowd", "a", "b"])


def link_block(keys: np.ndarray, first: np.ndarray, tokens: np.ndarray, percent: int, left: np.ndarray | None = None, classes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Similar pairs that connect what the block's similar pairs connect; with ``left``, pairs of a left and a right set alone; ``classes`` are connected already.

    Set i is tokens[first[i]:first[i+1]]. Sets come by size; one looks up those before it by its rarest
    tokens, leaves those that are connected to it, and verifies the rest, the likeliest first.
    """
    size = np.diff(first)
    n = len(keys)
    _, token, count = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner = np.repeat(np.arange(n), size)
    token = rank[token]
    order = np.lexsort((token, owner))
    token = token[order]
    frequency = np.sort(count)
    label = np.arange(n) if classes is None else np.unique(classes, return_inverse=True)[1]
    mark = np.zeros(len(count), bool)
    postings: dict[int, list[int]] = {}
    edges = []
    prefix = size - (percent * size + 99) // 100 + 1
    for x in np.argsort(size, kind="stable").tolist():
        own = token[first[x] : first[x + 1]]
        head = own[: prefix[x]]
        head = head[frequency[head] > 1].tolist()
        found = [y for t in head for y in postings.get(t, ())]
        for t in head:
            postings.setdefault(t, []).append(x)
        if not found:
            continue
        seen, times = np.unique(np.array(found), return_counts=True)
        fits = (100 * size[seen] >= percent * size[x]) & (label[seen] != label[x])
        if left is not None:
            fits &= left[seen] != left[x]
        seen = seen[fits][np.argsort(-times[fits], kind="stable")]
        mark[own] = True
        step = 8
        while len(seen):
            some, seen = seen[:step], seen[step:]
            length = size[some]
            begin = np.cumsum(length) - length
            at = np.arange(int(length.sum())) - np.repeat(begin - first[some], length)
            shared = np.add.reduceat(mark[token[at]].astype(np.int64), begin)
            linked = some[100 * shared >= percent * (length + size[x] - shared)]
            for y in linked.tolist():
                if label[y] != label[x]:
                    edges.append((int(keys[x]), int(keys[y])))
                    label[label == label[y]] = label[x]
            seen = seen[label[seen] != label[x]]
            step = min(2 * step, 512)
        mark[own] = False
    return edges


def _linker(percent: int):
    """A function from the sets of a task (key, tokens, i, j, block, class) to the links among them, or, where i and j differ, between blocks i and j."""

    def link(table: pa.Table) -> pa.Table:
        tokens = table["tokens"].combine_chunks()
        first = tokens.offsets.to_numpy().astype(np.int64)
        flat = tokens.values.to_numpy()[first[0] : first[-1]] if len(tokens) else np.zeros(0, np.int64)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        found = link_block(table["key"].to_numpy(), first - first[0], flat, percent, None if i == j else table["block"].to_numpy() == i, table["class"].to_numpy())
        textkit.released()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return link


def _dealt(members: DataFrame) -> DataFrame:
    """members (root, key, n) with the blocks of their root, each of about BLOCK_SHINGLES, and the block of each."""
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(float(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    return members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))


def _named(members: DataFrame, links: list[DataFrame]) -> DataFrame:
    """members with the class that links make of each."""
    made = components(reduce(DataFrame.unionByName, links)).select(F.col("node").alias("key"), F.col("root").alias("linked"))
    return members.drop("class").join(made, "key", "left").withColumn("class", F.coalesce("linked", "key")).drop("linked")


def _group_links(members: DataFrame, sets: DataFrame, percent: int, keep: Callable[[DataFrame, str], DataFrame]) -> list[DataFrame]:
    """Tables of links (a, b) that connect what the similar pairs within groups do; members: (root, key, n), sets: (key, tokens)."""
    link = _linker(percent)

    def within(dealt: DataFrame, name: str) -> DataFrame:
        one = dealt.select("key", "root", F.col("block").alias("i"), F.col("block").alias("j"), "block", "class")
        return keep(sets.join(one, "key").groupBy("root", "i", "j").applyInArrow(link, "a long, b long"), name)

    dealt = keep(_dealt(members.withColumn("class", F.col("key"))), "dealt")
    links = [within(dealt, "inside")]
    several = dealt.where("blocks > 1").select("root", "key", "n", "block", "class")
    if not several.limit(1).count():
        return links
    # one of each class of each block, linked among themselves
    named = keep(_named(several, links), "classes")
    chosen = named.groupBy("root", "block", "class").agg(F.min(F.struct("key", "n")).alias("s")).select("root", "s.key", "s.n", "class")
    links.append(within(_dealt(chosen), "between"))
    # what is outside of the greatest class meets all other blocks
    named = keep(_named(several, links), "classes")
    sizes = named.groupBy("root", "class").agg(F.sum("n").alias("n"))
    greatest = sizes.groupBy("root").agg(F.max(F.struct("n", "class")).alias("s")).select("root", F.col("s.class").alias("greatest"))
    sides = named.select("root", "key", "n", "class").join(greatest, "root")
    rest = keep(_dealt(sides.where("class <> greatest").drop("greatest")), "rest")
    if not rest.limit(1).count():
        return links
    others = rest.select("root", F.col("blocks").alias("others")).distinct()
    main = _dealt(sides.where("class = greatest").drop("greatest")).join(others, "root")
    mains = main.select("root", F.col("blocks").alias("mains")).distinct()
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # blocks of the rest are 0 and on, those of the greatest class -1 and below, so a task's i is the lesser
    among = rest.withColumn("other", F.explode(upto("blocks"))).select("root", "key", "class", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    across = rest.join(mains, "root").withColumn("i", F.explode(F.transform(upto("mains"), lambda q: -1 - q))).select("root", "key", "class", "block", "i", F.col("block").alias("j"))
    against = main.withColumn("j", F.explode(upto("others"))).withColumn("block", -1 - F.col("block")).select("root", "key", "class", "block", F.col("block").alias("i"), "j")
    tasks = sets.join(among.unionByName(across).unionByName(against), "key")
    return [*links, keep(tasks.groupBy("root", "i", "j").applyInArrow(link, "a long, b long"), "across")]


def jaccard_components(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; two documents link when 100 * intersection >= percent * union.

    A document's set holds its distinct n-word shingles (words between white space, A-Z in lower case), or,
    with fewer words, its whole sequence of words. A null, empty or blank text has no set, links with nothing
    and is its own component. component_id is the smallest doc_id of the documents that links connect; rows
    without doc_id take part, and alone have none. Repeated rows are documents of their own. Other columns
    are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    temporary: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        table, path = written_at(df, name)
        temporary.append(path)
        return table

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, x in _sets(batch, n):
                size[row], key[row] = len(x), _key(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(key, mask=size == 0)], ["doc_id", "n_shingles", "key"])

    narrow = written(docs.mapInArrow(textkit.tidy(sized), T.StructType([T.StructField("doc_id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("key", T.LongType())])), "sizes")
    largest = narrow.agg(F.max("n_shingles")).first()[0] or 0
    edges = band_edges(percent, largest)
    bounds = np.array(edges)
    band = F.lit(0)
    for lower in edges[1:-1]:
        band = band + (F.col("n_shingles") >= lower).cast("int")
    counts = {r[0]: r[1] for r in narrow.where("key is not null").groupBy(band.alias("band")).count().collect()}
    plan = allocation(edges, counts, percent)
    signatures = sum(c * sum(plan[b - i][0] + (plan[b - i][1] and edges[b]) for i in (0, 1) if b >= i) for b, c in counts.items())
    cuts = [np.array([(i << 64) // m for i in range(1, m)], np.uint64) for m, _, _ in plan]
    seeds = [textkit.mix(np.arange(m, dtype=np.uint64) + np.uint64(1 << 32)) for m, _, _ in plan]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, found = [], []
            for _, x in _sets(batch, n):
                if not len(x) or (key := _key(x)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(key)
                mixed = textkit.mix(x ^ np.uint64(0xA0761D6478BD642F))
                total = np.concatenate([x_none, np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
                own = int(np.searchsorted(bounds, len(x), side="right")) - 1
                out = [_signatures(x, mixed, total, b, *plan[b][:2], cuts[b], seeds[b]) for b in (own, own - 1) if b >= 0 and plan[b][0] and (b == own or percent * len(x) <= 100 * (edges[own] - 1))]
                if out:
                    keys.append(key)
                    found.append(np.concatenate(out))
                if len(keys) >= 1000:
                    yield listed(keys, found)
                    keys, found = [], []
            if keys:
                yield listed(keys, found)

    def listed(keys: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        length = np.array([len(x) for x in found])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), length))], ["sig", "key"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-signatures // PARTITION_SIGNATURES))
    buckets = keep(docs.mapInArrow(textkit.tidy(signed), "sig long, key long").repartition(parts, "sig").mapInArrow(textkit.tidy(_buckets), "crowd byte, a long, b long"), "buckets")
    pairs = buckets.where("crowd = 0").select("a", "b").distinct()
    crowded = buckets.where("crowd = 1").select(F.col("a").alias("sig"), F.col("b").alias("key")).withColumn("band", F.col("sig").bitwiseAND(F.lit(0xFF)))
    spare = F.element_at(F.array(*[F.lit(e) for _, _, e in plan]), (F.col("band") + 1).cast("int"))
    stays = crowded.groupBy("key", "band").agg(F.count("*").alias("times")).where(F.col("times") > spare).select("key", "band")
    crowded = crowded.join(stays, ["key", "band"], "left_semi")
    group = keep(components(crowded.select(F.col("sig").alias("a"), F.col("key").alias("b"))).join(crowded.select(F.col("key").alias("node")).distinct(), "node", "left_semi"), "groups")
    pairs = keep(pairs, "pairs")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(group.select(F.col("node").alias("key"))).distinct()
    ids = keep(narrow.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null"), "ids")
    some = ids.select("doc_id").distinct()
    some = F.broadcast(some) if ids.count() <= BROADCAST_IDS else some

    def listed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, x in _sets(batch, n)]
            first = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = pa.array(np.concatenate([x_none, *found]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in found], pa.int64()), pa.ListArray.from_arrays(pa.array(first), values)], ["key", "tokens"])

    # a repeated doc_id may bring other texts; the set of a key is the same whichever row it comes from
    unnamed = narrow.where("doc_id is null").limit(1).count() > 0
    chosen = docs if unnamed else docs.join(some, "doc_id", "left_semi")
    sets = keep(chosen.mapInArrow(textkit.tidy(listed_sets), "key long, tokens array<long>").join(wanted, "key", "left_semi").dropDuplicates(["key"]), "sets")
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
    shared = left.where(100 * F.least(F.size("x"), F.size("y")) >= percent * F.greatest(F.size("x"), F.size("y"))).select("a", "b", (F.size("x") + F.size("y")).alias("both"), F.size(F.array_intersect("x", "y")).alias("shared"))
    verified = shared.where(100 * F.col("shared") >= percent * (F.col("both") - F.col("shared"))).select("a", "b")

    sizes = narrow.where("key is not null").groupBy("key").agg(F.first("n_shingles").alias("n"))
    members = group.select(F.col("node").alias("key"), "root").join(sizes, "key").select("root", "key", "n")
    found = [keep(verified, "verified"), *_group_links(members, sets, percent, keep)]
    # from written links, so no task runs two Python workers
    classes = components(reduce(DataFrame.unionByName, found))
    for path in temporary:  # what is still read are sizes and classes
        removed(spark, path)
    named = narrow.join(classes, F.col("key") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "key").alias("root"))
    lowest = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(lowest, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

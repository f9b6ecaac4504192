"""MinHash near-duplicates (operator 8): SuperMinHash, banding, verification, union-find.

Texts are lower-cased (A to Z) and cut into words at ASCII white space; a
document's set is that of its distinct runs of ``words`` words, as 64-bit
hashes.  Documents with equal sets become one *representative*; copies go no
further.  Each representative has a SuperMinHash signature: an element's ranks
are a permutation (a Fisher-Yates shuffle that the element's hash seeds), which
correlates the components negatively and lowers the variance, and an element is
given up as soon as no component can still improve.  ``BANDS`` bands of ``ROWS``
components miss a pair with similarity 0.8 about once in ten million times.

Buckets with one first member, their *hub*, are one group, so a pair that shares
many buckets meets once:

1. each member is compared with the hub (a star);
2. where a group still has members of several components, only those outside its
   largest component, the *others*, meet the rest;
3. groups that fit in a task (``GROUP_ROWS`` members, ``GROUP_ELEMENTS``
   elements) are compared inside it, larger ones block by block, the others' blocks
   with all blocks; only a spanning forest of the links leaves a task.  Inside, two
   sets' common elements are counted by what sets them apart: the elements that
   most of the members have count for those that lack them;
4. where blocks would send a set ``COPIES`` times on average, a fresh hub comes
   first, ``STARS`` times, then an exact prefix filter that splits the group: a
   member's set is ordered by "not in the hub's set" first, and of a set of n
   elements the first n - ceil(0.8 n) + 1 name the smaller groups that it goes to.
   Two sets with a link share one of these.  Members that only share a frequent
   passage with the hub have nothing but their own elements there, and part.  What
   is still large after ``SPLITS`` splits is compared block by block.

Every link is a comparison of full sets; nothing is decided by signatures.  So two
documents end in one component if and only if links connect them, up to the
stated chance that a linked pair shares no bucket.  Components come from
min-label propagation with pointer jumping over checkpointed tables; nothing
about all documents is held by the driver.

Defined cases: a null text counts as empty; a text without words has no set,
is linked with nothing and is its own component; with fewer than ``words`` words
the whole sequence is one shingle; repeated rows are copies; a null identifier
counts as larger than all others; an empty table gives no rows; extra columns of
any name are carried by :func:`drop_duplicates` and play no part but in ties (see
there).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, find_package, map_arrow, row_hash, size_chunks, temporary, whole

BANDS, ROWS = 40, 5
SIZE = BANDS * ROWS
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Members, and elements of their sets, of a group that one task compares.
GROUP_ROWS, GROUP_ELEMENTS = 2048, 1 << 20
#: Rows that are read at once on the way to a group.
SLICE = 256
#: Times that a group's sets are sent on average, from which it gets further stars, and splits if it remains.
COPIES = 16
STARS, SPLITS = 2, 3
#: Elements whose whole permutations are held at once.
FEW = 1 << 13
#: Pairs that are counted at once in a task, and marks that are read for them (or those of one row).
PAIRS, MARKS = 1 << 18, 1 << 20
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P2
    x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of each text, one after the other, and where each begins (and the end)."""
    column = pc.ascii_lower(whole(column))
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(column))
    coded = lists.flatten().dictionary_encode()
    entries = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)], dtype=np.uint64)
    h = entries[coded.indices.to_numpy()] if len(entries) else np.zeros(0, dtype=np.uint64)
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    n = np.diff(starts)
    blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(column)), 0).to_numpy(zero_copy_only=False).astype(bool)
    size = np.where(blank, 0, np.minimum(n, words))  # words of each shingle
    held = np.where(blank, 0, np.maximum(n - words + 1, 1))
    which = np.repeat(np.arange(len(n)), held)
    first = np.concatenate([[0], np.cumsum(held)])
    at = np.repeat(starts[:-1] - first[:-1], held) + np.arange(first[-1])
    length = size[which]
    value = mix(length.astype(np.uint64) + _P1)
    for i in range(words):
        more = length > i
        value[more] = mix(value[more] * _P1 + h[at[more] + i])
    for a, b in zip(first[:-1], first[1:], strict=True):
        value[a:b].sort()
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (which[1:] != which[:-1])
    value, which = value[new], which[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(n)))])


def superminhash(elements: np.ndarray, starts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """(sets, size) signatures of the sets ``elements[starts[i]:starts[i + 1]]``; empty sets have all ones."""
    sets = len(starts) - 1
    signature = np.full(sets * size, ~np.uint64(0), dtype=np.uint64)
    which = np.repeat(np.arange(sets), np.diff(starts))
    seeds, swaps = elements, []
    shuffled, own = None, None  # the permutations of the elements that are left, once these are few, and which each has
    for j in range(size):
        r = mix(seeds + np.uint64((j + 1) * int(_P1) & (1 << 64) - 1))
        k = (np.uint64(j) + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(size - j)) >> np.uint64(32))).astype(np.int16)
        if shuffled is None and len(seeds) <= FEW:
            shuffled, own = np.tile(np.arange(size, dtype=np.int16), (len(seeds), 1)), np.arange(len(seeds))
            for i, other in enumerate(swaps):
                shuffled[own, i], shuffled[own, other] = shuffled[own, other], shuffled[own, i]
        if shuffled is None:
            place = k.copy()
            for i in range(j - 1, -1, -1):  # the exchanges made so far, backwards
                other = swaps[i]
                place = np.where(place == other, np.int16(i), np.where(place == i, other, place))
        else:
            place = shuffled[own, k]
            shuffled[own, k] = shuffled[own, j]
        np.minimum.at(signature, which * size + place, (np.uint64(j) << np.uint64(32)) | (r >> np.uint64(32)))
        # A set is done when later ranks, which are larger, can change nothing.
        open_ = signature.reshape(sets, size).max(1) >= (np.uint64(j + 1) << np.uint64(32))
        going = open_[which]
        if not going.any():
            break
        if shuffled is None:
            swaps = [s[going] for s in [*swaps, k]]
        else:
            own = own[going]
        seeds, which = seeds[going], which[going]
    return signature.reshape(sets, size)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, BANDS): a hash of each band's components and of its number."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1).astype(np.uint64) * _P1), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * _P1 + parts[:, :, i])
    return key.view(np.int64)


def _described(column: pa.Array, words: int) -> list[pa.Array]:
    value, starts = shingle_sets(column, words)
    n = np.diff(starts)
    # Two sums of mixed elements name a set, in whatever order.
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    names = [(s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums]
    keys = band_keys(superminhash(value, starts))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
    return [pa.array(n, pa.int64()), *map(pa.array, names), lists]


def describe(named: DataFrame, words: int) -> DataFrame:
    """doc_id, hash, n (set size), s1, s2 (the set's name) and bands of doc_id, text, hash."""

    def run(batches):
        for part in size_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *_described(part.column(1), words)], ["doc_id", "hash", "n", "s1", "s2", "bands"])

    return map_arrow(named.select("doc_id", "text", "hash"), run, "doc_id long, hash long, n long, s1 long, s2 long, bands array<long>")


#: Rows of one part of a small intermediate table; few large files take less room than many small ones.
PART_ROWS = 200_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """Materialise a table of known size in as many parts as it needs."""
    return cut(df.coalesce(max(1, -(-rows // PART_ROWS))))


def components(edges: DataFrame, rows: int) -> DataFrame:
    """uid, root: the smallest vertex that edges (u, v), of that number, connect a vertex with."""
    both = compact(edges.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.*"), 2 * rows)
    labels = compact(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "uid"), 2 * rows)
    while True:
        near = both.join(labels.withColumnRenamed("uid", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "uid"), "uid").select("uid", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("uid").alias("root"), F.col("root").alias("beyond"))
        labels = compact(lower.join(jump, "root").select("uid", "old", F.least("root", "beyond").alias("root")), 2 * rows)
        moved = labels.where("root <> old").limit(1).count()
        labels = labels.drop("old")
        if not moved:
            return labels


def merge(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The roots after more links (u, v): only the old components' roots are connected anew."""
    if roots is None:
        rows = links.count()
        return components(links, rows) if rows else None
    root_of = lambda c: roots.select(F.col("uid").alias(c), F.col("root").alias(f"root_{c}"))
    lifted = links.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    lifted = cut(lifted.where("u <> v").distinct())
    rows = lifted.count()
    if not rows:
        return roots
    joined = components(lifted, rows)
    moved = roots.join(joined.select(F.col("uid").alias("root"), F.col("root").alias("next")), "root", "left").select("uid", F.coalesce("next", "root").alias("root"))
    # Vertices without a link before are their own roots there.
    fresh = joined.join(roots.select("uid"), "uid", "left_anti")
    return cut(moved.unionByName(fresh))


def with_sets(texts: DataFrame, words: int) -> DataFrame:
    """uid, tokens array<long>: the set of each text (uid, text)."""

    def run(batches):
        for part in size_chunks(batches, "text"):
            value, starts = shingle_sets(part.column(1), words)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["uid", "tokens"])

    return map_arrow(texts.select("uid", "text"), run, "uid long, tokens array<long>")


def fits(a, b):
    """Whether sets of these sizes can be linked."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v, ...) with both full sets, tu and tv, and their common elements' number."""
    of = lambda c: sets.select(F.col("uid").alias(c), F.col("tokens").alias(f"t{c}"))
    return pairs.join(of("v"), "v").join(of("u"), "u").withColumn("common", F.size(F.array_intersect("tv", "tu")).cast("long"))


def linked():
    return 100 * F.col("common") >= PERCENT * (F.size("tu") + F.size("tv") - F.col("common"))


def star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are linked."""
    return cut(beside(pairs.select("u", "v").distinct(), sets).where(linked()).select("u", "v"))


def mixed(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """The groups (key, uid, n) with members of several components, with ``root``, ``main`` (the root of
    most members), ``size`` and ``weight`` (members and elements), ``rest`` and ``rest_weight`` (those
    outside ``main``); of groups with the same members, one."""
    rooted = groups.join(roots, "uid", "left").select("key", "uid", "n", F.coalesce("root", "uid").alias("root"))
    parts = rooted.groupBy("key", "root").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("n").alias("weight"),
        F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(2), "uid")).alias("y"),
    )
    stat = parts.groupBy("key").agg(
        F.max(F.struct("size", "root", "weight")).alias("most"),
        F.count(F.lit(1)).alias("parts"),
        *(F.sum(c).alias(c) for c in ("size", "weight")),
        *(F.bit_xor(c).alias(c) for c in ("x", "y")),
    )
    once = stat.where("parts > 1").groupBy("size", "weight", "x", "y").agg(F.min(F.struct("key", "most")).alias("one"))
    rest = [(F.col(c) - F.col(f"one.most.{c}")).alias(name) for c, name in (("size", "rest"), ("weight", "rest_weight"))]
    kept = once.select("one.key", F.col("one.most.root").alias("main"), "size", "weight", *rest)
    return cut(rooted.join(kept, "key"))


def blocks(size, weight):
    """How many blocks so many members and elements are dealt into."""
    return F.ceil(F.greatest(size / GROUP_ROWS, weight / GROUP_ELEMENTS)).cast("int")


def block_counts():
    """The blocks of a group's members, of those outside its main component, and of those inside."""
    size, weight, rest, rest_weight = map(F.col, ("size", "weight", "rest", "rest_weight"))
    return blocks(size, weight), blocks(rest, rest_weight), blocks(size - rest, weight - rest_weight)


def large():
    all_, rest, main = block_counts()
    sent = F.col("rest") * (rest + main) + (F.col("size") - F.col("rest")) * rest
    return (all_ > 1) & (sent > COPIES * F.col("size"))


def with_hub(groups: DataFrame, turn: int, apart: bool) -> DataFrame:
    """The members (key, uid, n, root) of each group beside its hub ``u``, the one with the smallest hash; ``apart``: those that may be linked with it and aren't connected yet."""
    order = F.xxhash64(F.lit(turn), "uid")
    hub = groups.groupBy("key").agg(F.min_by("uid", order).alias("u"), F.min_by("n", order).alias("u_n"), F.min_by("root", order).alias("u_root"))
    return groups.join(hub, "key").where(((F.col("root") != F.col("u_root")) & fits(F.col("n"), F.col("u_n"))) if apart else F.col("uid") != F.col("u"))


def split(groups: DataFrame, sets: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) with the groups' hubs, and the groups (key, uid, n) that hold all other links inside them.

    Two linked sets share one of the first n - ceil(0.8 n) + 1 elements of each in
    any common order; here the hub's elements are the last ones.
    """
    pairs = with_hub(groups, turn, False).select("u", F.col("uid").alias("v")).distinct()
    ordered = F.concat(F.array_except("tv", "tu"), F.array_intersect("tv", "tu"))
    n = F.size("tv")
    prefix = F.slice(ordered, 1, (n - F.ceil(n * F.lit(PERCENT) / 100) + 1).cast("int"))
    seen = cut(beside(pairs, sets).select("u", "v", linked().alias("linked"), n.cast("long").alias("n"), prefix.alias("prefix")))
    smaller = seen.select(F.col("u"), F.col("v").alias("uid"), "n", F.explode("prefix").alias("token"))
    return seen.where("linked").select("u", "v"), smaller.select(F.xxhash64(F.lit(turn), "u", "token").alias("key"), "uid", "n").distinct()


def _links(uid: np.ndarray, root: np.ndarray, block: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between different components in one group, or between its two blocks."""
    n = np.diff(starts)
    _, tops, members = np.unique(root, return_inverse=True, return_counts=True)
    if block[0] == block[-1] and block.min() == block.max():
        rows, columns = np.flatnonzero(tops != members.argmax()), np.arange(len(n))
    else:
        rows, columns = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    if not len(rows):
        return

    # An element that most members have marks those that lack it, another one those that have it.
    # Of K such elements, sets that lack a and b of them, c of these the same, share K - a - b + c.
    member = np.repeat(np.arange(len(n)), n)
    _, element, held = np.unique(tokens[starts[0] : starts[-1]], return_inverse=True, return_counts=True)
    usual = np.flatnonzero(2 * held > len(n))
    place = np.full(len(held), -1)
    place[usual] = np.arange(len(usual))
    there = np.zeros((len(n), len(usual)), dtype=bool)
    at = place[element]
    there[member[at >= 0], at[at >= 0]] = True
    lacks, lacked = np.nonzero(~there)
    missing = len(usual) - there.sum(1)
    rare = (at < 0) & (held[element] > 1)
    member, mark = np.concatenate([lacks, member[rare]]), np.concatenate([lacked, len(usual) + element[rare]])

    # Each row's marks, and each mark's columns.
    order = np.argsort(member, kind="stable")
    marks, ends = mark[order], np.searchsorted(member[order], np.arange(len(n) + 1))
    column = np.full(len(n), -1)
    column[columns] = np.arange(len(columns))
    listed, mark = column[member], mark[column[member] >= 0]
    listed = listed[listed >= 0][np.argsort(mark, kind="stable")]
    lists = np.concatenate([[0], np.cumsum(np.bincount(mark, minlength=len(usual) + len(held)))])
    length = np.diff(lists)

    def spread(sizes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """begins[i], begins[i] + 1, ..., ``sizes[i]`` of them, for each i."""
        return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    reads = np.concatenate([[0], np.cumsum(length[marks])])
    reads = np.cumsum(reads[ends[rows + 1]] - reads[ends[rows]])
    most, start = max(1, PAIRS // len(columns)), 0
    while start < len(rows):
        before = reads[start - 1] if start else 0
        stop = max(start + 1, min(start + most, int(np.searchsorted(reads, before + MARKS, side="right"))))
        part = rows[start:stop]
        own = ends[part + 1] - ends[part]
        theirs = marks[spread(own, ends[part])]
        pair = np.repeat(np.repeat(np.arange(len(part)) * len(columns), own), length[theirs]) + listed[spread(length[theirs], lists[theirs])]
        common = np.bincount(pair, minlength=len(part) * len(columns)).reshape(len(part), len(columns))
        common += len(usual) - missing[part][:, None] - missing[columns]
        links = (100 + PERCENT) * common >= PERCENT * (n[part][:, None] + n[columns])
        links &= tops[part][:, None] != tops[columns]
        for r in np.flatnonzero(links.any(1)):
            i, js = part[r], columns[links[r]]
            while len(js := js[tops[js] != tops[i]]):
                tops[tops == tops[js[0]]] = tops[i]
                yield uid[i], uid[js[0]]
        start = stop


def dealt(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of each group with their sets, for the tasks that compare them: of a group that is too
    large for one, each block of the members outside its main component meets each block of all."""
    all_, rest, main = block_counts()
    fits_, apart, h = all_ <= 1, F.col("root") != F.col("main"), F.xxhash64(F.lit(3), "uid")
    block = F.when(fits_, F.lit(0)).when(apart, F.pmod(h, rest)).otherwise(rest + F.pmod(h, main))
    other = F.when(fits_, F.sequence(F.lit(0), F.lit(0))).when(apart, F.sequence(F.lit(0), rest + main - 1)).otherwise(F.sequence(F.lit(0), rest - 1))
    return (
        groups.withColumn("block", block.cast("int"))
        .withColumn("other", F.explode(other))
        .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "uid", "root")
        .join(sets, "uid")
        .select("key", "low", "high", "block", "uid", "root", "tokens")
    )


def inner_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that connect the components in each group as all links there do."""
    sorted_ = dealt(groups, sets).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "uid")

    def run(batches):
        """Groups follow each other; only the last one of what is held may go on in the next slice."""
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = pa.Table.from_batches([batch.slice(at, SLICE)])
                held = part if held is None else pa.concat_tables([held, part])
                ends = group_ends(held)
                if len(ends):
                    yield as_batch(found(held.slice(0, ends[-1]), ends[:-1]))
                    held = held.slice(ends[-1])
        if held is not None:
            yield as_batch(found(held, group_ends(held)))

    def group_ends(part: pa.Table) -> np.ndarray:
        return np.flatnonzero(np.any([np.diff(part[c].to_numpy()) != 0 for c in ("key", "low", "high")], axis=0)) + 1

    def found(part: pa.Table, cuts: np.ndarray) -> list[tuple[int, int]]:
        lists = part["tokens"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        tokens = lists.flatten().to_numpy().view(np.uint64)
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        uid, root, block = (part[c].to_numpy() for c in ("uid", "root", "block"))
        edges = [0, *cuts.tolist(), part.num_rows]
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out += _links(uid[a:b], root[a:b], block[a:b], tokens, starts[a : b + 1])
        return out

    def as_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    return cut(map_arrow(sorted_, run, "u long, v long"))


def connected(members: DataFrame, sets: DataFrame) -> DataFrame | None:
    """uid, root of all that links connect, from the members (hub, hub_n, uid, n) of the buckets with each hub, the hub among them."""
    spark = members.sparkSession
    none = spark.createDataFrame([], "uid long, root long")
    star = members.where("uid <> hub").where(fits(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("u"), F.col("uid").alias("v"))
    roots = merge(None, star_links(star, sets))
    groups = mixed(members.select(F.col("hub").alias("key"), "uid", "n"), none if roots is None else roots)
    done = []
    for turn in range(STARS + SPLITS):
        big = groups.where(large())
        if not big.limit(1).count():
            break
        done.append(groups.where(~large()).select("key", "uid", "n"))
        if turn < STARS:
            pairs = with_hub(big, turn, True)
            roots = merge(roots, star_links(pairs.select("u", F.col("uid").alias("v")), sets))
            smaller = big.select("key", "uid", "n")
        else:
            links, smaller = split(big, sets, turn)
            roots = merge(roots, links)
        groups = mixed(smaller, none if roots is None else roots)
    if done:  # components may have merged since
        for d in done:
            groups = groups.select("key", "uid", "n").unionByName(d)
        groups = mixed(groups, none if roots is None else roots)
    return merge(roots, inner_links(groups, sets))


def _identifier(doc_id: Column) -> list[Column]:
    """no_k, k: an identifier as two columns without nulls; a null one comes after all others."""
    return [doc_id.isNull().alias("no_k"), F.coalesce(doc_id, F.lit(0)).alias("k")]


def _rooted(named: DataFrame, marked: DataFrame, words: int) -> DataFrame:
    """s1, s2, no_k, k, hash, root: each set, its first row, and the smallest set number of its component."""
    order = F.struct(*_identifier(F.col("doc_id")), "hash")
    reps = marked.where("n > 0").groupBy("s1", "s2").agg(F.min(order).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = cut(reps.select("s1", "s2", "rep.no_k", "rep.k", "rep.hash", "n", "bands", F.monotonically_increasing_id().alias("uid")))

    keyed = reps.select(F.explode("bands").alias("key"), "uid", "n")
    # Aggregated before the exchange, so a bucket of a third of all rows loads no task.
    shared = keyed.groupBy("key").agg(F.min("uid").alias("hub"), F.min_by("n", "uid").alias("hub_n"), F.max("uid").alias("last")).where("hub < last")
    members = cut(keyed.join(shared.drop("last"), "key").select("hub", "hub_n", "uid", "n").distinct())

    busy = reps.join(members.select("uid").distinct(), "uid", "left_semi").select("uid", "no_k", "k", "hash")
    # Rows that repeat identifier and text are aggregated before the exchange.
    own = named.groupBy(*_identifier(F.col("doc_id")), "hash").agg(F.first("text").alias("text"))
    texts = busy.join(own, ["no_k", "k", "hash"]).select("uid", "text")
    roots = connected(members, cut(with_sets(texts, words)))
    if roots is None:
        roots = named.sparkSession.createDataFrame([], "uid long, root long")
    return reps.select("s1", "s2", "no_k", "k", "hash", "uid").join(roots, "uid", "left").select("s1", "s2", "no_k", "k", "hash", F.coalesce("root", "uid").alias("root"))


def _grouped(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, hash (of the text), n, and the first row of its component: no_k, k (its identifier), first_hash."""
    spark = df.sparkSession
    find_package(spark)
    named = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    marked = cut(describe(named, words), keep=True)
    with temporary(spark):
        placed = cut(_rooted(named, marked, words), keep=True)
    least = placed.groupBy("root").agg(F.min(F.struct("no_k", "k", "hash")).alias("first"))
    named_sets = placed.join(least, "root").select("s1", "s2", "first")
    own_row = F.struct(*_identifier(F.col("doc_id")), "hash")
    out = marked.select("doc_id", "hash", "n", "s1", "s2").join(named_sets, ["s1", "s2"], "left").withColumn("first", F.coalesce("first", own_row))
    return out.select("doc_id", "hash", "n", "first.no_k", "first.k", F.col("first.hash").alias("first_hash"))


def group(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles long, component_id long, kept boolean; one row for each row of ``df``."""
    component = F.when(~F.col("no_k"), F.col("k"))
    return _grouped(df, words, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_duplicates(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, without all but one of each component.

    The row with the smallest identifier stays; of several with that identifier
    the one whose text has the smallest hash, and of rows equal in both the one
    with the smallest hash of all columns.  Rows equal in everything are copies, one stays.
    """
    first = F.when(~F.col("no_k"), F.col("k"))
    firsts = _grouped(df, words, id_col, text_col).where(F.col("doc_id").eqNullSafe(first) & (F.col("hash") == F.col("first_hash")))
    keys = firsts.select("no_k", "k", "hash").distinct()
    # Columns go by number here, so no name of the table's can be in the way.
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    key = _identifier(F.col(f"c{df.columns.index(id_col)}").cast("long"))
    text = F.coalesce(F.col(f"c{df.columns.index(text_col)}"), F.lit(""))
    once = numbered.groupBy(*key, F.xxhash64(text).alias("hash")).agg(F.min_by(F.struct(*numbered.columns), row_hash(numbered)).alias("row"))
    return once.join(keys, ["no_k", "k", "hash"], "left_semi").select("row.*").toDF(*df.columns)

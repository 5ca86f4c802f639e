"""Near-duplicate documents by an inverted join on MinHash coordinates, confirmed on full shingle sets.

1. Each document's set of distinct word shingles gets a 128-bit digest and `COORDINATES` minimum hashes. Documents with equal sets are one
   class, represented by its smallest doc_id; only representatives go on.
2. A representative is posted under its (coordinate, value) tokens. Tokens that one class holds can't collide, so a class with fewer than
   `MATCHES` shared ones has no partner. Two sets of the least similarity collide on at least `MATCHES` of the 64 coordinates (all but about one
   pair in 10**8), so by the prefix rule they meet in the list of one of their `shared` - `MATCHES` + 1 rarest tokens. Longer lists are
   skipped by the merge and probed afterwards.
3. Every prefix list is merged against its most central member, the anchor. A pair met there is probed on the skipped coordinates; pairs of
   `MATCHES` collisions or more, and of fitting sizes, are confirmed on full sets. Confirmed links are contracted to components.
4. A list whose members lie in one component is done. Members of the others are posted again, under the rarest quarter of their whole sets (the prefix rule on
   shingles, which is exact, and which parts documents that share a template but not their rare words). In the lists that still join several
   components all pairs of different ones are decided: a short list joins them as rows, which are counted and confirmed like the first ones; a longer one is
   dealt into cells bounded by members and bytes, which compare the sets and return a spanning forest of their links.
5. Components of the links; every class member takes its representative's.

Nothing is capped: a list of any length is dealt into cells. Pairs inside a component that is already
joined aren't looked for, since they can't change it.

Similarity is |A n B| / |A u B| in whole percent, exactly `percent` * union <= 100 * intersection. Edge cases: a null or empty text has
no shingle, n_shingles 0, and is linked with nothing; a text of fewer than five words is one shingle, its whole
sequence. Rows that share a doc_id are one node of the graph, so all their links count for it. A null doc_id is never linked and is kept, with a
null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.graph import connected_components
from tallymark.session import staged

from .base import WordHashes, mix64, packed, pick, text_slices, texts_of, unpacked

WORDS = 5
COORDINATES = 64
MATCHES = 28
#: Members and bytes of sets on one side of a cell, and the longest list of which the pairs are joined as rows.
BLOCK, CELL_BYTES, SHORT = 512, 4 << 20, 32
#: Anchors that a group of near copies is tried against before its pairs are.
HUBS = 12
_A = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str, words: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; bytes.lower() changes A-Z only."""
    h = words.of(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(h):
        return h
    n = min(WORDS, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _tokens(sets: list[np.ndarray]) -> np.ndarray:
    """A row of tokens for each set: the coordinate in the upper 6 bits, a hash of its minimum below."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(COORDINATES):
            out[:, k] = mix64(np.minimum.reduceat(flat * _A[k], starts))
    return ((out >> np.uint64(6)) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(58))).view(np.int64)


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set) and tokens of each document. Sets of one or two shingles only match equal ones and get no token."""

    def run(batches: Iterator[pa.RecordBatch]):
        from xxhash import xxh3_128_digest

        words = WordHashes()
        for batch in text_slices(batches):
            sets = [shingles(t, words) for t in texts_of(batch)]
            digest = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            large = [i for i, s in enumerate(sets) if len(s) > 2]
            sizes = np.zeros(len(sets), np.int32)
            sizes[large] = COORDINATES
            flat = _tokens([sets[i] for i in large]).ravel() if large else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))], ["doc_id", "n_shingles", "d1", "d2", "tokens"])

    return pick(documents, "doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, tokens array<long>")


def full_sets(documents: DataFrame) -> DataFrame:
    """node (the doc_id) and its whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]):
        words = WordHashes()
        for batch in text_slices(batches):
            sets = [shingles(t, words) for t in texts_of(batch)]
            at = pa.array(np.append(0, np.cumsum([len(s) for s in sets])), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(np.concatenate(sets).view(np.int64)))], ["node", "set"])

    return documents.mapInArrow(run, "node long, set array<long>").where(F.size("set") > 0)


def posted_members(classes: DataFrame, agreeing: int) -> DataFrame:
    """rep, n_shingles, tokens (those of at least two classes, the rarest first), centre, of each class that can have a partner.

    The two shuffles of tokens carry token, rep and size only; a class meets its at most `COORDINATES` tokens again in one row.
    """
    posts = classes.where(F.size("tokens") > 0).select("rep", "d1", "n_shingles", F.explode("tokens").alias("token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = posts.join(shared, "token").groupBy("rep", "d1").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("found"), F.max("n_shingles").alias("n_shingles"), F.sum("df").alias("centre"))
    return own.where(F.size("found") >= agreeing).select("rep", "n_shingles", F.col("found.token").alias("tokens"), "centre")


def _collisions(left: Column, right: Column) -> Column:
    """On how many coordinates two token rows agree: a token holds its coordinate."""
    return F.size(F.array_intersect(left, right))


def _fit(left: Column, right: Column, percent: int) -> Column:
    return 100 * F.least(left, right) >= percent * F.greatest(left, right)


def counted(pairs: DataFrame, members: DataFrame, percent: int, agreeing: int) -> DataFrame:
    """The pairs (a, b) that collide often enough over all coordinates, the skipped lists included."""
    side = lambda x: members.select(F.col("rep").alias(x), F.col("tokens").alias(f"{x}_tokens"), F.col("n_shingles").alias(f"{x}_n"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_fit(F.col("a_n"), F.col("b_n"), percent) & (_collisions(F.col("a_tokens"), F.col("b_tokens")) >= agreeing)).select("a", "b").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, as src, dst."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", common.alias("common"), (F.size("a_set") + F.size("b_set")).alias("sizes"))
    return rows.where(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def forest(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Links between members of different components at places `left` and `right`, thinned to a spanning forest.

    Counts of common shingles come from a product of 0/1 matrices over the shingles that both sides hold.
    """
    src: list[int] = []
    dst: list[int] = []
    if not len(left) or not len(right):
        return src, dst
    a, b = np.concatenate([sets[k] for k in left]), np.concatenate([sets[k] for k in right])
    na, nb = np.array([len(sets[k]) for k in left]), np.array([len(sets[k]) for k in right])
    common = np.intersect1d(a, b)
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    counts = np.zeros((len(na), len(nb)), np.float32)
    for at in range(0, len(common), 1024):  # a strip of columns at a time bounds the matrices
        strip = common[at : at + 1024]
        m, n = np.zeros((len(na), len(strip)), np.float32), np.zeros((len(nb), len(strip)), np.float32)
        for values, rows, to in ((a, ra, m), (b, rb, n)):
            k = np.minimum(np.searchsorted(strip, values), len(strip) - 1)
            hit = strip[k] == values
            to[rows[hit], k[hit]] = 1
        counts += m @ n.T
    union = na[:, None] + nb[None, :] - counts
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    apart = component[left][:, None] != component[right][None, :]
    for i, j in zip(*np.nonzero(apart & (100 * counts >= percent * union))):
        p, q = find(int(component[left[i]])), find(int(component[right[j]]))
        if p != q:
            root[max(p, q)] = min(p, q)
            src.append(int(ids[left[i]]))
            dst.append(int(ids[right[j]]))
    return src, dst


def _lists_left(posts: DataFrame) -> DataFrame:
    """Lists of `posts` (token, rep, component, centre) that join several components, one of those that hold the same members: token, m, main.

    `main` is the component of the list's most central member; whoever is in it is only compared with those who aren't.
    """
    found = posts.groupBy("token").agg(
        F.count("*").alias("m"), F.min("component").alias("least"), F.max("component").alias("most"),
        F.max_by("component", F.struct("centre", "rep")).alias("main"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s1"), F.sum(F.hash("rep").cast("long")).alias("s2"),
    )
    return found.where("least < most").groupBy("m", "s1", "s2").agg(F.min("token").alias("token"), F.min_by("main", "token").alias("main")).drop("s1", "s2")


def _rare_posts(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """token, rep, component, centre: every set under the rarest of its shingles, as many as two similar sets can't both lack (the prefix rule on the sets)."""
    own = sets.join(members, F.col("node") == F.col("rep")).select("rep", "component", "centre", F.size("set").alias("n"), F.explode("set").alias("token"))
    shared = own.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    found = own.join(shared, "token").groupBy("rep", "component", "centre", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("found"))
    lacking = F.floor(F.col("n") * (100 - percent) / 100) + 1 - (F.col("n") - F.size("found"))
    found = found.where(lacking > 0).select("rep", "component", "centre", F.slice("found.token", F.lit(1), lacking.cast("int")).alias("found"))
    return found.select("rep", "component", "centre", F.explode("found").alias("token")).distinct()


def _short_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in lists of at most `SHORT` members."""
    side = lambda x: rows.select("token", F.col("rep").alias(x), F.col("component").alias(f"{x}_component"))
    both = side("a").join(side("b"), "token").where("a < b and a_component <> b_component")
    return both.select("a", "b").distinct()


def _cells(rows: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (src, dst) between components in longer lists: members outside the main component meet all members, in cells bounded by members and bytes.

    `rows` has token, m, main, rep, component, set.
    """
    lone = F.col("component") != F.col("main")
    size = F.lit(8).cast("long") * F.size("set")
    blocks = lambda n, bytes_: F.ceil(F.greatest(n / BLOCK, bytes_ / CELL_BYTES)).cast("int")
    sizes = rows.groupBy("token").agg(blocks(F.count("*"), F.sum(size)).alias("mb"), blocks(F.count_if(lone), F.sum(F.when(lone, size))).alias("ub"))
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rows.join(sizes, "token")
    left = rows.where(lone).select("token", place("ub").alias("i"), every("mb").alias("j"), F.lit(True).alias("lone"), "rep", "component", "set")
    right = rows.select("token", every("ub").alias("i"), place("mb").alias("j"), F.lit(False).alias("lone"), "rep", "component", "set")

    def run(table: pa.Table) -> pa.Table:
        side = table.column("lone").to_numpy().astype(bool)
        lists = table.column("set").combine_chunks()
        sets = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
        src, dst = forest(table.column("rep").to_numpy(), table.column("component").to_numpy(), sets, np.flatnonzero(side), np.flatnonzero(~side), percent)
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return left.unionByName(right).groupBy("token", "i", "j").applyInArrow(run, "src long, dst long")


def links(classes: DataFrame, documents: DataFrame, percent: int = 75, agreeing: int = MATCHES) -> DataFrame:
    """src, dst: links between class representatives whose components are those of all links."""
    members = staged(posted_members(classes, agreeing), "members")
    wanted = staged(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")  # by itself, so that Spark sees how small it is
    sets = staged(full_sets(documents.join(wanted, "doc_id", "left_semi")), "sets")
    lists = staged(members.select("rep", "centre", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - agreeing + 1)).alias("token")).distinct(), "lists")

    # One list in HUBS is merged against its most central member, the others against one drawn by a hash that lists of the same members agree on: a group gets several anchors.
    draw = F.pmod(F.xxhash64("token"), F.lit(HUBS))
    anchors = lists.groupBy("token").agg(F.max_by("rep", F.struct(F.when(draw == 0, F.col("centre")).otherwise(F.xxhash64("rep", draw)), "rep")).alias("anchor"), F.count("*").alias("m")).where("m > 1")
    met = lists.join(anchors.drop("m"), "token").where("rep <> anchor").groupBy(F.col("anchor").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("met"))
    first = staged(confirmed(staged(counted(met.drop("met"), members, percent, agreeing), "counted"), sets, percent), "links")
    joined = connected_components(first).withColumnsRenamed({"node": "rep"})

    # The anchors' pairs are done; members of lists that join several components meet again under their rarest shingles.
    placed = staged(lists.join(joined, "rep", "left").select("token", "rep", "centre", F.coalesce("component", "rep").alias("component")), "placed")
    unsettled = placed.join(_lists_left(placed).where("m > 2").select("token"), "token", "left_semi").select("rep", "component", "centre").distinct()
    posts = staged(_rare_posts(sets, unsettled, percent), "rare-posts")
    rows = staged(posts.drop("centre").join(_lists_left(posts), "token"), "open-lists")
    short = confirmed(staged(counted(_short_pairs(rows.where(F.col("m") <= SHORT)), members, percent, agreeing), "pairs"), sets, percent)
    long = rows.where(F.col("m") > SHORT).join(sets.withColumnRenamed("node", "rep"), "rep")
    second = staged(short.union(_cells(long, percent)), "more-links")
    return joined.select(F.col("rep").alias("src"), F.col("component").alias("dst")).union(second)


def near_duplicates(documents: DataFrame, percent: int = 75, agreeing: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    docs = pick(documents, "doc_id", "text")
    sketch = staged(sketches(docs), "sketch")
    present = sketch.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = staged(present.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("tokens").alias("tokens")), "classes")
    again = present.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    again = present.join(again, "doc_id").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    components = connected_components(links(classes, docs, percent, agreeing).union(again)).select(F.col("node").alias("rep"), "component")
    by_class = classes.select("d1", "d2", "rep").join(components, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "d1", "d2").join(by_class, ["d1", "d2"], "left")
    has = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(has, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each component, the one of smallest doc_id, with its columns as they were; of rows that share a doc_id and are equal in text one stays."""
    found = near_duplicates(documents, percent).where("kept").select(F.col("doc_id").alias("found")).distinct()
    rows = packed(documents).join(found, F.col("doc_id").eqNullSafe(F.col("found")), "left_semi")
    return unpacked(rows.dropDuplicates(["doc_id", "text"]))

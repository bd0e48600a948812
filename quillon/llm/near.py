"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets, stars.

1. A document's set is its distinct five-word shingles (64-bit hashes). One hash per shingle is cut into
   BINS bins and the least value of each bin kept; an empty bin borrows from the first non-empty bin
   of its own fixed random order. BANDS bands of the signature make bucket keys.
2. Documents with the same set are one node, under their smallest doc_id.
3. In each bucket a star joins its hub (the node that shares most with other nodes over all buckets) to
   the others, so that a bucket of n nodes gives n - 1 candidates and not n^2. Candidates are confirmed
   on full sets, read from whole texts.
4. Confirmed links make components (smallest label of neighbours, pointer jumping, contraction).
5. A star can miss a link between two of its rays. Of the nodes in buckets that still hold several
   components, those that share under three quarters of their shingles with such nodes outside their own
   component cannot link with any and are done. Buckets with several components among the rest get more stars, GROWTH times as many centres each round, between nodes of different components only, until
   every pair of a bucket is in one component or known to be apart. Two exact bounds tell most pairs
   apart without a look at their texts: what both share with the hub, what of the rest is not their own,
   and what of all is not their component's own; and a table of SLOTS flags per node (a shingle whose
   slot is empty in the other node is not in it). So the bands alone decide what is found: a pair at 0.75 shares a bucket but for about
   5 in a million cases.

Nothing is capped: a large group of near copies merges in the first rounds, which then leaves nothing
to test. All tables between the steps are written to shared storage. Exchanges that carry texts or
buckets are joins whose large partitions Spark splits, so no key is held by one task.

Defined cases: null, empty and blank texts have an empty set and link with nothing; with fewer than five
words the sequence is one shingle; rows that repeat a doc_id are one node with the links of all its
texts; rows with a null doc_id take no part (component null, kept); an empty table gives an empty table;
other columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, give_back, mixed, read_table, small_batches, stored, window_hashes, word_hashes

WIDTH = 5
PERCENT = 75
BINS, BANDS = 128, 32
ROWS = BINS // BANDS
GROWTH = 16
SLOTS = 2048
#: Up to so many ids (8 bytes each) are sent to all executors to pick texts; beyond that texts are dealt by id.
BROADCAST_IDS = 500_000

_shift = np.uint64(64 - BINS.bit_length() + 1)
_edges = np.arange(BINS, dtype=np.uint64) << _shift
_rng = np.random.Generator(np.random.PCG64(75))
#: For each bin, the fixed random order in which it looks for a bin to borrow from (itself first).
_donors = np.stack([np.concatenate(([b], (p := _rng.permutation(BINS))[p != b])) for b in range(BINS)])
_band_seeds = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return np.unique(window_hashes(word_hashes((text or "").encode()), WIDTH))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value per bin, from one hash per shingle. The set must not be empty and is sorted."""
    first = np.searchsorted(shingles, _edges)
    least = shingles[np.minimum(first, len(shingles) - 1)]
    filled = (first < len(shingles)) & (least >> _shift == np.arange(BINS, dtype=np.uint64))
    if not filled.all():
        least = least[_donors[np.arange(BINS), filled[_donors].argmax(axis=1)]]
    return least


def band_keys(shingles: np.ndarray) -> np.ndarray:
    out = _band_seeds.copy()
    for column in signature(shingles).reshape(BANDS, ROWS).T:
        out = mixed(out ^ column)
    return out.view(np.int64)


def slot_flags(shingles: np.ndarray) -> np.ndarray:
    flags = np.zeros(SLOTS, bool)
    flags[(shingles & np.uint64(SLOTS - 1)).astype(np.int64)] = True
    return np.packbits(flags).view(np.int64)


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 1024):
        sizes, prints, keys, slots = [], [], [], []
        for text in batch.column("text").to_pylist():
            shingles = shingle_set(text)
            sizes.append(len(shingles))
            prints.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            keys.append(band_keys(shingles) if len(shingles) else None)
            slots.append(slot_flags(shingles) if len(shingles) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(slots, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "bands", "slots"])
    give_back()


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and their texts, in runs of equal a -> a, b, shared, total."""
    last, last_text, own = None, None, None
    for batch in batches_of(batches, 256):
        shared, total = [], []
        for a, text_a, text_b in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
            if a != last or own is None:
                last, own = a, shingle_set(text_a.as_py())
            other = shingle_set(text_b.as_py())
            at = np.searchsorted(own, other)
            both = int((own[np.minimum(at, len(own) - 1)] == other).sum()) if len(own) else 0
            shared.append(both)
            total.append(len(own) + len(other) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "shared", "total"])
    give_back()


def _common_flags(x: str, y: str):
    each = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(q)))
    return F.aggregate(each, F.lit(0), lambda total, k: total + k)


def _explode_shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 256):
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        nodes = np.repeat(batch.column("node").to_numpy(), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], names=["node", "shingle"])
    give_back()


def own_shingles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, label -> node, own, within: how many shingles of a node no other node has, and how many no node
    outside its component has. Counts per shingle are pre-aggregated, whatever the groups are; they stay
    true when components merge. Nodes with several texts are left out."""
    rows = texts.join(nodes, "node", "left_semi")
    single = rows.groupBy("node").agg(F.count(F.lit(1)).alias("texts")).where("texts = 1").select("node")
    shingles = rows.mapInArrow(_explode_shingles, "node long, shingle long").join(nodes, "node")
    holders = shingles.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min("label").alias("l"), F.max("label").alias("h"))
    closed = holders.where("l = h").select("shingle", (F.col("low") == F.col("high")).alias("alone"))
    counted = shingles.join(closed, "shingle").groupBy("node").agg(F.count_if("alone").alias("own"), F.count(F.lit(1)).alias("within"))
    return counted.join(single, "node", "left_semi")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b -> a, b, shared, linked: counted on the full sets of both."""
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    counts = both.mapInArrow(_confirm, "a long, b long, shared long, total long")
    return counts.select("a", "b", "shared", (100 * F.col("shared") >= PERCENT * F.col("total")).alias("linked"))


def components(edges: DataFrame) -> DataFrame:
    """u, v (undirected) -> node, label: the smallest node that each node of an edge reaches.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots and
    contracts, which at least halves the nodes that still have edges.
    """
    labels = None
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "cc-hooks")
        while True:
            jump = hooks.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = stored(hooks.join(jump, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "cc-jump")
            hooks, moved = jumped.select("node", "label"), not jumped.where("moved").isEmpty()
            if not moved:
                break
        to = hooks.select(F.col("node").alias("v"), F.col("label").alias("to_v"))
        of = hooks.select(F.col("node").alias("u"), F.col("label").alias("to_u"))
        edges = edges.join(of, "u").join(to, "v").where("to_u <> to_v")
        edges = stored(edges.select(F.greatest("to_u", "to_v").alias("u"), F.least("to_u", "to_v").alias("v")).distinct(), "cc-edges")
        labels = hooks if labels is None else relabelled(labels, hooks)
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def relabelled(labels: DataFrame, newer: DataFrame) -> DataFrame:
    """node, label and the labels of labels -> node, label."""
    step = newer.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return stored(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "cc-labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id, kept; one row per row of docs."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketches = stored(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, print binary, bands array<long>, slots array<long>"), "near-sketches")
    known = sketches.where("doc_id is not null")
    # stored, so that both sides of a join are plain exchanges: Spark then splits a set with many documents
    nodes = stored(known.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("node")), "near-prints")
    sets = stored(known.where("print is not null").select("doc_id", "print").join(nodes, "print").select("doc_id", "node").distinct(), "near-nodes")
    # one row per node: the document that it is named after; a doc_id with several texts has a row for each
    named = nodes.select(F.col("print").alias("of_print"), "node")
    first = known.join(named, (F.col("print") == F.col("of_print")) & (F.col("doc_id") == F.col("node"))).groupBy("print").agg(F.first("node").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("slots").alias("slots"))
    first = stored(first, "near-first")
    banded = stored(first.select("node", "n", F.explode("bands").alias("key")), "near-bands")
    buckets = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    buckets = stored(buckets.select("key", "size"), "near-buckets")
    members = stored(banded.join(buckets, "key"), "near-members")
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    hubs = members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"))).alias("hub")).select("key", (-F.col("hub.minus")).alias("hub"))
    hubs = stored(hubs, "near-hub-keys")
    # a doc_id with several texts has no set of its own to bound what it shares
    multi = stored(first.groupBy("node").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("node"), "near-multi")
    own_loose = multi.select("node", F.lit(True).alias("loose_node"))
    hub_loose = multi.select(F.col("node").alias("hub"), F.lit(True).alias("loose_hub"))
    members = members.join(hubs, "key").join(own_loose, "node", "left").join(hub_loose, "hub", "left")
    members = stored(members.withColumn("loose", F.col("loose_node").isNotNull() | F.col("loose_hub").isNotNull()).drop("loose_node", "loose_hub"), "near-hubs")
    wanted = stored(members.select(F.col("node").alias("doc_id")).distinct(), "near-wanted")
    picked = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
    slots = stored(first.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, F.col("node") == F.col("doc_id"), "left_semi").select("node", "n", "slots"), "near-slots")
    texts = stored(picked.select(F.col("doc_id").alias("node"), "text").distinct(), "near-texts")

    # the sets of one doc_id belong together
    several = sets.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v <> w").select("doc_id", "v")
    labels = components(sets.join(several, "doc_id").select(F.col("node").alias("u"), "v"))
    # what two nodes can share at most: within the hub, and outside it of what is not their own
    most = F.least(F.least("s", "s_c") + F.least("rest", "rest_c"), F.col("open"), F.col("open_c"))
    close = 100 * most >= PERCENT * (F.col("n") + F.col("m") - most)
    # a node's flags that the other one has not are so many shingles, or more, that it has not
    flagged = F.least(F.col("n") - F.col("flags"), F.col("m") - F.col("flags_c")) + _common_flags("slots", "slots_c")
    close = close & (100 * flagged >= PERCENT * (F.col("n") + F.col("m") - flagged))
    pairs = members.where("node <> hub").select(F.col("hub").alias("c"), "node")
    tested = None
    centres = 1
    while True:
        pairs = pairs.select(F.col("c").alias("a"), F.col("node").alias("b")).distinct()
        pairs = stored(pairs, "near-pairs")
        if pairs.isEmpty() and centres == 1:
            break
        if not pairs.isEmpty():
            decided = stored(confirmed(pairs, texts), "near-decided")
            if centres == 1:
                shares = decided.groupBy("a", "b").agg(F.max("shared").alias("s"))
                shares = shares.select(F.col("a").alias("hub"), F.col("b").alias("node"), "s")
                members = stored(members.join(shares, ["hub", "node"], "left").withColumn("s", F.when(F.col("loose"), F.col("n")).otherwise(F.coalesce("s", "n"))), "near-shares")
            apart = decided.groupBy("a", "b").agg(F.max("linked").alias("linked")).where("not linked").select("a", "b")
            tested = apart if tested is None else tested.union(apart)
            new = decided.where("linked").select("a", "b")
            for side in ("a", "b"):
                l = labels.select(F.col("node").alias(side), F.col("label").alias(f"to_{side}"))
                new = new.join(l, side, "left")
            merged = components(new.select(F.coalesce("to_a", "a").alias("u"), F.coalesce("to_b", "b").alias("v")))
            labels = stored(relabelled(labels, merged).union(merged.join(labels, "node", "left_anti")), "near-labels")
        # buckets that still hold several components
        labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        left = labelled.where(F.col("size") > max(2, centres))  # all pairs of smaller ones have been tested
        if centres == 1:
            several = left.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
            open_nodes = stored(left.join(several, "key", "left_semi").select("node", "label").distinct(), "near-open")
            own = stored(own_shingles(open_nodes, texts), "near-own")
            members = members.join(own, "node", "left").fillna(0, ["own", "within"]).withColumn("open", F.col("n") - F.col("within"))
            members = members.where(100 * F.col("open") >= PERCENT * F.col("n"))
            members = stored(members.withColumn("rest", F.when(F.col("loose"), F.col("n")).otherwise(F.greatest(F.lit(0), F.col("n") - F.col("s") - F.col("own")))).drop("own", "within"), "near-members")
            left = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).where("size > 2")
        mixed_buckets = left.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
        members_left = stored(left.join(mixed_buckets, "key", "left_semi"), "near-left")
        if members_left.isEmpty():
            break
        # Centres are nodes outside the bucket's largest component, so nodes that are together already are
        # not compared; one is a centre if its place in the bucket, a fixed random number, is early enough.
        parts = members_left.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows"))
        largest = parts.groupBy("key").agg(F.max(F.struct("rows", "label")).alias("l")).select("key", F.col("l.label").alias("largest"))
        ready = members_left.join(slots.withColumn("flags", _common_flags("slots", "slots")), ["node", "n"])
        place = F.pmod(F.xxhash64("key", "node"), F.lit(1 << 20)) / float(1 << 20) * F.col("size")
        early = (place < centres * GROWTH) | (F.col("size") <= centres * GROWTH)
        chosen = ready.join(largest, "key").where((F.col("label") != F.col("largest")) & early)
        chosen = chosen.select("key", F.col("node").alias("c"), F.col("n").alias("m"), F.col("s").alias("s_c"), F.col("rest").alias("rest_c"), F.col("open").alias("open_c"), F.col("label").alias("label_c"), F.col("slots").alias("slots_c"), F.col("flags").alias("flags_c"))
        pairs = ready.join(chosen, "key").where((F.col("label") != F.col("label_c")) & close)
        pairs = pairs.select(F.least("c", "node").alias("c"), F.greatest("c", "node").alias("node")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select(F.col("a").alias("c"), F.col("b").alias("node")), ["c", "node"], "left_anti")
        centres *= GROWTH

    of_set = sets.groupBy("doc_id").agg(F.min("node").alias("node"))
    placed = sketches.select("doc_id", "n_shingles").join(of_set, "doc_id", "left")
    placed = placed.join(labels, "node", "left").withColumn("component_id", F.coalesce("label", "node", "doc_id"))
    return placed.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def filtered(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with its columns as they are; rows without an id stay.

    Of rows that repeat an id one stays, chosen by a hash of all its columns.
    """
    found = stored(near_duplicates(docs).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "near-found")
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*docs.columns).alias("row"))
    gone = found.where("not kept").select(F.col("doc_id").alias("id"))
    few = gone.count() <= BROADCAST_IDS
    rest = packed.join(F.broadcast(gone) if few else gone, "id", "left_anti")
    again = found.where("rows > 1 and kept and doc_id is not null").select(F.col("doc_id").alias("id"))
    if again.isEmpty():
        return rest.select("row.*")
    once = rest.join(again, "id", "left_anti").select("row")
    least = rest.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.xxhash64("row").alias("h"), "row")).alias("least"))
    return once.union(least.select("least.row")).select("row.*")


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

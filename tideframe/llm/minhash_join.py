"""Near-duplicate documents by an inverted join on signature coordinates.

Documents are sets of 5-word shingles. Sets that are equal collapse into one class first. Each class posts its signature
under every (coordinate, value) pair; pairs that one class alone holds cannot collide and go. Of the rest each class posts
the rarest only, the prefix: two signatures that agree in `matches` coordinates share a pair within both prefixes. Inside a
posting list, however long, signatures are compared whole, and those that agree often enough are linked into clusters.
Clusters hold the candidates: there the full sets are compared, and links of 100 * |A & B| >= percent * |A | B| make the
components. Signatures and documents of one component are not compared again (skip).

A posting list or cluster of many members is dealt out in blocks that share a few leaders; only members that their
block and the leaders leave outside its main component are then compared with all others, block by block. No task sees more
than a block pair, and tasks give spanning links, not all pairs. Joins by key broadcast the few keys of very many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, Words, mix, seeds, shingle_sets, text_slices, tidy
from .components import Groups, components
from .idfilter import id_filter
from .scratch import Scratch
from .skew import join_by_key
from .streams import groups

#: Signature size, and the agreements that make a candidate. At a similarity of 0.85 the chance that fewer than 23 of 40
#: coordinates agree is below 1e-5; at 0.35 that so many do is about 3e-3. Other thresholds need other matches: at 0.80
#: fewer than 20 agree with a chance of 5.0e-6.
COORDINATES, MATCHES = 40, 23
PERCENT = 85
#: Documents of a block of a cluster, signatures of a block of a posting list, and leaders that the blocks share.
BLOCK, SIGNATURES = 128, 1024
LEADERS = 4
SCALE = seeds(COORDINATES, 23) | U(1)
SHIFT = seeds(COORDINATES, 29)


def signature(items: np.ndarray) -> np.ndarray:
    """The least image of a set under each of COORDINATES hash functions."""
    out = np.full(COORDINATES, ~U(0), dtype=U)
    for lo in range(0, len(items), 20_000):
        part = items[lo : lo + 20_000]
        for k in range(COORDINATES):
            out[k] = min(out[k], (part * SCALE[k] + SHIFT[k]).min())
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, f1, f2, signs = [], [], [], []
        for _, _, data, offsets in text_slices(batch.column("text")):
            for items in shingle_sets(Words(data, offsets)):
                n.append(len(items))
                f1.append(mix(items ^ U(0x1234567)).sum(dtype=U))
                f2.append(mix(items + U(0x89ABCDEF01)).sum(dtype=U))
                signs.append(signature(items))
        rows = len(n)
        flat = np.concatenate(signs).view(np.int64) if rows else np.zeros(0, np.int64)
        sig = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * COORDINATES), pa.array(flat))
        as_long = lambda x: pa.array(np.array(x, dtype=U).view(np.int64))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "f1": as_long(f1), "f2": as_long(f2), "sig": sig})


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _agreeing(matches: int):
    """Spanning links of the signatures in one block of a posting list that agree in `matches` coordinates at least; those
    with equal `comp` are linked already. Where a group has rows marked outside, only their links are looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for table in groups(batches, ["key", "block", "other"]):
            n, ids = table.num_rows, table.column("doc_id").to_numpy()
            sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(n, COORDINATES)
            outside = table.column("outside").to_numpy().astype(bool)
            linked = Groups(n)
            linked.label = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
            for i in np.flatnonzero(outside).tolist() if outside.any() else range(n - 1):
                rest = np.flatnonzero(linked.label != linked.label[i]) if outside.any() else np.flatnonzero(linked.label[i + 1 :] != linked.label[i]) + i + 1
                near = rest[(sig[rest] == sig[i]).sum(axis=1) >= matches]
                if len(near):
                    out += [(int(ids[i]), int(ids[j])) for j in linked.join(i, near)]
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def similar_rows(sets: list[np.ndarray], i: int, order: np.ndarray, starts: np.ndarray, ranks: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Numbers of the sets whose similarity with set i is percent / 100 at least (order, starts: sets by item rank)."""
    at = ranks[i]
    counts = starts[at + 1] - starts[at]
    ends = np.cumsum(counts)
    held = order[np.repeat(starts[at] - (ends - counts), counts) + np.arange(ends[-1])]
    shared = np.bincount(held, minlength=len(sets))
    sizes = np.array([len(s) for s in sets])
    return np.flatnonzero(100 * shared >= percent * (sizes + len(sets[i]) - shared))


def linked(sets: list[np.ndarray], wanted: np.ndarray, known: Groups, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning links, beyond those known, between each wanted set and all sets."""
    full = [i for i, s in enumerate(sets) if len(s)]
    if len(full) < 2:
        return []
    items = np.concatenate([sets[i] for i in full])
    owner = np.repeat(full, [len(sets[i]) for i in full])
    distinct, rank = np.unique(items, return_inverse=True)
    order = owner[np.argsort(rank, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(distinct)))])
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ranks = np.split(rank, cuts)
    out = []
    for i in np.flatnonzero(wanted).tolist():
        if len(sets[i]):
            near = similar_rows(sets, i, order, starts, ranks, percent)
            out += [(i, j) for j in known.join(i, near)]
    return out


def _confirmed(percent: int):
    """Spanning links on full sets inside each (cluster, block, other) group; documents with equal `comp` are linked already.

    Where a group has rows marked outside, only their links are looked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for table in groups(batches, ["cluster", "block", "other"]):
            ids, outside = table.column("doc_id").to_pylist(), table.column("outside").to_numpy().astype(bool)
            known = Groups(len(ids))
            known.label = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
            sets = [s for _, _, data, offsets in text_slices(table.column("text")) for s in shingle_sets(Words(data, offsets))]
            out += [(ids[i], ids[j]) for i, j in linked(sets, outside if outside.any() else ~outside, known, percent)]
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _confirm(rows: DataFrame, percent: int) -> DataFrame:
    keys = ["cluster", "block", "other"]
    return rows.select(*keys, "doc_id", "comp", "outside", "text").repartition(*keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(tidy(_confirmed(percent)), "a long, b long")


def dealt(members: DataFrame, group: str, block: int, scratch: Scratch) -> DataFrame:
    """(group, block, other, doc_id, comp, outside): members (group, n, doc_id) of groups of n, in blocks of about `block`
    members. Groups of more than one block have LEADERS members in all of them."""
    one = members.where(F.col("n") <= block).select(group, F.lit(0).alias("block"), "doc_id")
    large = scratch.cut(members.where(F.col("n") > block))
    least = large.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.min(F.struct(F.xxhash64("doc_id", F.lit(i)), "doc_id"))["doc_id"].alias(f"l{i}") for i in range(LEADERS)])
    total = large.count()
    if total:
        blocks = F.ceil(F.col("n") / block).cast("int")
        leader = F.col("doc_id").isin(*[F.col(f"l{i}") for i in range(LEADERS)])
        places = F.when(leader, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", F.lit(77)), blocks).cast("int")))
        more = join_by_key(large.drop("n"), least, [group], "n", total).select(group, F.explode(places).alias("block"), "doc_id")
        one = one.unionByName(more)
    return one.withColumns({"other": F.lit(0), "comp": F.col("doc_id"), "outside": F.lit(False)})


def left_out(members: DataFrame, group: str, block: int, found: DataFrame, scratch: Scratch) -> DataFrame | None:
    """The same for groups of more than one block, once their blocks' links make the components `found`: members outside
    their group's main component meet all its members, block by block. None if there is no such group."""
    large = members.where(F.col("n") > block)
    placed = scratch.cut(large.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(group, "n", "doc_id", F.coalesce("component", "doc_id").alias("comp")))
    total = placed.count()
    if not total:
        return None
    of = placed.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n")).groupBy(group)
    # of each group: its main component, and the members outside it
    main = of.agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.first("n").alias("n"), (F.sum("m") - F.max("m")).alias("out")).where("out > 0")
    grid = join_by_key(placed.drop("n"), main, [group], "n", total).withColumns({"outside": F.col("comp") != F.col("main"), "wide": F.ceil(F.col("out") / block).cast("int"), "high": F.ceil(F.col("n") / block).cast("int")})
    mine = lambda c, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(c)).cast("int")
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    wanted = grid.where("outside").select(group, mine("wide", 3).alias("block"), F.explode(each("high")).alias("other"), "doc_id", "comp", "outside")
    against = grid.select(group, F.explode(each("wide")).alias("block"), mine("high", 4).alias("other"), "doc_id", "comp", F.lit(False).alias("outside"))
    return wanted.unionByName(against)


def candidate_clusters(sets: DataFrame, scratch: Scratch, matches: int = MATCHES) -> DataFrame:
    """(node, component): clusters of classes whose signatures agree often (sets: doc_id, sig)."""
    posts = sets.select("doc_id", F.posexplode("sig").alias("k", "v")).select("doc_id", F.xxhash64("k", "v").alias("key"))
    shared = scratch.cut(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    held = join_by_key(posts, shared, ["key"], "n", sets.count() * COORDINATES)
    held = held.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("held"))  # 40 a document
    prefix = held.where(F.size("held") >= matches).select("doc_id", F.explode(F.expr(f"slice(held, 1, size(held) - {matches - 1})")).alias("h"))
    lists = scratch.cut(prefix.select(F.col("h.key").alias("key"), "doc_id"))
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.cut(join_by_key(lists, sizes, ["key"], "n", lists.count()))
    signs = sets.select("doc_id", F.transform("sig", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("sig"))
    keys = ["key", "block", "other"]
    agree = lambda rows: rows.join(signs, "doc_id").repartition(*keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(tidy(_agreeing(matches)), "a long, b long")
    found = components(agree(dealt(members, "key", SIGNATURES, scratch)), scratch)
    more = left_out(members, "key", SIGNATURES, found, scratch)
    if more is not None:
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(scratch.cut(agree(more))), scratch)
    return found


def link_documents(docs: DataFrame, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """Each row's doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included) and kept.

    percent is the least similarity of a link, in hundredths; matches the agreeing coordinates that make a candidate.

    Words, sets and links are as in the module's head. A text without words, or null, has an empty set and no link. A row
    without doc_id is linked with nothing: its component is null and it is kept. Rows that repeat a doc_id are one
    document in the graph and a row each in the result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = scratch.cut(rows.mapInArrow(tidy(_signatures), "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>"))
    full = made.where("n_shingles > 0 and doc_id is not null")
    # equal sets: the least doc_id stands for its class
    names = ["n_shingles", "f1", "f2"]
    same = full.groupBy(*names).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("rep <> most").drop("most")
    same = scratch.cut(same)
    whole = full.count()
    copies = scratch.cut(join_by_key(full.select("doc_id", *names), same, names, "n", whole).where("doc_id <> rep").select("doc_id", "rep"))
    reps = full.join(copies.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_shingles", "sig")
    clusters = scratch.cut(candidate_clusters(reps, scratch, matches).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")))

    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    members = scratch.cut(join_by_key(clusters, sizes, ["cluster"], "n", clusters.count()))
    texts = scratch.cut(rows.where(id_filter(members, "doc_id").may_hold("doc_id")).join(members.select("doc_id"), "doc_id"))
    links = scratch.cut(_confirm(dealt(members, "cluster", BLOCK, scratch).join(texts, "doc_id"), percent))
    found = components(links, scratch)
    more = left_out(members, "cluster", BLOCK, found, scratch)
    if more is not None:
        links = scratch.cut(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_confirm(more.join(texts, "doc_id"), percent)))
        found = components(links, scratch)

    found = found.where("node <> component")
    told = same.select("rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("moved"))
    moved = join_by_key(copies, told, ["rep"], "n", whole).select("doc_id", "moved")
    moved = moved.unionByName(found.select(F.col("node").alias("doc_id"), F.col("component").alias("moved"))).distinct()
    return made.select("doc_id", "n_shingles").join(moved, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("moved", "doc_id").alias("component_id"), F.coalesce(F.col("moved").isNull() | (F.col("moved") == F.col("doc_id")), F.lit(True)).alias("kept"))

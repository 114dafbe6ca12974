"""Near-duplicate embeddings by product quantisation.

A coarse quantiser of one or two levels deals unit vectors into inverted lists; what it leaves of a vector is coded by
subspace. A vector looks into every later list that can hold a link: a vector within reach lies in a list only if the first
is within reach of the bisector of that list's centre and its own. There, table-lookup distances between the vector and the
codes, less each code's own error, rule most vectors out, and exact cosines decide on the rest. The probes and the error
bound are sufficient, so no link is missed; the codebooks, fitted on a bounded sample, only set how much is ruled out.

Equal vectors collapse into one before that. Lists are per label and width; labels of few vectors are one list each. A list
with many members or visitors is dealt out in blocks, so no task sees more than two blocks. Tasks give counts and spanning
links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import tidy
from .components import Groups, components
from .scratch import Scratch
from .sharding import uniform
from .skew import join_by_key
from .streams import groups

LEAST = 0.98
#: Vectors of the sample the codebooks are fitted on, vectors a list is meant for, and lists of the first level; beyond
#: these, lists are cut by a second level, without bound.
SAMPLE, PER_LIST, FIRST_LISTS = 20_000, 4096, 1024
SUBSPACES, CODES = 8, 64
#: Vectors of a block, and of a label up to which it is one list.
BLOCK, WHOLE = 8192, 8192
#: Labels whose vectors are dealt into lists: a bound of what is broadcast.
MOST_LABELS = 1_000_000


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(half - x[lo : lo + 4096] @ centres.T).argmin(axis=1) for lo in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of x; an empty cluster takes a random row."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        count = np.bincount(at, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(1, count)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


@dataclass
class Level:
    """Centres, and how far they lie from each other."""

    centres: np.ndarray
    apart: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        norms = (self.centres**2).sum(axis=1)
        self.apart = np.sqrt(np.maximum(0, norms[:, None] - 2 * self.centres @ self.centres.T + norms))

    def within(self, x: np.ndarray, reach: float) -> np.ndarray:
        """Which centres' cells each row is within reach of: rows x centres."""
        far = (x**2).sum(axis=1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(axis=1)
        at = far.argmin(axis=1)
        return far - far[np.arange(len(x)), at][:, None] <= 2 * self.apart[at] * reach + 1e-6


@dataclass
class Index:
    """Coarse centres of two levels (the second may be one centre, nought) and subspace codebooks, for unit vectors of one
    width. A list is numbered first level * centres of the second + second level."""

    first: Level
    second: Level
    bounds: np.ndarray
    books: list[np.ndarray]
    reach: float

    def centre(self, lists: np.ndarray) -> np.ndarray:
        k = len(self.second.centres)
        return self.first.centres[lists // k] + self.second.centres[lists % k]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The list of each unit vector."""
        at = nearest(x, self.first.centres)
        return at * len(self.second.centres) + nearest(x - self.first.centres[at], self.second.centres)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each unit vector."""
        at = self.assign(x)
        rest = x - self.centre(at)
        codes = np.empty((len(x), len(self.books)), np.uint8)
        left = np.zeros(len(x))
        for s, book in enumerate(self.books):
            part = rest[:, self.bounds[s] : self.bounds[s + 1]]
            codes[:, s] = nearest(part, book)
            left += ((part - book[codes[:, s]]) ** 2).sum(axis=1)
        return at, codes, np.sqrt(left)

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each unit vector: the lists whose cell lies within reach of it, its own included."""
        k = len(self.second.centres)
        row, cell = np.nonzero(self.first.within(x, self.reach))
        if k == 1:
            return np.split(cell, np.searchsorted(row, np.arange(1, len(x))))
        owner, found = [], []
        for lo in range(0, len(row), 4096):
            r, c = row[lo : lo + 4096], cell[lo : lo + 4096]
            i, fine = np.nonzero(self.second.within(x[r] - self.first.centres[c], self.reach))
            owner.append(r[i])
            found.append(c[i] * k + fine)
        owner, found = np.concatenate(owner), np.concatenate(found)
        return np.split(found, np.searchsorted(owner, np.arange(1, len(x))))

    def distances(self, queries: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to coded vectors of some lists: a table lookup in each subspace, which
        takes a row of all queries' distances for each code."""
        out = np.empty((len(codes), len(queries)), np.float32)
        for at in np.unique(lists):
            here = np.flatnonzero(lists == at)
            rest = queries - self.centre(np.array([at]))
            total, found = np.zeros((len(here), len(queries)), np.float32), np.empty((len(here), len(queries)), np.float32)
            for s, book in enumerate(self.books):
                part = rest[:, self.bounds[s] : self.bounds[s + 1]]
                table = ((book**2).sum(axis=1)[:, None] - 2 * book @ part.T + (part**2).sum(axis=1)).astype(np.float32)
                total += np.take(table, codes[here, s], axis=0, out=found, mode="clip")
            out[here] = total
        return np.maximum(0, out, out=out).T


def fit(sample: np.ndarray, rows: int, least: float = LEAST, seed: int = 5) -> Index:
    """Codebooks of unit vectors (sample) for labels of up to `rows` vectors."""
    rng, width = np.random.default_rng(seed), sample.shape[1]
    lists = max(1, rows // PER_LIST)
    first = k_means(sample, min(lists, FIRST_LISTS), 8, rng)
    rest = sample - first[nearest(sample, first)]
    second = k_means(rest, min(-(-lists // FIRST_LISTS), len(sample)), 8, rng) if lists > FIRST_LISTS else np.zeros((1, width))
    rest = rest - second[nearest(rest, second)]
    bounds = np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int)
    books = [k_means(np.ascontiguousarray(rest[:, a:b]), CODES, 6, rng) for a, b in zip(bounds, bounds[1:], strict=False)]
    return Index(Level(first), Level(second), bounds, books, float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6)


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a list column of one width, as double, and scaled to unit length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x, x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _encode(shared):
    """Codes of vectors of the index's width; others have none, and lie in the list -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        width = int(index.bounds[-1])
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, lists = part.num_rows, np.full(part.num_rows, -1, np.int32)
                codes, error, visits = [b""] * n, np.zeros(n, np.float32), [[] for _ in range(n)]
                fits = np.flatnonzero(pc.list_value_length(part.column("v")).to_numpy() == width)
                if len(fits):
                    _, x = units(part.column("v").take(pa.array(fits)))
                    at, found, left = index.encode(x)
                    lists[fits], error[fits] = at, left + 1e-5
                    many = part.column("many").to_numpy(zero_copy_only=False)[fits].astype(bool)
                    for i, c in zip(fits.tolist(), found, strict=True):
                        codes[i] = c.tobytes()
                    for k, probed in zip(np.flatnonzero(many).tolist(), index.probes(x[many]) if many.any() else [], strict=True):
                        visits[fits[k]] = probed[probed > at[k]].tolist()
                yield pa.record_batch(
                    {
                        **{c: part.column(c) for c in ("key", "h", "rep", "copies", "many", "v")},
                        "at": lists,
                        "codes": pa.array(codes, pa.binary()),
                        "error": error,
                        "visits": pa.array(visits, pa.list_(pa.int32())),
                    }
                )

    return run


FOUND = "a long, h long, b long, links long"


def _search(shared, least: float):
    """Links of each (key, list, block, other) task: counts as (rep, h, null, count), spanning links as (rep, h, rep, null).

    Stored rows meet visiting ones, and each other where other is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        out: list[tuple] = []

        def give() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["a", "h", "b", "links"])

        for table in groups(batches, ["key", "list", "block", "other"]):
            rep, h, weight = (table.column(c).to_numpy() for c in ("rep", "h", "copies"))
            stored = table.column("stored").to_numpy().astype(bool)
            own, others = np.flatnonzero(stored), np.flatnonzero(~stored)
            x, unit = units(table.column("v").combine_chunks())
            length = np.sqrt((x**2).sum(axis=1))
            at, error = table.column("at").to_numpy()[own], table.column("error").to_numpy()[own]
            coded = at[0] >= 0 if len(own) else False
            codes = np.stack([np.frombuffer(c, np.uint8) for c in table.column("codes").to_pylist()])[own] if coded else None
            linked, count = Groups(len(rep)), np.zeros(len(rep))
            inner = table.column("other")[0].as_py() == 0
            # stored rows meet those after them, visitors all stored ones: each pair is seen once and counts for both
            tasks = [(own[lo : lo + 256], lo) for lo in range(0, len(own), 256)] if inner else []
            tasks += [(others[lo : lo + 256], None) for lo in range(0, len(others) if len(own) else 0, 256)]
            for q, lo in tasks:
                rest = slice(lo or 0, None)
                if coded:
                    near = index.distances(unit[q], at[rest], codes[rest]) <= (np.float32(index.reach) + error[rest] + np.float32(1e-4)) ** 2
                else:
                    near = np.ones((len(q), len(own[rest])), bool)
                if lo is not None:
                    near &= np.arange(near.shape[1]) > np.arange(len(q))[:, None]
                some, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(some):
                    continue
                q, cols = q[some], own[rest][columns]
                near = near[np.ix_(some, columns)]
                cosine = x[q] @ x[cols].T / (length[q][:, None] * length[cols])
                i, j = np.nonzero(near & (np.abs(cosine - least) < 1e-9))  # sums in another order may fall on the other side
                if len(i):
                    cosine[i, j] = np.einsum("ij,ij->i", x[q[i]], x[cols[j]]) / np.sqrt(np.einsum("ij,ij->i", x[q[i]], x[q[i]]) * np.einsum("ij,ij->i", x[cols[j]], x[cols[j]]))
                hit = near & (cosine >= least)
                count[q] += hit @ weight[cols]
                count[cols] += hit.T @ weight[q]
                for k in np.flatnonzero(hit.any(axis=1)).tolist():
                    met = cols[hit[k]]
                    met = met[linked.label[met] != linked.label[q[k]]]
                    for m in linked.join(int(q[k]), met) if len(met) else []:
                        out.append((int(rep[q[k]]), int(h[q[k]]), int(rep[m]), None))
            out += [(int(rep[k]), int(h[k]), None, int(count[k])) for k in np.flatnonzero(count).tolist()]
            if len(out) > 20_000:
                yield give()
        yield give()

    return run


def link_vectors(vectors: DataFrame, least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links (other vectors with the same label and cosine >= least), component_id (smallest vec_id that links
    reach, itself included) and kept (vec_id = component_id), one row for each input row.

    A vector that is null, zero, or that holds a null or a non-finite component links with nothing, nor does one with a null
    label or a null vec_id; their component is their vec_id and they are kept. Vectors of different widths do not link; each
    width is compared among its own. Rows that repeat a vec_id with the same label and vector are one vector in links. Rows
    of one vec_id with different vectors are different vectors, each with links of its own, but one node: what either
    reaches has one component. Labels may be of any type. Other columns are ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    v = F.col("embedding") if dict(vectors.dtypes).get("embedding") == "array<float>" else F.col("embedding").cast("array<double>")
    kind = "float" if dict(vectors.dtypes).get("embedding") == "array<float>" else "double"
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    # the key is null where the vector links with nothing
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v")).withColumn("key", F.when(sound, F.concat_ws(":", F.size("v"), "label")))
    rows = rows.select("vec_id", "key", F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(1)).alias("h2"), "v")
    names = ["key", "h", "h2"]
    light = scratch.cut(rows.select("vec_id", *names))
    members = scratch.cut(light.where("key is not null").distinct())
    n, whole = members.count(), light.count()
    lone = light.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return lone
    classes = scratch.cut(members.groupBy(*names).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    sizes = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # by their key, vectors of the commonest width are coded
    widths = sizes.groupBy(F.substring_index("key", ":", 1).cast("int").alias("width")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).orderBy(F.desc("n"), "width").first()
    large = sizes.where((F.col("n") > max(WHOLE, n // MOST_LABELS)) & F.col("key").startswith(f"{widths['width']}:")).select("key", F.lit(True).alias("many"))
    fitting = rows.where(F.col("key").startswith(f"{widths['width']}:"))
    drawn = fitting.where(uniform("h", "h2", seed=4) < min(1.0, sample / widths["n"])).dropDuplicates(names).orderBy("h", "h2").select(F.col("v").cast("array<float>").alias("v")).toArrow()
    drawn = drawn if drawn.num_rows else fitting.limit(1).select("v").toArrow()
    shared = spark.sparkContext.broadcast(fit(units(drawn.column("v").combine_chunks())[1], widths["most"], least))

    reps = rows.where("key is not null").dropDuplicates(names).join(classes, names)
    reps = reps.join(F.broadcast(large), "key", "left").select("key", "h", "rep", "copies", F.coalesce("many", F.lit(False)).alias("many"), "v")
    coded = scratch.cut(reps.mapInArrow(tidy(_encode(shared)), f"key string, h long, rep long, copies long, many boolean, v array<{kind}>, at int, codes binary, error float, visits array<int>"))

    columns = ["key", "list", "h", "rep", "copies", "v", "at", "codes", "error"]
    stored = coded.withColumn("list", F.when(F.col("many"), F.col("at")).otherwise(-1))
    visitors = coded.where("size(visits) > 0").withColumn("list", F.explode("visits"))
    place = ["key", "list"]
    each = lambda c: F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(c)
    grid = stored.select(place).groupBy(*place).agg(each("high")).join(visitors.select(place).groupBy(*place).agg(each("wide")), place, "left")
    grid = scratch.cut(grid.withColumn("wide", F.coalesce("wide", F.lit(0))))  # one row for each list of each key
    mine = lambda c: F.pmod(F.xxhash64("rep", "h"), F.col(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), c - 1)
    task = lambda block, other, stored: F.struct(block.alias("block"), other.alias("other"), F.lit(stored).alias("stored"))
    here = F.col("here")
    # members meet visitors, block by block, each other inside their block (other 0), and other blocks (other below 0)
    tasks = F.concat(
        F.transform(upto(F.greatest(F.col("wide"), F.lit(1))), lambda j: task(here, j, True)),
        F.transform(F.filter(upto(F.col("high")), lambda k: k > here), lambda k: task(here, -1 - k, True)),
        F.transform(F.filter(upto(F.col("high")), lambda k: k < here), lambda k: task(k, -1 - here, False)),
    )
    left = stored.join(grid, place).withColumn("here", mine("high")).withColumn("task", F.explode(tasks))
    right = visitors.join(grid, place).withColumn("here", mine("wide")).withColumn("task", F.explode(F.transform(upto(F.col("high")), lambda i: task(i, here, False))))
    key = [*place, "block", "other"]
    dealt = left.select(*columns, "task.*").unionByName(right.select(*columns, "task.*"))
    found = scratch.cut(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(tidy(_search(shared, least)), FOUND))

    edges = found.where("b is not null").select("a", "b")
    several = scratch.cut(members.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    if several.limit(1).count():  # vec_ids of several vectors
        held = members.join(several, "vec_id").join(classes.select(*names, "rep"), names).select("vec_id", "rep")
        edges = edges.unionByName(held.join(held.groupBy("vec_id").agg(F.min("rep").alias("b")), "vec_id").select(F.col("rep").alias("a"), "b"))
    comps = components(edges, scratch).select(F.col("node").alias("rep"), "component")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep"), "h").agg(F.sum("links").alias("links"))
    told = classes.join(counts, ["rep", "h"], "left").join(comps, "rep", "left").select(*names, "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = join_by_key(members, told, names, "copies", n).drop("copies")
    if whole != n:  # rows that repeat, or link with nothing
        out = light.where("key is not null").join(out, ["vec_id", *names])
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept")).unionByName(lone)

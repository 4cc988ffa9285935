"""Near-duplicate vectors by a PCA-ordered tiled comparison.

Vectors are scaled to length one and turned onto the principal axes of the whole table (second moments about the origin, so that
products stay what they are). Tiles hold about ``TILE`` vectors that lie together: a tree fitted to a bounded sample cuts
the space at medians of the axes along which it spreads most; every vector is dealt by it, and a cell of more than a
tile is dealt on by a hash. A tile carries its box on the leading axes and the range of the norms of what is left.

Two tiles meet unless their boxes are farther apart than two vectors at the threshold can be. Within a pair of tiles
the leading axes are multiplied first, with the norm of the rest as one more axis, which gives an upper bound of every
cosine at once. What can still reach the threshold goes on to twice as many axes, and so on; the last step is the exact
product. Products within 1e-9 of the threshold are worked out once more from the vectors as they came.

Equal vectors are one class, named by its smallest id. A pair of tiles gives the links of each class in number, and its links as a
spanning forest, never as pairs; components are found over the forests by star contraction.

Cases. Vectors that are null, empty, zero or hold a null or non-finite component link with nothing: no links, a
component of their own. Vectors of different dimensions never link. Null ids are members of their class without naming it; a
class without any id has the null component, and a null id is never ``kept``. Repeated rows are vectors of their own. An empty table gives an empty result.

What grows: pairs of tiles with the square of the tiles where nothing can be told apart by boxes (vectors spread evenly over a
sphere of many dimensions), each pair being one product of ``TILE`` rows on the leading axes. Nothing else does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verdigris.llm.simhash import _roots
from verdigris.llm.workers import claim
from verdigris.operators.graph import connected_components
from verdigris.storage import materialise

#: Vectors of a tile, about; rows of a tile multiplied at once; links looked at together.
TILE, ROWS, CHUNK = 4096, 1024, 2_000_000
#: Vectors to which the tree is fitted, and its cells, at most.
SAMPLE, CELLS = 65_536, 4096
#: Axes of a tile's box.
BOX = 8
#: Products nearer to the threshold than this are worked out again; what rounding can add to a bound in single precision.
NEAR, SLACK = 1e-9, 1e-5


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / largest
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def classes_of(rows: DataFrame) -> DataFrame:
    """(vector, n, rep): distinct usable vectors of a table of (id, vector), how many rows have each, the smallest id."""
    finite = F.forall("vector", lambda x: F.coalesce(x.cast("double") * 0 == 0, F.lit(False))) & F.exists("vector", lambda x: x != 0)
    return rows.where(finite).groupBy("vector").agg(F.count("*").alias("n"), F.min("id").alias("rep"))


def principal_axes(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension: (axes as columns, largest first; mean squares along them). A task sends d rows of sums a dimension."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            length = batch.column("vector").value_lengths().to_numpy()
            for d in np.unique(length):
                x = _unit(_matrix(batch.column("vector").filter(pa.array(length == d))))
                held[int(d)] = held.get(int(d), 0) + x.T @ x
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(m.ravel())], ["d", "i", "s"])

    found: dict[int, list] = {}
    for r in classes.mapInArrow(moments, "d int, i int, s double").groupBy("d", "i").agg(F.sum("s").alias("s")).collect():  # d * d rows a dimension
        found.setdefault(r["d"], []).append((r["i"], r["s"]))
    out = {}
    for d, cells in found.items():
        m = np.zeros(d * d)
        for i, s in cells:
            m[i] = s
        values, axes = np.linalg.eigh(m.reshape(d, d))
        out[d] = (axes[:, ::-1].copy(), np.maximum(values[::-1], 0) / max(np.trace(m.reshape(d, d)), 1e-300))
    return out


def leading(spectrum: np.ndarray, threshold: float) -> list[int]:
    """How many axes each step multiplies: first as many as leave three deviations between a common product's bound and
    the threshold (half of all, if none do), then twice as many each time, last all."""
    d = len(spectrum)
    rest = 1 - np.cumsum(spectrum)
    wide = 3 * np.sqrt(np.cumsum(spectrum**2))
    enough = np.flatnonzero(threshold - rest >= wide)
    first = min(d, 8 * -(-(int(enough[0]) + 1 if len(enough) else d // 2 + 1) // 8))
    steps = [first]
    while steps[-1] < d:
        steps.append(min(d, 2 * steps[-1]))
    return steps


def fit_tree(x: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, cut, next below or -1 - cell, next above or -1 - cell) that cut a sample at medians of its widest axis."""
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(rows: np.ndarray, wanted: int) -> int:
        nonlocal count
        spread = rows.std(axis=0) if len(rows) > 1 else np.zeros(1)
        axis = int(spread.argmax())
        cut = float(np.median(rows[:, axis])) if len(rows) > 1 else 0.0
        low = rows[:, axis] < cut if len(rows) > 1 else np.zeros(0, bool)
        if wanted < 2 or not low.any() or low.all():
            count += 1
            return -count
        at = len(nodes)
        nodes.append((0, 0.0, 0, 0))
        nodes[at] = (axis, cut, grow(rows[low], wanted // 2), grow(rows[~low], wanted - wanted // 2))
        return at

    grow(x, cells)
    return nodes


def cell_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The cell of each row, from 0."""
    out = np.zeros(len(x), np.int32)
    stack = [(0, np.arange(len(x)))] if nodes else []
    while stack:
        at, rows = stack.pop()
        axis, cut, low, high = nodes[at]
        below = x[rows, axis] < cut
        for to, some in ((low, rows[below]), (high, rows[~below])):
            if to < 0:
                out[some] = -1 - to
            elif len(some):
                stack.append((to, some))
    return out


def tiles(classes: DataFrame, axes: dict, threshold: float, rows: int = TILE) -> DataFrame:
    """One row a tile: d, cell, part, size, low, high (its box: leading axes and the norm of the rest), reps, ns, vectors (doubles, row by row)."""
    spark = classes.sparkSession
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row a dimension
    trees = {}
    for d, n in sizes.items():
        share = min(1.0, 2 * SAMPLE / n)
        some = classes.where((F.size("vector") == d) & (F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("vector").limit(SAMPLE)
        x = _unit(_matrix(some.toArrow()["vector"])) @ axes[d][0][:, :BOX]
        trees[d] = fit_tree(x, min(CELLS, -(-n // rows)))
    told = spark.sparkContext.broadcast((trees, {d: a for d, (a, _) in axes.items()}))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, turn = told.value
        for batch in batches:
            length = batch.column("vector").value_lengths().to_numpy()
            cell = np.zeros(len(batch), np.int32)
            for d in np.unique(length):
                own = np.flatnonzero(length == d)
                cell[own] = cell_of(_unit(_matrix(batch.column("vector").take(pa.array(own)))) @ turn[int(d)][:, :BOX], trees[int(d)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length, pa.int32()), pa.array(cell)], [*batch.schema.names, "d", "cell"])

    vector = classes.schema["vector"].dataType.simpleString()
    placed = materialise(classes.mapInArrow(dealt, f"vector {vector}, n long, rep long, d int, cell int"), "placed")
    counts = placed.groupBy("d", "cell").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("vector"), F.ceil(F.col("size") / rows)).cast("int")
    parted = placed.join(F.broadcast(counts), ["d", "cell"]).withColumn("part", part)  # at most CELLS rows a dimension

    def pack(table: pa.Table) -> pa.Table:
        x = _matrix(table["vector"])
        turned = _unit(x) @ told.value[1][x.shape[1]]
        box = np.c_[turned[:, :BOX], np.sqrt(np.maximum(0, (turned[:, BOX:] ** 2).sum(axis=1)))]
        return pa.table({
            "d": pa.array([x.shape[1]], pa.int32()), "cell": table["cell"][:1], "part": table["part"][:1], "size": pa.array([len(x)], pa.int64()),
            "low": [box.min(axis=0).tolist()], "high": [box.max(axis=0).tolist()], "reps": [table["rep"].to_pylist()], "ns": [table["n"].to_pylist()], "vectors": [x.tobytes()],
        })

    schema = "d int, cell int, part int, size long, low array<double>, high array<double>, reps array<long>, ns array<long>, vectors binary"
    return parted.select("d", "cell", "part", "vector", "n", "rep").groupBy("d", "cell", "part").applyInArrow(pack, schema)


def tile_pairs(boxes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): tiles that can hold a link. Tiles meet in slabs of the first axis as wide as the reach of a link."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    slab = lambda c, i: F.floor(F.get(c, F.lit(i)) / F.lit(reach))
    own = boxes.select("d", "tile", "low", "high", F.explode(F.sequence(slab("low", 0), slab("high", 0))).alias("slab"))
    near = boxes.select(F.col("d"), F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(slab("low", 0) - 1, slab("high", 0) + 1)).alias("slab"))
    gaps = F.zip_with(F.zip_with("low", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    return own.join(near, ["d", "slab"]).where((F.col("tile") <= F.col("b")) & (apart <= reach * reach)).select(F.col("tile").alias("a"), "b").distinct()


def _met(steps: dict[int, list[int]], turn: dict[int, np.ndarray], threshold: float):
    def links(x: np.ndarray, y: np.ndarray, same: bool, cuts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of x, row of y) with a cosine of at least the threshold, each once; of a tile with itself those with row < row."""
        axes = turn[x.shape[1]]
        p, q = _unit(x) @ axes, _unit(y) @ axes
        rest = [[np.sqrt(np.maximum(0, (z[:, m:] ** 2).sum(axis=1))) for m in cuts] for z in (p, q)]
        first = [np.c_[z[:, : cuts[0]], r[0]].astype(np.float32) for z, r in zip((p, q), rest)]
        for at in range(0, len(x), ROWS):
            bound = first[0][at : at + ROWS] @ first[1].T
            i, j = np.nonzero(bound >= threshold - SLACK)
            i += at
            if same:
                i, j = i[i < j], j[i < j]
            for lo in range(0, len(i), CHUNK):
                a, b = i[lo : lo + CHUNK], j[lo : lo + CHUNK]
                dot, done = np.zeros(len(a)), 0
                for k, m in enumerate(cuts):
                    for c in range(0, len(a), 65_536):
                        dot[c : c + 65_536] += np.einsum("ij,ij->i", p[a[c : c + 65_536], done:m], q[b[c : c + 65_536], done:m])
                    keep = dot + rest[0][k][a] * rest[1][k][b] >= threshold - NEAR
                    a, b, dot, done = a[keep], b[keep], dot[keep], m
                close = np.flatnonzero(dot < threshold + NEAR)
                if len(close):
                    u, v = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x[a[close]], y[b[close]]))
                    dot[close] = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
                yield a[dot >= threshold], b[dot >= threshold]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("vectors")
        for batch in batches:
            for r in range(len(batch)):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                d = row["d"].as_py()
                x, y = (np.frombuffer(row[c].as_buffer(), np.float64).reshape(-1, d) for c in ("vectors", "vectors_b"))
                same = row["a"].as_py() == row["b"].as_py()
                rep, n = (np.concatenate([row[c].values.to_numpy(), row[f"{c}_b"].values.to_numpy()]) for c in ("reps", "ns"))
                shift = 0 if same else len(x)
                linked = np.zeros(len(rep), np.int64)

                def counted():
                    for i, j in links(x, y, same, steps[d]):
                        np.add.at(linked, i, n[j + shift])
                        np.add.at(linked, j + shift, n[i])
                        yield i, j + shift

                root = _roots(len(rep), counted())
                some = np.flatnonzero(linked > 0)
                yield pa.RecordBatch.from_pydict({"rep": rep[some], "linked": linked[some], "root": rep[root[some]]})

    return met


def near_duplicate_vectors(rows: DataFrame, threshold: float = 0.95, id: str = "vec_id", vector: str = "embedding", tile: int = TILE) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept, as the module says."""
    given = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    classes = materialise(classes_of(given), "classes")
    # what has no id links too: it stands under a name below all ids and gets its component's smallest id
    named = classes.withColumn("rep", F.coalesce("rep", -1 - F.pmod(F.xxhash64("vector"), F.lit(1 << 62)) - (1 << 61)))
    axes = principal_axes(classes)
    packed = materialise(tiles(named, axes, threshold, tile).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    pairs = materialise(tile_pairs(packed.select("d", "tile", "low", "high"), threshold), "pairs")
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, min(20_000, -(-pairs.count() // 4)))
    # the later tile's side is dealt by pairs, so that as many tasks as pairs can work
    first = pairs.join(packed.select(F.col("tile").alias("a"), "d", "reps", "ns", "vectors"), "a")
    second = packed.select(F.col("tile").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("reps", "ns", "vectors")))
    both = first.repartition(tasks, "b").join(second.repartition(tasks, "b"), "b")
    work = _met({d: leading(s, threshold) for d, (_, s) in axes.items()}, {d: a for d, (a, _) in axes.items()}, threshold)
    found = materialise(both.select("a", "b", "d", "reps", "ns", "vectors", "reps_b", "ns_b", "vectors_b").mapInArrow(work, "rep long, linked long, root long"), "found")
    joined = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    return _named(given, named, found, joined)


def _named(given: DataFrame, named: DataFrame, found: DataFrame, joined: DataFrame) -> DataFrame:
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    component = joined.select(F.col("node").alias("rep"), "component")
    told = named.join(linked, "rep", "left").join(component, "rep", "left").select("vector", "n", "rep", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "rep").alias("component"))
    smallest = told.where("rep >= -(1L << 61)").groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = told.join(smallest, "component", "left").select("vector", "n", "linked", "component_id")
    usable = F.forall("vector", lambda x: F.coalesce(x.cast("double") * 0 == 0, F.lit(False))) & F.exists("vector", lambda x: x != 0)
    marked = given.withColumn("usable", F.coalesce(usable, F.lit(False)))
    out = marked.where("usable").join(classes, "vector").select("id", (F.col("n") - 1 + F.col("linked")).alias("n_links"), "component_id")
    alone = marked.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionAll(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

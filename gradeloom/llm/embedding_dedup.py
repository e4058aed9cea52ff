"""Near-duplicate vectors by product quantisation.

Unit vectors are put into coarse lists, those of the nearest of up to
``MAX_LISTS`` centroids, and the residual is coded in ``SUBSPACES`` bytes by one
codebook per subspace. A vector searches its own list and every list that can
hold one of its partners: a partner lies within the distance that the cosine
allows, so it can be in another list only if the border of the two is that close.
Distances come from a table per search and list; they are off by the length of
the stored vector's quantisation error at most, which is kept, so the filter
passes every partner. What passes is compared by the cosine of the full vectors.
Centroids and codebooks are fitted on a bounded sample and only decide how much
work there is, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import stored
from gradeloom.llm.graph import components

#: Bounds of the fit, of what is broadcast and of one group in a task.
SAMPLE, MAX_LISTS, SUBSPACES, CODES, GROUP = 8192, 1024, 8, 256, 1500


@dataclass
class Quantiser:
    centroids: np.ndarray
    cuts: np.ndarray
    codebooks: list[np.ndarray]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids."""
        return np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1), 0)

    def code(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the lengths of the errors."""
        codes, error = np.empty((len(residual), len(self.codebooks)), dtype=np.uint8), np.zeros(len(residual))
        for s, book in enumerate(self.codebooks):
            part = residual[:, self.cuts[s] : self.cuts[s + 1]]
            d = _squared(part, book)
            codes[:, s] = d.argmin(1)
            error += np.maximum(d.min(1), 0)
        return codes, np.sqrt(error)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)


def _means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from a random start."""
    k = min(k, len(x))
    centres = x[np.random.RandomState(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _squared(x, centres).argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def fit(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES) -> Quantiser:
    """A quantiser fitted on unit vectors, at least one."""
    centroids = _means(sample, lists, seed=1)
    residual = sample - centroids[_squared(sample, centroids).argmin(1)]
    cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    return Quantiser(centroids, cuts, [_means(residual[:, a:b], CODES, seed=2) for a, b in zip(cuts[:-1], cuts[1:])])


def _units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a column, unit length, zeros behind short ones; and their sizes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True)), sizes


def _assign(batches: Iterator[pa.RecordBatch], quantiser: Quantiser, width: int, radius: float) -> Iterator[pa.RecordBatch]:
    gaps = np.sqrt(np.maximum(_squared(quantiser.centroids, quantiser.centroids), 1e-30))
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            x, _ = _units(batch.column(batch.schema.get_field_index("embedding")), width)
            d = quantiser.nearest(x)
            own = d.argmin(1)
            to_border = (d - d[np.arange(len(x)), own][:, None]) / (2 * gaps[own])
            # Each pair of lists is searched from the one with the smaller number.
            probes = (to_border <= radius + 1e-9) & (np.arange(d.shape[1]) > own[:, None])
            probes[np.arange(len(x)), own] = True
            codes, error = quantiser.code(x - quantiser.centroids[own])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(probes.sum(1)))).astype(np.int32)), pa.array(np.nonzero(probes)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                                             names=[*batch.schema.names, "list", "probes", "code", "error"])


def _search(table: pa.Table, quantiser: Quantiser, width: int, cosine: float, radius: float) -> pa.Table:
    stored_side = table.filter(pa.compute.equal(table["side"], 0))
    searching = table.filter(pa.compute.equal(table["side"], 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(stored_side) and len(searching):
        y, _ = _units(stored_side["embedding"], width)
        x, _ = _units(searching["embedding"], width)
        y_id, x_id = stored_side["rep"].to_numpy(), searching["rep"].to_numpy()
        same = searching["list"].to_numpy() == searching["cell"].to_numpy()
        codes = np.frombuffer(b"".join(stored_side["code"].to_pylist()), dtype=np.uint8).reshape(len(y), -1)
        bound = (radius + 1e-6 + stored_side["error"].to_numpy()) ** 2
        residual = x - quantiser.centroids[searching["cell"][0].as_py()]
        for a in range(0, len(x), 128):
            part = residual[a : a + 128]
            distance = np.zeros((len(part), len(y)))
            for s, book in enumerate(quantiser.codebooks):
                tables = _squared(part[:, quantiser.cuts[s] : quantiser.cuts[s + 1]], book)
                distance += tables[:, codes[:, s]]
            i, j = np.nonzero(distance <= bound)
            i += a
            # In its own list a pair is looked at from the smaller id.
            keep = ~same[i] | (x_id[i] < y_id[j])
            i, j = i[keep], j[keep]
            close = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
            found.append((x_id[i[close]], y_id[j[close]]))
    a, b = (np.concatenate(v) if found else np.zeros(0, dtype=np.int64) for v in (zip(*found) if found else ((), ())))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_vectors(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of one label with at least the given cosine.

    Returns one row per input row: ``vec_id``, ``n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable) and ``kept`` (it is this
    row's). A vector that is null, empty, zero or has a null or non-finite
    component, or a null label or id, is linked with nothing and kept. Vectors of
    different lengths are not compared. Equal vectors fold into one first, and
    are linked, whatever rounding says of their cosine. Rows with one id are
    counted each. An empty table gives an empty one; other columns are not read.
    """
    spark = rows.sparkSession
    kind = rows.schema[vector_col].dataType.elementType.simpleString()
    v = F.col("embedding")
    source = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"), F.col(label_col).alias("label"))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0)
              & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    marked = source.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = marked.where("usable")
    classes = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "vectors")
    of_row = good.select("vec_id", "label", "embedding").join(classes, ["label", "embedding"]).select("vec_id", "rep", "size")
    alone = marked.where("NOT usable").select("vec_id")

    largest = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).agg(F.max("n"), F.max("width")).first()
    if largest[0] is None:
        return alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width, radius = int(largest[1]), float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    # By a sample of bounded size: it shapes the lists and codes, every vector is indexed.
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow()["embedding"]
    quantiser = fit(_units(sample, width)[0], int(np.clip(-(-largest[0] // 1000), 1, MAX_LISTS)))

    schema = f"rep long, label {classes.schema['label'].dataType.simpleString()}, width int, embedding array<{kind}>, list int, probes array<int>, code binary, error double"
    index = stored(classes.select("rep", "label", F.size("embedding").alias("width"), "embedding")
                   .mapInArrow(partial(_assign, quantiser=quantiser, width=width, radius=radius), schema), "index")
    cell = ["label", "width", "cell"]
    stored_side = index.withColumn("cell", F.col("list"))
    searching = index.withColumn("cell", F.explode("probes"))
    # A long list is cut, and every part of it meets every part of what searches it.
    parts = (stored_side.groupBy(*cell).agg(F.count("*").alias("n"))
             .join(searching.groupBy(*cell).agg(F.count("*").alias("m")), cell)
             .select(*cell, F.ceil(F.col("n") / GROUP).alias("rows"), F.ceil(F.col("m") / GROUP).alias("columns")))
    columns = [*cell, "i", "j", "side", "rep", "list", "embedding", "code", "error"]
    left = (stored_side.join(parts, cell).withColumn("i", F.pmod(F.xxhash64("rep"), "rows"))
            .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1))).withColumn("side", F.lit(0)).select(*columns))
    right = (searching.join(parts, cell).withColumn("j", F.pmod(F.xxhash64("rep"), "columns"))
             .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("side", F.lit(1)).select(*columns))

    def search(table: pa.Table) -> pa.Table:
        return _search(table, quantiser, width, cosine, radius)

    links = stored(left.unionByName(right).groupBy(*cell, "i", "j").applyInArrow(search, "a long, b long").distinct(), "vector-links")
    sizes = classes.select("rep", "size")
    both = links.union(links.select("b", "a"))
    linked = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("others"))
    parts_of = components(links).withColumnRenamed("node", "rep")
    out = (of_row.join(linked, "rep", "left").join(parts_of, "rep", "left")
           .select("vec_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = out.union(alone.select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

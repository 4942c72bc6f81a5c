"""Near-duplicate vectors by Euclidean p-stable hashing, checked by exact cosine.

Normalised vectors with a cosine of at least `least` lie within sqrt(2 - 2 least) of each other. A table's hash
concatenates projections on Gaussian directions, shifted and quantised to WIDTH; a vector is filed in one bucket of
each table. How many projections follows from the number of vectors (about CANDIDATES others by chance in a bucket),
and how many tables from the chance that a pair just at the threshold shares no bucket, at most MISS.

Buckets get no vectors, only slim rows: table, code, class and a sketch, the vector turned at random and rounded to
four bits a coordinate. Two of a bucket are candidates if the cosine of their sketches, with SLACK times what rounding
does to it, reaches the threshold; a task emits a forest of them, not the pairs. Candidates' connected components then
get each vector once, and all pairs within a component are checked by their exact cosine in double precision, large
components in blocks; a component of more than LARGE classes is checked within its buckets, each pair in the first
table that has it. A task emits each vector's links counted and a forest of them.

Equal vectors (by 128 bits of hashes) are one class from the start. Pairs below the threshold are never linked; a
pair at it is missed with a chance of MISS, and nearer ones with much less: all of a smaller chance as the cosine
grows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
each is its own component; vectors of different lengths never link; repeated rows are equal vectors and count as
links of each other; a row without an id links like any other and has a null component; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import drop_written, hot_join, written
from .components import components
from .grouped import blocked, stars, whole_groups

#: Width of a quantisation step, vectors that share a bucket by chance, and the chance of a miss at the threshold.
WIDTH, CANDIDATES, MISS = 2.0, 1024, 0.003
#: Projections of a table at least and at most.
PROJECTIONS = (4, 24)
#: Standard deviations of the rounding error by which candidates may seem to be below the threshold.
SLACK = 5.0
#: Rows of a bucket's block; classes of a component up to which all its pairs are checked.
BUCKET_ROWS, LARGE = 8192, 100_000
SEED = 20240101


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that two points at a distance fall into one step of a projection."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, least: float) -> tuple[int, int]:
    """Projections a table and tables for n vectors; unrelated ones are taken to be orthogonal."""
    far = collision(math.sqrt(2))
    k = round(math.log(max(1.0, n / CANDIDATES)) / -math.log(far))
    k = min(max(k, PROJECTIONS[0]), PROJECTIONS[1])
    near = collision(math.sqrt(max(0.0, 2 - 2 * least))) ** k
    return k, max(1, math.ceil(math.log(MISS) / math.log(1 - near))) if near < 1 else 1


class Hasher:
    """Bucket codes of unit vectors, one 32-bit integer a table, and their sketches."""

    def __init__(self, dims: int, projections: int, tables: int):
        draw = np.random.default_rng([SEED, dims])
        self.directions = draw.standard_normal((dims, projections * tables))
        self.shifts = draw.uniform(0, WIDTH, projections * tables)
        self.mix = draw.integers(1, 1 << 62, projections, dtype=np.int64) | 1
        self.form = (tables, projections)
        self.turn = np.linalg.qr(draw.standard_normal((dims, dims)))[0]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        steps = np.floor((unit @ self.directions + self.shifts) / WIDTH).astype(np.int64).reshape(len(unit), *self.form)
        mixed = (steps * self.mix).sum(2)
        return ((mixed ^ (mixed >> 31)) & 0x7FFFFFFF).astype(np.int32)

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        """A row of bytes for each vector: the size of a rounding step, then two coordinates, from -7 to 7, a byte."""
        turned = unit @ self.turn
        step = (np.abs(turned).max(1) / 7).astype("<f4")
        steps = np.rint(turned / step[:, None]).astype(np.int8) + 8
        steps = np.pad(steps, ((0, 0), (0, len(self.turn) % 2)), constant_values=8).astype(np.uint8)
        return np.concatenate([step.view(np.uint8).reshape(-1, 4), steps[:, ::2] << 4 | steps[:, 1::2]], 1)


def unpacked(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded vectors, and the sizes of their rounding steps."""
    step = np.ascontiguousarray(sketches[:, :4]).view("<f4")
    packed = sketches[:, 4:]
    steps = np.stack([packed >> 4, packed & 15], 2).reshape(len(sketches), -1).astype(np.float32) - 8
    return steps * step, step[:, 0]


_hashers: dict[tuple[int, int, int], Hasher] = {}


def hasher(dims: int, projections: int, tables: int) -> Hasher:
    if (dims, projections, tables) not in _hashers:
        _hashers[dims, projections, tables] = Hasher(dims, projections, tables)
    return _hashers[dims, projections, tables]


def _unit(vecs: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Unit vectors of some rows of equal length, in double precision."""
    ends = vecs.offsets.to_numpy()
    raw = vecs.values.to_numpy()[ends[rows][:, None] + np.arange(ends[rows[0] + 1] - ends[rows[0]])].astype(np.float64)
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _same_length(vecs: pa.Array, most: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """Dimensions, and rows of vectors that have them, at most `most` at a time."""
    dims = np.diff(vecs.offsets.to_numpy())
    for d in np.unique(dims):
        which = np.flatnonzero(dims == d)
        for start in range(0, len(which), most):
            yield int(d), which[start : start + most]


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec and two hashes of it, null where the vector isn't usable."""
    kind = "float" if isinstance(vectors.schema[vec_col].dataType.elementType, FloatType) else "double"
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    usable = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < math.inf)) & F.exists("vec", lambda x: x != 0)
    return slim.withColumns({"h1": F.when(usable, F.xxhash64("vec")), "h2": F.when(usable, F.xxhash64(F.lit(SEED), "vec"))})


def classes_of(rows: DataFrame) -> DataFrame:
    """cls (a number), h1, h2, rep (least id), n (rows), dims and vec of each distinct usable vector."""
    found = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    return found.select(F.monotonically_increasing_id().alias("cls"), "*", F.size("vec").alias("dims"))


def filed(classes: DataFrame, k: int, tables: int) -> DataFrame:
    """A slim row for each class and table: dims, tab, code, cls and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            for d, rows in _same_length(batch.column("vec")):
                unit, form = _unit(batch.column("vec"), rows), hasher(d, k, tables)
                each = np.repeat(np.arange(len(rows)), tables)
                columns = [np.full(len(each), d, np.int32), np.tile(np.arange(tables, dtype=np.int32), len(rows)), form.codes(unit).ravel(), cls[rows[each]]]
                sketch = pa.array([s.tobytes() for s in form.sketches(unit)], pa.binary()).take(pa.array(each))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), sketch], names=["dims", "tab", "code", "cls", "sketch"])

    return classes.select("cls", "vec").mapInArrow(run, "dims int, tab int, code int, cls long, sketch binary")


def candidates(buckets: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) that have the components of all pairs of classes of a bucket whose sketches are near enough."""
    rounding = SLACK / math.sqrt(12)
    dealt = blocked(buckets, ["dims", "tab", "code"], F.col("cls"), BUCKET_ROWS, "embedding-buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["dims", "tab", "code", "lo", "hi"]):
            cls, block, sketch = table.column("cls").to_numpy(), table.column("block").to_numpy(), table.column("sketch")
            apart = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in np.flatnonzero(np.diff(at) > 1):
                a, b = int(at[g]), int(at[g + 1])
                rounded, step = unpacked(np.frombuffer(b"".join(sketch.slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1))
                enough = least - rounding * np.sqrt(step * step + step.max() ** 2)
                size = max(1, (1 << 20) // (b - a))
                for i in range(a, b, size):
                    some = slice(i - a, min(i + size, b) - a)
                    left, right = np.nonzero(rounded[some] @ rounded[i - a :].T >= enough[some, None])
                    ok = left < right
                    if apart[a]:
                        ok &= block[i + left] != block[i + right]
                    if ok.any():
                        x, y = stars(cls[i + left[ok]], cls[i + right[ok]])
                        u.append(x)
                        v.append(y)
            u, v = np.concatenate(u), np.concatenate(v)
            if len(u):
                u, v = stars(u, v)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def bucket_links(members: DataFrame, least: float, k: int, tables: int) -> DataFrame:
    """Rows of two kinds for members (root, tab, code, cls, n, vec): (cls, links), counted once a pair, and edges (cls, root).

    Members of a component with tab -1 are compared with each other, those of a table within their bucket.
    """
    keys = ["root", "tab", "code"]
    dealt = blocked(members, keys, F.col("cls"), label="embedding-components")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, [*keys, "lo", "hi"]):
            column = {c: table.column(c).to_numpy() for c in ("tab", "lo", "hi", "block", "cls", "n")}
            vecs = table.column("vec").combine_chunks()
            classes, counts, left, right = [], [], [], []
            for g in np.flatnonzero(np.diff(at) > 1):
                a, b = int(at[g]), int(at[g + 1])
                unit, tab = _unit(vecs, np.arange(a, b)), int(column["tab"][a])
                if column["lo"][a] == column["hi"][a]:
                    i, j = np.nonzero(np.triu(unit @ unit.T >= least, 1))
                else:
                    low = np.flatnonzero(column["block"][a:b] == column["lo"][a])
                    high = np.flatnonzero(column["block"][a:b] != column["lo"][a])
                    i, j = np.nonzero(unit[low] @ unit[high].T >= least)
                    i, j = low[i], high[j]
                if tab > 0 and len(i):
                    codes = hasher(unit.shape[1], k, tables).codes(unit)[:, :tab]
                    first = np.concatenate([~(codes[i[x : x + 65536]] == codes[j[x : x + 65536]]).any(1) for x in range(0, len(i), 65536)])
                    i, j = i[first], j[first]
                if not len(i):
                    continue
                n, cls = column["n"][a:b], column["cls"][a:b]
                total = np.bincount(i, n[j], b - a) + np.bincount(j, n[i], b - a)
                linked = np.flatnonzero(total)
                classes.append(cls[linked])
                counts.append(total[linked].astype(np.int64))
                left.append(cls[i])
                right.append(cls[j])
            if classes:
                u, v = stars(np.concatenate(left), np.concatenate(right))
                classes, counts = np.concatenate(classes), np.concatenate(counts)
                none = pa.nulls(len(classes), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(counts), none], names=["cls", "links", "root"])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()), pa.array(v)], names=["cls", "links", "root"])

    return dealt.mapInArrow(run, "cls long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least id reachable) and kept of each vector."""
    rows = _rows(vectors, id_col, vec_col)
    classes = written(classes_of(rows), "embedding-classes")
    k, tables = shape(classes.count(), least)
    buckets = filed(classes, k, tables)
    grouped = components(candidates(buckets, least), "embedding-candidates")
    joined = classes.select("cls", "n", "vec").join(grouped, F.col("cls") == F.col("node")).select("root", "cls", "n", "vec")
    sizes = written(grouped.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > LARGE).select("root"), "embedding-large")
    members = joined.select("root", F.lit(-1).alias("tab"), F.lit(0).alias("code"), "cls", "n", "vec")
    if not sizes.isEmpty():
        large = joined.join(sizes, "root", "left_semi")
        members = members.join(sizes, "root", "left_anti").union(large.join(buckets.select("cls", "tab", "code"), "cls").select("root", "tab", "code", "cls", "n", "vec"))
    found = written(bucket_links(members, least, k, tables), "embedding-links")
    rooted = components(found.where("root IS NOT NULL").select(F.col("cls").alias("u"), F.col("root").alias("v")), "embedding-components")
    counts = found.where("links IS NOT NULL").select("cls", "links", F.lit(None).cast("long").alias("root"))
    linked = counts.union(rooted.select("node", F.lit(None).cast("long"), "root")).groupBy("cls").agg(F.sum("links").alias("links"), F.max("root").alias("root"))
    linked_rows = written(classes.select("cls", "h1", "h2", "rep", "n").join(linked, "cls", "left").drop("cls"), "embedding-linked")
    least_ids = linked_rows.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("least_id"))
    known = written(linked_rows.join(least_ids, "root", "left").select("h1", "h2", "n", "links", F.coalesce("least_id", "rep").alias("least_id")), "embedding-known")
    for old in (classes, grouped, sizes, found, rooted, linked_rows):
        drop_written(old)
    usable = hot_join(rows.drop("vec").where("h1 IS NOT NULL"), known, ["h1", "h2"], "n", F.col("vec_id"))
    others = rows.where("h1 IS NULL").select("h1", "h2", "vec_id", *[F.lit(None).cast("long").alias(c) for c in ("n", "links", "least_id")])
    out = usable.unionByName(others).select(
        "vec_id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("least_id", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

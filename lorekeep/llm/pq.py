"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

A bounded sample trains the coarse centroids and the codebooks; every vector is indexed. Two unit
vectors of cosine ``c`` are ``d = sqrt(2 - 2c)`` apart, so a vector must visit exactly the lists whose
bisecting plane with its own list is within ``d``: probes are sufficient by proof, not by tuning. Table
look-ups give the distance to a code; a pair stays a candidate while that is at most ``d`` plus the
code's own error, which again loses nothing. Candidates are decided by the exact cosine.

Equal vectors of a label are one class with a count. Tasks return counts and a spanning forest, never
all pairs. Vectors with a null id, label or component, with a non-finite component, without components or of length
zero link with nothing; a vector links only with vectors of its dimension. A null id has a null component and is not kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.bitslice import spanning
from lorekeep.llm.common import checkpoint, parts_of, sample_of
from lorekeep.operators.graph import connected_components


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision, zero-padded to ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        out = flat.reshape(-1, width).copy()
    else:
        out = np.zeros((len(sizes), width))
        out[np.arange(width)[None, :] < sizes[:, None]] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # no overflow in the squares
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres**2).sum(axis=1) / 2
    for a in range(0, len(x), 2048):
        out[a : a + 2048] = (half - x[a : a + 2048] @ centres.T).argmin(axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=k)
        for j in np.flatnonzero(n):
            centres[j] = x[near == j].mean(axis=0)
    return centres


class Index:
    """Coarse centroids (lists, width) and codebooks (subspaces, codes, part)."""

    def __init__(self, coarse: np.ndarray, books: np.ndarray):
        self.coarse, self.books = coarse, books
        gaps = coarse[:, None, :] - coarse[None, :, :] if len(coarse) <= 256 else None
        self.gap = np.sqrt((gaps**2).sum(axis=2)) if gaps is not None else None

    @classmethod
    def train(cls, x: np.ndarray, lists: int, subspaces: int, codes: int) -> Index:
        rng = np.random.default_rng(5)
        coarse = _kmeans(x, max(1, min(lists, len(x) // 8)), 8, rng)
        rest = (x - coarse[_nearest(x, coarse)]).reshape(len(x), subspaces, -1)
        books = np.stack([_kmeans(rest[:, s], min(codes, len(x)), 6, rng) for s in range(subspaces)])
        return cls(coarse, books)

    def encode(self, x: np.ndarray):
        """Home list, codes and the code's error per row."""
        home = _nearest(x, self.coarse)
        rest = (x - self.coarse[home]).reshape(len(x), len(self.books), -1)
        codes = np.stack([_nearest(rest[:, s], self.books[s]) for s in range(len(self.books))], axis=1)
        coded = np.stack([self.books[s][codes[:, s]] for s in range(len(self.books))], axis=1)
        return home, codes.astype(np.uint8), np.sqrt(((rest - coded) ** 2).sum(axis=(1, 2)))

    def visits(self, x: np.ndarray, home: np.ndarray, reach: float):
        """(row, list) for the lists after its own that hold any vector within ``reach``."""
        rows, lists = [], []
        for a in range(0, len(x), 512):
            part, own = x[a : a + 512], home[a : a + 512]
            far = (self.coarse**2).sum(axis=1) - 2 * part @ self.coarse.T
            ahead = far - np.take_along_axis(far, own[:, None], axis=1)  # twice the gap times the distance to the plane
            gap = self.gap[own] if self.gap is not None else np.sqrt(
                np.maximum(0, ((self.coarse**2).sum(axis=1)[own][:, None] + (self.coarse**2).sum(axis=1)) - 2 * self.coarse[own] @ self.coarse.T)
            )
            near = (ahead <= 2 * gap * reach + 1e-9) & (np.arange(len(self.coarse)) > own[:, None])
            r, c = np.nonzero(near)
            rows.append(r + a)
            lists.append(c)
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(lists or [np.zeros(0, int)])

    def candidates(self, queries: np.ndarray, where: int, codes: np.ndarray, error: np.ndarray, reach: float) -> np.ndarray:
        """Boolean (queries, targets): table distance at most ``reach`` plus the target's error."""
        rest = (queries - self.coarse[where]).reshape(len(queries), len(self.books), -1)
        total = np.zeros((len(queries), len(codes)))
        for s, book in enumerate(self.books):
            table = ((rest[:, s, None, :] - book[None]) ** 2).sum(axis=2)
            total += table[:, codes[:, s]]
        return total <= (reach + error + 1e-9) ** 2


def near_vectors(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = 0.98,
    sample: int = 20_000,
    lists: int | None = None,
    subspaces: int = 8,
    codes: int = 64,
    tile: int = 8192,
) -> DataFrame:
    """key, n_links, component_id, kept for every row.

    ``sample`` bounds the training set; ``lists`` defaults to the square root of the number of distinct vectors, 1024 at most.
    ``tile`` bounds the targets that one task holds; larger lists are cut into tiles.
    """
    reach = math.sqrt(2 - 2 * cosine)
    base = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(label).alias("label"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("x", lambda v: v != 0)
    base = base.withColumn("fit", F.coalesce(fit, F.lit(False)))
    classes = checkpoint(
        base.where("fit").groupBy("label", "x").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    )
    # a class has a number of its own: one id may have several vectors
    classes = checkpoint(classes.withColumn("rep", F.monotonically_increasing_id()))
    about = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    rest = base.where("not fit").select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not about["n"]:
        return rest.withColumn("kept", F.col(key).isNotNull())
    width = -(-about["width"] // subspaces) * subspaces
    lists = lists or max(1, min(1024, math.isqrt(about["n"])))

    def train(batches):
        x = np.concatenate([matrix_of(b.column(0), width) for b in batches])
        index = Index.train(x, lists, subspaces, codes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([index.coarse.tobytes()]), pa.array([index.books.tobytes()])], ["coarse", "books"]
        )

    drawn = sample_of(classes.select("x", "least"), "least", sample).select("x").repartition(1)
    blob = drawn.mapInArrow(train, "coarse binary, books binary").first()
    trained = Index(
        np.frombuffer(blob["coarse"]).reshape(-1, width),
        np.frombuffer(blob["books"]).reshape(subspaces, -1, width // subspaces),
    )
    shared = vectors.sparkSession.sparkContext.broadcast((trained.coarse, trained.books))  # size set by the parameters

    def place(batches):
        index = Index(*shared.value)
        for b in batches:
            if not len(b):
                continue
            x = matrix_of(b.column(1), width)
            home, code, error = index.encode(x)
            row, there = index.visits(x, home, reach)
            every = np.concatenate((np.arange(len(x)), row))
            role = np.concatenate((np.zeros(len(x), np.int32), np.ones(len(row), np.int32)))
            cell = np.concatenate((home, there)).astype(np.int32)
            take = pa.array(every)
            packed = pa.array([code[i].tobytes() for i in every])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(cell), pa.array(role), packed, pa.array(error[every])],
                ["label", "x", "rep", "n", "cell", "role", "code", "error"],
            )

    schema = classes.select("label", "x", "rep", "n").schema
    schema = T.StructType([*schema.fields, *T.StructType.fromDDL("cell int, role int, code binary, error double").fields])
    placed = classes.select("label", "x", "rep", "n").mapInArrow(place, schema).withColumn("dim", F.size("x"))
    group = ["label", "dim", "cell"]
    sizes = placed.where("role = 0").groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = placed.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    # a member is a target in its tile and a query in the later tiles of its list; a visitor queries all tiles
    to = F.when(F.col("role") == 0, F.filter(every, lambda t: t >= F.col("own"))).otherwise(every)
    dealt = dealt.withColumn("tile", F.explode(to)).withColumn(
        "role", F.when((F.col("role") == 0) & (F.col("tile") == F.col("own")), 0).otherwise(1)
    )
    dealt = dealt.select("label", "dim", "cell", "tile", "role", "rep", "n", "x", "code", "error")
    dealt = dealt.repartition(parts_of(vectors), "label", "dim", "cell", "tile").sortWithinPartitions("label", "dim", "cell", "tile", "role")

    def compare(batches):
        index = Index(*shared.value)
        key, held = None, None

        def emit(ids, counts, links):
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            if len(ids) + len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((ids, a))), pa.array(np.concatenate((counts, np.zeros(len(a), np.int64)))), pa.array(np.concatenate((ids, b)))],
                    ["rep", "n_links", "other"],
                )

        def settle():
            if held and "x" in held:
                ids, root = held["ids"], held["root"]
                some = held["count"] > 0
                child = np.flatnonzero(root != np.arange(len(root)))
                yield from emit(ids[some], held["count"][some], np.stack((ids[child], ids[root[child]]), axis=1))

        def seal():
            """The targets of the tile are complete: link them among themselves."""
            x = np.concatenate(held.pop("parts_x"))
            held.update(x=x, ids=np.concatenate(held.pop("parts_i")), n=np.concatenate(held.pop("parts_n")), code=np.concatenate(held.pop("parts_c")), error=np.concatenate(held.pop("parts_e")))
            held.update(count=np.zeros(len(x), np.int64), root=np.arange(len(x)))
            for a in range(0, len(x), 256):
                i, j = np.nonzero(index.candidates(x[a : a + 256], key[2], held["code"][a:], held["error"][a:], reach))
                i, j = i + a, j + a
                i, j = i[i < j], j[i < j]
                link(i, j, x, held["ids"], held["n"], held["count"], True)

        def link(i, j, qx, qi, qn, qc, same):
            """Decide the pairs (query i, target j) exactly; counts on both sides, roots of the targets."""
            hits = []
            for s in range(0, len(i), 1 << 16):
                a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                good = np.einsum("ij,ij->i", qx[a], held["x"][b]) >= cosine
                a, b = a[good], b[good]
                np.add.at(qc, a, held["n"][b])
                np.add.at(held["count"], b, qn[a])
                hits.append((a, b))
            if same:
                held["root"] = _merge(held["root"], hits)
                return []
            low: dict[int, int] = {}
            for a, b in hits:
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                first = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
                heads = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
                # targets of one query belong together; the query hangs on its first target
                held["root"] = _merge(held["root"], [(b[heads], b)])
                for q, t in zip(a[first].tolist(), b[first].tolist(), strict=True):
                    if q in low:
                        held["root"] = _merge(held["root"], [(np.array([low[q]]), np.array([t]))])
                    else:
                        low[q] = t
            return [(int(qi[q]), int(held["ids"][t])) for q, t in low.items()]

        for batch in batches:
            label, dim, cell, tile_no, role = (batch.column(c).to_pylist() for c in range(5))
            marks = list(zip(label, dim, cell, tile_no, role, strict=True))
            starts = [k for k in range(len(marks)) if not k or marks[k] != marks[k - 1]]
            for a, z in zip(starts, [*starts[1:], len(marks)], strict=True):
                part = batch.slice(a, z - a)
                if marks[a][:4] != key:
                    if held and "x" not in held:
                        seal()
                    yield from settle()
                    key, held = marks[a][:4], {"parts_x": [], "parts_i": [], "parts_n": [], "parts_c": [], "parts_e": []}
                ids, n = part.column(5).to_numpy(), part.column(6).to_numpy()
                x = matrix_of(part.column(7), width)
                if marks[a][4] == 0:
                    code = np.frombuffer(b"".join(part.column(8).to_pylist()), np.uint8).reshape(-1, subspaces)
                    for name, value in (("x", x), ("i", ids), ("n", n), ("c", code), ("e", part.column(9).to_numpy())):
                        held[f"parts_{name}"].append(value)
                    continue
                if "x" not in held:
                    if not held["parts_x"]:
                        continue  # no member in this tile
                    seal()
                for s in range(0, len(x), 256):
                    q = slice(s, s + 256)
                    i, j = np.nonzero(index.candidates(x[q], key[2], held["code"], held["error"], reach))
                    counts = np.zeros(len(x[q]), np.int64)
                    made = link(i, j, x[q], ids[q], n[q], counts, False)
                    some = counts > 0
                    yield from emit(ids[q][some], counts[some], made)
        if held and "x" not in held and held["parts_x"]:
            seal()
        yield from settle()

    found = checkpoint(dealt.mapInArrow(compare, "rep long, n_links long, other long"))
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("linked"))
    edges = found.where("rep <> other").select(F.col("rep").alias("source"), F.col("other").alias("target"))
    roots = connected_components(classes.select(F.col("rep").alias("node")), edges)
    placed = classes.join(roots.withColumnRenamed("node", "rep"), "rep")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(counts, "rep", "left").join(least, "component")
    known = known.select("label", "x", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = base.where("fit").join(known, ["label", "x"]).select(F.col("id").alias(key), "n_links", "component_id")
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def _merge(root: np.ndarray, pieces) -> np.ndarray:
    """``root`` after the pairs in ``pieces`` were linked too."""
    if not any(len(a) for a, _ in pieces):
        return root
    own = np.arange(len(root))
    child = np.flatnonzero(root != own)
    return spanning(len(root), [(child, root[child]), *pieces])

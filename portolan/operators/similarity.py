"""The k most similar reference vectors for every query vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.operators.relational import top_by
from portolan.session import materialize, ship_code

BROADCAST_BYTES = 128 << 20  # each worker of an executor has its own copy
PRODUCT_BYTES = 32 << 20  # of similarities in single precision that a worker holds at once


def _unit(vectors: pa.Array) -> np.ndarray:
    """A list array without nulls as a matrix of unit rows; a vector without length stays zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten()
    if len(vectors) and len(flat) % len(vectors) or len(set(pc.list_value_length(vectors).to_pylist())) > 1 or flat.null_count:
        raise ValueError("vectors have different lengths or missing entries")
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _best(q: np.ndarray, x: np.ndarray, fast: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k best of x by (similarity falling, rank rising): chosen in single precision with a margin, settled in double."""
    s = q.astype(np.float32) @ fast.T
    k = min(k, x.shape[0])
    some = min(k + 16, x.shape[0])
    cand = np.argpartition(s, x.shape[0] - some, axis=1)[:, x.shape[0] - some :] if some < x.shape[0] else np.broadcast_to(np.arange(some), (len(q), some))
    near = np.take_along_axis(s, cand, 1)
    low = np.partition(near, some - k, axis=1)[:, some - k] - 1e-5  # the k-th best with a margin
    cand = np.take_along_axis(cand, np.argsort(rank[cand], axis=1, kind="stable"), 1)
    exact = np.einsum("qcd,qd->qc", x[cand], q)
    order = np.argsort(-np.round(exact, 9), axis=1, kind="stable")[:, :k]
    at, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(exact, order, 1)
    if some < x.shape[0]:
        for i in np.flatnonzero(near.min(1) >= low):  # what wasn't looked at could be as good: all that is within the margin
            c = np.flatnonzero(s[i] >= low[i])
            exact = x[c] @ q[i]
            best = np.lexsort((rank[c], -np.round(exact, 9)))[:k]
            at[i], sims[i] = c[best], exact[best]
    return at, sims


def _best_in_blocks(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``_best`` with ranks as x lies, by blocks of x, so that memory depends neither on the rows of x nor on a copy of it."""
    size = max(1024, PRODUCT_BYTES // (4 * max(1, len(q))))
    found = [(at + lo, sims) for lo in range(0, len(x), size) for block in [x[lo : lo + size]] for at, sims in [_best(q, block, block.astype(np.float32), np.arange(len(block)), k)]]
    at, sims = (np.concatenate(part, axis=1) for part in zip(*found))
    order = np.lexsort((at, -np.round(sims, 9)), axis=1)[:, :k]
    return np.take_along_axis(at, order, 1), np.take_along_axis(sims, order, 1)


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, g) with the dimension, whether the vector has all entries (m), a direction (fit) or one that isn't finite (odd), and its unit vector where it is fit."""
    for b in batches:
        v, n = b.column("v"), b.num_rows
        size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
        flat = v.flatten()
        x, at = flat.to_numpy(zero_copy_only=False).astype(np.float64), np.repeat(np.arange(n), np.maximum(size, 0))
        with np.errstate(all="ignore"):
            sq = np.bincount(at, x * x, n)
            m = (size >= 0) & (np.bincount(at, flat.is_null().to_numpy(zero_copy_only=False), n) == 0)
            odd = m & ~np.isfinite(sq)
            fit = m & ~odd & (sq > 0)
            u = (x / np.sqrt(sq)[at])[fit[at]]
        ends = np.concatenate([[0], np.cumsum(np.where(fit, size, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("g"), pa.array(size.astype(np.int32)), *map(pa.array, (m, fit, odd)), pa.ListArray.from_arrays(pa.array(ends), pa.array(u), mask=pa.array(~fit))], ["id", "g", "dim", "m", "fit", "odd", "u"])


def cosine_sums(df: DataFrame, row_id: str, group: str, vec: str) -> DataFrame:
    """(row_id, sim_sum, n): over the pairs of a row with the rows of other ids in its group, the sum of their cosines, and how many there are.

    No pair is formed. A sum of cosines is the product of the row's unit vector
    with the sum of the others', and that is the group's sum without what has
    the row's own id. Cosines are null where a vector is missing, has a null
    entry, no length or another dimension, and don't add to the sum; with an
    entry that isn't finite they are NaN.
    """
    with_sum = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    ship_code(df.sparkSession)
    keyed = df.select(F.col(row_id).alias("id"), F.col(group).alias("g"), F.col(vec).cast("array<double>").alias("v")).dropna(subset=["id", "g"])
    extra = [T.StructField("dim", T.IntegerType()), *[T.StructField(c, T.BooleanType()) for c in ("m", "fit", "odd")], T.StructField("u", T.ArrayType(T.DoubleType()))]
    rows = keyed.mapInArrow(_directions, T.StructType([keyed.schema["id"], keyed.schema["g"], *extra]))
    fit = rows.filter("fit")
    count = lambda c: F.count_if(c).alias
    kinds = [F.count("*").alias("n"), count(F.col("m"))("m"), count(F.col("fit"))("r"), count(F.col("odd"))("o")]

    def summed(part: DataFrame, keys: list[str]) -> DataFrame:
        """The sum of the unit vectors of each group of ``keys``."""
        each = part.select(*keys, F.posexplode("u").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
        return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("s"))

    sums = summed(fit, ["g", "dim"])
    rows = rows.join(sums, ["g", "dim"], "left").withColumn("us", F.when(F.col("fit"), with_sum(F.zip_with("u", "s", lambda x, y: x * y))))
    own = rows.groupBy("g", "id", "dim").agg(*kinds, F.sum("us").alias("us"))
    several = own.filter("r > 1").select("g", "id", "dim")  # ids of more than one vector
    uu = summed(fit.join(several, ["g", "id", "dim"], "left_semi"), ["g", "id", "dim"]).select("g", "id", "dim", with_sum(F.transform("s", lambda x: x * x)).alias("uu"))
    all_of = own.groupBy("g", "dim").agg(*[F.sum(c).alias(f"all_{c}") for c in "mro"])
    counted = own.groupBy("g", "id").agg(F.sum("n").alias("n"))
    pairs = counted.join(counted.groupBy("g").agg(F.sum("n").alias("all_n")), "g").groupBy("id").agg(F.sum(F.col("n") * (F.col("all_n") - F.col("n"))).alias("n"))
    own = own.join(all_of, ["g", "dim"]).join(uu, ["g", "id", "dim"], "left")
    others = lambda c: F.col(f"all_{c}") > F.col(c)
    nan = ((F.col("o") > 0) & others("m")) | ((F.col("m") > 0) & others("o"))
    sim = F.when(nan, float("nan")).when((F.col("r") > 0) & others("r"), F.col("us") - F.coalesce("uu", F.lit(1.0)))
    return own.groupBy("id").agg(F.sum(sim).alias("sim_sum")).join(pairs.filter("n > 0"), "id").select(F.col("id").alias(row_id), "sim_sum", "n")


def cosine_top_k(queries: DataFrame, refs: DataFrame, q_vec: str, r_vec: str, r_key: str, k: int = 5, carry: tuple[str, ...] = (), batch: int = 1024, limit: int = BROADCAST_BYTES, exclude_equal: str | None = None) -> DataFrame:
    """Each query row without its vector, with ``r_key``, ``carry`` of the reference, sim and rank (1 is best); ties by ``r_key``.

    Similarities are matrix products on Arrow batches of at most ``batch``
    queries and blocks of references. A reference side up to
    ``limit`` bytes is broadcast; a larger one is cut into slices of that size
    by key, each slice gives its own best k for every query, and those are
    merged: the result is the same. With ``exclude_equal``, a query isn't
    matched with a reference whose key equals that column. Rows without a
    vector have no matches.
    """
    spark = queries.sparkSession
    ship_code(spark)
    refs = refs.filter(F.col(r_vec).isNotNull()).select(r_key, r_vec, *carry)
    shape = refs.agg(F.count("*"), F.max(F.size(r_vec))).first()
    n, dim = shape[0], max(shape[1] or 1, 1)
    names = [c for c in queries.columns if c != q_vec]
    if set(names) & {r_key, *carry, "sim", "rank"}:
        raise ValueError("rename the columns that both sides have")
    schema = T.StructType([*[queries.schema[c] for c in names], refs.schema[r_key], *[refs.schema[c] for c in carry], T.StructField("sim", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    if not n:
        return spark.createDataFrame([], schema)
    slices = max(1, -(-n * dim * 8 // limit))
    asked = queries.filter(F.col(q_vec).isNotNull())
    want = k + (1 if exclude_equal else 0)

    def run(part: DataFrame) -> DataFrame:
        table = part.orderBy(r_key).toArrow().combine_chunks()  # at most ``limit`` bytes
        held = spark.sparkContext.broadcast((_unit(table.column(r_vec)), table.drop_columns([r_vec])))

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, info = held.value
            for big in batches:
                for lo in range(0, big.num_rows, batch):
                    b = big.slice(lo, batch)
                    at, sims = _best_in_blocks(_unit(b.column(q_vec)), x, want)
                    rows, refs_at, s = np.repeat(np.arange(b.num_rows), at.shape[1]), at.ravel(), sims.ravel()
                    rank = np.tile(np.arange(1, at.shape[1] + 1, dtype=np.int32), b.num_rows)
                    if exclude_equal:
                        other = pc.fill_null(pc.not_equal(b.column(exclude_equal).take(pa.array(rows)), info.column(r_key).take(pa.array(refs_at)).combine_chunks()), True).to_numpy(zero_copy_only=False)
                        rows, refs_at, s = rows[other], refs_at[other], s[other]
                        first = np.searchsorted(rows, rows)
                        rank = (np.arange(len(rows)) - first + 1).astype(np.int32)
                        few = rank <= k
                        rows, refs_at, s, rank = rows[few], refs_at[few], s[few], rank[few]
                    mine, theirs = b.select(names).take(pa.array(rows)), info.take(pa.array(refs_at)).combine_chunks()
                    columns = [*mine.columns, *[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in theirs.columns], pa.array(s), pa.array(rank)]
                    yield pa.RecordBatch.from_arrays(columns, [*names, *theirs.column_names, "sim", "rank"])

        return asked.mapInArrow(match, schema)

    if slices == 1:
        return run(refs)
    tag = "__q"
    numbered = materialize(asked.withColumn(tag, F.monotonically_increasing_id()), "top-k-queries")
    asked, names = numbered, [*names, tag]
    schema = T.StructType([*schema.fields[: len(names) - 1], T.StructField(tag, T.LongType()), *schema.fields[len(names) - 1 :]])
    cut = refs.withColumn("__s", F.pmod(F.xxhash64(r_key), F.lit(slices)))
    found = None
    for i in range(slices):
        one = materialize(run(cut.filter(F.col("__s") == i).drop("__s")), "top-k-slice")
        found = one if found is None else found.unionByName(one)
    best = top_by(found.drop("rank"), [tag], [F.desc(F.round("sim", 9)), F.col(r_key).asc()], k)
    from pyspark.sql import Window as W

    return best.withColumn("rank", F.row_number().over(W.partitionBy(tag).orderBy(F.desc(F.round("sim", 9)), F.col(r_key)))).drop(tag)

"""Exact top-k inner products by the three-phase uniform threshold.

Each vector is cut into ``LISTS`` runs of dimensions; a query has one score list per run, and a candidate's
score is the sum of its entries. Phase one gathers from every block of candidates the best entries of the first list and
resolves these to whole scores: the k-th best of them is a lower bound of the answer. Phase two hands it to all blocks. Whoever
reaches the bound must reach bound / LISTS in at least one list, and what the lists not yet looked at can add is at most the
product of the lengths of both vectors there; so list after list, entries are dropped that can no longer do so. Phase
three resolves the remaining lists, exactly, for the entries left alone, and keeps each block's best.

Queries and candidates meet as blocks of bounded size; a block of queries is a few hundred kilobytes.
Numbers are whole, so scores are exact: blocks whose sums stay below 2**53 are multiplied as doubles,
others as 64-bit whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import bounded_batches, frozen

LISTS = 4
_FEW = 0.1  # of all entries: so few are resolved one by one
BLOCK, QUERY_BLOCK = 4096, 512
SCALE = 256.0

_BLOCKS = "block long, dim int, n int, ids binary, rows binary, data binary"
_FOUND = "q_block long, q int, query_id long, row long, vec_id long, score long"


def _pack(size: int):
    """Vectors of a partition as blocks of whole numbers, one run of blocks for each dimension."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, rows, data = zip(*held.pop(dim))
            ids, rows = np.array(ids, "<i8"), np.array(rows, "<i8")
            order = np.lexsort((rows, ids))
            values = np.array([data[i] for i in order], "<i8")
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([int(rows[0])], pa.int64()), "dim": pa.array([dim], pa.int32()),
                    "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()),
                    "rows": pa.array([rows[order].tobytes()], pa.binary()),
                    "data": pa.array([values.tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            for row, vec_id, vector in zip(*(batch.column(i) for i in range(3))):
                x = vector.values.to_numpy(zero_copy_only=False).astype("f8") if len(vector.values) else np.zeros(0)
                if not np.isfinite(x).all():
                    continue
                if abs(x).max(initial=0) >= 2.0**62 / SCALE:
                    raise OverflowError("a component does not fit 64 bits")
                held.setdefault(len(x), []).append((vec_id.as_py(), row.as_py(), np.floor(SCALE * x).astype("<i8")))
                if len(held[len(x)]) >= size:
                    yield block(len(x))
        for dim in list(held):
            yield block(dim)

    return packed


def vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(row, vec_id, vector) of the rows that take part, stored so that a row keeps its number."""
    x = F.col(vector_column).cast("array<double>")
    whole = ~F.exists(x, lambda v: v.isNull())
    return frozen(
        table.filter(F.col(id_column).isNotNull() & x.isNotNull() & whole)
        .select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("vec_id"), x.alias("v")),
        "vectors",
    )


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(n, dim) if dim else np.zeros((n, 0), "<i8")


def _lists(dim: int) -> list[slice]:
    edges = np.linspace(0, dim, LISTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Queries by candidates, as exact whole numbers."""
    most = float(abs(queries).max(initial=1)) * float(abs(data).max(initial=1)) * max(1, queries.shape[1])
    if most < 2.0**52:
        return np.rint(queries.astype("f8") @ data.T.astype("f8")).astype("i8")
    return queries @ data.T


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; of equal ones the first. -2**63 marks no score."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    else:
        at = np.arange(len(scores))
    at = at[scores[at] > np.iinfo("i8").min]
    return at[np.lexsort((at, -scores[at]))][:k]


def _resolved(queries: np.ndarray, data: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of single pairs of rows."""
    out = np.empty(len(q), np.int64)
    for i in range(0, len(q), 1 << 16):
        out[i : i + (1 << 16)] = (queries[q[i : i + (1 << 16)]] * data[c[i : i + (1 << 16)]]).sum(axis=1)
    return out


def _fits(queries: np.ndarray, data: np.ndarray) -> None:
    """Raises where a sum of a score's lists leaves 64 bits; lengths tell for most blocks that none does."""
    a, b = queries.astype("f8"), data.astype("f8")
    if np.sqrt((a * a).sum(axis=1)).max(initial=0) * np.sqrt((b * b).sum(axis=1)).max(initial=0) < 2.0**62:
        return
    score = np.zeros((len(a), len(b)))
    for s in _lists(a.shape[1]):
        part = a[:, s] @ b[:, s].T
        score += part
        if max(abs(part).max(initial=0), abs(score).max(initial=0)) > 2.0**63 * (1 - 1e-9):
            raise OverflowError("a score needs more than 64 bits")


def _gathered(queries: np.ndarray, data: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phase one: (query, its best candidates by the first list, their whole scores)."""
    first, *rest = _lists(queries.shape[1])
    part = np.where(own, np.iinfo("i8").min, _products(queries[:, first], data[:, first]))
    for q in range(len(queries)):
        at = _best(part[q], k)
        yield q, at, part[q, at] + sum(_resolved(queries[:, s], data[:, s], np.full(len(at), q), at) for s in rest)


def _sufficient(
    queries: np.ndarray, data: np.ndarray, own: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases two and three: (query, candidate, whole score) of all pairs that reach the query's bound."""
    lists = _lists(queries.shape[1])
    lengths = [
        (np.sqrt((queries[:, s].astype("f8") ** 2).sum(axis=1)), np.sqrt((data[:, s].astype("f8") ** 2).sum(axis=1)))
        for s in lists
    ]
    none = np.iinfo("i8").min
    # In doubles, with room for rounding; entries without a bound always suffice.
    bound = np.where(bounds == none, -np.inf, bounds.astype("f8"))
    cutoff = bound / LISTS
    alive = ~own
    score = np.zeros(own.shape, np.int64)
    reached = np.zeros(own.shape, bool)
    q, c = None, None
    for n, s in enumerate(lists):
        left = lists[n + 1 :]
        if q is None:
            part = _products(queries[:, s], data[:, s])
            score += part
            slack = 1 + 1e-9 * abs(score).max(initial=0)
            adds = [np.multiply.outer(a, b) for a, b in lengths[n + 1 :]]
            reached |= part >= cutoff[:, None] - slack
            may = reached.copy()
            for a in adds:
                may |= a * (1 + 1e-9) + slack >= cutoff[:, None]
            alive &= may & (score + sum(adds) * (1 + 1e-9) + slack >= bound[:, None])
            if left and alive.mean() < _FEW:
                q, c = np.nonzero(alive)
                kept = score[q, c]
        else:
            kept = kept + _resolved(queries[:, s], data[:, s], q, c)
            slack = 1 + 1e-9 * abs(kept).max(initial=0)
            adds = sum(a[q] * b[c] for a, b in lengths[n + 1 :])
            enough = kept + adds * (1 + 1e-9) + slack >= bound[q]
            q, c, kept = q[enough], c[enough], kept[enough]
    if q is None:
        q, c = np.nonzero(alive)
        kept = score[q, c]
    enough = kept >= bounds[q]
    return q[enough], c[enough], kept[enough]


def _meet(k: int, phase: int):
    schema = pa.schema([("q_block", pa.int64()), ("q", pa.int32()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                dim = x["dim"]
                data, queries = _matrix(x["data"], x["n"], dim), _matrix(x["q_data"], x["q_n"], dim)
                _fits(queries, data)
                ids, rows = np.frombuffer(x["ids"], "<i8"), np.frombuffer(x["rows"], "<i8")
                q_ids, q_rows = np.frombuffer(x["q_ids"], "<i8"), np.frombuffer(x["q_rows"], "<i8")
                own = q_rows[:, None] == rows[None, :]
                if phase == 1:
                    found = list(_gathered(queries, data, own, k))
                else:
                    q, c, scores = _sufficient(queries, data, own, np.frombuffer(x["bounds"], "<i8"))
                    edges = np.searchsorted(q, np.arange(len(queries) + 1))
                    found = []
                    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                        at = _best(scores[a:b], k)
                        found.append((n, c[a:b][at], scores[a:b][at]))
                out = [(n, q_ids[n], rows[i], ids[i], v) for n, at, values in found for i, v in zip(at, values)]
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["q_block"]] * len(out), pa.int64())]
                    + [pa.array(list(c), f.type) for c, f in zip(cols, list(schema)[1:])],
                    schema=schema,
                )

    return met


def top_k(
    table: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """For each row whose id is divisible by ``every`` its k highest whole-number inner products.

    Components become floor(256 * x). Candidates are all other rows with a vector of the same length, the
    query's own row excepted; with fewer than k of them all are returned. Equal scores go by the
    smaller id, then by row. Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; repeated rows are rows of their own. Returns query_id, rank, vec_id, score. Where
    components or scores might not fit 64 bits, the job fails. An empty table gives an empty one; other columns play no part.
    """
    bounded_batches(table.sparkSession)
    rows = vectors(table, id_column, vector_column)
    blocks = frozen(rows.mapInArrow(_pack(BLOCK), _BLOCKS), "blocks")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).hint("rebalance")
    queries = frozen(asked.mapInArrow(_pack(QUERY_BLOCK), _BLOCKS), "queries")
    queries = queries.select("dim", *(F.col(c).alias(f"q_{c}") for c in ("block", "n", "ids", "rows", "data")))

    # Every block of queries meets every block of candidates once: both lists of block numbers name the
    # meeting, the vectors follow by joins on these numbers, and each meeting is a row of its own.
    ends = frozen(blocks.select("dim", "block").join(queries.select("dim", "q_block"), "dim"), "meetings")

    def meet(asking: DataFrame, phase: int) -> DataFrame:
        met = ends.join(asking, ["dim", "q_block"]).join(blocks, ["dim", "block"])
        return met.repartition("block", "q_block").mapInArrow(_meet(k, phase), _FOUND)

    nth = Window.partitionBy("q_block", "q").orderBy(F.desc("score"), "vec_id", "row")
    best = (
        meet(queries, 1).withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k)
        .filter(F.col("rank") == k).select("q_block", "q", F.col("score").alias("bound"))
    )
    packed = (
        best.groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("q", "bound"))).alias("bounds"))
    )
    cut = frozen(queries.join(packed, "q_block", "left").mapInArrow(_with_bounds, _CUT), "cutoffs")
    return (
        meet(cut, 2).withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


_CUT = "dim int, q_block long, q_n int, q_ids binary, q_rows binary, q_data binary, bounds binary"


def _with_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.iinfo("i8").min
    for batch in batches:
        for x in batch.to_pylist():
            found = dict(x["bounds"] or [])
            bounds = np.array([found.get(q) if found.get(q) is not None else none for q in range(x["q_n"])], "<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x["dim"]], pa.int32()), pa.array([x["q_block"]], pa.int64()), pa.array([x["q_n"]], pa.int32()),
                    pa.array([x["q_ids"]], pa.binary()), pa.array([x["q_rows"]], pa.binary()),
                    pa.array([x["q_data"]], pa.binary()), pa.array([bounds.tobytes()], pa.binary()),
                ],
                names=["dim", "q_block", "q_n", "q_ids", "q_rows", "q_data", "bounds"],
            )

"""Near-duplicate documents by BagMinHash.

A document is a bag: its shingles of ``WORDS`` words with their counts. For each shingle the axis of weights is cut into
intervals [0, 1), [1, 2), [2, 4), [4, 8) ... and each interval carries a Poisson process in time whose points also have a
place on the axis and one of ``HASHES`` slots. A document sees the points below its count; the first point
in a slot is its hash there. Two documents agree in a slot with probability equal to their weighted Jaccard
similarity. Since points come in order of time, only those before every slot is likely to be filled are
made, about m log m of them whatever the document's length.

Bands of slots give candidates; their bags are then compared exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import bounded_batches, frozen, numbered, returning_memory, text_or_empty, without_rows
from loglens.llm.linking import planes, shared_buckets, similar_components, sketches

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 8
HASHES = BANDS * ROWS
#: Slots of the longer signatures that decide which unsettled documents are compared.
SLOTS = 512
_CACHE = 400_000
_AT_ONCE = 400_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str) -> list[str]:
    return text.lower().split()


def bag(text: str, n: int = WORDS) -> Counter:
    """Shingles with their counts; a text of fewer words is one shingle, one without words has none."""
    w = split_words(text)
    if len(w) < n:
        return Counter([tuple(w)]) if w else Counter()
    return Counter(zip(*(w[i:] for i in range(n))))


def overlap(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    if len(b) < len(a):
        a, b = b, a
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / ((a.total() + b.total() - both) or 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit function of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _known() -> dict[str, int]:
    return {}


def _shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles as 64-bit hashes, and their counts."""
    known = _known()
    words = split_words(text)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(known) > _CACHE:
        known.clear()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    total = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        total = mixed(total * _GOLD + h[i : len(h) - n + 1 + i])
    return np.unique(total, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = HASHES) -> np.ndarray:
    """(documents, m): the number of the first point in each slot; documents need at least one shingle."""
    keys, lows, widths, counts, docs = [], [], [], [], []
    for d, (shingles, times) in enumerate(bags):
        low, width, level = 0, 1, 0
        some, often = shingles, times
        while len(some):
            keys.append(mixed(some + _GOLD * np.array(level + 1, np.uint64).reshape(1)))
            lows.append(np.full(len(some), low, np.float64))
            widths.append(np.full(len(some), width, np.float64))
            counts.append(often.astype(np.float64))
            docs.append(np.full(len(some), d, np.int64))
            low, width, level = low + width, max(1, low + width), level + 1
            some, often = some[often > low], often[often > low]
    keys, lows, widths, counts, docs = map(np.concatenate, (keys, lows, widths, counts, docs))
    weight = np.array([float(times.sum()) for _, times in bags])
    horizon = m * (np.log(m) + 3) / weight
    first = np.full(len(bags) * m, np.inf)
    found = np.zeros(len(bags) * m, np.uint64)
    # Points behind a document's horizon are kept for the case that a slot stays empty.
    now = np.zeros(len(keys))
    number = np.zeros(len(keys), np.uint64)
    on = np.arange(len(keys))
    while len(on):
        number[on] += np.uint64(1)
        z = mixed(keys[on] + number[on] * _GOLD)
        now[on] -= np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / widths[on]
        near = now[on] < horizon[docs[on]]
        at, z = on[near], z[near]
        rest = mixed(z ^ np.uint64(0xD6E8FEB86659FD93))
        place = lows[at] + widths[at] * ((rest >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        seen = place < counts[at]
        hit, z = at[seen], z[seen]
        slot = docs[hit] * m + (rest[seen] & np.uint64(0xFFFFFFFF)).astype(np.int64) * m // (1 << 32)
        np.minimum.at(first, slot, now[hit])
        best = first[slot] == now[hit]
        found[slot[best]] = z[best]
        on = at
        if not len(on):
            open_docs = np.isinf(first.reshape(-1, m)).any(1)
            if open_docs.any():
                # A further stretch of time for documents with an empty slot. Their processes begin anew: what they
                # find is the same, and more.
                horizon = np.where(open_docs, horizon * 1.7, 0)
                on = np.flatnonzero(open_docs[docs])
                now[on], number[on] = 0.0, 0
    return found.reshape(-1, m)


def band_keys(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(documents, bands): each band's slots as one number."""
    rows = found.reshape(len(found), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(found), bands)).copy()
    for i in range(rows.shape[2]):
        keys = mixed(keys * _GOLD + rows[:, :, i])
    return keys.view(np.int64)


def _signed(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """(places of documents that have shingles, their signatures), some documents at a time."""
    begin = 0
    while begin < len(bags):
        end, size = begin, 0
        while end < len(bags) and size < _AT_ONCE:
            size += len(bags[end][0])
            end += 1
        some = [i for i in range(begin, end) if len(bags[i][0])]
        if some:
            yield some, signatures([bags[i] for i in some], m)
        begin = end


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [_shingles(t) for t in batch.column(2).to_pylist()]
        bands = [[]] * len(bags)
        for some, found in _signed(bags, HASHES):
            for i, keys in zip(some, band_keys(found)):
                bands[i] = keys
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([int(c.sum()) for _, c in bags], pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["row", "key", "weight", "bands"],
        )


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [_shingles(t) for t in batch.column(1).to_pylist()]
        sketch = [[]] * len(bags)
        for some, found in _signed(bags, SLOTS):
            for i, words in zip(some, planes(sketches(found))):
                sketch[i] = words
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketch, pa.list_(pa.int64()))], names=["node", "sketch"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[int, Counter] = {}
    size = 0

    def known(node: int, text: str) -> Counter:
        nonlocal size
        if node not in kept:
            if size > 200_000:
                kept.clear()
                size = 0
            kept[node] = bag(text)
            size += len(kept[node])
        return kept[node]

    for batch in batches:
        a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
        found = [overlap(known(i, x), known(j, y)) for i, j, x, y in zip(a, b, left, right)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
        )


def compared(pairs: DataFrame, texts: DataFrame, compare=_compare) -> DataFrame:
    """The pairs (a, b) with the similarity of their texts; ``texts`` is (node, text)."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return both.mapInArrow(returning_memory(compare), "a long, b long, similarity double")


def texts_of(buckets: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the nodes that share a bucket, from (key, text) with any number of copies. Stored."""
    wanted = frozen(classes.join(buckets.select("node").distinct(), "node", "left_semi").select("key", "node"), "wanted")
    return frozen(texts.join(wanted.hint("merge"), "key").select("node", "text").distinct(), "texts")


def near_duplicates(
    docs: DataFrame, row: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Which rows are near copies of others: one row per row of ``docs``.

    Two documents are linked when their bags of five-word shingles (lower case, cut at white space) have a weighted Jaccard similarity
    of 0.8 or more; a group is a connected component of links. Equal texts form one group, too, and enter the
    search once. A null text counts as empty. Texts without words are linked to equal texts only. The row with
    the smallest id stays (null ids last), then the first row. Other columns of ``docs`` play no part; an empty table gives an empty one.
    Returns row, doc_id, keep_id, group_size, kept.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(id_column).alias("doc_id"),
        text_or_empty(text_column).alias("text"),
    ).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    if not row:
        rows = frozen(rows, "rows")  # so that rows keep their numbers
    listed, source, signed = rows.select("row", "doc_id", "key"), rows.select("key", "text"), rows.select("row", "key", "text")
    signed = signed.mapInArrow(returning_memory(_sign), "row long, key binary, weight long, bands array<long>")
    classes = frozen(
        signed.groupBy("key").agg(*(F.first(c).alias(c) for c in ("weight", "bands")))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    buckets = shared_buckets(classes)
    texts = texts_of(buckets, classes, source)

    def sketched(nodes: DataFrame) -> DataFrame:
        made = texts.join(nodes, "node", "left_semi").mapInArrow(returning_memory(_sketch), "node long, sketch array<long>")
        return made.join(classes.select("node", "bands"), "node")

    found = similar_components(buckets, sketched, lambda pairs: compared(pairs, texts), SIMILARITY, SLOTS, SIMILARITY)
    found = frozen(classes.join(found, "node").select("key", F.col("component").alias("group")), "groups")
    order = [F.col("doc_id").isNull(), "doc_id", "row"]
    return grouped(listed, frozen(best_of(listed, order), "best"), found, order)


def _named(order: list) -> list:
    return [F.col(c).alias(c) if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)]


def best_of(listed: DataFrame, order: list, *more: Column) -> DataFrame:
    """Classes of equal content: key, the number n of its members, the first of them in that order, and what else is asked for."""
    return listed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_named(order))).alias("best"), *more)


def grouped(listed: DataFrame, classes: DataFrame, found: DataFrame, order: list) -> DataFrame:
    """Members of classes of equal content with their groups: all columns but key, keep_id, group_size, kept.

    ``classes`` is what ``best_of`` says; ``found`` has (key, group) for classes that are linked to others.
    """
    linked = frozen(classes.join(found, "key"), "members")
    groups = linked.groupBy("group").agg(F.sum("n").alias("group_size"), F.min("best").alias("keep"))
    alone = classes.filter("n > 1").join(found, "key", "left_anti")
    groups = frozen(
        linked.join(groups, "group").select("key", "group_size", "keep")
        .unionByName(alone.select("key", F.col("n").alias("group_size"), F.col("best").alias("keep"))),
        "groups",
    )
    joined = listed.join(groups, "key", "left")
    own = F.struct(*_named(order))
    alone = F.col("keep").isNull()
    return joined.select(
        *(c for c in listed.columns if c != "key"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("keep").eqNullSafe(own)).alias("kept"),
        *([F.when(alone, F.col("line_no")).otherwise(F.col("keep.line_no")).alias("keep_line")] if "line_no" in listed.columns else []),
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with all its columns, one row of each group of near copies."""
    rows, row = numbered(docs)
    marked = near_duplicates(rows, row, id_column, text_column)
    dropped = frozen(marked.filter(~F.col("kept")).select(F.col("row").alias(row)), "dropped")
    return without_rows(rows, row, dropped)

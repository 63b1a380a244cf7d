"""Exact deduplication by content-defined chunk recipes.

A normalised text is cut into chunks where its own characters say so, so that equal passages give
equal chunks wherever they stand. Each distinct chunk crosses the network once and gets an
identifier that is verified: a 64-bit hash, plus a slot number where different chunks share a hash.
A document is from then on the ordered list of its identifiers, its recipe, about one
hundredth of its text. Equal recipes are equal texts; long documents never move again.

Everything is DataFrame functions; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import frozen, numbered, text_or_empty, without_rows

WHITE = " \t\n\x0b\x0c\r"
MIN_CHUNK, MAX_CHUNK = 256, 4096


def _class(residue: int) -> str:
    """A pattern class of about one code point in four: single Latin-1 ones, which are tested fast, and a range of others."""
    points = "".join(f"\\x{{{p:x}}}" for p in range(0x21, 0x100) if p % 4 == residue)
    return f"[{points}\\x{{{0x400 + 0x4000 * residue:x}}}-\\x{{{0x43FF + 0x4000 * residue:x}}}]"


#: A chunk ends behind four characters of given classes, or at its longest.
BOUNDARY = (
    f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<={_class(0)}{_class(1)}{_class(2)}{_class(1)})|(?s).{{1,{MAX_CHUNK}}}"
)


def normalised(text_column: str = "text") -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(text_or_empty(text_column), WHITE, "")


def _chunks(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(BOUNDARY), F.lit(0))


def _chunk_hash(bits: int):
    return lambda chunk: F.xxhash64(chunk) if bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def chunk_ids(docs: DataFrame, text_column: str = "text", hash_bits: int = 64) -> DataFrame:
    """Each distinct chunk once: (chunk, hash, copies)."""
    chunk = docs.select(normalised(text_column).alias("t")).select(F.explode(_chunks("t")).alias("chunk"))
    return (
        chunk.groupBy("chunk").agg(F.count(F.lit(1)).alias("copies"))
        .select("chunk", _chunk_hash(hash_bits)(F.col("chunk")).alias("hash"), "copies")
    )


def recipes(
    docs: DataFrame, row: str | None = None, id_column: str = "doc_id", text_column: str = "text", hash_bits: int = 64
) -> DataFrame:
    """One row per document: row, doc_id, n_points, text_sha256 and the recipe (ids, slots).

    ``slots`` is empty for documents none of whose chunks shares its hash with a different chunk. Stored.
    """
    rows = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.col(id_column).alias("doc_id"),
        F.length(text_or_empty(text_column)).cast("long").alias("n_points"),
        normalised(text_column).alias("t"),
    )
    head = ["row", "doc_id", "n_points", F.sha2("t", 256).alias("text_sha256")]
    ids = chunk_ids(docs, text_column, hash_bits)
    clashes = frozen(ids.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "clashes")
    if clashes.isEmpty():
        listed = F.transform(_chunks("t"), _chunk_hash(hash_bits))
        return frozen(rows.select(*head, listed.alias("ids"), F.expr("array_repeat(0, 0)").alias("slots")), "recipes")
    # Different chunks under one hash: number them. Their count is tiny whatever the corpus.
    slot = F.row_number().over(Window.partitionBy("hash").orderBy("chunk")) - 1
    slots = frozen(ids.join(clashes, "hash", "left_semi").select("chunk", slot.alias("slot")), "slots")
    flat = rows.select(*head, F.posexplode_outer(_chunks("t")).alias("pos", "chunk")).join(slots, "chunk", "left")
    part = F.struct("pos", _chunk_hash(hash_bits)(F.col("chunk")).alias("hash"), F.coalesce("slot", F.lit(0)).alias("slot"))
    listed = flat.groupBy("row", "doc_id", "n_points", "text_sha256").agg(
        F.sort_array(F.collect_list(F.when(F.col("chunk").isNotNull(), part))).alias("parts")
    )
    has_clash = F.exists("parts", lambda p: p["slot"] > 0)
    return frozen(
        listed.select(
            "row", "doc_id", "n_points", "text_sha256", F.transform("parts", lambda p: p["hash"]).alias("ids"),
            F.when(has_clash, F.transform("parts", lambda p: p["slot"])).otherwise(F.expr("array_repeat(0, 0)")).alias("slots"),
        ),
        "recipes",
    )


def exact_duplicates(
    docs: DataFrame, row: str | None = None, id_column: str = "doc_id", text_column: str = "text", hash_bits: int = 64
) -> DataFrame:
    """Which rows hold a text that another row holds, too.

    Texts are equal when identical without ASCII white space; a null text counts as empty, and all
    empty texts are equal. Of equal texts the row with the most code points in the original text
    stays, then that with the smallest id (null ids last), then the first row. Other columns of
    ``docs`` play no part. Returns one row per row of ``docs``: row, doc_id, keep_id, group_size, kept,
    text_sha256, n_points, n_chunks. An empty table gives an empty one.

    A group's size and keeper are aggregates that are combined before they move; a group of any size is one
    row, and joining it back to its members is a skewed join that adaptive execution splits.
    """
    found = recipes(docs, row, id_column, text_column, hash_bits)
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = (
        found.groupBy("ids", "slots").agg(F.count(F.lit(1)).alias("copies"), best.alias("best"))
        .filter("copies > 1")
        .select("ids", "slots", "copies", F.col("best.row").alias("keep_row"), F.col("best.doc_id").alias("keep_doc_id"))
    )
    joined = found.join(groups, ["ids", "slots"], "left")
    alone = F.col("copies").isNull()
    return joined.select(
        "row", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_doc_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256", "n_points", F.size("ids").alias("n_chunks"),
    )


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts."""
    rows, row = numbered(docs)
    marked = exact_duplicates(rows, row, id_column, text_column)
    dropped = frozen(marked.filter(~F.col("kept")).select(F.col("row").alias(row)), "dropped")
    return without_rows(rows, row, dropped)

"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata columns are quantised to `BITS` bits each, and the cell they form is numbered
along the Hilbert curve, so rows that are near in all dimensions at once get near numbers. Rows are
ordered by that number, then by a hash of the id, and cut into runs. The law is `rows`: the sizes
of any two shards differ by one row at most. Each shard covers a compact region, so the minimum and
maximum of every dimension in its files prune it.

No single task orders all rows. A cell is spread over buckets by a hash of the id and the other
columns, as many as its share of `BUCKETS`: a cell that holds a third of all rows gets a third of
them, whether their ids are null, equal or all different. Only rows equal in every column would still
meet in one bucket; where they crowd one, the rows are written once with their places in the source,
and those spread them. Rows are numbered inside their bucket, and running totals of the bucket
counts, at most `BUCKETS` and one for each cell at any corpus size, turn that into a place in the
whole order.

Numbers are quantised by their logarithm, so no pass is needed for their range; other columns by a
hash. Defined cases: a null dimension is quantile 0; null and repeated ids get slots of their own, in
an order that the other columns decide; equal rows are interchangeable; very long texts and empty ones
count only by their quantised metadata; an empty table gives an empty result; other columns pass
through under any name (columns that hold maps or variants take no part in the hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from moundlens.llm.common import durable, read_table

BITS = 4
BUCKETS = 8192
CROWDED = 100_000  # rows beyond twice its share that a bucket may hold
SHARDS = 40
OVERHEAD = 16  # bytes that a row costs beside its text


def quantised(df: DataFrame, name: str, bits: int = BITS) -> Column:
    """A column on 0 .. 2**bits - 1; nulls on 0."""
    top, col = (1 << bits) - 1, F.col(name)
    if isinstance(df.schema[name].dataType, NumericType):
        magnitude = F.floor(F.log2(F.abs(col.cast("double")) + 1) * F.lit(top / 24.0)).cast("int")
        cell = F.greatest(F.least(magnitude, F.lit(top)), F.lit(0))
    else:
        cell = F.pmod(F.xxhash64(col.cast("string")), F.lit(top)).cast("int") + 1
    return F.coalesce(cell, F.lit(0))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _step(change, *which: int):
    return lambda a: change(a, *which)


def _set(a: Column, n: int, **changed: Column) -> Column:
    return F.array(*(changed.get(f"x{k}", F.get(a, k)) for k in range(n)))


def hilbert(cells: list[Column], bits: int) -> Column:
    """Number of a cell along the Hilbert curve (Skilling's transform over an array of longs)."""
    n = len(cells)
    state = F.array(*(c.cast("long") for c in cells))

    def undo(a: Column, k: int, level: int) -> Column:
        low = F.lit((1 << level) - 1).cast("long")
        first, own = F.get(a, 0), F.get(a, k)
        high = F.getbit(own, F.lit(level)) == 1
        if k == 0:
            return _set(a, n, x0=F.when(high, first.bitwiseXOR(low)).otherwise(first))
        swap = F.when(high, F.lit(0).cast("long")).otherwise(first.bitwiseXOR(own).bitwiseAND(low))
        flip = F.when(high, low).otherwise(swap)
        return _set(a, n, x0=first.bitwiseXOR(flip), **{f"x{k}": own.bitwiseXOR(swap)})

    for level in range(bits - 1, 0, -1):
        for k in range(n):
            state = _let(state, _step(undo, k, level))

    def gray(a: Column, k: int) -> Column:
        return _set(a, n, **{f"x{k}": F.get(a, k).bitwiseXOR(F.get(a, k - 1))})

    for k in range(1, n):
        state = _let(state, _step(gray, k))

    def number(a: Column) -> Column:
        t = F.lit(0).cast("long")
        for level in range(bits - 1, 0, -1):
            flip = F.when(F.getbit(F.get(a, n - 1), F.lit(level)) == 1, F.lit((1 << level) - 1)).otherwise(F.lit(0))
            t = t.bitwiseXOR(flip.cast("long"))
        place = F.lit(0).cast("long")
        for level in range(bits - 1, -1, -1):  # interleave, highest bits first
            for k in range(n):
                bit = F.getbit(F.get(a, k).bitwiseXOR(t), F.lit(level)).cast("long")
                place = F.shiftleft(place, 1).bitwiseOR(bit)
        return place

    return _let(state, number)


def _unhashable(kind: str) -> bool:
    return "map<" in kind or "variant" in kind


def assign(
    docs: DataFrame,
    dimensions: tuple[str, ...] = ("lang", "source", "n_chars"),
    id_col: str = "doc_id",
    shards: int = SHARDS,
    bits: int = BITS,
    crowded: int = CROWDED,
) -> DataFrame:
    """The rows' columns, then `curve`, `shard` and `slot` (the last three by position)."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    df = docs.toDF(*names)
    cells = [f"_q{k}" for k in range(len(dimensions))]
    quantiles = (quantised(df, of[d], bits).alias(c) for d, c in zip(dimensions, cells, strict=True))
    hashable = [f"c{k}" for k, f in enumerate(docs.schema.fields) if not _unhashable(f.dataType.simpleString())]
    keys = [F.xxhash64(of[id_col]).alias("_key"), F.xxhash64(F.lit(BITS), *hashable).alias("_digest")]
    df = df.select("*", *keys, *quantiles)
    # at most 2**(bits * dimensions) rows, whatever the corpus: broadcast is safe
    share = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    share = share.select(*cells, "_n", F.sum("_n").over(Window.partitionBy()).alias("_all"))
    buckets = F.ceil(F.col("_n") * F.lit(float(BUCKETS)) / F.col("_all"))
    share = share.select(*cells, "_all", buckets.alias("_m"), hilbert([F.col(c) for c in cells], bits).alias("_h"))
    df = df.join(F.broadcast(share), cells).drop(*cells)
    df = df.withColumn("_b", F.pmod(F.xxhash64("_key", "_digest"), "_m"))
    sizes = df.groupBy("_h", "_b").agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all"))
    if not sizes.where(F.col("_n") > F.col("_all") * F.lit(2.0 / BUCKETS) + crowded).isEmpty():
        # only equal rows can crowd a bucket: their places in the written table tell them apart
        df = durable(df.withColumn("_place", F.monotonically_increasing_id()), "sharding-rows")
        spread = F.pmod(F.xxhash64("_key", "_digest", "_place"), F.col("_m"))
        df = df.withColumn("_b", spread).drop("_place")
        sizes = df.groupBy("_h", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_h", "_b")) - F.col("_n")
    offsets = sizes.select("_h", "_b", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_h", "_b").orderBy("_key", of[id_col], "_digest")) - 1
    df = df.withColumn("_row", inside).join(F.broadcast(offsets), ["_h", "_b"])
    df = df.withColumn("_place", F.col("_before") + F.col("_row"))
    df = df.withColumn("_shard", F.expr(f"_place * {shards} div _all"))
    slot = F.expr(f"_place - (_shard * _all + {shards - 1}) div {shards}").cast("int")
    added = [F.col("_h").alias("curve"), F.col("_shard").cast("int").alias("shard"), slot.alias("slot")]
    return df.select(*(F.col(of[c]).alias(c) for c in docs.columns), *added)


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order; large shards take several files."""
    ordered = assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; sizes and checksums are of the whole texts."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    size = (F.length(text) + OVERHEAD).cast("long")
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", size.alias("size"), F.crc32(text).alias("text_crc32")
    )
    return assign(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

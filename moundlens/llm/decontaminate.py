"""Benchmark decontamination: scan documents for windows of benchmark words.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lowered. A window is
`window` consecutive words of an item; an item with fewer words is one window, one without words
has none. Window digests of the benchmark form a hash set that is broadcast when the benchmark's
text is within `INDEX_BYTES`; every hit is verified word by word. A larger benchmark is joined by
digest instead, with the same result.

Null and empty texts have no words and no hits, rows repeated in either table count as they stand,
an empty benchmark hits nothing, and an item without an id has the id ''. Other columns of the documents pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from moundlens.llm.common import numbered, pick, read_table, tidy
from moundlens.llm.words import (
    ALPHANUMERIC,
    LOWER,
    Words,
    spread,
    texts,
    window_starts,
    windows,
    words,
)

INDEX_BYTES = 32 << 20  # benchmark text up to which its windows are broadcast
WINDOW = 10

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(_SPAN)),  # byte offsets in the UTF-8 text
    T.StructField("kept_text", T.StringType()),
]


def _words(column) -> tuple[np.ndarray, Words]:
    data, offsets = texts(column)
    data = LOWER[data]
    return data, words(data, offsets, ALPHANUMERIC)


def _normal(data: np.ndarray, found: Words, at: int, size: int) -> bytes:
    pairs = zip(found.start[at : at + size], found.end[at : at + size], strict=True)
    return b" ".join(data[a:b].tobytes() for a, b in pairs)


def item_windows(items: list[str | None], texts_: list[str | None], window: int):
    """(size, digest, words, item) of every window of every item."""
    data, found = _words(pa.array(texts_, pa.large_string()))
    for k, item in enumerate(items):
        lo, n = int(found.first[k]), int(found.counts[k])
        size = min(n, window)
        if size:
            for at, digest in enumerate(windows(found.digest[lo : lo + n], size)):
                yield size, int(digest), _normal(data, found, lo + at, size), item


class Index:
    """size -> ascending digests, and digest -> words -> items."""

    def __init__(self, rows):
        self.items: dict[tuple[int, int], dict[bytes, list[str]]] = {}
        for size, digest, text, item in rows:
            named = self.items.setdefault((size, digest), {}).setdefault(text, [])
            if item not in named:
                named.append(item)
        self.sizes = {
            size: np.array(sorted(d for s, d in self.items if s == size), np.uint64)
            for size in sorted({s for s, _ in self.items})
        }

    def hits(self, data: np.ndarray, found: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(word position, size, items) of every verified window."""
        for size, known in self.sizes.items():
            starts = window_starts(found.first, size)
            digests = windows(found.digest, size)[starts]
            place = np.minimum(np.searchsorted(known, digests), len(known) - 1)
            for at in np.flatnonzero(known[place] == digests):
                start = int(starts[at])
                named = self.items[size, int(digests[at])].get(_normal(data, found, start, size))
                if named:
                    yield start, size, named


def _result(batch: pa.RecordBatch, text_at: int, hits, schema: pa.Schema) -> pa.RecordBatch:
    data, offsets = texts(batch.column(text_at))
    found = words(LOWER[data], offsets, ALPHANUMERIC, digests=False)
    hits = list(hits)
    starts = np.array([h[0] for h in hits], np.int64)
    sizes = np.array([h[1] for h in hits], np.int64)
    named: dict[int, set[str]] = {}
    doc_of = np.searchsorted(found.first, starts, side="right") - 1
    for doc, (_, _, items) in zip(doc_of.tolist(), hits, strict=True):
        named.setdefault(doc, set()).update(items)
    hit = spread(starts, sizes, len(found.start))
    n_hit = np.diff(np.r_[0, np.cumsum(hit)][found.first])
    spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    kept = batch.column(text_at).cast(pa.string())
    if named:
        whole = kept.to_pylist()
        for doc in named:
            lo, hi = found.first[doc], found.first[doc + 1]
            run = np.flatnonzero(np.diff(np.r_[False, hit[lo:hi], False].astype(np.int8)))
            base = int(offsets[doc])
            text = data[base : int(offsets[doc + 1])].tobytes()
            out, at = [], 0
            for a, b in zip(run[::2], run[1::2], strict=True):
                span = int(found.start[lo + a]) - base, int(found.end[lo + b - 1]) - base
                spans[doc].append({"start": span[0], "end": span[1]})
                out.append(text[at : span[0]])
                at = span[1]
            whole[doc] = b"".join([*out, text[at:]]).decode()
        kept = pa.array(whole, pa.string())
    added = [
        pa.array(found.counts, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([sorted(named.get(k, ())) for k in range(batch.num_rows)], pa.list_(pa.string())),
        pa.array(spans, schema.field("spans").type),
        kept,
    ]
    return pa.RecordBatch.from_arrays([*batch.columns, *added], schema=schema)


def scan(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """The documents' columns, then the five of FOUND: hit words, items, spans and the rest.

    A document column named like one of the five keeps its place; read the added ones by position
    (the last five) in that case.
    """
    items = pick(items, item=item_col, text=item_text_col).withColumn(
        "item", F.coalesce(F.col("item").cast("string"), F.lit(""))
    )
    weight = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)
    size = items.agg(F.coalesce(weight, F.lit(0))).first()[0]
    if size > index_bytes:
        return _scan_by_join(docs, items, text_col, window)
    rows = items.collect()
    index = Index(item_windows([r.item for r in rows], [r.text for r in rows], window))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    text_at, names = docs.columns.index(text_col), [*docs.columns, *(f.name for f in FOUND)]
    docs = numbered(docs)
    schema = T.StructType([*docs.schema.fields, *FOUND])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = shared.value.hits(*_words(batch.column(text_at)))
            yield _result(batch, text_at, hits, arrow)

    return docs.mapInArrow(tidy(run), schema).toDF(*names)


def _scan_by_join(docs: DataFrame, items: DataFrame, text_col: str, window: int) -> DataFrame:
    """As `scan`, for a benchmark too large to broadcast: windows meet in a join on their digest."""
    from moundlens.llm import blocks

    fields = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("digest", T.LongType()),
                           T.StructField("words", T.StringType()), T.StructField("item", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(item_windows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), window))
            size, digest, text, item = zip(*rows, strict=True) if rows else ((),) * 4
            signed = np.array(digest, np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(size, pa.int32()), signed, pa.array([x.decode() for x in text], pa.string()),
                                   pa.array(item, pa.string())], names=fields.names)

    wanted = items.mapInArrow(cut, fields).distinct()
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())  # at most `window`
    text_at, names = docs.columns.index(text_col), [*docs.columns, *(f.name for f in FOUND)]
    docs = numbered(docs)
    packed = blocks.pack(docs, "decontaminate-blocks")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                data, found = _words(blocks.unpack(held).column(text_at))
                for size in sizes:
                    starts = window_starts(found.first, size)
                    digests = windows(found.digest, size)[starts].view(np.int64)
                    for lo in range(0, len(starts), 50_000):
                        at = starts[lo : lo + 50_000]
                        text = [_normal(data, found, int(k), size).decode() for k in at]
                        n = len(at)
                        yield pa.record_batch([pa.array(np.full(n, size), pa.int32()), digests[lo : lo + n], pa.array(text, pa.string()),
                                               np.full(n, block), at], names=["size", "digest", "words", "block", "at"])

    every = packed.mapInArrow(tidy(emit), "size int, digest long, words string, block long, at long")
    hits = every.join(wanted, ["size", "digest", "words"]).select("block", "at", "size", "item")
    schema = T.StructType([*docs.schema.fields, *FOUND])
    arrow = to_arrow_schema(schema)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = blocks.unpack(left.column("data")[0])
        batch = pa.RecordBatch.from_arrays(batch.columns, schema=to_arrow_schema(docs_schema))
        rows = zip(*(right.column(c).to_pylist() for c in ("at", "size", "item")), strict=True)
        return pa.Table.from_batches([_result(batch, text_at, ((a, s, [i]) for a, s, i in rows), arrow)])

    docs_schema = docs.schema
    return blocks.with_answers(packed, hits, finish, schema).toDF(*names)


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", text_col: str = "text", **options) -> DataFrame:
    """The documents' columns only: hit spans cut out of the texts, or hit documents left out."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    n = len(docs.columns)
    found = scan(docs, items, text_col, **options).toDF(*(f"c{k}" for k in range(n + len(FOUND))))
    if remove == "documents":
        found = found.where(F.col(f"c{n + 1}") == 0)
    at = docs.columns.index(text_col)
    kept = [F.col(f"c{n + 4}" if k == at and remove == "spans" else f"c{k}").alias(name) for k, name in enumerate(docs.columns)]
    return found.select(*kept)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract columns from the scan of all documents against the whole benchmark."""
    docs = pick(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = scan(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

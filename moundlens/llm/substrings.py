"""Substring dedup by windows of words looked up in an index of all documents.

This hash exchange stands in place of a relative Lempel-Ziv parse, which is not done. The phrases of
`window` words of the whole corpus are indexed in hash-range blocks (the groups of
`blocks.shared_keys`); a phrase is looked up in the one block that could hold it and comes back with
the smallest document id that has it. Its words are removed from every document but that one.
Consecutive phrases with the same smallest owner are reported as one factor: each of its windows
occurs in the source, while the factor as a whole need not.

Two exchanges keep this small. Each phrase is represented by its anchor, the smallest digest among
its runs of `ANCHOR` words; overlapping phrases mostly share one, and equal phrases always do. The
first exchange finds the anchors that several documents have, the second looks up only the phrases
below those. Phrases are compared by 64-bit digests.

Defined cases: a null or empty text has no words and loses none; ids may repeat, and rows with the
same id are one document, never smaller than itself; a null id comes after all others, so such a
row can lose words and never costs another row any. Other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from moundlens.llm import blocks
from moundlens.llm.common import durable, numbered, pick, read_table
from moundlens.llm.words import NOT_BLANK, Words, spread, texts, window_starts, windows, words

WINDOW = 13
ANCHOR = 6

_FACTOR = T.StructType(
    [
        T.StructField("start", T.IntegerType()),  # word position
        T.StructField("words", T.IntegerType()),
        T.StructField("source", T.LongType()),  # id of the document that has it first
    ]
)
PARSED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("factors", T.ArrayType(_FACTOR)),
    T.StructField("kept_text", T.StringType()),  # words left, joined by one space
]


def _read(data, id_at: int, text_at: int) -> tuple[pa.RecordBatch, np.ndarray, Words]:
    batch = blocks.unpack(data)
    found = words(*texts(batch.column(text_at)), NOT_BLANK)
    return batch, blocks.owners(batch.column(id_at)), found


def _anchors(digest: np.ndarray, window: int) -> np.ndarray:
    """For every window start, the smallest digest of the word runs inside the window."""
    size = min(ANCHOR, window)
    low = windows(digest, size)
    left, reach = window - size + 1, 1
    while reach < left:  # minimum over `reach` runs, doubled until it spans the window
        step = min(reach, left - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    return low


def _owner_of(found: Words, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return ids[np.searchsorted(found.first, starts, side="right") - 1]


def parse(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """The documents' columns, then the four of PARSED (the last four columns by position)."""
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    names = [*docs.columns, *(f.name for f in PARSED)]
    docs = numbered(docs)
    table = blocks.pack(docs, "substring-blocks")

    def anchor_keys(data) -> blocks.Keys:
        _, ids, found = _read(data, id_at, text_at)
        starts = window_starts(found.first, window)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        low = _anchors(found.digest, window)[starts]
        owner = _owner_of(found, ids, starts)
        new = np.r_[True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])]
        return low[new], owner[new]

    size = blocks.total_size(table)
    anchors = blocks.shared_keys(table, "data", anchor_keys, size // 28, "substring-anchors")

    def phrases(left: pa.Table, right: pa.Table) -> pa.Table:
        """Digest and owner of every phrase below a shared anchor."""
        block, keys, owner = left.column("block"), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if right.num_rows:
            _, ids, found = _read(left.column("data")[0].as_buffer(), id_at, text_at)
            starts = window_starts(found.first, window)
            hit, _ = blocks.lookup(_anchors(found.digest, window)[starts], blocks.answers(right)[0])
            starts = starts[hit]
            keys, owner = windows(found.digest, window)[starts], _owner_of(found, ids, starts)
        held = pa.record_batch([pa.array(keys), pa.array(owner)], names=["key", "owner"])
        sink = pa.BufferOutputStream()
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with pa.ipc.new_stream(sink, held.schema, options=options) as out:
            out.write_batch(held)
        return pa.table([block, [len(keys)], [sink.getvalue().to_pybytes()]], blocks.PACKED_ARROW)

    below = durable(
        blocks.with_answers(table, anchors, phrases, blocks.PACKED), "substring-phrases"
    )

    def phrase_keys(data) -> blocks.Keys:
        held = blocks.unpack(data)
        return tuple(c.to_numpy(zero_copy_only=False) for c in held.columns)

    first = blocks.shared_keys(
        below, "data", phrase_keys, blocks.total_size(below), "substring-sources"
    )
    schema = T.StructType([*docs.schema.fields, *PARSED])
    arrow = to_arrow_schema(schema)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        batch, ids, found = _read(left.column("data")[0].as_buffer(), id_at, text_at)
        starts = window_starts(found.first, window)
        keys, low, _ = blocks.answers(right)
        hit, place = blocks.lookup(windows(found.digest, window)[starts], keys)
        starts, place = starts[hit], place[hit]
        source = low[place] if len(place) else np.zeros(0, np.int64)
        later = source < _owner_of(found, ids, starts)
        starts, source = starts[later], source[later]
        return pa.Table.from_batches([_parsed(batch, text_at, found, starts, source, window, arrow)])

    return blocks.with_answers(table, first, finish, schema).toDF(*names)


def _factors(at: np.ndarray, source: np.ndarray, window: int) -> list[dict]:
    """Greedy factors of one document from its found phrases, given in order."""
    ends = np.flatnonzero(np.r_[(at[1:] != at[:-1] + 1) | (source[1:] != source[:-1]), True])
    out, lo = [], 0
    for k in ends.tolist():
        size = int(at[k] - at[lo]) + window
        out.append({"start": int(at[lo]), "words": size, "source": int(source[lo])})
        lo = k + 1
    return out


def _parsed(batch, text_at, found: Words, starts, source, window, arrow) -> pa.RecordBatch:
    gone = spread(starts, window, len(found.start))
    doc_of = np.searchsorted(found.first, starts, side="right") - 1
    cuts = np.searchsorted(doc_of, np.arange(batch.num_rows + 1))
    data, offsets = texts(batch.column(text_at))
    factors, kept = [], []
    for doc in range(batch.num_rows):
        # bytes.split() cuts at exactly the six blanks that end a word
        parts = data[offsets[doc] : offsets[doc + 1]].tobytes().split()
        a, b = cuts[doc], cuts[doc + 1]
        if a < b:
            lo, hi = found.first[doc], found.first[doc + 1]
            factors.append(_factors(starts[a:b] - lo, source[a:b], window))
            parts = [parts[k] for k in np.flatnonzero(~gone[lo:hi]).tolist()]
        else:
            factors.append([])
        kept.append(b" ".join(parts))
    added = [
        pa.array(found.counts, pa.int64()),
        pa.array(np.diff(np.r_[0, np.cumsum(gone)][found.first]), pa.int64()),
        pa.array(factors, arrow.field("factors").type),
        pa.array(kept, pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays([*batch.columns, *added], schema=arrow)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract columns from the parse of all documents."""
    docs = pick(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return parse(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )

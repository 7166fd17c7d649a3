"""Documents packed into blocks, and the exchange by which blocks learn what they share.

A block is one row that holds a few megabytes of whole documents, compressed. Jobs that need every
document several times read the packed table instead of shuffling the texts again, and the rows of
an exchange carry thousands of 64-bit keys each, sorted, so that grouping them is array work.

`shared_keys` tells every block which of its keys have more than one owner over all blocks. A block
sends each key once, with its smallest and largest owner, however many documents hold it: a key
that a third of all documents share costs one entry per block, never one per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from moundlens.llm.common import durable, returned, tidy

BLOCK_BYTES = 8 << 20  # text in one block; a longer document is a block of its own
KEYS_PER_PART = 250_000  # keys that one group of the exchange should hold
LEAST_PARTS = 256
PACKED = "block long, size long, data binary"
# Rows without an id sort after all others.
NO_OWNER = np.iinfo(np.int64).max


def pack(df: DataFrame, name: str) -> DataFrame:
    """Durable table of blocks; the columns of `df` keep their order inside."""
    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_batch(table)
            return pa.record_batch([[block], [size], [sink.getvalue().to_pybytes()]], PACKED_ARROW)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, schema=schema)
            rows = _row_bytes(batch)
            lo = 0
            for at, n in enumerate(rows.tolist()):
                if size and size + n > BLOCK_BYTES:
                    if at > lo:
                        held.append(batch.slice(lo, at - lo))
                    yield flush()
                    held, size, lo, block = [], 0, at, block + 1
                size += n
            if lo < batch.num_rows:
                held.append(batch.slice(lo))
        if held:
            yield flush()

    return durable(df.mapInArrow(tidy(run), PACKED), name)


PACKED_ARROW = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the text columns of each row, and 64 for the rest."""
    total = np.full(batch.num_rows, 64, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            lengths = pc.binary_length(column).fill_null(0)
            total += lengths.to_numpy(zero_copy_only=False)
    return total


def unpack(data) -> pa.RecordBatch:
    data = data.as_buffer() if hasattr(data, "as_buffer") else data
    return pa.ipc.open_stream(data).read_next_batch()


def owners(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_OWNER).to_numpy(zero_copy_only=False)


Keys = tuple[np.ndarray, np.ndarray]  # keys (uint64) and their owners (int64), any order, repeats too

_SENT = pa.schema(
    [("part", pa.int64()), ("block", pa.int64())]
    + [(name, pa.binary()) for name in ("keys", "low", "high", "often")]
)
ANSWER = "block long, keys binary, low binary, often binary"
_ANSWER = pa.schema([("block", pa.int64())] + [(x, pa.binary()) for x in ("keys", "low", "often")])


def shared_keys(
    table: DataFrame, payload: str, keys_of: Callable[[bytes], Keys], total: int, name: str
) -> DataFrame:
    """(block, keys, low, often): for each block its keys with two owners or more over all blocks,
    the smallest owner of each, and how often it came from all blocks.

    total: how many keys there are about, which sets the number of groups.
    """
    parts = max(LEAST_PARTS, -(-total // KEYS_PER_PART))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                columns = summed(*keys_of(data.as_buffer()))
                if len(columns[0]):
                    yield _split(block, columns, parts)

    def gather(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sent = [_flat(group, name, kind) for name, kind in _KINDS]
        sizes = np.array([len(x) // 8 for x in group.column("keys").to_pylist()], np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(sent[0])
        keys = sent[0][order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else order[:0]
        run = np.diff(np.r_[first, len(keys)])
        low = np.repeat(np.minimum.reduceat(sent[1][order], first), run)
        high = np.repeat(np.maximum.reduceat(sent[2][order], first), run)
        often = np.repeat(np.add.reduceat(sent[3][order], first, dtype=np.int64), run)
        hit = np.flatnonzero(low < high)
        hit = hit[np.argsort(row[order[hit]], kind="stable")]
        at = row[order[hit]]
        rows, begin = np.unique(at, return_index=True)
        cut = np.r_[begin, len(at)]
        blocks = group.column("block").to_numpy()
        pieces = [hit[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return pa.table(
            [
                blocks[rows],
                [keys[x].tobytes() for x in pieces],
                [low[x].tobytes() for x in pieces],
                [often[x].tobytes() for x in pieces],
            ],
            schema=_ANSWER,
        )

    sent = table.select("block", payload).mapInArrow(
        tidy(send), "part long, block long, keys binary, low binary, high binary, often binary"
    )
    return durable(sent.groupBy("part").applyInArrow(lambda group: returned(gather(group)), ANSWER), name)


_KINDS = (("keys", np.uint64), ("low", np.int64), ("high", np.int64), ("often", np.int32))


def summed(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, ascending, with its smallest and largest owner and how often it came."""
    if not len(keys):
        return keys, owner, owner, owner.astype(np.int32)
    order = np.argsort(keys)
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    often = np.diff(np.r_[first, len(keys)]).astype(np.int32)
    return keys[first], np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first), often


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Group of each key; ascending with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _split(block: int, columns: tuple[np.ndarray, ...], parts: int) -> pa.RecordBatch:
    part, begin = np.unique(part_of(columns[0], parts), return_index=True)
    pairs = list(zip(begin, np.r_[begin[1:], len(columns[0])], strict=True))
    return pa.record_batch(
        [part.astype(np.int64), np.full(len(part), block, np.int64)]
        + [[column[a:b].tobytes() for a, b in pairs] for column in columns],
        schema=_SENT,
    )


def _flat(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)


def answers(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys ascending, smallest owner, how often sent) of all answers to one block."""
    keys = _flat(rows, "keys", np.uint64)
    order = np.argsort(keys, kind="stable")
    return keys[order], *(_flat(rows, name, np.int64)[order] for name in ("low", "often"))


def lookup(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of each key among the ascending `known`."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[place] == keys, place


def with_answers(
    table: DataFrame, answer: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """`run(block row, its answer rows)` for every block, answered or not."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        return returned(run(left, right))

    return table.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(each, schema)


def total_size(table: DataFrame, column: str = "size") -> int:
    return table.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]

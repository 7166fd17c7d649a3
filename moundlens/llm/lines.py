"""Line dedup: an exact set-similarity join of all lines, by prefix, position and length filters.

The tokens of a line are its distinct shingles of five words (A-Z lowered). Two lines match when
the Jaccard similarity of their token sets is `THRESHOLD` (4/5) or more. A line goes when an
earlier line matches: one of a document with a smaller id, or one above it in the same document.
"Earlier" does not ask whether that line itself stays, so the result depends on no processing order.

Tokens are ordered by rarity: the sum of the logarithms of their words' frequencies over all
documents, counted in `COUNTERS` hashed counters, then by digest. Any order that is the same
everywhere keeps the join exact; rarity only keeps candidate lists short.

1. Lines with equal token sets form a class. One exchange finds the first document of each class;
   a line of a later document goes. What is left to ask is one question for a class: does a class
   that starts in an earlier document match it? (Lines of one document are compared in its block.)
2. A second exchange finds the prefix tokens that several classes have, and in how many lines.
3. Only those are joined. Lists longer than `LIST` entries are cut into parts, and every pair of a
   listed and an asking part is a group of its own. Candidates pass the length and position filters and a
   bitmap of 128 bits, in which two sets differ in no more places than they differ in tokens. A class
   takes the `FIRST` earliest candidates of a long list, and only if none of them is verified, all
   the others. So a crowd of variants of one line is settled by its first members.
4. Candidates are verified on their whole token sets.

Defined cases: a null text has no lines and stays null; lines with fewer than five words match
nothing; ids may repeat, and rows with the same id never precede one another; rows without an id
come last and never cost another row a line; the rest of the columns pass through.

`dedup_texts` is the same join over whole documents: each text is one line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from moundlens.llm import blocks
from moundlens.llm.common import durable, numbered, pick, read_table, returned, tidy
from moundlens.llm.words import LOWER, NOT_BLANK, mix, texts, window_starts, windows, words

SHINGLE = 5
THRESHOLD = (4, 5)
COUNTERS = 1 << 16
LIST = 20_000
FIRST = 2
_SLICES = 64  # the counters travel in this many rows for each task

ADDED = [
    T.StructField("n_lines", T.LongType()),
    T.StructField("removed", T.ArrayType(T.IntegerType())),  # line numbers from 0
    T.StructField("kept_text", T.StringType()),
]


class Rows:
    """The texts of one block and where their lines begin; `whole`: a text is a single line."""

    def __init__(self, batch: pa.RecordBatch, text_at: int, whole: bool = False):
        self.batch = batch
        self.data, offsets = texts(batch.column(text_at))
        if whole:
            self.offsets, self.first_line = offsets, np.arange(len(offsets))
            self.row = self.first_line[:-1]
            return
        breaks = np.flatnonzero(self.data == 10)
        start = np.sort(np.r_[offsets[:-1], breaks + 1])
        self.offsets = np.r_[start, len(self.data)]
        # a row has one line more than line breaks; empty lines share their offset with the next
        self.first_line = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
        self.row = np.searchsorted(self.first_line, np.arange(len(start)), side="right") - 1


class Sets:
    """The token sets of lines, each in the order of rarity; lines without tokens are left out.

    `whole`: a text of fewer words than a shingle has one token, all its words (or that it has none).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, weight: np.ndarray, whole: bool = False):
        found = words(LOWER[data], offsets, NOT_BLANK)
        starts = window_starts(found.first, SHINGLE)
        line = np.searchsorted(found.first, starts, side="right") - 1
        rarity = np.r_[0, np.cumsum(weight[found.digest & np.uint64(COUNTERS - 1)])]

        def tokens(starts: np.ndarray, size: int) -> np.ndarray:
            rare = (rarity[starts + size] - rarity[starts]).astype(np.uint64)
            return (rare << np.uint64(48)) | (windows(found.digest, size)[starts] >> np.uint64(16))

        token = tokens(starts, SHINGLE)
        if whole:
            short = [np.flatnonzero(found.counts == k) for k in range(SHINGLE)]
            some = [tokens(found.first[at], k) for k, at in enumerate(short) if k]
            token = np.concatenate([token, np.zeros(len(short[0]), np.uint64), *some])
            line = np.concatenate([line, *short])
        order = _by_line(line, token)
        token, line = token[order], line[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (line[1:] != line[:-1])][: len(token)]
        self.token, line = token[new], line[new]
        self.lines, begin = np.unique(line, return_index=True)
        self.begin = np.r_[begin, len(line)]
        self.size = np.diff(self.begin)
        mixed = mix(self.token)
        total = np.add.reduceat(mixed, begin) if len(begin) else mixed
        self.names = mix(total + self.size.astype(np.uint64))
        bit = np.uint64(1) << (mixed & np.uint64(63))
        half = (mixed >> np.uint64(6)) & np.uint64(1)
        for name, value in (("bits", bit * half), ("more", bit * (np.uint64(1) - half))):
            setattr(self, name, np.bitwise_xor.reduceat(value, begin) if len(begin) else value)

    def tokens(self, k: int) -> np.ndarray:
        return self.token[self.begin[k] : self.begin[k + 1]]

    def prefixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which line, token, position) of the prefix tokens of all lines."""
        top, bottom = THRESHOLD
        length = self.size - -(-self.size * top // bottom) + 1
        which = np.repeat(np.arange(len(self.size)), length)
        place = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length)
        return which, self.token[self.begin[which] + place], place


def _by_line(line: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Order by line, then token: one sort of packed keys, unless two tokens of a line tie in it."""
    if not len(line) or line.max() >= 1 << 20:
        return np.lexsort((token, line))
    key = (line.astype(np.uint64) << np.uint64(44)) | (token >> np.uint64(20))
    order = np.argsort(key)
    tie = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if (token[order[tie]] != token[order[tie + 1]]).any():
        return np.lexsort((token, line))
    return order


def matches(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * sum(THRESHOLD) >= THRESHOLD[0] * (len(a) + len(b))


def _fits(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Length, position and bitmap filters for lines that share a token at these places.

    Every token flips one of 128 bits, so the bits that differ are at most the tokens that differ.
    """
    top, bottom = THRESHOLD
    both = a["size"] + b["size"]
    most = np.minimum(a["place"], b["place"]) + np.minimum(a["size"] - a["place"], b["size"] - b["place"])
    apart = sum(np.bitwise_count(a[x] ^ b[x]).astype(np.int64) for x in ("bits", "more"))
    return (
        (a["size"] * bottom >= b["size"] * top)
        & (b["size"] * bottom >= a["size"] * top)
        & (most * (top + bottom) >= top * both)
        & ((both - apart) * (top + bottom) >= 2 * top * both)
    )


# ---- what is kept of every block: its lines with tokens, and the prefixes of distinct lines

_LINE = (("line", np.int64), ("owner", np.int64), ("name", np.uint64), ("gone", np.int64))
_PREFIX = (("line", np.int64), ("owner", np.int64), ("name", np.uint64), ("gone", np.int64), ("size", np.int64),
           ("bits", np.uint64), ("more", np.uint64), ("length", np.int64), ("token", np.uint64))
_SIGNED = "block long, lines binary, prefixes binary"
_SIGNED_ARROW = pa.schema([("block", pa.int64()), ("lines", pa.binary()), ("prefixes", pa.binary())])


def _packed(columns: list[np.ndarray]) -> bytes:
    """Arrays of any lengths in one compressed row."""
    row = pa.record_batch([pa.array([x.tobytes()]) for x in columns], names=[str(k) for k in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacked(data, kinds) -> dict[str, np.ndarray]:
    row = blocks.unpack(data)
    return {n: np.frombuffer(c[0].as_buffer(), kind) for c, (n, kind) in zip(row.columns, kinds, strict=True)}


def _signature(rows: Rows, ids: np.ndarray, weight: np.ndarray, whole: bool) -> tuple[bytes, bytes]:
    """(all lines with tokens; one line of each class with its prefix tokens)."""
    sets = Sets(rows.data, rows.offsets, weight, whole)
    line, owner = sets.lines.astype(np.int64), ids[rows.row[sets.lines]]
    gone = np.zeros(len(line), bool)
    which, token, place = sets.prefixes()
    if not whole:
        _same_row(rows, sets, which, token, place, gone)
    gone = gone.astype(np.int64)
    order = np.lexsort((line, owner, sets.names))
    named = sets.names[order]
    chosen = np.sort(order[np.r_[True, named[1:] != named[:-1]][: len(named)]])
    keep = np.zeros(len(line), bool)
    keep[chosen] = True
    length = np.bincount(which, minlength=len(line))[chosen]
    some = [x[chosen] for x in (line, owner, sets.names, gone, sets.size, sets.bits, sets.more)]
    return _packed([line, owner, sets.names, gone]), _packed([*some, length, token[keep[which]]])


class Prefixes:
    """One line of each class of a block, and its prefix tokens: which line, token, place."""

    def __init__(self, data):
        self.at = _unpacked(data, _PREFIX)
        length = self.at["length"]
        self.which = np.repeat(np.arange(len(length)), length)
        self.place = np.arange(len(self.which)) - np.repeat(np.cumsum(length) - length, length)
        self.token = mix(self.at["token"])


def _frequencies(table: DataFrame, text_at: int) -> np.ndarray:
    """Words over all documents in each hashed counter."""
    step = COUNTERS // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for data in batch.column(0):
                data, offsets = texts(blocks.unpack(data.as_buffer()).column(text_at))
                found = words(LOWER[data], offsets, NOT_BLANK)
                at = found.digest & np.uint64(COUNTERS - 1)
                total += np.bincount(at.astype(np.int64), minlength=COUNTERS)
        yield pa.record_batch(
            [np.arange(_SLICES), [total[k * step : (k + 1) * step].tobytes() for k in range(_SLICES)]],
            schema=pa.schema([("slice", pa.int64()), ("counts", pa.binary())]),
        )

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
        return pa.table([group.column("slice")[:1], [total.tobytes()]], names=["slice", "counts"])

    kind = "slice long, counts binary"
    sent = table.select("data").mapInArrow(tidy(count), kind).groupBy("slice").applyInArrow(add, kind)
    out = np.zeros(COUNTERS, np.int64)
    for k, counts in sent.collect():  # COUNTERS numbers at any corpus size
        out[k * step : (k + 1) * step] = np.frombuffer(bytes(counts), np.int64)
    return out


_ENTRY = (
    ("token", np.uint64), ("name", np.uint64), ("size", np.int64), ("place", np.int64), ("bits", np.uint64),
    ("more", np.uint64), ("owner", np.int64), ("line", np.int64), ("asks", np.int64), ("salt", np.int64),
)
_ENTRIES = "part long, block long, " + ", ".join(f"{name} binary" for name, _ in _ENTRY)
_ENTRIES_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int64())] + [(n, pa.binary()) for n, _ in _ENTRY])
# the asking line and the earlier one: block, line in the block, class
_PAIR_NAMES = ["block", "line", "name", "other_block", "other_line", "other", "cut"]
_PAIR = "block long, line long, name long, other_block long, other_line long, other long, cut boolean"
_PAIR_ARROW = pa.schema([(n, pa.int64()) for n in _PAIR_NAMES[:-1]] + [("cut", pa.bool_())])
_SHORT = 8  # lists of up to one entry more are compared all at once
_STRIDE = 4096


def _candidates(group: pa.Table, limit: int | None) -> pa.Table:
    """Pairs (asking line, earlier line) of one group that pass the filters.

    With a limit, only so many of a long list, in the order of owners; `cut` tells of more.
    """
    group = group.combine_chunks()
    sizes = np.array([len(x) // 8 for x in group.column("token").to_pylist()], np.int64)
    block = np.repeat(group.column("block").to_numpy(), sizes)
    e = {n: np.frombuffer(b"".join(group.column(n).to_pylist()), kind) for n, kind in _ENTRY}
    order = np.lexsort((block, e["owner"], e["salt"], e["token"]))
    e = {n: x[order] for n, x in (e | {"block": block}).items()}
    n = len(order)
    new = np.r_[True, (e["token"][1:] != e["token"][:-1]) | (e["salt"][1:] != e["salt"][:-1])]
    edge = np.r_[np.flatnonzero(new[:n]), n]
    length = np.repeat(np.diff(edge), np.diff(edge))
    of = np.cumsum(new[:n])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = (e["asks"][i] > 0) & (e["asks"][j] != 2) & (e["owner"][j] < e["owner"][i]) & (e["name"][i] != e["name"][j])
        a, b = ({k: e[k][x] for k in ("size", "place", "bits", "more")} for x in (i, j))
        return ok & _fits(a, b)

    for d in range(1, _SHORT + 1):
        i = np.flatnonzero((of[d:] == of[:-d]) & (length[d:] <= _SHORT + 1)) + d if n > d else order[:0]
        i = i[pairs(i, i - d)]
        found.append((i, i - d, np.zeros(len(i), bool)))
    for k in np.flatnonzero(np.diff(edge) > _SHORT + 1).tolist():
        lo, hi = int(edge[k]), int(edge[k + 1])
        for i in (lo + np.flatnonzero(e["asks"][lo:hi] > 0)).tolist():
            got: list[np.ndarray] = []
            total, j = 0, lo
            while j < i and (limit is None or total <= limit):
                some = np.arange(j, min(j + _STRIDE, i))
                got.append(some[pairs(np.full(len(some), i), some)])
                total += len(got[-1])
                j += _STRIDE
            if total:
                before = np.concatenate(got)
                cut = limit is not None and len(before) > limit
                before = before[:limit]
                found.append((np.full(len(before), i), before, np.full(len(before), cut)))
    i, j, cut = (np.concatenate(c) for c in zip(*found, strict=True))
    sides = [e[c][x].view(np.int64) for x in (i, j) for c in ("block", "line", "name")]
    return pa.table([*sides, cut], schema=_PAIR_ARROW)


def _sketch(token: np.ndarray) -> bytes:
    """Parities of a set: every token flips one of as many bits as the next power of two of its size."""
    bits = 1 << max(6, (len(token) - 1).bit_length())
    at = (mix(token) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def _may_match(a: bytes, b: bytes, both: int) -> bool:
    """The bitmap filter on sketches; the longer one is folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    top, bottom = THRESHOLD
    return (both - int(np.bitwise_count(x ^ y).sum())) * (top + bottom) >= 2 * top * both


def _sketched(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The pairs whose sketches do not rule them out."""
    arrow = to_arrow_schema(pairs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(x).to_pylist() for x in ("a", "b", "n", "m"))
            both = (x + y for x, y in zip(n, m, strict=True))
            keep = pa.array([_may_match(*x) for x in zip(a, b, both, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[: len(arrow)], schema=arrow).filter(keep)

    mine, theirs = drawn.toDF("block", "line", "a", "n"), drawn.toDF("other_block", "other_line", "b", "m")
    both = pairs.join(mine, ["block", "line"]).join(theirs, ["other_block", "other_line"])
    return both.select(*pairs.columns, "a", "b", "n", "m").mapInArrow(tidy(run), pairs.schema)


def _verified(table: DataFrame, pairs: DataFrame, text_at: int, weight, whole: bool) -> DataFrame:
    """(block, name) of the asking classes that match one of their candidates."""
    asking = ["block", "line", "name"]
    pairs = pairs.groupBy(*asking, "other").agg(F.min(F.struct("other_block", "other_line")).alias("o"))
    pairs = durable(pairs.select(*asking, "other", "o.*"), "line-pairs")

    def read(sketch: bool) -> DataFrame:
        """(block, line, tokens) of the lines of all pairs, or (block, line, sketch, size)."""
        other = pairs.select(F.col("other_block").alias("block"), F.col("other_line").alias("line"))
        wanted = pairs.select("block", "line").union(other).distinct()
        kinds = [("sketch", pa.binary()), ("size", pa.int64())] if sketch else [("tokens", pa.list_(pa.int64()))]
        schema = pa.schema([("block", pa.int64()), ("line", pa.int64()), *kinds])

        def sets(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows or not left.num_rows:
                return schema.empty_table()
            rows = Rows(blocks.unpack(left.column("data")[0].as_buffer()), text_at, whole)
            line = np.sort(right.column("line").to_numpy())
            size = rows.offsets[line + 1] - rows.offsets[line]
            offsets = np.r_[0, np.cumsum(size)]
            pieces = [rows.data[rows.offsets[k] : rows.offsets[k + 1]] for k in line.tolist()]
            found = Sets(np.concatenate(pieces), offsets, weight.value, whole)
            block = np.full(len(found.lines), left.column("block")[0].as_py())
            if sketch:
                drawn = [_sketch(found.tokens(k)) for k in range(len(found.lines))]
                return pa.table([block, line[found.lines], drawn, found.size], schema=schema)
            tokens = pa.ListArray.from_arrays(pa.array(found.begin, pa.int32()), pa.array(found.token.view(np.int64)))
            return pa.table([block, line[found.lines], tokens], schema=schema)

        named = "sketch binary, size long" if sketch else "tokens array<long>"
        return durable(blocks.with_answers(table, wanted, sets, f"block long, line long, {named}"), "line-sets")

    if whole:  # 128 bits tell nothing of sets of hundreds of tokens
        pairs = durable(_sketched(pairs, read(sketch=True)), "line-pairs-left")
    found = read(sketch=False)
    top, bottom = THRESHOLD
    mine = found.withColumnRenamed("tokens", "a")
    theirs = found.toDF("other_block", "other_line", "b")
    both = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(mine, ["block", "line"])
        .join(theirs, ["other_block", "other_line"])
        .where(both * (top + bottom) >= top * (F.size("a") + F.size("b")))
        .select("block", "name")
        .distinct()
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' columns, then the three of ADDED (the last three columns by position)."""
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    names = [*docs.columns, *(f.name for f in ADDED)]
    schema = T.StructType([*numbered(docs).schema.fields, *ADDED])
    arrow = to_arrow_schema(schema)

    def cut(rows: Rows, removed: np.ndarray) -> pa.RecordBatch:
        return _result(rows, removed, text_at, arrow)

    return _searched(numbered(docs), id_at, text_at, False, cut, schema).toDF(*names)


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose whole text matches no earlier one: the join of lines, a text being one line.

    Texts of fewer than five words match equal texts, and texts without words each other. Unlike
    lines, rows that share an id or have none do precede one another, in any order.
    """
    names, fields = docs.columns, numbered(docs).schema
    id_at, text_at = names.index(id_col), names.index(text_col)
    docs = numbered(docs)
    owner, place = F.col(f"c{id_at}"), f"c{len(names)}"
    order, owner_at = docs, id_at
    if not docs.groupBy(owner).count().where((F.col("count") > 1) | owner.isNull()).isEmpty():
        order = docs.orderBy(owner.asc_nulls_last(), F.xxhash64(f"c{text_at}"))
        order = durable(order.withColumn(place, F.monotonically_increasing_id()), "text-order")
        owner_at = len(names)

    def keep(rows: Rows, removed: np.ndarray) -> pa.RecordBatch:
        stay = np.ones(rows.batch.num_rows, bool)
        stay[removed] = False
        batch = rows.batch.filter(pa.array(stay))
        return pa.RecordBatch.from_arrays(batch.columns[: len(fields)], schema=to_arrow_schema(fields))

    return _searched(order, owner_at, text_at, True, keep, fields).toDF(*names)


def _searched(docs: DataFrame, id_at: int, text_at: int, whole: bool, cut: Callable[[Rows, np.ndarray], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """What `cut` makes of every block and its lines that match an earlier one."""
    table = blocks.pack(docs, "line-blocks")
    counts = _frequencies(table, text_at)
    weight = np.floor(np.log2(np.maximum(counts, 1)) * 16).astype(np.int64)
    weight = docs.sparkSession.sparkContext.broadcast(weight)
    size = blocks.total_size(table)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block"), batch.column("data"), strict=True):
                held = blocks.unpack(data.as_buffer())
                signed = _signature(Rows(held, text_at, whole), blocks.owners(held.column(id_at)), weight.value, whole)
                yield pa.record_batch([[block.as_py()], [signed[0]], [signed[1]]], _SIGNED_ARROW)

    signed = durable(table.mapInArrow(tidy(sign), _SIGNED), "line-signatures")

    def class_keys(data) -> blocks.Keys:
        found = _unpacked(data, _LINE)
        return found["name"], found["owner"]

    def prefix_keys(data) -> blocks.Keys:
        found = Prefixes(data)
        return found.token, found.at["name"][found.which].view(np.int64)

    same = blocks.shared_keys(signed, "lines", class_keys, size // 300, "line-classes")
    often = blocks.shared_keys(signed, "prefixes", prefix_keys, size // 40, "line-prefixes")
    parts = max(blocks.LEAST_PARTS, size // (4 << 20))
    told = same.withColumn("kind", F.lit(0)).union(often.withColumn("kind", F.lit(1)))
    asking, ask = ["block", "name"], signed.select("block", "prefixes")

    def met(told: DataFrame, limit: int | None, name: str) -> tuple[DataFrame, DataFrame]:
        entries = blocks.with_answers(ask, told, lambda a, b: _entries(a, b, parts, limit is None), _ENTRIES)
        pairs = entries.groupBy("part").applyInArrow(lambda g: returned(_candidates(g, limit)), _PAIR)
        pairs = durable(pairs, f"{name}-candidates")
        return pairs, durable(_verified(table, pairs, text_at, weight, whole), f"{name}-matches")

    early, near = met(told, FIRST, "line")
    open_ = early.where("cut").select(*asking).distinct().join(near, asking, "left_anti")
    nothing = F.lit(None).cast("binary")
    open_ = open_.select("block", F.col("name").cast("string").cast("binary").alias("keys"), nothing.alias("low"), nothing.alias("often"), F.lit(2).alias("kind"))
    open_ = durable(open_, "line-open")
    if not open_.isEmpty():  # only these ask again, without a limit
        near = near.union(met(told.union(open_), None, "line-late")[1])
    by_name = near.select("block", F.lit(1).alias("kind"), F.col("name").cast("string").cast("binary").alias("keys"), nothing.alias("low"))
    by_block = signed.select("block", F.lit(2), "lines", nothing)
    gone = same.select("block", F.lit(0).alias("kind"), "keys", "low").union(by_name).union(by_block)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = Rows(blocks.unpack(left.column("data")[0].as_buffer()), text_at, whole)
        kind = right.column("kind").to_numpy()
        of = [right.filter(pa.array(kind == k)) for k in range(3)]
        found = _unpacked(of[2].column("keys")[0].as_buffer(), _LINE)
        keys = np.frombuffer(b"".join(of[0].column("keys").to_pylist()), np.uint64)
        low = np.frombuffer(b"".join(of[0].column("low").to_pylist()), np.int64)
        order = np.argsort(keys, kind="stable")
        hit, at = blocks.lookup(found["name"], keys[order])
        removed = found["gone"] > 0
        removed[hit] |= low[order][at[hit]] < found["owner"][hit]
        near_ = np.array([int(x) for x in of[1].column("keys").to_pylist()], np.int64)
        removed |= np.isin(found["name"], near_.view(np.uint64))
        return pa.Table.from_batches([cut(rows, found["line"][removed])])

    return blocks.with_answers(table, gone, finish, schema)


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _entries(left: pa.Table, right: pa.Table, parts: int, late: bool) -> pa.Table:
    """What one block lists and asks under its shared prefix tokens."""
    first, listed, again = (right.filter(pc.field("kind") == k) for k in (0, 1, 2))
    if not listed.num_rows or not left.num_rows:
        return _ENTRIES_ARROW.empty_table()
    found = Prefixes(left.column("prefixes")[0].as_buffer())
    at = found.at
    known, low, _ = blocks.answers(first)
    hit, place = blocks.lookup(at["name"], known)
    asks = at["gone"] == 0
    asks[hit] &= low[place[hit]] >= at["owner"][hit]  # else an equal line is earlier
    if late:  # only what is still open
        names = np.array([int(x) for x in again.column("keys").to_pylist()], np.int64)
        asks &= np.isin(at["name"], names.view(np.uint64))
    known, _, often = blocks.answers(listed)
    hit, place = blocks.lookup(found.token, known)
    which, lists = found.which[hit], -(-often[place[hit]] // LIST)
    asks = asks[which].astype(np.int64)
    home = (mix(at["name"][which]) % lists.astype(np.uint64)).astype(np.int64)
    e = [found.token[hit], at["name"][which], at["size"][which], found.place[hit], at["bits"][which],
         at["more"][which], at["owner"][which], at["line"][which], asks, home]
    split = np.flatnonzero(lists > 1)
    if len(split):
        # A list of L parts makes L * L groups, one for each pair (part listed, part asking): every
        # entry is listed in the groups of its row and asks in those of its column.
        count, own = lists[split], home[split]
        rep, other = np.repeat(split, count), _ranges(count)
        mine, many = np.repeat(own, count), np.repeat(count, count)
        both = mine == other
        listed_at = [*(x[rep] for x in e[:-2]), np.where(both, asks[rep], 0), mine * many + other]
        asking = np.flatnonzero(~both & (asks[rep] > 0))
        asks_at = [*(x[rep[asking]] for x in e[:-2]), np.full(len(asking), 2, np.int64), (other * many + mine)[asking]]
        alone = lists == 1
        e = [np.concatenate([x[alone], a, b]) for x, a, b in zip(e, listed_at, asks_at, strict=True)]
    part = blocks.part_of(mix(e[0] + e[-1].astype(np.uint64)), parts).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, e = part[order], [x[order] for x in e]
    name, begin = np.unique(part, return_index=True)
    cut = list(zip(begin, np.r_[begin[1:], len(part)], strict=True))
    block = np.full(len(name), left.column("block")[0].as_py())
    return pa.table([name, block, *([x[a:b].tobytes() for a, b in cut] for x in e)], schema=_ENTRIES_ARROW)


def _same_row(rows: Rows, sets: Sets, which, token, place, removed: np.ndarray) -> None:
    """Marks lines that match a line above them in the same document."""
    row = rows.row[sets.lines][which]
    order = np.lexsort((which, token, row))
    a, b = order[:-1], order[1:]
    met = (token[a] == token[b]) & (row[a] == row[b])
    if not met.any():
        return
    edge = np.flatnonzero(np.r_[True, ~met, True])
    for k in np.flatnonzero(np.diff(edge) > 1).tolist():
        group = order[edge[k] : edge[k + 1]]
        lines = which[group]
        seen: dict[int, int] = {}
        for g, line in zip(group.tolist(), lines.tolist(), strict=True):
            name = int(sets.names[line])
            if name in seen:
                removed[line] = True
            elif not removed[line]:
                above = np.fromiter(seen.values(), np.int64, len(seen))
                other = which[above]
                mine, theirs = (
                    {"size": sets.size[x], "place": place[y], "bits": sets.bits[x], "more": sets.more[x]}
                    for x, y in ((line, g), (other, above))
                )
                fit = other[_fits(mine, theirs)] if len(above) else other
                own = sets.tokens(line)
                removed[line] = any(matches(own, sets.tokens(j)) for j in fit.tolist())
            seen.setdefault(name, g)


def _result(rows: Rows, lines: np.ndarray, text_at: int, arrow: pa.Schema) -> pa.RecordBatch:
    batch = rows.batch
    column = batch.column(text_at)
    gone: list[list[int]] = [[] for _ in range(batch.num_rows)]
    for line in np.sort(lines).tolist():
        row = int(rows.row[line])
        gone[row].append(line - int(rows.first_line[row]))
    missing = column.is_null().to_numpy(zero_copy_only=False)
    counts = np.where(missing, 0, np.diff(rows.first_line))
    kept = column.cast(pa.string())
    if len(lines):
        whole = kept.to_pylist()
        for row, some in enumerate(gone):
            if some:
                drop = set(some)
                parts = whole[row].split("\n")
                whole[row] = "\n".join(x for k, x in enumerate(parts) if k not in drop)
        kept = pa.array(whole, pa.string())
    added = [pa.array(counts, pa.int64()), pa.array(gone, pa.list_(pa.int32())), kept]
    return pa.RecordBatch.from_arrays([*batch.columns, *added], schema=arrow)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' columns with the matching lines cut; documents left without a line go."""
    n, at = len(docs.columns), docs.columns.index(text_col)
    found = find(docs, id_col, text_col).toDF(*(f"c{k}" for k in range(n + len(ADDED))))
    emptied = (F.size(f"c{n + 1}") > 0) & (F.size(f"c{n + 1}") == F.col(f"c{n}"))
    kept = [F.col(f"c{n + 2}" if k == at else f"c{k}").alias(x) for k, x in enumerate(docs.columns)]
    return found.where(~emptied).select(*kept)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines, lines removed and the text left, for every document."""
    docs = pick(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return find(docs).select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )

"""SimHash near-dedup by the generalised pigeonhole principle.

The fingerprint of a text has 64 bits: a bit is 1 if it is set in over half of the XXH64 digests
(seed 42) of its shingles, repeats included. Documents link when their fingerprints differ in at
most `distance` bits; components of links are the groups.

Fingerprints are first made distinct, so copies cost one row each and nothing more. The 64 bits
are split into partitions of correlated bits, and every partition i gets a threshold t_i with
sum(t_i) = distance - partitions + 1 (-1: not probed). Two fingerprints within the distance then
agree up to t_i bits in some partition i. A dynamic program over the partitions chooses the
thresholds with the lowest estimated work, for several numbers of partitions; the estimates come
from the counts of all partition values. Every fingerprint is listed under its value of each
probed partition and probes all values within t_i bits; each meeting is verified.

Lists are walked, not joined: inside one, an unvisited fingerprint is compared with all unvisited
ones at a time, so a crowd of near copies yields a chain of links as long as the crowd and never
all its pairs. A list of more than `LIST` rows would be too much for a task. The fingerprints that
meet there go another exact way: two of them differ in at most two bits if and only if some 64-bit
value is within one bit of both, so each writes itself and its 64 neighbours, and no more than 65
can meet. Distances above 2 are not supported for that reason.

Defined cases: null and empty texts have the fingerprint zero and link like any other; repeated
rows and ids share their group; a null id is never the name of a group unless all ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from moundlens.llm.common import durable, numbered, pick, read_table, returned, tidy
from moundlens.llm.components import components

SHINGLE = 5
QUERY_SHINGLE = 3  # of the registered query and the pipeline's stage
DISTANCE = 2
SEED = 42
LIST = 20_000  # the most fingerprints that are compared with each other in one task
ROWS_PER_PART = 50_000
PARTITIONS = (2, 3, 4)
PER_ROW = 200.0
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle: int) -> int:
    parts = text.encode().translate(_LOWER).split()  # the six ASCII blanks end words
    if not parts:
        return 0
    ones, total = np.zeros(64, np.int64), 0
    for lo in range(0, max(1, len(parts) - shingle + 1), 1 << 16):  # bounded memory for long texts
        some = parts[lo : lo + (1 << 16) + shingle - 1]
        joined = b" ".join(some)
        n = max(1, len(some) - shingle + 1)
        ends = np.cumsum([len(w) + 1 for w in some])
        last = ends[min(shingle, len(some)) - 1 :].tolist()
        begin = [0, *ends[: n - 1].tolist()]
        digest = xxhash.xxh64_intdigest
        h = [digest(joined[a : b - 1], SEED) for a, b in zip(begin, last, strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += n
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, out: str = "fp") -> DataFrame:
    """The documents' columns and their fingerprint as a signed 64-bit number."""
    at, names = docs.columns.index(text_col), [*docs.columns, out]
    docs = numbered(docs)
    schema = T.StructType([*docs.schema.fields, T.StructField("out", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x or "", shingle) for x in batch.column(at).to_pylist()]
            values = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], schema=arrow)

    return docs.mapInArrow(tidy(run), schema).toDF(*names)


# ---- partitions and thresholds


def _agreement(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(fingerprints, 64 x 64 counts of pairs of set bits): fixed in size, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(values), 1 << 16):
                part = values[lo : lo + (1 << 16)]
                bits = (part[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
                total += np.rint(bits.T @ bits).astype(np.int64)
                n += len(part)
        cells = np.r_[total.ravel(), n]
        yield pa.record_batch([np.arange(4097), cells], names=["cell", "n"])

    sums = fps.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(4097, np.int64)
    for cell, n in sums.collect():
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits split into `parts` groups of near equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    link = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, out = list(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, out))) // (parts - k)
        # start with the most lopsided bit left: skewed bits belong together
        group = [max(free, key=lambda b: (abs(p[b] - 0.5), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (link[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and the lowest cost: dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (sofar, chosen) in best.items():
            for t, c in cost.items():
                new = (sofar + c, [*chosen, t])
                if spent + t not in step or new < step[spent + t]:
                    step[spent + t] = new
        best = step
    return best[total]


def _value(bits: list[int]):
    """The bits of one partition, the others cleared."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def plan(fps: DataFrame, distance: int, choices: tuple[int, ...] = PARTITIONS) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the partitions to probe, by estimated rows and candidates."""
    n, both = _agreement(fps)
    p = np.diag(both) / max(n, 1)
    apart = 2 * p * (1 - p)  # chance that two fingerprints differ in a bit
    designs = [group_bits(n, both, m) for m in choices]
    groups = [g for design in designs for g in design]
    keyed = F.explode(F.array(*(F.struct(F.lit(k).alias("g"), _value(g).alias("v")) for k, g in enumerate(groups))))
    counts = fps.select(keyed.alias("x")).select("x.*").groupBy("g", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # comparing two numbers costs a small part of what writing a row does
    work = F.when(F.col("n") > LIST, F.col("n") * 65).otherwise(F.col("n") * F.col("n") / PER_ROW)
    meet = {r.g: r.work for r in counts.groupBy("g").agg(F.sum(work).alias("work")).collect()}
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    at = 0
    for m, design in zip(choices, designs, strict=True):
        costs = []
        for k, bits in enumerate(design):
            # chance of exactly d differing bits in the partition, were its bits independent
            chance = np.array([1.0])
            for b in bits:
                chance = np.convolve(chance, [1 - apart[b], apart[b]])
            same = meet.get(at + k, 0.0)
            ratio = np.cumsum(chance[: distance + 1]) / max(chance[0], 1e-300)
            cost = {-1: 0.0}
            for t in range(min(distance, len(bits)) + 1):
                probes = sum(comb(len(bits), d) for d in range(t + 1))
                cost[t] = n * probes + same * ratio[t]
            costs.append(cost)
        at += m
        work, chosen = allocate(costs, distance - m + 1)
        if best is None or work < best[0]:
            best = work, [(g, t) for g, t in zip(design, chosen, strict=True) if t >= 0]
    return best[1]


# ---- links


def _flips(bits: list[int], radius: int) -> list[int]:
    masks = [sum(1 << b for b in some) for d in range(radius + 1) for some in combinations(bits, d)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _probes(fps: DataFrame, index: int, bits: list[int], radius: int) -> DataFrame:
    """(g, v, fp): the partition values within `radius` bits of a fingerprint's own."""
    masks = F.explode(F.array(*(F.lit(m).cast("long") for m in _flips(bits, radius))))
    probes = fps.select(F.lit(index).alias("g"), "fp", masks.alias("m"))
    return probes.select("g", _value(bits).bitwiseXOR(F.col("m")).alias("v"), "fp")


def _walk(rows: pa.Table, distance: int) -> pa.Table:
    """Links that connect, inside each list (g, v), what is within the distance."""
    rows = rows.combine_chunks()
    g, v, fp = (rows.column(c).to_numpy() for c in ("g", "v", "fp"))
    order = np.lexsort((fp, v, g))
    g, v, fp = g[order], v[order], fp[order].view(np.uint64)
    edge = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]), True])
    size = np.diff(edge)
    found: list[tuple[np.ndarray, np.ndarray]] = [(fp[:0], fp[:0])]
    first = edge[:-1][size == 2]  # by far most lists: all at once
    first = first[np.bitwise_count(fp[first] ^ fp[first + 1]) <= distance]
    found.append((fp[first], fp[first + 1]))
    for k in np.flatnonzero(size > 2).tolist():
        left = np.unique(fp[edge[k] : edge[k + 1]])
        todo: list[np.uint64] = []
        while len(left):
            if todo:
                here = todo.pop()
            else:
                here, left = left[0], left[1:]
            close = np.bitwise_count(left ^ here) <= distance
            if close.any():
                met, left = left[close], left[~close]
                found.append((np.full(len(met), here), met))
                todo.extend(met)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    low, high = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
    return pa.table([low[low < high], high[low < high]], names=["a", "b"])


def _apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): verified links between distinct fingerprints that span all groups of links."""
    if distance not in (0, 1, 2):
        raise ValueError("distance is 0, 1 or 2")
    asked = None
    for k, (bits, radius) in enumerate(plan(fps, distance)):
        some = _probes(fps, k, bits, radius)
        asked = some if asked is None else asked.union(some)
    asked = durable(asked, "simhash-probes")
    lists = asked.groupBy("g", "v").count()
    crowd = durable(lists.where(F.col("count") > LIST).select("g", "v"), "simhash-crowds")
    usual = asked.join(crowd, ["g", "v"], "left_anti")
    parts = max(256, asked.count() // ROWS_PER_PART)
    part = F.pmod(F.xxhash64("g", "v"), F.lit(parts)).cast("int")
    near = usual.select(part.alias("part"), "g", "v", "fp").groupBy("part")
    near = near.applyInArrow(lambda rows: returned(_walk(rows, distance)), "a long, b long").distinct()
    dense = asked.join(crowd, ["g", "v"], "left_semi").select("fp").distinct()
    around = _probes(dense, 0, list(range(64)), 1).select("v", "fp")
    if distance < 2:  # meeting is then necessary, not sufficient
        around = durable(around, "simhash-around")
        back = around.select("v", F.col("fp").alias("b"))
        met = around.withColumnRenamed("fp", "a").join(back, "v")
        met = met.where((F.col("a") < F.col("b")) & (_apart("a", "b") <= distance))
        return durable(near.union(met.select("a", "b").distinct()), "simhash-links")
    first = around.groupBy("v").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
    star = first.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    return durable(near.union(star), "simhash-links")


def _named(table: DataFrame, distance: int) -> DataFrame:
    """(fp, root, component_id): the group of every distinct fingerprint of (doc_id, fp)."""
    fps = durable(table.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = components(links(fps, distance), "simhash")
    known = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    known = known.withColumn("root", F.coalesce("root", "fp"))
    named = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return known.join(named, "root").select("fp", "root", "component_id")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest id that links reach from it."""
    mine = pick(docs, doc_id=id_col, text=text_col)
    table = durable(fingerprints(mine, "text", shingle).drop("text"), "simhash-fingerprints")
    return table.join(_named(table, distance), "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents' columns; of every group the row with the smallest id (one, if ids repeat)."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = durable(fingerprints(docs.toDF(*names), text, shingle), "simhash-rows")
    table = rows.select(F.col(key).alias("doc_id"), "fp")
    known = durable(_named(table, distance), "simhash-groups")
    first = table.join(known, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    known = known.join(first.groupBy("root").count(), "root")
    kept = rows.join(known, "fp").where(F.col(key).eqNullSafe(F.col("component_id")))
    alone = kept.where("count = 1").select(*names)
    tied = kept.where("count > 1").dropDuplicates(["root"]).select(*names)
    return alone.union(tied).toDF(*docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of shingles of three words, and the groups within two bits."""
    found = groups(read_table(spark, sf_dir, "documents"), shingle=QUERY_SHINGLE)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

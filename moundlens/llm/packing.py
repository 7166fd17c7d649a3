"""Best-fit packing of token sequences under several capacities at once.

A document is its token ids and an end mark, cut into pieces only where it is longer than a sequence.
A piece needs `length` tokens, one document and `length`^2 of attention cost; a sequence (bin) has a
capacity of each. Pieces are taken in decreasing length. Each goes to the bin, among those with room
in every capacity, with the best score:

- `norm`: the smallest weighted norm of what would be left, each capacity measured against its limit;
- `dot`: the smallest weighted dot product of the piece's needs and the bin's residuals.

Needs depend on the length alone, so the choice of bins is made on the histogram of lengths, never on
the pieces: bins in the same state are one run (so many bins, one state), and all pieces of a length
meet the runs in order of score. A bin just chosen has less left than before in every capacity, so
its score stays the best until it has no room: a run takes as many pieces as fit into each of its
bins, in one step, and only the last run of a length is split. A sequence of T tokens knows T lengths
and so at most 4 T runs, whatever the number of documents: that is all the driver ever holds, and
the result is that of packing all pieces of all documents one by one. Spark numbers the pieces of
each length (a count per task and length, running sums over the tasks) and looks up their places.

Defined cases: null and empty texts are a piece of the end mark alone. Repeated rows and ids are
packed each. A text of any length is walked in stretches that end at a blank. An empty table has no
pieces. All columns but the text are carried along, by position, so names may clash.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema

from moundlens.llm.bpe import _byte_of_char
from moundlens.llm.common import durable, numbered, pick, read_table, tidy

END = 1
# The pattern by which tokenizers with word ends cut their normal form, as their files hold it.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STRETCH = 1 << 18  # bytes of text split into words at a time
WORD_BYTES = 64  # longer words are forgotten at once
CACHED = 500_000  # words in one of the two sets that a worker remembers; the older one is forgotten
ROWS = 200  # rows handed on together


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence; None for those that its tokens bound already (a piece has a token at
    least, and squares sum to no more than the square of the sum). `weights` score them."""

    tokens: int
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)

    @property
    def capacity(self) -> np.ndarray:
        full = (self.tokens, self.documents or self.tokens, self.attention or self.tokens**2)
        if min(full) < 1:
            raise ValueError("capacities are positive")
        return np.array(full, np.int64)

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that fits into an empty sequence."""
        return min(self.tokens, isqrt(int(self.capacity[2])))


# ---- tokens

_MARK = "\x01"  # ends a word inside the merging engine; no plain word holds it
# characters whose class is beyond doubt, as they come and in normal form
_RAW = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u017f]+")
_PLAIN = re.compile("[\x21-\x7e\xdf-\xf6\xf8-\u017f]+")
_STOPS = (b",", b".", b";", b":", b"!", b"?", b"|")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\u017f]+")


class WordEncoder:
    """Token ids of whole texts by looking up their words.

    The tokenizer separates at blanks and cuts words into parts that it merges by themselves. Words
    not met before are put into the tokenizer's normal form; plain ones, of printable ASCII and
    European letters, are cut here and merged by tiktoken, which is given the merges with the end of
    a word as a byte of its own. That merges alike if every token is what its own bytes merge to,
    which `check` holds against the file. All other words go to the tokenizers library.
    """

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["end_of_word_suffix"] != "</w>" or split["pattern"]["Regex"] != PARTS:
            raise ValueError("only tokenizer files that mark word ends by </w> and cut words as expected")
        byte = _byte_of_char()

        def raw(token: str) -> bytes:
            ended = token.endswith("</w>")
            return bytes(byte[c] for c in (token[:-4] if ended else token)) + _MARK.encode() * ended

        # a byte at the end of a word comes first: there it is a symbol of its own from the start
        single = [c for c, b in byte.items() if b != 1]
        order = [c + "</w>" for c in single] + single
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        joint = [a + b for a, b in merges]
        ranks = {raw(t): k for k, t in enumerate(order + joint)}
        if len(ranks) != len(order) + len(joint):
            raise ValueError("two merges make the same token")
        self.merges, self.joint = merges, joint
        self.ids = np.array([model["vocab"][t] for t in order + joint] + [0], np.uint32)
        self.ends = np.array([t.endswith("</w>") for t in order + joint] + [False])
        self.engine = tiktoken.Encoding(
            "words", pat_str=f"[^{_MARK}]+{_MARK}", mergeable_ranks=ranks | {b"\x01": len(ranks)}, special_tokens={}
        )
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def check(self) -> None:
        """Every token is made by the merges that come before it from its own bytes."""
        rank = {tuple(pair): k for k, pair in enumerate(self.merges)}
        for token in self.joint:
            ended = token.endswith("</w>")
            some = list(token[:-4] if ended else token)
            some[-1] += "</w>" * ended
            while len(some) > 1:
                found = [rank.get(pair, len(rank)) for pair in zip(some, some[1:], strict=False)]
                best = min(found)
                if best == len(rank):
                    raise ValueError(f"token {token!r} is not what its bytes merge to")
                k = found.index(best)
                some[k : k + 2] = [self.joint[best]]

    def _learn(self, words: list[bytes]) -> None:
        """Puts the ids of new words into the cache."""
        # ASCII letters alone, then those before one stop; all of a kind are put together at once
        plain = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        ended = [w for w in rest if w[-1:] in _STOPS and w[:-1].isalpha()]
        mark = _MARK.encode()
        joined = [w + mark for w in plain] + [w[:-1] + mark + w[-1:] + mark for w in ended]
        parts = [b"".join(joined).lower().decode()]
        sizes = [1] * len(plain) + [2] * len(ended)  # how many parts a word has
        other = [w for w in rest if not (w[-1:] in _STOPS and w[:-1].isalpha())]
        plain += ended
        text = [w.decode() for w in other]
        raw = [k for k, x in enumerate(text) if _RAW.fullmatch(x) and "<|" not in x]  # no other blanks, no marks
        normal = self.library.normalizer.normalize_str(" ".join([text[k] for k in raw])).split(" ") if raw else []
        sure = {k: _PARTS.findall(x) for k, x in zip(raw, normal, strict=True) if _PLAIN.fullmatch(x)}
        plain.extend(other[k] for k in sure)
        parts.extend(_MARK.join(x) + _MARK for x in sure.values())
        sizes.extend(map(len, sure.values()))
        self.cache.update(zip(plain, self._merged("".join(parts), sizes), strict=True))
        if rest := [k for k in range(len(other)) if k not in sure]:
            found = self.library.encode_batch_fast([text[k] for k in rest], add_special_tokens=False)
            self.cache.update((other[k], struct.pack(f"<{len(e.ids)}I", *e.ids)) for k, e in zip(rest, found, strict=True))

    def _merged(self, parts: str, sizes: list[int]) -> Iterator[bytes]:
        """Ids of words, given their parts with marks one after the other, and how many each has."""
        found = np.array(self.engine.encode_ordinary(parts), np.int64)
        stop = np.r_[0, np.flatnonzero(self.ends[found]) + 1]
        upto = (stop[np.r_[0, np.cumsum(sizes, dtype=np.int64)]] * 4).tolist()
        ids = self.ids[found].astype("<u4").tobytes()
        return (ids[a:b] for a, b in zip(upto, upto[1:], strict=False))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            data = text.encode()
            if len(data) > STRETCH:
                yield from self._encode(group)
                group, size = [], 0
                yield b"".join(x for part in _stretches(data) for x in self._encode([part]))
                continue
            group.append(data)
            size += len(data)
            if size > STRETCH:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, texts: list[bytes]) -> Iterator[bytes]:
        # split() cuts at the six ASCII blanks; lower case has fewer words, and in ASCII it is the normal form
        cut = [(x.lower() if x.isascii() and b"<|" not in x else x).split() for x in texts]
        distinct = set().union(*cut)
        new = [w for w in distinct if w not in self.cache]
        if len(self.cache) + len(new) > CACHED:
            self.older, self.cache = self.cache, {}
            new = list(distinct)
        if self.older:
            self.cache.update((w, self.older[w]) for w in new if w in self.older)
            new = [w for w in new if w not in self.older]
        if new:
            self._learn(new)
        for words in cut:
            yield b"".join(map(self.cache.__getitem__, words))
        for w in new:
            if len(w) > WORD_BYTES:
                del self.cache[w]


def _stretches(data: bytes) -> Iterator[bytes]:
    """The text in pieces that end before a blank."""
    at = 0
    while len(data) - at > STRETCH:
        cut = [k for k in (data.find(b, at + STRETCH) for b in (b" ", b"\n")) if k >= 0]
        if not cut:
            break
        yield data[at : min(cut)]
        at = min(cut)
    yield data[at:]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


ADDED = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("part", T.LongType()),
    T.StructField("nth", T.LongType()),
]


def pieces(docs: DataFrame, path: str, longest: int, text_col: str = "text") -> DataFrame:
    """Durable table of the documents' other columns c0, c1, ... and of each piece: its number, first
    token, length, ids and their CRC-32, and its place among the equally long ones of its task."""
    word_encoder(path).check()
    at = docs.columns.index(text_col)
    docs = numbered(docs)
    kept = [k for k in range(len(docs.columns)) if k != at]
    schema = T.StructType([*(docs.schema.fields[k] for k in kept), *ADDED])
    arrow = to_arrow_schema(schema)
    end = struct.pack("<I", END)

    def cut(ids: bytes) -> Iterable[tuple[int, bytes]]:
        return enumerate(ids[k : k + 4 * longest] for k in range(0, len(ids), 4 * longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_encoder(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(longest + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                row, made = [], []
                for k, found in enumerate(known.encode(x.as_py() or "" for x in some.column(at))):
                    for piece, ids in cut(found + end):
                        n = len(ids) // 4
                        row.append(k)
                        made.append((piece, piece * longest, n, ids, zlib.crc32(ids), part, int(seen[n])))
                        seen[n] += 1
                carried = [some.column(k).take(pa.array(row, pa.int32())) for k in kept]
                columns = [pa.array(c, arrow.field(len(kept) + j).type) for j, c in enumerate(zip(*made, strict=True))]
                yield pa.RecordBatch.from_arrays([*carried, *columns], schema=arrow)

    return durable(docs.mapInArrow(tidy(run), schema), "packing-pieces")


# ---- bins


def plan(histogram: dict[int, int], limits: Limits, rule: str = "norm") -> tuple[np.ndarray, int]:
    """(slots, bins): rows (length, first, count, bin, per_bin, offset) say that the `count` pieces of
    a length from the `first` on lie `per_bin` to a bin, from `bin` on, each bin's from `offset` on."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is 'norm' or 'dot'")
    capacity = limits.capacity
    weight = np.array(limits.weights, float) / capacity.astype(float) ** 2
    first_bin, bins = np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.zeros((0, 3), np.int64)
    slots, made = [], 0
    for length in sorted(histogram, reverse=True):
        count, need = histogram[length], np.array([length, 1, length**2], np.int64)
        if (need > capacity).any():
            raise ValueError("a piece is larger than a sequence")
        fits = (left // need).min(axis=1)
        open_ = np.flatnonzero(fits > 0)
        rest = left[open_] - need
        score = ((rest * rest.astype(float) if rule == "norm" else need * left[open_].astype(float)) * weight).sum(axis=1)
        order = open_[np.lexsort((first_bin[open_], score))]
        room = np.cumsum(bins[order] * fits[order])
        taken = order[: np.searchsorted(room, count) + 1]
        given, new = 0, []
        for run in taken.tolist():
            per, n = int(fits[run]), min(count - given, int(bins[run] * fits[run]))
            slots.append((length, given, n, first_bin[run], per, capacity[0] - left[run, 0]))
            given += n
            new += _parts(int(first_bin[run]), int(bins[run]), left[run], need, per, n)
        if given < count:  # empty sequences for the rest
            per = int((capacity // need).min())
            fresh = -(-(count - given) // per)
            slots.append((length, given, count - given, made, per, 0))
            new += _parts(made, fresh, capacity, need, per, count - given)
            made += fresh
        stay = np.ones(len(bins), bool)
        stay[taken] = False
        some = [x for x in new if x[2].min() > 0]
        first_bin = np.r_[first_bin[stay], np.array([x[0] for x in some], np.int64)]
        bins = np.r_[bins[stay], np.array([x[1] for x in some], np.int64)]
        left = np.concatenate([left[stay], *(x[2][None] for x in some)])
    return np.array(slots, np.int64).reshape(-1, 6), made


def _parts(first: int, bins: int, left: np.ndarray, need: np.ndarray, per: int, n: int) -> list[tuple[int, int, np.ndarray]]:
    """A run after n pieces, `per` to a bin: full bins, one with what is over, untouched ones."""
    full, over = divmod(n, per)
    out = [(first, full, left - per * need), (first + full, int(over > 0), left - over * need)]
    out.append((first + full + (over > 0), bins - full - (over > 0), left))
    return [x for x in out if x[1] > 0]


def place(made: DataFrame, limits: Limits, rule: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to a table of `pieces`."""
    counts = durable(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n"))  # a row a length: at most limits.longest
    slots, _ = plan({r.length: r.n for r in histogram.collect()}, limits, rule)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    # (length, first) as one ascending number would need more than 64 bits: look up in two steps
    lengths, begin = np.unique(slots[:, 0], return_index=True)
    begin = np.r_[begin, len(slots)]
    to = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @arrow_udf(to)
    def where(length: pa.Array, nth: pa.Array) -> pa.Array:
        size, rank = length.to_numpy(), nth.to_numpy()
        row = np.zeros(len(size), np.int64)
        for x in np.unique(size).tolist():
            at, k = np.flatnonzero(size == x), int(np.searchsorted(lengths, x))
            mine = slots[begin[k] : begin[k + 1], 1]
            row[at] = begin[k] + np.searchsorted(mine, rank[at], "right") - 1
        found = slots[row]
        turn = rank - found[:, 1]
        sequence = found[:, 3] + turn // found[:, 4]
        offset = found[:, 5] + turn % found[:, 4] * size
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    known = counts.select("part", "length", before.alias("before"))
    others = [c for c in made.columns if c not in ("part", "nth")]
    found = made.join(known, ["part", "length"]).withColumn("_to", where("length", F.col("nth") + F.col("before")))
    return found.select(*others, "_to.sequence_id", "_to.offset")


def pack(docs: DataFrame, path: str, limits: Limits, rule: str = "norm", text_col: str = "text") -> DataFrame:
    """The documents' columns but the text, then piece, start, length, ids, ids_crc32, sequence_id
    and offset, a row for each piece."""
    names = [c for k, c in enumerate(docs.columns) if k != docs.columns.index(text_col)]
    placed = place(pieces(docs, path, limits.longest, text_col), limits, rule)
    return placed.toDF(*names, *placed.columns[len(names) :])


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): the sequences themselves, with the offsets at which pieces start.
    A group holds one sequence, so no more tokens than its limit."""
    last = packed.select(*(F.col(c) for c in ("sequence_id", "offset", "ids")))
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = last.groupBy("sequence_id").agg(inside.alias("inside"))
    joined = F.aggregate("inside", F.lit(b""), lambda sofar, x: F.concat(sofar, x["ids"]))
    return whole.select("sequence_id", joined.alias("ids"), F.col("inside.offset").alias("starts"))


PRODUCTION = Limits(tokens=4096)  # tokens alone are limited; documents and attention only score


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_packing(spark, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 4,096 tokens."""
    docs = pick(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return pack(docs, default_path(), PRODUCTION).drop("ids")

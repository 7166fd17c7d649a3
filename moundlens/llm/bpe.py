"""Byte-level BPE encoding by speculation, and decoding.

A text is cut into pieces by the tokenizer's pattern. For every distinct piece, greedy longest
match proposes tokens. A sequence of tokens is what merging would have given exactly when every
token is what its own bytes merge to and every two neighbours are what their joint bytes merge to;
so one vectorised look-up of all adjacent pairs accepts a proposal, and only pieces with a failing
pair are merged exactly. The verdicts on pairs are kept, as each needs exact merging once.

Special tokens inside a text are recognised as the tokenizer file has them. A null text is an
empty one: no tokens, an empty decoded text. Texts of any length are walked in stretches cut
between a non-blank and a blank character, where every piece ends whatever surrounds it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from moundlens.llm.common import numbered, pick, read_table, tidy

# The pattern of byte-level tokenizers whose file says `use_regex`, as their library documents it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRETCH = 1 << 18  # characters handled at a time
SHORT = 32  # bytes of a piece for which merging by plain scans is the faster way
_NONE = (1 << 62, -1)
PORTION = 4 << 20  # bytes of texts or ids handed on together
CACHED = 400_000  # pieces whose tokens a worker remembers; beyond that it starts afresh


def _byte_of_char() -> dict[str, int]:
    """The printable alphabet of byte-level vocabularies: every byte has one character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and what has been learnt about pairs of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cutter = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and cutter["type"] == "ByteLevel" and cutter["use_regex"]
        if not plain or spec["normalizer"] or cutter["add_prefix_space"] or model["dropout"]:
            raise ValueError("only byte-level BPE files without normalizer or prefix space")
        byte = _byte_of_char()
        as_bytes = {t: bytes(byte[c] for c in t) for t in model["vocab"]}
        self.ids = {as_bytes[t]: i for t, i in model["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge = {}
        for rank, (a, b) in enumerate(merges):
            joint = self.ids[as_bytes[a] + as_bytes[b]]
            self.merge[self.ids[as_bytes[a]], self.ids[as_bytes[b]]] = rank, joint
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not supported")
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pieces = regex.compile(PATTERN)
        self.longest: dict[bytes, int] = {}
        for token in self.ids:
            head = token[:2]
            self.longest[head] = max(self.longest.get(head, 1), len(token))
        self.known = np.zeros(0, np.uint64)  # pairs judged so far, ascending, and the verdicts
        self.verdict = np.zeros(0, bool)
        self.cache: dict[str, bytes] = {}  # ids as they are returned

    def exact(self, data: bytes) -> list[int]:
        """Tokens by merging: the lowest rank first, the leftmost of equals."""
        if len(data) <= SHORT:
            return self._exact_short(data)
        ids: list[int | None] = [self.ids[data[k : k + 1]] for k in range(len(data))]
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        heap = []
        for k in range(len(ids) - 1):
            if (found := self.merge.get((ids[k], ids[k + 1]))) is not None:
                heap.append((found[0], k, ids[k], ids[k + 1]))
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != left or nxt >= len(ids) or ids[nxt] != right:
                continue  # one of the two has been merged since
            ids[k], ids[nxt] = self.merge[left, right][1], None
            after[k] = after[nxt]
            if after[k] < len(ids):
                before[after[k]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else len(ids)
                if b < len(ids) and (found := self.merge.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (found[0], a, ids[a], ids[b]))
        return [i for i in ids if i is not None]

    def _exact_short(self, data: bytes) -> list[int]:
        """The same by scanning all pairs for each merge, which is faster for a few bytes."""
        merge = self.merge.get
        ids = [self.ids[data[k : k + 1]] for k in range(len(data))]
        found = [merge(pair, _NONE) for pair in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is _NONE:
                break
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = merge((ids[k - 1], ids[k]), _NONE)
            if k < len(found):
                found[k] = merge((ids[k], ids[k + 1]), _NONE)
        return ids

    def propose(self, data: bytes) -> list[int]:
        """Greedy longest match from the left."""
        if (whole := self.ids.get(data)) is not None:
            return [whole]
        out, at, n = [], 0, len(data)
        known, longest = self.ids.get, self.longest.get
        while at < n:
            size = min(longest(data[at : at + 2], 1), n - at)
            while (token := known(data[at : at + size])) is None:
                size -= 1
            out.append(token)
            at += size
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each left << 32 | right: do the joint bytes merge to just these two tokens?

        right = 2**32 - 1 asks whether the left token is what its own bytes merge to.
        """
        distinct, back = np.unique(pairs, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != distinct[inside]
        if fresh.any():
            judged = [self._judge(int(p)) for p in distinct[fresh]]
            keys = np.r_[self.known, distinct[fresh]]
            verdict = np.r_[self.verdict, np.array(judged, bool)]
            order = np.argsort(keys)
            self.known, self.verdict = keys[order], verdict[order]
        return self.verdict[np.searchsorted(self.known, distinct)][back]

    def _judge(self, pair: int) -> bool:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        ids = [left] if right == 0xFFFFFFFF else [left, right]
        return self.exact(b"".join(self.bytes[i] for i in ids)) == ids

    def learn(self, pieces: list[str]) -> None:
        """Puts the tokens of new pieces into the cache."""
        data = [p.encode() for p in pieces]
        proposed = [self.propose(d) for d in data]
        size = np.fromiter(map(len, proposed), np.int64, len(proposed))
        ids = np.fromiter(chain.from_iterable(proposed), np.uint64, int(size.sum()))
        last = np.cumsum(size) - 1
        right = np.r_[ids[1:], np.uint64(0)]
        right[last] = np.uint64(0xFFFFFFFF)  # a token is asked for by itself at the end of a piece
        alone = self.compatible((ids << np.uint64(32)) | np.uint64(0xFFFFFFFF))
        good = alone & ((right == np.uint64(0xFFFFFFFF)) | self.compatible((ids << np.uint64(32)) | right))
        failing = np.unique(np.searchsorted(last, np.flatnonzero(~good)))
        for k in failing.tolist():
            proposed[k] = self.exact(data[k])
        for piece, tokens in zip(pieces, proposed, strict=True):
            self.cache[piece] = pack(f"<{len(tokens)}I", *tokens)

    def _stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > 2 * STRETCH:
            cut = _BOUNDARY.search(text, at + STRETCH)
            if cut is None:
                break
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Token ids of each text, as little-endian unsigned 32-bit integers."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= STRETCH:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        cut: list[list[list[str] | int]] = []
        for text in texts:
            if len(text) > 2 * STRETCH:
                yield from self._flush(cut)
                cut = []
                yield b"".join(self._ids([self._cut(x)]) for x in self._stretches(text))
            else:
                cut.append(self._cut(text))
        yield from self._flush(cut)

    def _flush(self, cut: list) -> Iterator[bytes]:
        if cut:
            self._know(cut)
            for parts in cut:
                yield self._ids([parts], known=True)

    def _cut(self, text: str) -> list[list[str] | int]:
        if self.split_special is None or not self.split_special.search(text):
            return [self.pieces.findall(text)]
        parts = self.split_special.split(text)
        return [self.special[p] if k % 2 else self.pieces.findall(p) for k, p in enumerate(parts)]

    def _know(self, cut: list) -> None:
        if len(self.cache) > CACHED:
            self.cache.clear()
        need = set()
        for parts in cut:
            for part in parts:
                if not isinstance(part, int):
                    need.update(part)
        if new := [p for p in need if p not in self.cache]:
            self.learn(new)

    def _ids(self, cut: list, known: bool = False) -> bytes:
        if not known:
            self._know(cut)
        out: list[bytes] = []
        for parts in cut:
            for part in parts:
                if isinstance(part, int):
                    out.append(pack("<I", part))
                else:
                    out.extend(map(self.cache.__getitem__, part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        found = map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(found).decode("utf-8", "replace")


# A blank after a character that is none: no piece and no special token runs across it.
_BOUNDARY = regex.compile(r"\S(?=[ \n])")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _with(df: DataFrame, column: str, added: list[T.StructField], of) -> DataFrame:
    """The columns of `df` and those of `added`, computed from the values of a column."""
    at, names = df.columns.index(column), [*df.columns, *(f.name for f in added)]
    df = numbered(df)
    schema = T.StructType([*df.schema.fields, *added])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _portions(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                found = zip(of(part.column(at)), arrow.types[-len(added) :], strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, t in found)], schema=arrow)

    return df.mapInArrow(tidy(run), schema).toDF(*names)


def _portions(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `PORTION` bytes each, one row at least."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    upto, lo = np.cumsum(sizes, dtype=np.int64), 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PORTION, "right")))
        yield lo, hi
        lo = hi


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds the token ids as binary: little-endian unsigned 32-bit integers, one after the other."""

    def of(column: pa.Array) -> list[list[bytes]]:
        texts = (x or "" for x in column.to_pylist())
        return [list(vocabulary(path).encode(texts))]

    return _with(df, text_col, [T.StructField(out, T.BinaryType())], of)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of the token ids in a column made by `encode`; null ids are none."""

    def of(column: pa.Array) -> list[list[str]]:
        known = vocabulary(path)
        return [[known.decode(x or b"") for x in column.to_pylist()]]

    return _with(df, ids_col, [T.StructField(out, T.StringType())], of)


def encode_checked(df: DataFrame, path: str, text_col: str = "text", names: tuple[str, str] = ("ids", "round_trip")) -> DataFrame:
    """Adds the token ids, and whether the text decoded from them is the text (of a null: empty).

    Both in one Python worker a task: a worker for each would hold the vocabulary twice.
    """

    def of(column: pa.Array) -> tuple[list[bytes], list[bool]]:
        known, texts = vocabulary(path), [x or "" for x in column.to_pylist()]
        ids = list(known.encode(texts))
        return ids, [known.decode(i) == x for i, x in zip(ids, texts, strict=True)]

    added = [T.StructField(names[0], T.BinaryType()), T.StructField(names[1], T.BooleanType())]
    return _with(df, text_col, added, of)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of the text decoded from those ids."""
    docs = pick(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    tokens = encode(docs, default_path()).drop("text")
    return decode(tokens, default_path()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )

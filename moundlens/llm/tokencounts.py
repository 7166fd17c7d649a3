"""Token counts of whole texts, however long, by overlapping chunks.

A text of at most `CHUNK` characters is encoded at once. A longer one is cut into chunks that
overlap; each is encoded by itself, with the offsets of its tokens. Neighbouring encodings are
spliced at a boundary that both have inside the overlap and that is proven stable: a blank
character after one that is none. No piece of the tokenizer's pattern and no special token runs
across such a place, and what follows it does not depend on what precedes it, so from there on
both encodings are that of the whole text. The blank has to lie inside the earlier chunk too, so
that nothing before the boundary can have been cut short by that chunk's end. Where the overlap has no such boundary, it is widened, twice as long each
time, until it has one or the chunk reaches the end of the text.

Counts equal those of the tokenizers library for the same file, special tokens recognised as it
does. The merging itself is done by tiktoken's byte-pair encoder, given the vocabulary of the file;
that is the same tokenization when ids rise in the order of the merges, which is checked.

Defined cases: null and empty texts have no tokens and no bytes; a blank-free text of any length is
one chunk in the end, with the right count; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from moundlens.llm.bpe import PATTERN, Vocabulary, default_path
from moundlens.llm.common import numbered, pick, read_table

CHUNK = 16_384  # characters of a chunk's own part
OVERLAP = 256  # characters by which it runs into the next
LIMIT = 512
_STABLE = regex.compile(r"(?<=\S)[ \n]")


class Encoder:
    def __init__(self, path: str):
        known = Vocabulary(path)
        joint = [i for _, i in known.merge.values()]
        if joint != sorted(joint) or len(known.ids) != 256 + len(joint):
            raise ValueError("ids do not rise in the order of the merges")
        plain = {b: i for b, i in known.ids.items()}
        self.engine = tiktoken.Encoding(
            "file", pat_str=PATTERN, mergeable_ranks=plain, special_tokens=known.special
        )
        self.size = np.zeros(max(known.bytes) + 1, np.int64)
        for i, b in known.bytes.items():
            self.size[i] = len(b)

    def encode(self, text: str) -> list[int]:
        return self.engine.encode(text, allowed_special="all")

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets at which tokens start, and the byte offset of every character."""
        starts = np.r_[0, np.cumsum(self.size[self.encode(text)])]
        data = np.frombuffer(text.encode(), np.uint8)
        return starts, np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) <= chunk:
            return len(self.encode(text))
        total, lo = 0, 0  # tokens up to `lo`, a proven boundary of the whole text
        here = self._chunk(text, lo, chunk + overlap)
        while here[0] < len(text):
            reach, starts, chars = here
            wide = overlap
            while True:
                nxt_lo = max(reach - wide, lo + 1)
                splice = self._splice(text, lo, here, nxt_lo, chunk)
                if splice is not None or reach >= len(text):
                    break
                wide *= 2  # no common boundary: let this chunk run further and look again
                here = reach, starts, chars = self._chunk(text, lo, reach - lo + wide)
            if splice is None:
                break
            at, tokens, here = splice
            total, lo = total + tokens, at
        return total + len(here[1]) - 1

    def _chunk(self, text: str, lo: int, size: int) -> tuple[int, np.ndarray, np.ndarray]:
        part = text[lo : lo + size]
        return lo + len(part), *self.offsets(part)

    def _splice(self, text: str, lo: int, here, nxt_lo: int, chunk: int):
        """(boundary, tokens before it, the next chunk's encoding from it), or None."""
        reach, starts, chars = here
        places = [m.start() for m in _STABLE.finditer(text, nxt_lo, reach)]
        mine = [p for p in places if _has(starts, chars[p - lo])]
        if not mine:
            return None
        end, other, bytes_ = self._chunk(text, nxt_lo, reach - nxt_lo + chunk)
        for p in mine:
            k = _has(other, bytes_[p - nxt_lo])
            if k:
                tokens = int(np.searchsorted(starts, chars[p - lo]))
                rest = bytes_[p - nxt_lo :] - bytes_[p - nxt_lo]
                return p, tokens, (end, other[k - 1 :] - other[k - 1], rest)
        return None


def _has(starts: np.ndarray, at: int) -> int:
    """1 + place of `at` among the token starts, or 0."""
    k = int(np.searchsorted(starts, at))
    return k + 1 if k < len(starts) and starts[k] == at else 0


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


ADDED = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]


def token_counts(docs: DataFrame, path: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The documents' columns, then n_bytes (UTF-8) and n_tokens."""
    at, names = docs.columns.index(text_col), [*docs.columns, *(f.name for f in ADDED)]
    docs = numbered(docs)
    schema = T.StructType([*docs.schema.fields, *ADDED])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            column = batch.column(at)
            size = pc.binary_length(column.cast(pa.large_binary())).fill_null(0).cast(pa.int64())
            counts = [known.count(x.as_py() or "", chunk, overlap) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, size, pa.array(counts, pa.int64())], schema=arrow)

    return docs.mapInArrow(run, schema).toDF(*names)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = pick(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = token_counts(docs, default_path())
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

"""Token counts of whole texts with public tokenizers, huge texts by overlapping chunks.

The byte-level vocabulary is applied by ``tiktoken`` (the same ranks and pattern as
the library's file, several times as fast); the file's own special strings count as
the one token that the library makes of them by default.

Overlap resynchronisation of a huge text: chunks that overlap are encoded apart,
each with the byte offsets of its tokens. Two neighbours are spliced at a boundary
that both have and that is proven stable: a break between pre-tokens that the
pattern makes whatever stands further left or right of a bounded context. If the
overlap has no such boundary, it is widened until it has, at worst to the rest of the text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK, OVERLAP = 50_000, 1_000
LIMIT = 1024
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def byte_encoding(ranks_file: str, pattern: str):
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def default_encoding():
    import public_tokenizers as P

    return byte_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


#: Behind a letter and before a space, a line's end or a mark of punctuation that begins no contraction and is in no
#: special string, the pattern always begins a pre-token: none that has letters goes on behind them, and none
#: that begins there depends on what stands before it. Scripts without spaces have such places too.
_STABLE = re.compile(r"(?<=[^\W\d_])(?=[ \n]|[^\w\s'<|>\x00-\x1f\x7f-\x9f])")
#: Characters at either end of an overlap in which no boundary is looked for.
MARGIN = 16


@lru_cache(maxsize=4)
def _token_sizes(encoding) -> np.ndarray:
    """Bytes of each token."""
    sizes = np.zeros(encoding.n_vocab, np.int64)
    for token in encoding.token_byte_values():
        sizes[encoding.encode_single_token(token)] = len(token)
    sizes[encoding.encode_single_token(SPECIAL)] = len(SPECIAL)
    return sizes


def token_offsets(encoding, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of ``text`` and the byte offset of each token's begin."""
    ids = np.array(encoding.encode(text, allowed_special="all"), np.int64)
    ends = np.cumsum(_token_sizes(encoding)[ids])
    return ids, np.concatenate(([0], ends))[:-1] if len(ids) else np.zeros(0, np.int64)


def encode_long(encoding, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of ``text``, equal to encoding it at once, with memory for offsets of two chunks only.

    A chunk without a stable boundary is doubled, so that the work stays in proportion to the text.
    """
    if len(text) <= chunk + overlap:
        return encoding.encode(text, allowed_special="all")
    out: list[int] = []
    skip, begin, end = 0, 0, chunk
    ids, at = token_offsets(encoding, text[:end])
    while end < len(text):
        width, got = min(overlap, end - begin), None
        while got is None:
            first = end - width
            places = _STABLE.finditer(text, first + MARGIN, max(first + MARGIN, end - MARGIN))
            if (place := next(places, None)) is not None:
                stop = min(len(text), first + max(chunk, 2 * width))
                right_ids, right_at = token_offsets(encoding, text[first:stop])
                base, begins = len(text[begin:first].encode()), len(text[first : place.start()].encode())
                while place is not None:
                    i, j = int(np.searchsorted(at, base + begins)), int(np.searchsorted(right_at, begins))
                    if i < len(at) and j < len(right_at) and at[i] == base + begins and right_at[j] == begins:
                        got = i, j
                        break
                    last = place.start()
                    if (place := next(places, None)) is not None:
                        begins += len(text[last : place.start()].encode())
            if got is None:
                if width == end - begin:
                    break
                width = min(4 * width, end - begin)  # alignment failed: widen
        if got is None:  # no stable boundary in the whole chunk
            end = min(len(text), begin + 2 * (end - begin))
            ids, at = token_offsets(encoding, text[begin:end])
            continue
        out += ids[skip : got[0]].tolist()
        skip, begin, end, ids, at = got[1], first, stop, right_ids, right_at
    return out + ids[skip:].tolist()


def count_tokens(texts: list[str | None], chunk: int = CHUNK) -> np.ndarray:
    encoding = default_encoding()
    return np.array([0 if not t else len(encode_long(encoding, t, chunk)) if len(t) > chunk + OVERLAP else len(encoding.encode(t, allowed_special="all")) for t in texts], dtype=np.int64)


def _count(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = count_tokens(texts)
            size = np.array([len((t or "").encode()) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, a row for each of ``docs``.

    Null and empty text: 0 bytes, 0 tokens. Null ids and repeated rows are kept as
    they are, a table without rows gives none, and texts of any length are counted whole; other columns aren't read.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_count(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Token counts with overlap resynchronisation.

A huge document is encoded in overlapping chunks with character offsets. Two neighbours are
spliced at a character where both encodings start a token and which is proven stable: a single
space between two printable ASCII characters or Latin letters, which normalisation leaves alone. No piece of the vocabulary holds the space mark after
another character (checked on the loaded vocabulary), so no merge can ever cross that place and
both sides are encoded independently. An overlap without such a place is widened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from .common import session

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK, OVERLAP = 16_384, 512  # characters
_STABLE = re.compile("(?<=[!-~\u00c0-\u024f]) (?=[!-~\u00c0-\u024f])")
_SLICE = 64
_LOADED: dict[str, object] = {}


def processor(path: str):
    if path not in _LOADED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        marks = [sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())]
        _LOADED[path] = sp, not any("▁" in m or " " in m for m in marks)
    return _LOADED[path]


def starts(sp, text: str) -> np.ndarray:
    """Character offsets where the tokens of ``text`` start."""
    return np.array([b for b, _ in sp.encode(text, return_type="offset_mapping")["offsets"]], np.int64)


def long_count(sp, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of ``text``, by chunks; equal to encoding it whole."""
    total, begin, since, n = 0, 0, 0, len(text)
    while True:
        end = min(n, begin + chunk)
        here = begin + starts(sp, text[begin:end])
        if end == n:
            return total + int((here >= since).sum() if since else len(here))
        width = overlap
        while True:  # find a place in the overlap, or widen it
            nxt = max(since + 1, end - width)
            follow = nxt + starts(sp, text[nxt:min(n, end + 64)])
            both = np.intersect1d(here, follow)
            both = both[(both > nxt) & (both > since) & (both < end - 1)]
            stable = {m.start() for m in _STABLE.finditer(text, nxt, end)}
            place = next((int(p) for p in both if int(p) in stable), None)
            if place is not None:
                break
            if nxt <= since + 1:  # nothing stable in the whole chunk: read on
                end = min(n, end + (end - begin))
                here = begin + starts(sp, text[begin:end])
                if end == n:
                    return total + int((here >= since).sum() if since else len(here))
                width = (end - begin) // 2
            else:
                width *= 4
        total += int(((here >= since) & (here < place)).sum() if since else (here < place).sum())
        begin, since = nxt, place


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, proven = processor(path)
        for batch in batches:
            texts, counts = batch.column("text").to_pylist(), np.zeros(batch.num_rows, np.int64)
            huge = [i for i, t in enumerate(texts) if len(t) > CHUNK and proven]
            for i in huge:
                counts[i] = long_count(sp, texts[i])
            rest = np.setdiff1d(np.arange(len(texts)), huge)
            for i in range(0, len(rest), _SLICE):
                part = rest[i:i + _SLICE]
                counts[part] = [len(x) for x in sp.encode([texts[k] for k in part], return_type="numpy", num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs`` (doc_id, text).

    A null text counts as empty: no bytes, no tokens. Ids are passed through, null or repeated.
    """
    session(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(_count(model_path or public_tokenizers.path(MODEL)), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)

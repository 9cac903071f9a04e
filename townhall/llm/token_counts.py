"""Token counts by overlap resynchronisation.

A huge document is cut into chunks that overlap on both sides. Each chunk is encoded by itself with
offsets, and neighbouring encodings are spliced at a boundary that both have and that is proven
stable: a place whose two neighbouring characters never stand side by side inside any piece of the
vocabulary. A merge only ever makes a piece of the vocabulary, so no merge crosses such a place and
the encodings on its two sides don't depend on each other. Where an overlap holds no such place, the
overlap is widened (fourfold, in the end to the whole document) and the document is done again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.llm.common import materialize, slices

#: Characters of a chunk, and of the overlap on each side of its borders.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 256
#: Chunks of huge documents that one task encodes between shuffles, at least.
WIDEN = 4
SPACE, MARK = " ", "▁"


class _Pieces:
    """The library's encoder with what splicing needs: bytes of each piece, and the stable places."""

    def __init__(self, model: str):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.encoder.id_to_piece(i) for i in range(self.encoder.get_piece_size())]
        self.width = np.array([1 if self.encoder.is_byte(i) else len(p.replace(MARK, SPACE).encode()) for i, p in enumerate(pieces)])
        self.joined = {p[i : i + 2].replace(MARK, SPACE) for p in pieces for i in range(len(p) - 1)}

    def splice(self, text: str, at: int, until: int) -> int:
        """The first stable place in text from `at` on and before `until`; -1: there is none."""
        return next((i for i in range(max(at, 1), min(until, len(text))) if text[i - 1 : i + 1] not in self.joined), -1)

    def starts(self, text: str) -> np.ndarray:
        """The byte offsets at which the tokens of the text start; the added first space is at -1."""
        ids = np.asarray(self.encoder.encode(text), dtype=np.int64)
        return np.cumsum(self.width[ids]) - self.width[ids] - 1


@lru_cache(maxsize=2)
def _pieces(model: str) -> _Pieces:
    return _Pieces(model)


def count_between(pieces: _Pieces, text: str, lead: int, nominal: int, overlap: int, first: bool, last: bool) -> int:
    """Tokens of a chunk between its two splices, -1 if a splice isn't found or isn't a token border.

    text: the chunk with `lead` characters of overlap before it; nominal: its length without overlaps."""
    text = text.replace(MARK, SPACE)  # the encoder takes both for the same
    a = 0 if first else pieces.splice(text, lead, lead + overlap)
    b = len(text) if last else pieces.splice(text, lead + nominal, lead + nominal + overlap)
    if a < 0 or b < 0:
        return -1
    starts = pieces.starts(text)
    at = -1 if first else len(text[:a].encode())
    to = len(text.encode()) if last else len(text[:b].encode())
    if not (first or at in starts) or not (last or to in starts):
        return -1
    return int(np.searchsorted(starts, to) - np.searchsorted(starts, at))


def _count_whole(model: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _pieces(model).encoder
        for b in slices(batches, "text"):
            n = [len(x) for x in encoder.encode([t or "" for t in b.column("text").to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return count


def _cut(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, digest, n_bytes, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "n_bytes", "text")), strict=True):
                n = max(1, -(-len(text) // chunk))
                for at in range(0, n, 64):
                    ks = range(at, min(n, at + 64))
                    lead = [min(k * chunk, overlap) for k in ks]
                    parts = [text[k * chunk - x : (k + 1) * chunk + overlap] for k, x in zip(ks, lead, strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([doc_id] * len(ks), pa.int64()), "digest": pa.array([digest] * len(ks), pa.string()), "n_bytes": pa.array([n_bytes] * len(ks), pa.int64()),
                        "k": pa.array(list(ks), pa.int64()), "last": pa.array([k == n - 1 for k in ks]), "lead": pa.array(lead, pa.int64()), "part": pa.array(parts, pa.string()),
                    })

    return cut


def _count_chunks(model: str, chunk: int, overlap: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for b in slices(batches, "part"):
            cols = [b.column(c).to_pylist() for c in ("part", "lead", "k", "last")]
            n = [count_between(pieces, part, lead, chunk, overlap, k == 0, last) for part, lead, k, last in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "digest", "n_bytes", "k")), pa.array(n, pa.int64())], ["doc_id", "digest", "n_bytes", "k", "n_tokens"])

    return count


def token_counts(docs: DataFrame, model: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens: the tokens of every whole text as the library gives them.

    docs: doc_id and text; other columns don't matter, whatever their names. A null text counts as
    empty: no bytes, no tokens. Null ids and repeated rows each keep their row. An empty table gives
    an empty result. Texts over chunk_chars go through overlapping chunks, which are dealt over all
    tasks; a document of any length never has to be encoded by one task, unless it holds no stable
    place in reach.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = "doc_id long, n_bytes long, n_tokens long"
    short = rows.filter(F.length("text") <= chunk_chars).mapInArrow(_count_whole(model), counted)

    long_rows = rows.filter(F.length("text") > chunk_chars).withColumn("digest", F.sha2("text", 256))
    done, overlap, left = None, overlap_chars, long_rows
    while True:
        size = max(chunk_chars, 4 * overlap)
        cut = left.mapInArrow(_cut(size, overlap), "doc_id long, digest string, n_bytes long, k long, last boolean, lead long, part string")
        spread = cut.repartition(F.xxhash64("doc_id", "digest", "k"))
        parts = spread.mapInArrow(_count_chunks(model, size, overlap), "doc_id long, digest string, n_bytes long, k long, n_tokens long")
        # repeated rows have the same chunks: each chunk stands there as often as the row
        found = materialize(
            parts.groupBy("doc_id", "digest", "n_bytes").agg(
                F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("k") == 0).alias("copies"), F.min("n_tokens").alias("least")
            ),
            "token-counts",
        )
        good = found.filter("least >= 0").select("doc_id", "n_bytes", F.expr("n_tokens div copies").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
        done = good if done is None else done.unionByName(good)
        failed = found.filter("least < 0").select("doc_id", "digest")
        if failed.isEmpty():
            return short.unionByName(done)
        overlap *= WIDEN
        keys = failed.select(F.col("doc_id").alias("f_id"), F.col("digest").alias("f_digest"))
        left = long_rows.join(keys, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest")), "left_semi")

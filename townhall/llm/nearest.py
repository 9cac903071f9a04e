"""Maximum inner product search with score-aware anisotropic quantisation and exact reranking.

Vectors are cut into subspaces of SUB components, each coded with four bits. Codes and codebooks
minimise a loss that weighs the part of the residual along the vector more than the part across it,
since only the former moves the inner product with queries that the vector is a near neighbour of.
A scan adds up table entries, two codes a byte; the best of each block are scored exactly again.
Queries and rows meet in a grid of bounded blocks, so no task and no broadcast holds more than two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townhall.llm.common import materialize

SUB, CODES = 2, 16
#: The bound of the training sample, and rows and queries of a block, about.
SAMPLE_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 8_192, 16_000, 4_096
#: Queries of a block whose tables are held at a time.
TABLES = 256
#: Rows of each block that are scored exactly, for each query: times the wanted neighbours.
RERANK = 8
#: Rows whose scanned score lies so many deviations of its error (by the row's own residual) under the k-th exact one are scored exactly, too.
DEVIATIONS = 3.0
#: Inner products over this share of the norms are those that the weights are made for.
THRESHOLD = 0.2


@dataclass
class Codebooks:
    """books (subspaces, codes, SUB), and the weight of the parallel residual over the orthogonal one."""

    books: np.ndarray
    extra: float

    def start(self, x: np.ndarray) -> np.ndarray:
        parts = x.reshape(len(x), -1, SUB)
        return np.stack([((parts[:, m, None, :] - self.books[m][None]) ** 2).sum(2).argmin(1) for m in range(parts.shape[1])], 1)

    def assign(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent on the anisotropic loss."""
        parts, codes = x.reshape(len(x), -1, SUB), self.start(x)
        weight = self.extra / np.maximum((x**2).sum(1), 1e-30)
        for_code = [parts[:, m] @ self.books[m].T for m in range(parts.shape[1])]
        norms = (parts**2).sum(2)
        rows = np.arange(len(x))
        along = sum(norms[:, m] - for_code[m][rows, codes[:, m]] for m in range(parts.shape[1]))
        for _ in range(sweeps):
            for m in range(parts.shape[1]):
                own = norms[:, m, None] - for_code[m]
                rest = along - own[rows, codes[:, m]]
                across = norms[:, m, None] - 2 * for_code[m] + (self.books[m] ** 2).sum(1)[None]
                codes[:, m] = (across + weight[:, None] * (rest[:, None] + own) ** 2).argmin(1)
                along = rest + own[rows, codes[:, m]]
        return codes.astype(np.uint8)


def train_codebooks(x: np.ndarray, threshold: float = THRESHOLD, rounds: int = 6, seed: int = 5) -> Codebooks:
    """Codebooks for rows of x: assignments and weighted least squares for each code, in turn."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    extra = max(0.0, (d - 1) * threshold**2 / (1 - threshold**2) - 1)
    parts = x.reshape(len(x), -1, SUB)
    books = np.stack([p[rng.choice(len(p), CODES, replace=len(p) < CODES)] for p in parts.transpose(1, 0, 2)]).astype(np.float64)
    cb = Codebooks(books, extra)
    weight = extra / np.maximum((x**2).sum(1), 1e-30)
    for _ in range(rounds):
        codes = cb.assign(x)
        rec = np.stack([cb.books[m][codes[:, m]] for m in range(parts.shape[1])], 1)
        along = ((parts - rec) * parts).sum((1, 2))
        for m in range(parts.shape[1]):
            p = parts[:, m]
            rest = along - ((p - rec[:, m]) * p).sum(1)
            for k in range(CODES):
                i = codes[:, m] == k
                if not i.any():
                    cb.books[m, k] = p[rng.integers(len(p))]
                    continue
                a = np.eye(SUB) * i.sum() + (p[i] * weight[i, None]).T @ p[i]
                b = p[i].sum(0) + (p[i] * (weight[i] * (rest[i] + (p[i] ** 2).sum(1)))[:, None]).sum(0)
                cb.books[m, k] = np.linalg.solve(a, b)
            rec[:, m] = cb.books[m][codes[:, m]]
            along = rest + ((p - rec[:, m]) * p).sum(1)
    return cb


def usable(c: Column | str) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    v = F.col(c) if isinstance(c, str) else c
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _padded(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * SUB))))


def _pack(cb: Codebooks | None):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x = _padded(pdf["embedding"])
        codes, spread = b"", b""
        if cb is not None:
            c = cb.assign(x)
            read = np.stack([cb.books[m][c[:, m]] for m in range(c.shape[1])], 1).reshape(x.shape)
            spread = np.sqrt(((x - read) ** 2).mean(1)).astype(np.float32).tobytes()
            codes = np.ascontiguousarray((c[:, 0::2] << 4 | c[:, 1::2]).T).tobytes()
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "codes": [codes], "spread": [spread]})

    return pack


def best_of(approximate: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest, and of all that equal the last of them: near copies share their codes."""
    if n >= len(approximate):
        return np.arange(len(approximate))
    return np.flatnonzero(approximate >= np.partition(approximate, len(approximate) - n)[len(approximate) - n])


def _scan(cb: Codebooks, k: int, rerank: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64)
                x = x.reshape(len(ids), -1)
                codes, spread = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(ids)), np.frombuffer(row["spread"], np.float32)
                q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"], np.float64)
                q = q.reshape(len(q_ids), -1)
                for start in range(0, len(q), TABLES):
                    some = slice(start, start + TABLES)
                    tables = np.einsum("qms,mks->qmk", q[some].reshape(len(q[some]), -1, SUB), cb.books).astype(np.float32)
                    pairs = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(tables), len(codes), -1)
                    out = []
                    for query, v, table in zip(q_ids[some], q[some], pairs, strict=True):
                        about = table[0].take(codes[0])
                        for m in range(1, len(codes)):
                            about += table[m].take(codes[m])
                        first = best_of(about, rerank * k + 1)
                        sure = np.sort((x[first] * v).sum(1))[-min(k + 1, len(first))]
                        # all that may yet be nearer: the scan errs by the residual's share of the query
                        at = np.union1d(first, np.flatnonzero(about + DEVIATIONS * np.sqrt((v**2).sum()) * spread >= sure))
                        at = at[ids[at] != query]
                        exact = (x[at] * v).sum(1)
                        order = np.lexsort((ids[at], -exact))
                        best = order[np.sort(np.unique(ids[at][order], return_index=True)[1])][:k]  # the best row of each id
                        out.append((np.full(len(best), query), ids[at][best], exact[best]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return scan


def nearest(vectors: DataFrame, queries: Column, k: int = 20, sample_rows: int = SAMPLE_ROWS, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets the condition `queries`, the k rows with the largest inner products.

    vectors: vec_id, embedding; other columns don't matter. Rows without id, and embeddings that are null,
    zero, or hold null or non-finite components, take no part; neither do those of another length than
    the most frequent one. A row is no neighbour of a query with its own id; an id on several rows is
    listed once, with its best score. Fewer than k others: all of them; ties go to the smaller id. The
    codebooks learn from a bounded sample of sample_rows vectors, chosen by the hash of the id; every row
    is indexed and scanned. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable("embedding")).distinct()  # a repeated row is one
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.count_if(queries).alias("q")).orderBy(F.desc("n"), "d").first()
    if sizes is None or not sizes["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == sizes["d"])
    h = F.pmod(F.xxhash64("vec_id", F.lit("books")), F.lit(1 << 40))
    sample = rows.filter(h < sample_rows / sizes["n"] * (1 << 40)).orderBy("vec_id").toPandas()
    if not len(sample):
        sample = rows.limit(sample_rows).toPandas()
    cb = train_codebooks(_padded(sample["embedding"]))

    n_blocks = math.ceil(sizes["n"] / BLOCK_ROWS)
    # few blocks of rows have more blocks of queries, so that every core has a cell or two
    n_queries = max(math.ceil(sizes["q"] / BLOCK_QUERIES), min(sizes["q"], math.ceil(2 * spark.sparkContext.defaultParallelism / n_blocks)))
    block = lambda df, n, salt: df.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int"))
    packed = "block int, ids binary, vectors binary, codes binary, spread binary"
    index = materialize(block(rows, n_blocks, "row").groupBy("block").applyInPandas(_pack(cb), packed), "quantised")
    asked = materialize(block(rows.filter(queries), n_queries, "query").groupBy("block").applyInPandas(_pack(None), packed), "queries")
    cells = index.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    asked = asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    grid = cells.hint("shuffle_hash").join(asked, ["q_block", "block"]).select("ids", "vectors", "codes", "spread", "q_ids", "q_vectors")
    found = grid.mapInArrow(_scan(cb, k, rerank), "query_id long, vec_id long, score double")
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # one shuffle for both steps
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

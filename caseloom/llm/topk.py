"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are dealt by hash to index blocks of about ``block`` rows. In a block the postings of each dimension are sorted by value and
cut in segments of equal quantised value. For a query the segments of all dimensions are processed by descending impact (query value
times the segment's best value), adding impacts to accumulators. When segments down to impact t are done, no row can score more than its
accumulator plus t for each dimension not seen yet. Processing stops only when that proves that all but a few rows
score below the k-th best exact score known; the rows that may still be members are then scored exactly.
The k-th best score starts from a bounded sample of rows and rises with every row that is scored.

Query rows go in blocks against every index block; each pair gives its own k best, and a ranking keeps the k best of all.

Rows with a null vector, or a null or non-finite component, take no part. Vectors of unequal length are compared as if
filled up with zeros. A query's own row is every row of its id; null ids take no part. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import cut

#: Rows whose scores give each query its first bound.
SAMPLE = 1024
#: Rows left that are scored rather than processed on.
FEW = 48


def scaled(embedding: str, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


class ImpactIndex:
    """Segments (dimension, quantised value) of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = 24):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        self.step = max(1, int(-(-2 * np.abs(vectors).max(initial=1) // levels)))
        level = vectors // self.step
        order = np.argsort(level, axis=0, kind="stable")
        self.rows = order.T.ravel().astype(np.int32)  # postings, dimension by dimension
        ordered = np.take_along_axis(level, order, axis=0).T.ravel()
        owner = np.repeat(np.arange(dims), n)
        new = np.flatnonzero(np.concatenate(([True], (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])))) if n * dims else np.zeros(0, np.int64)
        self.begin, self.end = new, np.append(new[1:], n * dims)
        self.dim, self.low = owner[new], ordered[new] * self.step

    def search(self, query: np.ndarray, k: int, own: int, bound: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those of id ``own``, of all that can reach ``bound``."""
        n, dims = self.vectors.shape
        weight = query[self.dim]
        impact = weight * np.where(weight > 0, self.low + self.step - 1, self.low)
        order = np.argsort(-impact, kind="stable")
        size = (self.end - self.begin)[order]
        total, seen = np.zeros(n), np.zeros(n, np.int64)
        scores: dict[int, int] = {}
        theta = -np.inf if bound is None else bound
        # a quarter of the postings first, then less and less between two looks at the bounds
        marks = np.searchsorted(np.cumsum(size), n * dims * np.array([0.25, 0.45, 0.6, 0.7, 0.8, 0.88, 0.94, 1.0]))
        done, maybe = 0, np.arange(n)
        for mark in np.unique(np.minimum(marks + 1, len(order))):
            part = order[done:mark]
            lengths = size[done:mark]
            place = np.repeat(self.begin[part] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            rows = self.rows[place]
            total += np.bincount(rows, np.repeat(impact[part], lengths).astype(float), minlength=n)
            seen += np.bincount(rows, minlength=n)
            done = mark
            rest = impact[order[done]] if done < len(order) else 0
            most = total + (dims - seen) * float(rest)
            for r in np.argpartition(-most, min(k, n - 1))[: k + 1] if n else ():
                if r not in scores and self.ids[r] != own:
                    scores[int(r)] = int(self.vectors[r] @ query)
            if len(scores) >= k:
                theta = max(theta, sorted(scores.values())[-k])
            maybe = np.flatnonzero(most >= theta)
            if len(maybe) <= FEW:
                break
        maybe = maybe[self.ids[maybe] != own]
        exact = self.vectors[maybe] @ query
        best = np.lexsort((self.ids[maybe], -exact))[:k]
        return self.ids[maybe][best], exact[best]


def _matrix(rows, width: int) -> np.ndarray:
    matrix = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        matrix[i, : len(row)] = row
    return matrix


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, embedding); ``is_query`` is a condition on vec_id."""
    finite = "embedding is not null and vec_id is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = cut(vectors.filter(finite).select("vec_id", scaled("embedding", scale).alias("vector")), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width"),
                    F.coalesce(F.sum(is_query.cast("int")), F.lit(0)).alias("asked")).first()
    blocks, asking = max(1, -(-size.n // block)), max(1, -(-size.asked // query_block))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    sample_ids, sample_rows = sample.vec_id.to_numpy(np.int64), _matrix(sample.vector, size.width)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        index = ImpactIndex(left.vec_id.to_numpy(np.int64), _matrix(left.vector, size.width))
        found = []
        for own, query in zip(right.vec_id.tolist(), _matrix(right.vector, size.width)):
            known = np.sort((sample_rows @ query)[sample_ids != own])
            ids, scores = index.search(query, k, own, int(known[-k]) if len(known) >= k else None)
            found.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})

    hashed = F.xxhash64("vec_id")
    index = rows.select("vec_id", "vector", F.pmod(hashed, F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asking - 1).cast("long"))).alias("q"))
    queries = rows.filter(is_query).dropDuplicates(["vec_id"]).select(
        "vec_id", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(hashed, F.lit(asking)).alias("q"))
    best = index.groupBy("b", "q").cogroup(queries.groupBy("b", "q")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Best-n rows per query: bounded query blocks and partial top-n in tasks.

Every question has to meet every chunk, so the corpus side is scanned in place
and never shuffled: a block of questions (bounded in rows and bytes) goes to
the tasks, each task keeps its n best rows per question, and only those
``partitions x questions x n`` rows reach the final window.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Bounds of one question block.
BLOCK_ROWS = 2_048
BLOCK_CHARS = 16 * 1024 * 1024
# Cells of one (questions x rows) score matrix inside a task.
_CELLS = 1_000_000
_NULL = "!"   # NULL in joined keys; values begin with +


def question_blocks(queries: DataFrame, text_col: str | None = None,
                    id_col: str = "query_id") -> list[DataFrame]:
    """Split ``queries`` by id hash into blocks within the bounds above.

    One counting pass; a table within the bounds is one block. Larger tables
    become several blocks, each an own scan of the corpus.
    """
    chars = F.sum(F.length(text_col)) if text_col else F.lit(0)
    n, size = queries.agg(F.count(F.lit(1)), F.coalesce(chars, F.lit(0))).first()
    blocks = max(math.ceil(n / BLOCK_ROWS), math.ceil(size / BLOCK_CHARS))
    if blocks <= 1:
        return [queries]
    blocks = math.ceil(blocks * 1.25)   # slack: hash blocks vary in size
    bucket = F.pmod(F.xxhash64(id_col), F.lit(blocks))
    return [queries.where(bucket == b) for b in range(blocks)]


class PartialTopN:
    """Running n smallest (score, key) per question within one task."""

    def __init__(self, n_queries: int, n: int):
        self.n = n
        self.best = [([], []) for _ in range(n_queries)]

    def rows_per_step(self) -> int:
        return max(256, _CELLS // max(1, len(self.best)))

    def push(self, scores: np.ndarray, keys: np.ndarray, questions=None) -> None:
        """``scores``: questions (all, or those given) x rows, inf where a row does not qualify."""
        n = self.n
        for q, row in zip(range(len(scores)) if questions is None else questions, scores):
            if len(row) > n:
                cut = np.partition(row, n - 1)[n - 1]
                pick = np.nonzero((row <= cut) & np.isfinite(row))[0]
            else:
                pick = np.nonzero(np.isfinite(row))[0]
            if not len(pick):
                continue
            old_s, old_k = self.best[q]
            s = np.concatenate([old_s, row[pick]])
            k = np.concatenate([np.asarray(old_k, dtype=object), keys[pick]])
            order = np.lexsort((k, s))[:n]
            self.best[q] = (s[order], k[order])

    def table(self, query_ids, names) -> pa.RecordBatch:
        """``names``: query id, the columns that the keys were joined from, score."""
        sizes = [len(s) for s, _ in self.best]
        ids = [i for i, m in zip(query_ids, sizes) for _ in range(m)]
        scores = [x for s, _ in self.best for x in s]
        keys = [[None if p == _NULL else p[1:] for p in x.split("\0", len(names) - 3)]
                for _, k in self.best for x in k]
        columns = [[k[i] for k in keys] for i in range(len(names) - 2)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), *(pa.array(c, pa.string()) for c in reversed(columns)),
             pa.array(scores, pa.float64())], names=names)


def joined_keys(batch, columns: int) -> np.ndarray:
    """The first columns of a batch as one string per row, the last of them in front.

    NULL comes before all values, as in Spark's order.
    """
    parts = [[_NULL if p is None else "+" + p for p in batch.column(i).to_pylist()]
             for i in reversed(range(columns))]
    return np.asarray(["\0".join(p) for p in zip(*parts)], dtype=object)


def repo_mask(q_repo, repos: pa.Array) -> np.ndarray:
    """Questions x rows: whether a row is of the question's repository; NULL is of none."""
    codes = repos.dictionary_encode()
    names = np.asarray(codes.dictionary.to_pylist() + [None], dtype=object)
    wanted = np.asarray(q_repo, dtype=object)[:, None] == names[None, :]
    wanted[:, -1] = False
    at = codes.indices.fill_null(len(names) - 1)
    return wanted[:, at.to_numpy(zero_copy_only=False)]


def rank_rows(df: DataFrame, by: list, n: int | None, rank: str,
              within=("query_id",)) -> DataFrame:
    """row_number within ``within``; a cut to n lets Spark limit each task first."""
    w = Window.partitionBy(*within).orderBy(*by)
    out = df.withColumn(rank, F.row_number().over(w))
    return out if n is None else out.where(F.col(rank) <= n)

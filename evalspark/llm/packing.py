"""Packing of token sequences: non-negative least squares over shallow length combinations.

Texts become ids plus an end id; documents longer than the window are cut into full windows and a
remainder.  The lengths, rounded up to a multiple of ``grain``, give a histogram of bounded size.  All
combinations of up to ``depth`` lengths that fill the window exactly are enumerated; non-negative
least squares fits how often each is used, the counts are rounded down, and what is left of the
histogram is packed greedily, longest first.  Only the histogram reaches the driver: pieces get their
place by their position within their length class, so every row is dealt out in parallel.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import group_positions, spread, text_rows, written
from evalspark.llm.pretokens import id_bytes

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text", cache_entries: int = 400_000) -> DataFrame:
    """Windows of each document's ids (its text's ids, then ``end_id``)."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for doc, raw in zip(ids, id_bytes(tokenizer_path, batch.column("text").to_pylist(), cache_entries)):
                raw += end
                total = len(raw) // 4
                for a in range(0, total, window):
                    part = raw[4 * a:4 * (a + window)]
                    out.append((doc, a, len(part) // 4, zlib.crc32(part), total))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, PIECES)


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of up to ``depth`` positive lengths with the sum ``units``."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], rest: int, most: int) -> None:
        if rest == 0:
            out.append(head)
            return
        left = depth - len(head)
        for x in range(min(rest, most), 0, -1):
            if x * left < rest:
                break
            extend((*head, x), rest - x, x)

    extend((), units, units)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |a x - b| over x >= 0: active sets, each solved by least squares on its free columns."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    eps = 1e-9 * max(1.0, float(np.abs(target).max(initial=0.0)))
    for _ in range(rounds or 3 * n):
        slope = np.where(free, -np.inf, target - gram @ x)
        j = int(np.argmax(slope))
        if slope[j] <= eps:
            break
        free[j] = True
        while True:
            k = np.flatnonzero(free)
            s = np.zeros(n)
            s[k] = np.linalg.lstsq(gram[np.ix_(k, k)], target[k], rcond=None)[0]
            low = k[s[k] <= 0]
            if not len(low):
                x = s
                break
            ratio = x[low] / np.maximum(x[low] - s[low], 1e-300)
            x = x + float(ratio.min()) * (s - x)
            free[low[ratio <= ratio.min()]] = False
            x[~free] = 0.0
    return x


def plan(histogram: dict[int, int], units: int, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) covering the histogram exactly."""
    left = np.zeros(units + 1, dtype=np.int64)
    for u, c in histogram.items():
        left[u] = c
    chosen: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        combos = combinations(units, depth)
        matrix = np.zeros((units, len(combos)))
        for j, combo in enumerate(combos):
            for u in combo:
                matrix[u - 1, j] += 1
        scale = float(left.max())
        repeats = np.floor(nnls(matrix, left[1:] / scale) * scale + 1e-6).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            uses = Counter(combos[j])
            times = min([int(repeats[j]), *(int(left[u]) // m for u, m in uses.items())])
            if times > 0:
                chosen.append((combos[j], times))
                for u, m in uses.items():
                    left[u] -= times * m
    while left.any():  # every round uses up a length or what still fits beside it
        combo, space = Counter(), units
        for u in range(units, 0, -1):
            m = min(int(left[u]), space // u)
            if m:
                combo[u] += m
                space -= m * u
        times = min(int(left[u]) // m for u, m in combo.items())
        chosen.append((tuple(sorted(combo.elements(), reverse=True)), times))
        for u, m in combo.items():
            left[u] -= times * m
    return chosen


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length class, first position, end position, first sequence, slot) of each run of places."""
    used: Counter[int] = Counter()
    out, sequence = [], 0
    for combo, times in chosen:
        for slot, u in enumerate(combo):
            out.append((u, used[u], used[u] + times, sequence, slot))
            used[u] += times
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, grain: int = 8, depth: int = 3,
         id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece with the end id only; a null id stays null; repeated rows are
    packed as often as they occur; an empty table gives an empty result; other columns are ignored.
    ``grain`` (a divisor of ``window``) bounds the histogram at ``window / grain`` lengths; ``chunks``
    is the number of sub-groups a length class is numbered in (by default, about a million pieces each).
    """
    spark = docs.sparkSession
    units = window // grain
    cut = written(pieces(docs, tokenizer_path, window, end_id, id_col, text_col), "pieces")
    cut = cut.withColumn("_class", F.ceil(F.col("length") / grain).cast("int"))
    histogram = {r["_class"]: r["n"] for r in cut.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = chunks or spread(max(histogram.values(), default=0))
    table = slots(plan(histogram, units, depth))
    places = spark.createDataFrame(table, "_class int, _from long, _to long, _first long, _slot int")
    ranked = group_positions(cut, ["_class"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "_rank", chunks)
    # One row per run of places; at most a few thousand, as the histogram has window / grain lengths.
    placed = ranked.join(F.broadcast(places), "_class").where("_rank >= _from AND _rank < _to")
    placed = placed.withColumn("sequence_id", F.col("_first") + F.col("_rank") - F.col("_from"))
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))

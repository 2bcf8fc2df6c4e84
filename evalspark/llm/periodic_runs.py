"""Runs (maximal periodic stretches) of words, found with grammars made by recompression.

A run of period q and length at least 2q holds two neighbours i and i + q of the grid of multiples of
q.  Grid pairs whose words, and a three-word window over them, agree are candidates; every run gives at
least one.  How far a pair agrees to the right and to the left is answered by two run-length grammars,
one of the words and one of the words reversed.  Each is built by recompression: levels alternate
block compression (equal neighbours become one symbol and a count) and pair compression (symbols are
split in two halves by a hash, and neighbours from the first and second half become one symbol).
Equal symbols of a level stand for equal words, so a query climbs while both places are boundaries of
the next level and descends where symbols differ.  No suffix array is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import text_rows
from evalspark.llm.words import U, mix

SLICE_WORDS = 400_000  # words of the documents worked on at a time, or of one longer document
CHUNK = 1 << 18  # candidates whose extensions are asked for at a time
RUN = "array<struct<start:long,length:long,period:long>>"


class Grammar:
    """A word sequence and the levels above it.

    Level l: ``sym`` (ids, equal only for equal words), ``rem`` (equal symbols from here on),
    ``size`` (words of a symbol), ``up`` (index of the symbol of level l + 1 that starts here, else -1) and
    ``down`` (index of the first symbol of level l - 1).
    """

    def __init__(self, words: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.down: list[np.ndarray] = [np.zeros(0, np.int64)]
        sym = words.astype(np.int64)
        size = np.ones(len(sym), np.int64)
        level = 0
        while True:
            n = len(sym)
            # Block compression.
            edge = np.ones(n, bool)
            edge[1:] = sym[1:] != sym[:-1]
            heads = np.flatnonzero(edge)
            ends = np.append(heads[1:], n)
            rem = np.repeat(ends, ends - heads) - np.arange(n)
            if len(heads) <= 1 or level > 200:
                self.levels.append((sym, rem, size, np.full(n, -1, np.int64)))
                return
            block = np.unique(np.stack([sym[heads], ends - heads]), axis=1, return_inverse=True)[1].ravel() if len(heads) < n else sym[heads]
            # Pair compression: a symbol of the first half takes a following one of the second.
            side = (mix(block.astype(U) * U(0x9E3779B97F4A7C15) + U(level + 1)) >> U(63)).astype(bool)
            pair = ~side[:-1] & side[1:]
            if pair.sum() < ((side[:-1] & ~side[1:])).sum():
                pair = side[:-1] & ~side[1:]
            taken = np.zeros(len(block), bool)
            taken[1:] = pair
            first = np.flatnonzero(~taken)
            second = np.where(np.append(pair, False)[first], np.append(block[1:], 0)[first] + 1, 0)
            _, new = np.unique(block[first] * np.int64(n + int(block.max()) + 2) + second, return_inverse=True)
            down = heads[first]
            up = np.full(n, -1, np.int64)
            up[down] = np.arange(len(first))
            self.levels.append((sym, rem, size, up))
            self.down.append(down)
            total = np.append(np.cumsum(size), 0)
            start = total[down] - size[down]
            size = np.diff(np.append(start, total[n - 1]))
            sym = new.ravel().astype(np.int64)
            level += 1

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that agree from places i and j on (i < j, both at most the length)."""
        n = len(self.levels[0][0])
        a, b = i.astype(np.int64), j.astype(np.int64)
        got = np.zeros(len(a), np.int64)
        stop = np.full(len(a), -1)  # level at which a query met a difference or the end
        live = np.arange(len(a))
        for level, (sym, rem, size, up) in enumerate(self.levels):
            active = live
            climbed = []
            while len(active):
                x, y = a[active], b[active]
                inside = y < len(sym)
                stop[active[~inside]] = level
                active, x, y = active[inside], x[inside], y[inside]
                ux, uy = up[x], up[y]
                rise = (ux >= 0) & (uy >= 0)
                climbed.append(active[rise])
                a[active[rise]], b[active[rise]] = ux[rise], uy[rise]
                active, x, y = active[~rise], x[~rise], y[~rise]
                same = sym[x] == sym[y]
                stop[active[~same]] = level
                active, x, y = active[same], x[same], y[same]
                step = np.minimum(rem[x], rem[y])
                got[active] += step * size[x]
                a[active] += step
                b[active] += step
            live = np.concatenate(climbed) if climbed else live[:0]
            if not len(live):
                break
        for level in range(int(stop.max(initial=-1)), -1, -1):
            sym, rem, size, _ = self.levels[level]
            active = np.flatnonzero(stop >= level)
            while len(active):
                x, y = a[active], b[active]
                inside = y < len(sym)
                active, x, y = active[inside], x[inside], y[inside]
                same = sym[x] == sym[y]
                active, x, y = active[same], x[same], y[same]
                step = np.minimum(rem[x], rem[y])
                got[active] += step * size[x]
                a[active] += step
                b[active] += step
            if level:
                lower = len(self.levels[level - 1][0])
                down = np.append(self.down[level], lower)
                here = np.flatnonzero(stop >= level)
                a[here], b[here] = down[a[here]], down[b[here]]
        return got


def _candidates(words: np.ndarray, doc_end: np.ndarray, longest: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of grid pairs i, i + q of one document that agree in three words over i.

    Words agree with those q later over at least max(q, least - q) >= least / 2 places of a run, so
    from ``least`` 6 on three in a row do around each grid pair of it; below, the word alone counts."""
    n = len(words)
    window = mix(mix(words[:-2].astype(U) + U(1)) + mix(words[1:-1].astype(U) + U(2)) * U(3) + mix(words[2:].astype(U) + U(3)) * U(5))
    window = np.append(window, np.arange(2, dtype=U))  # the last two start none; agreeing by chance only adds a candidate
    places, periods, held = [], [], 0
    for q in range(1, longest // 2 + 1):
        hit = np.flatnonzero(words[:n - q:q] == words[q::q])
        if not len(hit):
            continue
        i = hit * q
        i = i[i + q < doc_end[i]]
        agree = np.full(len(i), least < 6)
        for back in (0, 1, 2) if least >= 6 else ():
            at = i - back
            fits = (at >= 0) & (at + q < n)
            agree |= fits & (window[np.maximum(at, 0)] == window[np.minimum(np.maximum(at, 0) + q, n - 1)])
        i = i[agree]
        places.append(i)
        periods.append(np.full(len(i), q))
        held += len(i)
        if held >= CHUNK:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def _least_periods(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per stretch, with its smallest period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], period[first]


def runs_of(docs: list[np.ndarray], least: int = 12) -> list[np.ndarray]:
    """Per document (an array of word numbers, equal for equal words only): its runs as rows
    (start, length, period) by start, then period."""
    sizes = np.array([len(d) for d in docs], np.int64)
    offset = np.cumsum(sizes + 1) - (sizes + 1)
    empty = np.zeros((0, 3), np.int64)
    out = [empty] * len(docs)
    if not len(docs) or sizes.max(initial=0) < max(least, 2):
        return out
    # A word of its own ends each document.
    words = np.empty(int((sizes + 1).sum()), np.int64)
    end_of = np.repeat(offset + sizes, sizes + 1)
    words[:] = end_of
    top = max((int(d.max()) for d in docs if len(d)), default=0) + 1
    words += top
    for d, at in zip(docs, offset):
        words[at:at + len(d)] = d
    wanted = []
    for places, periods in _candidates(words, end_of, int(sizes.max()), least):
        wanted.append((places, periods))
    if not wanted:
        return out
    # Grammars only of the documents that have a candidate.
    doc_of = np.repeat(np.arange(len(docs)), sizes + 1)
    some = np.zeros(len(docs), bool)
    for places, _ in wanted:
        some[doc_of[places]] = True
    keep = some[doc_of]
    shift = np.cumsum(~keep)  # words left out before a place
    part = np.unique(words[keep], return_inverse=True)[1].ravel()
    m = len(part)
    ahead, back = Grammar(part), Grammar(part[::-1])
    found = (np.zeros(0, np.int64),) * 3
    for places, periods in wanted:
        for at in range(0, len(places), CHUNK):
            i, q = places[at:at + CHUNK], periods[at:at + CHUNK]
            i = i - shift[i]
            right = ahead.common(i, i + q)
            # Words before i and i + q, read backwards from places m - i - q and m - i of the reversal.
            left = back.common(m - i - q, m - i)
            start, end = i - left, i + q + right
            long = end - start >= np.maximum(least, 2 * q)
            found = _least_periods(*(np.concatenate([x, y[long]]) for x, y in zip(found, (start, end, q))))
    start, end, period = found
    full = np.flatnonzero(keep)
    order = np.lexsort((period, start))
    start, end, period = full[start[order]], end[order] - start[order], period[order]
    owner = doc_of[start] if len(start) else np.zeros(0, np.int64)
    rows = np.stack([start - offset[owner] if len(start) else start, end, period], axis=1)
    for d in np.unique(owner).tolist():
        out[d] = rows[owner == d]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray | None:
    """Which of n words stay: those in no run after its first period; None when all do."""
    if not len(runs):
        return None
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _run_batches(least: int):
    def rows_of(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts])
        flat = pa.array([w for t in texts for w in t], pa.large_binary())
        codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        docs = np.split(codes, np.cumsum(sizes)[:-1]) if len(texts) else []
        runs, collapsed = [], []
        for t, r in zip(texts, runs_of(docs, least)):
            keep = kept_words(len(t), r)
            collapsed.append(b" ".join(t if keep is None else [t[k] for k in np.flatnonzero(keep).tolist()]))
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in r.tolist()])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, kind),
             pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                words = text.as_py().encode().split()  # splits at space and 0x09-0x0D
                if held and held + len(words) > SLICE_WORDS:
                    yield rows_of(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(words)
                held += len(words)
            if ids:
                yield rows_of(ids, texts)
    return run


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start), collapsed (the words outside
    the repeats of runs, joined by one space) of every row.

    A run is a stretch of words of smallest period q and length at least max(``least``, 2q) that no
    neighbouring word extends.  Null and empty texts have no words, no runs and an empty ``collapsed``;
    rows are independent, so repeated rows, ids and null ids come back as they are; an empty table
    gives no rows; other columns are ignored.
    """
    return text_rows(docs, id_col, text_col).mapInArrow(_run_batches(least), f"doc_id long, n_words long, runs {RUN}, collapsed string")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): with h the crc32 of the decimal id and g = h div 10, texts with h mod 10 = 0 have
    each word i from a = g mod n on replaced by word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8)."""
    rows = text_rows(docs, id_col, text_col).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    picked = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    g, n = F.floor(F.col("h") / 10).cast("long"), F.size("w").cast("long")
    a = F.when(n > 0, g % n)
    picked = picked.withColumn("a", a.cast("int"))
    p = F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + g % 8))
    picked = picked.withColumn("p", p.cast("int"))
    turned = F.transform("w", lambda w, i: F.when(i >= F.col("a"), F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))).otherwise(w))
    return picked.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", turned)).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The columns of the registered query from those of :func:`periodic_runs`."""
    # Longest first, then the smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                                r["period"].cast("string"), F.lit("\n"))), "")
    return (found.withColumn("_b", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.s")).alias("start"), F.col("_b.l").alias("length"),
                    (-F.col("_b.p")).alias("period"), F.floor(F.col("_b.l") * 1000 / -F.col("_b.p")).cast("long").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))

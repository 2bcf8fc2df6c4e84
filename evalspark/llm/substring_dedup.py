"""Removal of repeated passages by difference-cover anchors.

Positions p with p mod ``period`` in a difference cover are anchors.  For any two positions i and j
some shift d < period puts both i + d and j + d on the cover, so two equal windows of L words hold an
equal anchor window of L - period + 1 words at the same shift.  Only anchor windows are counted over
the corpus; a window of L words that holds no repeated anchor is unique.  The others are extended to
the full L words and compared as such.

No step gathers the rows of one key: keys are counted by partial aggregation, and what returns to a
document is the list of its own keys (anchors that are unique, windows that start there first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import text_rows
from evalspark.llm.words import U, Words, mix, slices

# A perfect difference set: every residue mod 13 is the difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)


def _anchor_places(w: Words, length: int) -> np.ndarray:
    """Word indices of the anchor windows."""
    place = (np.arange(len(w)) - w.first[:-1][w.doc]) % PERIOD
    return np.flatnonzero(np.isin(place, COVER) & w.fits(length - PERIOD + 1))


def _candidates(w: Words, single: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows that hold an anchor which is not single in the corpus; ``single`` has the
    word indices of those that are."""
    at = _anchor_places(w, length)
    known = np.zeros(len(w) + 1, bool)
    known[single] = True
    again = at[~known[at]]
    edge = np.zeros(len(w) + 1, np.int64)
    # The anchor's window lies in those that start up to PERIOD - 1 words before it.
    np.add.at(edge, np.maximum(again - (PERIOD - 1), w.first[:-1][w.doc[again]]), 1)
    np.add.at(edge, again + 1, -1)
    return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & w.fits(length))


def _flat(column: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column's rows a to b, and the row of each."""
    part = column.slice(a, b - a)
    sizes = np.asarray([0 if n is None else n for n in pa.compute.list_value_length(part).to_pylist()], np.int64)
    return pa.compute.list_flatten(part).to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(b - a), sizes)


def _ids(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    return batch.column("doc_id").slice(a, b - a).fill_null(0).to_numpy(zero_copy_only=False)


def _known(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    return batch.column("doc_id").slice(a, b - a).is_valid().to_numpy(zero_copy_only=False)


def _with_marks(batch: pa.RecordBatch, rows: np.ndarray, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """The batch of ``columns``, and with the texts' marks of ``rows`` if the input has marks."""
    if "mark" in batch.schema.names:
        columns, names = [*columns, batch.column("mark").take(pa.array(rows))], [*names, "mark"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text")):
                at = _anchor_places(w, length)
                if len(at):
                    keys = w.windows(w.hashes(1), length - PERIOD + 1)[at]
                    place = (at - w.first[:-1][w.doc[at]]).astype(np.int32)
                    yield _with_marks(batch, a + w.doc[at],
                                      [pa.array(keys.view(np.int64)), pa.array(_ids(batch, a, b)[w.doc[at]]), pa.array(place)],
                                      ["key", "doc_id", "place"])
    return run


def _window_keys(w: Words, hashes: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and an independent 32-bit hash of the windows."""
    other = w.windows(mix(w.hashes(2)), length)[at] >> U(33)
    return w.windows(hashes, length)[at].view(np.int64), other.astype(np.int32)


def _singles(batch: pa.RecordBatch, a: int, b: int, w: Words) -> np.ndarray:
    place, doc = _flat(batch.column("single"), a, b)
    return w.first[:-1][doc] + place


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        raw = [t.encode("utf8") for t in batch.column("text").to_pylist()]
        yield _with_marks(batch, np.arange(len(raw)),
                          [batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()),
                           pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], ["doc_id", "size", "pressed"])


def _text_slices(batch: pa.RecordBatch, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int, Words]]:
    """``slices`` of the compressed texts; only one slice is unpacked at a time."""
    codec = pa.Codec("zstd")
    sizes = np.cumsum(np.concatenate([[0], batch.column("size").to_numpy(zero_copy_only=False)]))
    pressed, a = batch.column("pressed"), 0
    while a < len(pressed):
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + most_bytes, "right")) - 1)
        raw = b"".join(codec.decompress(x.as_py(), int(sizes[i + 1] - sizes[i]), asbytes=True)
                       for i, x in enumerate(pressed.slice(a, b - a), a) if sizes[i + 1] > sizes[i])
        yield a, b, Words(np.frombuffer(raw, np.uint8), sizes[a:b + 1] - sizes[a])
        a = b


def _window_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in _text_slices(batch):
                hashes = w.hashes(1)
                at = _candidates(w, _singles(batch, a, b, w), length)
                at = at[_known(batch, a, b)[w.doc[at]]]
                if len(at):
                    key, more = _window_keys(w, hashes, at, length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(more), pa.array(_ids(batch, a, b)[w.doc[at]])], names=["key", "more", "doc_id"])
    return run


def _result_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept_texts = [], [], []
            for a, b, w in _text_slices(batch):
                hashes = w.hashes(1)
                at = _candidates(w, _singles(batch, a, b, w), length)
                at = at[_known(batch, a, b)[w.doc[at]]]
                key, _ = _window_keys(w, hashes, at, length)
                doc = w.doc[at]
                order = np.lexsort((at, key, doc))
                first_here = np.ones(len(at), bool)
                first_here[order[1:]] = (key[order[1:]] != key[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
                owned_key, owned_doc = _flat(batch.column("first"), a, b)
                keep = first_here & _member(doc, key, owned_doc, owned_key)
                edge = np.zeros(len(w) + 1, np.int64)
                gone = at[~keep]
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + length, -1)
                removed = np.cumsum(edge[:-1]) > 0
                raw = w.raw.tobytes()
                lows, highs = w.starts.tolist(), w.ends.tolist()
                for d in range(b - a):
                    i, j = int(w.first[d]), int(w.first[d + 1])
                    left = np.flatnonzero(~removed[i:j]) + i
                    n_words.append(j - i)
                    n_removed.append(j - i - len(left))
                    kept_texts.append(b" ".join([raw[lows[x]:highs[x]] for x in left.tolist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept_texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def _member(doc: np.ndarray, key: np.ndarray, owned_doc: np.ndarray, owned_key: np.ndarray) -> np.ndarray:
    """Is (doc, key) among the owned pairs?"""
    if not len(owned_key) or not len(key):
        return np.zeros(len(key), bool)
    pairs = np.unique(np.rec.fromarrays([owned_doc, owned_key]))
    mine = np.rec.fromarrays([doc.astype(np.int64), key])
    pairs = pairs.astype(mine.dtype)
    at = np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)
    return pairs[at] == mine


def remove_repeats(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by a space).

    A word goes if a window of ``length`` words that covers it also starts earlier (in a document with
    a smaller id, or earlier in the same one).  Null and empty texts have no words.  Rows without an
    id have no place in the order: they neither lose words nor cause losses.  Rows that share an id
    stand at one place: equal or not, they lose nothing to each other, but to smaller ids and to earlier
    starts in the same text, and larger ids lose to each of them.  An empty table gives an empty
    result; other columns are ignored.
    """
    if length < PERIOD + 1:
        raise ValueError(f"windows need more than {PERIOD} words")
    rows = text_rows(docs, id_col, text_col)
    # Where different texts share an id, what returns to a row needs the text's hash beside the id.
    mark = F.xxhash64("text")
    shared = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b")
    row_key, more = ["doc_id"], ""
    if not shared.isEmpty():
        rows, row_key, more = rows.withColumn("mark", mark), ["doc_id", "mark"], ", mark long"
    known = rows.where(F.col("doc_id").isNotNull())
    anchors = known.mapInArrow(_anchor_rows(length), f"key long, doc_id long, place int{more}")
    # Of a key that occurs once, the smallest id, hash and place are its own.
    single = (anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in [*row_key, "place"]])
              .where("n = 1").groupBy(*row_key).agg(F.collect_list("place").alias("single")))
    pressed = rows.mapInArrow(_pressed, f"doc_id long, size long, pressed binary{more}")
    base = pressed.join(single, row_key, "left")  # used twice in one plan: its exchanges are shared
    windows = base.mapInArrow(_window_rows(length), "key long, more int, doc_id long")
    first = (windows.groupBy("key", "more").agg(F.min("doc_id").alias("doc_id"))
             .groupBy("doc_id").agg(F.collect_list("key").alias("first")))
    return base.join(first, "doc_id", "left").mapInArrow(
        _result_rows(length), "doc_id long, n_words long, n_removed long, kept_text string")


def remove_repeats_digest(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (hex, of the kept words joined by one space)."""
    return remove_repeats(docs, length).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

"""Token counts of whole texts: a two-tier, map-side lookup of piece lengths.

Tier 1 is a broadcast table of the most frequent pieces of a bounded sample of the corpus with their
token counts.  Tier 2 is a bounded cache in each Python worker; only pieces in neither tier are
encoded.  No piece is ever shuffled.  The sample decides speed only, never a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import text_rows
from evalspark.llm.pretokens import coder, pieces_of

PIECE_BYTES = 256
_MISSES: dict[str, dict[str, int]] = {}


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, n) of each text; long pieces, which the table leaves out, are not worth a row."""
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen = Counter(p for p in pieces_of(text) if len(p) <= PIECE_BYTES and len(p.encode("utf8")) <= PIECE_BYTES)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])


def frequent_pieces(docs: DataFrame, tokenizer_path: str, sample_rows: int = 512, entries: int = 32_768) -> dict[str, int]:
    """Token counts of the most frequent pieces of ``sample_rows`` whole texts: the rows with the smallest
    hashes of id and text.  The hashes are chosen first, then only their texts are counted, in tasks of
    their own; at most ``entries`` pieces of at most ``PIECE_BYTES`` bytes reach the driver."""
    marked = text_rows(docs).withColumn("_hash", F.xxhash64("doc_id", "text", F.lit(8)))
    chosen = [r["_hash"] for r in marked.select("_hash").orderBy("_hash").limit(sample_rows).collect()]
    sample = marked.join(F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in set(chosen)], "_hash long")), "_hash", "left_semi")
    counts = sample.dropDuplicates(["_hash"]).select("text").mapInArrow(_piece_rows, "piece string, n long")
    top = counts.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("piece")).limit(entries).collect()
    words = [r.piece for r in top if not any(s in r.piece for s in coder(tokenizer_path).special)]
    return dict(zip(words, map(len, coder(tokenizer_path).encode(words)))) if words else {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text",
                 cache_entries: int = 400_000, sample_rows: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    A null text counts as empty (0 tokens); a null id stays null; repeated rows give repeated rows;
    an empty table gives an empty result; other columns are ignored.  ``sample_rows`` bounds the
    sample behind the broadcast table and ``cache_entries`` each worker's cache.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col)
    tier1 = spark.sparkContext.broadcast(frequent_pieces(rows, tokenizer_path, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, c = tier1.value, coder(tokenizer_path)
        cache = _MISSES.setdefault(tokenizer_path, {})
        for batch in batches:
            counts = []
            for text in batch.column("text").to_pylist():
                if any(s in text for s in c.special):
                    counts.append(len(c.whole(text)))
                    continue
                n, rest = 0, []
                for p in pieces_of(text):
                    k = frequent.get(p)
                    if k is None:
                        rest.append(p)
                    else:
                        n += k
                missing = [p for p in dict.fromkeys(rest) if p not in cache]
                if missing:
                    if len(cache) + len(missing) > cache_entries:
                        cache.clear()
                        missing = list(dict.fromkeys(rest))
                    cache.update(zip(missing, map(len, c.encode(missing))))
                counts.append(n + sum(map(cache.__getitem__, rest)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    counted = (rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
               .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

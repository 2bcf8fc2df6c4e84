"""Similarity, de-duplication, diversity and selection.

* Exact duplicates collapse on a content hash with a partial ``min_by``
  aggregation, so the joins never compare copies; a query that wants their
  pairs adds them to the links of the representatives (``member_pairs``).
* The set-similarity join (token Jaccard > t) uses prefix filtering
  (Chaudhuri et al. 2006; Xiao et al. 2008, PPJoin): tokens are ordered by
  global rarity, each set contributes only its first |x| − ⌈t·|x|⌉ + 1
  tokens, candidates meet on an equi-join of those prefix tokens under the
  length filter, and every candidate is verified exactly.  Output size, not
  n², bounds the work.
* Greedy "keep unless similar to an earlier kept item" is the
  lexicographically-first maximal independent set of the edge table,
  computed in rounds of joins; each round's state is checkpointed to the
  shared checkpoint folder so lineage stays short and a lost executor
  recomputes one round only.
* The 2-D Pareto front needs one grouped max per x and a distributed
  running max — no dominance self-join; more objectives go through a grid
  and local fronts (``skyline``).
* Means over all pairs of a group are summed in tiles (block i, block j) of
  the group's distinct token sets; a tile returns one partial sum.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.char_ratio import char_ratios
from ..functions.tokens import set_jaccard, split_ws, tokens
from ..session import ensure_checkpoint_dir, stored
from .ordinal import with_prefix_max
from .skyline import skyline


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ SI1
def exact_dedup(df: DataFrame, key: str, content: str) -> DataFrame:
    """Keep the first row (smallest ``key``) of every distinct content (md5)."""
    others = [c for c in df.columns if c != key]
    g = df.groupBy(F.md5(F.col(content)).alias("_h")).agg(
        F.min_by(F.struct(F.col(key).alias(key), *[F.col(c) for c in others]), F.col(key)).alias("_r"))
    return g.select("_r.*")


# ------------------------------------------------------------------ token sets
def token_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, toks, n): the distinct lower-cased whitespace tokens of each text."""
    return df.select(key, F.array_distinct(tokens(text)).alias("toks")).withColumn("n", F.size("toks"))


FEW_KEYS = 1_000_000  # keys that are broadcast to a table of token sets or texts


def _few(keys: DataFrame) -> DataFrame:
    """Keys for a join with a wide table: few of them go to the table, not the table to a shuffle."""
    return F.broadcast(keys) if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else keys


def collapse_identical_sets(sets: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(representatives, members): identical token sets keep their smallest key as representative;
    ``members`` maps every key to its representative, ``set_id`` names the set in both.  The sets are written
    once with their hash; hashes are grouped, and the other copies leave when the table is read, so no token arrays are shuffled."""
    canon = F.md5(F.array_join(F.array_sort("toks"), " "))
    s = stored(sets.select(key, "toks", "n", canon.alias("set_id"), F.monotonically_increasing_id().alias("_row")), "token-sets")
    g = s.groupBy("set_id").agg(F.min(key).alias("rep"), F.count("*").alias("copies"), F.min_by("_row", F.col(key)).alias("_row"))
    others = s.select("_row").join(g.where(F.col("_row").isNotNull()).select("_row"), "_row", "left_anti")
    rep_sets = s.join(_few(others), "_row", "left_anti").drop("_row")
    members = s.select(key, "set_id").join(g.select("set_id", "rep", "copies"), "set_id").select(key, "rep", "copies", "set_id")
    return rep_sets, members


def member_pairs(edges: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(a, b) with a < b: all pairs of keys whose token sets an edge (a, b) of set ids links, or that share a set."""
    held = members.select(key, "set_id").where(F.col(key).isNotNull()).distinct()
    same = held.groupBy("set_id").agg(F.count("*").alias("_n")).where("_n > 1")
    links = edges.select("a", "b").union(same.select(F.col("set_id").alias("a"), F.col("set_id").alias("b")))
    ends = links.join(held.select(F.col("set_id").alias("a"), F.col(key).alias("_x")), "a").join(held.select(F.col("set_id").alias("b"), F.col(key).alias("_y")), "b")
    either = (F.col("a") != F.col("b")) | (F.col("_x") < F.col("_y"))
    return ends.where(either & (F.col("_x") != F.col("_y"))).select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()


JOIN_TILE = 2048  # holders of a prefix token that meet in one tile
RARITY_BITS = 23  # token counts, up to 65,535, are kept for so many bits of the token's hash
SIGNATURE_WORDS = 4  # 256 bits of parity per set
LOW_THRESHOLD = 0.7  # below it prefixes are so long that the join goes by groups of tokens
COUNT_BUCKETS = 512  # buckets of a set's tokens, counted up to 15 in four bits each
GROUP_TOKENS = 1 << 21  # prefix tokens in one group, about
LEAST_GROUPS = 16
TILE_BYTES = 32 << 20  # of the rows that meet in one tile of pairs, about


HASH_BYTES = 1 << 16  # of tokens that are hashed at once
_ODD = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(1).integers(0, 1 << 64, 256, np.uint64)


def _hash_tokens(tokens: pa.Array) -> np.ndarray:
    """A 64-bit hash of each token: a polynomial of its bytes in an odd number, mixed."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    kind = np.int64 if pa.types.is_large_string(tokens.type) else np.int32
    ends = np.frombuffer(tokens.buffers()[1], kind)[tokens.offset:tokens.offset + len(tokens) + 1].astype(np.int64)
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
    out = np.empty(len(tokens), np.uint64)
    up = down = np.ones(1, np.uint64)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + HASH_BYTES, "right")) - 1)
        at = ends[a:b + 1] - ends[a]
        if len(up) <= at[-1]:
            n = max(int(at[-1]), HASH_BYTES)
            up, down = (np.cumprod(np.append(np.uint64(1), np.full(n, m, np.uint64))) for m in (_ODD, pow(_ODD, -1, 1 << 64)))
        total = np.zeros(int(at[-1]) + 1, np.uint64)
        np.cumsum(_BYTES[data[ends[a]:ends[b]]] * up[:at[-1]], out=total[1:])
        out[a:b] = (total[at[1:]] - total[at[:-1]]) * down[at[:-1]]
        a = b
    for shift in (32, 29):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _hashes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of token lists, and the hashes of their tokens."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), _hash_tokens(lists.flatten())


def _bucket_counts(batches):
    held = np.zeros(1 << RARITY_BITS, np.int32)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            np.add.at(held, _hashes(batch.column(0).slice(at, 1000))[1] & ((1 << RARITY_BITS) - 1), 1)
    k = np.flatnonzero(held)
    for at in range(0, len(k), 100_000):
        some = k[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some].astype(np.int64))], names=["k", "c"])


def _rarity(sets: DataFrame) -> tuple[np.ndarray, int]:
    """Holders per bucket of token hashes, a table of fixed size whatever the vocabulary, and the sum."""
    counted = sets.select("toks").mapInArrow(_bucket_counts, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    held = np.zeros(1 << RARITY_BITS, np.uint16)
    count = counted["c"].to_numpy()
    held[counted["k"].to_numpy()] = np.minimum(count, 65_535)
    return held, int(count.sum())


def _prefixes(size: np.ndarray, h: np.ndarray, held: np.ndarray, threshold: float, buckets: int = COUNT_BUCKETS):
    """(row, token, place, holders) of the prefix tokens that others may hold, and for each row its size
    and its tokens counted in buckets."""
    row = np.repeat(np.arange(len(size)), size)
    counts = np.bincount(row * buckets + ((h >> 40) & (buckets - 1)), minlength=len(size) * buckets) if buckets else np.zeros(0)
    counts = np.minimum(counts, 15).astype(np.uint8).reshape(len(size), buckets)
    shared = held[h & ((1 << RARITY_BITS) - 1)]
    order = np.lexsort((h, shared, row))
    h, shared = h[order], shared[order]
    first = np.cumsum(size) - size
    place = np.arange(len(h)) - first[row]
    # Two tokens of one hash stand at one place: the first.
    tied = np.zeros(len(h), bool)
    tied[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    pos = np.maximum.accumulate(np.where(tied, 0, np.arange(len(h)))) - first[row] if len(h) else place
    length = np.maximum(size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1, 1)
    # A token that no other set holds keeps its place but needs no entry.
    out = np.flatnonzero((place < length[row]) & (shared > 1))
    return row[out], h[out], pos[out], shared[out], size, counts


def _frequent_rows(shared, threshold: float, tile: int):
    """Prefix tokens that more than ``tile`` prefixes may hold, once per holder."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                _, tok, _, holders, _, _ = _prefixes(*_hashes(batch.slice(at, 1000).column("toks")), shared.value, threshold, 0)
                if (holders > tile).any():
                    yield pa.RecordBatch.from_arrays([pa.array(tok[holders > tile])], names=["tok"])
    return run


def _frequent(sets: DataFrame, held: np.ndarray, threshold: float, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix tokens that more than ``tile`` prefixes hold, and the blocks of their holders: at most one
    in ``tile`` prefix tokens is such a token."""
    if not (held > tile).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(held)
    hot = (sets.select("toks").mapInArrow(_frequent_rows(shared, threshold, tile), "tok long").groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
           .where(F.col("c") > tile).orderBy("tok").toArrow())
    return hot["tok"].to_numpy().astype(np.int64), -(-hot["c"].to_numpy().astype(np.int64) // tile)


def _dealt(row, tok, pos, own, frequent, blocks):
    """(row, token, place, side): a frequent token is a token of its own for each pair of blocks of its holders;
    side 0 meets all in a block's own tile, sides 1 and 2 meet each other."""
    side = np.zeros(len(row), np.int64)
    if len(frequent) and len(row):
        i = np.minimum(np.searchsorted(frequent, tok), len(frequent) - 1)
        many = np.where(frequent[i] == tok, blocks[i], 1)
        own = own[row] % many
        e = np.repeat(np.arange(len(row)), many)
        other = np.arange(len(e)) - np.repeat(np.cumsum(many) - many, many)
        row, tok, pos, many, own = row[e], tok[e], pos[e], many[e], own[e]
        lo, hi = np.minimum(own, other), np.maximum(own, other)
        side = np.where(lo == hi, 0, np.where(own == lo, 1, 2))
        # Tokens that come to clash here only add candidates.
        tok = np.where(many > 1, tok ^ ((lo * many + hi + 1) * np.int64(0x1E3779B97F4A7C15)), tok)
    return row, tok, pos, side


def _prefix_rows(shared, key: str, threshold: float):
    """Of each set (key, tok, place, signature words) for the tokens of its prefix that others may hold; ``place``
    packs the set's size, the token's position and its side."""
    def run(batches):
        held, frequent, blocks = shared.value
        bits = SIGNATURE_WORDS * 64
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                size, h = _hashes(some.column("toks"))
                doc = np.repeat(np.arange(len(size)), size)
                odd = (np.bincount(doc * bits + ((h >> 40) & (bits - 1)), minlength=len(size) * bits) & 1).astype(np.uint8)
                marks = np.packbits(odd).view(np.int64).reshape(len(size), SIGNATURE_WORDS)
                row, tok, pos, _, _, _ = _prefixes(size, h, held, threshold, 0)
                own = some.column("_k").to_numpy(zero_copy_only=False).astype(np.int64)
                row, tok, pos, side = _dealt(row, tok, pos, own, frequent, blocks)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [some.column(key).take(pa.array(row)), pa.array(tok), pa.array(size[row] << 33 | pos << 2 | side),
                         *(pa.array(marks[row, w]) for w in range(SIGNATURE_WORDS))],
                        names=[key, "tok", "place", *(f"s{w}" for w in range(SIGNATURE_WORDS))])
    return run


def _packed_sets(key: str):
    """Of each set (key, its tokens as compressed bytes): a third of the bytes that an array of strings has in a shuffle."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                packed = [None if toks is None else zlib.compress(pickle.dumps(toks, 5), 1) for toks in some.column("toks").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(key), pa.array(packed, pa.binary())], names=[key, "_p"])
    return run


@F.udf(T.IntegerType(), useArrow=False)
def _packed_common(a, b):
    return len(set(pickle.loads(zlib.decompress(a))).intersection(pickle.loads(zlib.decompress(b))))


def _group_rows(shared, key: str, threshold: float, groups: int):
    """Of each set one row per group of tokens: (key, g, n, counts, its prefix tokens there, their places
    and sides)."""
    def run(batches):
        held, frequent, blocks = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                row, tok, pos, _, size, counts = _prefixes(*_hashes(some.column("toks")), held, threshold)
                own = some.column("_k").to_numpy(zero_copy_only=False).astype(np.int64)
                row, tok, pos, side = _dealt(row, tok, pos, own, frequent, blocks)
                g = (tok >> 24) % groups
                order = np.lexsort((g, row))
                row, tok, pos, side, g = row[order], tok[order], pos[order], side[order], g[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                ends = pa.array(np.append(first, len(row)).astype(np.int32))
                packed = [(c[0::2] | c[1::2] << 4).tobytes() for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [some.column(key).take(pa.array(row[first])), pa.array(g[first].astype(np.int32)), pa.array(size[row[first]].astype(np.int32)),
                     pa.array([packed[r] for r in row[first].tolist()], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(tok)),
                     pa.ListArray.from_arrays(ends, pa.array((pos * 4 + side).astype(np.int32)))], names=[key, "g", "n", "counts", "toks", "places"])
    return run


def _met(n: np.ndarray, packed: np.ndarray, row: np.ndarray, tok: np.ndarray, place: np.ndarray, threshold: float,
         at_once: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that meet under a token and pass the length, position and count tests."""
    pos, side = place >> 2, place & 3
    order = np.lexsort((n[row], tok))
    row, tok, pos, side = row[order], tok[order], pos[order], side[order]
    size = n[row]
    wide = int(n.max()) + 1 if len(n) else 1
    number = np.cumsum(np.append(False, tok[1:] != tok[:-1])) if len(tok) else tok
    # What is left of a set from its place on must reach the overlap, which grows with the other's size.
    longest = np.minimum(size / threshold, (size - pos) * ((1 + threshold) / threshold) - size)
    longest = np.clip(np.floor(longest + 1e-6).astype(np.int64), 0, wide - 1)
    # Holders of a token stand by size: those that fit each one are the next so many.
    times = np.maximum(np.searchsorted(number * wide + size, number * wide + longest, "right") - np.arange(len(tok)) - 1, 0)
    excess = n - (packed & 15).sum(1, dtype=np.int64) - (packed >> 4).sum(1, dtype=np.int64)
    found = [np.zeros(0, np.int64)]
    ends = np.cumsum(times)
    a = 0
    while a < len(tok):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + at_once, "right")))
        t = times[a:b]
        x = np.repeat(np.arange(a, b), t)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(t) - t, t)
        need = np.ceil(threshold / (1 + threshold) * (size[x] + size[y]) - 1e-9)
        fits = (np.minimum(size[x] - pos[x], size[y] - pos[y]) >= need) & ((side[x] == 0) | (side[x] != side[y]))
        x, y = row[x[fits]], row[y[fits]]
        pair = np.unique(np.minimum(x, y) * len(n) + np.maximum(x, y))
        for c in range(0, len(pair), 20_000):
            x, y = np.divmod(pair[c:c + 20_000], len(n))
            p, q = packed[x], packed[y]
            most = (np.minimum(p & 15, q & 15).sum(1, dtype=np.int64) + np.minimum(p >> 4, q >> 4).sum(1, dtype=np.int64) + np.minimum(excess[x], excess[y]))
            found.append(pair[c:c + 20_000][most >= np.ceil(threshold / (1 + threshold) * (n[x] + n[y]) - 1e-9)])
        if len(found) > 1000:
            found = [np.unique(np.concatenate(found))]
        a = b
    return np.divmod(np.unique(np.concatenate(found)), max(len(n), 1))


def _candidates(key: str, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        lists = table.column("toks").combine_chunks()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        tok, place = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("toks", "places"))
        packed = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).reshape(-1, COUNT_BUCKETS // 2)
        x, y = _met(table.column("n").to_numpy().astype(np.int64), packed, row, tok, place, threshold)
        ids = table.column(key).combine_chunks()
        return pa.table([ids.take(pa.array(x)), ids.take(pa.array(y))], names=["x", "y"])
    return run


def in_tiles(pairs: DataFrame, rows: DataFrame, key: str, size: int, compare, schema) -> DataFrame:
    """``compare(pairs, rows)`` over Arrow tables for all pairs (a, b) of keys of ``rows``, tile by tile.

    Keys are dealt into blocks by a hash, so many that two blocks of rows of ``size`` bytes in all fill a tile of
    about ``TILE_BYTES``.  A row goes once to each tile where it has a pair, whatever the number of its pairs."""
    blocks = max(8, -(-2 * size // TILE_BYTES))
    x, y = (F.pmod(F.xxhash64(c), F.lit(blocks)) for c in ("a", "b"))
    tiled = pairs.withColumn("tile", F.least(x, y) * blocks + F.greatest(x, y))
    ends = _few(tiled.select(F.col("tile").alias("_tile"), F.explode(F.array("a", "b")).alias(key)).distinct())
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * pairs.sparkSession.sparkContext.defaultParallelism)
    left, right = tiled.repartition(tasks, "tile"), ends.join(rows, key).repartition(tasks, "_tile")
    return left.groupBy("tile").cogroup(right.groupBy("_tile")).applyInArrow(lambda p, r: compare(p, r), schema)


def _places(pairs: pa.Table, rows: pa.Table, key: str) -> Iterator[tuple[int, int, int]]:
    """(pair, row of a, row of b): each pair with every row of its keys."""
    held: dict = {}
    for at, k in enumerate(rows.column(key).to_pylist()):
        held.setdefault(k, []).append(at)
    for i, (a, b) in enumerate(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())):
        for x in held.get(a, ()):
            for y in held.get(b, ()):
                yield i, x, y


def _jaccards(key: str, threshold: float):
    def run(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        lists = rows.column("toks").combine_chunks()
        size, h = _hashes(lists)
        sets = np.split(h, np.cumsum(size)[:-1]) if len(size) else []
        met = []
        # Equal tokens have one hash: by hashes no overlap is too small.
        for i, x, y in _places(pairs, rows, key):
            if size[x] and size[y]:
                both = np.concatenate([sets[x], sets[y]])
                both.sort()
                common = np.count_nonzero(both[1:] == both[:-1])
                if common >= threshold / (1 + threshold) * (size[x] + size[y]) - 1e-9:
                    met.append((i, x, y))
        # The few that are left are counted by their tokens.
        used = np.unique(np.array([m[1:] for m in met], np.int64))
        few = lists.take(pa.array(used))
        codes = few.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        tokens = dict(zip(used.tolist(), np.split(codes, np.cumsum(size[used])[:-1])))
        out, found = [], []
        for i, x, y in met:
            common = len(np.intersect1d(tokens[x], tokens[y], assume_unique=True))
            if common / (size[x] + size[y] - common) > threshold:
                out.append(i)
                found.append(float(common / (size[x] + size[y] - common)))
        some = pairs.select(["a", "b"]).take(pa.array(out, pa.int64()))
        return some.append_column("jaccard", pa.array(found, pa.float64()))
    return run


def grouped_join(sets: DataFrame, key: str, threshold: float, tile: int = JOIN_TILE) -> DataFrame:
    """The edges of ``similarity_join`` for low thresholds, where prefixes hold many tokens, so that a signature
    with each token would be most of the shuffle, and parities of large sets exclude nothing.

    Filters are the same, but for the signature: tokens are counted in 512 buckets, and the overlap is at
    most the sum of the smaller counts.  Survivors are verified on the tokens themselves, in tiles of
    pairs (``in_tiles``).

    Prefix tokens are dealt into groups by their hash; a set sends one row with its counts to each group
    that holds tokens of it, so that the shuffle follows the tokens, and pairs exist inside a group only, until
    all filters have passed them.  The global order is (holders in the token's hash bucket, hash): the counts
    are a broadcast table of 2^23 numbers.  Tokens of one hash share a place in every set, which
    adds candidates and loses none.

    The holders of a prefix token that more than ``tile`` prefixes hold are dealt into blocks by a hash
    of their key, and each pair of blocks is a token of its own: a hot token spreads over groups.  At
    most one in ``tile`` prefix tokens is such a token; the list goes with the broadcast."""
    spark = sets.sparkSession
    sets = sets.where(F.col(key).isNotNull()).select(key, "n", "toks")
    held, total = _rarity(sets)
    frequent, blocks = _frequent(sets, held, threshold, tile)
    groups = max(LEAST_GROUPS, int(total * (1 - threshold)) // GROUP_TOKENS)
    shared = spark.sparkContext.broadcast((held, frequent, blocks))
    kind = sets.schema[key].dataType
    packed = T.StructType([T.StructField(key, kind), T.StructField("g", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("counts", T.BinaryType()),
                           T.StructField("toks", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType()))])
    met = (sets.select(key, F.xxhash64(key).alias("_k"), "toks").mapInArrow(_group_rows(shared, key, threshold, groups), packed).repartition(2 * groups, "g")
           .groupBy("g").applyInArrow(_candidates(key, threshold), T.StructType([T.StructField(c, kind) for c in ("x", "y")])))
    pairs = stored(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "candidate-pairs")
    edge = T.StructType([*(T.StructField(c, kind) for c in ("a", "b")), T.StructField("jaccard", T.DoubleType())])
    return in_tiles(pairs, sets.select(key, "toks"), key, 8 * total, _jaccards(key, threshold), edge)


def similarity_join(sets: DataFrame, key: str, threshold: float, tile: int = JOIN_TILE) -> DataFrame:
    """Edges (a, b, jaccard) with a < b and token-set Jaccard > threshold, among the given sets
    (call on representatives: identical sets are collapsed beforehand).

    Filters, all exact: prefix (a pair above the threshold shares a token among the first
    |x| − ⌈t·|x|⌉ + 1 rarest tokens of each set), length (t·|a| ≤ |b| ≤ |a|/t), position
    (tokens are in one global order, so every common token lies at or after the first common
    prefix position in both sets: overlap ≤ min(|a| − pos_a, |b| − pos_b), which must reach
    ⌈t/(1+t)·(|a|+|b|)⌉) and signature (parities of the tokens' hash bits differ in at most
    |a| + |b| − 2·overlap bits).  All are tested inside the join on the prefix token: at a pair's first
    common token they decide, later common tokens have higher positions.  Survivors are verified on their
    tokens, which travel as compressed bytes.

    The global order is (holders in the token's hash bucket, hash): the counts are a broadcast table of
    2^23 numbers, so only prefixes are shuffled.  Tokens of one hash share a place in every set, which
    adds candidates and loses none.

    The holders of a prefix token that more than ``tile`` prefixes hold are dealt into blocks by a hash
    of their key, and each pair of blocks is a join key of its own: a hot token spreads over tasks, a
    holder is copied once per block, and each pair still meets exactly once under the token.
    Thresholds below ``LOW_THRESHOLD`` go through ``grouped_join``."""
    if threshold < LOW_THRESHOLD:
        return grouped_join(sets, key, threshold, tile)
    sets = sets.where(F.col(key).isNotNull()).select(key, "toks")
    held, _ = _rarity(sets)
    shared = sets.sparkSession.sparkContext.broadcast((held, *_frequent(sets, held, threshold, tile)))
    marks = [f"s{w}" for w in range(SIGNATURE_WORDS)]
    kind = sets.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in ("tok", "place", *marks))])
    prefix = sets.select(key, F.xxhash64(key).alias("_k"), "toks").mapInArrow(_prefix_rows(shared, key, threshold), schema)
    a = prefix.select(F.col(key).alias("a"), "tok", F.col("place").alias("pa"), *[F.col(c).alias(f"a{c}") for c in marks])
    b = prefix.select(F.col(key).alias("b"), "tok", F.col("place").alias("pb"), *[F.col(c).alias(f"b{c}") for c in marks])
    na, nb = (F.shiftright(c, 33) for c in ("pa", "pb"))
    left = [F.shiftright(c, 33) - F.shiftright(c, 2).bitwiseAND(F.lit((1 << 31) - 1)) for c in ("pa", "pb")]
    sides = [F.col(c).bitwiseAND(F.lit(3)) for c in ("pa", "pb")]
    need = F.ceil(F.lit(threshold / (1.0 + threshold)) * (na + nb) - F.lit(1e-9))
    apart = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in marks), F.lit(0))
    # In a tile of two blocks, members of one block leave each other to that block's own tile.
    cand = (a.join(b, "tok").where((F.col("a") < F.col("b")) & ((sides[0] == 0) | (sides[0] != sides[1]))
                                   & (nb >= na * threshold) & (na >= nb * threshold)
                                   & (F.least(*left) >= need) & (apart <= na + nb - 2 * need))
            .select("a", "b", na.alias("na"), nb.alias("nb")).distinct())
    packed = sets.mapInArrow(_packed_sets(key), T.StructType([T.StructField(key, kind), T.StructField("_p", T.BinaryType())]))
    sa = packed.select(F.col(key).alias("a"), F.col("_p").alias("ta"))
    sb = packed.select(F.col(key).alias("b"), F.col("_p").alias("tb"))
    v = cand.join(sa, "a").join(sb, "b").select("a", "b", "na", "nb", _packed_common("ta", "tb").alias("inter"))
    v = v.select("a", "b", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("jaccard"))
    return v.where(F.col("jaccard") > threshold)


# ------------------------------------------------------------------ SI2
def greedy_independent_set(nodes: DataFrame, edges: DataFrame, key: str, max_rounds: int | None = None) -> DataFrame:
    """Lexicographically-first MIS: in key order, keep a node unless an earlier kept node is adjacent.

    Each round decides every node whose earlier neighbours are all decided: dropped when one of
    them is kept, kept when all are dropped.  The edges are computed once and checkpointed; edges into
    decided nodes leave after each round.  Returns (key, kept)."""
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    inc = edges.select(F.col("a").alias("src"), F.col("b").alias(key)).checkpoint(eager=True)  # a < b: a is earlier
    state = nodes.select(key).distinct().withColumn("st", F.lit("U"))
    state = state.checkpoint(eager=True)
    rounds = 0
    while True:
        undecided = state.where(F.col("st") == "U")
        if undecided.isEmpty():
            return state.select(key, (F.col("st") == "K").alias("kept"))
        s_src = state.select(F.col(key).alias("src"), F.col("st").alias("src_st"))
        info = (inc.join(undecided.select(key), key).join(s_src, "src")
                   .groupBy(key).agg(F.max((F.col("src_st") == "K").cast("int")).alias("has_k"),
                                     F.max((F.col("src_st") == "U").cast("int")).alias("has_u")))
        new = (state.join(info, key, "left")
               .withColumn("st", F.when(F.col("st") != "U", F.col("st"))
                           .when(F.coalesce("has_k", F.lit(0)) == 1, F.lit("D"))
                           .when(F.coalesce("has_u", F.lit(0)) == 0, F.lit("K"))
                           .otherwise(F.lit("U")))
               .select(key, "st"))
        state = new.checkpoint(eager=True)
        inc = inc.join(state.where(F.col("st") == "U").select(key), key, "left_semi").select("src", key).checkpoint(eager=True)
        rounds += 1
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError("greedy_independent_set did not converge")


def near_dedup(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """Keep a text iff its token Jaccard with every earlier *kept* text is ≤ threshold (and it is
    not an exact repeat).  Returns (key, kept) for every input row."""
    sets = token_sets(df, key, text)
    reps, members = collapse_identical_sets(sets, key)
    edges = similarity_join(reps, key, threshold)
    mis = greedy_independent_set(reps.select(key), edges, key)
    return (members.join(mis.withColumnRenamed(key, "rep"), "rep", "left")
            .select(key, (F.col("kept") & (F.col(key) == F.col("rep"))).alias("kept")))


# ------------------------------------------------------------------ SI3 / SI23 (given pairs)
@F.pandas_udf(T.DoubleType())
def char_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    both = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    out = np.zeros(len(a))
    out[both] = char_ratios(a.iloc[both].tolist(), b.iloc[both].tolist())
    return pd.Series(out)


def _pair_ratios(key: str):
    def run(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        texts = rows.column("text").to_pylist()
        met = list(_places(pairs, rows, key))
        ratio = np.zeros(len(met))
        whole = [k for k, (_, x, y) in enumerate(met) if texts[x] is not None and texts[y] is not None]
        ratio[whole] = char_ratios([texts[met[k][2]] for k in whole], [texts[met[k][1]] for k in whole])
        return pairs.select(["a", "b"]).take(pa.array([i for i, _, _ in met], pa.int64())).append_column("ratio", pa.array(ratio))
    return run


def char_ratio_pairs(pairs: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(a, b, ratio) for the pairs (a, b) of keys of ``texts`` (key, text): the Ratcliff–Obershelp ratio of the
    lower-cased texts, b's first.  Each two texts are compared once, whatever the number of their copies, and travel
    once to each tile of pairs; equal texts have ratio 1."""
    whole = texts.select(key, F.lower("text").alias("text")).withColumn("_t", F.unhex(F.md5("text")))
    named = whole.select(key, "_t")
    ends = stored(pairs.select("a", "b").join(named.select(F.col(key).alias("a"), F.col("_t").alias("_x")), "a")
                  .join(named.select(F.col(key).alias("b"), F.col("_t").alias("_y")), "b"), "text-pairs")
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    out = T.StructType([*(T.StructField(c, T.BinaryType()) for c in ("a", "b")), T.StructField("ratio", T.DoubleType())])
    unlike = ends.where("_x != _y").select(F.col("_x").alias("a"), F.col("_y").alias("b")).distinct()
    found = in_tiles(unlike, whole.select("_t", "text").dropDuplicates(["_t"]), "_t", size, _pair_ratios("_t"), out)
    ratio = F.when(F.col("_x").isNull() | F.col("_y").isNull(), 0.0).when(F.col("_x") == F.col("_y"), 1.0).otherwise(F.col("ratio"))
    return (ends.join(found.select(F.col("a").alias("_x"), F.col("b").alias("_y"), "ratio"), ["_x", "_y"], "left")
            .select("a", "b", ratio.alias("ratio")))


def spread_pairs(pairs: DataFrame) -> DataFrame:
    """Rows dealt evenly over several tasks a core before costly work on each: a table of few row groups is
    read by few tasks, and adaptive execution would join small partitions again."""
    spark = pairs.sparkSession
    return pairs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def char_similarity(a, b, lower: bool = True) -> Column:
    """Ratcliff–Obershelp ratio (difflib) of two texts; applied to given pairs only."""
    x, y = (F.lower(_c(a)), F.lower(_c(b))) if lower else (_c(a), _c(b))
    return char_ratio_udf(x, y)


def combined_similarity(a, b) -> Column:
    """SI23: .3·char ratio + .5·token Jaccard + .2·(1 − |len diff| / max len), rounded to 3;
    any empty text ⇒ 0."""
    x, y = _c(a), _c(b)
    la, lb = F.length(x), F.length(y)
    length_sim = 1 - F.abs(la - lb) / F.greatest(la, lb)
    jac = set_jaccard(tokens(x), tokens(y), 0.0, 0.0)
    s = 0.3 * char_similarity(x, y, lower=False) + 0.5 * jac + 0.2 * length_sim
    return F.when((la == 0) | (lb == 0) | x.isNull() | y.isNull(), F.lit(0.0)).otherwise(F.round(s, 3))


# ------------------------------------------------------------------ SI5 / SI14 – SI18
PAIR_BLOCK = 512  # distinct token sets of a block; a tile compares two blocks


def _common(nx: int, ny: int, rows: np.ndarray, cols: np.ndarray, n_ids: int) -> np.ndarray:
    """Common tokens of each set of x (rows below ``nx``) with each of y, from (row, token) places.

    Tokens on one side only are left out.  A token that few pairs share adds one to each of those pairs;
    the others are columns of a matrix product, in bounded slices."""
    inter = np.zeros((nx, ny))
    in_x = rows < nx
    cx, cy = (np.bincount(cols[side], minlength=n_ids) for side in (in_x, ~in_x))
    dense = cx * cy >= max(1, nx * ny // 128)
    few = (cx > 0) & (cy > 0) & ~dense
    xr, xc = rows[in_x & few[cols]], cols[in_x & few[cols]]
    y = np.flatnonzero(~in_x & few[cols])
    y = y[np.argsort(cols[y], kind="stable")]
    yr, first = rows[y] - nx, np.searchsorted(cols[y], np.arange(n_ids))
    times = cy[xc]
    ends = np.cumsum(times)
    a = 0
    while a < len(xc):  # about a million shared places at once
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 1_000_000, "right")))
        n = times[a:b]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[xc[a:b]], n)
        inter += np.bincount(np.repeat(xr[a:b], n) * ny + yr[at], minlength=nx * ny).reshape(nx, ny)
        a = b
    number = np.cumsum(dense) - 1
    rows, cols = rows[dense[cols]], number[cols[dense[cols]]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    n_dense = int(dense.sum())
    for a in range(0, n_dense, 4096):  # bounded slices of the vocabulary
        lo, hi = np.searchsorted(cols, [a, a + 4096])
        held = np.zeros((nx + ny, min(4096, n_dense - a)), np.float32)
        held[rows[lo:hi], cols[lo:hi] - a] = 1
        inter += held[:nx] @ held[nx:].T
    return inter


def _jaccard_sum(x: list, mx: np.ndarray, y: list, my: np.ndarray, both_empty: float, same: bool) -> float:
    """Σ m_a · m_b · Jaccard(a, b) over the sets of x and y (a before b when they are the same list)."""
    ids: dict = {}
    flat = [[ids.setdefault(t, len(ids)) for t in s] for s in (*x, *y)]
    sizes = np.array([len(s) for s in flat], float)
    rows = np.repeat(np.arange(len(flat)), sizes.astype(int))
    inter = _common(len(x), len(y), rows, np.array([t for s in flat for t in s], np.int64), len(ids))
    union = sizes[:len(x), None] + sizes[None, len(x):] - inter
    jac = np.where(union > 0, inter / np.maximum(union, 1), both_empty)
    total = jac * mx[:, None] * my[None, :]
    return float(np.triu(total, 1).sum() if same else total.sum())


def _pair_tiles(group: str, both_empty: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, part in pdf.groupby(group, sort=False, dropna=False):
            toks, m, side = [list(t) for t in part["toks"]], part["m"].to_numpy(float), part["_side"].to_numpy()
            first = np.flatnonzero(side < 2)
            second = first if (side == 0).all() else np.flatnonzero(side == 2)
            total = _jaccard_sum([toks[i] for i in first], m[first], [toks[i] for i in second], m[second], both_empty, bool((side == 0).all()))
            out.append((part[group].iloc[0], total))
        return pd.DataFrame(out, columns=[group, "_sum_x"])
    return run


def group_pair_similarity(df: DataFrame, group: str, item: str, text: str, both_empty: float) -> DataFrame:
    """Per group: number of items, Σ of pairwise token Jaccard over i < j, and the pair count.

    Identical token sets are collapsed first with their multiplicity m: they contribute
    C(m, 2) pairs of similarity 1 (``both_empty`` for empty sets) without being paired.  Distinct sets
    are dealt into blocks; a tile holds two blocks of a group (or many small groups whole), counts
    common tokens in arrays, and returns one partial sum per group: no pair is a row."""
    sets = df.select(group, item, F.array_distinct(tokens(text)).alias("toks"))
    canon = F.md5(F.array_join(F.array_sort("toks"), " "))
    d = sets.groupBy(group, canon.alias("_h")).agg(F.first("toks").alias("toks"), F.count("*").alias("m"))
    same = d.groupBy(group).agg(
        F.sum(F.col("m") * (F.col("m") - 1) / 2 * F.when(F.size("toks") == 0, F.lit(both_empty)).otherwise(F.lit(1.0))).alias("_sum_same"),
        F.sum("m").alias("n_items"), F.count("*").alias("_sets"))
    blocks = same.where(F.col("_sets") > 1).select(F.col(group).alias("_g"), F.ceil(F.col("_sets") / PAIR_BLOCK).cast("int").alias("_b"))
    many = d.agg(F.greatest(F.ceil(F.count("*") / (8 * PAIR_BLOCK)), F.lit(1))).scalar()
    dealt = d.join(blocks, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumn("_x", F.pmod(F.xxhash64("_h"), F.col("_b")).cast("int"))
    dealt = dealt.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    # Groups of one block share tiles; a larger group has tiles of its own.
    tile = F.when(F.col("_b") == 1, F.pmod(F.xxhash64(group), many)).otherwise(F.xxhash64(group))
    tiles = dealt.select(group, "toks", "m", (F.col("_b") > 1).alias("_large"), tile.alias("_tile"), F.least("_x", "_y").alias("_i"), F.greatest("_x", "_y").alias("_j"),
                         F.when(F.col("_x") == F.col("_y"), 0).when(F.col("_x") < F.col("_y"), 1).otherwise(2).alias("_side"))
    kind = df.schema[group].dataType
    schema = T.StructType([T.StructField(group, kind), T.StructField("_sum_x", T.DoubleType())])
    cross = (tiles.groupBy("_large", "_tile", "_i", "_j").applyInPandas(_pair_tiles(group, both_empty), schema)
             .groupBy(F.col(group).alias("_g")).agg(F.sum("_sum_x").alias("_sum_x")))
    j = same.join(cross, F.col(group).eqNullSafe(F.col("_g")), "left")
    n = F.col("n_items")
    return j.select(group, "n_items", (n * (n - 1) / 2).alias("n_pairs"),
                    (F.col("_sum_same") + F.coalesce("_sum_x", F.lit(0.0))).alias("sum_sim"))


def consistency(df: DataFrame, group: str, item: str, text: str) -> DataFrame:
    """SI14: mean pairwise Jaccard within the group (union 0 ⇒ 0); fewer than 2 ⇒ 1."""
    p = group_pair_similarity(df, group, item, text, both_empty=0.0)
    return p.select(group, "n_items", F.when(F.col("n_items") < 2, F.lit(1.0))
                    .otherwise(F.col("sum_sim") / F.col("n_pairs")).alias("consistency"))


def diversity(df: DataFrame, group: str, item: str, text: str) -> DataFrame:
    """SI5: 1 − mean pairwise similarity; 0 when the group has ≤ 1 item."""
    p = group_pair_similarity(df, group, item, text, both_empty=1.0)
    return p.select(group, "n_items", F.when(F.col("n_items") <= 1, F.lit(0.0))
                    .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sum_sim") / F.col("n_pairs")))).alias("diversity"))


def robustness(orig: DataFrame, noisy: DataFrame, group: str, idx: str, text: str) -> DataFrame:
    """SI15: mean Jaccard of aligned (group, idx) pairs; unequal sizes ⇒ 0."""
    o = orig.select(group, idx, F.col(text).alias("_a"))
    n = noisy.select(group, idx, F.col(text).alias("_b"))
    co = o.groupBy(group).agg(F.count("*").alias("_no"))
    cn = n.groupBy(group).agg(F.count("*").alias("_nn"))
    pairs = o.join(n, [group, idx]).groupBy(group).agg(F.avg(set_jaccard(tokens("_a"), tokens("_b"), 0.0, 0.0)).alias("_m"))
    return co.join(cn, group, "full_outer").join(pairs, group, "left").select(
        group, F.when(F.coalesce("_no", F.lit(0)) != F.coalesce("_nn", F.lit(0)), F.lit(0.0))
        .otherwise(F.coalesce("_m", F.lit(0.0))).alias("robustness"))


def variance_score(df: DataFrame, group: str, value) -> DataFrame:
    """SI16: 1 / (1 + sample variance); fewer than 2 values ⇒ 1."""
    v = _c(value)
    return df.groupBy(group).agg(F.when(F.count(v) < 2, F.lit(1.0)).otherwise(1.0 / (1.0 + F.var_samp(v))).alias("variance_score"))


def stability(df: DataFrame, group: str, item: str, text: str) -> DataFrame:
    """SI17: .7·consistency + .3·variance score of the response lengths (words)."""
    c = consistency(df, group, item, text)
    v = variance_score(df, group, F.size(split_ws(text)))
    return c.join(v, group).withColumn("stability", 0.7 * F.col("consistency") + 0.3 * F.col("variance_score"))


def cross_fold_stability(df: DataFrame, group: str, fold: str, item: str, text: str) -> DataFrame:
    """SI18: consistency per (group, fold) → mean · (1 − sample variance) over folds; < 2 folds ⇒ 0."""
    k = df.withColumn("_gf", F.to_json(F.struct(group, fold)))
    c = consistency(k, "_gf", item, text)
    c = c.select(F.from_json("_gf", T.StructType([df.schema[group]]))[group].alias(group), "consistency")
    return c.groupBy(group).agg(
        F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.avg("consistency") * (1 - F.var_samp("consistency"))).alias("cross_fold_stability"),
        F.count("*").alias("n_folds"))


# Word classes of the reference's semantic-consistency features.
SENTIMENT_WORDS = ["good", "bad", "excellent", "poor", "great", "terrible"]
QUESTION_WORDS = ["what", "how", "why", "when", "where", "who"]
ACTION_WORDS = ["analyze", "evaluate", "assess", "determine", "calculate"]


def word_class_consistency(df: DataFrame, group: str, text: str) -> DataFrame:
    """SI19: per class the count of its words per response; class consistency 1 (all equal) or
    1/(1+sample variance); their mean, and the sample variance of the summed counts."""
    t = tokens(text)
    cnt = lambda ws: F.size(F.filter(t, lambda w: w.isin(ws)))
    f = df.select(group, cnt(SENTIMENT_WORDS).alias("s"), cnt(QUESTION_WORDS).alias("q"), cnt(ACTION_WORDS).alias("a"))
    cons = lambda c: F.when(F.min(c) == F.max(c), F.lit(1.0)).otherwise(1.0 / (1.0 + F.var_samp(c)))
    g = f.groupBy(group).agg(F.count("*").alias("n"), cons("s").alias("_cs"), cons("q").alias("_cq"), cons("a").alias("_ca"),
                             F.var_samp(F.col("s") + F.col("q") + F.col("a")).alias("_sv"))
    return g.select(group, F.when(F.col("n") < 2, F.lit(1.0)).otherwise((F.col("_cs") + F.col("_cq") + F.col("_ca")) / 3).alias("semantic_consistency"),
                    F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("_sv")).alias("semantic_variance"))


def structural_consistency(text) -> Column:
    """SI20: (has . ! ?, no whitespace run of 2+, stripped text all-lower or all-upper) / 3.
    Case is tested through character classes (no upper-casing: 'ß' would become 'SS')."""
    t = _c(text)
    s = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    lower_eq = ~s.rlike(r"[\p{Lu}\p{Lt}]")
    upper_eq = ~s.rlike(r"[\p{Ll}\p{Lt}]")
    parts = [t.rlike(r"[.!?]"), ~t.rlike(r"(?U)\s{2,}"), lower_eq | upper_eq]
    return sum((p.cast("double") for p in parts), F.lit(0.0)) / 3.0


# Template verbs of the reference's template extraction.
TEMPLATE_VERBS = ["please", "provide", "explain", "describe", "analyze"]


def template_terms(df: DataFrame, text: str) -> DataFrame:
    """SI22: the 10 most frequent words (ties by word), kept if a template verb, first three."""
    top = (df.select(F.explode(tokens(text)).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
             .orderBy(F.col("c").desc(), "w").limit(10))
    kept = top.where(F.col("w").isin(TEMPLATE_VERBS))
    return kept.agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("c"), F.col("w")))), lambda s: s["w"]), 1, 3)
                    .alias("terms"), F.count("*").alias("n_verbs"))


# ------------------------------------------------------------------ SI6 diversity pick
PICK_GROUPS = 1000  # newest picks that are broadcast to all texts
FIRST_COMPARED = 64  # texts of a group by which the first scores are bounded


def diversity_pick(df: DataFrame, group: str, key: str, text: str, quality: str, k: int = 10, w: float = 0.3) -> DataFrame:
    """Greedy quality + diversity selection of up to k items per group: start at the best quality;
    then argmax (1−w)·quality + w·(1 − min char-similarity to the chosen items), first on ties.

    A ratio lies in [0, 1], so that a text's quality bounds its score from both sides, and for w ≥ 0 a score only
    rises from pick to pick.  A round compares the texts whose highest possible score reaches the best score known to
    be reached, each with the picks that it has not met: the others cannot be chosen.  Texts are stored once, under row
    numbers and ordered by that bound inside each file, so that a round reads the first pages; the state is narrow."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = spread_pairs(df.select(group, key, F.lower(F.col(text)).alias("_t"), F.col(quality).alias("_q")))
    texts = stored(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_most", (1 - w) * F.col("_q") + max(w, 0.0))
                   .sortWithinPartitions(F.col("_most").desc()), "texts")
    cur = texts.select("_row", group, key, "_q", "_most", F.lit(None).cast("double").alias("_min_sim"), F.lit(0).alias("_seen"), F.lit(None).cast("int").alias("rank"))
    first = cur.groupBy(group).agg(F.max_by(F.col(key), F.struct(F.col("_q"), -F.col(key))).alias("_pick")).where(F.col("_pick").isNotNull())
    cur = cur.join(first, group).withColumn("rank", F.when(F.col(key) == F.col("_pick"), F.lit(0))).drop("_pick")
    cur = cur.checkpoint(eager=True)
    score = (1 - w) * F.col("_q") + w * (1 - F.col("_min_sim"))

    # What there is once a group goes to the texts, if the groups are few, not the texts to a shuffle.
    few = F.broadcast if first.limit(PICK_GROUPS + 1).count() <= PICK_GROUPS else (lambda some: some)

    def texts_of(some: DataFrame) -> tuple[DataFrame, int]:
        low, unknown, n = some.agg(F.min("_most"), F.count(F.when(F.col("_most").isNull() | F.isnan("_most"), 1)), F.count(F.lit(1))).first()
        near = texts if low is None or unknown else texts.where(F.col("_most") >= low)
        ids = some.drop("_most")
        return near.select("_row", "_t").join(F.broadcast(ids) if n <= FEW_KEYS else ids, "_row"), n

    def compared(cur: DataFrame, some: DataFrame, r: int) -> DataFrame:
        near, n = texts_of(some.select("_row", group, "_seen", "_most"))
        pairs = near.join(few(picks), group).where(F.col("rank") >= F.col("_seen"))
        sims = pairs.select("_row", char_ratio_udf(F.col("_t"), F.col("_pt")).alias("_s")).groupBy("_row").agg(F.min("_s").alias("_s")).checkpoint(eager=True)
        return (cur.join(F.broadcast(sims) if n <= FEW_KEYS else sims, "_row", "left").withColumn("_min_sim", F.least("_min_sim", "_s"))
                .withColumn("_seen", F.when(F.col("_s").isNotNull(), F.lit(r)).otherwise(F.col("_seen"))).drop("_s"))

    picks = None
    for r in range(1, k):
        newest = texts_of(cur.where(F.col("rank") == r - 1).select("_row", group, "rank", "_most"))[0].select(group, "rank", F.col("_t").alias("_pt")).checkpoint(eager=True)
        picks = picks.unionByName(newest) if picks is not None else newest
        if r == 1:
            order = Window.partitionBy(group).orderBy(F.col("_most").desc(), F.col(key))
            top = cur.where(F.col("rank").isNull() & F.col("_q").isNotNull()).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FIRST_COMPARED)
            cur = compared(cur, top, r)
        open_ = cur.where(F.col("rank").isNull())
        # What a text reaches at least: its score with the picks it has met, if it can only rise.
        least = F.when(F.col("_seen") == r, score).otherwise((1 - w) * F.col("_q") + w * (1 - F.coalesce("_min_sim", F.lit(1.0))) if w >= 0 else (1 - w) * F.col("_q") + w)
        reached = open_.groupBy(group).agg(F.max(least).alias("_reached"))
        cur = compared(cur, open_.join(few(reached), group).where((F.col("_most") >= F.col("_reached")) & (F.col("_seen") < r)), r)
        best = (cur.where(F.col("rank").isNull() & ((F.col("_seen") == r) | F.col("_q").isNull()))
                .groupBy(group).agg(F.max_by(F.col(key), F.struct(F.when(F.col("_seen") == r, score), -F.col(key))).alias("_pick")))
        cur = (cur.join(few(best), group, "left")
               .withColumn("rank", F.when(F.col("rank").isNotNull(), F.col("rank"))
                           .when(F.col(key) == F.col("_pick"), F.lit(r))).drop("_pick")).checkpoint(eager=True)
    picked = cur.where(F.col("rank").isNotNull())
    # Rows of a repeated key are picked together; a round joins each row of a group with each row of its newest pick,
    # so it returns them as often as these joins do, unless that is more than any run could write.
    held = picked.where(F.col("rank") < k - 1).groupBy(group, "rank").agg(F.count(F.lit(1)).alias("_n")).groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "_n"))), lambda x: x["_n"].cast("double")).alias("_held"))
    times = F.aggregate("_held", F.lit(1.0), lambda m, n: m * m * n)
    copies = held.select(group, F.when(times < 2.0 ** 31, times.cast("int")).otherwise(F.lit(1)).alias("_copies"))
    return (picked.join(few(copies), group, "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("_copies", F.lit(1)))))
            .select(group, key, "rank", F.col("_q").alias(quality)))


# ------------------------------------------------------------------ SI7 – SI11, SI13
def quality_filter(df: DataFrame, score: str, threshold: float = 0.6) -> DataFrame:
    return df.where(F.col(score) >= threshold)


def variant_quality(clarity, specificity, coherence) -> Column:
    """SI8: .4·clarity + .3·specificity + .3·coherence, a missing score counts .5, clamped."""
    f = lambda c: F.coalesce(_c(c), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * f(clarity) + 0.3 * f(specificity) + 0.3 * f(coherence)))


def strategy_rollup(df: DataFrame, strategy: str, quality: str, div: str, time: str) -> DataFrame:
    """SI9: count, mean quality / diversity / time, min and max quality per strategy."""
    return df.groupBy(strategy).agg(F.count("*").alias("count"), F.avg(quality).alias("avg_quality"),
                                    F.avg(div).alias("avg_diversity"), F.avg(time).alias("avg_generation_time"),
                                    F.min(quality).alias("min_quality"), F.max(quality).alias("max_quality"))


def generation_stats(df: DataFrame, quality: str, time: str) -> DataFrame:
    """SI10: count, min / max / mean / population std of quality, Σ generation time."""
    return df.agg(F.count("*").alias("total_variants"), F.min(quality).alias("min_quality"), F.max(quality).alias("max_quality"),
                  F.avg(quality).alias("avg_quality"), F.stddev_pop(quality).alias("std_quality"),
                  F.sum(time).alias("total_generation_time"))


def best_n(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """SI11: top n by score, stable on key (TakeOrderedAndProject)."""
    return df.orderBy(F.col(score).desc(), F.col(key)).limit(n)


def pareto_front(df: DataFrame, x: str, y: str, *more: str) -> DataFrame:
    """SI12: rows not dominated when maximising all objectives (duplicates stay).  With two, a point
    survives iff y ≥ the max y at its own x and y > the max y over every larger x; three or more go
    through :func:`skyline`."""
    if more:
        return skyline(df, [x, y, *more])
    per_x = df.groupBy(x).agg(F.max(y).alias("_my"))
    sfx = with_prefix_max(per_x, [F.col(x).desc()], "_my", "_above", exclusive=True)
    j = df.join(sfx.select(x, "_my", "_above"), x)
    return j.where((F.col(y) >= F.col("_my")) & (F.col("_above").isNull() | (F.col(y) > F.col("_above")))).drop("_my", "_above")


def multi_objective(df: DataFrame, key: str, objectives: dict[str, float], k: int = 10) -> DataFrame:
    """SI13: weighted score, non-dominated filter over all objectives, then the best k."""
    cols = list(objectives)
    ws = sum((F.col(c) * float(wt) for c, wt in objectives.items()), F.lit(0.0))
    scored = df.withColumn("weighted_score", ws)
    front = skyline(scored, cols) if len(cols) < 2 else pareto_front(scored, *cols)
    return best_n(front, "weighted_score", key, k)


# ------------------------------------------------------------------ SI25 / SI26
# Clause templates of the simple variant generator.
VARIANT_PREFIXES = ["Please carefully", "Think step by step and", "Consider the context and", "Using your expertise,"]
VARIANT_SUFFIXES = ["Provide a detailed explanation.", "Be concise and accurate.", "Consider multiple perspectives.",
                    "Focus on the key points."]


# Clauses that the stable-prompt variants append.
CONSISTENCY_CLAUSES = ["Please provide a consistent and reliable response.",
                       "Ensure your answer follows the same format and style.",
                       "Maintain consistency in your reasoning approach.",
                       "Use a systematic method to approach this task."]
ROBUSTNESS_CLAUSES = ["Consider edge cases and variations in your response.",
                      "Provide a robust answer that works across different scenarios.",
                      "Ensure your response is stable and reliable.",
                      "Account for potential variations in the input."]


def expand_clauses(df: DataFrame, key: str, text: str) -> DataFrame:
    """SI25: the text with each consistency clause as a paragraph of its own, and with each robustness
    clause after it: all clauses, not one drawn at random."""
    t = F.col(text)
    variants = ([F.struct(F.lit(f"consistency{i}").alias("kind"), F.concat(t, F.lit("\n\n" + c)).alias("variant"))
                 for i, c in enumerate(CONSISTENCY_CLAUSES)]
                + [F.struct(F.lit(f"robustness{i}").alias("kind"), F.concat(t, F.lit(" " + c)).alias("variant"))
                   for i, c in enumerate(ROBUSTNESS_CLAUSES)])
    return df.select(key, F.explode(F.array(*variants)).alias("v")).select(key, "v.kind", "v.variant")


def expand_templates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every prefix with the lower-cased text and every suffix after the text: an in-row explode of
    a literal array (no join)."""
    t = F.col(text)
    variants = ([F.struct(F.lit(f"prefix{i}").alias("kind"), F.concat(F.lit(p + " "), F.lower(t)).alias("variant"))
                 for i, p in enumerate(VARIANT_PREFIXES)]
                + [F.struct(F.lit(f"suffix{i}").alias("kind"), F.concat(t, F.lit(" " + s)).alias("variant"))
                   for i, s in enumerate(VARIANT_SUFFIXES)])
    return df.select(key, F.explode(F.array(*variants)).alias("v")).select(key, "v.kind", "v.variant")


def line_diff(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Line i of A against line i of B: unchanged / added / removed / modified (blank = absent)."""
    la = df.select(key, F.posexplode(F.split(a, "\n", -1)).alias("pos", "la"))
    lb = df.select(key, F.posexplode(F.split(b, "\n", -1)).alias("pos", "lb"))
    j = la.join(lb, [key, "pos"], "full_outer")
    ea, eb = F.coalesce(F.col("la"), F.lit("")) == "", F.coalesce(F.col("lb"), F.lit("")) == ""
    status = (F.when(ea & eb, F.lit(None)).when(ea, "added").when(eb, "removed")
               .when(F.col("la") == F.col("lb"), "unchanged").otherwise("modified"))
    return j.select(key, "pos", status.alias("status")).where(F.col("status").isNotNull())


# ------------------------------------------------------------------ SI21 noise injection
def inject_noise(df: DataFrame, key: str, text: str, levels: list[float], seed: int = 7) -> DataFrame:
    """For each level: change one character in ``int(words·level)`` words (words of length > 1),
    chosen by a hash of (seed, level, key, word index); the replacement position and letter come
    from the same hash, so the result is reproducible and independent of partitioning."""
    lv = F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level")
    base = df.select(key, F.col(text).alias("_t"), lv).withColumn("_w", split_ws("_t"))

    def h(i):
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("level").cast("string"),
                                                    F.col(key).cast("string"), i.cast("string"))), 1, 12), 16, 10).cast("long")

    k = F.floor(F.size("_w") * F.col("level")).cast("int")
    # rank of every word index by its hash: index i is chosen when fewer than k indices hash lower
    ranked = base.withColumn("_hs", F.transform("_w", lambda w, i: F.struct(h(i).alias("h"), i.alias("i"))))
    chosen = ranked.withColumn("_sel", F.transform(F.slice(F.array_sort("_hs"), 1, F.greatest(k, F.lit(0))), lambda s: s["i"]))

    def mutate(w, i):
        hv = h(i)
        pos = (hv % F.length(w)).cast("int")
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), ((F.floor(hv / 7) % 26) + 1).cast("int"), 1)
        new = F.concat(F.substring(w, 1, pos), letter, F.substring(w, pos + 2, 1 << 30))
        return F.when(F.array_contains(F.col("_sel"), i) & (F.length(w) > 1), new).otherwise(w)

    noisy = chosen.withColumn("noisy", F.when(k == 0, F.col("_t")).otherwise(F.array_join(F.transform("_w", mutate), " ")))
    return noisy.select(key, "level", F.col("_t").alias("original"), "noisy")


def noise_robustness(noisy: DataFrame, key: str) -> DataFrame:
    """Per key: Jaccard of original and noisy tokens per level, and their mean over levels."""
    per = noisy.withColumn("robustness", set_jaccard(tokens("original"), tokens("noisy"), 0.0, 0.0))
    return per.groupBy(key).agg(F.avg("robustness").alias("overall_robustness"),
                                F.map_from_entries(F.collect_list(F.struct(F.col("level").cast("string"), "robustness"))).alias("by_level"))


# ------------------------------------------------------------------ SI24 parameter grid
def parameter_grid(axes: dict[str, DataFrame], max_combinations: int | None = None) -> DataFrame:
    """Cartesian product of the parameter values (each axis: one column of values, sorted), in
    key order (the first axis varies slowest); ``max_combinations`` asks for the first ones only.
    Each axis becomes one sorted array in a single row; the product is an in-row explode — no join."""
    names = list(axes)
    arrays = [axes[n].agg(F.array_sort(F.collect_set(n))).scalar().alias(n) for n in names]
    out = axes[names[0]].sparkSession.range(1).select(*arrays)
    for n in names:
        out = out.select(*[c for c in out.columns if c != n], F.posexplode(n).alias(f"_{n}_i", n))
    order = [F.col(f"_{n}_i") for n in names]
    out = out.orderBy(*order)
    return (out.limit(max_combinations) if max_combinations else out).select(*names)

"""Near copies by Jaccard similarity of word shingles, with signature trees.

Sets of shingle hashes (62 bits or more) are handled in four steps; every one is exact on the hashes.

1. *Counting.*  Shingle hashes are dealt out by their top bits, packed in arrays by map task.  A bin's
   task finds the hashes that several documents hold and returns those to the documents, with a class
   of how frequent they are.  A document with fewer than ``threshold`` of its shingles shared has no
   link and leaves.
2. *Collapsing.*  Equal sets become one row.
3. *Contracting.*  Sets that meet under a min-hash are compared with up to a few pivots; verified links
   join sets into components.  Rounds with fresh min-hashes go on for the sets whose rare shingles
   still lie in several components, as long as they join a share of them, so that the members of a
   large group end in one component before any pair is made.  This only saves work; it decides
   nothing alone.
4. *Signature trees.*  Linked sets share a shingle among the rarest of each (prefix filter).  Under
   each such shingle that lies in two or more components, the sets form a tree whose nodes hold the
   OR of their members' bitmaps and their range of sizes.  Pairs of nodes are walked down together;
   a pair is left as soon as the bitmaps and sizes allow no sufficient overlap.  The pairs of sets that
   remain are verified on the full sets: first, in turns, a forest of them between the components,
   fewer rows than sets; then, when a turn joins no more, all pairs between components that are still apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import settled, text_rows, written
from evalspark.llm.components import components
from evalspark.llm.words import U, Words, mix, slices

TOKEN_BYTES = 7  # of a hash; the bin's number gives its top bits too: 62 to 64 bits in all
SIGNATURE_WORDS = 32  # 2,048 bits
BLOCK = 1024  # sets compared at once
FORESTS = 3  # turns that verify a forest of candidates before all that remain


def _shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct shingles, sorted; a text of fewer words is one shingle."""
    hashes = w.hashes(3, lower=True)
    at = np.flatnonzero(w.fits(k))
    doc, key = w.doc[at], w.windows(hashes, k)[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = np.asarray([w.windows(hashes[w.first[d]:w.first[d + 1]], int(w.counts[d]))[0] for d in short.tolist()], U)
        doc, key = np.concatenate([doc, short]), np.concatenate([key, whole])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new]


def _pack(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).reshape(-1)


def _unpack(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    full = np.zeros((len(part), 8), np.uint8)
    full[:, :TOKEN_BYTES] = part
    return full.reshape(-1).view("<u8")


def bin_bits(partitions: int) -> int:
    """Bins for the counting step: a power of two that follows the session's shuffle partitions, so that
    a bin is what one task holds at any size of the input."""
    return min(16, max(6, (partitions - 1).bit_length()))


def _chunk_rows(k: int, bits: int):
    """Of each slice of texts one row per bin: ids, set sizes (once per text, else 0), counts, hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(a, b - a).to_numpy(zero_copy_only=False)
                doc, key = _shingles(w, k)
                size = np.bincount(doc, minlength=b - a)
                group = (key >> U(64 - bits)).astype(np.int64)
                # A text's size travels with its first shingle; a text without any goes to bin 0.
                bare = np.flatnonzero(size == 0)
                order = np.argsort(group, kind="stable")
                doc, key, group = doc[order], key[order], group[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(doc)))
                run_doc, run_bin = doc[at], group[at]
                told = np.zeros(len(at), np.int64)
                first = np.unique(run_doc, return_index=True)[1]
                told[first] = size[run_doc[first]]
                edges = np.searchsorted(run_bin, np.arange((1 << bits) + 1))
                places = np.append(at, len(doc))
                out: list[tuple] = []
                for g in range(1 << bits):
                    i, j = int(edges[g]), int(edges[g + 1])
                    extra = bare if g == 0 else bare[:0]
                    if i == j and not len(extra):
                        continue
                    zeros = np.zeros(len(extra), np.int64)
                    out.append((g, np.concatenate([ids[run_doc[i:j]], ids[extra]]).astype("<i8").tobytes(),
                                np.concatenate([told[i:j], zeros]).astype("<i4").tobytes(),
                                np.concatenate([count[i:j], zeros]).astype("<i4").tobytes(),
                                _pack(key[places[i]:places[j]]).tobytes()))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]],
                                                     names=["bin", "ids", "sizes", "counts", "keys"])
    return run


def _runs(column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of a partition sorted by ``column``, one value at a time."""
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        values = batch.column(column).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for i, j in zip(edges[:-1], edges[1:]):
            if i == j:
                continue
            if held and values[i] != value:
                yield value, held
                held = []
            value = values[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield value, held


def _shared_rows(bits: int):
    """(doc_id, part): of each text in a bin, the hashes that other texts hold too; a part is the set's
    size (or 0, as it is told once), then the hashes, then their frequency classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, parts in _runs("bin", batches):
            yield from _shared_in_bin(int(g), parts, bits)
    return run


def _shared_in_bin(g: int, parts: list[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    joined = {n: b"".join(x for p in parts for x in p.column(n).to_pylist()) for n in ("ids", "sizes", "counts", "keys")}
    ids, sizes, counts = (np.frombuffer(joined[n], t) for n, t in (("ids", "<i8"), ("sizes", "<i4"), ("counts", "<i4")))
    keys = _unpack(joined["keys"])
    holder = np.repeat(np.arange(len(ids)), counts)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(keys)))
    frequency = np.empty(len(keys), np.int64)
    frequency[order] = np.repeat(times, times)
    shared = np.flatnonzero(frequency > 1)
    holder, keys = holder[shared], keys[shared]
    classes = np.minimum(255, np.floor(8 * np.log2(frequency[shared]))).astype(np.uint8)
    many = np.bincount(holder, minlength=len(ids))
    send = np.flatnonzero((many > 0) | (sizes > 0) | (counts == 0))
    ends = np.cumsum(many)
    packed, told = _pack(keys), sizes.astype("<u4")
    for i in range(0, len(send), 4096):
        some = send[i:i + 4096].tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[some]),
             pa.array([bytes((g & 255, g >> 8)) + told[x].tobytes()
                       + packed[TOKEN_BYTES * (ends[x] - many[x]):TOKEN_BYTES * ends[x]].tobytes()
                       + classes[ends[x] - many[x]:ends[x]].tobytes() for x in some], pa.binary())],
            names=["doc_id", "part"])


def _batched(items: Iterator, size: int) -> Iterator[list]:
    held = []
    for x in items:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _enough(overlap, n, m, percent: int):
    """100 * overlap >= percent * union."""
    return (100 + percent) * overlap >= percent * (n + m)


def _whole(parts: list[bytes], bits: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Size, hashes and frequency classes of a text's parts."""
    n, keys, classes = 0, [], []
    for part in parts:
        m = (len(part) - 6) // (TOKEN_BYTES + 1)
        n = max(n, int.from_bytes(part[2:6], "little"))
        cut = 6 + TOKEN_BYTES * m
        top = U(part[0] | part[1] << 8) << U(64 - bits)
        keys.append(_unpack(part[6:cut]) & ~(U((1 << bits) - 1) << U(64 - bits)) | top)
        classes.append(np.frombuffer(part[cut:], np.uint8))
    return n, np.concatenate(keys).astype("<u8"), np.concatenate(classes)


def _set_rows(percent: int, bits: int):
    """Texts with enough shared shingles as sets: hashes sorted by frequency class, then hash, and a
    fingerprint that equal whole sets have in common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batched(_runs("doc_id", batches), 1000):
            out: list[tuple] = []
            for doc, parts in held:
                n, key, rare = _whole([x for p in parts for x in p.column("part").to_pylist()], bits)
                key, at = np.unique(key, return_index=True)
                if n and 100 * len(key) >= percent * n:
                    order = np.lexsort((key, rare[at]))
                    mark = hashlib.blake2b(key.tobytes(), digest_size=16).digest() if len(key) == n else b"id" + int(doc).to_bytes(8, "little", signed=True)
                    out.append((doc, n, mark, key[order].tobytes()))
                else:
                    out.append((doc, n, None, None))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                             names=["doc_id", "n", "mark", "keys"])
    return run


def _stars(block: list[tuple[int, int, int, np.ndarray]], percent: int, pivots: int) -> list[tuple[int, int]]:
    """Verified links between components, (component, component), of up to ``pivots`` sets with all others
    of the block; a pivot is a set whose component no earlier pivot's links have reached.  Of all links
    found, a spanning forest is returned, less than one link per set."""
    links: list[tuple[int, int]] = []
    up = {c: c for _, c, _, _ in block}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    if len(up) < 2:
        return links
    comps = np.asarray([c for _, c, _, _ in block])
    sizes = np.asarray([n for _, _, n, _ in block])
    lengths = np.asarray([len(k) for *_, k in block])
    every, starts = np.concatenate([k for *_, k in block]), np.cumsum(lengths) - lengths
    free = np.ones(len(block), bool)
    for _ in range(pivots):
        if not free.any():
            break
        p = int(np.argmax(free))
        free[p] = False
        inside = np.isin(every, block[p][3])
        hit = _enough(np.add.reduceat(inside.astype(np.int64), starts), sizes[p], sizes, percent)
        for i in np.flatnonzero(hit & (comps != comps[p])).tolist():
            x, y = top(int(comps[p])), top(int(comps[i]))
            if x != y:
                up[y] = x
                links.append((int(comps[p]), int(comps[i])))
        free &= ~hit & (comps != comps[p])
    return links


def _star_rows(percent: int, pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _runs("meet", batches):
            block: list[tuple[int, int, int, np.ndarray]] = []
            links: list[tuple[int, int]] = []
            for part in parts:
                for doc, comp, n, keys in zip(*(part.column(c).to_pylist() for c in ("doc_id", "component", "n", "keys"))):
                    block.append((doc, comp, n, np.frombuffer(keys, "<u8")))
                    if len(block) == BLOCK:
                        links += _stars(block, percent, pivots)
                        block = block[:1]
            links += _stars(block, percent, pivots)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])
    return run


def _signature(keys: np.ndarray) -> tuple[bytes, int]:
    """Bitmap of the hashes, and how many fell on a bit that was set already."""
    bits = np.zeros(SIGNATURE_WORDS * 64, np.uint8)
    bits[(mix(keys.astype(U)) % U(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits).tobytes(), len(keys) - int(bits.sum())


class Node:
    """A tree node: OR of the members' bitmaps, range of sizes, most collisions; leaves are sets."""

    __slots__ = ("bits", "collided", "component", "high", "id", "low", "parts")

    def __init__(self, parts=None, **leaf):
        self.parts = parts
        if parts is None:
            for k, v in leaf.items():
                setattr(self, k, v)
        else:
            self.bits = np.bitwise_or.reduce([p.bits for p in parts])
            self.low, self.high = min(p.low for p in parts), max(p.high for p in parts)
            self.collided = max(p.collided for p in parts)
            ids = {p.component for p in parts}
            self.component = ids.pop() if len(ids) == 1 else None


def build_tree(leaves: list[Node], fan: int = 4) -> Node:
    """Members of one component stand side by side, by size; ``fan`` neighbours share a parent."""
    level = sorted(leaves, key=lambda x: (x.component, x.low, x.id))
    while len(level) > 1:
        level = [Node(level[i:i + fan]) if len(level[i:i + fan]) > 1 else level[i] for i in range(0, len(level), fan)]
    return level[0]


def walk(x: Node, y: Node, percent: int, emit: Callable[[Node, Node], None]) -> None:
    """Dual traversal: pairs of leaves of different components that the bounds cannot exclude."""
    stack = [(x, y)]
    while stack:
        x, y = stack.pop()
        if x.component is not None and x.component == y.component:
            continue
        if x is not y:
            # Linked sets differ in size by the threshold at most, and overlap in enough common bits.
            if 100 * min(x.high, y.high) < percent * max(x.low, y.low):
                continue
            common = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.collided, y.collided)
            if not _enough(common, x.low, y.low, percent):
                continue
        if x.parts is None and y.parts is None:
            if x is not y:
                emit(x, y)
        elif x is y:
            stack += [(a, b) for i, a in enumerate(x.parts) for b in x.parts[i:]]
        elif y.parts is None or (x.parts is not None and x.high - x.low >= y.high - y.low):
            stack += [(a, y) for a in x.parts]
        else:
            stack += [(x, b) for b in y.parts]


def _forest(pairs: list[tuple[Node, Node]], up: dict[int, int], turn: int) -> list[tuple[int, int]]:
    """Of candidate pairs, in an order of the turn's own, those that join components which earlier ones
    have not joined: fewer than one per component."""
    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k in np.random.default_rng(turn).permutation(len(pairs)).tolist():
        x, y = pairs[k]
        a, b = top(x.component), top(y.component)
        if a != b:
            up[b] = a
            out.append((min(x.id, y.id), max(x.id, y.id)))
    return out


def _pair_rows(percent: int, turn: int | None):
    """Candidate pairs under one shingle and tile (a pair of blocks of its sets): with a ``turn`` a forest
    of them between the components, else all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        up: dict[int, int] = {}
        for tile, parts in _runs("tile", batches):
            groups: dict[tuple, list[tuple[int, Node]]] = {}
            for part in parts:
                cols = (part.column(c).to_pylist() for c in ("token", "i", "j", "block", "doc_id", "component", "n", "bits", "collided"))
                for token, i, j, blk, doc, comp, n, bits, collided in zip(*cols):
                    leaf = Node(id=doc, component=comp, low=n, high=n, bits=np.frombuffer(bits, np.uint64), collided=collided)
                    groups.setdefault((token, i, j), []).append((blk, leaf))
            out: list[tuple[int, int]] = []
            met: list[tuple[Node, Node]] = []

            def emit(x: Node, y: Node) -> None:
                pair = (min(x.id, y.id), max(x.id, y.id))
                if turn is not None:
                    met.append((x, y))
                elif pair not in done:
                    done.add(pair)
                    out.append(pair)

            for (_, i, j), members in groups.items():
                left = [leaf for blk, leaf in members if blk == i]
                right = [leaf for blk, leaf in members if blk == j]
                if i == j:
                    if len({leaf.component for leaf in left}) > 1:
                        tree = build_tree(left)
                        walk(tree, tree, percent, emit)
                elif left and right:
                    walk(build_tree(left), build_tree(right), percent, emit)
                out += _forest(met, up, turn or 0)
                met.clear()
                if len(done) > 1_000_000:  # only spares repeated output
                    done.clear()
                if len(up) > 1_000_000:
                    up.clear()
            for a in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[a:a + 10_000])], names=["a", "b"])
    return run


def _verified_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "m", "x", "y"))):
                overlap = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                if _enough(overlap, n, m, percent):
                    out.append((a, b))
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])
    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets overlap enough."""
    first = sets.select(F.col("doc_id").alias("a"), "n", F.col("keys").alias("x"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("keys").alias("y"))
    near = pairs.join(first, "a").join(second, "b").select("a", "b", "n", "m", "x", "y")
    return near.mapInArrow(_verified_rows(percent), "a long, b long")


def _meeting_rows(hashes: int, first: int):
    """Each set under its smallest mixed hash, for ``hashes`` mixes from number ``first`` on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, keys in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "keys"))):
                key = np.frombuffer(keys, "<u8").astype(U)
                out += [(int(mix(key + U(h * 0x51ED27)).min().view(np.int64)), doc) for h in range(first, first + hashes)]
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["meet", "doc_id"])
    return run


def _prefix_rows(percent: int):
    """(token, doc_id, n): the rarest shingles of each set, of which a linked set holds one at least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, n, keys in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "keys"))):
                key = np.frombuffer(keys, "<i8")
                # n - ceil(percent * n / 100) + 1 in the order "unshared first": those come off the front.
                length = n - -(-percent * n // 100) + 1 - (n - len(key))
                head = key[:max(0, length)]
                if len(head):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(head), pa.array(np.full(len(head), doc)), pa.array(np.full(len(head), n))], names=["token", "doc_id", "n"])
    return run


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_signature(np.frombuffer(k, "<u8")) for k in batch.column("keys").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m[0] for m in made], pa.binary()),
                                          pa.array([m[1] for m in made], pa.int64())], names=["doc_id", "bits", "collided"])


def near_copies(docs: DataFrame, percent: int = 75, shingle: int = 5, pivots: int = 8, meetings: int = 2,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document id: doc_id, n_shingles, component_id.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case; a set holds the
    distinct ``shingle``-word shingles, or the whole sequence if it is shorter.  Two documents link if
    100 * intersection >= percent * union; component_id is the smallest id reachable by links.  Null,
    empty and blank texts have an empty set and no link.  Rows without an id are left out; rows that
    share an id are one document.  An empty table gives an empty result; other columns are ignored.
    The result is a written table; the larger ones made on the way are deleted.
    """
    return settled(docs.sparkSession, "near-copies", lambda: _near_copies(docs, percent, shingle, pivots, meetings, id_col, text_col))


def _near_copies(docs: DataFrame, percent: int, shingle: int, pivots: int, meetings: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    bits = bin_bits(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = text_rows(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    chunks = rows.mapInArrow(_chunk_rows(shingle, bits), "bin int, ids binary, sizes binary, counts binary, keys binary")
    shared = (chunks.repartition(1 << bits, "bin").sortWithinPartitions("bin")
              .mapInArrow(_shared_rows(bits), "doc_id long, part binary"))
    # A document's parts are bounded by its own length.
    by_doc = shared.repartition("doc_id").sortWithinPartitions("doc_id")
    sized = written(by_doc.mapInArrow(_set_rows(percent, bits), "doc_id long, n long, mark binary, keys binary"), "shingle-sets")

    live = sized.where(F.col("mark").isNotNull())
    # Equal sets are one: the smallest id stands for them.
    sets = written(live.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("keys").alias("keys"))
                   .select("mark", "doc_id", "n", "keys"), "distinct-sets")
    members = live.select("doc_id", "mark").join(sets.select("mark", F.col("doc_id").alias("stands")), "mark").select("doc_id", "stands")

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))

    def stars(some: DataFrame, turn: int) -> DataFrame:
        """Links between components among ``some`` (doc_id, component); a frequent meeting is cut into
        blocks by a hash of the id."""
        met = (sets.join(some.select("doc_id"), "doc_id", "left_semi").mapInArrow(_meeting_rows(meetings, turn * meetings), "meet long, doc_id long")
               .join(some, "doc_id"))
        crowd = (met.groupBy("meet").agg(F.count(F.lit(1)).alias("crowd"), F.min("component").alias("c0"), F.max("component").alias("c1"))
                 .where("c0 <> c1").select("meet", "crowd"))
        # Other blocks each turn: the salt is mixed with its number.
        part = F.pmod(F.xxhash64(salt, F.lit(turn)), F.ceil(F.col("crowd") / BLOCK))
        places = met.join(crowd, "meet").select("doc_id", "component", F.xxhash64("meet", part).alias("meet"))
        spread = (sets.select("doc_id", "n", "keys").join(places, "doc_id").select("meet", "doc_id", "component", "n", "keys")
                  .repartition("meet").sortWithinPartitions("meet", "doc_id"))
        return written(spread.mapInArrow(_star_rows(percent, pivots), "a long, b long").distinct(), "stars")

    def joined(places: DataFrame, links: Callable[[], DataFrame]) -> DataFrame:
        """(doc_id, component) after the links between components."""
        def make() -> DataFrame:
            outer = components(links()).select(F.col("id").alias("component"), F.col("component").alias("outer"))
            return places.join(outer, "component", "left").select("doc_id", F.coalesce("outer", "component").alias("component"))
        return settled(spark, "places", make)

    # The rare shingles of each set that other sets hold as rare ones too.
    def rare_held() -> DataFrame:
        every = written(sets.mapInArrow(_prefix_rows(percent), "token long, doc_id long, n long"), "rare-shingles")
        held = every.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
        return every.join(held, "token").select("token", "doc_id", "n", "held")

    rare = settled(spark, "rare-held", rare_held)

    def split_under(places: DataFrame) -> tuple[DataFrame, int]:
        """(token, doc_id, n, held, component) of the rare shingles that lie in several components, and how
        many sets hold one."""
        def make() -> DataFrame:
            placed = written(rare.join(places, "doc_id"), "rare-placed")
            split = placed.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("token")
            return placed.join(split, "token", "left_semi")

        prefix = settled(spark, "rare-split", make)
        return prefix, prefix.select("doc_id").distinct().count()

    places = sets.select("doc_id", F.col("doc_id").alias("component"))
    turn, frontier = 0, places
    while True:
        links = stars(frontier, turn)
        found = links.count()
        if found:
            places = joined(places, lambda: links)
        turn += 1
        prefix, left = split_under(places)
        if not left or 4 * found < left or turn >= 8:
            break
        frontier = prefix.select("doc_id", "component").distinct()

    # Signature trees under the shingles that are left: turns that verify a forest between the components
    # while that joins any, then all pairs that remain.
    signed = written(sets.join(prefix.select("doc_id").distinct(), "doc_id", "left_semi")
                     .mapInArrow(_signature_rows, "doc_id long, bits binary, collided long"), "signatures")

    def linked(prefix: DataFrame, turn: int | None) -> DataFrame:
        """Verified links (a, b) between the components' sets."""
        blocks = F.ceil(F.col("held") / BLOCK)
        leaves = (prefix.withColumn("block", F.pmod(F.xxhash64("doc_id", "token"), blocks).cast("int"))
                  .withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
                  .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
                  .withColumn("tile", F.pmod(F.xxhash64("token", "i", "j"), F.lit(4096)))
                  .join(signed, "doc_id").select("tile", "token", "i", "j", "block", "doc_id", "component", "n", "bits", "collided"))
        pairs = (leaves.repartition("token", "i", "j").sortWithinPartitions("tile")
                 .mapInArrow(_pair_rows(percent, turn), "a long, b long").distinct())
        return written(verify(pairs, sets, percent), "links")

    def between(links: DataFrame) -> DataFrame:
        """One edge per pair of components."""
        of = lambda end: links.join(places.withColumnsRenamed({"doc_id": end, "component": f"c{end}"}), end)
        return of("a").join(of("b"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()

    for k in range(FORESTS):
        if not left:
            break
        links = linked(prefix, k)
        if links.isEmpty():
            break
        places = joined(places, lambda: between(links))
        prefix, left = split_under(places)
    if left:
        places = joined(places, lambda: between(linked(prefix, None)))
    final = members.join(places.withColumnRenamed("doc_id", "stands"), "stands").select("doc_id", F.col("component").alias("component_id"))
    return sized.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies, that with the smallest id; documents
    without words are no group, and rows without an id stay."""
    gone = (near_copies(docs, percent, shingle, id_col=id_col, text_col=text_col)
            .where("component_id <> doc_id").select("doc_id").alias("_gone"))
    return docs.alias("_own").join(gone, F.col(f"_own.`{id_col}`").cast("long") == F.col("_gone.doc_id"), "left_anti")

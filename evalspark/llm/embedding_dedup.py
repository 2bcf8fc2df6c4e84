"""Near-duplicate vectors by a forest of random-projection trees with spill.

Copies of a vector become one unit.  Each of several trees splits the units again and again by a random
direction; those within a margin of the threshold go to both sides, so a linked pair is parted by one
split only if it differs by more than two margins along it.  Units that meet in a leaf are compared in
full, in double precision; a pair that meets in several leaves counts in the first of them, which each
unit's list of leaves tells, so no pair is ever written down: a leaf returns link counts and a star for
each of its connected parts.

Trees are fitted to bounded samples: a round's sample of a node gives the thresholds of up to
``DEPTH`` levels, directions come from the node's number; nodes that are still too large go through another
round, so leaves grow in number and not in size.

Dense groups: units within half the link angle of one pivot all link with one another (angles obey the
triangle inequality).  Such balls are sought in samples until none holds a noticeable share; their inner
links are counted by arithmetic, and their members meet only units outside the ball.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import written
from evalspark.llm.components import components
from evalspark.llm.vectors import double_matrix, is_finite
from evalspark.llm.words import U, mix

SAMPLE = 16_384  # units of a node that its thresholds are fitted to
DEPTH = 9  # levels of one round
PIVOTS = 4_096  # units among which dense balls are sought, each round anew
DENSE = 8  # sampled units within reach that make a pivot a ball


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs = [np.asarray(x, "<f8") for x in batch.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array([len(x) for x in vecs], pa.int32()), pa.array([x.tobytes() for x in vecs], pa.binary())],
            names=["vec_id", "dim", "vec"])


def _unit(vecs: np.ndarray) -> np.ndarray:
    # Lengths of very small or large entries would leave the range of a double when squared.
    vecs = vecs / np.abs(vecs).max(axis=1, keepdims=True)
    return vecs / np.sqrt((vecs * vecs).sum(1, keepdims=True))


def _directions(node: int, dim: int) -> np.ndarray:
    """The random unit directions of a node's inner splits, from its number alone."""
    d = np.random.default_rng(np.random.Philox(key=[node & (2 ** 64 - 1), 11])).standard_normal((2 ** DEPTH, dim))
    return d / np.sqrt((d * d).sum(1, keepdims=True))


def _child(node: int, at: np.ndarray) -> np.ndarray:
    """Numbers of the nodes that heap places ``at`` of a node become; never that of another place."""
    return mix(mix(np.full(len(at), node, np.int64).view(U)) + at.astype(U)).view(np.int64)


def _fit(node: int, vecs: np.ndarray, share: float, leaf: int, margin: float) -> np.ndarray:
    """Thresholds by heap place; NaN ends a path, infinity passes all to the left.

    Each split takes, of the sampled quantiles, the one whose larger side, spill included, is smallest.
    It must pay: the copies it makes, squared, times the share of its larger side stay at or below 1.  If no
    quantile does, the next direction is tried, three times; a node that still does not part is left."""
    out = np.full(2 ** DEPTH, np.nan)
    if not len(vecs):
        return out
    along = vecs @ _directions(node, vecs.shape[1]).T
    work = [(1, np.arange(len(vecs)), 0)]
    while work:
        at, rows, passed = work.pop()
        if at >= 2 ** DEPTH or len(rows) * share <= leaf or len(rows) < 32:
            continue
        x = np.sort(along[rows, at])
        cuts = np.quantile(x, np.linspace(0.05, 0.95, 19))
        left, right = np.searchsorted(x, cuts + margin, "right") / len(x), 1 - np.searchsorted(x, cuts - margin, "right") / len(x)
        larger = np.maximum(left, right)
        larger[(left + right) ** 2 * larger > 1] = np.inf
        best = int(np.argmin(larger))
        if larger[best] <= 0.9:
            out[at] = cuts[best]
            x = along[rows, at]
            work.append((2 * at, rows[x <= cuts[best] + margin], 0))
            work.append((2 * at + 1, rows[x > cuts[best] - margin], 0))
        elif passed < 3:
            out[at] = np.inf
            work.append((2 * at, rows, passed + 1))
    return out


def _walk(node: int, cuts: np.ndarray, vecs: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, heap place) of every leaf that each vector reaches."""
    along = vecs @ _directions(node, vecs.shape[1]).T
    rows, at = np.arange(len(vecs)), np.ones(len(vecs), np.int64)
    done_rows, done_at = [], []
    while len(rows):
        cut = np.where(at < 2 ** DEPTH, cuts[np.minimum(at, 2 ** DEPTH - 1)], np.nan)
        ends = np.isnan(cut)
        done_rows.append(rows[ends])
        done_at.append(at[ends])
        rows, at, cut = rows[~ends], at[~ends], cut[~ends]
        x = along[rows, at]
        left, right = x <= cut + margin, x > cut - margin
        rows, at = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * at[left], 2 * at[right] + 1])
    return np.concatenate(done_rows), np.concatenate(done_at)


def _fits(dim: int, leaf: int, margin: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, size = int(pdf["node"].iloc[0]), int(pdf["size"].iloc[0])
        pdf = pdf.sort_values("vec")
        cuts = _fit(node, _unit(double_matrix(pa.array(pdf["vec"]), dim)), size / len(pdf), leaf, margin)
        return pd.DataFrame({"node": [node], "cuts": [cuts.tobytes()]})
    return run


def _walks(dim: int, margin: float):
    """uid, node -> uid, node of the next round; a node whose model has no split is ended."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column("node").to_numpy()
            uids, vecs = batch.column("uid").to_numpy(), _unit(double_matrix(batch.column("vec"), dim))
            cuts = batch.column("cuts")
            values, first, which = np.unique(nodes, return_index=True, return_inverse=True)
            for k, node in enumerate(values.tolist()):
                some = np.flatnonzero(which == k)
                model = np.frombuffer(cuts[int(first[k])].as_py(), "f8")
                rows, at = _walk(node, model, vecs[some], margin)
                ended = not np.isfinite(model).any()  # no split that parts anything
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids[some][rows]), pa.array(np.full(len(rows), node) if ended else _child(node, at)), pa.array(np.full(len(rows), ended))],
                    names=["uid", "node", "ended"])
    return run


def _first_walks(dim: int, roots: dict[int, np.ndarray], margin: float):
    """The first round of all trees in one pass: the models have a fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                uids, vecs = batch.column("uid").to_numpy(), _unit(double_matrix(batch.column("vec"), dim))
                for node, model in roots.items():
                    rows, at = _walk(node, model, vecs, margin)
                    yield pa.RecordBatch.from_arrays([pa.array(uids[rows]), pa.array(_child(node, at)), pa.array(np.full(len(rows), False))],
                                                     names=["uid", "node", "ended"])
    return run


def _balls(dim: int, pivots: np.ndarray, numbers: np.ndarray, near: float):
    """uid, vec, mult, ball: the first pivot within reach, for units in no ball yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ball = batch.column("ball").to_numpy().copy()
            if batch.num_rows:
                reach = _unit(double_matrix(batch.column("vec"), dim)) @ pivots.T >= near
                first = np.argmax(reach, axis=1)
                hit = reach.any(axis=1) & (ball < 0)
                ball[hit] = numbers[first[hit]]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec"), batch.column("mult"), pa.array(ball)],
                                             names=["uid", "vec", "mult", "ball"])
    return run


def _share(column: str, rows: int, of: int, salt: int):
    """Condition that picks about ``rows`` of ``of`` rows by a hash of a column."""
    whole = 1 << 40
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(whole)) < int(whole * min(1.0, rows / max(of, 1))) + 1


def _with_balls(units: DataFrame, dim: int, cosine: float) -> DataFrame:
    """Give units the number of the dense ball they lie in (that of its pivot; -1: none).

    Rounds go on while the balls of a round hold a twentieth of the units that were still free."""
    near = math.cos(math.acos(cosine) / 2) + 1e-9
    units = units.withColumn("ball", F.lit(-1).cast("long"))
    while True:
        free = units.where("ball < 0")
        count = free.count()
        # A hashed share of the free units; the limit only guards the bound.
        some = free.where(_share("vec", PIVOTS, count, 3)).select("uid", "vec").limit(2 * PIVOTS).collect()
        if len(some) < DENSE:
            return units
        some.sort(key=lambda r: bytes(r.vec))
        vecs = _unit(np.frombuffer(b"".join(bytes(r.vec) for r in some), "<f8").reshape(-1, dim))
        left, pivots, numbers = np.ones(len(some), bool), [], []
        degree = np.concatenate([(vecs[a:a + 1024] @ vecs.T >= near).sum(1) for a in range(0, len(vecs), 1024)])
        for i in np.argsort(-degree, kind="stable").tolist():
            if degree[i] < DENSE:
                break
            if left[i]:
                around = left & (vecs @ vecs[i] >= near)
                if around.sum() >= DENSE:
                    left &= ~around
                    pivots.append(vecs[i])
                    numbers.append(some[i].uid)
        if not pivots:
            return units
        units = written(units.mapInArrow(_balls(dim, np.array(pivots), np.array(numbers, np.int64), near),
                                         "uid long, vec binary, mult long, ball long"), "dense-balls")
        if len(some) >= count or left.mean() > 0.95:
            return units


def _sampled(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """About SAMPLE rows of each node, chosen by a hash of the unit."""
    whole = 1 << 40
    kept = F.pmod(F.xxhash64("vec", "node"), F.lit(whole)) < F.lit(whole) * F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("size"))
    return rows.join(sizes, "node").where(kept)


def _leaves(units: DataFrame, dim: int, trees: int, leaf: int, margin: float) -> DataFrame:
    """(uid, node) of every leaf of every tree that a unit reaches."""
    lone = units.where("ball < 0")  # the trees are fitted to what lies in no ball
    count = lone.count()
    tree_nodes = mix(np.arange(1, trees + 1, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64).tolist()
    roots = F.explode(F.array(*[F.lit(t) for t in tree_nodes]))
    sample = (lone.where(_share("vec", SAMPLE, count, 5))
              .select("uid", "vec", F.lit(count).cast("long").alias("size"), roots.alias("node")))
    models = {r.node: np.frombuffer(bytes(r.cuts), "f8")
              for r in sample.groupBy("node").applyInPandas(_fits(dim, leaf, margin), "node long, cuts binary").collect()}  # one row per tree
    models = {t: models.get(t, np.full(2 ** DEPTH, np.nan)) for t in tree_nodes}
    placed = written(units.select("uid", "vec").mapInArrow(_first_walks(dim, models, margin), "uid long, node long, ended boolean"), "forest")
    done = []
    while True:
        sizes = written(placed.join(lone.select("uid"), "uid", "left_semi").where("not ended").groupBy("node").agg(F.count(F.lit(1)).alias("size"))
                        .where(F.col("size") > leaf), "large-nodes")
        if sizes.isEmpty():
            break
        done.append(placed.join(sizes, "node", "left_anti").select("uid", "node"))
        large = placed.join(sizes, "node", "left_semi").select("uid", "node").join(units.select("uid", "vec"), "uid")
        fitted = (_sampled(large.join(lone.select("uid"), "uid", "left_semi"), sizes)
                  .groupBy("node").applyInPandas(_fits(dim, leaf, margin), "node long, cuts binary"))
        placed = written(large.join(fitted, "node").select("uid", "node", "vec", "cuts")
                         .mapInArrow(_walks(dim, margin), "uid long, node long, ended boolean"), "forest")
    out = placed.select("uid", "node")
    for d in done:
        out = out.unionByName(d)
    return out


def _unmet(hit: np.ndarray, leaves: list[np.ndarray], here: int) -> None:
    """Take from ``hit`` the pairs that share a leaf before ``here``."""
    rows = np.flatnonzero(hit.any(1))
    flat = np.concatenate([leaves[i] for i in rows.tolist()])
    owner = np.repeat(np.arange(len(rows)), [len(leaves[i]) for i in rows.tolist()])
    owner, flat = owner[flat < here], flat[flat < here]
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # only leaves of two units or more matter
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    pairs = hit[np.ix_(rows, rows)]
    for a in range(0, int(column.max(initial=-1)) + 1, 4096):
        some = (column >= a) & (column < a + 4096)
        met = np.zeros((len(rows), min(4096, int(column.max()) + 1 - a)), np.float32)
        met[owner[some], column[some] - a] = 1
        pairs &= met @ met.T == 0
    hit[np.ix_(rows, rows)] = pairs


def _tile(pdf: pd.DataFrame, dim: int, cosine: float) -> pd.DataFrame:
    """uid, links, rep, part of the units of one tile that link with another: ``rep`` is the unit's ball
    or itself, ``part`` the least rep that the tile's links reach."""
    uid, mult, ball, side = (pdf[c].to_numpy() for c in ("uid", "mult", "ball", "side"))
    vecs = _unit(double_matrix(pa.array(pdf["vec"]), dim))
    n = len(uid)
    hit = np.zeros((n, n), bool)
    for a in range(0, n, 1024):
        hit[a:a + 1024] = vecs[a:a + 1024] @ vecs.T >= cosine
    hit |= hit.T  # a product may differ in its last bit with the order of its factors
    hit &= (ball[:, None] != ball[None, :]) | (ball < 0)[:, None]
    if side.any():
        hit &= side[:, None] != side[None, :]
    np.fill_diagonal(hit, False)
    if hit.any():
        _unmet(hit, [np.asarray(x, np.int64) for x in pdf["leaves"]], int(pdf["node"].iloc[0]))
    rows = np.flatnonzero(hit.any(1))
    rep = np.where(ball < 0, uid, ball)
    part = rep.copy()
    for i in rows.tolist():
        joined = np.unique(np.append(part[hit[i]], part[i]))
        if len(joined) > 1:
            part[np.isin(part, joined)] = joined[0]
    return pd.DataFrame({"uid": uid[rows], "links": (hit[rows] @ mult), "rep": rep[rows], "part": part[rows]})


def _tiles(dim: int, cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _tile(pdf, dim, cosine)
    return run


def _met(units: DataFrame, reached: DataFrame, leaf: int) -> DataFrame:
    """Rows of tiles: node, i, j, side, uid, vec, mult, ball, leaves.

    A leaf of up to twice ``leaf`` members is one tile.  A larger one (a dense ball passes through, or
    no split parts it) is dealt into blocks of one ball each, and tiles are pairs of blocks, but for
    pairs of one ball.  Tiles are planned on ids; vectors are joined to the plan at the end."""
    members = written(reached.join(units.select("uid", "ball"), "uid"), "forest-members")
    full = units.join(members.groupBy("uid").agg(F.sort_array(F.collect_set("node")).alias("leaves")), "uid")
    counts = written(members.groupBy("node", "ball").agg(F.count(F.lit(1)).alias("c")), "leaf-sizes")
    total = counts.groupBy("node").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("balls"), F.max("ball").alias("b"))
    # Leaves of one unit, or of one ball alone, hold nothing to compare.
    total = total.where((F.col("t") > 1) & ~((F.col("balls") == 1) & (F.col("b") >= 0)))
    zero = [F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side")]
    whole = members.join(total.where(F.col("t") <= 2 * leaf).select("node"), "node", "left_semi").select("uid", "node", *zero)
    blocks = (counts.join(total.where(F.col("t") > 2 * leaf).select("node"), "node", "left_semi")
              .withColumn("blocks", F.ceil(F.col("c") / leaf).cast("int")))
    numbered = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "ball", "part")
    block = F.struct("ball", "part")
    pairs = (numbered.withColumn("x", block).alias("p").join(numbered.select("node", block.alias("y")).alias("r"), "node")
             .where((F.col("x.ball") != F.col("y.ball")) | (F.col("x.ball") < 0))
             .select("node", "ball", "part", F.xxhash64(F.least("x", "y")).alias("i"), F.xxhash64(F.greatest("x", "y")).alias("j"),
                     F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2).alias("side")))
    dealt = (members.join(blocks.select("node", "ball", "blocks"), ["node", "ball"])
             .withColumn("part", F.pmod(F.xxhash64("uid", F.lit(9)), F.col("blocks")).cast("int")))
    plan = whole.unionByName(dealt.join(pairs, ["node", "ball", "part"]).select("uid", "node", "i", "j", "side"))
    return plan.join(full, "uid")


def _one_dimension(rows: DataFrame, dim: int, cosine: float, trees: int, leaf: int) -> DataFrame:
    """key, n_links, component_id of the distinct vectors of one length."""
    # Written once, so the numbers that units get hold from then on.
    units = written(rows.groupBy("key").agg(F.min("vec_id").alias("least"), F.any_value("vec").alias("vec"), F.count(F.lit(1)).alias("mult"))
                    .withColumn("uid", F.monotonically_increasing_id()), "units")
    plain = _with_balls(units.select("uid", "vec", "mult"), dim, cosine)
    # Half a standard deviation of the difference that a pair just at the threshold has along a random direction.
    margin = 0.5 * math.sqrt(max(2 - 2 * cosine, 0.0) / dim)
    met = _met(plain, _leaves(plain, dim, trees, leaf, margin), leaf)
    found = written(met.groupBy("node", "i", "j").applyInPandas(_tiles(dim, cosine), "uid long, links long, rep long, part long"), "tiles")
    inside = plain.where("ball >= 0").groupBy("ball").agg(F.sum("mult").alias("inside"))
    parts = components(found.select("rep", "part").where("rep <> part").distinct(), "rep", "part").withColumnRenamed("id", "rep")
    told = (units.select("key", "uid", "mult", "least").join(plain.select("uid", "ball"), "uid").join(inside, "ball", "left")
            .join(found.groupBy("uid").agg(F.sum("links").alias("links")), "uid", "left")
            .withColumn("rep", F.when(F.col("ball") < 0, F.col("uid")).otherwise(F.col("ball")))
            .join(parts, "rep", "left")
            .select("key", "least", (F.coalesce("inside", "mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                    F.coalesce("component", "rep").alias("component")))
    told = written(told, "vector-links")
    return (told.join(told.groupBy("component").agg(F.min("least").alias("component_id")), "component")
            .select("key", "n_links", "component_id"))


def near_vectors(table: DataFrame, cosine: float = 0.95, trees: int = 6, leaf: int = 1024, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: how many other rows link with it (cosine at or
    above ``cosine``), the smallest id that links reach, and whether that is its own.

    Vectors that are null, empty or zero, or hold null or non-finite entries, link with nothing; vectors
    of different lengths do not link.  Repeated rows are vectors of their own and link as copies do; they
    share a component and, with one id, are all kept.  Rows without an id link with nothing, have no
    component and are kept.  An empty table gives no rows; other columns are ignored.
    """
    spark = table.sparkSession
    sound = is_finite(vec_col) & F.col(id_col).isNotNull()
    wide = F.col(vec_col).cast("array<double>")
    base = table.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound & F.exists(wide, lambda c: c != 0), wide).alias("v"))
    packed = base.where("v IS NOT NULL").mapInArrow(_packed, "vec_id long, dim int, vec binary")
    rows = written(packed.withColumn("key", F.md5("vec")), "vectors")
    ends = base.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for r in rows.select("dim").distinct().orderBy("dim").collect():  # one row per length of vectors
        mine = rows.where(F.col("dim") == r.dim)
        ends = ends.unionByName(mine.select("vec_id", "key").join(_one_dimension(mine, r.dim, cosine, trees, leaf), "key")
                                .select("vec_id", "n_links", "component_id"))
    return ends.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""Toxicity scores of texts after noisy-channel deobfuscation.

Odd tokens (leetspeak, letters spaced or parted out, letters repeated) become lattices of the letters
they may stand for.  A Viterbi search under a character trigram model, counted over the words of all
documents, restores the likeliest word, or words where spaced letters hold several.  Words get weights from a bounded sample of labelled texts
(lower confidence bounds of log odds of the word and its prefixes); a logistic curve over the three
strongest distinct words of a text gives the score.  Language, source and id never enter a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import text_rows

# What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
         "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou"}
EDGES = ".,;:?\"'()[]{}<>…«»“”‘’„-–—_/\\&%#~=^`"
_WORD = re.compile(r"[^\W\d_]+")
_TAIL = re.compile(r"([^\w\s])\1\1+$")
_HEAD = re.compile(r"^([^\w\s])\1\1+")
_PARTED = re.compile(r"^\w(?:[^\w\s]+\w){2,}$")
_DOUBLE = re.compile(r"(.)\1")
SLACK = 6.0  # cuts of spaced letters that cost so much more than the cheapest still give words
LONGEST = 64  # longer words are not counted by the character model


class _Counts:
    """Counts of trigrams as two sorted arrays: 16 bytes a trigram, however many there are."""

    def __init__(self, grams: dict[str, int]):
        packed = np.fromiter(map(_code, grams), np.int64, len(grams))
        order = np.argsort(packed)
        self.packed, self.n = packed[order], np.fromiter(grams.values(), np.int64, len(grams))[order]

    def get(self, gram: str, default: int = 0) -> int:
        code = _code(gram)
        at = int(np.searchsorted(self.packed, code))
        return int(self.n[at]) if at < len(self.packed) and self.packed[at] == code else default


def _code(gram: str) -> int:
    """A trigram as one number, 21 bits a character."""
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


class CharModel:
    """Interpolated character trigrams of words; ``^`` opens and ``$`` closes a word."""

    def __init__(self, grams: dict[str, int]):
        self.tri = _Counts(grams)
        self.bi: Counter[str] = Counter()
        self.uni: Counter[str] = Counter()
        self.pairs: Counter[str] = Counter()
        for g, n in grams.items():
            self.bi[g[:2]] += n
            self.pairs[g[1:]] += n
            self.uni[g[1]] += n
        self.total = sum(self.uni.values()) + 1
        self.cache: dict[str, float] = {}

    def cost(self, gram: str) -> float:
        """-log P(third character | the two before)."""
        c = self.cache.get(gram)
        if c is None:
            low = (self.uni.get(gram[2], 0) + 0.1) / self.total
            mid = (self.pairs.get(gram[1:], 0) + 10 * low) / (self.uni.get(gram[1], 0) + 10)
            c = -math.log((self.tri.get(gram, 0) + 10 * mid) / (self.bi.get(gram[:2], 0) + 10))
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[gram] = c
        return c


_BROKEN = ((1, 1), (1, 2), (2, 1), (2, 2))  # letters of one run before and after the end of a word


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of one character: what it may stand for, with the channel's cost.

    A sign between letters may also be there only to part them.  In a ``spaced`` token a word may end
    inside a run of one letter (breaks between runs are the search's).
    """
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, n = token[i], j - i
        letters = SIGNS.get(c, "")
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.5 * (n - 1)))
            if n > 1:
                options.append((c * 2, 0.0 if n == 2 else 0.5 * n))
            if spaced:
                options += [(f"{c * a} {c * b}", 0.5 * (n - a - b)) for a, b in _BROKEN if a + b <= n]
        for letter in letters:
            options.append((letter * min(n, 2), 1.0 + math.log(len(letters))))
            if spaced:
                options += [(f"{letter * a} {letter * b}", 1.0 + math.log(len(letters))) for a, b in _BROKEN if a + b <= n]
        if not c.isalnum():
            options.append(("", 1.5))
        out.append(options or [("", 2.0)])
        i = j
    return out


def restore(token: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest word behind an odd token: Viterbi over the lattice; states are two characters.

    ``spaced``: the token's characters stood apart, so it may be several words; they come parted by
    blanks.  A path is a chain of its pieces, so the work is linear in the token's length.
    """
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for options in lattice(token, spaced):
        fresh: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, path) in states.items():
            for letters, extra in options:
                total, now = cost + extra, state
                for c in letters:
                    if c == " ":
                        total, now = total + model.cost(now + "$"), "^^"
                    else:
                        total += model.cost(now + c)
                        now = now[1] + c
                if now not in fresh or total < fresh[now][0]:
                    fresh[now] = (total, (letters, path))
        if spaced:
            for state, (cost, path) in list(fresh.items()):
                total = cost + model.cost(state + "$")
                if state != "^^" and ("^^" not in fresh or total < fresh["^^"][0]):
                    fresh["^^"] = (total, (" ", path))
        states = fresh
    path = min(((cost + model.cost(state + "$"), path) for state, (cost, path) in states.items()), key=lambda x: x[0])[1]
    pieces: list[str] = []
    while path:
        pieces.append(path[0])
        path = path[1]
    return "".join(reversed(pieces))


def parts(letters: str, model: CharModel, slack: float) -> set[str]:
    """Words of up to LONGEST letters on all ways to cut ``letters`` that cost at most ``slack`` over the cheapest.

    With the letters fixed, a path at a place has ended a word there, is one letter into one, or more;
    ``start`` and ``rest`` are the cheapest costs before and after a cut, ``after`` those from inside a word.
    """
    n, cost = len(letters), model.cost
    first, second, third, last = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for i, c in enumerate(letters):
        first[i] = cost("^^" + c)
        second[i] = cost("^" + letters[i - 1:i + 1]) if i else math.inf
        third[i] = cost(letters[i - 2:i + 1]) if i > 1 else math.inf
        last[i] = cost(letters[i - 1:i + 1] + "$") if i else math.inf
    single = [cost("^" + c + "$") for c in letters]
    start, inside = [0.0] * (n + 1), [math.inf] * (n + 1)  # inside: two letters or more into a word
    for j in range(1, n + 1):
        k = j - 1
        inside[j] = min(inside[k] + third[k], start[j - 2] + first[j - 2] + second[k]) if j > 1 else math.inf
        start[j] = min(inside[j] + last[k], start[k] + first[k] + single[k])
    rest, after = [0.0] * (n + 1), [math.inf] * (n + 1)
    for j in range(n, -1, -1):
        if j < n:
            rest[j] = first[j] + single[j] + rest[j + 1]
            if j + 1 < n:
                rest[j] = min(rest[j], first[j] + second[j + 1] + after[j + 2])
        if j > 1:
            after[j] = min(last[j - 1] + rest[j], third[j] + after[j + 1] if j < n else math.inf)
    most = start[n] + slack
    out: set[str] = set()
    for i in range(n):
        if start[i] + rest[i] > most:
            continue
        if start[i] + first[i] + single[i] + rest[i + 1] <= most:
            out.add(letters[i])
        if i + 1 == n:
            break
        so_far, j = start[i] + first[i] + second[i + 1], i + 2
        while so_far + after[j] <= most and j - i <= LONGEST:
            if so_far + last[j - 1] + rest[j] <= most:
                out.add(letters[i:j])
            if j == n:
                break
            so_far, j = so_far + third[j], j + 1
    return out


def _spaced(token: str, model: CharModel) -> set[str]:
    """Words of letters that stood apart: as the lattice restores them and, if all are letters, as they stand."""
    found = restore(token, model, spaced=True)
    out = set(found.split())
    for letters in {found.replace(" ", ""), token if token.isalpha() else ""}:
        out |= parts(letters, model, SLACK)
    return out


def words_of(text: str, model: CharModel, cache: dict[str, tuple[str, ...]], cache_entries: int = 200_000) -> set[str]:
    """Distinct words of a text: those that stand there, and those restored from odd tokens."""
    tokens = text.lower().split()
    out: set[str] = set()
    for token in set(tokens):
        if token.isalpha() and not _DOUBLE.search(token):
            out.add(token)
            continue
        found = cache.get(token)
        if found is None:
            found = tuple(_read(token, model))
            if len(cache) > cache_entries:
                cache.clear()
            cache[token] = found
        out.update(found)
    run: list[str] = []
    for token in [*tokens, ""]:
        if len(token) == 1:
            run.append(token)
        else:
            if len(run) >= 2:
                spaced = "".join(run)
                if any(c.isalpha() for c in spaced):
                    out |= _spaced(spaced, model)
                for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):  # a one-letter word may stand beside a spaced one
                    out.update(_read(spaced[i:len(run) - j], model))
            run.clear()
    return out


def _read(token: str, model: CharModel) -> list[str]:
    plain = _WORD.findall(token)
    core = _HEAD.sub("", _TAIL.sub("", token)).strip(EDGES)
    if not any(c.isalpha() for c in core):
        return plain
    if core.isalpha() and not _DOUBLE.search(core):
        return [*plain, core]
    if _PARTED.match(core):
        core = "".join(c for c in core if c.isalnum() or c in SIGNS)
        return [*plain, restore(core, model), *_spaced(core, model)]
    return [*plain, restore(core, model)]


def features_of(word: str) -> tuple[str, ...]:
    return ("w" + word, "p" + word[:4], "q" + word[:5]) if len(word) > 4 else ("w" + word,)


def char_model(docs: DataFrame) -> CharModel:
    """Character trigrams of the words of all documents, every one of them: their number follows the
    alphabets in use, not the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                words.update(w for w in text.lower().split() if w.isalpha())
            grams: Counter[str] = Counter()
            for word, n in words.items():
                if len(word) <= LONGEST:
                    spelled = "^^" + word + "$"
                    for i in range(len(spelled) - 2):
                        grams[spelled[i:i + 3]] += n
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

    counted = docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    return CharModel(dict(zip(table["gram"].to_pylist(), table["n"].to_pylist())))


class Scorer:
    """Word weights and the logistic curve over the three strongest words of a text."""

    def __init__(self, model: CharModel, weights: dict[str, float], curve: list[float]):
        self.model, self.weights, self.curve = model, weights, curve

    def strongest(self, text: str, cache: dict) -> list[float]:
        get = self.weights.get
        best = [0.0, 0.0, 0.0]
        for word in words_of(text, self.model, cache):
            w = max(get(f, 0.0) for f in features_of(word))
            if w > best[2]:
                best = sorted([*best[:2], w], reverse=True)
        return best

    def score(self, text: str, cache: dict) -> float:
        z = self.curve[0] + sum(c * w * w for c, w in zip(self.curve[1:], self.strongest(text, cache)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression on the sum of the squares of the three weights (squares set one strong
    word above several doubtful ones), by Newton steps; the slope is never negative.  Returned as one
    coefficient for each of the three."""
    design = np.column_stack([np.ones(len(x)), (x * x).sum(1)])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + 0.1 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(0.0, float(beta[1]))
    return [float(beta[0]), slope, slope, slope]


FOLDS = 8  # the curve sees each labelled text under weights learnt from the other seven folds


def _least(pos: int) -> int:
    """Toxic texts that must hold a feature: half the root of their number, 2 to 5, so that few labels
    still speak and many are not heard for every chance."""
    return min(5, max(2, round(math.sqrt(pos) / 2)))


def _weights(table: dict[str, tuple[int, int]], pos: int, neg: int) -> dict[str, float]:
    """Lower confidence bounds of the features' log odds, where they speak clearly for toxic texts."""
    out = {}
    least = _least(pos)
    for f, (p, n) in table.items():
        odds = math.log((p + 0.5) / (pos + 1)) - math.log((n + 0.5) / (neg + 1))
        bound = odds - math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        if p >= least and bound > 2:
            out[f] = bound
    return out


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Scorer:
    """A scorer from the labelled documents outside fold 2.

    ``fit_rows`` bounds the labelled rows used (those with the smallest hash of their id), and with them
    the words that may get a weight.  The curve is fitted on each of ``FOLDS`` parts with the weights of
    the others; the weights kept are of all.  The character model is counted over all documents.
    """
    spark: SparkSession = docs.sparkSession
    model = char_model(docs)
    known = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(fold_of(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sample = known.withColumn("h", F.xxhash64("doc_id", F.lit(5))).orderBy("h", "doc_id").limit(fit_rows)
    # At most fit_rows small rows.
    texts = docs.join(F.broadcast(sample), "doc_id").select("text", "toxic", F.pmod("h", F.lit(FOLDS)).cast("int").alias("part"))
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic, part in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "part"))):
                # "all" counts the texts themselves
                for f in {f for w in words_of(text, shared.value, cache) for f in features_of(w)} | {"all"}:
                    seen.setdefault(f, [0] * (2 * FOLDS))[2 * part + toxic] += 1
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())] + [
                    pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(2 * FOLDS)], names=["f", *cells])

    cells = [f"{side}{k}" for k in range(FOLDS) for side in ("n", "p")]
    sums = (texts.mapInArrow(count, "f string, " + ", ".join(f"{c} long" for c in cells)).groupBy("f")
            .agg(*[F.sum(c).alias(c) for c in cells]).checkpoint())
    whole = sums.where("f = 'all'").collect()
    total = [int(whole[0][c]) for c in cells] if whole else [0] * len(cells)
    pos, neg = sum(total[1::2]), sum(total[::2])
    p, n = (sum((F.col(c) for c in cells if c[0] == side), F.lit(0)) for side in ("p", "n"))
    # Features that may get a weight in some fold: well over even odds among all labelled texts.
    speaks = (p >= 2) & (F.log((p + 0.5) / (pos + 1)) - F.log((n + 0.5) / (neg + 1)) - F.sqrt(1 / (p + 0.5) + 1 / (n + 0.5)) > 1)
    table = {r.f: [int(r[c]) for c in cells] for r in sums.where("f <> 'all'").where(speaks).collect()}
    weights = _weights({f: (sum(v[1::2]), sum(v[::2])) for f, v in table.items()}, pos, neg)
    # The rows of a fold are measured by the weights of the others.
    others = [_weights({f: (sum(v[1::2]) - v[2 * k + 1], sum(v[::2]) - v[2 * k]) for f, v in table.items()},
                       pos - total[2 * k + 1], neg - total[2 * k]) for k in range(FOLDS)]
    held = spark.sparkContext.broadcast((model, others))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        scorers = [Scorer(held.value[0], w, [0.0] * 4) for w in held.value[1]]
        for batch in batches:
            best = [scorers[h].strongest(t, cache) for t, h in zip(batch.column("text").to_pylist(), batch.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    rows = texts.mapInArrow(measure, "x array<double>, toxic int").collect()  # at most fit_rows
    shared.destroy()
    held.destroy()
    if not rows:
        return Scorer(model, weights, [-2.0, 0.5, 0.5, 0.5])
    return Scorer(model, weights, _fit_curve(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)))


def score_texts(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            scores = [shared.value.score(t, cache) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.3, fit_rows: int = 20_000, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    ``held_out``: crc32 of the id in decimal leaves 2 mod 4; labels of such rows are never used.  Null
    and empty texts get the score of a text without words; a row without an id is scored, with held_out
    false; repeated rows give repeated rows; without labels a fixed curve over no weights remains;
    empty tables give an empty result; other columns are ignored.
    """
    scorer = train(text_rows(docs, id_col, text_col), labels, fit_rows)
    scored = score_texts(docs, scorer, id_col, text_col)
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, cut: float = 0.3, fit_rows: int = 20_000, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores ``cut`` or more; all columns, clean rows unchanged."""
    scorer = train(text_rows(docs, id_col, text_col), labels, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            fine = [shared.value.score(t or "", cache) < cut for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

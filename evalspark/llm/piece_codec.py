"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they would form
(then by position) and merges the best pair until none is left; symbols that are no piece become
byte pieces.  Merges never cross from other characters to a space mark, nor touch a character that no
piece of two or more characters holds, so a text is encoded segment by segment with a bounded cache
per worker.  The agendas of all new short segments of a block advance together in arrays; a long
segment's agenda is a heap over linked symbols.  Every segment that is encoded anew is checked against
the sentencepiece library in the same Arrow batch; a text with a segment on which they differ takes the
library's ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.llm.common import text_rows

MARK = "▁"
# Segments from this many characters on go through the heap: array rounds read all symbols for each merge.
LONG = 256
# The cache is emptied before the next block when its segments and ids have more characters.
CACHE_CHARACTERS = 50_000_000


class PieceCodec:
    """Agenda encoder and decoder for one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(size) if lib.is_byte(i)}
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i)}
        self.ids = {self.pieces[i]: i for i in range(size) if i not in special}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.special = special - set(self.bytes_of)
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        # Segments are independent if a space mark stands only at a piece's start, and text is used as it is.
        self.by_segment = (not any(MARK in p.lstrip(MARK) for p in self.ids) and not any("\n" in p for p in self.ids)
                           and len(self.byte_ids) == 256 and lib.normalize(" a  ﬁ\n①") == "▁▁a▁▁ﬁ\n①")
        self.cache: dict[str, tuple[str, int]] = {}
        self.held = 0  # characters in the cache
        self._pairs: dict[int, tuple[int, int]] | None = None
        self.names = [str(i) for i in range(size)]
        self._pair_table()
        self.wrong: set[str] = set()

    _SEGMENT = re.compile(r"\n|▁*[^▁\n]+|▁+")

    def _pair_table(self) -> None:
        """Open-addressing table: (left symbol, right symbol) -> rank of the merged piece's score, its id.

        A symbol is a piece id, or ``size + code point`` for a character that is no piece."""
        size = len(self.pieces)
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + size
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        symbol = lambda x: self.ids.get(x, int(self.symbol_of[ord(x)]) if len(x) == 1 else None)
        keys, ranks, merged = [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 21 | b)
                    ranks.append(order[self.score[p]])
                    merged.append(i)
        self.mask = (1 << max(4, (3 * len(keys)).bit_length())) - 1
        self.key = np.full(self.mask + 1, -1, np.int64)
        self.rank, self.merged = np.zeros(self.mask + 1, np.int64), np.zeros(self.mask + 1, np.int64)
        todo = np.arange(len(keys))
        keys, ranks, merged = np.array(keys, np.int64), np.array(ranks, np.int64), np.array(merged, np.int64)
        slot = self._slot(keys)
        while len(todo):
            free = self.key[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.key[at], self.rank[at], self.merged[at] = keys[todo[took]], ranks[todo[took]], merged[todo[took]]
            left = np.ones(len(todo), bool)
            left[took] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x1E3779B97F4A7C15)) >> np.int64(24)) & self.mask

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 where absent."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.flatnonzero(keys >= 0)
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.key[slot]
            hit = there == keys[todo]
            out[todo[hit]] = slot[hit]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def pairs(self) -> dict[int, tuple[int, int]]:
        """The pair table as a dictionary, made when a long segment first needs it."""
        if self._pairs is None:
            used = np.flatnonzero(self.key >= 0)
            self._pairs = dict(zip(self.key[used].tolist(), zip(self.rank[used].tolist(), self.merged[used].tolist())))
        return self._pairs

    def _merge_long(self, segment: str) -> list[int]:
        """Symbols of one marked segment once its agenda is empty, in n log n steps.

        The agenda is a heap of (rank, place of the left symbol); symbols are linked, and an entry whose
        symbols have changed since is skipped."""
        sym = self.symbol_of[np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), "<u4")]
        n = len(sym)
        slot = self._lookup(sym[:-1] << 21 | sym[1:])
        at = np.flatnonzero(slot >= 0)
        agenda = list(zip(self.rank[slot[at]].tolist(), at.tolist(), sym[at].tolist(), sym[at + 1].tolist(), self.merged[slot[at]].tolist()))
        heapq.heapify(agenda)
        pairs = self.pairs()
        here, behind, before = sym.tolist(), [*range(1, n), -1], list(range(-1, n - 1))
        while agenda:
            _, i, a, b, made = heapq.heappop(agenda)
            j = behind[i]
            if j < 0 or here[i] != a or here[j] != b:
                continue
            here[i], here[j] = made, -1
            k = behind[i] = behind[j]
            if k >= 0:
                before[k] = i
                if (found := pairs.get(made << 21 | here[k])) is not None:
                    heapq.heappush(agenda, (found[0], i, made, here[k], found[1]))
            h = before[i]
            if h >= 0 and (found := pairs.get(here[h] << 21 | made)) is not None:
                heapq.heappush(agenda, (found[0], h, here[h], made, found[1]))
        return [s for s in here if s >= 0]

    def agenda(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of marked segments, one after the other, and the number of ids of each.

        All segments advance together: each round takes, in every segment, the head of its agenda
        (the adjacent pair with the best score, the leftmost of equals) and merges it; segments
        with an empty agenda leave.  Segments of ``LONG`` characters and more go through a heap each.
        """
        never = np.int64(1) << 62
        text = np.frombuffer("".join([s for s in segments if len(s) < LONG]).encode("utf-32-le", "surrogatepass"), "<u4")
        seg = np.repeat(np.arange(len(segments)), [len(s) if len(s) < LONG else 0 for s in segments])
        sym = self.symbol_of[text]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for k, s in enumerate(segments):
            if len(s) >= LONG:
                merged = np.array(self._merge_long(s), np.int64)
                done.append((np.full(len(merged), k), merged))
        while len(sym):
            n = len(sym)
            keys = np.full(n, -1, np.int64)
            together = seg[:-1] == seg[1:]
            keys[:-1] = np.where(together, sym[:-1] << 21 | sym[1:], -1)
            slot = self._lookup(keys)
            agenda = np.where(slot >= 0, self.rank[slot] << 32 | np.arange(n), never)
            starts = np.flatnonzero(np.concatenate([[True], ~together]))
            best = np.minimum.reduceat(agenda, starts)
            going = best < never
            at = best[going] & 0xFFFFFFFF
            sym[at] = self.merged[slot[at]]
            keep = np.repeat(going, np.diff(np.append(starts, n)))
            done.append((seg[~keep], sym[~keep]))
            keep[at + 1] = False
            seg, sym = seg[keep], sym[keep]
        seg = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        sym = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(seg, kind="stable")
        seg, sym = seg[order], sym[order]
        size = len(self.pieces)
        if (odd := np.flatnonzero(sym >= size)).size:  # characters that are no piece become bytes
            spelled = [[self.byte_ids[b] for b in chr(c - size).encode("utf8", "surrogatepass")] for c in sym[odd].tolist()]
            width = np.ones(len(sym), np.int64)
            width[odd] = [len(x) for x in spelled]
            first = np.cumsum(width) - width
            seg, sym = np.repeat(seg, width), np.repeat(sym, width)
            for at, x in zip(first[odd].tolist(), spelled):
                sym[at:at + len(x)] = x
        return sym, np.bincount(seg, minlength=len(segments))

    def segments(self, text: str) -> list[str]:
        return self._SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, segments: list[str]) -> None:
        """Encode new segments by the agenda and check them against the library."""
        # The library puts a mark before its input, so it is asked about the segment behind a line break.
        head = self.library.encode("\n")
        asked = self.library.encode(["\n" + s.replace(MARK, " ") for s in segments], num_threads=1)
        ids, counts = self.agenda(segments)
        ids, names, a = ids.tolist(), self.names, 0
        for s, theirs, n in zip(segments, asked, counts.tolist()):
            ours = ids[a:a + n]
            a += n
            if theirs[len(head):] != ours:
                self.wrong.add(s)
            self.cache[s] = (" ".join([names[i] for i in ours]), n)
            self.held += len(s) + len(self.cache[s][0])

    def encode_texts(self, texts: list[str], cache_entries: int = 300_000) -> Iterator[tuple[str, int]]:
        """Of each text: the ids in decimal, joined by one space, and their number; without an end id."""
        block: list[list[str]] = []
        weight = 0
        for k, text in enumerate(texts):
            block.append(self.segments(text) if self.by_segment else [text])
            weight += len(text)
            if weight > 4_000_000 or k == len(texts) - 1:
                yield from self._block(block, cache_entries)
                block, weight = [], 0

    def _block(self, block: list[list[str]], cache_entries: int) -> Iterator[tuple[str, int]]:
        if not self.by_segment:
            for (text,) in block:
                ids = self.library.encode(text)
                yield " ".join(map(str, ids)), len(ids)
            return
        cache = self.cache
        missing = {s for segments in block for s in segments if s not in cache}
        if len(cache) + len(missing) > cache_entries or self.held > CACHE_CHARACTERS:
            cache.clear()
            self.held = 0
            missing = {s for segments in block for s in segments}
        if missing:
            self.learn(list(missing))
        for segments in block:
            if self.wrong and not self.wrong.isdisjoint(segments):
                ids = self.library.encode("".join(segments)[1:].replace(MARK, " "))
                yield " ".join(map(str, ids)), len(ids)
            else:
                found = [cache[s] for s in segments]
                yield " ".join([f[0] for f in found]), sum([f[1] for f in found])

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: byte runs as UTF-8 (bad bytes replaced), marks as spaces, the mark that
        encoding put first taken away; control pieces are
        silent and the unknown piece gives the library's sign for it."""
        parts: list[str] = []
        run = bytearray()
        for i in [*ids, None]:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run.clear()
            if i == self.unknown:
                parts.append(" ⁇ ")
            elif i is not None and i not in self.special:
                piece = self.pieces[i]
                if not parts and piece.startswith(MARK):
                    piece = piece[1:]
                    if not piece:
                        parts.append("")
                        continue
                parts.append(piece.replace(MARK, " "))
        return "".join(parts)


def _utf8(raw: bytes) -> str:
    """Each byte that starts no valid character gives one replacement character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + n].decode("utf8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf8")).hexdigest()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           cache_entries: int = 300_000) -> DataFrame:
    """doc_id, ids (array<int>, with the end id).  Null text: only the end id; a null id stays null;
    repeated rows give repeated rows; an empty table an empty result; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = [[*map(int, ids.split()), c.end] for ids, _ in c.encode_texts(texts, cache_entries)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of the ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = [c.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    named = rows.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids")
    return named.mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                   cache_entries: int = 300_000) -> DataFrame:
    """doc_id, n_tokens (with the end id), ids_sha256, decoded_sha256 of every whole text.

    Encodes and decodes in one pass over the Arrow batch, so the ids need no second stage.  Null and
    empty texts have the end id only; a null id stays null; repeated rows give repeated rows; an empty
    table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        spoken = _Spoken(c)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for ids, n in c.encode_texts(batch.column("text").to_pylist(), cache_entries):
                counts.append(n + 1)
                ids_sha.append(_sha(f"{ids} {c.end}" if ids else str(c.end)))
                text_sha.append(_sha(spoken.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


class _Spoken:
    """Decodes ids given in decimal: plain pieces by one table look-up each, byte pieces by ``decode``."""

    def __init__(self, c: PieceCodec):
        self.codec = c
        self.table = {str(i): p.replace(MARK, " ") for i, p in enumerate(c.pieces) if i not in c.special and i not in c.bytes_of}
        # A lone byte below 128 is its character; others may be parts of one.
        self.table |= {str(i): chr(b) for b, i in c.byte_ids.items() if b < 128}

    def decode(self, ids: str) -> str:
        words = ids.split()
        try:
            text = "".join(map(self.table.__getitem__, words))
        except KeyError:
            return self.codec.decode([*map(int, words)])
        return text[1:] if text[:1] == " " and self.codec.pieces[int(words[0])].startswith(MARK) else text

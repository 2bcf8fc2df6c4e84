"""Byte-level BPE ids of whole texts through a per-worker cache of space-delimited pieces.

A text is cut at every single space that stands between two non-space characters.  The byte-level
pattern always starts a new pre-token there (the space opens the next one), so the ids of a text are
the ids of its pieces in a row.  Pieces repeat a lot, so each worker keeps a bounded dictionary of
pieces it has encoded; only misses reach the tokenizer.

Misses go through ``tiktoken`` with the ranks taken from the tokenizer file itself, if the file's
merge list is in the order of the merged ids (then merging by rank and by merge list are the same);
pieces with unusual characters, texts with a special-token string and vocabularies of another order
go through ``tokenizers``.
"""

from __future__ import annotations

import json
import re

import numpy as np

# A run of white space that holds a space next to other white space: cut such texts more carefully.
_ODD_SPACES = re.compile(r"  |[^\S ] [^\S ]")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
# Up to here, Unicode classes are the same in every library's regex tables.
_PLAIN_BELOW = "ɐ"


def pieces_of(text: str) -> list[str]:
    """Pieces whose ids, put in a row, are the ids of the text."""
    if not text:
        return []
    if _ODD_SPACES.search(text):
        first, *rest = _LONE_SPACE.split(text)
    else:
        first, *rest = text.split(" ")
    out = [" " + x for x in rest]
    if first:
        out.insert(0, first)
    return out


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class PieceCoder:
    """Encodes pieces; one per worker and tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        self.fast = self._by_rank(spec)

    def _by_rank(self, spec):
        """A rank-based encoder, if the merges are exactly the vocabulary in id order."""
        model = spec["model"]
        vocab = {k: v for k, v in model["vocab"].items() if k not in set(self.special)}
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [vocab.get(a + b) for a, b in merged]
        alphabet = _byte_alphabet()
        plain = (ids and None not in ids and ids == sorted(set(ids)) and len(ids) + 256 == len(vocab)
                 and ids[0] >= 256 and spec.get("normalizer") is None and model.get("dropout") is None
                 and not model.get("ignore_merges"))
        if not plain:
            return None
        try:
            import public_tokenizers
            import tiktoken
        except ImportError:
            return None
        ranks = {bytes(alphabet[c] for c in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={}).encode_ordinary

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, pieces: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        rare = [p for p in pieces if max(p) >= _PLAIN_BELOW]
        known = dict(zip(rare, (e.ids for e in self.tokenizer.encode_batch(rare, add_special_tokens=False)))) if rare else {}
        fast = self.fast
        return [known[p] if p in known else fast(p) for p in pieces]


_CODERS: dict[str, PieceCoder] = {}
_IDS: dict[str, dict[str, bytes]] = {}


def coder(path: str) -> PieceCoder:
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def id_bytes(path: str, texts, cache_entries: int = 400_000):
    """For each text: its ids as little-endian unsigned 32-bit integers, in one bytes object."""
    c, cache = coder(path), _IDS.setdefault(path, {})
    for text in texts:
        if any(s in text for s in c.special):
            yield np.asarray(c.whole(text), dtype="<u4").tobytes()
            continue
        pieces = pieces_of(text)
        if not pieces:
            yield b""
            continue
        missing = [p for p in dict.fromkeys(pieces) if p not in cache]
        if missing:
            if len(cache) + len(missing) > cache_entries:
                cache.clear()
                missing = list(dict.fromkeys(pieces))
            cache.update(zip(missing, (np.asarray(x, dtype="<u4").tobytes() for x in c.encode(missing))))
        yield b"".join(map(cache.__getitem__, pieces))

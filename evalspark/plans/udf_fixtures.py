"""Example user functions for the UD queries (kept import-light: Python workers import this module)."""

from __future__ import annotations

import pandas as pd


def first_word_match(p: str, r: str) -> float:
    if not p:
        raise ValueError("empty prediction")
    if not r.split():
        return 0.0
    return 1.0 if p.split()[0].lower() == r.split()[0].lower() else 0.0


class EchoModel:
    """A stand-in model: answers with the first five words of the prompt (fails on empty prompts)."""

    def __call__(self, prompt: str) -> str:
        words = prompt.split()
        if not words:
            raise ValueError("empty prompt")
        return " ".join(words[:5])


def word_count(s: pd.Series) -> pd.Series:
    return s.map(lambda x: len(x.split()) if isinstance(x, str) else 0).astype("int64")

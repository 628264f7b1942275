"""Structure statistics of texts, for the classifiers."""

from __future__ import annotations

import re

import numpy as np

SYMBOLS = bytes(b"#*$%&|<>")
NAMES = (
    "log_words", "log_bytes", "mean_word", "symbols", "digits", "uppercase", "punctuation", "non_ascii", "distinct_words", "same_as_last",
    "odd_words", "repeated_lines", "words_a_line", "stops", "exclamations", "urls",
)
LINE = re.compile(rb"[^\n]+")
_KIND = np.zeros((6, 256), np.float32)
_KIND[0, list(SYMBOLS)] = 1
_KIND[1, list(b"0123456789")] = 1
_KIND[2, list(range(65, 91))] = 1
_KIND[3, list(b".,;:'\"()-")] = 1
_KIND[4, list(range(128, 256))] = 1
_KIND[5, list(b"!")] = 1


def structure(text: bytes, codes: np.ndarray, odd: np.ndarray) -> list[float]:
    """Shares and logarithms of one text; codes: its words as codes; odd: for each code, whether it ends or starts
    with a symbol. An empty text gives zeros."""
    n, size = len(codes), len(text)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    symbols, digits, upper, points, wide, bangs = (_KIND @ counts) / size
    lines = LINE.findall(text)
    stops = counts[46] + counts[63]
    return [
        np.log1p(n) / 10, np.log1p(size) / 12, min(size / n, 40) / 10, symbols * 4, digits * 4, upper * 2, points * 4, wide, len(np.unique(codes)) / n,
        float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0, float(odd[codes].mean()), 1 - len(set(lines)) / max(len(lines), 1),
        min(n / max(len(lines), 1), 100) / 50, min(stops / n, 1) * 4, bangs * 8, (text.count(b"http") + text.count(b"www.")) / n * 8,
    ]


def odd_words(vocabulary: list[bytes]) -> np.ndarray:
    return np.fromiter((w[0] in SYMBOLS or w[-1] in SYMBOLS for w in vocabulary), np.float32, len(vocabulary))

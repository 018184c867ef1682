"""Functions on phrases, token lists and their suffixes. Positions in strings
and arrays count from 1, as in SQL; those in numpy arrays from 0."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved symbols of the text, and the trigger hash.
TERMINATOR, SEPARATOR, SEPARATOR_END = "\x02", "\x05", "\x04"
BASE, PRIME = 257, 1_000_003


def separator(w: int) -> str:
    """The mark that ends each sequence; ``w`` symbols, so always a trigger."""
    return SEPARATOR * (w - 1) + SEPARATOR_END


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once per row, also if a lambda
    uses it: named columns are put in again at every use."""
    return F.element_at(F.transform(F.array(value), then), 1)


def trigger_windows(symbols: np.ndarray, w: int, p: int) -> np.ndarray:
    """Which windows of ``w`` numbers hash to 0 modulo ``p``. The hash is of the
    window's content alone, its terms reduced so that wide windows fit."""
    n = len(symbols) - w + 1
    total = np.zeros(n, np.int64)
    for j in range(w):
        total += symbols[j : j + n] % PRIME * pow(BASE, w - 1 - j, PRIME) % PRIME
    return total % PRIME % p == 0


def wrapped(position: Column, n: Column | int) -> Column:
    """A position of the circular text."""
    return F.pmod(position, n if isinstance(n, Column) else F.lit(n))

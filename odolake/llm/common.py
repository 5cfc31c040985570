"""Helpers the operators share: text slices and vectorised word hashes.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` of a text whose A-Z are lower-cased.
A word's hash is a polynomial over its bytes modulo 2**64, mixed afterwards; one
cumulative sum gives the hashes of all words of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
"""Texts are worked on in slices of about this size; a longer text is a slice of its own."""

BATCH_ROWS = 2000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def small_batches(spark: SparkSession) -> None:
    """Rows of text are long: hand them to Python in batches of BATCH_ROWS, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of unsigned 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(index of the first row, texts) for runs of rows of about ``most`` characters; null is the empty text."""
    first, size, texts = 0, 0, []
    for k, text in enumerate(batch.column(batch.schema.get_field_index(column))):
        text = text.as_py() or ""
        if texts and size + len(text) > most:
            yield first, texts
            first, size, texts = k, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and for each text the index of its first word (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw).lower() + b"\n"
    a = np.frombuffer(joined, np.uint8)
    inside = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    terms = total[1:]
    np.take(_BYTE, a, out=terms, mode="clip")
    terms *= power[: len(a)]
    np.cumsum(terms, out=terms)
    h = (total[end] - total[start]) * inverse[start]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return h, np.searchsorted(start, at)


def held_out(column: str, modulus: int, remainder: int) -> str:
    """SQL that tells whether crc32 of the id as text leaves ``remainder``; a null id does not."""
    return f"coalesce(crc32(cast(cast({column} as string) as binary)) % {modulus} = {remainder}, false)"

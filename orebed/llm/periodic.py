"""Periodic runs of words, by bit-parallel lags over big-integer planes of word numbers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few_rows

#: Least words of a run, and least periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
OUT_DDL = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _bits(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _stretches(x: int, n: int) -> tuple[list[int], list[int]]:
    """First and last place of each stretch of ones among the n lowest bits."""
    bits = np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8 + 1, "little"), np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(bits.astype(np.int8), prepend=0))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def find_runs(words: list, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period: a stretch with smallest period q, of max(least_words,
    least_periods * q) words at least, that no neighbouring word extends. least_periods is 2 or more.

    Words are numbered; plane j is an integer whose bit i is bit j of word i's number. A plane XOR itself shifted by q has
    ones where that bit differs q words on; the OR of all planes are the mismatches of lag q. AND of its complement with
    itself shifted by 1, 2, 4, ... words leaves the places from which enough words in a row match. That is done after
    each plane, so most lags end after one or two.

    A word in a run occurs as often as it has periods: a rarer word ends any run, and the longest stretch without one
    bounds the lags."""
    n = len(words)
    if n < least_words:
        return []
    count = Counter(words)
    number = {w: k for k, w in enumerate(count)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    often = np.fromiter(count.values(), np.int64, len(count)) >= least_periods
    firsts, lasts = _stretches(_bits(often[ids]), n)
    longest = max((b - a + 1 for a, b in zip(firsts, lasts, strict=True)), default=0)
    if longest < least_words:
        return []
    planes = [_bits((ids >> j) & 1) for j in range(max(1, int(len(count) - 1).bit_length()))]
    found: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    ones = (1 << n) - 1
    for q in range(1, longest // least_periods + 1):
        need = max(least_words, least_periods * q) - q
        same = ones >> q  # the places with a word q places on
        for plane in planes:
            same &= ~(plane ^ (plane >> q))
            held, width = same, 1
            while held and width < need:
                step = min(width, need - width)
                held &= held >> step
                width += step
            if not held:
                break
        else:
            for a, b in zip(*_stretches(held, n), strict=True):
                stretch = (a, b - a + need + q)
                if stretch not in seen:  # the same words have a smaller period
                    seen.add(stretch)
                    found.append((*stretch, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """A mask of the words that stay: all but those that a run has after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(documents: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the words that no run repeats,
    joined by one space) of documents (doc_id, text). Words are [^\\x20\\x09-\\x0D]+, unchanged.

    Each row stands alone: no shuffle, a task's memory is that of its longest text, and a lost task is done again from its
    rows. Time grows with the words times the longest stretch of words that occur least_periods times.

    Null and empty texts: no words, no runs, an empty text. Repeated rows and rows without doc_id have a row each; other
    columns take no part and may have any name; an empty table gives no rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in few_rows(parts):
            counts, runs, texts = [], [], []
            for t in p.column(1).cast(pa.binary()).to_pylist():
                words = (t or b"").split()
                own = find_runs(words, least_words, least_periods)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                stay = kept_words(len(words), own)
                texts.append(b" ".join(words if not own else [words[i] for i in np.flatnonzero(stay).tolist()]))
            run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [p.column(0), pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id long, {OUT_DDL}")

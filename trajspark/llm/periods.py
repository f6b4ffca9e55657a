"""Periodic runs of words: maximal stretches in which the words repeat at a period, at least three times over.

Short periods are found by scanning: words are compared with those q places on, for each q up to LAGS. Longer ones by
minimizers at several scales. A scale is for periods from `low` to `block`, at most a quarter more. Every stretch of `block`
words has a hash, and every window of neighbouring stretches picks its least one. Inside a run of period q the windows
repeat q places on, and so do their minima; the window is narrow enough for one to fit into each run with its copy. A stretch
of a period or more meets its equal inside a run at multiples of the period only, so the next equal minimizer lies exactly
q on. Such pairs are the seeds; the words themselves, compared at that distance, give both ends of the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import slices
from trajspark.llm.words import U, mix

#: Periods found by scanning; more only move work from minimizers to scans.
LAGS = 16
LEAST, TIMES = 24, 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Numbers(dict):
    """Numbers of words, in the order of their first use."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def scales(longest: int, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """For texts of at most so many words: least period, greatest one (the stretch), and width of windows."""
    low = LAGS + 1
    while times * low <= longest:
        block = low + low // 4
        # A run has 3 q - block + 1 stretches or more; q of them are the copies.
        yield low, block, 2 * low - block + 1
        low = block + 1


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind last place of each maximal row of True."""
    edge = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) of all windows."""
    size = 1
    while 2 * size <= width:
        x, size = f(x[:-size], x[size:]), 2 * size
    return f(x[:len(x) - width + size], x[width - size:]) if width > size else x


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least hash of a window of `width`, equal ones all."""
    least = sliding(np.minimum, hashes, width)
    pad = np.zeros(width - 1, hashes.dtype)
    return np.flatnonzero(hashes == sliding(np.maximum, np.concatenate([pad, least, pad]), width))


def seeds(hashes: np.ndarray, low: int, block: int, width: int) -> list[tuple[int, int]]:
    """(distance, place) of minimizers whose next equal one is low to block places on, by distance, then place."""
    if len(hashes) < width:
        return []
    at = minimizers(hashes, width)
    order = np.argsort(hashes[at], kind="stable")
    at = at[order]
    far = np.diff(at)
    good = (hashes[at[1:]] == hashes[at[:-1]]) & (far >= low) & (far <= block)
    return sorted(zip(far[good].tolist(), at[:-1][good].tolist()))


def equal_for(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements agree."""
    done, size, n = 0, 64, min(len(a), len(b))
    while done < n:
        end = min(n, done + size)
        differ = a[done:end] != b[done:end]
        if differ.any():
            return done + int(differ.argmax())
        done, size = end, 2 * size
    return n


def runs(words: np.ndarray, cuts: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(first, behind last, period) of all runs, ordered.

    words: numbers of the words of several texts, longest text first, with a number of its own after each, so that no run
    crosses two; cuts: where each text ends.
    """
    found: dict[tuple[int, int], int] = {}

    def keep(a, b, q):
        found[a, b] = min(q, found.get((a, b), q))

    for q in range(1, min(LAGS, len(words) - 1) + 1):
        a, b = stretches(words[q:] == words[:-q])
        long = b - a + q >= max(least, times * q)
        for x, y in zip(a[long].tolist(), b[long].tolist()):
            keep(x, y + q, q)

    sizes = np.diff(np.array([-1, *cuts])) - 1
    hashed, size = mix((words.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)), 1  # of stretches of `size`
    for low, block, width in scales(int(sizes[0]) if len(sizes) else 0, times):
        end = cuts[int(np.searchsorted(-sizes, -max(least, times * low), "right")) - 1] if sizes[0] >= least else 0
        if not end:
            break
        while 2 * size <= block:
            hashed, size = mix(hashed[:-size] * U(0xD6E8FEB86659FD93) + hashed[size:]), 2 * size
        hashed = hashed[:end - size + 1]
        shift = block - size
        whole = mix(hashed[:len(hashed) - shift] * U(0xA0761D6478BD642F) + hashed[shift:])
        of, until = 0, 0
        for d, x in seeds(whole, low, block, width):
            if d == of and x < until:
                continue  # in the stretch that the seed before has given
            forth = equal_for(words[x:], words[x + d:])
            back = equal_for(words[:x][::-1], words[:x + d][::-1])
            of, until = d, x + forth
            if forth and forth + back + d >= max(least, times * d):
                keep(x - back, x + forth + d, d)
    return sorted((a, b, q) for (a, b), q in found.items())


def run_table(texts: list[bytes], least: int = LEAST, times: int = TIMES):
    """Of each text its runs (start, length, period), by start, and the words that stay, joined by blanks."""
    numbers, split = Numbers(), [t.split() for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(split[i]))
    parts, cuts, at = [], [], 0
    for k, i in enumerate(order):
        parts += [np.fromiter(map(numbers.__getitem__, split[i]), np.int64, len(split[i])), np.array([-1 - k])]
        at += len(split[i]) + 1
        cuts.append(at - 1)
    out = [([], b" ".join(w)) for w in split]
    if not texts:
        return out
    by_text: dict[int, list] = {}
    for a, b, q in runs(np.concatenate(parts), cuts, least, times):
        by_text.setdefault(int(np.searchsorted(cuts, a)), []).append((a, b, q))
    for k, rows in by_text.items():
        i, first = order[k], cuts[k] - len(split[order[k]])
        stay = np.ones(len(split[i]), bool)
        for a, b, q in rows:
            stay[a - first + q:b - first] = False
        out[i] = ([(a - first, b - a, q) for a, b, q in rows],
                  b" ".join(split[i][j] for j in np.flatnonzero(stay).tolist()))
    return out


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, `runs` and `collapsed`.

    Words are what white space of ASCII parts. A run is a maximal stretch with smallest period q of at least
    max(least, times * q) words (times: 3 or more); `runs` holds (start, length, period) in words, by start, then
    period. `collapsed` is the text without the words that some run contains after its first q, joined by one blank.

    Null and empty texts have no runs and collapse to an empty text, a null id stays null, repeated rows stay repeated,
    an empty table gives an empty one. Only the two columns are read, so others may have any name. Narrow: no shuffle, so
    neither sources nor copies can be hot; a task holds one slice of texts, and some ten numbers for each of its words.
    """
    if times < 3:
        raise ValueError("minimizers find runs of three periods or more")
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in slices(batches, "text"):
            table = run_table([b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()], least, times)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[dict(zip(("start", "length", "period"), r)) for r in rows]
                                            for rows, _ in table], run),
                 pa.array([t for _, t in table], pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(find, f"id {kind}, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col))

"""Runs of repeated words, found with a run-length grammar of the text.

Recompression shortens a sequence in rounds. A block round replaces every stretch of
one symbol by a symbol for (symbol, times); a pair round deals the symbols into left and
right ones and replaces every left symbol that a right one follows, with it, by a symbol
for the pair. Equal stretches are compressed alike but for their ends, so a longest
common extension (LCE) of two places climbs the rounds while whole symbols agree and
comes down again where they differ: a few comparisons a round, exact.

A run of period p and at least 4p words holds some multiple e of p such that the words
e, e - p, e - 2p and e - 3p agree. These places, over all p a harmonic number of them,
are the candidates; their extensions in both directions are the runs. Many documents go
through each step together, as one sequence with a symbol of its own between any two.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import GOLDEN, MASK, Batches, Codes, begin, in_slices, mix, texts_of

EXPONENT = 4
LEAST_LENGTH = 6
_CACHED_WORDS = 1 << 15
_CANDIDATES = 1 << 20


class Grammar:
    """Rounds of recompression of a sequence of small non-negative codes.

    Each round keeps, for its symbols, the name, the length in words, where the parent
    stands in the next round, and the first child's place in the round before. In a
    round that goes into blocks, ``back`` and ``ahead`` count the equal symbols of the
    block before and from each symbol on. Codes below ``closing`` occur once each and are
    never compressed; the sequence begins and ends with one.
    """

    def __init__(self, codes: np.ndarray, closing: int) -> None:
        self.names, self.lengths, self.parents, self.children, self.blocks = [codes], [np.ones(len(codes), np.int64)], [], [], []
        turn, idle = 0, 0
        while idle < 4 and len(self.names[-1]) > 2 * closing - 1:
            names = self.names[-1]
            heads = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if turn % 2 == 0 else self._pair_heads(names, closing, turn)
            turn += 1
            if len(heads) == len(names):
                idle += 1
                continue
            idle = 0
            self._add(heads, closing, block=turn % 2 == 1)

    @staticmethod
    def _pair_heads(names: np.ndarray, closing: int, turn: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            left = mix(names.astype(np.uint64) + np.uint64(turn * GOLDEN & MASK)) & np.uint64(1) == 0
        inner = names >= closing
        joined = np.zeros(len(names), bool)
        joined[1:] = left[:-1] & ~left[1:] & inner[:-1] & inner[1:]
        return np.flatnonzero(~joined)

    def _add(self, heads: np.ndarray, closing: int, block: bool) -> None:
        names, lengths = self.names[-1], self.lengths[-1]
        sizes = np.diff(np.r_[heads, len(names)])
        parent = np.repeat(np.arange(len(heads)), sizes)
        if block:
            within = np.arange(len(names)) - heads[parent]
            self.blocks.append((within, sizes[parent] - within))
            second = sizes
        else:
            self.blocks.append(None)
            second = np.where(sizes == 2, names[np.minimum(heads + 1, len(names) - 1)] + 1, 0)
        first = names[heads]
        compressed = np.flatnonzero(sizes > 1)
        _, rule = np.unique(first[compressed] * (int(second.max()) + 1) + second[compressed], return_inverse=True)
        fresh = first.copy()  # a symbol that stays keeps its name; new names lie above all of this round's
        fresh[compressed] = int(names.max()) + 1 + rule
        self.parents.append(parent)
        self.children.append(heads)
        self.names.append(fresh)
        self.lengths.append(np.add.reduceat(lengths, heads))

    def extensions(self, left: np.ndarray, right: np.ndarray, forward: bool) -> np.ndarray:
        """How many words agree from the places ``left`` and ``right`` on (or before them, going backwards)."""
        move = 1 if forward else -1
        matched = np.zeros(len(left), np.int64)
        a, b = (left.copy(), right.copy()) if forward else (left - 1, right - 1)
        stopped = np.full(len(left), -1)  # the round in which the symbols at a and b differ
        going = np.arange(len(left))
        for level in range(len(self.names)):
            if not len(going):
                break
            going = self._step(level, going, a, b, matched, move, upward=level < len(self.parents), stopped=stopped)
            if len(going):
                parent = self.parents[level]
                a[going], b[going] = parent[a[going]], parent[b[going]]
        for level in range(len(self.names) - 1, 0, -1):
            down = np.flatnonzero(stopped == level)
            if not len(down):
                continue
            heads, last = self.children[level - 1], len(self.names[level - 1]) - 1
            for at in (a, b):
                here = at[down]
                at[down] = heads[here] if forward else np.where(here + 1 < len(heads), heads[np.minimum(here + 1, len(heads) - 1)] - 1, last)
            stopped[down] = -1
            self._step(level - 1, down, a, b, matched, move, upward=False, stopped=stopped)
        return matched

    def _step(self, level: int, going: np.ndarray, a: np.ndarray, b: np.ndarray, matched: np.ndarray, move: int, upward: bool, stopped: np.ndarray) -> np.ndarray:
        """Match symbols of one round, upwards only until both places are first (or last) children.

        Where they differ, ``stopped`` tells the round. Returns what is still going.
        """
        names, lengths = self.names[level], self.lengths[level]
        block = self.blocks[level] if level < len(self.blocks) else None
        up = []
        while len(going):
            x, y = a[going], b[going]
            if upward:
                aligned = self._at_edge(level, x, move) & self._at_edge(level, y, move)
                up.append(going[aligned])
                going, x, y = going[~aligned], x[~aligned], y[~aligned]
            equal = names[x] == names[y]
            stopped[going[~equal]] = level
            going, x, y = going[equal], x[equal], y[equal]
            if block is None:
                times = 1
            else:
                back, ahead = block
                times = np.minimum(ahead[x], ahead[y]) if move > 0 else np.minimum(back[x], back[y]) + 1
            matched[going] += lengths[x] * times
            a[going] += move * times
            b[going] += move * times
        return np.concatenate(up) if up else going

    def _at_edge(self, level: int, at: np.ndarray, move: int) -> np.ndarray:
        parent = self.parents[level]
        beside = at - move
        inside = (beside >= 0) & (beside < len(parent))
        return ~inside | (parent[at] != parent[np.where(inside, beside, at)])


def _grid(words: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(e, p) for all p in [low, high) and their multiples e in [3p, words)."""
    periods = np.arange(low, high)
    counts = np.maximum((words - 1) // periods - (EXPONENT - 2), 0)
    p = np.repeat(periods, counts)
    times = np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts) + EXPONENT - 1
    return p * times, p


class _Cached:
    """The grid of all texts up to some length, by e, so that a shorter text uses a prefix of it."""

    ends = periods = np.empty(0, np.int32)
    words = 0

    @classmethod
    def up_to(cls, words: int) -> tuple[np.ndarray, np.ndarray]:
        if words > cls.words:
            cls.words = min(_CACHED_WORDS, max(1024, 2 * words))
            ends, periods = _grid(cls.words, 1, (cls.words - 1) // (EXPONENT - 1) + 1)
            by = np.argsort(ends, kind="stable")
            cls.ends, cls.periods = ends[by].astype(np.int32), periods[by].astype(np.int32)
        stop = int(np.searchsorted(cls.ends, words))
        return cls.ends[:stop], cls.periods[:stop]


def candidates(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places e and periods p on the harmonic grid where the words e, e - p, e - 2p, e - 3p agree."""

    def agreeing(e: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for times in range(1, EXPONENT):
            alike = np.flatnonzero(codes[e] == codes[e - times * p])
            e, p = e[alike], p[alike]
        return e.astype(np.int64), p.astype(np.int64)

    count = len(codes)
    if count <= _CACHED_WORDS:
        return agreeing(*_Cached.up_to(count))
    found, low, most = [], 1, (count - 1) // (EXPONENT - 1)
    while low <= most:
        high = min(most + 1, low + max(1, _CANDIDATES * low // count))
        found.append(agreeing(*_grid(count, low, high)))
        low = high
    return np.concatenate([e for e, _ in found]), np.concatenate([p for _, p in found])


def runs_of(documents: list[np.ndarray]) -> list[np.ndarray]:
    """Per sequence of codes its runs of at least max(6, 4 periods) words: rows (start, length, period), in that order's sort.

    Candidates go by growing periods; one inside a run already found, whose period
    divides its own, would give that run again and is left out.
    """
    nothing = np.empty((0, 3), np.int64)
    places = [candidates(codes) if len(codes) >= LEAST_LENGTH else (nothing[:, 0], nothing[:, 0]) for codes in documents]
    active = [d for d, (e, _) in enumerate(places) if len(e)]
    out = [nothing] * len(documents)
    if not active:
        return out
    closing = len(active) + 1
    sequence = [np.array([0])]
    for number, d in enumerate(active):
        sequence += [documents[d].astype(np.int64) + closing, np.array([number + 1])]
    codes = np.concatenate(sequence)
    starts = np.cumsum([1, *(len(documents[d]) + 1 for d in active)])
    grammar = Grammar(codes, closing)
    e = np.concatenate([places[d][0] + start for d, start in zip(active, starts)])
    p = np.concatenate([places[d][1] for d in active])
    known = nothing
    low = 1
    while len(p):
        now = p < 2 * low
        if now.any():
            known = _extended(grammar, e[now], p[now], known, len(codes))
            e, p = e[~now], p[~now]
            if len(p) and len(known):
                again = _covered(e, p, known, len(codes))
                e, p = e[~again], p[~again]
        low *= 2
    owner = np.searchsorted(starts, known[:, 0], "right") - 1
    for number, d in enumerate(active):
        own = known[owner == number] - [starts[number], 0, 0]
        out[d] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return out


def _extended(grammar: Grammar, e: np.ndarray, p: np.ndarray, known: np.ndarray, size: int) -> np.ndarray:
    """``known`` with the runs that the candidates (e, p) extend to; one interval keeps its least period."""
    by = np.lexsort((e, p))
    e, p = e[by], p[by]
    for some in np.array_split(np.arange(len(e)), max(1, len(e) // _CANDIDATES)):
        ahead = grammar.extensions(e[some] - p[some], e[some], forward=True)
        behind = grammar.extensions(e[some] - p[some], e[some], forward=False)
        start, length = e[some] - p[some] - behind, ahead + behind + p[some]
        long = length >= np.maximum(LEAST_LENGTH, EXPONENT * p[some])
        found = np.stack([start[long], length[long], p[some][long]], axis=1)
        known = np.concatenate([known, found])
        known = known[np.lexsort((known[:, 2], known[:, 1], known[:, 0]))]
        fresh = np.r_[True, (known[1:, 0] != known[:-1, 0]) | (known[1:, 1] != known[:-1, 1])][: len(known)]
        known = known[fresh]
    return known


def _covered(e: np.ndarray, p: np.ndarray, known: np.ndarray, size: int) -> np.ndarray:
    """Whether e - 3p to e lies in the known run that reaches furthest of those begun by then, and its period divides p."""
    by = np.argsort(known[:, 0], kind="stable")
    begin_, end, period = known[by, 0], known[by, 0] + known[by, 1], known[by, 2]
    reach = np.maximum.accumulate(end)
    holder = np.maximum.accumulate(np.where(end == reach, np.arange(len(end)), 0))
    at = np.searchsorted(begin_, e - (EXPONENT - 1) * p, "right") - 1
    run = holder[np.maximum(at, 0)]
    return (at >= 0) & (e < end[run]) & (p % period[run] == 0)


def collapsed_words(count: int, runs: np.ndarray) -> np.ndarray:
    """Numbers of the words that stay: those no run holds after its first period."""
    edges = np.zeros(count + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(edges[:-1]) == 0)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, in every tenth document by the id's checksum with a repeated stretch at the end; a null id changes nothing."""
    count = len(words)
    key = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if key % 10 or not count:
        return words
    group = key // 10
    start = group % count
    period = 1 + (count - start) // (3 + group % 8)
    stretch = words[start : start + period]
    times = -(-(count - start) // len(stretch))
    return words[:start] + (stretch * times)[: count - start]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())])


def find_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row of ``docs``: maximal runs of repeated words, and the text without them.

    Words stand between ASCII white space and keep their case; ``change`` may alter a
    document's words first. A run is a stretch of at least 4 of its smallest periods and
    at least 6 words that no neighbouring word goes on with; runs are ordered by start,
    then period. ``collapsed`` (UTF-8) keeps the words that no run holds after its first
    period, joined by a space. Null and empty texts have no words and no runs. Every row
    has its result, repeated or not; other columns are ignored.
    """

    def found(batches: Batches) -> Batches:
        begin("repetition")
        for batch in in_slices(batches):
            known, words, documents = Codes(), [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1), b"")):
                own = text.split()
                own = change(doc_id, own) if change else own
                words.append(own)
                documents.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
            columns: list[list] = [[], [], []]
            for own, runs in zip(words, runs_of(documents)):
                columns[0].append(len(own))
                columns[1].append([{"start": s, "length": l, "period": p} for s, l, p in runs.tolist()])
                columns[2].append(b" ".join([own[i] for i in collapsed_words(len(own), runs).tolist()] if len(runs) else own))
            arrays = [pa.array(column, field.type) for column, field in zip(columns, list(_FOUND_ARROW)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=_FOUND_ARROW)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return plain.mapInArrow(found, _FOUND)

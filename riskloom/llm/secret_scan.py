"""Secrets in texts: assignments, access keys, hex runs, and strings that a vocabulary cannot shorten.

Natural words take few tokens for their length; random strings take nearly one for
every other letter. A string of letters and digits with no more letters per token
than a bound is reported, in whatever case, and also between ordinary words of a path
or a dashed name, unless it has the form of a digest, a UUID or a date. Digits alone are
identifiers (numbers of cards, orders, accounts). Short runs of letters of one case need a
lower ratio, as long words that the vocabulary does not know come close to random ones.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Batches, begin, held, in_slices, texts_of

# The base patterns and the least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]

LEAST = 16  # shorter natural words often have no more letters per token than random ones
ONE_CASE = (20, 1.9)  # letters of one case below this length: the most letters per token
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_PART = re.compile(r"[A-Za-z0-9]+")
_DATE = r"(?:[0-9]{4}([-/_]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?:[T_-]?[0-2][0-9][-_]?[0-5][0-9](?:[-_]?[0-6][0-9])?(?:[-+_]?[0-9]{1,9})?Z?)?)"
# Digests in hex and base64, UUIDs, dates with times.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:" + "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in (32, 40, 56, 64, 96, 128)) + r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|sha(?:1-[A-Za-z0-9+/]{27}=|256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)|" + _DATE + r")(?![A-Za-z0-9])"
)

SPANS = "array<struct<kind: string, start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class Vocabulary:
    """A rank file, read once per worker."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        begin("secrets")
        if path not in _VOCABULARIES:
            _VOCABULARIES[path] = cls(path)
        return _VOCABULARIES[path]

    def letters_per_token(self, run: str) -> float:
        return len(run) / max(1, len(self.encoding.encode_ordinary(run)))


_VOCABULARIES: dict[str, Vocabulary] = held("secrets", {})


def random_spans(run: str, vocabulary: Vocabulary, most_letters_per_token: float) -> list[tuple[int, int]]:
    """Where a run of letters, digits and separators has random strings: stretches without words, or else all of it."""
    spans, last = [], 0
    for known in [*_KNOWN.finditer(run), None]:
        end = known.start() if known else len(run)
        spans += [(last + low, last + high) for low, high in _random_within(run[last:end], vocabulary, most_letters_per_token)]
        last = known.end() if known else end
    return spans


def _random_within(run: str, vocabulary: Vocabulary, most: float) -> list[tuple[int, int]]:
    if len(run) < LEAST:
        return []
    stretches: list[list[tuple[int, int, bool, bool]]] = [[]]
    parts = []
    for m in _PART.finditer(run):
        ratio = vocabulary.letters_per_token(m[0])
        size = len(m[0])
        # A part is no word if it takes several tokens and is not shortened by them; one below four letters tells nothing.
        part = (m.start(), m.end(), ratio <= most and ratio < size, ratio == size >= 3)
        parts.append(part)
        if stretches[-1] and "=" in run[stretches[-1][-1][1] : m.start()]:
            stretches.append([])
        if size >= 4 and ratio > most:
            stretches.append([])
        else:
            stretches[-1].append(part)
    found = []
    for stretch in stretches:
        while stretch and stretch[0][3]:
            del stretch[0]
        while stretch and stretch[-1][3]:
            del stretch[-1]
        if stretch:
            found += _measured(run, stretch[0][0], stretch[-1][1], stretch, vocabulary, most)
    return found or _measured(run, 0, len(run), parts, vocabulary, most)


def _measured(run: str, start: int, end: int, parts: list[tuple[int, int, bool, bool]], vocabulary: Vocabulary, most: float) -> list[tuple[int, int]]:
    """The span around the parts, if it is long enough, has few letters per token, and half of its letters stand in no word."""
    letters, unlike = sum(p[1] - p[0] for p in parts), sum(p[1] - p[0] for p in parts if p[2])
    told = "".join(_PART.findall(run, start, end))
    if told.isdigit():
        return []
    if len(told) < ONE_CASE[0] and told.isalpha() and (told[1:].islower() or told.isupper()):
        most = min(most, ONE_CASE[1])
    if end - start < LEAST or not parts or 2 * unlike < letters or vocabulary.letters_per_token(run[start:end]) > most:
        return []
    padding = re.compile("={1,2}(?![A-Za-z0-9=])").match(run, end)
    return [(start, padding.end() if padding else end)]


def secret_spans(text: str, vocabulary: Vocabulary, most_letters_per_token: float) -> list[dict]:
    """Spans by start, then kind as in KINDS; code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    exact = sorted((start, end) for start, kind, end in found if kind)  # not told once more as random
    starts, ends = [start for start, _ in exact], list(accumulate((end for _, end in exact), max))
    for m in _RUN.finditer(text):
        spans = [(m.start() + low, m.start() + high) for low, high in random_spans(m[0], vocabulary, most_letters_per_token)]
        found += [(low, 3, high) for low, high in spans if not (at := bisect_right(starts, low)) or ends[at - 1] < high]
    return [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in sorted(found)]


def find_secrets(docs: DataFrame, vocabulary: str, most_letters_per_token: float = 2.0) -> DataFrame:
    """``docs`` with a column spans; a null or empty text has none, every row stays.

    ``vocabulary`` is a rank file. The base kinds (assign, access, hex) are reported
    whatever their token ratio; ``random`` spans may overlap them. A column of
    ``docs`` that is named spans is replaced.
    """
    kept = docs.drop("spans")
    at = kept.columns.index("text")
    schema = kept.withColumn("spans", F.lit(None).cast(SPANS)).schema

    def scanned(batches: Batches) -> Batches:
        own = Vocabulary.of(vocabulary)
        for batch in in_slices(batches):
            spans = [secret_spans(text, own, most_letters_per_token) for text in texts_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _SPANS)], names=[*batch.schema.names, "spans"])

    return kept.mapInArrow(scanned, schema)


def redact_secrets(docs: DataFrame, vocabulary: str, mark: str = "[SECRET]", most_letters_per_token: float = 2.0) -> DataFrame:
    """``docs`` with every reported span (overlapping ones as one) replaced by ``mark``; null texts stay null."""
    at = docs.columns.index("text")

    def cleaned(batches: Batches) -> Batches:
        own = Vocabulary.of(vocabulary)
        for batch in in_slices(batches):
            texts = [text and redacted(text, secret_spans(text, own, most_letters_per_token), mark) for text in batch.column(at).to_pylist()]
            columns = [*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(cleaned, docs.schema)


def redacted(text: str, spans: list[dict], mark: str) -> str:
    out, last = [], 0
    for span in spans:
        if span["end"] <= last:
            continue
        if span["start"] >= last:
            out += [text[last : span["start"]], mark]
        last = span["end"]
    return "".join([*out, text[last:]])

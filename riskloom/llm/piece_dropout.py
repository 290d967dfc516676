"""SentencePiece merges with seeded dropout, and decoding that gives every text back.

The vocabulary is a BPE model with byte fallback. Merges are taken from an agenda by
score, leftmost first; when one is taken, a keyed hash of the seed, the document, the
chunk's position in the text and the number of the decision tells whether it is
skipped. Every occurrence of a word thus has a segmentation of its own, and the same
call gives the same on any machine. What is remembered are chunks with the decisions
made on them: equal decisions give equal pieces, wherever they were made. Without
dropout the ids are those of the library.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import GOLDEN, MASK, Batches, begin, held, in_slices, mix, texts_of

SPACE = "▁"  # fixed: how the models write a space
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")
_MOST_CHUNKS, _MOST_NODES, _LONGEST_CHUNK = 300_000, 4_000_000, 48
_LITERAL = "\n" + SPACE  # no chunk is like that
_NONE = 1 << 24  # no merge
_NEVER = float("inf")


class Pieces:
    """Vocabulary of a model file and the chunks that this worker has segmented."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.dtype = np.dtype("<u2" if count <= 1 << 16 else "<u4")
        plain = [i for i in range(count) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        names = {i: model.id_to_piece(i) for i in plain}
        self.rank = {piece: -model.get_score(i) for i, piece in names.items()}
        self.coded = {piece: np.array([i], self.dtype).tobytes() for i, piece in names.items()}
        self.decoded = [b""] * count
        for i, piece in names.items():
            self.decoded[i] = piece.replace(SPACE, " ").encode()
        bytes_of = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for b, i in enumerate(bytes_of):
            self.decoded[i] = bytes([b])
        self.decoded_flat = np.frombuffer(b"".join(self.decoded), np.uint8)
        self.decoded_ends = np.cumsum([0, *map(len, self.decoded)])
        self.coded_bytes = [np.array([i], self.dtype).tobytes() for i in bytes_of]
        # Chunks end where no piece of the vocabulary reaches across.
        across = [piece for piece in self.rank if SPACE in piece.lstrip(SPACE) or "\n" in piece and len(piece) > 1]
        mixed = [piece for piece in self.rank if any(a.isalpha() != b.isalpha() and SPACE not in (a, b) for a, b in zip(piece, piece[1:]) if _LATIN.match(a) or _LATIN.match(b))]
        word = "" if mixed else f"{SPACE}*{_LATIN.pattern}+(?=[.,;:!?{SPACE}\n]|\\Z)|"
        self.chunk = re.compile(r"(?s).+") if across else re.compile(f"\n|{word}{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.known = Decisions(self.dtype)
        scores = sorted(set(self.rank.values()))
        order = {score: i for i, score in enumerate(scores)}
        self.rank = {piece: order[score] for piece, score in self.rank.items()}
        self.of_letter = np.full(0x110000, -1, np.int32)
        for i, piece in names.items():
            if len(piece) == 1:
                self.of_letter[ord(piece)] = i
        number = {piece: i for i, piece in names.items()}
        splits = [(number[p[:i]], number[p[i:]], self.rank[p], n) for p, n in number.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        self.merges = Merges(np.array(splits, np.int64).reshape(-1, 4))

    def encode(self, texts: list[str], keys: list[int] | None = None, skip: int = 0) -> list[bytes]:
        """Ids of each text; its key and a chunk's position pick the segmentation, ``skip`` / 2**32 is the chance of a merge to be skipped.

        A SPACE that the text itself holds is written as bytes, to be told from a space.
        """
        split = [self._split(text) for text in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        first = np.cumsum(counts) - counts
        chunks = list(chain.from_iterable(split))
        position = np.arange(len(chunks)) - np.repeat(first, counts)
        keyed = mix(np.repeat(np.array(keys or [0] * len(texts), np.uint64), counts) + position.astype(np.uint64) * np.uint64(GOLDEN))
        if len(self.known.numbers) > _MOST_CHUNKS or self.known.nodes > _MOST_NODES:
            self.known = Decisions(self.dtype)
        known = self.known
        number = np.fromiter(map(known.numbers.get, chunks, repeat(-1)), np.int64, len(chunks))
        unseen = np.flatnonzero(number < 0)
        words = [chunks[i] for i in unseen.tolist()]
        new = [chunk for chunk in set(words) if len(chunk) <= _LONGEST_CHUNK]
        if new:
            self._segmented(new, known.plant(new, *self._letters_of(new)), np.zeros(len(new), np.uint64), 0)
            number[unseen] = np.fromiter(map(known.numbers.get, words, repeat(-1)), np.int64, len(words))
        result = known.walk(known.roots[number], keyed, skip)  # a number of -1 has no root
        missing = np.flatnonzero(result < 0)
        forgotten = number[missing] < 0  # too long to be remembered
        for at in missing[~forgotten], missing[forgotten]:
            kept = known.kept
            result[at] = self._segmented(chunks, number[at], keyed[at], skip, at)
        flat, sizes = known.ids_of(result)
        known.kept = kept
        ends = np.append(0, np.cumsum(sizes))
        low, high = ends[first] * self.dtype.itemsize, ends[first + counts] * self.dtype.itemsize
        data = flat.tobytes()
        return [data[i:j] for i, j in zip(low.tolist(), high.tolist())]

    def _segmented(self, chunks: list[str], number: np.ndarray, keyed: np.ndarray, skip: int, at: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the ids of ``chunks`` (of those ``at`` these places); the decisions on chunks that have a number are remembered."""
        known, result = self.known, np.full(len(number), -1, np.int64)
        plain = known.is_plain(number)
        for part in self._slices(np.flatnonzero(plain)):
            flat, sizes, used = self._side_by_side(*known.letters_of(number[part]), keyed[part], skip)
            result[part] = known.keep_flat(flat, sizes)
            known.learn(known.roots[number[part]], used, keyed[part], skip, result[part])
        others = np.flatnonzero(~plain)
        rows, used = self._traced([chunks[i] for i in (others if at is None else at[others]).tolist()], keyed[others], skip)
        result[others] = known.keep(rows)
        held = number[others] >= 0
        known.learn(known.roots[number[others[held]]], used[held], keyed[others[held]], skip, result[others[held]])
        return result

    def _split(self, text: str) -> list[str]:
        """Chunks that are segmented on their own; _LITERAL stands for a SPACE of the text's own."""
        if not text:
            return []
        first, *others = text.split(SPACE)
        chunks = self.chunk.findall(SPACE + first.replace(" ", SPACE))
        for other in others:
            chunks.append(_LITERAL)
            chunks += self.chunk.findall(other.replace(" ", SPACE))
        return chunks

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.decoded.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")

    def decode_many(self, rows: list[bytes]) -> list[str]:
        """``decode`` for the stored ids of many texts."""
        ids = np.frombuffer(b"".join(rows), self.dtype)
        sizes = self.decoded_ends[ids + np.int64(1)] - self.decoded_ends[ids]
        data = self.decoded_flat[_spread(self.decoded_ends[ids], sizes)].tobytes()
        pieces = np.cumsum([0, *map(len, rows)]) // self.dtype.itemsize
        ends = np.append(0, np.cumsum(sizes))[pieces].tolist()
        return [data[low + 1 : high].decode("utf-8", "surrogatepass") for low, high in zip(ends, ends[1:])]

    def _segment_many(self, chunks: list[str], key: int, skip: int) -> list[bytes]:
        return self._traced(chunks, np.full(len(chunks), key, np.uint64), skip)[0]

    @staticmethod
    def _slices(at: np.ndarray, at_once: int = 8192) -> list[np.ndarray]:
        """Slices whose words fit the processor's cache side by side."""
        return [at[low : low + at_once] for low in range(0, len(at), at_once)]

    def _letters_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of all letters of the chunks, -1 where there is none, the rank and the result of each one's merge with the next, and the lengths."""
        lengths = np.fromiter(map(len, chunks), np.int32, len(chunks))
        symbol = self.of_letter[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]
        rank, merged = self.merges.look_up(symbol, np.append(symbol[1:], -1))
        rank[np.cumsum(lengths) - 1] = _NONE
        return symbol, rank, merged, lengths

    def _traced(self, chunks: list[str], keyed: np.ndarray, skip: int) -> tuple[list[bytes], np.ndarray]:
        """Ids of many chunks and how many decisions each took, short ones side by side."""
        out, used = [b""] * len(chunks), np.zeros(len(chunks), np.int64)
        alone = [i for i, chunk in enumerate(chunks) if len(chunk) > 64]
        short = [i for i, chunk in enumerate(chunks) if len(chunk) <= 64 and chunk != _LITERAL]
        for at in self._slices(np.array(short, np.int64)):
            *letters, lengths = self._letters_of([chunks[i] for i in at.tolist()])
            known = np.minimum.reduceat(letters[0], np.cumsum(lengths) - lengths) >= 0
            alone += at[~known].tolist()
            if known.any():
                of_known = np.repeat(known, lengths)
                flat, sizes, used[at[known]] = self._side_by_side(*(x[of_known] for x in letters), lengths[known], keyed[at[known]], skip)
                data, ends = flat.tobytes(), (np.cumsum(sizes) * self.dtype.itemsize).tolist()
                for i, low, high in zip(at[known].tolist(), [0, *ends], ends):
                    out[i] = data[low:high]
        for i in alone:
            out[i], used[i] = self._alone(chunks[i], int(keyed[i]), skip)
        if len(short) + sum(len(chunk) > 64 for chunk in chunks) < len(chunks):
            literal = self._as_bytes(SPACE)
            out = [literal if chunk == _LITERAL else row for chunk, row in zip(chunks, out)]
        return out, used

    def _side_by_side(
        self, symbol: np.ndarray, rank: np.ndarray, merged: np.ndarray, lengths: np.ndarray, keyed: np.ndarray, skip: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The agendas of many words of known letters: each round takes the best merge that each of them has left.

        Takes what ``_letters_of`` says of them; returns the ids of all, how many each has and how many decisions it took.
        """
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        done, used, turn = [], np.zeros(len(lengths), np.int64), -1
        while len(word):
            turn += 1
            border = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, border)
            sizes = np.diff(np.append(border, len(word)))
            closed = best >= _NONE
            shut = np.repeat(closed, sizes)
            if closed.any():
                done.append((word[shut], symbol[shut]))
                used[word[border[closed]]] = turn
            at = np.flatnonzero((rank == np.repeat(best, sizes)) & ~shut)
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])] if len(at) else at  # the leftmost of a word
            if skip and len(at):
                left_out = _skipped_many(keyed[word[at]], turn, skip)
                rank[at[left_out]] = _NONE
                at = at[~left_out]
            symbol[at] = merged[at]
            stays = ~shut
            stays[at + 1] = False
            if stays.all():
                continue
            place = np.cumsum(stays) - 1
            at = place[at]
            word, symbol, rank, merged = (x[stays] for x in (word, symbol, rank, merged))
            if not len(at):
                continue
            before = at[at > 0] - 1
            again = np.concatenate([at, before[word[before] == word[before + 1]]])
            following = np.minimum(again + 1, len(word) - 1)
            rank[again], merged[again] = self.merges.look_up(symbol[again], symbol[following])
            rank[again[(word[following] != word[again]) | (following == again)]] = _NONE
        word, symbol = (np.concatenate(x) for x in zip(*done))
        ordered = np.argsort(word, kind="stable")  # a word closes in one round, its pieces in order
        return symbol[ordered].astype(self.dtype), np.bincount(word, minlength=len(lengths)), used

    def _as_bytes(self, letter: str) -> bytes:
        return b"".join(map(self.coded_bytes.__getitem__, letter.encode("utf-8", "surrogatepass")))

    def _coded(self, part: str) -> bytes:
        return self.coded.get(part) or self._as_bytes(part)

    def _segment(self, chunk: str, key: int, skip: int) -> bytes:
        return self._alone(chunk, key, skip)[0]

    def _alone(self, chunk: str, keyed: int, skip: int) -> tuple[bytes, int]:
        if len(chunk) > 200:
            parts, turn = self._merged_long(chunk, keyed, skip)
            return b"".join(map(self._coded, parts)), turn
        turn = 0
        rank, parts = self.rank, list(chunk)
        agenda = [rank.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)
            turn += 1
            if skip and _skipped(keyed, turn - 1, skip):
                agenda[i] = _NEVER
                continue
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = rank.get(parts[i - 1] + parts[i], _NEVER)
            if i < len(agenda):
                agenda[i] = rank.get(parts[i] + parts[i + 1], _NEVER)
        return b"".join(map(self._coded, parts)), turn

    def _merged_long(self, chunk: str, keyed: int, skip: int) -> tuple[list[str], int]:
        """The same from a heap, for chunks of any length: (rank, start, middle, end) of living neighbours."""
        end_of, start_of = list(range(1, len(chunk) + 1)), list(range(len(chunk)))  # by a part's start and by its end - 1
        heap: list[tuple[float, int, int, int]] = []

        def offer(start: int, middle: int) -> None:
            end = end_of[middle]
            found = self.rank.get(chunk[start:end]) if end - start <= 64 else None
            if found is not None:
                heapq.heappush(heap, (found, start, middle, end))

        for i in range(len(chunk) - 1):
            offer(i, i + 1)
        turn = 0
        while heap:
            _, start, middle, end = heapq.heappop(heap)
            if end_of[start] != middle or start_of[middle - 1] != start or end_of[middle] != end or start_of[end - 1] != middle:
                continue
            turn += 1
            if skip and _skipped(keyed, turn - 1, skip):
                continue
            end_of[start], start_of[end - 1] = end, start
            if start:
                offer(start_of[start - 1], start)
            if end < len(chunk):
                offer(start, end)
        parts, at = [], 0
        while at < len(chunk):
            parts.append(chunk[at : end_of[at]])
            at = end_of[at]
        return parts, turn


class Decisions:
    """Chunks with the decisions made on them, as binary trees (1 is a skipped merge) whose leaves number their ids.

    Of each chunk its letters are kept as pieces, with the merges of neighbours, so that it need not be read again.
    """

    def __init__(self, dtype: np.dtype):
        self.numbers: dict[str, int] = {}
        self.roots, self.plain = np.full(1 << 12, -1, np.int32), np.zeros(1 << 12, bool)
        self.starts, self.letters = np.zeros((1 << 12) + 1, np.int64), np.zeros((3, 1 << 15), np.int32)
        self.nodes, self.kept = 0, 0
        self.child, self.result = np.full(2 << 16, -1, np.int32), np.full(1 << 16, -1, np.int32)
        self.ends, self.flat = np.zeros((1 << 16) + 1, np.int64), np.zeros(1 << 18, dtype)

    def _more(self, count: int) -> np.ndarray:
        new = np.arange(self.nodes, self.nodes + count)
        self.nodes += count
        while self.nodes > len(self.result):
            self.child = np.concatenate([self.child, np.full_like(self.child, -1)])
            self.result = np.concatenate([self.result, np.full_like(self.result, -1)])
        return new

    def plant(self, chunks: list[str], symbol: np.ndarray, rank: np.ndarray, merged: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of new chunks, whose letters are as ``Pieces._letters_of`` has them."""
        low = len(self.numbers)
        high = low + len(chunks)
        self.numbers.update(zip(chunks, range(low, high)))
        while high >= len(self.roots):  # the last entry stays -1
            self.roots = np.concatenate([self.roots, np.full_like(self.roots, -1)])
            self.plain = np.concatenate([self.plain, np.zeros_like(self.plain)])
            self.starts = np.append(self.starts, np.zeros(len(self.starts) - 1, np.int64))
        start = int(self.starts[low])
        while start + len(symbol) > self.letters.shape[1]:
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)], axis=1)
        self.letters[:, start : start + len(symbol)] = symbol, rank, merged
        self.starts[low + 1 : high + 1] = start + np.cumsum(lengths)
        self.roots[low:high] = self._more(len(chunks))
        self.plain[low:high] = np.minimum.reduceat(symbol, np.cumsum(lengths) - lengths) >= 0
        if _LITERAL in self.numbers:
            self.plain[self.numbers[_LITERAL]] = False
        return np.arange(low, high)

    def is_plain(self, number: np.ndarray) -> np.ndarray:
        """Whether a chunk is kept and every letter of it is a piece."""
        return (number >= 0) & self.plain[number]

    def letters_of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        low = self.starts[number]
        lengths = self.starts[number + 1] - low
        symbol, rank, merged = self.letters[:, _spread(low, lengths)]
        return symbol, rank, merged, lengths

    def keep(self, rows: list[bytes]) -> np.ndarray:
        """Numbers by which ``ids_of`` finds the rows."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // self.flat.dtype.itemsize
        return self.keep_flat(np.frombuffer(b"".join(rows), self.flat.dtype), sizes)

    def keep_flat(self, added: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``keep`` for the ids of all rows in one array."""
        low, start = self.kept, self.ends[self.kept]
        self.kept += len(sizes)
        while self.kept >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while start + len(added) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[start : start + len(added)] = added
        self.ends[low + 1 : self.kept + 1] = start + np.cumsum(sizes)
        return np.arange(low, self.kept)

    def learn(self, root: np.ndarray, used: np.ndarray, keyed: np.ndarray, skip: int, result: np.ndarray) -> None:
        node, turn, at = root.copy(), 0, np.flatnonzero(used > 0)
        while len(at):
            way = 2 * node[at] + (_skipped_many(keyed[at], turn, skip) if skip else 0)
            new = way[self.child[way] < 0]
            self.child[new] = np.arange(len(new))
            new = new[self.child[new] == np.arange(len(new))]  # each once
            made = self._more(len(new))
            self.child[new] = made
            node[at] = self.child[way]
            turn += 1
            at = at[used[at] > turn]
        self.result[node] = result

    def walk(self, root: np.ndarray, keyed: np.ndarray, skip: int) -> np.ndarray:
        """What the decisions by ``keyed`` lead to, -1 where they were not met before."""
        out, turn = np.full(len(root), -1, np.int64), 0
        at = np.flatnonzero(root >= 0)
        node = root[at]
        while len(at):
            found = self.result[node]
            over = found >= 0
            out[at[over]] = found[over]
            at, node = at[~over], node[~over]
            node = self.child[2 * node + (_skipped_many(keyed[at], turn, skip) if skip else 0)]
            at, node = at[node >= 0], node[node >= 0]
            turn += 1
        return out

    def ids_of(self, result: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.ends[result]
        sizes = self.ends[result + 1] - low
        return self.flat[_spread(low, sizes)], sizes


class Merges:
    """(left, right) to (rank, merged piece) for arrays of pieces, by a few hash tables without collisions."""

    def __init__(self, splits: np.ndarray):
        self.tables = []
        while len(splits):
            slots = self._slots(splits[:, 0], splits[:, 1], len(self.tables))
            _, firsts = np.unique(slots, return_index=True)
            pairs, results = np.full(1 << 19, -1, np.int64), np.zeros((1 << 19, 2), np.int32)
            pairs[slots[firsts]] = splits[firsts, 0] << 32 | splits[firsts, 1]
            results[slots[firsts]] = splits[firsts, 2:]
            self.tables.append((pairs, results))
            splits = np.delete(splits, firsts, axis=0)

    @staticmethod
    def _slots(left: np.ndarray, right: np.ndarray, turn: int) -> np.ndarray:
        mixed = (left * 0x9E3779B1 + right * 0x85EBCA6B + turn * 0x27D4EB2F) & 0xFFFFFFFFFFFF
        return (mixed ^ (mixed >> 21)) & ((1 << 19) - 1)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = left.astype(np.int64), right.astype(np.int64)
        rank, merged = np.full(len(left), _NONE, np.int32), np.full(len(left), -1, np.int32)
        asked, at = left << 32 | right, None
        for turn, (pairs, results) in enumerate(self.tables):
            slots = self._slots(left, right, turn)
            there = pairs[slots]
            hit = there == asked
            found, place = results[slots[hit]], np.flatnonzero(hit) if at is None else at[hit]
            rank[place], merged[place] = found[:, 0], found[:, 1]
            others = np.flatnonzero(~hit & (there >= 0))  # only a pair whose slot another one has can be in a later table
            if not len(others):
                break
            at = others if at is None else at[others]
            left, right, asked = left[others], right[others], asked[others]
        return rank, merged


def _spread(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places from each ``low`` on, as many as its size."""
    return np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _skipped_many(keyed: np.ndarray, turn: int, skip: int) -> np.ndarray:
    """``_skipped`` for arrays."""
    x = keyed + np.uint64((turn + 1) * GOLDEN & MASK)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(32) < np.uint64(skip)


def _skipped(keyed: int, turn: int, skip: int) -> bool:
    x = (keyed + (turn + 1) * GOLDEN) & MASK
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & MASK
    return (x ^ (x >> 29)) >> 32 < skip


_PIECES: dict[str, Pieces] = held("pieces", {})


def _pieces(path: str) -> Pieces:
    begin("pieces")
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _document_key(doc_id: object, text: str, seed: int) -> int:
    if doc_id is None:
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), (seed + 1) & MASK)
    return xxhash.xxh64_intdigest(str(doc_id), seed & MASK)


def encode_pieces(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 0, decode: bool = False) -> DataFrame:
    """``docs`` with a column ids: each text's pieces, every chunk segmented by seed, doc_id and its position in the text.

    With ``decode``, a column decoded holds what the ids stand for, made in the same
    pass. Null and empty texts have no ids. Every row stays; the text stands in for a
    null doc_id. Columns of ``docs`` that are named ids or decoded are replaced.
    """
    kept = docs.drop("ids", "decoded")
    text_at, id_at = kept.columns.index("text"), kept.columns.index("doc_id")
    skip = int(dropout * 2**32)
    made = kept.withColumn("ids", F.lit(None).cast("array<int>"))
    schema = (made.withColumn("decoded", F.lit("")) if decode else made).schema

    def encoded(batches: Batches) -> Batches:
        own = _pieces(model)
        for batch in in_slices(batches, 1 << 20):  # every word of a slice is an object for a while
            texts = texts_of(batch.column(text_at))
            keys = [_document_key(i, text, seed) for i, text in zip(batch.column(id_at).to_pylist(), texts)]
            rows = own.encode(texts, keys, skip)
            offsets = np.cumsum([0, *(len(row) // own.dtype.itemsize for row in rows)], dtype="<i4")
            flat = np.frombuffer(b"".join(rows), own.dtype).astype("<i4")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            columns, names = [*batch.columns, ids], [*batch.schema.names, "ids"]
            if decode:
                columns.append(pa.array(own.decode_many(rows), pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(encoded, schema)


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` with a column decoded: the text that ``ids`` stand for, empty for null or no ids."""
    kept = rows.drop("decoded")
    at = kept.columns.index("ids")
    schema = kept.withColumn("decoded", F.lit("")).schema

    def decoded(batches: Batches) -> Batches:
        own = _pieces(model)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(decoded, schema)

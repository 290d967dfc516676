"""Token ids of whole texts, encoded chunk by chunk with a memory of chunks seen before.

A vocabulary of the ``tokenizers`` library never merges across the borders between
pre-tokens, so a text's ids are those of its chunks in order wherever every chunk
border is such a border. Frequent chunks of a word vocabulary are then encoded once
per worker, and a new Latin chunk goes to the vocabulary's merges directly. The
merges of a byte-level file are run by ``tiktoken`` where its ids are ranks too. All
else takes the library's whole way, and tests hold all ways against it.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import regex
import tiktoken

from riskloom.llm.common import begin, held

_LATIN = re.compile("[\n\x20-\x7e\xa1-ɏ]*")
_BYTE_LEVEL_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MOST_CHUNKS, _LONGEST_CHUNK = 600_000, 48


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_LETTERS = _byte_letters()


class Chunks(dict):
    """Ids of each chunk as bytes, remembered up to a fixed number of chunks."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= _LONGEST_CHUNK:
            if len(self) >= _MOST_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Encodes with a tokenizer file, as its library does; ids as little-endian unsigned integers of ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.kind = _kind(settings)
        self.marks = [token["content"] for token in settings["added_tokens"]]
        if self.kind == "words":
            self.words = regex.compile(settings["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        if self.kind == "byte level":
            self.merges = _ranked(settings["model"])
        self.dtype = np.dtype(id_type(self.tokenizer.get_vocab_size()))
        self.code = self.dtype.char
        self.chunks, self.parts = Chunks(self._chunk), Chunks(self._part)

    def encode(self, text: str) -> bytes:
        if self.kind == "words":  # white space ends every word and is dropped
            return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
        if self.kind == "byte level" and not any(mark in text for mark in self.marks):
            return self.merges.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes()
        return self._library(text)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk between spaces that is not remembered."""
        latin = chunk.isascii() or _LATIN.fullmatch(chunk)
        if not latin or any(mark in chunk for mark in self.marks) or len(chunk) > 4 * _LONGEST_CHUNK:
            return self._library(chunk)
        word = chunk.lower()
        if word.isalpha():  # most are a plain word, with a mark behind it at most
            return self.parts[word]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return self.parts[word[:-1]] + self.parts[word[-1]]
        lowered = "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
        return b"".join(map(self.parts.__getitem__, self.words.findall(lowered)))

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() and part.isalnum() else "".join(map(_LETTERS.__getitem__, part.encode()))
        return array(self.code, [token.id for token in self.model.tokenize(letters)]).tobytes()

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


def _ranked(model: dict) -> tiktoken.Encoding:
    """The file's own vocabulary and merges for ``tiktoken``, which runs them several times as fast."""
    byte_of = {letter: byte for byte, letter in enumerate(_LETTERS)}
    ranks = {bytes(map(byte_of.__getitem__, token)): number for token, number in model["vocab"].items()}
    return tiktoken.Encoding("file", pat_str=_BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})


def _in_rank_order(model: dict) -> bool:
    """Whether every merge makes the next id, so that ids are also the ranks of merges."""
    made = ["".join(merge if isinstance(merge, list) else merge.split(" ")) for merge in model["merges"]]
    numbers = [model["vocab"].get(token, -1) for token in made]
    return numbers == sorted(set(numbers)) and len(model["vocab"]) == 256 + len(numbers) and min(numbers) == 256


def id_type(vocabulary: int) -> str:
    """The narrowest unsigned type that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _kind(settings: dict) -> str:
    """How texts may be cut for this tokenizer; a kind that is not known here is not cut at all."""
    before, normalizer = settings["pre_tokenizer"] or {}, settings["normalizer"]
    if settings["model"].get("dropout") or settings["post_processor"]:
        return "other"
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normalizer:
        return "byte level" if _in_rank_order(settings["model"]) else "other"
    steps = [step.get("type") for step in before.get("pretokenizers", [])]
    cleaned = [step.get("type") for step in (normalizer or {}).get("normalizers", [])]
    if steps == ["Split", "ByteLevel"] and before["pretokenizers"][0].get("behavior") == "Removed" and cleaned == ["NFC", "Replace", "Lowercase"]:
        return "words"
    return "other"


_ENCODERS: dict[str, Encoder] = held("encoding", {})


def encoder(path: str) -> Encoder:
    """This worker's encoder for ``path``."""
    begin("encoding")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

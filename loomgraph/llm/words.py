"""Vectorised word-wise encoding with a public tokenizer file, used inside Arrow tasks.

The tokenizers handled here drop white space and never let a token span it, so the ids of a text
are the ids of its white-space separated words in a row. Words repeat, so each worker encodes a
word once and gathers the rest from a table. Texts of plain Latin letters, digits and signs take a
quicker road: Arrow splits and lower-cases them, and only the merges are left to the library.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TABLE_WORDS = 400_000   # a word table starts anew beyond this many words (memory, not results)
SLICE_BYTES = 2 << 20   # text handled at once
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = r"!-&(-/:-@\[-`{-~"                       # ASCII signs but the apostrophe, which opens suffixes
SPACE = r" \t\n\x0b\f\r"
ODD = f"[^{SPACE}{LETTERS}0-9{SIGNS}]|<[|]"        # texts with any of these go word by word
PIECE = f"([^{SPACE}{LETTERS}0-9]+|[0-9])"


class Table:
    """Ids of strings, each encoded once while it stays in the table."""

    def __init__(self, code: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.code = code
        self.reset()

    def reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.start = np.zeros(1, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def gather(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, bounds of each word's ids)."""
        coded = words.dictionary_encode()
        if len(self.slot) > TABLE_WORDS:
            self.reset()
        known = coded.dictionary.to_pylist()
        new = [w for w in known if w not in self.slot]
        if new:
            flat, size = self.code(new)
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new))))
            self.size = np.concatenate([self.size, size])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
            self.flat = np.concatenate([self.flat, flat])
        slots = np.fromiter(map(self.slot.__getitem__, known), np.int64, len(known))[np.asarray(coded.indices)]
        size = self.size[slots]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.start[slots] - ends[:-1], size) + np.arange(ends[-1])], ends


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file, with truncation and padding off."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        probe = "ab cd\nef,\t gh"
        if self.direct(probe) != [i for w in probe.split() for i in self.direct(w)]:
            raise ValueError("this tokenizer keeps white space; words can't be encoded one by one")
        self.words, self.pieces = Table(self._by_library), Table(self._by_merges)
        # a second tokenizer over the same merges, used only if it agrees on every plain character
        signs = [c for c in map(chr, range(33, 256)) if not re.match(ODD, c)]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {ord(c): level.pre_tokenize_str(c)[0][0] for c in [*signs, *"¶§©®°±£¥"]}
        self.merges = Tokenizer(self.tok.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.mark, self.mark_id = next(((c, i[0]) for c in "¶§©®°±£¥" if len(i := self.direct(c)) == 1), ("", -1))
        self.plain = bool(self.mark)
        probes = [*signs, *(f"{a}{b}" for a in signs[::3] for b in signs[::5]), "ABé9(x).y,", "Ünï-cödé12!? a\x0bb"]
        self.plain = self.plain and [x.tolist() for x in self.encode_list(probes)] == [self.direct(p) for p in probes]

    def direct(self, text: str) -> list[int]:
        """The library's own answer for one text."""
        return self.tok.encode(text, add_special_tokens=False).ids

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter((i for ids in coded for i in ids), np.uint32, int(size.sum())), size

    def _by_merges(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces joined with a lone mark between, so that one call codes many and the mark parts them."""
        texts = [(f" {self.mark} ".join(pieces[i:i + 100]) + f" {self.mark}").translate(self.shown)
                 for i in range(0, len(pieces), 100)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.merges.encode_batch_fast(texts, add_special_tokens=False)])
        marks = ids == self.mark_id
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the bounds of each text's ids in them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, ODD)) if self.plain else np.ones(len(texts), bool)
        if odd.all() or not odd.any():
            return self._encode(texts, bool(len(odd) and odd[0]))
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        parts = [self._encode(texts.filter(pa.array(odd == flag)), flag) for flag in (False, True)]
        ids = np.concatenate([p[0] for p in parts])
        size = np.concatenate([np.diff(p[1]) for p in parts])
        start, back = np.concatenate([[0], np.cumsum(size)[:-1]]), np.argsort(order)
        size, start = size[back], start[back]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends

    def _encode(self, texts: pa.Array, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        if not odd:
            texts = pc.utf8_lower(pc.replace_substring_regex(texts, PIECE, r" \1 "))
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        words = lists.flatten()
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ids, ends = (self.words if odd else self.pieces).gather(words)
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        return ids, ends[bounds - bounds[0]]

    def encode_list(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.encode(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path)


@lru_cache(maxsize=2)
def token_strings(path: str) -> list[str]:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    if tok.decoder is not None:
        raise ValueError("a tokenizer with a decoder step needs the library's decode")
    return [tok.id_to_token(i) for i in range(tok.get_vocab_size())]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop
    pa.default_memory_pool().release_unused()   # workers live on; what a batch took goes back


def part_of(column: pa.Array, a: int, b: int) -> pa.Array:
    """Rows [a, b) as an array of its own: Arrow's string kernels misread some arrays with an offset."""
    return column if a == 0 and b == len(column) else column.take(pa.array(np.arange(a, b)))

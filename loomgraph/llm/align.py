"""Alignment of two tokenizers' tokens on the bytes of a text.

Both tokenizers see the text behind one space. A byte offset where tokens of both end closes a
group. Groups are found by pointer jumping: each token points to the token that overlaps it and
reaches farthest right (a token that reaches as far as any it overlaps with points to the second
tokenizer's of that end, which points to itself), and successors are doubled until nothing moves;
each component's terminal token then names its group. The tokens of many pieces of text lie on one
line of bytes, so a round is one gather over all of them.

Neither tokenizer joins a word to a single space behind it, so a text falls into pieces at single
spaces between other characters; both tokenizers end a token there, and pieces repeat. A worker
encodes and groups a piece once while it stays in its table.

A link is a pair of token occurrences that end together. Links of all documents are counted by their
pair of ids. Of two tokens that end together the shorter is a tail of the longer, so the distinct
pairs are at most the bytes of both vocabularies (``most_pairs``), whatever the corpus; that bound is
checked before the counts are broadcast.

Null or empty texts, and texts that either tokenizer changes (joined token bytes differ from space and
text), have no tokens and get zeros and an empty string. Repeated rows and ids are aligned row by row;
empty tables give empty results; other columns are not read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, text_of
from .words import part_of, slices

CUT = re.compile(r"(?<=\S) (?=\S)")
TABLE_PIECES, TABLE_TOKENS = 300_000, 4_000_000   # a worker's table starts anew beyond these (memory, not results)
ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, groups string, pairs binary, times binary"


def byte_symbols() -> dict[str, int]:
    """Character that byte-level vocabularies write for each byte: visible Latin-1 stands for itself, the rest is moved behind it."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def jump(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Terminal token of each token, those of A first; ``ends_*`` are strictly increasing and end alike."""
    n = len(ends_a)
    over_a = n + np.searchsorted(ends_b, ends_a)     # the token of B that holds A's last byte reaches farthest
    over_b = np.searchsorted(ends_a, ends_b)
    over_b = np.where(ends_a[over_b] == ends_b, n + np.arange(len(ends_b)), over_b)
    succ = np.concatenate([over_a, over_b])
    while not np.array_equal(succ, twice := succ[succ]):
        succ = twice
    return succ


class Aligner:
    """Pieces of text with both tokenizers' ids, groups and links."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=path_b)
        symbols = byte_symbols()
        self.bytes_a = [bytes(symbols[c] for c in t) if set(t := self.a.id_to_token(i)) <= symbols.keys() else t.encode()
                        for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("this vocabulary joins words to spaces behind them; texts can't be aligned piece by piece")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in v]) for v in (self.bytes_a, self.bytes_b))
        self.most_pairs = int(self.size_a.sum() + self.size_b.sum())
        self.kind = np.dtype("<u4" if len(self.size_a) * len(self.size_b) <= 1 << 32 else "<u8")
        self.reset()

    def reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.shown: list[str] = []          # a1,a2|b1;...
        self.n = np.zeros((0, 4), np.int64)  # sound, tokens of A, tokens of B, groups
        self.start = np.zeros(1, np.int64)
        self.links = np.zeros(0, self.kind)

    def learn(self, pieces: list[str]) -> None:
        """Adds pieces that are not in the table."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        ids_b = self.b.encode(pieces, num_threads=1)
        whole = [(" " + p).encode() for p in pieces]
        sound = [b"".join([self.bytes_a[i] for i in x]) == s == b"".join([self.bytes_b[i] for i in y]) for x, y, s in zip(ids_a, ids_b, whole)]
        kept = [k for k, ok in enumerate(sound) if ok]
        flat_a = np.fromiter((i for k in kept for i in ids_a[k]), np.int64)
        flat_b = np.fromiter((i for k in kept for i in ids_b[k]), np.int64)
        n = np.zeros((len(pieces), 4), np.int64)
        if kept:
            ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
            last = jump(ends_a, ends_b)
            # ids in the order of the line: groups by terminal, A before B in each
            last_a, last_b = last[:len(flat_a)] - len(flat_a), last[len(flat_a):] - len(flat_a)
            closing = np.flatnonzero(np.append(last_b[1:] != last_b[:-1], True))        # B's tokens that end a group
            cut_a = np.searchsorted(last_a, closing, "right")
            n[kept, 0] = 1
            n[kept, 1] = [len(ids_a[k]) for k in kept]
            n[kept, 2] = [len(ids_b[k]) for k in kept]
            size_b = n[kept, 2]
            upto = np.searchsorted(closing, np.cumsum(size_b))                          # groups up to each piece's end
            n[kept, 3] = np.diff(upto, prepend=0)
            links = (flat_a[cut_a - 1].astype(self.kind) * self.kind.type(len(self.size_b)) + flat_b[closing].astype(self.kind))
            say_a, say_b = [str(i) for i in flat_a.tolist()], [str(i) for i in flat_b.tolist()]
            groups, x, y = [], 0, 0
            for p, q in zip(cut_a.tolist(), (closing + 1).tolist()):
                groups.append(f"{','.join(say_a[x:p])}|{','.join(say_b[y:q])}")
                x, y = p, q
        else:
            links, groups, upto = np.zeros(0, self.kind), [], np.zeros(0, np.int64)
        bounds = dict(zip(kept, zip([0, *upto[:-1].tolist()], upto.tolist())))
        for k, p in enumerate(pieces):
            self.slot[p] = len(self.shown)
            lo, hi = bounds.get(k, (0, 0))
            self.shown.append(";".join(groups[lo:hi]))
        self.n = np.concatenate([self.n, n])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n[:, 3])])
        self.links = np.concatenate([self.links, links])

    def align(self, texts: list[str | None]) -> pa.RecordBatch:
        """ALIGNED columns of these texts."""
        split = [CUT.split(" " + t) if t else [] for t in texts]
        for s in split:
            if s:
                s[0] = s[0][1:]
        if len(self.slot) > TABLE_PIECES or len(self.links) > TABLE_TOKENS:
            self.reset()
        new = {p for s in split for p in s if p not in self.slot}
        if new:
            self.learn(list(new))
        slot, shown, rows, pairs, times = self.slot, self.shown, [], [], []
        for s in split:
            at = np.array([slot[p] for p in s], np.int64)
            got = self.n[at]
            if not len(at) or not got[:, 0].all():
                rows.append((0, 0, 0, ""))
                pairs.append(b"")
                times.append(b"")
                continue
            once, often = np.unique(at, return_counts=True)
            size = self.n[once, 3]
            ends = np.cumsum(size)
            links = self.links[np.repeat(self.start[once] - ends + size, size) + np.arange(ends[-1])]
            key, back = np.unique(links, return_inverse=True)
            count = np.bincount(back, np.repeat(often, size), len(key)).astype("<i8")
            rows.append((*map(int, got[:, 1:].sum(axis=0)), ";".join([shown[i] for i in at.tolist()])))
            pairs.append(key.tobytes())
            times.append(count.tobytes())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(pairs, pa.binary()), pa.array(times, pa.binary())],
                                          ["n_a", "n_b", "n_groups", "groups", "pairs", "times"])


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process and pair of files."""
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pairs, times): a document's groups as ``a1,a2|b1;a3|b2,b3``, its
    distinct id pairs packed as a * |B| + b, and how often each is linked."""
    columns_of(docs, ["doc_id", "text"])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = aligner(path_a, path_b)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                out = code.align(part_of(batch.column(1), a, b).to_pylist())
                yield pa.RecordBatch.from_arrays([part_of(batch.column(0), a, b), *out.columns], ["doc_id", *out.schema.names])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, {ALIGNED}")


def unpacked(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """All numbers of a binary column in a row."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def link_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n): links of all documents by id pair; tasks add up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = aligner(path_a, path_b).kind
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own = np.concatenate([pairs, unpacked(batch.column(0), kind).astype(np.int64)])
            pairs, back = np.unique(own, return_inverse=True)
            n = np.bincount(back, np.concatenate([n, unpacked(batch.column(1), np.dtype("<i8"))]), len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    return aligned.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def score(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``aligned`` (stored) with n_links, n_best and count_sum in place of the packed pairs."""
    code = aligner(path_a, path_b)
    # at most one row for each byte of the vocabularies: see the head of this module
    table = link_counts(aligned, path_a, path_b).limit(code.most_pairs + 1).toArrow()
    if len(table) > code.most_pairs:
        raise ValueError("more id pairs than two tokens of equal ends can form")
    pairs, n = table["pair"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    size_b, most = len(code.size_b), np.zeros(len(code.size_b), np.int64)
    np.maximum.at(most, pairs % size_b, n)
    held = aligned.sparkSession.sparkContext.broadcast((pairs, n, n == most[pairs % size_b]))
    kind = code.kind

    @F.arrow_udf("struct<n_links: bigint, n_best: bigint, count_sum: bigint>")
    def found(keys: pa.Array, times: pa.Array) -> pa.Array:
        all_pairs, counts, best = held.value
        size = np.asarray(pc.binary_length(keys)).astype(np.int64) // kind.itemsize
        often = unpacked(times, np.dtype("<i8"))
        at = np.searchsorted(all_pairs, unpacked(keys, kind).astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(size)])
        total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[ends])
        sums = [total(often), total(often * best[at]), total(often * counts[at])] if len(at) else [np.zeros(len(size), np.int64)] * 3
        return pa.StructArray.from_arrays([pa.array(s) for s in sums], ["n_links", "n_best", "count_sum"])

    return aligned.withColumn("__llm_found", found("pairs", "times")).select(
        *[c for c in aligned.columns if c not in ("pairs", "times")], "__llm_found.*")

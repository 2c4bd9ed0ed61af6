"""Encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of their last 32 bytes says so, so equal passages give equal
chunks wherever they stand. A chunk that different texts share is encoded once, by the text that
owns it, and its ids are joined to the others; the rest of a text is encoded in place. Where two
pieces meet inside a word, the words around the joint are encoded again, wider and wider, until
both sides agree with the ids at hand.

Null text is empty. Repeated rows and ids are encoded row by row; empty tables give empty results.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, release, store, text_key, text_of
from .suffix import bytes_of
from .words import encoder, part_of, slices, token_strings, WordEncoder

GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
CHUNK_BITS = 10   # chunks of about a kilobyte
FILTER_BITS = 1 << 27   # 4096 slots of 4 kB
WHITE_BYTES = frozenset(b" \t\n\x0b\f\r")


def chunk_ends(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """End of each chunk, relative to its text."""
    if not len(data):
        return [np.zeros(0, np.int64) for _ in bounds[1:]]
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):   # doubling: h covers 32 bytes after five steps
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    cut = (h >> np.uint32(32 - CHUNK_BITS)) == 0
    cut[:-1] &= (data[1:] & 0xC0) != 0x80   # never inside a character
    at = np.flatnonzero(cut) + 1
    lo, hi = np.searchsorted(at, bounds[:-1] + 32, "left"), np.searchsorted(at, bounds[1:], "left")
    return [np.append(at[a:b], e) - s if e > s else np.zeros(0, np.int64) for a, b, s, e in zip(lo, hi, bounds[:-1], bounds[1:])]


def chunks(texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(number, bytes, chunk ends) of each text."""
    data, bounds = bytes_of(texts)
    for k, ends in enumerate(chunk_ends(data, bounds)):
        yield k, data[bounds[k]:bounds[k + 1]].tobytes(), ends


def split_names(texts: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """(text, chunk, name) of chunks that hold white space; others can't be reused whole."""
    for k, data, ends in chunks(texts):
        start = 0
        for i, end in enumerate(ends.tolist()):
            part = data[start:end]
            if len(part.split()) > 1:
                yield k, i, xxhash.xxh3_128_digest(part)
            start = end


def _left(data: bytes, x: int, words: int) -> int:
    """Start of the word that ends at ``x``, and of ``words`` more before it."""
    for k in range(words + 1):
        while x > 0 and k and data[x - 1] in WHITE_BYTES:
            x -= 1
        while x > 0 and data[x - 1] not in WHITE_BYTES:
            x -= 1
    return x


def _right(data: bytes, x: int, words: int) -> int:
    n = len(data)
    for k in range(words + 1):
        while x < n and k and data[x] in WHITE_BYTES:
            x += 1
        while x < n and data[x] not in WHITE_BYTES:
            x += 1
    return x


def joined(code: WordEncoder, data: bytes, ends: list[int], parts: list[np.ndarray]) -> np.ndarray:
    """Ids of ``data`` from the ids of the pieces that end at ``ends``, with the joints repaired.

    Ids grow in one buffer and a joint reads only the words around it, so a long text stays linear.
    A joint where the pieces disagree is encoded from the last place that is settled.
    """
    out, n = np.empty(sum(map(len, parts)) + 1024, np.uint32), 0
    direct = lambda a, b: code.direct(data[a:b].decode())

    def put(ids: np.ndarray) -> None:
        nonlocal out, n
        if n + len(ids) > len(out):
            out = np.concatenate([out[:n], np.empty(n + 2 * len(ids), np.uint32)])
        out[n:n + len(ids)] = ids
        n += len(ids)

    if parts:
        put(parts[0])
    settled, settled_ids = 0, 0   # a word starts here, and the ids before it are final
    for x, stop, piece in zip(ends[:-1], ends[1:], parts[1:]):
        if data[x - 1] in WHITE_BYTES or data[x] in WHITE_BYTES:
            settled, settled_ids = x, n
            put(piece)
            continue
        for words in (0, 1, 3, 7):
            a, b = _left(data, x, words), _right(data, x, words)
            left, right = direct(a, x), direct(x, b)
            if b <= stop and out[max(0, n - len(left)):n].tolist() == left and piece[:len(right)].tolist() == right:
                n -= len(left)
                settled, settled_ids = a, n
                put(np.array(direct(a, b), np.uint32))
                put(piece[len(right):])
                break
        else:
            n = settled_ids
            put(np.array(direct(settled, stop), np.uint32))
    return out[:n].copy()


def whole_words(data: bytes, plan: list[list]) -> list[list]:
    """A piece to encode that holds no white space joins its neighbour, whose lent ids then go unused."""
    out, start = [], 0
    for end, ids in plan:
        if out and (out[-1][1] is None) and (ids is None or len(data[out[-1][2]:out[-1][0]].split()) < 2):
            out[-1][0] = end
        elif out and ids is None and len(data[start:end].split()) < 2:
            out[-1][:2] = [end, None]
        else:
            out.append([end, ids, start])
        start = end
    return [[end, ids] for end, ids, _ in out]


def filed(keys: DataFrame) -> DataFrame:
    """(slot, bits): a table of ``FILTER_BITS`` bits at most, one set for each 16-byte ``key``."""
    at = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    return keys.groupBy(F.bitmap_bucket_number(at).alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def marked(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """``rows`` with ``hit``: false only where ``key`` is surely not filed. The table is small by construction."""
    at = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substr("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (place % 8 + 1).cast("int"))) != 0, F.lit(False))
    out = rows.withColumn("slot", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "slot", "left")
    return out.withColumn("hit", hit).drop("slot", "bits")


def encode(docs: DataFrame, path: str, with_text: bool = False) -> DataFrame:
    """(doc_id, ids): ids as unsigned 32-bit little-endian bytes, one row per document.

    ``with_text`` adds ``decoded``, what ``decode`` gives for the ids, made by the same worker process.

    Only texts that share a chunk with another text are shuffled. They are told apart by a bit table of
    fixed size (16 MB); a false hit moves a text for nothing and changes no id.
    """
    columns_of(docs, ["doc_id", "text"])
    keyed = docs.select("doc_id", text_key().alias("key"), text_of().alias("text"))

    def name_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b in slices(batch.column(1)):
                rows = [(keys[a + k], i, name) for k, i, name in split_names(part_of(batch.column(1), a, b)) if keys[a + k] not in seen]
                seen.update(keys[a:b])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.binary()))], ["key", "seq", "name"])

    refs = store(keyed.select("key", "text").mapInArrow(name_chunks, "key binary, seq int, name binary"))
    at = F.struct("key", "seq")
    owned = (refs.groupBy("name").agg(F.min(at).alias("own"), F.max("key").alias("other"))
             .filter(F.col("own.key") != F.col("other")).select("name", "own"))
    shared = store(refs.join(owned, "name").select("key", "seq", "name", (F.struct("key", "seq") == F.col("own")).alias("mine")))
    release(refs)
    sharing = marked(keyed, store(filed(shared.select("key"))))
    asked = shared.filter("mine").groupBy("key").agg(F.collect_set("seq").alias("seqs"))
    owners = marked(keyed, store(filed(shared.filter("mine").select("key")))).filter("hit").dropDuplicates(["key"])

    def encode_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen = encoder(path), set()
        for batch in batches:
            names, parts = [], []
            for seqs, (_, data, ends) in zip(batch.column(1).to_pylist(), chunks(batch.column(0))):
                for i in seqs:
                    part = data[(int(ends[i - 1]) if i else 0):int(ends[i])]
                    if (name := xxhash.xxh3_128_digest(part)) not in seen:
                        seen.add(name)
                        names.append(name)
                        parts.append(part.decode())
            if names:
                ids = [x.astype("<u4").tobytes() for x in code.encode_list(parts)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, pa.binary())], ["name", "ids"])

    coded = store(owners.join(asked, "key").select("text", "seqs").mapInArrow(encode_own, "name binary, ids binary"))
    lent = (shared.join(coded, "name").groupBy("key", "seq").agg(F.first("ids").alias("ids"))
            .groupBy("key").agg(F.collect_list(F.struct("seq", "ids")).alias("lent")))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts, lent = part_of(batch.column(1), a, b), part_of(batch.column(2), a, b)
                plain = np.flatnonzero(np.asarray(lent.is_null()))
                flat, ends = code.encode(texts.take(pa.array(plain)))
                ids: list[np.ndarray] = [flat[:0]] * len(texts)
                for k, s, e in zip(plain, ends[:-1], ends[1:]):
                    ids[k] = flat[s:e]
                todo, plans = [], []
                asking = np.flatnonzero(np.asarray(lent.is_valid()))
                for j, data, cuts in chunks(texts.take(pa.array(asking))) if len(asking) else ():
                    k = int(asking[j])
                    own = {x["seq"]: np.frombuffer(x["ids"], "<u4") for x in lent[k].as_py()}
                    plan, start = [], 0   # (end, ids or None); neighbours without ids become one piece
                    for i, end in enumerate(cuts.tolist()):
                        if i in own:
                            plan.append([end, own[i]])
                        elif plan and plan[-1][1] is None:
                            plan[-1][0] = end
                        else:
                            plan.append([end, None])
                    plan = whole_words(data, plan)
                    for p in plan:
                        if p[1] is None:
                            todo.append((p, data[start:p[0]].decode()))
                        start = p[0]
                    plans.append((k, data, plan))
                for (p, _), got in zip(todo, code.encode_list([t for _, t in todo]) if todo else []):
                    p[1] = got
                for k, data, plan in plans:
                    ids[k] = joined(code, data, [p[0] for p in plan], [p[1] for p in plan])
                out = [part_of(batch.column(0), a, b), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if with_text:
                    out.append(texts_of(ids, path))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][:len(out)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    apart = sharing.filter(~F.col("hit")).select("doc_id", "text", F.lit(None).cast("array<struct<seq:int,ids:binary>>").alias("lent"))
    met = sharing.filter("hit").join(lent, "key", "left").select("doc_id", "text", "lent")
    return apart.unionByName(met).mapInArrow(assemble, f"doc_id {kind}, ids binary" + ", decoded string" * with_text)


def texts_of(ids: Iterable[np.ndarray], path: str) -> pa.Array:
    names = token_strings(path)
    return pa.array([" ".join([names[i] for i in x.tolist()]) for x in ids], pa.string())


def decode(ids: Column, path: str) -> Column:
    """Text of an ids column, special tokens included."""
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return texts_of((np.frombuffer(x.as_buffer(), "<u4") for x in column), path)

    return run(ids)

"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A shard is one binary value: a header, the ids, and an Elias-Fano sequence of document ends whose select
structure returns any boundary from about 2 + log2(u/n) bits a document. Shards are written in ascending
document order and read back; a document's global offset is its shard's base plus a select.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Interner, arrow_rows, chunks, kept, partitions_for, stash, table

MAGIC = b"AXTF1"
#: a shard is closed at this many ids or documents; words kept by a worker's encoder
SHARD_IDS, SHARD_DOCS, CACHED = 1 << 19, 4096, 700_000
SAMPLE = 64
#: bytes of text encoded together (or one longer text); new pieces in a string for the library
GROUP, TOGETHER = 8 << 20, 64
#: a piece without white space but for a space or line break that leads it
PLAIN = re.compile(r"[ \n]?\S+")
#: by byte: ASCII white space, ASCII letters, ASCII punctuation without the apostrophe, bytes that may begin a Latin-1 letter or other white space; white space of three bytes
WHITE, LETTER, MARK, LEADS = (np.array([f(b) for b in range(256)]) for f in (
    lambda b: b in b"\t\n\v\f\r\x1c\x1d\x1e\x1f ", lambda b: b < 128 and chr(b).isalpha(), lambda b: 32 < b < 127 and not chr(b).isalnum() and b != 39, lambda b: b in b"\xc2\xc3\xe1\xe2\xe3",
))
WIDE = np.array([int.from_bytes(chr(c).encode()) for c in (0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


class EliasFano:
    """A monotone sequence of n values below or at u: low bits packed, high bits in unary, select samples every 64 ones."""

    def __init__(self, n: int, u: int, low: np.ndarray, high: np.ndarray):
        self.n, self.u, self.low, self.high = n, u, low, high
        self.l = self.low_bits(n, u)
        self._ones = None
        if n:
            counts = np.cumsum(POPCOUNT[high])
            self.samples = np.searchsorted(counts, np.arange(0, n, SAMPLE) + 1)  # byte of every 64th one
            self.before = np.concatenate(([0], counts))[self.samples]

    @staticmethod
    def low_bits(n: int, u: int) -> int:
        return max(0, (u // n).bit_length() - 1) if n else 0

    @classmethod
    def of(cls, values: np.ndarray, u: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, l = len(values), cls.low_bits(len(values), u)  # noqa: E741
        bits = ((values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if l else np.zeros((n, 0), np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        top = np.zeros(n + (u >> l) + 1, np.uint8)
        top[(values >> np.uint64(l)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, u, low, np.packbits(top, bitorder="little"))

    def select(self, i: int) -> int:
        """The i-th value, from a sample and a scan of a few bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, seen = int(self.samples[i // SAMPLE]), int(self.before[i // SAMPLE])
        while seen + int(POPCOUNT[self.high[byte]]) <= i:
            seen += int(POPCOUNT[self.high[byte]])
            byte += 1
        ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        pos = byte * 8 + int(ones[i - seen])
        if not self.l:
            return pos - i
        at = i * self.l
        raw = int.from_bytes(self.low[at // 8 : (at + self.l + 7) // 8].tobytes(), "little")
        return ((pos - i) << self.l) | ((raw >> (at % 8)) & ((1 << self.l) - 1))

    def all(self) -> np.ndarray:
        pos = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (pos - np.arange(self.n)).astype(np.uint64) << np.uint64(self.l)
        if self.l:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.l].reshape(self.n, self.l).astype(np.uint64)
            out |= (bits << np.arange(self.l, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out.astype(np.int64)

    def to_bytes(self) -> bytes:
        return struct.pack("<QQII", self.n, self.u, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> EliasFano:
        n, u, a, h = struct.unpack_from("<QQII", b)
        return cls(n, u, np.frombuffer(b, np.uint8, a, 24), np.frombuffer(b, np.uint8, h, 24 + a))


POPCOUNT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def write_shard(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """doc ids (null: flagged), Elias-Fano document ends, ids as 16-bit words where they fit."""
    kind = np.dtype("<u2") if len(ids) == 0 or int(ids.max()) < 65536 else np.dtype("<u4")
    ends = EliasFano.of(np.cumsum(lengths), len(ids)).to_bytes()
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.packbits([d is None for d in doc_ids], bitorder="little").tobytes()
    return MAGIC + struct.pack("<BIQII", kind.itemsize, len(doc_ids), len(ids), len(ends), len(nulls)) + keys + nulls + ends + ids.astype(kind).tobytes()


class Shard:
    """Random access to a written shard: ``doc(i)`` returns the ids of its i-th document."""

    def __init__(self, b: bytes):
        assert b[:5] == MAGIC, "not a token file"
        width, self.n, self.total, e, z = struct.unpack_from("<BIQII", b, 5)
        at = 5 + struct.calcsize("<BIQII")
        self.keys = np.frombuffer(b, "<i8", self.n, at)
        at += 8 * self.n
        self.nulls = np.unpackbits(np.frombuffer(b, np.uint8, z, at), bitorder="little")[: self.n].astype(bool)
        self.ends = EliasFano.from_bytes(b[at + z : at + z + e])
        self.ids = np.frombuffer(b, f"<u{width}", self.total, at + z + e)

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def doc(self, i: int) -> np.ndarray:
        return self.ids[self.start(i) : self.ends.select(i)]


def cuts(buf: np.ndarray) -> np.ndarray:
    """Where UTF-8 text may be cut so that the ids of its pieces are its ids: bytes before which the splitting pattern always ends a match.

    These are a single space or line break between two characters that are not white space, what follows such a line break, and
    ASCII punctuation (no apostrophe) after a letter of ASCII or Latin-1. Other letters are not looked for, their pieces are only longer.
    """
    white, letter = WHITE[buf], LETTER[buf]
    at = np.flatnonzero(LEADS[buf])
    if len(at):
        x, y, z = buf[at], np.append(buf[1:], 0)[at], np.append(buf[2:], (0, 0))[at]
        latin = at[(x == 0xC3) & (y != 0x97) & (y != 0xB7)]
        letter[latin] = letter[latin + 1] = True
        two = at[(x == 0xC2) & ((y == 0x85) | (y == 0xA0))]
        white[two] = white[two + 1] = True
        code = (x.astype(np.int64) << 16) | (y.astype(np.int64) << 8) | z
        three = at[np.isin(code, WIDE)]
        white[three] = white[three + 1] = white[three + 2] = True
    gap = (buf == 32) | (buf == 10)
    gap[1:] &= ~white[:-1]
    gap[:-1] &= ~white[1:]
    out = gap.copy()
    out[1:] |= (gap[:-1] & (buf[:-1] == 10)) | (MARK[buf[1:]] & letter[:-1])
    return out


class Encoder:
    """Whole texts to ids, exactly as the tokenizers library, with the ids of frequent words kept.

    Texts are cut where the tokenizer's splitting pattern always cuts (``cuts``), so their ids are those of the pieces. The distinct pieces of many
    texts are looked up once. New ones without white space inside go to the library many at a time in one string, each led by its space or a line break,
    whose ids are cut again at the tokens that begin with it; others go one by one. Texts with a special token's string go to the library whole.
    """

    def __init__(self, path: str, cached: int = CACHED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cached = cached
        self.forget()
        self.begins = np.zeros(self.tok.get_vocab_size(), bool)
        for piece, i in self.tok.get_vocab().items():
            self.begins[i] = piece.startswith(("\u0120", "\u010a"))  # how byte-level vocabularies write a space and a line break

    def forget(self) -> None:
        """Pieces by number; the i-th has size[i] ids from first[i] on."""
        self.known, self.ids, self.first, self.size = Interner(), np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.encode_array(pa.array(texts, pa.large_string()))
        return np.split(ids, ends[:-1]) if texts else []

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (large strings without nulls), and where those of each text end."""
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.encode_plain(texts)
        ids, ends = self.encode_plain(pc.if_else(pa.array(whole), "", texts))
        parts = np.split(ids, ends[:-1])
        for i in np.flatnonzero(whole).tolist():
            parts[i] = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if bounds[0] == bounds[-1]:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        if len(self.known) > self.cached or len(self.ids) > 8 * self.cached or len(self.known) != len(self.size):  # full, or a group before was not learned to its end
            self.forget()
        buf, bounds = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
        cut = np.append(cuts(buf), True)
        cut[bounds] = True
        cut = np.flatnonzero(cut)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(buf)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.learn(self.known.take())
        number = number[pieces.indices.to_numpy()]
        size = self.size[number]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[number] - (ends - size), size) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(cut, bounds[1:])]

    def learn(self, new: list[bytes]) -> None:
        """Ids of new pieces, in their order."""
        texts = [p.decode() for p in new]
        plain = [i for i, p in enumerate(texts) if PLAIN.fullmatch(p)]
        bare = np.array([texts[i][0] not in " \n" for i in plain], np.int64)
        strings = ["\n" + texts[i] if x else texts[i] for i, x in zip(plain, bare.tolist(), strict=True)]
        found = [e.ids for e in self.tok.encode_batch_fast(["".join(strings[at : at + TOGETHER]) for at in range(0, len(plain), TOGETHER)], add_special_tokens=False)]
        bounds = np.cumsum([0, *map(len, found)])
        ids = np.fromiter(itertools.chain.from_iterable(found), "<u4", bounds[-1])
        starts = np.flatnonzero(self.begins[ids])
        held = np.diff(np.searchsorted(starts, bounds))  # beginnings found in each string, and how many there are
        asked = np.minimum(TOGETHER, len(plain) - TOGETHER * np.arange(len(found)))
        right, whole = np.repeat(held == asked, asked), np.repeat(held == asked, held)
        some, starts, ends = np.array(plain, np.int64)[right], starts[whole], np.append(starts, len(ids))[1:][whole]
        first, size = np.zeros(len(new), np.int64), np.full(len(new), -1)
        first[some], size[some] = starts + bare[right], ends - starts - bare[right]
        rest = np.flatnonzero(size < 0).tolist()
        singly = [np.array(e.ids, "<u4") for e in self.tok.encode_batch([texts[i] for i in rest], add_special_tokens=False)]
        size[rest] = [len(x) for x in singly]
        first[rest] = len(ids) + np.cumsum([0, *map(len, singly)])[:-1]
        self.first, self.size = np.append(self.first, len(self.ids) + first), np.append(self.size, size)
        self.ids = np.concatenate([self.ids, ids, *singly])


@kept
@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """A worker's encoder: what one task has learned serves the next."""
    return Encoder(path)


#: of a row of ``write_tokens``
WRITTEN = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("within", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary())])


def grouped(batches):
    """Arrow batches in tables of about GROUP bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored shards, in ascending id order: (part, seq, within, n_docs, n_ids, shard binary); ``within`` counts the ids of the part before the shard.

    Null texts are empty (only the end id). Null ids come first; repeated ids follow each other, ordered by text. Texts are encoded whole. An empty table gives no shard;
    other columns are not read.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 256)
    parts = partitions_for(docs, 16)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, ids = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("doc_id")).first()
    # ids are the key; only where many rows share one is a range cut by text too
    keys = ["doc_id"] if ids > n / 2 else ["doc_id", "text"]
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions("doc_id", "text")

    def run(batches):
        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        keys, lengths, ids, total, within = [], [], [], 0, 0

        def close():
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "within": [within], "n_docs": [len(keys)], "n_ids": [total], "shard": [write_shard(keys, lengths, np.concatenate(ids))]}, WRITTEN)

        for group in grouped(batches):
            texts = group["text"].combine_chunks().cast(pa.large_string())
            for at, some in chunks(group["doc_id"].to_pylist(), pc.binary_length(texts).to_pylist(), GROUP):
                found, ends = enc.encode_array(texts.slice(at, len(some)))
                found, last, done = np.insert(found, ends, end_id), 0, 0
                for key, end in zip(some, (ends + np.arange(1, len(some) + 1)).tolist(), strict=True):
                    keys.append(key)
                    lengths.append(end - last)
                    total += end - last
                    last = end
                    if total >= SHARD_IDS or len(keys) >= SHARD_DOCS:
                        ids.append(found[done:end])
                        yield close()
                        seq, within, done = seq + 1, within + total, end
                        keys, lengths, ids, total = [], [], [], 0
                ids.append(found[done:])
        if keys:
            yield close()

    return stash(ordered.mapInArrow(run, "part int, seq int, within long, n_docs long, n_ids long, shard binary"), "tokens")


def read_tokens(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian 32-bit ids).

    Empty files give no rows; null ids come first and stay null, repeated ids each have their row.
    """
    spark = shards.sparkSession
    arrow_rows(spark, 4)
    # one row for each partition of the writer, whatever the number of documents
    totals = sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["part"])
    base, at = {}, 0
    for r in totals:
        base[r["part"]] = at
        at += r["n"]
    def run(batches):
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                s = Shard(t.shard)
                ends = np.fromiter((s.ends.select(i) for i in range(s.n)), np.int64, s.n)  # each boundary by the select structure
                starts = np.concatenate(([0], ends[:-1]))
                wide = memoryview(s.ids.astype("<u4")).cast("B")
                yield pd.DataFrame({
                    "doc_id": pd.array(s.keys, dtype="Int64").copy() if not s.nulls.any() else pd.array([None if z else int(k) for k, z in zip(s.keys, s.nulls, strict=True)], dtype="Int64"),
                    "start": base[t.part] + int(t.within) + starts, "n_tokens": ends - starts,
                    "ids_crc32": np.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64),
                })

    return shards.select("part", "within", "shard").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir):
    import public_tokenizers

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))

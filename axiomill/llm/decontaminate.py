"""Benchmark decontamination with training suffix arrays.

Each shard of training documents gets a suffix array over its words. Every benchmark suffix is searched in it by
binary search; the ranges give all verbatim occurrences of each window with their places. Words are compared by hashes in the search and
byte by byte after it. Occurrences that follow each other on one diagonal of a document and an item are one match, which gives the longest
matches and their places. Suffixes of the shard that no benchmark suffix can match (other leading words) are left out
of the array before sorting, which changes no answer.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_rows, chunks, encoded, joined, release, table, word_hashes, words_of

#: bytes of documents in one suffix array; bytes of benchmark text that are broadcast at once (larger benchmarks go block by block)
SHARD_BYTES, BLOCK_BYTES = 2 << 20, 4 << 20

#: word bytes: everything but 00-2F, 3A-60, 7B-7F (after lower-casing); all bytes of non-ASCII characters
IS_WORD = np.ones(256, bool)
IS_WORD[0x00:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False


def hashed_words(text: np.ndarray):
    """Starts, ends and hashes of the words of a buffer, and the buffer in lower case."""
    low = LOWER[text]
    s, e = words_of(low, IS_WORD)
    return s, e, word_hashes(low, s, e), low


class TestSuffixes:
    """The benchmark's windows: word hashes once, windows as places in them. About 40 bytes for each word of the benchmark travel; the
    rows of ``size`` hashes that the search needs are laid out where they are used."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size = size
        self.names: list[str] = []  # an item of each text; texts with one item share its name
        texts = [encoded(t) for _, t in items]
        buf, starts = joined(texts, b"\x00")
        s, e, self.words, low = hashed_words(buf)
        self.low, self.s, self.e = low, s, e
        first = np.searchsorted(s, starts)
        self.base = first[:-1]  # each text's first word
        self.names = [i for i, _ in items]
        n = np.diff(first)
        count = np.where(n > 0, np.maximum(1, n - size + 1), 0)
        text = np.repeat(np.arange(len(items)), count)
        at = first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        lens = np.minimum(size, n[text])
        rows = self.laid_out(at, lens)
        key = np.concatenate([rows, lens[:, None].astype(np.uint64)], axis=1)
        key = np.ascontiguousarray(key).view([("", np.uint64)] * (size + 1)).ravel()
        _, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        # equal rows are one window; windows whose hashes agree but not their bytes would be kept apart here, and the search looks at bytes again
        self.at, self.lens = at[index], lens[index]
        order = np.lexsort((at, inverse))
        same = self.equal_bytes(at[order], self.at[inverse[order]], lens[order])
        if not same.all():
            raise ValueError("two windows of the benchmark have the same hashes but other words")
        self.place, self.place_text = at[order], text[order]
        self.upto = np.searchsorted(inverse[order], np.arange(len(index) + 1))
        self._rows = None

    def laid_out(self, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
        used = np.arange(self.size)[None, :] < lens[:, None]
        return np.where(used, self.words[np.minimum(at[:, None] + np.arange(self.size), max(0, len(self.words) - 1))], np.uint64(0)) if len(at) else np.zeros((0, self.size), np.uint64)

    def window(self, at: int, n: int) -> bytes:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.s[at : at + n].tolist(), self.e[at : at + n].tolist(), strict=True))

    def equal_bytes(self, a: np.ndarray, b: np.ndarray, lens: np.ndarray) -> np.ndarray:
        return np.array([x == y or self.window(x, n) == self.window(y, n) for x, y, n in zip(a.tolist(), b.tolist(), lens.tolist(), strict=True)], bool)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "heads", "second", "first")} | {"_rows": None}

    @property
    def rows(self) -> np.ndarray:
        """Each window's word hashes, and the filters on its first two words."""
        if self._rows is None:
            self._rows = self.laid_out(self.at, self.lens)
            self.heads = np.zeros(1 << 16, bool)
            self.heads[(self._rows[:, 0] & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.first = np.unique(self._rows[:, 0])
            two = self._rows[self.lens > 1]
            self.second = np.zeros(1 << 16, bool)
            self.second[(two[:, 1] & np.uint64(0xFFFF)).astype(np.int64)] = True
            if (self.lens == 1).any():
                self.second[:] = True
        return self._rows


def suffix_array(words: np.ndarray, ends: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes whose leading words the benchmark has, in order of their first ``size`` words; the words as rows.

    ``ends``: for each word the index after its document's last word; places past the end hold 0.
    """
    if not len(test.rows):
        return np.zeros(0, np.int64), np.zeros((0, test.size), np.uint64)
    at = np.flatnonzero(test.heads[(words & np.uint64(0xFFFF)).astype(np.int64)])
    nxt = words[np.minimum(at + 1, len(words) - 1)] if len(words) else words
    at = at[test.second[(nxt & np.uint64(0xFFFF)).astype(np.int64)]]
    if len(at):
        place = np.minimum(np.searchsorted(test.first, words[at]), len(test.first) - 1)
        at = at[test.first[place] == words[at]]
    rows = np.zeros((len(at), test.size), np.uint64)
    for j in range(test.size):
        inside = at + j < ends[at]
        rows[inside, j] = words[at[inside] + j]
    order = np.lexsort(rows.T[::-1])
    return at[order], rows[order]


def ranges(rows: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of every test suffix at once: its range [lo, hi) among the sorted rows."""
    n, m = len(rows), len(test.rows)
    used = np.arange(test.size)[None, :] < test.lens[:, None]

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            r = rows[np.minimum(mid, n - 1)]
            differ = (r != test.rows) & used
            at = differ.argmax(axis=1)
            rest = np.arange(m)
            less = (r[rest, at] < test.rows[rest, at]) & differ[rest, at]
            if upper:
                less |= ~differ.any(axis=1)
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    return (bound(False), bound(True)) if n else (np.zeros(m, np.int64), np.zeros(m, np.int64))


def search_shard(texts: list[bytes], test: TestSuffixes):
    """(words of each text; of every occurrence its text, word place and window)."""
    buf, starts = joined(texts, b"\x00")
    s, e, h, low = hashed_words(buf)
    first = np.searchsorted(s, starts)  # index of each document's first word; one more: the end
    counts = np.diff(first)
    ends = np.repeat(first[1:], counts)
    at, rows = suffix_array(h, ends, test)
    lo, hi = ranges(rows, test)
    found = np.flatnonzero(hi > lo)
    n = hi[found] - lo[found]
    which = np.repeat(found, n)
    pos = at[np.repeat(lo[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if len(found) else np.zeros(0, np.int64)
    # what the hashes found is read
    s_, e_ = s.tolist(), e.tolist()
    known: dict[int, bytes] = {}
    ok = np.ones(len(pos), bool)
    for i, (p, w) in enumerate(zip(pos.tolist(), which.tolist(), strict=True)):
        k = int(test.lens[w])
        if w not in known:
            known[w] = test.window(int(test.at[w]), k)
        ok[i] = b" ".join(low[s_[j] : e_[j]].tobytes() for j in range(p, p + k)) == known[w]
    pos, which = pos[ok], which[ok]
    doc = np.searchsorted(first, pos, side="right") - 1
    return counts, doc, pos - first[doc], which


def segments(text: bytes, most: int, size: int) -> list[tuple[bytes, int]]:
    """A very long text in parts of about ``most`` bytes that share ``size - 1`` words; each with its first word's index."""
    if len(text) <= 2 * most:
        return [(text, 0)]
    s, e = words_of(LOWER[np.frombuffer(text, np.uint8)], IS_WORD)
    out, w = [], 0
    while True:
        last = max(int(np.searchsorted(e, s[w] + most)), w + 2 * size) if len(s) else 0
        if last >= len(s):
            out.append((text[s[w] :] if len(s) else b"", w))
            return out
        out.append((text[s[w] : e[last - 1]], w))
        w = last - (size - 1)


def judge(texts: list[bytes], test: TestSuffixes) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(n_words, word places, windows) of each text: every occurrence once."""
    parts = [(i, t, w) for i, text in enumerate(texts) for t, w in segments(text, SHARD_BYTES, test.size)]
    words, found = [0] * len(texts), [[] for _ in texts]
    for _, group in chunks(parts, [len(p[1]) + 1 for p in parts], SHARD_BYTES):
        counts, doc, pos, which = search_shard([t for _, t, _ in group], test)
        cut = np.searchsorted(np.sort(doc, kind="stable"), np.arange(len(group) + 1))
        order = np.argsort(doc, kind="stable")
        for g, (i, _, w) in enumerate(group):
            words[i] = max(words[i], w + int(counts[g]))
            own = order[cut[g] : cut[g + 1]]
            if len(own):
                found[i].append(np.stack([pos[own] + w, which[own]], axis=1))
    none = np.zeros((0, 2), np.int64)
    out = []
    for n, own in zip(words, found, strict=True):
        both = np.unique(np.concatenate(own), axis=0) if own else none  # parts of a long text share words
        out.append((n, both[:, 0], both[:, 1]))
    return out


def hit_mask(n: int, pos: np.ndarray, which: np.ndarray, test: TestSuffixes) -> np.ndarray:
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, pos, 1)
    np.add.at(d, pos + test.lens[which], -1)
    return np.cumsum(d[:-1]) > 0


def items_of(which: np.ndarray, test: TestSuffixes) -> set[str]:
    return {test.names[t] for w in np.unique(which).tolist() for t in test.place_text[test.upto[w] : test.upto[w + 1]].tolist()}


def spans(pos: np.ndarray, which: np.ndarray, test: TestSuffixes) -> list[tuple[int, int, int, str]]:
    """Maximal matches (length in words, place in the document, place in the item, item): occurrences in a row on one diagonal."""
    if not len(pos):
        return []
    n = test.upto[which + 1] - test.upto[which]
    p = np.repeat(pos, n)
    k = np.repeat(test.upto[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place, length = test.place[k], np.repeat(test.lens[which], n)
    text = test.place_text[k]
    order = np.lexsort((p, p - place, text))
    p, place, text, length = p[order], place[order], text[order], length[order]
    new = np.ones(len(p), bool)
    new[1:] = (text[1:] != text[:-1]) | (p[1:] - place[1:] != p[:-1] - place[:-1]) | (p[1:] != p[:-1] + 1)
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(p)) - 1
    return [(int(p[b] + length[b] - p[a]), int(p[a]), int(place[a] - test.base[text[a]]), test.names[text[a]]) for a, b in zip(cut.tolist(), last.tolist(), strict=True)]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str):
    """The benchmark in blocks of at most about BLOCK_BYTES of text: one for a small one."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r["item"], r["text"]) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", places: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``places`` also longest (words of its longest verbatim
    match, 0 if none), longest_at (the match's first word) and longest_item: of equally long ones the first place, then the smaller item.

    A word is hit if it lies in a verbatim occurrence of a window of ``size`` words of an item (an item of fewer words is one window).
    Null texts and texts without words have none and are clean; null ids stay null; null items or items without words take no part; repeated rows are judged
    each; items with one id count once. Texts are searched whole; very long ones in overlapping parts. With no items nothing is hit; an empty
    table gives no rows. Other columns are not read.
    A benchmark beyond BLOCK_BYTES is searched block by block, the marks carried from pass to pass.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 1024)
    carried = "doc_id long, text string, hit binary, items array<string>, longest long, longest_at long, longest_item string"
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("hit", "binary"), ("items", "array<string>"), ("longest", "long"), ("longest_at", "long"), ("longest_item", "string"))))
    for items in blocks_of(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(TestSuffixes(items, size))

        def run(batches, shared=shared):
            release()
            test = shared.value
            for pdf in batches:
                rows = []
                for (n, pos, which), old, had, *best in zip(judge([encoded(t) for t in pdf["text"]], test), pdf["hit"], pdf["items"], pdf["longest"], pdf["longest_at"], pdf["longest_item"], strict=True):
                    mask = hit_mask(n, pos, which, test)
                    if old is not None:
                        mask = mask | np.unpackbits(np.frombuffer(old, np.uint8)[8:])[:n].astype(bool)
                    names = sorted(items_of(which, test) | set(had if had is not None else ()))
                    own = [(-k, at, item) for k, at, _, item in spans(pos, which, test)] + ([(-int(best[0]), int(best[1]), best[2])] if best[2] is not None else [])
                    k, at, item = min(own, default=(0, None, None))
                    rows.append((n.to_bytes(8, "little") + np.packbits(mask).tobytes(), names, -k, at, item))
                out = pd.DataFrame(rows, columns=["hit", "items", "longest", "longest_at", "longest_item"], index=pdf.index)
                out["longest_at"] = out["longest_at"].astype("Int64")
                yield pdf[["doc_id", "text"]].join(out)

        df = df.mapInPandas(run, carried)

    def finish(batches):
        for pdf in batches:
            n = [int.from_bytes(h[:8], "little") for h in pdf["hit"]]
            k = [int(np.unpackbits(np.frombuffer(h, np.uint8)[8:]).sum()) for h in pdf["hit"]]
            out = pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_words": n, "n_hit": k, "n_items": [len(x) for x in pdf["items"]],
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in pdf["items"]], "contaminated": [x > 0 for x in k],
            })
            yield out.join(pdf[["longest", "longest_at", "longest_item"]]) if places else out

    return df.mapInPandas(finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", longest long, longest_at long, longest_item string" * places)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that share no window of ``size`` words (or whole shorter item) with the benchmark; all their columns. Null and empty
    texts stay, as does everything if there are no items; repeated rows are judged each."""
    spark = docs.sparkSession
    arrow_rows(spark, 1024)
    for items in blocks_of(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(TestSuffixes(items, size))

        def run(batches, shared=shared):
            release()
            test = shared.value
            for pdf in batches:
                yield pdf.loc[[not len(pos) for _, pos, _ in judge([encoded(t) for t in pdf[text_col]], test)]]

        docs = docs.mapInPandas(run, docs.schema)
    return docs


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The maximal verbatim matches of at least a window: doc_id, item_id, word (place in the document), item_word (place in the item), length in words."""
    spark = docs.sparkSession
    arrow_rows(spark, 1024)
    out = None
    for items in blocks_of(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(TestSuffixes(items, size))

        def run(batches, shared=shared):
            release()
            test = shared.value
            for pdf in batches:
                rows = [(d, item, at, to, k) for d, (_, pos, which) in zip(pdf["doc_id"], judge([encoded(t) for t in pdf["text"]], test), strict=True) for k, at, to, item in spans(pos, which, test)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "word", "item_word", "length"])

        one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, item_id string, word long, item_word long, length long")
        out = one if out is None else out.unionByName(one)
    return out


def query(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM wins
), occ AS (
  SELECT d.doc_id, i, sizes.n, array_to_string(w[i : i + sizes.n - 1], ' ') AS win FROM dw d, sizes, unnest(range(1, len(w) - sizes.n + 2)) AS t(i)
), found AS (
  SELECT o.doc_id, o.i, o.n, x.item_id FROM occ o JOIN wins x ON o.win = x.win AND o.n = x.n
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits ON dw.doc_id = hits.doc_id LEFT JOIN own ON dw.doc_id = own.doc_id
"""

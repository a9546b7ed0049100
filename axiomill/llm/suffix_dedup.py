"""Suffix-array deduplication of repeated byte strings.

A byte is removed if some string of ``width`` bytes over it also starts earlier. Sorting every suffix would send its text
``width`` times over, so the array is sparse: suffixes are taken where a local rule on their leading bytes (the leftmost least hash of
``LEAD`` bytes among a window's) selects them, so that equal windows select the same place. Every window then belongs to one selected suffix; windows
with one suffix are a run.

1. The selected suffixes are range-partitioned by their leading text with sampled splitters; each bucket is sorted by multikey quicksort, eight
   bytes of text at a time, then by what follows (a 64-bit hash of the run's whole text) and place, and neighbours are compared; the last suffix of a bucket
   is compared with the first of the next. A suffix that more buckets share is thus no harm, and a hot one is cut where the splitters fall. A run
   whose text came earlier is repeated entirely. A suffix whose leading bytes stand before one text only is not repeated otherwise.
2. What is left - the first run of each text among several that share leading bytes, as at the ends of a
   repeated passage - is sent with its text: as suffixes again, from the selected place (for windows that reach further right of it) or from half
   a window before it (for the others), range-partitioned and sorted by about two thirds of ``width`` bytes of text. Windows are compared byte by byte there.

Tasks drop repeats of their own before they send anything, so a passage that a third of all rows share is sent
once by a task.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, arrow_rows, encoded, input_bytes, packed, partitions_for, release, stash, table, unpacked

#: what is known of a run: its windows all came earlier; they are to be compared one by one; it waits for the buckets beside
REPEATED, OPEN, HEAD_FIRST, HEAD, TAIL = 1, 2, 3, 4, 5
#: leading bytes of a suffix that select and partition it
LEAD = 32
#: bytes of text worked on at once; documents in the sample of splitters
PIECE_BYTES, SPLIT_DOCS = 1 << 20, 400
#: bytes of open runs gathered before they are sent
PACK_BYTES = 8 << 20
#: a run: its suffix's leading bytes as four numbers in text order, its text's hash, document, part, first window, windows, and the suffix's place after it
TEXT = ("t0", "t1", "t2", "t3")
RUN = np.dtype([*((t, "<u8") for t in TEXT), ("eh", "<u8"), ("doc", "<i8"), ("part", "<u4"), ("s", "<u4"), ("n", "<u2"), ("q", "<u2")])
MARK = np.dtype([("doc", "<i8"), ("s", "<u4"), ("n", "<u2"), ("q", "<u2"), ("kind", "u1")])


def selected(buf: np.ndarray, n_windows: int, width: int):
    """Runs of windows with one selected suffix: (first window, windows, place of the suffix), and the prefix hash."""
    p, lead = Prefix(buf), min(LEAD, max(1, width // 3))
    at = np.arange(len(buf) - lead + 1)
    h = p.of(at, at + lead)
    span = width - lead + 1
    val, pos = h.copy(), at.astype(np.int32)
    size = 1
    while size < span:  # leftmost least by doubling
        step = min(size, span - size)
        a, b = val[:-step], val[step:]
        less = b < a
        pos = np.where(less, pos[step:], pos[:-step])
        val = np.where(less, b, a)
        size += step
    pos = pos[:n_windows]
    cut = np.flatnonzero(np.diff(pos, prepend=-1))
    n = np.diff(np.append(cut, n_windows))
    return cut, n, pos[cut].astype(np.int64), p


def pieces(text: bytes, width: int):
    """(offset, bytes) of parts with all windows of a text between them: parts overlap by width - 1 bytes."""
    if len(text) >= width:
        for at in range(0, len(text) - width + 1, PIECE_BYTES):
            yield at, text[at : at + PIECE_BYTES + width - 1]


def groups(docs, width: int):
    """Pieces of several documents gathered into buffers of about PIECE_BYTES: lists of (doc, offset, bytes)."""
    out, total = [], 0
    for doc, text in docs:
        for at, part in pieces(text, width):
            if out and total + len(part) > PIECE_BYTES + width:
                yield out
                out, total = [], 0
            out.append((doc, at, part))
            total += len(part)
    if out:
        yield out


def leading(buf: np.ndarray, at: np.ndarray, lead: int) -> np.ndarray:
    """The leading bytes of suffixes as four numbers each that sort as the text does (unused bytes are zero)."""
    rows = np.zeros((len(at), LEAD), np.uint8)
    rows[:, :lead] = buf[at[:, None] + np.arange(lead)]
    return rows.view(">u8").astype(np.uint64)


def sort_key(rec: np.ndarray) -> np.ndarray:
    """Bytes that sort as runs do: leading text, text hash, document, place."""
    cols = [*(rec[t] for t in TEXT), rec["eh"], rec["doc"].astype(np.uint64) ^ np.uint64(1 << 63), rec["s"].astype(np.uint64)]
    return np.ascontiguousarray(np.stack([c.astype(">u8") for c in cols], axis=1)).view("S56").ravel()


def run_order(rec: np.ndarray) -> np.ndarray:
    return multikey_order(*(rec[t] for t in TEXT), rec["eh"], rec["doc"], rec["s"])


def runs_of(group, width: int) -> np.ndarray:
    """Runs of a buffer as RUN records (part left 0)."""
    buf = np.frombuffer(b"".join(b for _, _, b in group), np.uint8)
    ends = np.cumsum([len(b) for _, _, b in group])
    cut, n, pos, p = selected(buf, len(buf) - width + 1, width)
    # windows that run over the end of a document's piece do not count: cut runs at each piece's last window
    starts = np.concatenate(([0], ends[:-1]))
    own = np.searchsorted(ends, cut, side="right")
    first, last = cut, cut + n  # [first, last) of each run; runs may span pieces
    out_f, out_l, out_p, out_d = [], [], [], []
    over = np.searchsorted(ends, last - 1, side="right")
    one = own == over
    lim = ends - width + 1
    out_f.append(first[one]); out_l.append(np.minimum(last[one], lim[own[one]])); out_p.append(pos[one]); out_d.append(own[one])  # noqa: E702
    for i in np.flatnonzero(~one):
        for d in range(own[i], over[i] + 1):
            out_f.append([max(first[i], starts[d])]); out_l.append([min(last[i], lim[d])]); out_p.append([pos[i]]); out_d.append([d])  # noqa: E702
    f, l, q, d = (np.concatenate(x).astype(np.int64) for x in (out_f, out_l, out_p, out_d))  # noqa: E741
    ok = l > f
    f, l, q, d = f[ok], l[ok], q[ok], d[ok]  # noqa: E741
    rec = np.zeros(len(f), RUN)
    for t, c in zip(TEXT, leading(buf, q, min(LEAD, max(1, width // 3))).T, strict=True):
        rec[t] = c
    rec["eh"], rec["q"] = p.of(f, l + width - 1), q - f
    docs, offs = np.array([x[0] for x in group], np.int64), np.array([x[1] for x in group], np.int64)
    rec["doc"], rec["s"], rec["n"] = docs[d], f - starts[d] + offs[d], l - f
    return rec


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """Multikey sort: by the first key, then only within groups of equal keys by the next."""
    order = np.argsort(keys[0], kind="stable")
    for depth in range(1, len(keys)):
        same = np.ones(len(order), bool)
        for k in keys[:depth]:
            v = k[order]
            same[1:] &= v[1:] == v[:-1]
        same[:1] = False
        open_ = same.copy()
        open_[:-1] |= same[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        group = np.cumsum(~same)[at]
        order[at] = order[at][np.lexsort((keys[depth][order[at]], group))]
    return order


def decide(rec: np.ndarray):
    """Kind of each run of a bucket, and what its neighbours need to know: (first leading text, text hash, texts), the same of the last, one group only.

    Runs of the first and of the last leading text wait for the buckets beside: HEAD_FIRST, HEAD and TAIL are settled by ``settled``.
    """
    order = run_order(rec)
    r = rec[order]
    new_k = np.ones(len(r), bool)
    new_k[1:] = np.logical_or.reduce([r[t][1:] != r[t][:-1] for t in TEXT])
    new_e = new_k.copy()
    new_e[1:] |= r["eh"][1:] != r["eh"][:-1]
    group = np.cumsum(new_k) - 1
    texts = np.bincount(group, weights=new_e).astype(np.int64)
    kind = np.where(new_e, np.where(texts[group] > 1, OPEN, 0), REPEATED).astype(np.uint8)
    kind[new_e & (group == group[-1])] = TAIL
    kind[new_e & (group == 0)] = HEAD
    kind[0] = HEAD_FIRST
    out = np.zeros(len(r), np.uint8)
    out[order] = kind
    ends = [b"".join(int(r[t][i]).to_bytes(8, "big") for t in TEXT) + int(r["eh"][i]).to_bytes(8, "big") for i in (0, -1)]
    return out, (ends[0], int(texts[0]), ends[1], int(texts[-1]), bool(group[-1] == 0))


def settled(borders: dict[int, tuple]) -> dict[int, tuple[int, int, int]]:
    """For each bucket the kinds that HEAD_FIRST, HEAD and TAIL stand for, from what the buckets beside it begin and end with."""
    kinds: dict[int, list[int]] = {b: [0, 0, 0] for b in borders}
    chain: list[tuple[int, int]] = []  # (bucket, 0 head or 1 tail) of one leading text across buckets
    texts, last = 0, None

    def close():
        if texts > 1:
            for b, side in chain:
                if side:
                    kinds[b][2] = OPEN
                else:
                    kinds[b][1] = OPEN
                    kinds[b][0] = kinds[b][0] or OPEN

    for b in sorted(borders):
        first, n_first, end, n_last, alone = borders[b]
        again = last == first  # the same leading text and the same run: the first here repeats it
        if last is not None and last[:LEAD] == first[:LEAD]:
            texts += n_first - again
        else:
            close()
            chain, texts = [], n_first
        if again:
            kinds[b][0] = REPEATED
        chain.append((b, 0))
        if not alone:
            close()
            chain, texts = [(b, 1)], n_last
        last = end
    close()
    return {b: tuple(k) for b, k in kinds.items()}


def marks_of(rec: np.ndarray, flag: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(int(flag.sum()), MARK)
    for k in ("doc", "s", "n", "q"):
        out[k] = rec[k][flag]
    out["kind"] = kind
    return out, rec["part"][flag]


def by_part(marks: np.ndarray, part: np.ndarray):
    """Rows (part, payload) with the marks of each part of the documents."""
    order = np.argsort(part, kind="stable")
    marks, part = marks[order], part[order]
    cut = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1)).tolist()
    for a, b in zip(cut, [*cut[1:], len(part)], strict=False):
        yield int(part[a]), packed(marks[a:b])


def covered(n: int, marks: np.ndarray, width: int) -> np.ndarray:
    """Byte mask of a text of n bytes: under a marked window."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, marks["s"].astype(np.int64), 1)
    np.add.at(d, marks["s"].astype(np.int64) + marks["n"] + width - 1, -1)
    return np.cumsum(d[:n]) > 0


class Plan:
    """Sizes: parts of the documents, tasks, buckets; and the sampled splitters of the buckets."""

    def __init__(self, docs: DataFrame, width: int):
        spark = docs.sparkSession
        size = input_bytes(docs)
        self.tasks = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, math.ceil(size / (12 << 20)))))
        self.parts = self.buckets = self.tasks
        n = max(1, docs.count())
        arrow_rows(spark, 256)

        def sample(batches):
            r = np.random.default_rng(1)
            for pdf in batches:
                for g in groups(zip(pdf["doc_id"].tolist(), map(encoded, pdf["text"]), strict=True), width):
                    rec = runs_of(g, width)
                    keys = sort_key(rec[r.choice(len(rec), min(len(rec), 64 * len(g)), replace=False)])
                    yield pd.DataFrame({"k": [k.ljust(56, b"\x00") for k in keys.tolist()]})

        some = docs.select("doc_id", "text").sample(False, min(1.0, SPLIT_DOCS / n), 3).limit(2 * SPLIT_DOCS)
        keys = np.sort(np.array([bytes(r["k"]) for r in some.mapInPandas(sample, "k binary").collect()], "S56"))
        at = (np.arange(1, self.buckets) * len(keys)) // self.buckets
        self.splitters = keys[at] if len(keys) else np.zeros(0, "S56")


def run_marks(docs: DataFrame, width: int, plan: Plan) -> DataFrame:
    """(part, payload of MARK): repeated and open runs of documents (doc_id, part, text)."""
    spark = docs.sparkSession
    splitters = spark.sparkContext.broadcast(plan.splitters)
    buckets = plan.buckets

    def send(batches):
        """Runs of each batch, packed by bucket; what repeats within the batch is decided here and forwarded."""
        release()
        for pdf in batches:
            part_of = dict(zip(pdf["doc_id"].tolist(), pdf["part"].tolist(), strict=True))
            for g in groups(zip(pdf["doc_id"].tolist(), map(encoded, pdf["text"]), strict=True), width):
                rec = runs_of(g, width)
                if not len(rec):
                    continue
                rec["part"] = [part_of[d] for d in rec["doc"].tolist()] if len(g) > 1 else part_of[g[0][0]]
                rows = []
                order = run_order(rec)
                r = rec[order]
                again = np.zeros(len(r), bool)
                again[1:] = np.logical_and.reduce([r[t][1:] == r[t][:-1] for t in (*TEXT, "eh")])
                rows += [(p % buckets, p, m) for p, m in by_part(*marks_of(r, again, REPEATED))]
                stay = np.zeros(len(rec), bool)
                stay[order[~again]] = True
                keep = rec[stay]  # in document order, which compresses
                b = np.searchsorted(splitters.value, sort_key(keep), side="right")
                o = np.argsort(b, kind="stable")
                keep, b = keep[o], b[o]
                cut = np.flatnonzero(np.diff(b, prepend=-1))
                rows += [(int(b[x]), -1, packed(keep[x:y])) for x, y in zip(cut, np.append(cut[1:], len(b)), strict=True)]
                yield pd.DataFrame(rows, columns=["bucket", "part", "payload"])

    def sort_buckets(batches):
        """Rows come ordered by bucket; one bucket is held at a time. What waits goes out in rows that name the bucket, the bucket's ends with part -1."""
        at, held = None, []

        def flush():
            rec = unpacked(held, RUN)
            kind, ends = decide(rec)
            sure, wait = (kind == REPEATED) | (kind == OPEN), kind > OPEN
            rows = [(-1, *x) for x in by_part(*marks_of(rec, sure, kind[sure]))] + [(at, *x) for x in by_part(*marks_of(rec, wait, kind[wait]))]
            rows.append((at, -1, pickle.dumps(ends)))
            return pd.DataFrame(rows, columns=["wait", "part", "payload"])

        for pdf in batches:
            done = pdf["part"] >= 0
            if done.any():
                yield pdf.loc[done, ["part", "payload"]].assign(wait=-1)[["wait", "part", "payload"]]
            pdf = pdf[~done]
            for b, payload in zip(pdf["bucket"].tolist(), pdf["payload"], strict=True):
                if b != at and held:
                    yield flush()
                    held = []
                at = b
                held.append(payload)
        if held:
            yield flush()

    sent = docs.mapInPandas(send, "bucket int, part int, payload binary")
    sorted_ = stash(sent.repartition(plan.tasks, "bucket").sortWithinPartitions("bucket").mapInPandas(sort_buckets, "wait int, part int, payload binary"), "marks", free=True)
    # two ends for each bucket, whatever the number of documents
    kinds = spark.sparkContext.broadcast(settled({r["wait"]: pickle.loads(r["payload"]) for r in sorted_.where("part = -1").collect()}))

    def settle(batches):
        for pdf in batches:
            rows = []
            for wait, part, payload in zip(pdf["wait"].tolist(), pdf["part"].tolist(), pdf["payload"], strict=True):
                if wait >= 0:
                    m = unpacked([payload], MARK)
                    m["kind"] = np.array([0, 0, 0, *kinds.value[wait]], np.uint8)[m["kind"]]
                    m = m[m["kind"] > 0]
                    if not len(m):
                        continue
                    payload = packed(m)
                rows.append((part, payload))
            yield pd.DataFrame(rows, columns=["part", "payload"])

    return sorted_.where("part >= 0").mapInPandas(settle, "part int, payload binary")


def beside(docs: DataFrame, marks: DataFrame, plan: Plan) -> DataFrame:
    """Documents and the marks of their part in one partition, marks first: (part, payload, doc_id, text)."""
    rows = docs.select("part", F.lit(None).cast("binary").alias("payload"), "doc_id", "text").unionByName(marks.select("part", "payload", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    return rows.repartition(plan.tasks, "part").sortWithinPartitions("part", F.col("payload").isNull())


def with_marks(batches):
    """Yields (part, doc_id, text, marks of the document by start) from rows ordered as ``beside`` leaves them."""
    at, held, own = None, [], {}
    for pdf in batches:
        for part, payload, doc, text in zip(pdf["part"].tolist(), pdf["payload"], pdf["doc_id"], pdf["text"], strict=True):
            if part != at:
                at, held, own = part, [], None
            if payload is not None:
                held.append(payload)
                continue
            if own is None:
                m = unpacked(held, MARK)
                m = m[np.argsort(m["doc"], kind="stable")]
                cut = np.flatnonzero(np.diff(m["doc"], prepend=m["doc"][0] - 1)).tolist() if len(m) else []
                own = {int(m["doc"][a]): m[a:b] for a, b in zip(cut, [*cut[1:], len(m)], strict=False)}
                held = []
            yield part, int(doc), text, own.get(int(doc))


def halves(b: bytes, s: int, n: int, q: int, width: int):
    """The windows [s, s + n) around the selected place q as at most two suffixes: (text of the windows, where the suffix begins in it, its length, first window, windows)."""
    lead = min(LEAD, max(1, width // 3))
    half = (width - lead) // 2
    cut = max(s, min(s + n, q - half + 1))  # windows from here on reach less than half bytes left of q
    if cut > s:
        yield b[s : cut + width - 1], q - half - s, half + lead, s, cut - s
    if cut < s + n:
        yield b[cut : s + n + width - 1], q - cut, width - half + 1, cut, s + n - cut


def window_marks(docs: DataFrame, marks: DataFrame, width: int, plan: Plan) -> DataFrame:
    """Windows of the open runs that start earlier too, as marks (part, payload)."""

    def suffixes(batches):
        """Open runs with their text; of those with one text the first of a batch goes out, the others are known to be repeated."""
        out, total = [], 0

        def pack():
            out.sort(key=lambda r: (r[3], r[5]))
            first: set = set()
            rows, again, parts = [], [], []
            for text, at, size, doc, part, s, n in out:
                if (text, at, size) in first:
                    again.append((doc, s, n, 0, REPEATED))
                    parts.append(part)
                else:
                    first.add((text, at, size))
                    rows.append((text, at, size, doc, part, s, n, None))
            rows += [(None, None, None, None, p, None, None, payload) for p, payload in by_part(np.array(again, MARK), np.array(parts, np.int64))] if again else []
            return pd.DataFrame(rows, columns=["text", "at", "size", "doc", "part", "s", "n", "payload"]).astype({"at": "Int32", "size": "Int32", "doc": "Int64", "s": "Int64", "n": "Int32"})

        for part, doc, text, m in with_marks(batches):
            m = m[m["kind"] == OPEN] if m is not None else ()
            if not len(m):
                continue
            b = encoded(text)
            for s, n, q in zip(m["s"].tolist(), m["n"].tolist(), m["q"].tolist(), strict=True):
                for t, at, size, first, k in halves(b, s, n, s + q, width):
                    out.append((t, at, size, doc, part, first, k))
                    total += len(t) + 64
            if total > PACK_BYTES:
                yield pack()
                out, total = [], 0
        if out:
            yield pack()

    def compare(batches):
        """Rows come ordered by leading text, document and place: a window that was seen before under this text is repeated. One leading text is held at a time."""
        key, seen, found, parts = None, set(), [], []

        def flush():
            rows = list(by_part(np.array(found, MARK), np.array(parts, np.int64)))
            return pd.DataFrame(rows, columns=["part", "payload"])

        for pdf in batches:
            for text, lead, doc, part, s, n in zip(pdf["text"], pdf["lead"], pdf["doc"].tolist(), pdf["part"].tolist(), pdf["s"].tolist(), pdf["n"].tolist(), strict=True):
                if lead != key:
                    key, seen = lead, set()
                since = None
                for i in range(n + 1):
                    again = False
                    if i < n:
                        w = text[i : i + width]
                        again = w in seen
                        if not again:
                            seen.add(w)
                    if again and since is None:
                        since = i
                    elif not again and since is not None:
                        found.append((doc, s + since, i - since, 0, REPEATED))
                        parts.append(part)
                        since = None
            if len(found) > 100_000:
                yield flush()
                found, parts = [], []
        if found:
            yield flush()

    shape = "text binary, at int, size int, doc long, part int, s long, n int, payload binary"
    sent = stash(beside(docs, marks, plan).mapInPandas(suffixes, shape), "suffixes", free=True)
    rows = sent.where("payload is null").select("text", "doc", "part", "s", "n", F.expr("substring(text, at + 1, size)").alias("lead"))
    placed = rows.repartitionByRange(plan.tasks, "lead").sortWithinPartitions("lead", "doc", "s")
    return placed.mapInPandas(compare, "part int, payload binary").unionByName(sent.where("payload is not null").select("part", "payload"))


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with keep_text the remaining text, and the columns in
    ``keep``, whose names must differ from these).

    Every byte under a ``width``-byte string that also starts earlier (smaller id, or the same document further left) goes; strings are judged on
    the input. An empty table gives no rows. Null texts are empty; texts under ``width`` bytes lose nothing; rows with one id are one document's rivals in an order by
    text, so repeated rows keep one copy; rows with a null id come before all others. Remaining bytes that no
    longer form UTF-8 (a character cut in two) are dropped from the kept text, not from its digest.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("real"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep)).alias("kept"))
    n, ids = base.agg(F.count(F.lit(1)), F.count("real")).first()
    unique = n == ids and base.groupBy("real").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() == 0
    if unique:
        keyed = base.withColumn("key", F.col("real"))
    else:  # a key in the order of ids, then texts
        keyed = stash(base.repartitionByRange(partitions_for(base, 12), "real", "text").sortWithinPartitions("real", "text").withColumn("key", F.monotonically_increasing_id()), "keyed")
    plan = Plan(keyed.select(F.col("key").alias("doc_id"), "text"), width)
    keyed = keyed.select(F.col("key").alias("doc_id"), F.pmod(F.xxhash64("key"), F.lit(plan.parts)).cast("int").alias("part"), "text", "real", "kept")
    body = keyed.select("doc_id", "part", "text")
    arrow_rows(spark, 512)
    marks = run_marks(body, width, plan)
    fine = stash(window_marks(body, marks, width, plan), "fine", free=True)
    whole = beside(body, marks.unionByName(fine), plan)

    def finish(batches):
        rows = []
        for _, doc, text, m in with_marks(batches):
            b = encoded(text)
            m = m[m["kind"] == REPEATED] if m is not None else ()
            if len(m):
                gone = covered(len(b), m, width)
                kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            else:
                kept, spans = b, 0
            rows.append((doc, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None))
            if len(rows) >= 256:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    out = whole.mapInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    if not unique or keep:  # the key is unique
        out = out.join(keyed.select("doc_id", "real", "kept"), "doc_id").drop("doc_id").withColumnRenamed("real", "doc_id")
    return out.select(*names[:5], *(["text"] if keep_text else []), *(F.col(f"kept.`{c}`") for c in keep))



def query(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT doc_id, i, hash(substr(x, 2 * i + 1, 200)) AS h, hash(substr(x, 2 * i + 1, 200) || '#') AS g FROM b, unnest(range(0, n - 99)) AS u(i) WHERE n >= 100
), r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h, g ORDER BY doc_id, i) AS k FROM w
), d AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r WHERE k > 1
), s AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sid FROM d
), spans AS (SELECT doc_id, sid, min(i) AS a, max(i) + 100 AS z FROM s GROUP BY doc_id, sid
), gaps AS (
  SELECT doc_id, a AS upto, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, z FROM spans
), kept AS (
  SELECT b.doc_id, string_agg(substr(x, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since) || substr(any_value(x), 2 * max(z) + 1) AS k, sum(z - upto) AS removed, count(*) AS n_spans
  FROM b JOIN gaps ON b.doc_id = gaps.doc_id GROUP BY b.doc_id
)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN kept.doc_id IS NULL THEN t ELSE unhex(k) END) AS kept_sha256
FROM b LEFT JOIN kept ON b.doc_id = kept.doc_id
"""

"""MinHash near-duplicates by tensored banding, with every link confirmed on whole sets.

Two small collections of half-keys (each of ``ROWS`` minhashes) form SIDE x SIDE table keys by pairing: 2 * SIDE * ROWS minhashes
serve SIDE**2 tables of 2 * ROWS rows. Texts with equal shingle sets are one class from the start.
Classes that share a table key are candidates. They are compared with one pivot of their bucket
at a time - never all pairs of a bucket - and only while their bucket holds several components; what is left after the pivots
is compared across components only, through an exact prefix filter and a bound from bitmaps: first with a few texts of each
component that have least of their own, then, where that joined nothing, with all. Between rounds labels grow by one step over the new links (they may
stay finer than the components, which costs comparisons, never links); components are computed once, at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import LOWER, arrow_rows, chunks, encoded, joined, mix, release, stash, table, trim, word_hashes, words_of

SHINGLE, SIDE, ROWS = 5, 12, 2
#: rounds of pivots before the exact comparison of what is left; texts of a component that stand for it at first; bytes of text hashed at once
PIVOTS, CENTRAL, CHUNK = 2, 16, 1 << 19
#: bits of a set's bitmap
BITS = 512
#: pairs of one pivot that meet its set in one place; a pivot with more is dealt over several
HUB = 512
IS_WORD = np.ones(256, bool)
IS_WORD[0x20] = IS_WORD[0x09:0x0E] = False
_r = np.random.default_rng(77)
MUL = _r.integers(1, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _r.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``size`` words, or the whole sequence if shorter."""
    buf, starts = joined(texts, b" ")
    low = LOWER[buf]
    s, e = words_of(low, IS_WORD)
    h = word_hashes(low, s, e)
    first = np.searchsorted(s, starts)
    n = len(h)
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            key[: max(0, n - j)] += mix(h[j:] + np.uint64(j + 1)) if j < n else np.uint64(0)
        key = mix(key)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(key[a : b - size + 1]))
            elif b > a:
                out.append(np.array([mix(np.array([sum(int(x) * (2 * j + 3) for j, x in enumerate(mix(h[a:b]).tolist())) % 2**64], np.uint64) + np.uint64(b - a))[0]], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Half-keys of non-empty sets: len(sets) x 2*SIDE."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1]))
    with np.errstate(over="ignore"):
        m = np.stack([np.minimum.reduceat(flat * MUL[i] + ADD[i], at) for i in range(len(MUL))], axis=1).reshape(len(sets), 2 * SIDE, ROWS)
        out = m[:, :, 0]
        for r in range(1, ROWS):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a = mix(s * np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64) + np.uint64(len(s))
        b = mix(s ^ np.uint64(0x8BB84B93962EACC9)).sum(dtype=np.uint64)
    return int(np.int64(np.uint64(a).view(np.int64))), int(np.uint64(b).view(np.int64))


def bitmap(s: np.ndarray) -> np.ndarray:
    """Of each of BITS residues whether an odd number of hashes has it. Bitmaps differ in no more places than their sets."""
    return np.packbits((np.bincount((mix(s) >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, halves array<long>)."""

    def run(batches):
        release()
        for pdf in batches:
            texts, ids = [encoded(t) for t in pdf["text"]], pdf["doc_id"]
            for at, part in chunks(texts, [len(t) + 1 for t in texts], CHUNK):
                sets = shingle_sets(part)
                full = [i for i, s in enumerate(sets) if len(s)]
                halves = half_keys([sets[i] for i in full]).view(np.int64) if full else np.zeros((0, 2 * SIDE), np.int64)
                prints = [fingerprint(s) if len(s) else (0, 0) for s in sets]
                rows = [None] * len(sets)
                for i, h in zip(full, halves, strict=True):
                    rows[i] = h
                yield pd.DataFrame({"doc_id": ids.iloc[at : at + len(part)].array, "n_shingles": [len(s) for s in sets], "f1": [p[0] for p in prints], "f2": [p[1] for p in prints], "halves": rows})
        trim()

    return docs.mapInPandas(run, "doc_id long, n_shingles long, f1 long, f2 long, halves array<long>")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def dealt(pairs: DataFrame, hubs: DataFrame, side: str) -> DataFrame:
    """Pairs with the place (at_v or at_p) where they meet the set of that side, chosen by the other side."""
    place = F.pmod(F.xxhash64("p" if side == "v" else "v"), F.col("deal"))
    return pairs.join(hubs, side, "left").withColumn(f"at_{side}", F.coalesce(place, F.lit(0)).cast("int")).drop("deal")


def with_set(pairs: DataFrame, sets: DataFrame, hubs: DataFrame, side: str) -> DataFrame:
    """Pairs with the whole set of one side. Only the sets of hubs are copied to further places."""
    own = sets.select("v", F.lit(0).alias("at"), "n", "s")
    more = sets.join(hubs.withColumnRenamed(side, "v"), "v").select("v", F.explode(F.sequence(F.lit(1), F.col("deal") - 1)).alias("at"), "n", "s")
    own = own.unionByName(more).select(F.col("v").alias(side), F.col("at").alias(f"at_{side}"), F.col("n").alias(f"n{side}"), F.col("s").alias(f"s{side}"))
    return pairs.join(own, [side, f"at_{side}"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, once: bool = False) -> DataFrame:
    """The pairs (v, p, c, d), d and c labels, whose whole sets are similar enough; ``pairs`` is stored, since it is read several times.
    A side in many pairs has its set dealt over several places. ``once``: every v is in one pair, so its set needs no dealing."""

    def run(batches):
        for pdf in batches:
            ok = [linked(x, y, percent) for x, y in zip(pdf["sv"], pdf["sp"], strict=True)]
            yield pdf.loc[ok, ["v", "p", "c", "d"]]

    hubs = {x: pairs.groupBy(x).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HUB).select(x, F.ceil(F.col("k") / HUB).cast("int").alias("deal")) for x in ("v", "p")}
    y = dealt(pairs, hubs["p"], "p")
    if once:
        y = y.join(sets.select("v", F.col("n").alias("nv"), F.col("s").alias("sv")), "v")
    else:
        y = with_set(dealt(y, hubs["v"], "v"), sets, hubs["v"], "v")
    y = with_set(y, sets, hubs["p"], "p")
    y = y.where(F.least("nv", "np") * 100 >= F.greatest("nv", "np") * percent)
    return y.select("v", "p", "c", "d", "sv", "sp").mapInPandas(run, "v long, p long, c long, d long")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (v, c) after two steps to the smallest over linked labels: enough for stars, and never joins what is not linked."""
    e = links.select("c", "d").where("c <> d")
    e = e.unionByName(e.select(F.col("d").alias("c"), F.col("c").alias("d")))
    one = e.groupBy("c").agg(F.min("d").alias("m")).select("c", F.least("c", "m").alias("m"))
    two = e.join(one.select(F.col("c").alias("d"), "m"), "d").groupBy("c").agg(F.min("m").alias("m"))
    return labels.join(two, "c", "left").select("v", F.least("c", F.coalesce("m", "c")).alias("c"))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept (doc_id = component_id).

    Links: 100 * intersection >= percent * union of distinct 5-word shingle sets (a shorter text is one shingle). Null and empty texts
    and texts without words have an empty set and no links. Rows with one id are one document with several texts; a null id links
    with nothing (component null, kept). An empty table gives no rows. Whole texts are used.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 128)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = stash(signatures(base), "signatures")
    # texts with one set are one class, named by its smallest id
    cls = sig.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("v"), F.max("n_shingles").alias("n"), F.first("halves").alias("halves"))
    cls = stash(cls, "classes")
    buckets = stash(centred(tables(cls)), "tables")
    # one representative text for each class that has a candidate
    wanted = buckets.select("v").distinct().join(cls.select("v", "f1", "f2", "n"), "v")
    sets = stash(candidate_sets(base, wanted, sig), "sets")
    labels = sets.select("v", F.col("v").alias("c")).distinct()
    links = None
    for r in range(PIVOTS + 2):
        if r == PIVOTS:
            prefix = stash(prefixes(mixed_buckets(buckets, labels), sets, percent), "prefixes")
        pairs = stash(pivot_pairs(buckets, labels, r) if r < PIVOTS else rest_pairs(prefix, labels, percent, central=r == PIVOTS), "pairs", small=True)
        if pairs.isEmpty():
            continue  # these pivots have nothing new; the exact round decides
        found = stash(confirm(pairs, sets, percent, once=r < PIVOTS), "links", small=True)
        links = found if links is None else links.unionByName(found)
        if r <= PIVOTS:
            labels = stash(relabelled(labels, found), "labels", small=True)
    if links is not None:
        # what the steps have not joined yet: links between different labels
        ends = links.select("v", "p").join(labels, "v").join(labels.select(F.col("v").alias("p"), F.col("c").alias("d")), "p")
        open_ = stash(ends.where("c <> d").select(F.col("c").alias("a"), F.col("d").alias("b")).distinct(), "open", small=True)
        if not open_.isEmpty():
            comp = connected_components(open_)
            labels = stash(labels.join(comp.select(F.col("node").alias("c"), "component"), "c", "left").select("v", F.coalesce("component", "c").alias("c")), "labels", small=True)
    # ids of one class, and rows of one id, belong together
    own = sig.where("n_shingles > 0 and doc_id is not null").join(cls.select("f1", "f2", "v"), ["f1", "f2"]).select("doc_id", "v").join(labels, "v", "left").select("doc_id", F.coalesce("c", "v").alias("c"))
    several = own.groupBy("doc_id").agg(F.min("c").alias("c"), F.max("c").alias("d"))
    several = stash(several, "members")
    if not several.where("c <> d").isEmpty():
        # an id with several texts joins their components
        comp = connected_components(own.join(several.where("c <> d").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("c").alias("b")).unionByName(own.select(F.col("doc_id").alias("a"), F.col("c").alias("b"))))
        several = several.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", F.coalesce("component", "c").alias("c"))
    out = sig.select("doc_id", "n_shingles").join(several.select("doc_id", "c"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("c", "doc_id"), F.lit(True)).alias("kept"))


def tables(cls: DataFrame) -> DataFrame:
    """(key, v, k): the table entries of classes that share a key, and how many share it. A class can only share a table with another that
    shares both half-keys, so half-keys that one class alone has are dropped before pairing."""
    each = cls.select("v", F.posexplode("halves").alias("slot", "half"))
    shared = each.groupBy("slot", "half").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("slot", "half")
    live = each.join(shared, ["slot", "half"]).groupBy("v").agg(F.collect_list(F.struct("slot", "half")).alias("h"))
    left = F.filter("h", lambda x: x["slot"] < SIDE)
    right = F.filter("h", lambda x: x["slot"] >= SIDE)
    keys = live.select("v", F.explode(left).alias("l"), right.alias("r")).select("v", "l", F.explode("r").alias("r"))
    keys = keys.select(F.xxhash64("l.slot", "l.half", "r.slot", "r.half").alias("key"), "v")
    full = keys.groupBy("key").agg(F.min("v").alias("x"), F.max("v").alias("y"), F.count(F.lit(1)).alias("k")).where("x <> y").select("key", "k")
    return keys.join(full, "key")


def centred(entries: DataFrame) -> DataFrame:
    """(key, v, w): with the number of entries that a class meets over all its buckets. Texts in the middle of a group of copies meet
    most, and make the best pivots."""
    meets = entries.groupBy("v").agg(F.sum("k").alias("w"))
    return entries.join(meets, "v").select("key", "v", "w")


def candidate_sets(base: DataFrame, wanted: DataFrame, sig: DataFrame) -> DataFrame:
    """(v, n, s array<long>, b array<long>): the whole set of each candidate class, from the text of its smallest id, and its bitmap."""

    def run(batches):
        for pdf in batches:
            texts = [encoded(t) for t in pdf["text"]]
            for at, part in chunks(texts, [len(t) + 1 for t in texts], CHUNK):
                sets = shingle_sets(part)
                sub = pdf.iloc[at : at + len(part)]
                ok = [fingerprint(s) == (a, b) for s, a, b in zip(sets, sub["f1"], sub["f2"], strict=True)]
                yield pd.DataFrame({"v": sub["v"].to_numpy()[ok], "n": [len(s) for s, k in zip(sets, ok, strict=True) if k], "s": [s.view(np.int64) for s, k in zip(sets, ok, strict=True) if k], "b": [bitmap(s) for s, k in zip(sets, ok, strict=True) if k]})

    texts = base.join(wanted.select(F.col("v").alias("doc_id"), "f1", "f2"), "doc_id").select(F.col("doc_id").alias("v"), "f1", "f2", "text")
    found = texts.mapInPandas(run, "v long, n long, s array<long>, b array<long>")
    return found


def mixed_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, v, w, c) of the buckets that still hold several components."""
    now = buckets.join(labels, "v")
    several = now.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
    return now.join(several, "key", "left_semi")


def pivot_pairs(buckets: DataFrame, labels: DataFrame, r: int) -> DataFrame:
    """(v, p, c, d): one pair for each class, with the pivot of another component that it meets in most buckets; both labels.
    Only buckets that still hold several components have a pivot; one grouping by key finds both."""
    now = buckets.join(labels, "v")
    chance = F.lit(1.0) if r == 0 else F.pmod(F.xxhash64("v", F.lit(r)), F.lit(1 << 20)) / float(1 << 20)
    best = F.max(F.struct((F.col("w") * chance).alias("h"), F.col("v").alias("p"), F.col("c").alias("d"))).alias("z")
    pivot = now.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), best).where("x <> y").select("key", "z.p", "z.d")
    met = now.join(pivot, "key").where("c <> d").groupBy("v", "c", "p", "d").agg(F.count(F.lit(1)).alias("k"))
    most = met.groupBy("v").agg(F.max(F.struct("k", "p", "c", "d")).alias("z"))
    return most.select("v", "z.p", "z.c", "z.d")


def prefixes(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(v, n, z, i, t, b): the shingles t by which texts of different components in mixed buckets can meet, by an exact prefix filter.

    With shingles ordered from rare to frequent, two sets of that similarity share one of their first n - ceil(percent * n / 100) + 1. Shingles
    that one component alone has come first, as no other component shares them; z counts these and i is a shingle's place in its text's order.
    A text that differs from all other components in a quarter of its shingles has only such ones there and meets nobody. Labels may grow
    afterwards: what one label alone had, one component alone still has.
    """
    open_ = stash(mixed.select("v", "c").distinct().join(sets, "v"), "open")
    shingles = open_.select("v", "c", F.explode("s").alias("t"))
    often = shingles.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("t", "df")
    own = shingles.select("v", "t").join(often, "t").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("ts"))
    own = open_.select("v", "n", "b").join(own, "v").withColumn("z", F.col("n") - F.size("ts"))
    left = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("z")
    x = own.where(left > 0).select("v", "n", "z", "b", F.posexplode(F.slice("ts", F.lit(1), left.cast("int"))).alias("q", "e"))
    return x.select("v", "n", "z", (F.col("z") + F.col("q") + 1).alias("i"), "e.t", "b")


def rest_pairs(prefix: DataFrame, labels: DataFrame, percent: int, central: bool = False) -> DataFrame:
    """Every pair (v, p, c, d) of different components that can still be a link. ``central``: both are among the CENTRAL texts of
    their component with least of their own, so a large group meets each other text a few times only."""
    x = prefix.join(labels, "v")
    if central:
        place = F.row_number().over(Window.partitionBy("c").orderBy("z", "v"))
        few = x.select("v", "c", "z").distinct().withColumn("place", place).where(F.col("place") <= CENTRAL)
        x = x.join(few.select("v"), "v", "left_semi")
    y = x.select(F.col("v").alias("p"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("i").alias("j"), "t", F.col("b").alias("bp"))
    # at the first shingle that two texts share, what follows it in both must still hold the overlap that the link needs
    need = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    fits = (1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= need) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    # sets differ in at least as many shingles as their bitmaps in places
    apart = sum((F.bit_count(F.col("b")[k].bitwiseXOR(F.col("bp")[k])) for k in range(BITS // 64)), F.lit(0))
    fits &= (F.col("n") + F.col("m") - apart) * (100 + percent) >= 2 * percent * (F.col("n") + F.col("m"))
    hit = x.join(y, (x["t"] == y["t"]) & (F.col("c") != F.col("d")) & (F.col("v") < F.col("p")) & fits)
    return hit.select("v", "p", "c", "d").distinct()


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(a[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(a) - 4, 1) + 1)) AS t(i) WHERE len(a) > 0
), n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), e AS (
  SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 75 * (na.k + nb.k - c)
), d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(doc_id, o) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT d.b, r.o FROM r JOIN d ON d.a = r.doc_id WHERE r.o < d.b
), m AS (SELECT doc_id, min(o) AS c FROM r GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = documents.doc_id AS kept
FROM documents LEFT JOIN n ON documents.doc_id = n.doc_id LEFT JOIN m ON documents.doc_id = m.doc_id
"""

"""Operators with exact results against brute force: nulls, empty and long texts, ties, repeats, clashing names, empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from axiomill.llm import decontaminate, minhash_dedup, suffix_dedup, topk, url_filters

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "Eta", "théta", "iota9"]


def some_text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


# ------------------------------------------------------------------ repeated strings


def brute_repeats(rows, width):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,width", [(1, 20), (2, 100), (3, 12)])
def test_suffix_dedup_equals_brute_force(spark, seed, width):
    r = random.Random(seed)
    shared = [some_text(r, 40), some_text(r, 12)]
    rows = [(i, some_text(r, r.randint(0, 60)) + " " + r.choice(shared) + r.choice(["", "!", some_text(r, 3)])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 400), (103, "ab" * 150), (104, rows[3][1]), (105, "x" * (width - 1)), (106, shared[0] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "'x' as payload", "doc_id as key")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(df, width).collect()), key=str)
    assert got == brute_repeats(rows, width)


def test_suffix_dedup_with_repeated_and_null_ids(spark):
    t = "the quick brown fox jumps over the lazy dog " * 3
    rows = [(1, t), (1, t), (None, t), (2, "short"), (1, t + "and more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(df, 40).collect()), key=str)
    assert got == brute_repeats(rows, 40)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_suffix_dedup_over_piece_borders(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 256)
    r = random.Random(9)
    own = some_text(r, 30)
    texts = [(i, some_text(r, 120) + own + some_text(r, 100)) for i in range(6)]
    runs = []
    for doc, t in texts:
        for g in suffix_dedup.groups([(doc, t.encode())], 50):
            rec = suffix_dedup.runs_of(g, 50)
            runs += [(doc, int(s) + k) for s, n in zip(rec["s"], rec["n"], strict=True) for k in range(n)]
    assert sorted(runs) == [(d, i) for d, t in texts for i in range(len(t.encode()) - 49)]  # each window in one run


def test_buckets_settle_across_their_borders():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(60):
        rec = np.zeros(60, suffix_dedup.RUN)
        rec["t0"], rec["eh"], rec["doc"] = r.integers(0, 4, 60), r.integers(0, 3, 60), r.permutation(60)
        whole = {}
        texts = {}
        for x in rec[suffix_dedup.run_order(rec)]:
            texts.setdefault(int(x["t0"]), set()).add(int(x["eh"]))
        seen = set()
        for x in rec[suffix_dedup.run_order(rec)]:
            k = (int(x["t0"]), int(x["eh"]))
            whole[int(x["doc"])] = suffix_dedup.REPEATED if k in seen else suffix_dedup.OPEN if len(texts[k[0]]) > 1 else 0
            seen.add(k)
        keys = suffix_dedup.sort_key(rec)
        b = np.searchsorted(np.sort(r.choice(keys, 8, replace=False)), keys, side="right")
        found, borders = {}, {}
        for i in np.unique(b).tolist():
            found[i], borders[i] = suffix_dedup.decide(rec[b == i])
        kinds = suffix_dedup.settled(borders)
        got = {}
        for i, kind in found.items():
            for d, k in zip(rec["doc"][b == i].tolist(), kind.tolist(), strict=True):
                got[d] = k if k <= suffix_dedup.OPEN else kinds[i][k - suffix_dedup.HEAD_FIRST]
        assert got == whole


def test_multikey_order_is_lexicographic():
    import numpy as np

    r = np.random.default_rng(3)
    keys = [r.integers(0, 4, 500) for _ in range(4)]
    assert suffix_dedup.multikey_order(*keys).tolist() == np.lexsort(keys[::-1]).tolist() or [tuple(k[i] for k in keys) for i in suffix_dedup.multikey_order(*keys)] == sorted(zip(*keys, strict=True))


# ------------------------------------------------------------------ near duplicates


def brute_near(rows, percent=75):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_minhash_equals_brute_force(spark):
    r = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice([3, 8, 60, 150]))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "One two"), (504, "one TWO"), (505, rows[0][1]), (506, "one " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as v", "2 as n", "3 as key", "4 as c")
    assert sorted(map(tuple, minhash_dedup.near_duplicates(df).collect())) == brute_near(rows)


def test_minhash_defined_results(spark):
    rows = [(None, "one two three four five six"), (1, "one two three four five six"), (1, "nine eight seven"), (2, "nine eight seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["component_id"], x["kept"]) for x in minhash_dedup.near_duplicates(df).collect()}
    assert got == {(None, None, True), (1, 1, True), (2, 1, False)}
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def near_group(n, words=150, edits=7, seed=8):
    """Copies of one text with up to so many words changed: links hold them together, and some copies have them with a few others only."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(2, edits)):
            w[r.randrange(words)] = f"x{r.randint(0, 10**9)}"
        rows.append((i, " ".join(w)))
    return rows


def test_a_large_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    seen, confirm = [], minhash_dedup.confirm
    monkeypatch.setattr(minhash_dedup, "confirm", lambda pairs, *a, **b: seen.append(pairs.count()) or confirm(pairs, *a, **b))
    rows = near_group(600)
    got = sorted(map(tuple, minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_near(rows)
    assert sum(seen) < 5 * len(rows), seen


def test_bitmaps_differ_in_no_more_places_than_sets():
    r = np.random.default_rng(3)
    for n, k in ((1, 0), (40, 9), (900, 300), (3000, 5)):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[k:], r.integers(0, 2**63, k, dtype=np.uint64)]))
        x, y = minhash_dedup.bitmap(a), minhash_dedup.bitmap(b)
        assert len(x) == minhash_dedup.BITS // 64 and sum(int(z).bit_count() for z in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_tensored_keys_need_few_minhashes():
    assert len(minhash_dedup.MUL) == 2 * minhash_dedup.SIDE * minhash_dedup.ROWS < minhash_dedup.SIDE**2


# ------------------------------------------------------------------ benchmark windows


def brute_leaks(rows, items, size=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for doc, text in rows:
        w, hit, own = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(size, len(b))
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n and item is not None else set()
            for i in range(len(w) - n + 1 if wins else 0):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    own.add(str(item))
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 25), (400, 300)])
def test_decontamination_equals_brute_force(spark, monkeypatch, shard, block):
    r = random.Random(6)
    items = [(i, some_text(r, r.randint(11, 25))) for i in range(12)] + [(20, "short item here"), (21, "solo"), (22, None), (None, some_text(r, 12)), (23, ""), (3, some_text(r, 12))]
    rows = [(i, some_text(r, r.randint(0, 80)) + ", " + (r.choice(items)[1] or "").upper() + ". " + some_text(r, 5)) for i in range(50)]
    rows += [(90, None), (91, ""), (92, items[0][1]), (92, items[0][1]), (93, some_text(r, 4000) + " " + items[1][1]), (None, items[2][1]), (94, "a short  item-here!"), (95, "SOLO")]
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as hit", "2 as items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=str)
    assert got == brute_leaks(rows, items)
    assert sorted((tuple(x)[:6] for x in decontaminate.contamination(docs, bench, places=True).collect()), key=str) == got
    clean = {x["doc_id"] for x in decontaminate.remove_contaminated(docs, bench).collect()}
    assert clean == {x[0] for x in brute_leaks(rows, items) if not x[5]} - {x[0] for x in brute_leaks(rows, items) if x[5]}


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [x["n_hit"] for x in decontaminate.contamination(docs, bench).collect()] == [0]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_longest_matches_and_places(spark):
    r = random.Random(3)
    items = [(i, " ".join(f"w{r.randint(0, 10**6)}" for _ in range(40))) for i in range(4)] + [(9, "tiny item")]
    w = [t.split() for _, t in items]
    rows = [(1, " ".join(["x", *w[0][5:30], "y", *w[1][:12]])), (2, " ".join(w[2] + w[2])), (3, "no match at all"), (4, "a tiny item b"), (5, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(x) for x in decontaminate.matches(docs, bench).collect())
    assert got == [(1, "0", 1, 5, 25), (1, "1", 27, 0, 12), (2, "2", 0, 0, 40), (2, "2", 40, 0, 40), (4, "9", 1, 0, 2)]
    own = {x["doc_id"]: (x["longest"], x["longest_at"], x["longest_item"]) for x in decontaminate.contamination(docs, bench, places=True).collect()}
    assert own == {1: (25, 1, "0"), 2: (40, 0, "2"), 3: (0, None, None), 4: (2, 1, "9"), 5: (0, None, None)}


def test_words_whose_hashes_collide_are_told_apart(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a  # of these two no sum of powers modulo 2**64 knows the difference
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, b)], "item_id long, text string")
    assert {x["doc_id"]: x["contaminated"] for x in decontaminate.contamination(docs, bench).collect()} == {1: False, 2: True, 3: False}
    assert {x["doc_id"]: x["component_id"] for x in minhash_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


# ------------------------------------------------------------------ urls


RULES = [("org", "/"), ("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/fr/"), ("com", "/de/")]
VERDICT = dict(zip([a + b for a, b in RULES], ["allow", "block", "block", "allow", "block"], strict=True))


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    fits = [h + p for h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=len, default=None)
    return host, path, best, VERDICT.get(best, "allow")


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "HTTP://a.Example.org/es/x?y#z", "http://example.org/en/12", "http://myexample.org/es/", "ftp://x.y.com/de/?q", "http://com/fr/a#b", "http://a.org?x=/", "http://a..org/x", "://net/a", "http://u:p@a.com:80/de/", "http://a.com/de", "x://y://org/es/", "http://" + "a." * 3000 + "org/" + "p" * 5000, "http://example.org/es/", "http://é.org/ü"]
    rows = [(i, u) for i, u in enumerate(urls * 2)] + [(None, "http://org/"), (1, "http://org/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "'p' as path", "'v' as verdict")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, url_filters.judge_urls(df, rules).collect()), key=str)
    assert got == sorted(((i, *brute_url(u)) for i, u in rows), key=str)
    assert {x["verdict"] for x in url_filters.judge_urls(df, rules.limit(0)).collect()} == {"allow"}
    assert url_filters.judge_urls(df.limit(0), rules).count() == 0


def test_urls_with_many_rules_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 0)
    df = spark.createDataFrame([(1, "http://b.example.org/es/1")], "page_id long, url string")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    assert [x["rule"] for x in url_filters.judge_urls(df, rules).collect()] == ["example.org/es/"]


# ------------------------------------------------------------------ top-k


def brute_topk(rows, k, every):
    import math

    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in {(i, tuple(e)) for i, e in v if i % every == 0}:
        s = sorted((-sum(x * y for x, y in zip(a, e)), i) for i, e in v if i != q)[:k]  # noqa: B905
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 16])
def test_topk_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(40)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 40), (303, [float("inf")] * 40), (None, rows[1][1]), (304, []), (305, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as b", "2 as v", "3 as score")
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_topk(rows, 20, 20)
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_is_exact_for_large_components(spark):
    rows = [(i, [float(2**22 + i) / 64, float(i)]) for i in range(0, 60, 5)] + [(61, [2.0**31, -1.0]), (80, [2.0**16, 2.0**16 - 1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, every=20).collect())) == brute_topk(rows, 20, 20)


def test_topk_refuses_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [2.0**50]), (1, [2.0**50])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(df).collect()


def test_topk_bound_is_never_under_an_exact_score():
    import numpy as np

    r = np.random.default_rng(5)
    for _ in range(200):
        d = int(r.integers(1, 200))
        q, c = r.integers(-(2**20), 2**20, d), r.integers(-(2**20), 2**20, (d, 50))
        c[:, 0] = q  # the bound is met there
        cut = int(r.integers(0, d + 1))
        rest, mass = float(np.sqrt((q[cut:].astype(float) ** 2).sum())), np.sqrt((c[cut:].astype(float) ** 2).sum(axis=0))
        bound = topk.upper((q[:cut] @ c[:cut]).astype(float), rest, mass, d)
        assert all(int(b) >= int(x) for b, x in zip(np.ceil(bound), q @ c, strict=True))

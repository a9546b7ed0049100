"""SentencePiece encoding and decoding with N-best segmentation.

Texts are written with word marks for spaces; no piece holds a mark after another character or a line break after anything, so a text is a
row of words, each with the whole run of marks before it. Over each word's piece lattice the forward Viterbi pass gives every place its best score so far, which is an exact heuristic for a
backward A* search: complete segmentations leave the queue in order of score, without exploring any other. Short words go through the
forward pass many at once, long ones singly and whole, in time linear in their length. A text's N best combine
its words': only the N - 1 words with the least margin can differ from the best. Decoding is exact: characters outside the
vocabulary, and word marks of the text itself, are written as byte pieces.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Interner, arrow_rows, kept, table

MARK = "▁"
#: longest unit searched many at once (longer ones are searched one by one, whole) and longest piece, in characters
UNIT, PIECE = 24, 16
CACHED = 400_000
#: characters of long units that a worker keeps
CACHED_LONG = 2_000_000
NEVER = -1e18
#: in a search by itself a score is a whole number of these parts, so that sums are exact and equal scores are seen to be equal
PARTS = 1 << 44


class Vocabulary:
    """Pieces and scores of a public sentencepiece model; byte pieces stand in for characters outside it.

    The model is one of merges: its own scores are minus the rank of each merge, and as summands they would prefer many early fragments to one
    word. A piece's score here is the log of a Zipf probability of that rank. With these scores the segmentations and ids are those of the
    library's unigram encoding over the same pieces (a test holds them against it), a space before the text included where the model asks for one.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.prefix = sp.encode("a", out_type=str)[0].startswith(MARK)  # texts are encoded with a space before them
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        norm = np.log(np.sum(1.0 / np.arange(10, 10 + len(plain))))
        self.score = np.full(n, NEVER)
        for i, r in rank.items():
            self.score[i] = -np.log(10.0 + r) - norm
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.byte_score = float(self.score[list(rank)].min()) - 2.0
        self.ids = {self.pieces[i]: i for i in plain if len(self.pieces[i]) <= PIECE}
        self.longest = max(map(len, self.ids), default=1)
        self.parts = {p: (i, round(float(self.score[i]) * PARTS)) for p, i in self.ids.items()}
        self.byte_parts = round(self.byte_score * PARTS)
        if any("\n" in p[1:] or MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces cross the places where words_in parts a text")

    def edges(self, word: str):
        """For each start the (end, id or None for bytes, score) of its pieces; a character of no piece has its byte edge."""
        out = []
        for i in range(len(word)):
            own = []
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                k = self.ids.get(word[i:j])
                if k is not None:
                    own.append((j, k, float(self.score[k])))
            if not own or own[0][0] != i + 1:
                own.append((i + 1, None, self.byte_score * len(raw(word[i]).encode("utf-8"))))
            out.append(own)
        return out

    def into(self, word: str, j: int):
        """The (start, id or None for bytes, score in PARTS) of the pieces that end at a place, shortest first."""
        own = [(i, *k) for i in range(j - 1, max(0, j - self.longest) - 1, -1) if (k := self.parts.get(word[i:j])) is not None]
        if not own or own[0][0] != j - 1:
            own.insert(0, (j - 1, None, self.byte_parts * len(raw(word[j - 1]).encode("utf-8"))))
        return own

    def spell(self, word: str, path) -> list[int]:
        ids = []
        for i, _, k in path:
            ids += [k] if k is not None else [self.byte[b] for b in raw(word[i]).encode("utf-8")]
        return ids

    def decode(self, ids) -> str:
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(int(i))
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.pieces[int(i)].replace(MARK, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).removeprefix(" " if self.prefix else "")


#: a word mark that the text itself holds travels as this lone surrogate, which no valid text has, so that it is not taken for a space
OWN_MARK = "\udc81"


def raw(ch: str) -> str:
    return MARK if ch == OWN_MARK else ch


#: parts units in a text; a lone surrogate as well
CUT = "\udc82"


def words_in(text: str) -> list[str]:
    """Units: each run of spaces' marks, with the word after it, and each line break begins one (no piece goes across)."""
    if MARK in text:
        text = text.replace(MARK, OWN_MARK)
    runs = "  " in text
    text = text.replace(" ", CUT + MARK)
    if runs:
        text = text.replace(MARK + CUT, MARK)
    units = text.replace("\n", CUT + "\n").split(CUT)
    if not units[0]:
        del units[0]
    return units


def n_best(vocab: Vocabulary, word: str, n: int) -> list[tuple[float, list]]:
    """The n best segmentations as (score, [(start, end, id)]); of equal scores the one with the longer last pieces comes first."""
    m = len(word)
    best = [0] * (m + 1)
    for j in range(1, m + 1):
        best[j] = max(best[i] + s for i, _, s in vocab.into(word, j))
    # backward: a state is (place, score of the path from it to the end); best[place] is exactly what remains, so each state stands for a
    # segmentation of that score, no two for the same one, and only the best states that are still wanted are kept
    queue = [(best[m], 0, m, 0, None)]
    out, tick = [], 0
    while queue and len(out) < n:
        f, _, at, done, path = queue.pop()
        if at == 0:
            steps = []
            while path is not None:
                steps.append(path[0])
                path = path[1]
            out.append((f / PARTS, steps))
            continue
        for i, k, s in vocab.into(word, at):
            tick += 1
            bisect.insort(queue, (best[i] + s + done, tick, i, s + done, ((i, at, k), path)))
        del queue[: max(0, len(queue) - (n - len(out)))]
    return out


class Lattices:
    """Best and second-best scores and best pieces of many words at once: the forward pass, vectorised over words."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.step = np.uint64(0x9E3779B97F4A7C15)
        names = list(vocab.ids)
        keys = np.zeros(len(names), np.uint64)
        for i, p in enumerate(names):
            h = 0
            for c in p:
                h = (h * int(self.step) + ord(c) + 1) & (2**64 - 1)
            keys[i] = h
        self.ascii = np.array([vocab.byte[b] for b in range(128)])  # the byte pieces of one-byte characters
        o = np.argsort(keys)
        self.keys, self.piece = keys[o], np.array([vocab.ids[names[i]] for i in o])
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(best score, margin to the second best, 32-bit ids of the best) of each word."""
        n = len(words)
        cp = np.array(words, dtype=f"U{UNIT}").view(np.uint32).reshape(n, UNIT).astype(np.uint64)
        odd = np.array([i for i, w in enumerate(words) if len(w) > UNIT or "\x00" in w], np.int64)  # long ones, and NULs, which end a fixed-width string: searched one by one
        cp[odd] = 0
        size = (cp > 0).sum(axis=1)
        one = np.full((UNIT + 1, n), NEVER)
        two = np.full((UNIT + 1, n), NEVER)
        back = np.full((UNIT + 1, n), -1, np.int8)
        kind = np.full((UNIT + 1, n), -1, np.int32)
        one[0] = 0.0
        for i in range(int(size.max(initial=0))):
            live = np.flatnonzero(cp[:, i] > 0)
            h = np.zeros(len(live), np.uint64)
            single = np.zeros(n, bool)
            for d in range(1, min(self.vocab.longest, UNIT - i) + 1):
                c = cp[live, i + d - 1]
                go = c > 0
                if not go.all():
                    live, h, c = live[go], h[go], c[go]
                if not len(live):
                    break
                with np.errstate(over="ignore"):
                    h = h * self.step + (c + np.uint64(1))
                maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
                ok = self.keys[at] == h[maybe]
                rows, piece = live[maybe[ok]], self.piece[at[ok]]
                if d == 1:
                    single[rows] = True
                    none = live[~single[live]]
                    if len(none):
                        cost = self.vocab.byte_score * np.array([len(raw(chr(int(x))).encode("utf-8", "surrogatepass")) for x in cp[none, i]])
                        self.relax(one, two, back, kind, i, 1, none, np.where(cp[none, i] < 128, self.ascii[np.minimum(cp[none, i], 127).astype(np.int64)], -2), cost)
                self.relax(one, two, back, kind, i, d, rows, piece, self.vocab.score[piece])
        rest = np.arange(n)
        top, margin = one[size, rest], one[size, rest] - two[size, rest]
        at = size.copy()
        chain = []
        while (at > 0).any():
            live = np.flatnonzero(at > 0)
            chain.append((live, at[live] - back[at[live], live], kind[at[live], live]))
            at[live] = at[live] - back[at[live], live]
        # back pointers gathered step by step, then put in reading order for all words at once
        word = np.concatenate([c[0] for c in chain]) if chain else np.zeros(0, np.int64)
        piece = np.concatenate([c[2] for c in chain]) if chain else np.zeros(0, np.int32)
        step = np.repeat(np.arange(len(chain)), [len(c[0]) for c in chain])
        order = np.lexsort((-step, word))
        ends = (4 * np.cumsum(np.bincount(word, minlength=n))).tolist()
        flat = piece[order].astype("<u4").tobytes()
        ids = [flat[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        for w in {*odd.tolist(), *np.unique(word[piece < 0]).tolist()}:  # long, characters of several byte pieces or a NUL: searched one by one
            found = n_best(self.vocab, words[w], 2)
            top[w], margin[w] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else -NEVER
            ids[w] = np.array(self.vocab.spell(words[w], found[0][1]), "<u4").tobytes()
        return top, margin, ids

    @staticmethod
    def relax(one, two, back, kind, i, d, rows, piece, score):
        first, second = one[i, rows] + score, two[i, rows] + score
        j = i + d
        a, b = one[j, rows], two[j, rows]
        better = first > a
        two[j, rows] = np.where(better, np.maximum(a, second), np.maximum(b, first))
        one[j, rows] = np.where(better, first, a)
        back[j, rows] = np.where(better, d, back[j, rows])
        kind[j, rows] = np.where(better, piece, kind[j, rows])


class Segmenter:
    """Texts to ids and N-best scores; what a worker has found for a word it keeps."""

    def __init__(self, vocab: Vocabulary, n: int):
        self.vocab, self.n, self.lattices = vocab, n, Lattices(vocab)
        self.reset()

    def reset(self):
        self.at, self.ids, self.best_of, self.long = Interner(), [], {}, 0
        self.top, self.margin = np.zeros(0), np.zeros(0)

    def prepare(self, split: list[list[str]]) -> list[list[int]]:
        """The numbers of each text's words; words not seen before are searched."""
        if len(self.at) > CACHED or self.long > CACHED_LONG:
            self.reset()
        out = [list(map(self.at.__getitem__, s)) for s in split]
        new = self.at.take()
        self.long += sum(len(w) for w in new if len(w) > UNIT)
        tops, margins = [self.top], [self.margin]
        for a in range(0, len(new), 1 << 15):
            top, margin, ids = self.lattices(new[a : a + (1 << 15)])
            self.ids += ids
            tops.append(top)
            margins.append(margin)
        self.top, self.margin = np.concatenate(tops), np.concatenate(margins)
        return out

    def word_best(self, word: str) -> tuple:
        """A word's n best (score, ids). Kept in the segmenter itself, so that they go with it."""
        if word not in self.best_of:
            if len(self.best_of) > 20_000:
                self.best_of = {}
            self.best_of[word] = tuple((s, tuple(self.vocab.spell(word, p))) for s, p in n_best(self.vocab, word, self.n))
        return self.best_of[word]

    def text_n_best(self, words: list[str], at: np.ndarray) -> list[tuple[float, dict[int, int]]]:
        """The n best of a text: (score, {word place: which of its segmentations}), best first."""
        base = float(self.top[at].sum())
        if self.n == 1 or not len(at):
            return [(base, {})]
        k = min(self.n - 1, len(at))
        near = np.argpartition(self.margin[at], k - 1)[:k] if k < len(at) else np.arange(len(at))
        near = sorted(near.tolist(), key=lambda p: (self.margin[at[p]], p))
        choices = [[s for s, _ in self.word_best(words[p])] for p in near]
        states, seen = [(-base, (0,) * len(near))], {(0,) * len(near)}
        out = []
        while states and len(out) < self.n:
            f, pick = heapq.heappop(states)
            out.append((-f, {p: c for p, c in zip(near, pick, strict=True) if c}))
            for i, c in enumerate(pick):
                if c + 1 < len(choices[i]):
                    nxt = (*pick[:i], c + 1, *pick[i + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(states, (f + choices[i][c] - choices[i][c + 1], nxt))
        return out


@kept
@functools.lru_cache(1)
def segmenter(model_path: str, n: int) -> Segmenter:
    """A worker's segmenter: what one task has found serves the next."""
    return Segmenter(Vocabulary(model_path), n)


def encode_texts(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_pieces, ids_crc32 (of the best ids, little-endian 32-bit), best_score, n_best (array of scores, best
    first), round_trip (decoding the ids gives the text); with_ids adds the ids of the best and of each other segmentation.

    Null and empty texts have no pieces, the score 0 and one segmentation; null ids stay null; repeated rows are encoded each; an empty table
    gives no rows. Whole texts are used, and words of any length are searched whole. Other columns are not read.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 2048)

    def run(batches):
        seg = segmenter(model_path, n)
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            split = [words_in(" " + t if t and seg.vocab.prefix else t) for t in texts]
            places = seg.prepare(split)
            rows = []
            for doc, text, words, at in zip(pdf["doc_id"].array, texts, split, places, strict=True):
                b = b"".join(map(seg.ids.__getitem__, at))
                ids = np.frombuffer(b, "<u4")
                found = seg.text_n_best(words, np.array(at, np.int64))
                row = [doc, len(words), len(ids), zlib.crc32(b), round(found[0][0], 6), [round(s, 6) for s, _ in found], seg_decode(seg, ids) == text]
                if with_ids:
                    alt = [[x for p, w in enumerate(words) for x in (seg.word_best(w)[pick[p]][1] if p in pick else np.frombuffer(seg.ids[at[p]], "<u4").tolist())] for _, pick in found]
                    row += [ids.tolist(), alt]
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "n_words", "n_pieces", "ids_crc32", "best_score", "n_best", "round_trip"] + ["ids", "alternatives"] * with_ids
    fields = "doc_id long, n_words long, n_pieces long, ids_crc32 long, best_score double, n_best array<double>, round_trip boolean" + ", ids array<long>, alternatives array<array<long>>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, fields)


def seg_decode(seg: Segmenter, ids: np.ndarray) -> str:
    """Decoding by a table of pieces' bytes: byte pieces and texts join as UTF-8."""
    if not hasattr(seg, "spelled"):
        v = seg.vocab
        seg.spelled = [bytes([v.byte_of[i]]) if i in v.byte_of else p.replace(MARK, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(v.pieces)]
    t = seg.spelled
    return b"".join([t[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" " if seg.vocab.prefix else "")


def query(spark, sf_dir):
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations form a lattice; backward sums over it give the probability
of every piece after every prefix, exactly. The k largest Gumbel-perturbed
segmentations are a sample without replacement, and a best-first (A*) search
emits them in order: a subtree's largest perturbed value is drawn without
looking inside, conditioned on its parent's, so a node is opened only when its
value is the largest left. Along a segmentation that carries its subtree's largest
value, the rest of each node's children is one set with one truncated Gumbel
value; the search heap holds such sets. The value of the (k+1)-th
segmentation gives the inclusion score log P(in sample) = log(1 - exp(-exp(phi - kappa))).

Pieces never contain an inner word mark or a new line, so the lattice falls apart
into words. What follows a place depends on the rest of its word alone, so equal rests
share their pieces and sums, which a worker keeps from batch to batch; numpy does
the sums for all rests of a length together. A segmentation is a row of edges, each a
piece before a rest. Piece log probabilities are Zipf's law over the vocabulary's own
order (a merge vocabulary has ranks, not probabilities).
A character without a piece is spelled by byte pieces, as is a literal word mark, so
decoding gives back every text exactly.

Null and empty texts have one segmentation, the empty one. A text with fewer than
k segmentations yields them all. All draws depend on seed and row key alone; rows
repeating a key and text repeat the samples, and a null key counts as 0. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, _powers, mix, read, seeded, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
_STEP = U64(0xD6E8FEB86659FD93)
_INV = U64(pow(int(_STEP), -1, 1 << 64))
#: Stands for a literal word mark in a text; no piece has it.
_LITERAL = 0x110000
#: Edges that a worker keeps between batches, 38 bytes each; beyond, it forgets them all.
MAX_EDGES = 3_000_000
#: Characters of the longest rests of words that are kept; longer ones go with their batch.
MAX_KEPT = 32
#: Words sampled together; their arrays stay in a core's cache.
_WORDS = 1 << 15
_LOW_BITS = U64((1 << 20) - 1)


class Words:
    """Lattices of words and rests of words met so far. The edges of a rest, its first pieces, lie in a row by length."""

    TYPES = {
        "low": np.float64,  # chance of the edges before it in its row
        "logc": np.float64, "others": np.float64,  # log chances of it and of the others in its row
        "next": np.int32,  # last edge of the rest after it, -1 at the word's end
        "ids": np.int32,  # -1 spells one character in several bytes
        "size": np.int16,  # characters
        "slot": np.int16, "more": np.int16,  # edges before and after it in its row
    }

    def __init__(self):
        self.summed = 0  # rests whose sums were made
        self.forget()

    def forget(self) -> None:
        self.keys, self.tops, self.betas = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0)  # of kept rests: sorted hashes, last edges, backward sums
        self.n = self.kept = 0
        for name, kind in self.TYPES.items():
            setattr(self, name, np.empty(0, kind))

    def append(self, new: dict[str, np.ndarray]) -> None:
        n = self.n + len(new["low"])
        for name in self.TYPES:
            have = getattr(self, name)
            if n > len(have):
                grown = np.empty(n + n // 2, have.dtype)
                grown[: self.n] = have[: self.n]
                setattr(self, name, grown)
            getattr(self, name)[self.n : n] = new[name]
        self.n = n

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of these hashes among the kept ones, and whether they are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def look_up(self, v: Vocabulary, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sums: np.ndarray, back: np.ndarray) -> np.ndarray:
        """The last edges of these distinct words' rows."""
        if self.kept > MAX_EDGES or len(self.low) > 4 * MAX_EDGES:
            self.forget()
        self.n = self.kept
        at, known = self.find(keys)
        tops = np.full(len(keys), -1, np.int32)
        tops[known] = self.tops[at[known]]
        new = np.flatnonzero(~known)
        if not len(new):
            return tops
        # all rests of the new words, the empty ones last in each
        width = lengths[new] + 1
        begin = np.cumsum(width) - width
        place = np.arange(int(width.sum())) - np.repeat(begin, width)
        left, at = np.repeat(lengths[new], width) - place, np.repeat(starts[new], width) + place
        h = _span_hash(sums, back, at, left)
        order = np.argsort(h)
        differs = np.append(True, np.diff(h[order]) != 0)
        own = np.empty(len(h), np.int64)
        own[order] = np.cumsum(differs) - 1
        some = order[differs]  # a place of each distinct rest
        k, known = self.find(h[some])
        top, beta = np.full(len(some), -1, np.int32), np.zeros(len(some))
        top[known], beta[known] = self.tops[k[known]], self.betas[k[known]]
        todo = np.flatnonzero(~known & (left[some] > 0))
        todo = todo[np.argsort(left[some[todo]], kind="stable")]
        made, last = _edges(v, points, at, left, sums, back, some[todo], todo, own, top, beta, self.n)
        short = np.searchsorted(left[some[todo]], MAX_KEPT, side="right")
        self.kept = int(last[short - 1]) + 1 if short else self.n
        self.append(made)
        self.summed += len(todo)
        todo = np.sort(todo[:short])
        into = np.searchsorted(self.keys, h[some[todo]])
        self.keys, self.tops, self.betas = np.insert(self.keys, into, h[some[todo]]), np.insert(self.tops, into, top[todo]), np.insert(self.betas, into, beta[todo])
        tops[new] = top[own[begin]]
        return tops


@dataclass
class Vocabulary:
    pieces: pa.Array  # bytes of all pieces with spaces for word marks, and once more without the first byte
    size: int
    keys: np.ndarray  # sorted hashes of the pieces that aren't bytes
    ids: np.ndarray
    logp: np.ndarray  # of each id
    byte_ids: np.ndarray
    longest: int
    seen: np.ndarray  # a filter over the low bits of the hashes
    begun: np.ndarray  # the same of all beginnings of longer pieces
    words: Words = field(default_factory=Words)


def _hash_points(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(U64) + U64(0x632BE59BD9B4E019))


def _span_hash(sums: np.ndarray, back: np.ndarray, starts: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[starts + n] - sums[starts]) * back[starts] + np.asarray(n).astype(U64))


def _running(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        sums = np.zeros(len(points) + 1, U64)
        np.cumsum(_hash_points(points) * _powers(_STEP, len(points)), out=sums[1:], dtype=U64)
    return sums, _powers(_INV, len(points) + 1)


@lru_cache(maxsize=2)
def vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.vocab_size()
    names = [m.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    order = sorted(plain, key=lambda i: (-m.get_score(i), i))
    weight = np.zeros(n)
    weight[order] = 1 / (np.arange(len(order)) + 10.0)
    byte_ids = np.array([i for i in range(n) if m.is_byte(i)])
    byte_ids = byte_ids[np.argsort([int(names[i][3:5], 16) for i in byte_ids])]
    weight[byte_ids] = 1 / (len(order) + 10.0)
    logp = np.log(np.maximum(weight, 1e-300) / weight.sum())
    length = np.array([len(names[i]) for i in plain])
    starts = np.cumsum(length) - length
    sums, back = _running(np.frombuffer("".join(names[i] for i in plain).encode("utf-32-le"), np.uint32))
    hashes = _span_hash(sums, back, starts, length)
    at = np.argsort(hashes)
    seen, begun = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
    seen[hashes & _LOW_BITS] = True
    for k in range(1, int(length.max())):
        begun[_span_hash(sums, back, starts[length > k], k) & _LOW_BITS] = True
    pieces = [b""] * n
    for i in plain:
        pieces[i] = names[i].replace("▁", " ").encode()
    for b, i in enumerate(byte_ids):
        pieces[i] = bytes([b])
    both = pa.array([*pieces, *(p[1:] for p in pieces)], pa.large_binary())
    return Vocabulary(both, n, hashes[at], np.array(plain)[at], logp, byte_ids, int(length.max()), seen, begun)


def _byte_count(points: np.ndarray) -> np.ndarray:
    p = np.where(points == _LITERAL, MARK, points)
    return 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)


def _edges(
    v: Vocabulary, points: np.ndarray, at: np.ndarray, left: np.ndarray, sums: np.ndarray, back: np.ndarray, places: np.ndarray, rests: np.ndarray, own: np.ndarray, top: np.ndarray, beta: np.ndarray, base: int,
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Edges, numbered from base, of the rests that begin at these places, the shorter first, and the last edge of each.

    own numbers the rest of every place; top and beta hold last edges and backward sums by those numbers and are filled in.
    """
    at, left = at[places], left[places]
    live, found = np.arange(len(places)), []  # rows, lengths, ids and log probabilities
    for n in range(1, v.longest + 1):
        live = live[np.searchsorted(left[live], n) :]
        if not len(live):
            break
        h = _span_hash(sums, back, at[live], n)
        low = h & _LOW_BITS
        may = np.flatnonzero(v.seen[low])
        k = np.minimum(np.searchsorted(v.keys, h[may]), len(v.keys) - 1)
        hit = v.keys[k] == h[may]
        row, ids = live[may[hit]], v.ids[k[hit]]
        found.append((row, n, ids, v.logp[ids]))
        if n == 1:  # characters without a piece
            lone = np.ones(len(places), bool)
            lone[row] = False
            row = np.flatnonzero(lone)
            p = points[at[row]]
            found.append((row, 1, np.where(p < 0x80, v.byte_ids[np.minimum(p, 0x7F)], -1), _byte_count(p) * v.logp[v.byte_ids[0]]))
        live = live[v.begun[low]]
    count = np.zeros(len(places), np.int64)
    for row, *_ in found:
        count[row] += 1
    bounds = np.append(0, np.cumsum(count))
    e, filled = int(bounds[-1]), np.zeros(len(places), np.int64)
    size, ids, slot, logp = np.empty(e, np.int64), np.empty(e, np.int64), np.empty(e, np.int64), np.empty(e)
    for row, n, i, p in found:
        to = bounds[row] + filled[row]
        size[to], ids[to], slot[to], logp[to] = n, i, filled[row], p
        filled[row] += 1
    of = np.repeat(np.arange(len(places)), count)
    to = own[places[of] + size]
    last = bounds[1:] - 1 + base
    top[rests] = last
    level = np.append(0, np.flatnonzero(np.diff(left)) + 1).tolist()  # rests of one length
    for a, z in zip(level, [*level[1:], len(left)], strict=True):
        lo, hi = bounds[a], bounds[z]
        x, head = logp[lo:hi] + beta[to[lo:hi]], bounds[a:z] - lo
        most = np.maximum.reduceat(x, head)
        beta[rests[a:z]] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, count[a:z])), head))
    p = np.exp(logp + beta[to] - beta[rests][of])
    p /= np.add.reduceat(p, bounds[:-1])[of]
    low = np.zeros(e)
    for k in range(1, int(count.max())):
        i = bounds[:-1][count > k] + k
        low[i] = np.minimum(low[i - 1] + p[i - 1], 1.0)
    high = np.append(low[1:], 1.0)
    high[bounds[1:] - 1] = 1.0
    logc = np.log(np.maximum(high - low, 1e-300))
    others = np.full(e, -np.inf)
    i = np.flatnonzero(logc < -1e-13)
    others[i] = np.log(-np.expm1(logc[i]))
    return {"low": low, "logc": logc, "others": others, "next": top[to], "ids": ids, "size": size, "slot": slot, "more": count[of] - 1 - slot}, last


class Batch:
    """Texts of one Arrow batch: their words, and the lattices of the distinct ones."""

    def __init__(self, v: Vocabulary, texts: list[str | None]):
        self.v = v
        whole = [" " + t if t else "" for t in texts]
        points = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        self.doc_end = np.cumsum([len(t) for t in whole])
        space = points == 32
        points[points == MARK] = _LITERAL
        points[space] = MARK
        first = np.zeros(len(points), bool)
        if len(points):
            first[0] = True
            first[1:] = (space[1:] & ~space[:-1]) | (points[1:] == 10) | (points[:-1] == 10)
            ends = self.doc_end[:-1]
            first[ends[ends < len(points)]] = True
        self.points = points
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(points)))
        sums, back = _running(points)
        with np.errstate(over="ignore"):
            keys = mix((sums[starts + lengths] - sums[starts]) * back[starts] + lengths.astype(U64)) if len(starts) else np.zeros(0, U64)
        _, at, word = np.unique(keys, return_index=True, return_inverse=True)
        self.word_doc = np.searchsorted(self.doc_end, starts, side="right")
        self.doc_word = np.searchsorted(self.word_doc, np.arange(len(texts) + 1))
        self.start = starts
        self.top = v.words.look_up(v, keys[at], points, starts[at], lengths[at], sums, back)[word]

    def sample(self, words: np.ndarray, keys: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """An exact sample for each of these words: their edges in order, and where each word's begin."""
        low, after, parts, counts = self.v.words.low, self.v.words.next, [], [np.zeros(1, np.int64)]
        for i in range(0, len(words), _WORDS):
            w = words[i : i + _WORDS]
            doc = self.word_doc[w]
            with np.errstate(over="ignore"):
                noise = mix(keys[doc] + mix((w - self.doc_word[doc]).astype(U64) + U64(salt) * U64(0x9E3779B97F4A7C15)))
            live, e, n, steps = np.arange(len(w)), self.top[w], np.zeros(len(w), np.int64), []
            while len(live):
                with np.errstate(over="ignore"):
                    u = (mix(noise + U64(len(steps)) * U64(0xD1B54A32D192ED03)) >> U64(11)) / float(1 << 53)
                above = np.flatnonzero(u < low[e])
                while len(above):
                    e[above] -= 1
                    above = above[u[above] < low[e[above]]]
                steps.append((live, e))
                n[live] += 1
                e = after[e]
                on = np.flatnonzero(e >= 0)
                live, e, noise = live[on], e[on], noise[on]
            first = np.cumsum(n) - n
            flat = np.empty(int(n.sum()), np.int32)
            for t, (live, e) in enumerate(steps):
                flat[first[live] + t] = e
            parts.append(flat)
            counts.append(n)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.cumsum(np.concatenate(counts))

    def spell(self, doc: int, path: np.ndarray) -> np.ndarray:
        """The ids of a segmentation with lone characters in byte pieces."""
        ids = self.v.words.ids[path]
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids
        sizes = self.v.words.size[path].astype(np.int64)
        begin = self.start[self.doc_word[doc]] + np.cumsum(sizes) - sizes
        parts, last = [], 0
        for i in lone:
            p = int(self.points[begin[i]])
            spelled = chr(MARK if p == _LITERAL else p).encode("utf-8", "surrogatepass")
            parts += [ids[last:i], self.v.byte_ids[np.frombuffer(spelled, np.uint8)].astype(np.int32)]
            last = i + 1
        return np.concatenate([*parts, ids[last:]])


def _gumbel_under(phi: np.ndarray, top: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Largest perturbed value of sets of log mass phi, given that it is at most top."""
    x = phi - np.log(-np.log(u))
    return np.where(np.isfinite(phi), -np.logaddexp(-top, -x), -np.inf)


def _uniform(keys: np.ndarray) -> np.ndarray:
    return ((mix(keys) >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class _Search:
    """The heap of one document: sets of siblings off the segmentations found so far."""

    def __init__(self, batch: Batch, doc: int, key: np.uint64, k: int):
        self.b, self.doc, self.key, self.k = batch, doc, key, k
        self.found: list[tuple[np.ndarray, float]] = []  # edges and value
        self.heap: list[tuple[float, int, int, tuple[int, ...]]] = []

    def salted(self, *salt: int) -> int:
        h = int(self.key)
        for s in salt:
            h = ((h ^ (s + 1)) * 0xA0761D6478BD642F + (h >> 29)) & 0xFFFFFFFFFFFFFFFF
        return h

    def _draw(self, n: int, *salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _uniform(U64(self.salted(*salt)) + np.arange(n, dtype=U64) * U64(0xE7037ED1A0B428DB))

    def branch(self) -> tuple[_Search, np.ndarray, int, float, int]:
        """Open the best set: its best member goes on, the rest is a set again. The new segmentation to the end of the word that differs, that word, value and since, for add()."""
        value, path, t, gone = heapq.heappop(self.heap)
        value, before, e = -value, self.found[path][0][:t], int(self.found[path][0][t])
        b, s = self.b, self.b.v.words
        at = b.start[b.doc_word[self.doc]] + int(s.size[before].sum(dtype=np.int64))
        w = int(np.searchsorted(b.start, at, side="right") - 1)
        lo, hi = e - int(s.slot[e]), e + int(s.more[e]) + 1
        open_ = np.diff(s.low[lo:hi], append=1.0)
        open_[list(gone)] = 0
        mass = open_.sum()
        u = self._draw(16, 2, len(self.found)).tolist()
        pick = int(min(np.searchsorted(np.cumsum(open_) / mass, u[0], side="right"), np.flatnonzero(open_)[-1]))
        left = mass - open_[pick]
        if left > 1e-13:
            rest = float(_gumbel_under(np.array([s.logc[before].sum() + np.log(left)]), value, np.array(u[1:2]))[0])
            heapq.heappush(self.heap, (-rest, path, t, (*gone, pick)))
        new, place, i = [lo + pick], int(at - b.start[w]) + int(s.size[lo + pick]), 2
        while (e := int(s.next[new[-1]])) >= 0:
            if i == len(u):
                u, i = self._draw(16, 3, len(self.found), place).tolist(), 0
            while u[i] < s.low[e]:
                e -= 1
            new.append(e)
            place, i = place + int(s.size[e]), i + 1
        return self, np.concatenate([before, np.array(new, np.int32)]), w, value, t + 1


def add(news: list[tuple[_Search, np.ndarray, float, int]], k: int) -> None:
    """Give searches a new segmentation each: (search, edges, value, since).

    Its siblings from edge `since` on are new sets, and only the best of them can
    matter. A set so much lighter than the heaviest of its text that it could overtake
    it with a chance below e^-80 gets no value.
    """
    for s, path, value, _ in news:
        s.found.append((path, value))
    news = [x for x in news if len(x[1]) > x[3]]
    if not news:
        return
    w = news[0][0].b.v.words
    n = np.array([len(x[1]) for x in news])
    begin = np.cumsum(n) - n
    path = np.concatenate([x[1] for x in news])
    of, logc, phi = np.repeat(np.arange(len(news)), n), w.logc[path], w.others[path]
    place, ends = np.arange(len(path)) - begin[of], np.empty(len(path))
    for lo, hi in zip(begin.tolist(), (begin + n).tolist(), strict=True):  # text by text, so that no rounding depends on the batch
        np.cumsum(logc[lo:hi], out=ends[lo:hi])
    phi += ends - logc
    phi[place < np.array([x[3] for x in news])[of]] = -np.inf
    at = np.flatnonzero(phi > np.maximum.reduceat(phi, begin)[of] - 80)
    with np.errstate(over="ignore"):
        seeds = np.array([x[0].salted(1, len(x[0].found) - 1) for x in news], U64)
        u = _uniform(seeds[of[at]] + place[at].astype(U64) * U64(0xE7037ED1A0B428DB))
    g = _gumbel_under(phi[at], np.array([x[2] for x in news])[of[at]], u)
    cuts = np.searchsorted(of[at], np.arange(len(news) + 1))
    for (s, path, *_), lo, hi in zip(news, cuts[:-1], cuts[1:], strict=True):
        best = np.arange(lo, hi) if hi - lo <= k + 1 else lo + np.argpartition(-g[lo:hi], k)[: k + 1]
        for j in best:
            t = int(place[at[j]])
            heapq.heappush(s.heap, (-float(g[j]), len(s.found) - 1, t, (int(w.slot[path[t]]),)))


def encode_batch(v: Vocabulary, texts: list[str | None], row_keys: np.ndarray, k: int, seed: int) -> list[list[dict]]:
    """For each text up to k distinct segmentations, by perturbed value."""
    b = Batch(v, texts)
    keys = mix(row_keys.astype(U64) ^ seeded(1, seed)[0])
    roots = -np.log(-np.log(_uniform(keys ^ U64(0x2545F4914F6CDD1D))))
    searches = [_Search(b, d, keys[d], k) for d in range(len(texts))]
    flat, first = b.sample(np.arange(len(b.top)), keys, 0)
    cuts = first[b.doc_word]
    add([(s, flat[lo:hi], float(roots[d]), 0) for d, (s, lo, hi) in enumerate(zip(searches, cuts[:-1], cuts[1:], strict=True))], k)
    for r in range(1, k):  # only the words after the one that differs are sampled anew
        news = [s.branch() for s in searches if s.heap]
        begin = np.array([w + 1 for _, _, w, _, _ in news], np.int64)
        n = np.array([b.doc_word[s.doc + 1] for s, *_ in news], np.int64) - begin
        ends = np.cumsum(n)
        flat, first = b.sample(np.repeat(begin - ends + n, n) + np.arange(int(n.sum())), keys, r)
        add([(s, np.concatenate([head, flat[first[z - m] : first[z]]]), value, since) for (s, head, _, value, since), m, z in zip(news, n, ends, strict=True)], k)
    out = []
    for d, s in enumerate(searches):
        kappa = -s.heap[0][0] if s.heap and len(s.found) == k else -np.inf
        rows = []
        for j, (path, value) in enumerate(s.found):
            phi = float(v.words.logc[path].sum())
            over = phi - kappa
            log_inclusion = 0.0 if over > 5 else over if over < -30 else float(np.log(-np.expm1(-np.exp(over))))
            rows.append({"sample": j, "ids": b.spell(d, path), "log_prob": phi, "perturbed": value, "log_inclusion": log_inclusion})
        out.append(rows)
    return out


def decode_all(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of the texts of sequences of ids; the mark that encoding puts first goes."""
    ids = ids.astype(np.int64)
    ids[offsets[:-1][np.diff(offsets) > 0]] += v.size
    got = v.pieces.take(pa.array(ids))
    ends = np.frombuffer(got.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    raw = got.buffers()[2]
    return np.frombuffer(raw, np.uint8)[: ends[-1]] if raw is not None and ends[-1] else np.zeros(0, np.uint8), ends[offsets]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    return decode_all(v, np.asarray(ids), np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "surrogatepass")


_SAMPLES = "array<struct<sample:int,ids:array<int>,log_prob:double,perturbed:double,log_inclusion:double>>"


def encode_samples(docs: DataFrame, k: int = 2, seed: int = 13, model: str = MODEL) -> DataFrame:
    """doc_id, text and one row for each sampled segmentation: sample, ids, log_prob, perturbed, log_inclusion."""
    small_batches(docs.sparkSession, "600")

    def run(key: pa.Array, text: pa.Array) -> pa.Array:
        rows = encode_batch(vocabulary(model), text.to_pylist(), key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), k, seed)
        flat = [x for r in rows for x in r]
        off = np.concatenate([[0], np.cumsum([len(x["ids"]) for x in flat])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([x["ids"] for x in flat]).astype(np.int32) if flat else np.zeros(0, np.int32)))
        column = lambda c, t: pa.array([x[c] for x in flat], t)
        items = pa.StructArray.from_arrays(
            [column("sample", pa.int32()), ids, *(column(c, pa.float64()) for c in ("log_prob", "perturbed", "log_inclusion"))], names=["sample", "ids", "log_prob", "perturbed", "log_inclusion"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)), items)

    found = docs.select("doc_id", "text", F.explode(F.arrow_udf(run, _SAMPLES)(F.col("doc_id").cast("long"), "text")).alias("s"))
    return found.select("doc_id", "text", "s.*")


def decode_ids(ids_col: str, model: str = MODEL):
    """Column of the texts that sequences of ids spell."""
    def run(ids: pa.Array) -> pa.Array:
        lists = ids.fill_null(pa.scalar([], ids.type))
        off = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
        raw, cuts = decode_all(vocabulary(model), flat, off - off[0])
        return pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())).cast(pa.string())

    return F.arrow_udf(run, "string")(F.col(ids_col))


def op3_gumbel_pieces(spark, sf_dir: str) -> DataFrame:
    """Digest of two sampled segmentations of every document, and whether they decode to its text."""
    rows = encode_samples(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumn("back", decode_ids("ids")).select(
        "doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "log_inclusion",
        (F.col("back") == F.coalesce("text", F.lit(""))).alias("round_trip"))

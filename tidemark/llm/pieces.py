"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text falls into units that no piece crosses (a run of blanks with what follows up to the next blank or line end). For
each distinct unit of a batch, forward filtering gives the total weight of all segmentations that end at each character;
backward sampling then draws each occurrence's last piece, the one before it, and so on, in one vectorised search for
all occurrences of the batch. The random numbers are hashes of seed, row key, unit and step: the same row always gets
the same segmentation, on any machine and in any order. Weights are Zipf's law over the vocabulary's rank,
(rank + 10) ** -alpha; with sample=False the heaviest segmentation is taken. The vocabulary file is a parameter.

Characters without a piece become byte pieces. A blank is the piece mark; a mark that stands in the text itself becomes
bytes, so that decoding restores every text exactly. Defined results: a null text gives null pieces; an empty text gives
an empty list; a null key draws as key 0; texts are encoded whole; repeated rows give equal results; further columns
pass through; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import M3, arrow_rows, kept, list_array, mix, table, with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MOST_EDGES = 3_000_000  # of lattices that a worker keeps
_UNIT = re.compile(r" *[^ \n]+| +|\n+")


class Lattice:
    """Vocabulary as a hashed trie in arrays, and filtered units by text."""

    def __init__(self, proto: bytes, alpha: float = 1.0, sample: bool = True, seed: int = 1):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.sample, self.seed = sample, np.uint64(seed)
        self.raw: list[bytes] = []  # what each id decodes to
        self.byte_id = [0] * 256
        trie: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, float]] = {}
        weights = np.zeros(sp.vocab_size())
        for i in range(sp.vocab_size()):
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(s[3:5], 16)] = i
                self.raw.append(bytes([int(s[3:5], 16)]))
                continue
            s = s.replace(MARK, " ")
            self.raw.append(b"" if sp.is_control(i) or sp.is_unknown(i) else s.encode())
            # A piece with a blank after another character, or with a line end, would cross units.
            if sp.is_control(i) or sp.is_unknown(i) or not s or "\n" in s or " " in s.lstrip(" ") or " " in s.strip(" "):
                continue
            weights[i] = -alpha * np.log(max(0.0, -sp.get_score(i)) + 10)
            node = 0
            for c in map(ord, s):
                node = trie.setdefault((node, c), len(trie) + 1)
            ends[node] = (i, weights[i])
        # Trie edges in an open table of a load below 0.2: a step costs a look or two instead of a binary search.
        self.bits = max(10, (len(trie) * 5).bit_length())
        self.keys, self.to = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int64)
        for (a, ch), to in trie.items():
            k = (a << 21) | ch
            at = int(self._slot(np.array([k], np.int64))[0])
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.to[at] = k, to
        self.piece = np.full(len(trie) + 1, -1, np.int64)
        self.weight = np.zeros(len(trie) + 1)
        for node, (i, w) in ends.items():
            self.piece[node], self.weight[node] = i, w
        self.lone = -alpha * np.log(sp.vocab_size() * 4.0)  # of a byte
        self.reset()

    def _put(self, name: str, at: int, new: np.ndarray) -> None:
        """Writes new at a place of an array, which doubles when it is full."""
        old = getattr(self, name)
        while len(old) < at + len(new):
            old = np.concatenate([old, np.zeros_like(old)])
        old[at : at + len(new)] = new
        setattr(self, name, old)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * M3) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, key: np.ndarray) -> np.ndarray:
        """The nodes that trie edges lead to, -1 where there is none."""
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.to[at], -1)
        on = np.flatnonzero((got != key) & (got >= 0))
        while len(on):  # slots that other edges took
            at[on] += 1
            got = self.keys[at[on]]
            hit = got == key[on]
            out[on[hit]] = self.to[at[on[hit]]]
            on = on[~hit & (got >= 0)]
        return out

    def reset(self) -> None:
        self.unit: dict[str, int] = {}
        self.last = np.zeros(0, np.int64)  # the end node of each unit
        self.cdf, self.prev, self.edge = np.zeros(1 << 16), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)  # by edge, edges by end node
        self.first = np.zeros(1 << 16, np.int32)  # edge of each node
        self.edges = 0
        self.nodes = 0
        self.fallback: list[bytes] = []

    def learn(self, texts: list[str]) -> None:
        """Builds the lattices of new units and filters forward; edges are kept by end node, with a running share of its weight."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(texts)), size)
        pos = np.arange(len(chars)) - first[of]  # within the unit
        base = first + np.arange(len(texts))  # a unit of n characters has n + 1 nodes
        start = base[of] + pos
        # All starts walk the trie together, a character a step.
        live, node, depth = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        a, b, w, what = [], [], [], []
        covered = np.zeros(len(chars), bool)
        while len(live):
            to = self._step((node << 21) | chars[live + depth])
            hit = to >= 0
            live, node = live[hit], to[hit]
            depth += 1
            done = self.piece[node] >= 0
            a.append(start[live[done]])
            b.append(start[live[done]] + depth)
            w.append(self.weight[node[done]])
            what.append(self.piece[node[done]])
            if depth == 1:
                covered[live[done]] = True
            more = pos[live] + depth < size[of[live]]
            live, node = live[more], node[more]
        for i in np.flatnonzero(~covered):  # no piece of one character: its bytes
            s = chr(chars[i]).encode()
            a.append([start[i]])
            b.append([start[i] + 1])
            w.append([self.lone * len(s)])
            if len(s) == 1:
                what.append([self.byte_id[s[0]]])
            else:
                what.append([-1 - len(self.fallback)])
                self.fallback.append(s)
        a, b, w, what = (np.concatenate(x) for x in (a, b, w, what))
        order = np.argsort(b * 128 - (b - a))  # by end, the longest first; no piece has 128 characters
        a, b, w, what = a[order], b[order], w[order], what[order].astype(np.int64)
        alpha = np.full(len(chars) + len(texts), -np.inf)
        alpha[base] = 0.0
        # End nodes at the same distance from their unit's begin are filtered together.
        dist = b - np.repeat(base, size + 1)[b]
        by = np.argsort(dist.astype(np.uint16) if len(dist) and dist.max() < 65536 else dist, kind="stable")
        bounds = np.searchsorted(dist[by], np.arange(1, (size.max() if len(size) else 0) + 2))
        score = np.empty(len(a))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            e = by[lo:hi]
            if not len(e):
                continue
            x = alpha[a[e]] + w[e]
            score[e] = x
            heads = np.flatnonzero(np.diff(b[e], prepend=-1))
            top = np.maximum.reduceat(x, heads)
            n = np.diff(np.append(heads, len(e)))
            if self.sample:
                alpha[b[e[heads]]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, n)), heads))
            else:
                alpha[b[e[heads]]] = top
        heads = np.flatnonzero(np.diff(b, prepend=-1))
        n = np.diff(np.append(heads, len(b)))
        if self.sample:
            share = np.exp(score - alpha[b])
            run = np.cumsum(share)
            cum = run - np.repeat(run[heads] - share[heads], n)
        else:
            best = score >= alpha[b]
            cum = (np.cumsum(best) - np.repeat(np.cumsum(best)[heads] - best[heads], n) > 0).astype(float)
        cum = np.clip(cum, 0, 1)
        cum[np.append(heads[1:], len(b)) - 1 if len(b) else heads] = 1.0
        begin = np.zeros(len(chars) + len(texts), np.int64)
        begin[b[heads]] = heads + self.edges
        self._put("first", self.nodes, begin)
        self._put("cdf", self.edges, cum)
        self._put("prev", self.edges, np.where(a == np.repeat(base, size + 1)[a], -1, a + self.nodes))
        self._put("edge", self.edges, what)
        self.edges += len(b)
        self.last = np.concatenate([self.last, base + size + self.nodes])
        for i, t in enumerate(texts):
            self.unit[t] = len(self.unit)
        self.nodes += len(chars) + len(texts)

    def encode(self, texts: list[str], keys: list[int | None]) -> list[np.ndarray]:
        split = [_UNIT.findall(t) for t in texts]
        if self.edges > MOST_EDGES:
            self.reset()
        new = set().union(*split).difference(self.unit) if split else set()
        if new:
            self.learn(sorted(new))
        count = np.fromiter(map(len, split), np.int64, len(split))
        occ = np.fromiter(map(self.unit.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
        k = np.array([0 if x is None else int(x) & 0xFFFFFFFFFFFFFFFF for x in keys], np.uint64)
        nth = np.arange(len(occ)) - np.repeat(np.cumsum(count) - count, count)
        seed = mix(np.repeat(mix(k * M3 + self.seed), count) + nth.astype(np.uint64) * M3)
        live, node, steps = np.arange(len(occ)), self.last[occ], []
        made = np.zeros(len(occ), np.int64)
        while len(live):
            u = (mix(seed[live] + np.array(len(steps) + 1, np.uint64).reshape(1) * M3) >> np.uint64(11)).astype(float) / float(1 << 53)
            e = self.first[node]
            on = np.flatnonzero(u >= self.cdf[e])
            while len(on):  # the shares of a node's edges run up to 1
                e[on] += 1
                on = on[u[on] >= self.cdf[e[on]]]
            steps.append((live, e))
            made[live] += 1
            node = self.prev[e]
            live, node = live[node >= 0], node[node >= 0]
        out = np.empty(int(made.sum()), np.int64)
        end = np.cumsum(made)
        for j, (who, e) in enumerate(steps):  # drawn from the last piece on
            out[end[who] - 1 - j] = self.edge[e]
        of_text = np.add.reduceat(np.append(made, 0), np.minimum(np.cumsum(count) - count, len(made))) * (count > 0) if len(count) else made
        got = np.split(out, np.cumsum(of_text)[:-1]) if len(count) else []
        return [self._bytes(x) if (x < 0).any() else x for x in got]

    def _bytes(self, x: np.ndarray) -> np.ndarray:
        """x with characters that have no piece (negative) as the pieces of their bytes."""
        at = np.flatnonzero(x < 0)
        own = [[self.byte_id[b] for b in self.fallback[-1 - i]] for i in x[at].tolist()]
        size = np.ones(len(x), np.int64)
        size[at] = [len(o) for o in own]
        out = np.repeat(x, size)
        out[np.repeat(x < 0, size)] = list(chain.from_iterable(own))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode()


def read_model(path: str = MODEL) -> bytes:
    """The vocabulary file, read on the driver; it is of a fixed size (about half a megabyte) and goes with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL, alpha: float = 1.0, sample: bool = True, seed: int = 1) -> DataFrame:
    """docs with pieces (ids), n_pieces, and lossless: whether decoding gives the text back."""
    proto = read_model(path)

    def each(texts: list, keys: list) -> list:
        lat, pieces = kept(("lattice", hash(proto), alpha, sample, seed), lambda: Lattice(proto, alpha, sample, seed)), [None] * len(texts)
        some = [i for i, t in enumerate(texts) if t is not None]
        at = 0
        while at < len(some):  # up to a million characters at a time, a longer text alone
            n, to = 0, at
            while to < len(some) and (to == at or n + len(texts[some[to]]) <= 1_000_000):
                n += len(texts[some[to]])
                to += 1
            for i, p in zip(some[at:to], lat.encode([texts[i] for i in some[at:to]], [keys[i] for i in some[at:to]]), strict=True):
                pieces[i] = p
            at = to
        same = [None if p is None else lat.decode(p.tolist()) == t for p, t in zip(pieces, texts, strict=True)]
        return [list_array(pieces), [None if p is None else len(p) for p in pieces], same]

    return with_columns(docs, [text, key], "pieces array<int>, n_pieces long, lossless boolean", each)


def decode(df: DataFrame, pieces: str = "pieces", path: str = MODEL) -> DataFrame:
    """df with decoded: the text of each list of ids."""
    proto = read_model(path)

    def each(rows: list) -> list:
        lat = kept(("lattice", hash(proto), 1.0, True, 1), lambda: Lattice(proto))
        return [[None if p is None else lat.decode(p) for p in rows]]

    return with_columns(df, [pieces], "decoded string", each)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_pieces", "lossless", "pieces")

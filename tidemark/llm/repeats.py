"""Suffix-array dedup: repeats of at least MIN bytes, and passages of over 50 words, by the interval tree of an enhanced suffix array.

1. Anchors. Of the gram strings of each window of the least length, the one of the smallest hash (the leftmost of equals)
   is the window's anchor. Equal windows have equal anchors at equal places, and a long text has few anchors. An anchor
   that neither another text nor another place has means that its windows occur once. There are two kinds: BYTES, the
   windows of MIN bytes whose repetition is removed, and WORDS, windows of 51 words, which find the passages.
2. Segments. For each other anchor, the windows that it stands for, as one string. A segment that occurs twice is
   repeated as a whole, and only distinct segments are compared further, by anchor.
3. Suffix arrays. A task concatenates the segments of whole anchors, sorts the suffixes by doubling ranks, takes common
   prefixes from the ranks, and scans the LCP intervals of at least the least length with a stack. Each suffix is covered
   over the length of its innermost interval; for passages, of its innermost interval that two documents share. An anchor
   of more than LARGE distinct segments is cut into ranges of windows first (descend()), until each task's share is that
   small: the same arrays, on shorter strings.
4. Coverage goes back to the texts by their hash; overlapping parts are merged and removed.

repeat_groups() gives the groups themselves: left-diverse intervals, those whose occurrences differ in the byte before
them, with all occurrences in all documents. A group is clipped to its anchor's segment, so that a long repeat is a row of
overlapping groups.

Texts are judged as given. Equal texts are one text of many occurrences from the start. Ranges of large anchors, words,
whole texts, and the segments of one text are told apart by hashes of 64 bits (words: 32), segments of different texts by
content. Long texts are gone through in pieces, and a run of equal segments, as periodic texts have, is kept once. Defined results: a null text is empty;
texts shorter than MIN keep all; texts of any length are whole; repeated rows of 400 bytes or more remove all; of over 50
words they are passages; a null doc_id is a document like others; an empty table gives an empty one; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import M2, M3, MOST_TASKS, arrow_rows, bucket_count, discard, emit, kept, lists, mix, places, runs, shared_dir, staged, table

MIN, GRAM = 400, 64
LARGE = 200  # distinct segments of an anchor that one task compares
BATCH = 1 << 20  # bytes of segments in one suffix array
PIECE = 1 << 21  # symbols of a text whose anchors are sought at once
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * M2)
_STEP = [mix(np.array([i + 77], np.uint64)) | np.uint64(1) for i in range(8)]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_P = 0x9E3779B97F4A7C15  # odd: it has an inverse among 64-bit words


@dataclass(frozen=True)
class Kind:
    """What repeats: symbols of `unit` bytes; the shortest repeat, an anchor's gram, and ranges of windows, in symbols."""

    code: int
    unit: int
    least: int
    gram: int
    widths: tuple[int, int, int]


BYTES, WORDS = Kind(0, 1, MIN, GRAM, (64, 8, 1)), Kind(1, 4, 51, 8, (16, 4, 1))
KINDS = (BYTES, WORDS)
SHORTEST = 101  # bytes of the shortest text that can have 51 words


def _of_kind(of) -> F.Column:
    return F.when(F.col("kind") == BYTES.code, of(BYTES)).otherwise(of(WORDS))


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all strings of gram symbols from hashes of the symbols, by doubling."""
    k, i = 1, 0
    while k < gram:
        h = h[:-k] * _STEP[i] + h[k:]
        k, i = 2 * k, i + 1
        if k == 8:
            h = mix(h)
    return mix(h)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _P and of its inverse."""
    size = 1 << max(20, (n - 1).bit_length())

    def make():
        out = []
        for q in (_P, pow(_P, -1, 1 << 64)):
            x = np.full(size, np.uint64(q))
            x[0] = 1
            out.append(np.cumprod(x))
        return out

    return tuple(x[:n] for x in kept(f"powers{size}", make))


def word_symbols(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts that x concatenates, as 32-bit hashes, and the texts' ends among them: differences of prefix hashes, without a loop."""
    if not len(x):
        return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
    word = ~_SPACE[x]
    edge = np.zeros(len(x) + 1, bool)  # before each byte: whether a text begins there
    edge[0] = edge[-1] = True
    edge[ends] = True
    a = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    z = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]])))
    up, down = powers(len(x))
    total = np.cumsum(_BYTE[x] * up)
    h = (total[z] - np.where(a > 0, total[np.maximum(a - 1, 0)], np.uint64(0))) * down[a]
    return (mix(h) >> np.uint64(32)).astype(np.uint32), np.searchsorted(a, ends)


def anchors(h: np.ndarray, ends: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, hash) of the anchors of texts that end at ends. h: hashes of their symbols."""
    none = np.zeros(0, np.int64)
    n = len(h) - kind.least + 1
    if n < 1:
        return none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(h, kind.gram)
    w = kind.least - kind.gram + 1
    place = np.uint64((1 << 28) - 1)
    key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % w
    blocks = np.concatenate([key, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    at = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & place).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    ok = np.zeros(n + 1, np.int64)  # windows within one text
    long = ends - starts >= kind.least
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, ends[long] - kind.least + 1, -1)
    valid = np.cumsum(ok)[:n] > 0
    i = np.flatnonzero(valid)
    if not len(i):
        return none, none, none, np.zeros(0, np.uint64)
    new = np.concatenate([[True], (at[i][1:] != at[i][:-1]) | (np.diff(i) > 1)])
    first = i[new]
    last = np.append(i[np.flatnonzero(new)[1:] - 1], i[-1])
    p = at[first]
    return p, first, last, h[p]


def enhanced(x: np.ndarray, start: np.ndarray, part: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the suffixes at start by their first `depth` bytes at least, and common prefixes with the one before.

    part: the bounds that suffixes end at.
    """
    n = len(x)
    stop = part[np.searchsorted(part, np.arange(n), side="right")]
    near = stop - np.arange(n)
    if x.dtype != np.uint8:
        k, rank = 1, places(x)
    else:
        # Beyond a part's end, a symbol of its own stands for each place: suffixes of different parts differ there.
        words = np.zeros(n, np.uint64)
        padded = np.concatenate([x.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
        for j in range(7):  # 7 symbols of 9 bits
            s = padded[j : j + n].copy()
            s[near <= j] = 0
            words = (words << np.uint64(9)) | s
        k, rank = 7, places(words)
        del words, padded
    base, levels = k, [(k, rank)]
    ary, bits = (3, 21) if n < (1 << 21) - 1 else (2, 32)  # so many ranks side by side make the next one

    def side_by_side(at: np.ndarray) -> np.ndarray:
        key = rank[at].astype(np.int64)
        for i in range(1, ary):
            nxt, ok = np.zeros(len(at), np.int64), near[at] > i * k
            nxt[ok] = rank[at[ok] + i * k] + 1  # 0: beyond the part
            key = (key << bits) | nxt
        return key

    every = np.arange(n)
    while ary * k < depth:
        rank = places(side_by_side(every))
        k *= ary
        levels.append((k, rank))
    order = np.argsort(side_by_side(start), kind="stable")  # only the suffixes asked for need the last order
    sa = start[order]
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    for k, rank in levels[::-1]:
        on, times = np.arange(len(a)), 0
        while len(on) and (k == levels[-1][0] or times < ary - 1):  # the longest step as often as it fits, each shorter one ary - 1 times
            i, j = a[on] + lcp[on], b[on] + lcp[on]
            ok = (near[a[on]] - lcp[on] >= k) & (near[b[on]] - lcp[on] >= k)
            on, i, j = on[ok], i[ok], j[ok]
            on = on[rank[i] == rank[j]]
            lcp[on] += k
            times += 1
    for _ in range(base if base > 1 else 0):
        ia, ib = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        same = (near[a] > lcp) & (near[b] > lcp) & (x[ia] == x[ib])
        lcp[same] += 1
    return sa, lcp


def intervals(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int):
    """LCP intervals: (length, first and last place in sa, places in sa that no inner interval has, whether it is left-diverse).

    before: for each suffix of sa what stands before it; negative values differ from all others.
    """
    hot = np.flatnonzero(lcp >= least)
    if not len(hot):
        return
    cut = np.flatnonzero(np.diff(hot) > 1)
    for lo, hi in zip(np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(hot) - 1]]), strict=True):
        first, last = int(hot[lo]), int(hot[hi]) + 1
        heights, left = lcp[first:last].tolist(), before[first : last + 1].tolist()
        stack: list[list] = []  # length, first place, what stands before all or None, own places
        pending = [(first, left[0])]
        for j, h in enumerate([*heights, 0]):
            lb, child = None, None
            while stack and stack[-1][0] > h:
                top = stack.pop()
                if pending:
                    _join(top, pending)
                    pending = []
                yield top[0], top[1], first + j, top[3], top[2] is None
                lb, child = top[1], top
                if stack and stack[-1][0] >= h:
                    if child[2] is None or stack[-1][2] != child[2]:
                        stack[-1][2] = None
                    child = None
            if h >= least:
                if not stack or stack[-1][0] < h:
                    new = [h, lb if lb is not None else pending[0][0], child[2] if child else pending[0][1], []]
                    stack.append(new)
                elif child is not None and (child[2] is None or stack[-1][2] != child[2]):
                    stack[-1][2] = None
                if pending:
                    _join(stack[-1], pending)
                pending = [(first + j + 1, left[j + 1])]


def _join(top: list, places: list[tuple[int, int]]) -> None:
    for p, c in places:
        top[3].append(p)
        if top[2] is not None and (c != top[2] or c < 0):
            top[2] = None


def maximal_repeats(texts: list[bytes], least: int = MIN) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of at least `least` bytes: (length, [(text, offset), ...])."""
    x = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    if not len(x):
        return []
    starts = np.arange(len(x))
    starts = starts[ends[np.searchsorted(ends, starts, side="right")] - starts >= least]
    if len(starts) < 2:
        return []
    sa, lcp = enhanced(x, starts, ends, max(map(len, texts)))
    begin = ends - np.array([len(t) for t in texts])
    of = np.searchsorted(ends, sa, side="right")
    before = np.where(sa == begin[of], -1 - np.arange(len(sa)), x[np.maximum(sa - 1, 0)].astype(np.int64))
    return [(n, [(int(of[i]), int(sa[i] - begin[of[i]])) for i in range(lb, rb + 1)]) for n, lb, rb, _, diverse in intervals(sa, lcp, before, least) if diverse]


def _array(segs: list[bytes], kind: Kind, whole: bool = False):
    """Suffix array of the windows of segments, in order of at least their least length (whole: of all they have): symbols, ends, suffixes, common prefixes, segment of each suffix, symbol before it (negative: none)."""
    x = np.frombuffer(b"".join(segs), np.uint8 if kind is BYTES else np.uint32)
    size = np.array([len(s) // kind.unit for s in segs], np.int64)
    ends = np.cumsum(size)
    count = size - kind.least + 1
    starts = np.repeat(ends - size, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    sa, lcp = enhanced(x, starts, ends, int(size.max()) if whole else kind.least)
    of = np.searchsorted(ends, sa, side="right")
    before = np.where(sa == (ends - size)[of], -1 - np.arange(len(sa)), x[np.maximum(sa - 1, 0)].astype(np.int64))
    return x, size, ends, sa, lcp, of, before


def shares(lcp: np.ndarray, who: np.ndarray | None) -> np.ndarray:
    """Length of each suffix's innermost interval; with who (the document of each suffix), of the innermost that two documents have.

    It is the longer of the common prefixes with the nearest suffixes before and behind, of another document with who: the
    least of the prefixes on the way there, taken over runs of a document.
    """
    n = len(lcp) + 1
    ahead, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ahead[1:], behind[:-1] = lcp, lcp
    if who is not None:
        run = np.cumsum(np.append(False, who[1:] != who[:-1])) * (int(lcp.max(initial=0)) + 1)  # later runs lie below all earlier ones
        ahead = np.minimum.accumulate(ahead - run) + run
        run = run[-1] - run[::-1]
        behind = (np.minimum.accumulate(behind[::-1] - run) + run)[::-1]
    return np.maximum(ahead, behind)


def covered(segs: list[bytes], kind: Kind = BYTES, docs: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """For each segment, merged parts (begin, end) that repeats among the segments cover. docs: the document of each segment, where only repeats of two documents count."""
    x, size, ends, sa, lcp, of, _ = _array(segs, kind)
    begin = ends - size
    # Order beyond the least length isn't needed: what a longer repeat covers further on, suffixes that begin later show.
    n = shares(lcp, None if docs is None else np.array(docs)[of])
    hot = n >= kind.least
    delta = np.bincount(sa[hot], minlength=len(x) + 1) - np.bincount((sa + n)[hot], minlength=len(x) + 1)
    on = np.concatenate([[0], (np.cumsum(delta[:-1]) > 0).astype(np.int8), [0]])
    out: list[list[tuple[int, int]]] = [[] for _ in segs]
    a, b = np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        while i < j:  # parts of neighbouring segments touch
            s = int(np.searchsorted(ends, i, side="right"))
            e = min(j, int(ends[s]))
            out[s].append((i - int(begin[s]), e - int(begin[s])))
            i = e
    return out


def _slices(texts: list, most: int = 2 << 20):
    """(first, texts as bytes) of parts of a batch of up to about most bytes."""
    part, n, at = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        if part and n + len(b) > most:
            yield at, part
            part, n, at = [], 0, i
        part.append(b)
        n += len(b)
    if part:
        yield at, part


def _symbols(part: list[bytes], kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts of a part, and the texts' ends; words are hashed some MB at a time, cut where a word ends."""
    if kind is BYTES:
        return np.frombuffer(b"".join(part), np.uint8), np.cumsum([len(b) for b in part]).astype(np.int64)
    if sum(map(len, part)) <= 2 * PIECE:
        return word_symbols(np.frombuffer(b"".join(part), np.uint8), np.cumsum([len(b) for b in part]).astype(np.int64))
    out, ends, n = [], [], 0
    for t in part:
        raw, at = np.frombuffer(t, np.uint8), 0
        while at < len(raw):
            to = min(len(raw), at + PIECE)
            gap = np.flatnonzero(_SPACE[raw[to : to + PIECE]]) if to < len(raw) else [0]
            to = to + int(gap[0]) if len(gap) else min(len(raw), to + PIECE)  # a word of more than PIECE bytes is cut: at equal places only if it is equal so far
            w, _ = word_symbols(raw[at:to], np.array([to - at]))
            out.append(w)
            n += len(w)
            at = to
        ends.append(n)
    return np.concatenate(out) if out else np.zeros(0, np.uint32), np.array(ends, np.int64)


def _found(part: list[bytes]):
    """kind, symbols, ends, first symbol and end of a piece, and its anchors: place, first and last window, hash, text. Anchors follow from their windows alone, so that pieces bound the memory of texts of any length and change nothing but where a segment ends."""
    for kind in KINDS:
        x, ends = _symbols(part, kind)
        for at in range(0, max(1, len(x)), PIECE):
            to = min(len(x), at + PIECE + kind.least - 1)
            h = _BYTE[x[at:to]] if kind is BYTES else mix(x[at:to].astype(np.uint64) + np.uint64(0x51ED27))
            p, first, last, g = anchors(h, np.clip(ends - at, 0, to - at), kind)
            yield kind, x, ends, at, to, p + at, first + at, last + at, g.view(np.int64), np.searchsorted(ends, first + at, side="right")


def _fingerprints(x: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hashes of the strings from a to z of x."""
    up, down = powers(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=total[1:])
    return mix((total[z] - total[a]) * down[a] + (z - a).astype(np.uint64) * M2)


def _distinct(h: np.ndarray, of: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (h, of), and whether one came more than once or was told to."""
    if not len(h):
        return h, of, again
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
    return h[heads], of[heads], (np.diff(np.append(heads, len(h))) > 1) | np.logical_or.reduceat(again[order], heads)


def profile(docs: DataFrame) -> DataFrame:
    """node, anchors, again (whether the text has an anchor of BYTES more than once) for each row of docs (node, text)."""

    def each(batches, out):
        for b in batches:
            nodes, texts = b.column("node").to_pylist(), b.column("text").to_pylist()
            for at, part in _slices(texts):
                hs, ofs, agains = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for kind, *_, h, of in _found(part):
                    h, of, again = _distinct(h, of, np.zeros(len(h), bool))
                    hs.append(h)
                    ofs.append(of)
                    agains.append(again & (kind is BYTES))
                h, of, again = _distinct(*map(np.concatenate, (hs, ofs, agains)))
                order = np.argsort(of, kind="stable")
                h, again = h[order], again[order]
                cut = np.searchsorted(of[order], np.arange(len(part) + 1))
                yield out([nodes[at : at + len(part)], [h[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)], [again[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]])

    return emit(docs, "node long, anchors array<long>, again array<boolean>", each)


SEGMENT = "h long, kind int, node long, start long, lead int, seg binary"


def segments(docs: DataFrame, every: bool = False) -> DataFrame:
    """Segments of docs (node, text, wanted: anchors) by SEGMENT, equal ones of a text once (every: each); seg is null where a text's own repetition covers bytes from start to lead."""

    def each(batches, out):
        rows: list[tuple] = []

        def flush():
            got = out(list(zip(*rows, strict=True)))
            rows.clear()
            return got

        for b in batches:
            nodes, texts, wanted = b.column("node").to_pylist(), b.column("text").to_pylist(), lists(b.column("wanted"))
            for at, part in _slices(texts):
                seen: dict[int, set[int]] = {}  # of each text, hashes of its segments
                own: dict[int, list[tuple]] = {}  # of each text, its segments' hashes and places, touching equal ones once
                for kind, x, ends, lo, hi, p, first, last, h, of in _found(part):
                    mine = [np.flatnonzero((of == i) & np.isin(h, wanted[at + i])) for i in np.unique(of)]
                    mine = np.concatenate(mine) if mine else np.zeros(0, np.int64)
                    if not len(mine):
                        continue
                    p, h, of, a, z = p[mine], h[mine], of[mine], first[mine], last[mine] + kind.least
                    key = mix(mix(h.view(np.uint64) + (p - a).astype(np.uint64) * M3) + _fingerprints(x[lo:hi], a - lo, z - lo) + np.uint64(kind.code))
                    begin = np.concatenate([[0], ends[:-1]])[of]
                    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
                    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        t = int(of[i])
                        if kind is BYTES and not every:
                            k, ka, kz = key[i:j], a[i:j] - begin[i:j], z[i:j] - begin[i:j]
                            heads = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (ka[1:] > kz[:-1])]))
                            ends_ = np.append(heads[1:], len(k)) - 1
                            own.setdefault(t, []).append((k[heads], ka[heads], kz[ends_], ends_ > heads))
                        new = np.arange(i, j) if every else i + np.sort(np.unique(key[i:j], return_index=True)[1])
                        known = seen.setdefault(t, set())
                        for n in new.tolist():
                            if every or int(key[n]) not in known:
                                known.add(int(key[n]))
                                rows.append((int(h[n]), kind.code, nodes[at + t], int(a[n] - begin[n]), int(p[n] - a[n]), x[a[n] : z[n]].tobytes()))
                                if len(rows) > 4000:
                                    yield flush()
                for t, found in own.items():  # runs of what the text itself repeats
                    k, a, z, twice = (np.concatenate(c) for c in zip(*found, strict=True))
                    _, back, count = np.unique(k, return_inverse=True, return_counts=True)
                    many = (count[back] > 1) | (np.bincount(back, weights=twice) > 0)[back]
                    a, z = a[many], np.maximum.accumulate(z[many])
                    heads = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))[: len(a)]
                    for i, j in zip(heads, np.append(heads[1:], len(a))[: len(heads)], strict=True):
                        rows.append((None, BYTES.code, nodes[at + t], int(a[i]), int(z[j - 1]), None))
        if rows:
            yield flush()

    return emit(docs, SEGMENT, each)


TASK = ("g", "kind", "h", "lead", "dig", "base", "seg", "twice", "lo", "same")


def descend(spark: SparkSession, pieces: DataFrame, folder: str) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Cuts anchors of very many segments into ranges of windows: (parts that repeats cover as a whole, groups for suffix arrays by TASK, pieces by their content `same`).

    pieces: h, kind, lead, dig, seg, lo, hi, a, b: the windows a to b of a segment. Windows are taken in ranges of fixed places
    by the anchor, narrower in each round. All windows of a range share a core: ranges whose core no other has are done, and
    so are ranges of which all with that core are equal. Up to LARGE different ones are a group for one suffix array; more go
    down to the next width, at last 1. What goes down are the few windows at the ends of repeats, so rows grow with the
    segments, not with their pairs.
    """
    covers, groups, members = [], [], []
    unit, least = _of_kind(lambda k: F.lit(k.unit)), _of_kind(lambda k: F.lit(k.least))
    part = lambda a, n: F.col("seg").substr((a * unit + 1).cast("int"), (n * unit).cast("int"))
    for i in range(3):
        w = _of_kind(lambda k: F.lit(k.widths[i]))  # noqa: B023
        df = pieces.withColumn("r", F.explode(F.sequence(F.floor((F.col("lead") - F.col("b")) / w).cast("int"), F.floor((F.col("lead") - F.col("a")) / w).cast("int"))))
        df = df.withColumn("top", F.col("lead") - F.col("r") * w)  # the range's last window, wherever the piece ends
        df = df.withColumn("a", F.greatest(F.col("a"), F.col("top") - (w - 1))).withColumn("b", F.least("b", "top"))
        df = df.withColumn("core", F.xxhash64("h", "r", part(F.col("top"), least - w + 1)))
        df = df.withColumn("same", F.xxhash64("core", F.col("top") - F.col("a"), part(F.col("a"), F.col("b") - F.col("a") + least)))
        df = staged(spark, df.select(*pieces.columns, "core", "same"), folder, f"ranges-{i}")
        one = F.min_by(F.struct(*pieces.columns), F.struct("dig", "lead", "a")).alias("one")
        twice = F.when(F.first("kind") == BYTES.code, F.count(F.lit(1)) > 1).otherwise(F.min("lo") != F.max("hi"))
        kinds = staged(spark, df.groupBy("core", "same").agg(twice.alias("twice"), one), folder, f"kinds-{i}", small=True)
        covers.append(df.join(kinds.where("twice").select("same"), "same").select("h", "kind", "lead", "dig", "a", (F.col("b") + least).alias("z"), F.col("same").alias("g")))
        members.append(df.select("same", "kind", "h", "lead", "dig", "a"))
        mixed = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.count_if(~F.col("twice")).alias("open")).where("k > 1 and open > 0")
        kinds = kinds.join(staged(spark, mixed.select("core", "k"), folder, f"mixed-{i}", small=True), "core").select("core", "k", "same", "twice", "one.*")
        few = kinds.where(F.col("k") <= LARGE)
        groups.append(few.select(F.col("core").alias("g"), "kind", "h", "lead", "dig", F.col("a").alias("base"), part(F.col("a"), F.col("b") - F.col("a") + least).alias("seg"), "twice", "lo", "same"))
        pieces = kinds.where(F.col("k") > LARGE).select(*pieces.columns)
    return covers, groups, members


def candidates(spark: SparkSession, docs: DataFrame, folder: str, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(segments, parts covered as a whole, groups for suffix arrays, pieces of cut anchors by content) of docs (node, text)."""
    prof = staged(spark, profile(docs.select("node", "text")), folder, "profile")
    seen = prof.select("node", F.explode(F.arrays_zip("anchors", "again")).alias("x")).select("node", F.col("x.anchors").alias("h"), F.col("x.again").alias("again"))
    many = seen.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("again").alias("again")).where("lo != hi or again").select("h")
    many = staged(spark, many, folder, "anchors", small=True)
    wanted = seen.select("node", "h").join(many, "h").groupBy("node").agg(F.collect_set("h").alias("wanted"))
    wanted = staged(spark, wanted, folder, "wanted")
    discard(spark, folder, "profile", "anchors")
    segs = staged(spark, segments(docs.join(wanted, "node").select("node", "text", "wanted"), every), folder, "segments")

    # Distinct segments of each anchor: what two texts have is covered; the others are compared if the anchor has several.
    dig = F.xxhash64("seg", "lead")
    distinct = segs.where("seg is not null").groupBy("h", "kind", "lead", "seg").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    distinct = staged(spark, distinct.withColumns({"twice": F.col("lo") != F.col("hi"), "dig": dig}), folder, "distinct")
    sizes = staged(spark, distinct.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.count_if(~F.col("twice")).alias("open")).where("c > 1 and open > 0").select("h", "c"), folder, "sizes", small=True)
    open_ = distinct.join(sizes, "h")
    least, unit = _of_kind(lambda k: F.lit(k.least)), _of_kind(lambda k: F.lit(k.unit))
    size = (F.octet_length("seg") / unit).cast("int")
    covers, groups, members = descend(spark, open_.where(F.col("c") > LARGE).select("h", "kind", "lead", "dig", "seg", "lo", "hi", F.lit(0).alias("a"), (size - least).alias("b")), folder)
    groups.append(open_.where(F.col("c") <= LARGE).select(F.col("h").alias("g"), "kind", "h", "lead", "dig", F.lit(0).alias("base"), "seg", "twice", "lo", F.lit(None).cast("long").alias("same")))
    covers.append(distinct.where("twice").select("h", "kind", "lead", "dig", F.lit(0).alias("a"), size.alias("z"), F.xxhash64("seg").alias("g")))
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    n = min(MOST_TASKS, bucket_count(spark, distinct, 8 << 20))
    return segs, union(covers), union(groups).repartition(n, "g").sortWithinPartitions("g"), union(members)


def batched(batches, flush, same: bool = False):
    """What flush(kind, rows) gives for the groups of batches sorted by g, as rows (kind, h, lead, seg, dig, twice, lo, base, and same if asked for), up to about BATCH bytes of a kind at a time."""
    rows, held = {k: [] for k in KINDS}, dict.fromkeys(KINDS, 0)
    for _, group in runs(batches, "g", ["kind", "h", "lead", "seg", "dig", "twice", "lo", "base", *(["same"] if same else [])]):
        kind = KINDS[group[0][0]]
        rows[kind] += group
        held[kind] += sum(len(r[3]) for r in group)
        if held[kind] >= BATCH:
            yield from flush(kind, rows[kind])
            rows[kind], held[kind] = [], 0
    for kind in KINDS:
        if rows[kind]:
            yield from flush(kind, rows[kind])


def repeated_parts(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """node, parts, passages: arrays of (begin, end) of docs (node, text, one row a node) that repeats cover: bytes, and words of passages."""
    segs, covers, groups, _ = candidates(spark, docs, folder)

    def compare(batches, out):
        def flush(kind, rows):
            # A segment of several documents is a document of its own: any interval with it has two.
            who = None if kind is BYTES else [-1 - i if r[5] else r[6] for i, r in enumerate(rows)]
            got = covered([r[3] for r in rows], kind, who)
            flat = [(r[1], r[0], r[2], r[4], r[7] + a, r[7] + z) for r, parts in zip(rows, got, strict=True) if not r[5] for a, z in parts]
            if flat:
                yield out(list(zip(*flat, strict=True)))

        yield from batched(batches, flush)

    cover = staged(spark, emit(groups.drop("same"), "h long, kind int, lead int, dig long, a int, z int", compare).unionByName(covers.drop("g")), folder, "cover")
    place = segs.where("seg is not null").select("h", "kind", "lead", "node", "start", F.xxhash64("seg", "lead").alias("dig"))
    back = place.join(cover, ["h", "kind", "lead", "dig"]).select("node", "kind", (F.col("start") + F.col("a")).alias("begin"), (F.col("start") + F.col("z")).alias("end"))
    own = segs.where("seg is null").select("node", "kind", F.col("start").alias("begin"), F.col("lead").cast("long").alias("end"))
    of = lambda k: F.sort_array(F.collect_set(F.when(F.col("kind") == k.code, F.struct("begin", "end"))))
    return back.unionByName(own).groupBy("node").agg(of(BYTES).alias("parts"), of(WORDS).alias("passages"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))


def repeat_groups(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """group, length, key, offset: groups of repeats of at least MIN bytes, all occurrences in all rows.

    Groups are left-diverse intervals of the suffix arrays, and segments or ranges of windows that occur several times as a
    whole; equal texts are listed for each of their rows. A group is clipped to an anchor's segment or range. Rows are as many as occurrences: no list is gathered.
    """
    arrow_rows(spark)
    folder = shared_dir(spark)
    rows = _rows(docs, key, text).where(F.octet_length("text") >= MIN)
    texts = rows.groupBy("node").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    segs, covers, groups, members = candidates(spark, texts.select("node", "text"), folder, every=True)

    def grouped(batches, out):
        import xxhash

        def flush(kind, rows):
            x, size, ends, sa, lcp, of, before = _array([r[3] for r in rows], kind, whole=True)
            begin, flat = ends - size, []
            for n, lb, rb, _, diverse in intervals(sa, lcp, before, kind.least):
                if diverse:
                    g = xxhash.xxh3_64_intdigest(x[sa[lb] : sa[lb] + n].tobytes()) - (1 << 63)
                    flat += [(g, n, *[rows[of[i]][c] for c in (1, 2, 4, 7, 8)], int(sa[i] - begin[of[i]])) for i in range(lb, rb + 1)]
            if flat:
                yield out(list(zip(*flat, strict=True)))

        yield from batched(batches, flush, same=True)

    made = emit(groups.where(F.col("kind") == BYTES.code).select(*TASK), "group long, length int, h long, lead int, dig long, base int, same long, at int", grouped)
    made = staged(spark, made, folder, "groups")
    # A piece of a cut anchor stands for all pieces of its content.
    like = made.where("same is not null").select("group", "length", "same", "at").join(members.where(F.col("kind") == BYTES.code), "same")
    at = ("group", "length", "h", "lead", "dig", (F.col("a") + F.col("at")).alias("at"))
    made = made.where("same is null").withColumnRenamed("base", "a").select(*at).unionByName(like.select(*at))
    place = segs.where((F.col("kind") == BYTES.code) & F.col("seg").isNotNull()).select("h", "lead", "node", "start", F.xxhash64("seg", "lead").alias("dig"), F.octet_length("seg").alias("size"))
    again = place.groupBy("h", "lead", "dig").agg(F.count(F.lit(1)).alias("places"), F.first("size").alias("z")).where("places > 1")  # within a text, too
    again = again.select(F.xxhash64("h", "lead", "dig").alias("group"), F.col("z").alias("length"), "h", "lead", "dig", F.lit(0).alias("at"))
    ranges_ = covers.where(F.col("kind") == BYTES.code).select(F.col("g").alias("group"), (F.col("z") - F.col("a")).alias("length"), "h", "lead", "dig", F.col("a").alias("at"))
    found = place.join(made.unionByName(again).unionByName(ranges_).distinct(), ["h", "lead", "dig"]).select("group", "length", "node", (F.col("start") + F.col("at")).alias("offset"))
    copies = texts.where("copies > 1").select(F.xxhash64(F.lit("text"), "node").alias("group"), F.octet_length("text").alias("length"), "node", F.lit(0).cast("long").alias("offset"))
    found = found.unionByName(copies)
    return found.join(rows.select("node", F.col("key").alias(key)), "node").select("group", "length", key, "offset").distinct()


def remove_repeats(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, passage_words (words of passages of over 50 words that another row has too) and kept (the remaining bytes) for each row of docs."""
    arrow_rows(spark)
    folder = shared_dir(spark)
    rows = _rows(docs, key, text)
    some = F.octet_length("text") >= SHORTEST
    # Of equal texts, one takes part; shorter texts have no windows.
    copies = rows.where(some).groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    copies = staged(spark, copies, folder, "copies", small=True)
    parts = staged(spark, repeated_parts(spark, rows.where(some).select("node", "text"), folder), folder, "parts", small=True)
    of = copies.join(parts, "node", "left").where("copies > 1 or parts is not null")
    of = staged(spark, of.select(F.col("node").alias("n"), "copies", "parts", "passages"), folder, "of", small=True)
    discard(spark, folder, "segments", "distinct", "cover", *[f"ranges-{i}" for i in range(3)], *[f"kinds-{i}" for i in range(3)])

    def merged(spans):
        out: list[list[int]] = []
        for s in spans or []:
            if out and s["begin"] <= out[-1][1]:
                out[-1][1] = max(out[-1][1], s["end"])
            else:
                out.append([s["begin"], s["end"]])
        return out

    def each(batches, out):
        import pyarrow as pa

        for b in batches:
            got = []
            for k, t, c, spans, passages in zip(*[b.column(x).to_pylist() for x in ("key", "text", "copies", "parts", "passages")], strict=True):
                raw = t.encode()
                copy = (c or 0) > 1
                gone = [[0, len(raw)]] if copy and len(raw) >= MIN else merged(spans)
                words = len(raw.split()) if copy else 0
                if words < WORDS.least:
                    words = sum(z - a for a, z in merged(passages))
                kept, at = [], 0
                for a, z in gone:
                    kept.append(raw[at:a])
                    at = z
                kept = b"".join([*kept, raw[at:]])
                got.append((k, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), words, kept))
            yield out(list(zip(*got, strict=True)) if got else [pa.array([])] * 7)

    kind = docs.schema[key].dataType.simpleString()
    df = rows.join(of, (F.col("node") == F.col("n")) & some, "left").select("key", "text", "copies", "parts", "passages")
    return emit(df, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long, kept binary", each).withColumnRenamed("key", key)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")

"""Secret scans: a character convolutional network over every candidate and its surroundings.

Patterns find the base spans (assignments, access keys, hex runs), which always stay. Further candidates - any run of 16
or more token characters that mixes letters and digits, without the base spans in it - are judged by a small network
(embedding, one convolution, pooling over candidate and context, one output) in numpy. What is longer than a window is
judged in overlapping windows over all of it and what follows, and the highest probability counts. The network is
trained on labelled findings made by a seeded generator (secrets in the forms that scanners list; look-alikes such as
checksums, commit ids, identifiers and numbers; long runs with a secret anywhere or none), calibrated by a logistic fit
on a second part, and cut at the highest threshold that keeps the wanted recall on a third part. One narrow pass over the documents: no shuffle.

Defined results: a null text is an empty one; an empty text has no spans; texts are searched whole; repeated rows give
repeated results; further columns are ignored; an empty table gives an empty one. Positions are code points.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, table, with_columns

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_OTHER = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WIDTH, BEFORE, EMBED, FILTERS, SPAN = 96, 32, 8, 24, 5
STEP = 32  # between the windows of a long candidate: each 32 characters in a row are whole in one
RECALL = 0.98


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns. A run of the minimal length begins where the unbounded pattern's run does."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in t:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(t)]
    return sorted(out + [(m.start(), 2, m.end()) for m in _HEX.finditer(t)])


def mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def other_candidates(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters with letters and digits, without base spans: of what these leave, parts that are such
    runs themselves, and shorter ones beside a key or hex run, which may belong to it."""
    out, k = [], 0
    union: list[list[int]] = []
    for a, _, b in base:
        if union and a <= union[-1][1]:
            union[-1][1] = max(union[-1][1], b)
        else:
            union.append([a, b])
    starts, ends = {a for a, kind, _ in base if kind}, {b for _, kind, b in base if kind}
    for m in _OTHER.finditer(t):
        if not mixed(m.group()):
            continue
        at, b = m.span()
        while k < len(union) and union[k][1] <= at:
            k += 1
        parts, j = [], k
        while j < len(union) and union[j][0] < b:
            parts.append((at, union[j][0]))
            at, j = union[j][1], j + 1
        for x, y in [*parts, (at, b)]:
            if x < y and ((y - x >= 16 and mixed(t[x:y])) or ((x in ends or y in starts) and any(c.isalnum() for c in t[x:y]))):
                out.append((x, y))
    return out


def codes(t: str, a: int, b: int) -> np.ndarray:
    """BEFORE characters before the candidate, then it and what follows, as small codes: 0 none, 1 not ASCII."""
    s = t[max(0, a - BEFORE) : a].rjust(BEFORE, "\0") + t[a : a + WIDTH - BEFORE].ljust(WIDTH - BEFORE, "\0")
    x = np.fromiter(map(ord, s), np.int64, WIDTH)
    return np.where(x >= 127, 1, np.where(x < 32, np.where(x == 0, 0, 2), x - 29)).astype(np.int8)


def places(a: int, b: int) -> range:
    """Where the windows of a candidate begin: one, or if it is longer than that, as many as see all of it and STEP more."""
    return range(a, b, STEP) if b - a > WIDTH - BEFORE else range(a, a + 1)


class Net:
    """Embedding, convolution, ReLU, maxima over context and candidate, one logit; trained by plain Adam."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.3, (98, EMBED)), "k": r.normal(0, 0.2, (SPAN * EMBED, FILTERS)), "b": np.zeros(FILTERS), "w": r.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        emb = self.p["e"][x]
        win = np.lib.stride_tricks.sliding_window_view(emb, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - SPAN + 1, -1)
        act = np.maximum(win @ self.p["k"] + self.p["b"], 0)
        cut = BEFORE - SPAN + 1
        at = np.stack([act[:, :cut].argmax(1), act[:, cut:].argmax(1) + cut], axis=1)  # row, part, filter
        pooled = np.take_along_axis(act, at, axis=1).reshape(len(x), -1)
        return win, at, pooled, pooled @ self.p["w"] + self.p["c"]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logit(x) + self.shift)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> None:
        r, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                win, at, pooled, z = self._forward(x[rows])
                d = (1 / (1 + np.exp(-z)) - y[rows]) / len(rows)
                g = {"w": pooled.T @ d, "c": d.sum(keepdims=True)}
                dp = (d[:, None] * self.p["w"] * (pooled > 0)).reshape(len(rows), 2, FILTERS)
                da = np.zeros((len(rows), WIDTH - SPAN + 1, FILTERS))
                np.put_along_axis(da, at, dp, axis=1)
                g["k"] = np.tensordot(win, da, ([0, 1], [0, 1]))
                g["b"] = da.sum((0, 1))
                dw = (da @ self.p["k"].T).reshape(len(rows), -1, SPAN, EMBED)
                g["e"] = np.zeros_like(self.p["e"])
                for j in range(SPAN):
                    np.add.at(g["e"], x[rows][:, j : WIDTH - SPAN + 1 + j], dw[:, :, j])
                t += 1
                for k, dk in g.items():
                    m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * dk, 0.999 * v.get(k, 0) + 0.001 * dk * dk
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic fit of scale and shift by Newton's method."""
        z, w = self.logit(x), np.array([1.0, 0.0])
        a = np.stack([z, np.ones_like(z)], axis=1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a @ w)))
            h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + 1e-3 * np.eye(2)
            w = w - np.linalg.solve(h, a.T @ (p - y) + 1e-3 * (w - [1, 0]))
        self.scale, self.shift = float(w[0]), float(w[1])

    def constrain(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """The highest threshold at which at least this share of the secrets is found."""
        p = np.sort(self.prob(x)[y == 1])
        self.threshold = float(p[int(np.floor((1 - recall) * len(p)))])


def long_findings(n: int, seed: int = 11) -> list[tuple[str, int, int]]:
    """n made texts with a long run or a run around a hex run, and where its secret begins and ends: every other one has none."""
    r = np.random.default_rng([seed, 1])
    alnum, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    some = lambda a, k: "".join(np.array(list(a))[r.integers(0, len(a), k)])
    word = lambda: some("etaoinshrdlucmfw", int(r.integers(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    pick = lambda a: a[int(r.integers(0, len(a)))]

    def words(least: int) -> str:
        sep, s = pick("/_-"), word() + str(r.integers(1, 2030))
        while len(s) < least:
            s += sep + (word() if r.random() < 0.8 else pick(["v", "", "id"]) + str(r.integers(1, 2030)))
        return s

    out = []
    for i in range(n):
        k = int(r.integers(0, 5))
        secret = some(alnum, int(r.integers(24, 48)))
        if i % 2:
            lead, secret, rest = [
                lambda: ("", "eyJ" + some(alnum + "_-", int(r.integers(65, 300))), ""), lambda: ("", some(alnum + "+/", int(r.integers(65, 300))) + pick(["", "="]), ""),
                lambda: (words(int(r.integers(60, 240))) + pick("/=_"), secret, ""), lambda: (words(int(r.integers(40, 120))) + "/", secret, "/" + words(int(r.integers(20, 120)))),
                lambda: ("", some(alnum, int(r.integers(8, 24))) + some(hexa, 24) + some(alnum, int(r.integers(0, 24))), ""),
            ][k]()
        else:
            secret = ""
            lead, rest = [
                lambda: (words(int(r.integers(65, 300))), ""), lambda: (pick(["/", "./", ""]) + words(int(r.integers(65, 160))), ""), lambda: (pick("=-_/") * int(r.integers(60, 120)) + word() + str(r.integers(0, 99)), ""),
                lambda: (words(int(r.integers(4, 40))) + pick("/-_="), some(hexa, 40) + pick(["", "/" + words(8), "-" + word()])), lambda: ("-".join(str(r.integers(1, 2030)) for _ in range(int(r.integers(14, 40)))) + "-" + word(), ""),
            ][k]()
        t = prose(int(r.integers(2, 7))) + " "
        a = len(t) + len(lead)
        out.append((t + lead + secret + rest + pick([" ", ". ", ", ", "\n"]) + prose(int(r.integers(1, 6))), a, a + len(secret)))
    return out


def long_windows(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of the windows of long_findings, without those that hold a secret's edge only."""
    xs, ys = [], []
    for t, lo, hi in long_findings(n, seed):
        for a, b in other_candidates(t, base_spans(t)):
            for w in places(a, b):
                if min(hi, w + WIDTH - BEFORE) - max(lo, w) >= 16:
                    xs.append(codes(t, w, b))
                    ys.append(1)
                elif lo == hi or hi <= w - BEFORE or w + WIDTH - BEFORE <= lo:
                    xs.append(codes(t, w, b))
                    ys.append(0)
    return np.array(xs), np.array(ys, float)


def labelled_findings(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of n made findings in prose, half of them secrets, and of the windows of n / 4 long ones."""
    r = np.random.default_rng(seed)
    alnum, low, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    some = lambda a, k: "".join(np.array(list(a))[r.integers(0, len(a), k)])
    word = lambda: some("etaoinshrdlucmfw", int(r.integers(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    cue = ["key", "secret", "token", "bearer", "auth", "password", "credential", "pwd", "client_secret", "access", "private", "apikey"]
    no_cue = ["commit", "sha1", "md5", "checksum", "id", "uuid", "path", "file", "version", "order", "image", "page", "build", "ref", "see"]
    pick = lambda a: a[int(r.integers(0, len(a)))]
    xs, ys = [], []
    for i in range(n):
        y = i % 2
        if y:
            k = int(r.integers(0, 7))
            s = [lambda: some(alnum, int(r.integers(20, 48))), lambda: some(alnum + "+/", 40), lambda: "ghp_" + some(alnum, 36), lambda: "sk-" + some(alnum, 32), lambda: "eyJ" + some(alnum + "_-", 44), lambda: some(hexa, int(r.integers(32, 64))), lambda: "xoxb-" + some("0123456789", 11) + "-" + some(alnum, 24)][k]()
            before = f"{prose(4)} {pick(cue)}{pick([' ', ' = ', ': ', '=', ' is '])}{pick(['', chr(34), chr(39)])}" if r.random() < 0.8 else prose(6) + " "
        else:
            k = int(r.integers(0, 7))
            s = [lambda: some(hexa, 40), lambda: "-".join(some(hexa, j) for j in (8, 4, 4, 4, 12)), lambda: word() + "_" + word() + "_" + word() + str(r.integers(0, 99)).rjust(2, "0"), lambda: "/".join(word() for _ in range(4)) + "/v" + str(r.integers(1, 99)), lambda: some("0123456789", 15) + "a", lambda: word() + "-" + word() + "-" + str(r.integers(1900, 2030)) + "-" + word(), lambda: some(low, 18) + str(r.integers(0, 9))][k]()
            before = f"{prose(4)} {pick(no_cue)}{pick([' ', ': ', '=', '/', ' '])}" if r.random() < 0.8 or k == 0 else prose(6) + " "
        if len(s) < 16:
            s += "_" + some(low, 16)
        t = before + s + pick([" ", chr(34) + " ", ". ", ", ", "\n"]) + prose(5)
        if r.random() < 0.2 and y:
            t = prose(3) + "\n" + t
        at = t.index(s, len(before) - 1 if t.startswith(before) else 0)
        xs.append(codes(t, at, at + len(s)))
        ys.append(y)
    x, y = long_windows(n // 4, seed)
    return np.concatenate([np.array(xs), x]), np.concatenate([np.array(ys, float), y])


_MODEL: list[Net] = []


def model(n: int = 3000) -> Net:
    """The network, trained once a process: n findings (and long ones) to train on, n / 2 each to calibrate and to set the threshold."""
    if not _MODEL:
        net = Net()
        net.fit(*labelled_findings(n, 11))
        net.calibrate(*labelled_findings(n // 2, 12))
        x, y = labelled_findings(n // 2, 13)
        least = []
        for part in (slice(n // 2), slice(n // 2, None)):  # the recall holds for short and for long ones
            net.constrain(x[part], y[part])
            least.append(net.threshold)
        net.threshold = min(least)
        _MODEL.append(net)
    return _MODEL[0]


def scan(t: str, net: Net) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """Base spans, all spans, and the highest probability that the network gives any candidate (base ones included)."""
    base = base_spans(t)
    other = other_candidates(t, base)
    if not base and not other:
        return base, base, 0.0
    all_ = [(a, b) for a, _, b in base] + other
    at = [places(a, b) for a, b in all_]
    p = net.prob(np.array([codes(t, w, b) for (_, b), ws in zip(all_, at, strict=True) for w in ws]))
    p = np.maximum.reduceat(p, np.cumsum([0, *map(len, at)])[:-1])
    more = [(a, 3, b) for (a, b), q in zip(other, p[len(base) :], strict=True) if q >= net.threshold]
    return base, sorted(base + more), float(p.max())


def redacted(t: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """The text with each union of overlapping spans replaced."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [t[at:a], mask]
        at = max(at, b)
    return "".join([*out, t[at:]]) if out else t


def say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """docs with secret_spans, base_spans and secret_score; with redact, the text without the secrets takes the text's place."""
    net = model()

    def each(texts: list) -> list:
        got = [scan(t, net) if t else ([], [], 0.0) for t in texts]
        return [[say(x[1]) for x in got], [say(x[0]) for x in got], [x[2] for x in got], [redacted(t, x[1]) if x[1] else t for t, x in zip(texts, got, strict=True)]]

    return with_columns(docs, [text], "secret_spans string, base_spans string, secret_score double", each, replaces=text if redact else None)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    df = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.regexp_count("base_spans", F.lit(f"{k}:")).cast("long").alias(f"n_{k}")
    return df.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2("base_spans", 256).alias("base_sha256"), F.col("secret_spans").alias("spans"), F.round("secret_score", 6).alias("score"))

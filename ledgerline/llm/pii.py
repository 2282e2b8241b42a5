"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans, which always stay. The network finds what the
patterns miss: it is trained in numpy on labelled windows in which base spans
stand as they are or are written in other ways (``disguised``: spelled-out signs,
other separators, numbers without a country code), and adds spans that it reads
as the same kinds. It decodes overlapping windows by Viterbi; the spans of all
windows of a text are then reconciled together. Every span must hold a digit, an
``@`` or the word "dot", as all spans do that it has learned; a window without
these can give no span and is not decoded; the result is the same as with
decoding it.
"""

from __future__ import annotations

import bisect
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.runtime import small_batches
from ledgerline.llm.toxicity import fold

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base spans. A run of digits is taken whole, so that time grows with the text only;
#: of e-mail addresses what follows the ``@``, and the characters before it.
PATTERNS = {
    "email": re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
BEFORE_AT = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: Window length and step in characters; their difference is what neighbours share.
WINDOW, STEP = 96, 64
HIDDEN = 16
#: Bounds of the training sample: documents, their characters in all and each, and windows of them.
MAX_DOCS, MAX_CHARS, MAX_TEXT, MAX_WINDOWS = 1_500, 20_000_000, 200_000, 12_000
STEPS, BATCH = 320, 64
#: Characters of texts that are read together.
TOGETHER = 2_000_000
#: Least mean posterior probability of a span that the network adds.
CONFIDENCE = 0.9
SIGNAL = re.compile(r"[0-9@]|(?<![A-Za-z])dot(?![A-Za-z])")
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
LETTER, OTHER, PAD = 128, 129, 130


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _accept(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in found.split(".")))
    digits = re.sub("[^0-9]", "", found) if kind in ("card", "phone") else ""
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def _plausible(kind: str, found: str) -> bool:
    """Whether a span of the network has the numbers of its kind, however they are written."""
    numbers = re.findall("[0-9]+", found)
    if kind == "ip":
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    return _accept(kind, "".join(numbers)) if kind != "email" else True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: from each ``@`` to the left over what may stand before it, but not into the address before."""
    end = 0
    for m in PATTERNS["email"].finditer(text):
        head = text[max(end, text.rfind("@", end, m.start()) + 1) : m.start()]
        start = len(head.rstrip(BEFORE_AT)) - len(head) + m.start()
        if start < m.start():
            yield start, m.end()
            end = m.end()


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the patterns by kind, then start, in code points."""
    text = text or ""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    need = {"ip": ".", "card": "", "phone": "+"}
    return out + [(k, m.start(), m.end()) for k in KINDS[1:] if need[k] in text for m in PATTERNS[k].finditer(text) if _accept(k, m.group())]


def disguise(kind: str, found: str, rng) -> str:
    """A base span written in a way that its pattern does not cover."""
    pick = lambda *forms: forms[int(rng.integers(len(forms)))]
    if kind == "email":
        dot = pick(" dot ", " (dot) ", "[dot]", "(dot)")
        return found.replace("@", pick(" at ", " (at) ", "[at]", " @ ", "(at)")).replace(".", dot)
    if kind == "ip":
        return pick(" . ", "[.]", "(.)", " dot ").join(found.split("."))
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return pick("  ", ".", "/", " - ", "_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    home = digits[-10:]
    return pick("({}) {}-{}", "{}.{}.{}", "{}-{}-{}", "+ 1 {} {} {}", "001/{}/{}-{}").format(home[:3], home[3:6], home[6:])


def disguised(text: str, spans, rng) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its spans disguised, and where they then stand; of spans that overlap the first is taken."""
    out, at, size, placed = [], 0, 0, []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a < at:
            continue
        new = disguise(kind, text[a:b], rng)
        out += [text[at:a], new]
        size += a - at + len(new)
        placed.append((kind, size - len(new), size))
        at = b
    return "".join([*out, text[at:]]), placed


def classes(text: str) -> np.ndarray:
    """One class a character: ASCII as it is, other letters, and the rest."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where(points < 128, points, OTHER).astype(np.uint8)
    for i in np.flatnonzero(points >= 128):
        if text[i].isalpha():
            out[i] = LETTER
    return out


def window_starts(n: int) -> range:
    return range(0, max(n - WINDOW + STEP, 1), STEP)


def signal_windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit, an ``@`` or the beginning of a "dot"."""
    found, last = set(), window_starts(len(text))[-1]
    for m in SIGNAL.finditer(text):
        p = m.start()
        first = max(0, -(-(p - WINDOW + 1) // STEP))
        found.update(range(first * STEP, min(p, last) + 1, STEP))
    return sorted(found)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """The network: ``p`` holds its arrays by name."""

    def __init__(self, p: dict[str, np.ndarray] | None = None, seed: int = 1):
        rng = np.random.default_rng(seed)
        new = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
        self.p = p or {
            **{f"x{d}": new(PAD + 1, 4 * HIDDEN) for d in "fb"},
            **{f"u{d}": new(HIDDEN, 4 * HIDDEN) for d in "fb"},
            "out": new(2 * HIDDEN, TAGS),
            "bias": np.zeros(TAGS, np.float32),
            "trans": np.zeros((TAGS, TAGS), np.float32),
        }

    def _lstm(self, x, keep):
        """Hidden states (time first, both directions side by side); ``keep`` gathers what the backward pass needs.

        Both directions go through time together, the second over the windows turned round.
        """
        n, steps = x.shape
        turned = x[:, ::-1]
        gates_in = np.stack([self.p["xf"][x.T], self.p["xb"][turned.T]], axis=1)
        live = np.stack([x.T != PAD, turned.T != PAD], axis=1)[..., None]
        u = np.stack([self.p["uf"], self.p["ub"]])
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        hs = np.empty((steps, 2, n, HIDDEN), np.float32)
        for t in range(steps):
            z = gates_in[t] + h @ u
            s, g = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
            i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, g, tc, live[t]))
            h, c = o * tc * live[t], c * live[t]
            hs[t] = h
        return np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2)

    def emissions(self, x, keep=None):
        h = self._lstm(x, keep)
        return h, h @ self.p["out"] + self.p["bias"]

    def viterbi(self, x):
        """Best tags (windows by time), and the emissions (time by windows)."""
        _, e = self.emissions(x)
        best, back = e[0].copy(), np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            step = best[:, :, None] + self.p["trans"] + _ALLOWED
            back[t] = step.argmax(1)
            now = step.max(1) + e[t]
            best = np.where((x[:, t] != PAD)[:, None], now, best)
        tag = best.argmax(1)
        tags, rows = np.zeros((len(x), len(e)), np.int8), np.arange(len(x))
        for t in range(len(e) - 1, -1, -1):
            live = x[:, t] != PAD
            tags[live, t] = tag[live]
            if t:
                tag = np.where(live, back[t][rows, tag], tag)
        return tags, e

    def _chains(self, x, e):
        """Of the CRF: posterior probabilities of the tags, the log partition, and the expected number of each move.

        Forward and backward sums are scaled at every step.
        """
        live, moves = (x != PAD).T, np.exp((self.p["trans"] + _ALLOWED).astype(np.float64))
        top = e.max(2)
        ee = np.exp(e.astype(np.float64) - top[..., None])
        alpha, beta, scale = np.empty_like(ee), np.ones_like(ee), np.ones(top.shape)
        v = ee[0]
        for t in range(len(e)):
            v = (alpha[t - 1] @ moves) * ee[t] if t else v
            s = v.sum(1)
            scale[t] = np.where(live[t], s, 1.0) if t else s
            alpha[t] = np.where(live[t][:, None], v / s[:, None], alpha[t - 1]) if t else v / s[:, None]
        ahead = np.empty_like(ee)  # what follows a move into each tag
        for t in range(len(e) - 1, -1, -1):
            ahead[t] = ee[t] * beta[t] / scale[t][:, None]
            if t:
                beta[t - 1] = np.where(live[t][:, None], ahead[t] @ moves.T, beta[t])
        z = (np.log(scale) + top * np.where(np.arange(len(e))[:, None] > 0, live, True)).sum(0)
        k = e.shape[2]
        expected = moves * (alpha[:-1].reshape(-1, k).T @ (ahead[1:] * live[1:, :, None]).reshape(-1, k))
        posterior = alpha * beta
        return posterior / posterior.sum(2, keepdims=True), z, expected

    def marginals(self, x, e, tags):
        """Posterior probability of each chosen tag."""
        prob = self._chains(x, e)[0].transpose(1, 0, 2)
        return np.take_along_axis(prob, tags[:, :, None].astype(np.int64), 2)[:, :, 0]

    def gradients(self, x, y):
        """Loss and gradients of the CRF's negative log likelihood of the tags ``y``."""
        keep: list = []
        h, e = self.emissions(x, keep)
        n, steps, p = len(x), x.shape[1], self.p
        live, trans = (x != PAD).T, p["trans"] + _ALLOWED
        posterior, z, g_trans = self._chains(x, e)
        d = (posterior * live[:, :, None]).astype(np.float32)
        rows, at = np.arange(n), np.arange(steps)[:, None]
        d[at, rows, y.T] -= live
        d[np.abs(d) < 1e-9] = 0  # numbers next to nothing slow the arithmetic down
        moves = y[:, :-1].astype(np.int64) * TAGS + y[:, 1:]
        loss = z.sum() - (e[at, rows, y.T] * live).sum() - (trans.ravel()[moves] * live[1:].T).sum()
        g = {"trans": (g_trans - np.bincount(moves[live[1:].T], minlength=TAGS * TAGS).reshape(TAGS, TAGS)).astype(np.float32)}
        g["out"], g["bias"] = h.reshape(steps * n, -1).T @ d.reshape(steps * n, -1), d.sum((0, 1))
        dh_all = d @ p["out"].T
        part = np.stack([dh_all[..., :HIDDEN], dh_all[::-1, :, HIDDEN:]], axis=1)
        u = np.stack([p["uf"], p["ub"]]).transpose(0, 2, 1)
        dh = dc = np.zeros((2, n, HIDDEN), np.float32)
        dzs = np.empty((steps, 2, n, 4 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            _, c0, i, f, o, gg, tc, m = keep[t]
            dh = (dh + part[t]) * m
            dc = dc * m + dh * o * (1 - tc * tc)
            dz = dzs[t]
            dz[..., :HIDDEN] = dc * gg * i * (1 - i)
            dz[..., HIDDEN : 2 * HIDDEN] = dc * c0 * f * (1 - f)
            dz[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
            dz[..., 3 * HIDDEN :] = dc * i * (1 - gg * gg)
            dh, dc = dz @ u, dc * f
        h0 = np.stack([k[0] for k in keep])
        for k, (way, turned) in enumerate((("f", x), ("b", x[:, ::-1]))):
            seen = np.zeros((steps * n, PAD + 1), np.float32)
            seen[np.arange(steps * n), turned.T.ravel()] = 1
            flat = dzs[:, k].reshape(steps * n, -1)
            g[f"x{way}"], g[f"u{way}"] = seen.T @ flat, h0[:, k].reshape(steps * n, -1).T @ flat
        return loss / n, {k: v / n for k, v in g.items()}


#: Inside tags follow only begin or inside of their own kind.
_ALLOWED = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(KINDS)):
    _ALLOWED[:, 2 + 2 * _k] = -1e4
    _ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0


def _window(x: np.ndarray, start: int) -> np.ndarray:
    out = np.full(WINDOW, PAD, np.uint8)
    part = x[start : start + WINDOW]
    out[: len(part)] = part
    return out


def _label(n: int, spans) -> np.ndarray:
    y = np.zeros(n, np.int8)
    for kind, a, b in sorted(spans, key=lambda s: -KINDS.index(s[0])):
        k = KINDS.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def labelled_windows(texts: list[str], rng, most: int = MAX_WINDOWS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """At most ``most`` windows and their tags: with spans as they stand and disguised, as many with a signal but no span, and some others."""
    marked, bare, plain = [], [], []
    for text in texts:
        base = base_spans(text)
        for t, spans in [(text, base), disguised(text, base, rng)] if base else [(text, base)]:
            x, y = classes(t), _label(len(t), spans)
            own = set(signal_windows(t))
            for s in [*own, *(s for s in window_starts(len(t)) if s not in own and rng.random() < 0.02)]:
                if not (s < len(y) and y[s] and y[s] % 2 == 0):  # no window starts inside a span
                    w = _window(x, s), np.pad(y[s : s + WINDOW], (0, max(0, s + WINDOW - len(y))))
                    (marked if w[1].any() else bare if s in own else plain).append(w)
    take = lambda ws, n: [ws[i] for i in rng.permutation(len(ws))[:n]]
    chosen = take(marked, most // 2)
    half = max(len(chosen), most // 8)
    chosen += take(bare, half) + take(plain, half // 4)
    return [x for x, _ in chosen], [y for _, y in chosen]


def train(texts: list[str], steps: int = STEPS, seed: int = 1, windows: int = MAX_WINDOWS) -> dict[str, np.ndarray] | None:
    """Adam on labelled windows of the texts; None without any."""
    rng = np.random.default_rng(seed)
    xs, ys = labelled_windows(texts, rng, windows)
    if not xs:
        return None
    xs, ys = np.stack(xs), np.stack(ys)
    net = Tagger(seed=seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = rng.integers(0, len(xs), BATCH)
        _, g = net.gradients(xs[at], ys[at])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.02 * min(1.0, 1.5 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 5 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            net.p[k] = (net.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net.p


def read_windows(net: Tagger, texts: list[tuple[np.ndarray, list[int]]], block: int = 1024) -> list[list[tuple[str, int, int, float]]]:
    """Spans (kind, start, end, mean probability) of the windows of each text (its classes, the windows' starts), in places of the whole text.

    Windows of several texts are read together, ``block`` at a time.
    """
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    places = [(i, s) for i, (_, starts) in enumerate(texts) for s in starts]
    for o in range(0, len(places), block):
        at = places[o : o + block]
        windows = np.stack([_window(texts[i][0], s) for i, s in at])
        tags, e = net.viterbi(windows)
        marked = np.flatnonzero(tags.any(1))
        if not len(marked):
            continue
        prob = np.zeros(tags.shape)
        prob[marked] = net.marginals(windows[marked], e[:, marked], tags[marked])
        for r in marked:
            a = None
            for t in range(WINDOW + 1):
                tag = tags[r, t] if t < WINDOW else 0
                if a is not None and not (tag and tag % 2 == 0):
                    out[at[r][0]].append((KINDS[(tags[r, a] - 1) // 2], at[r][1] + a, at[r][1] + t, float(prob[r, a:t].mean())))
                    a = None
                if tag % 2:
                    a = t
    return out


def reconcile(text: str, base, found) -> list[tuple[str, int, int]]:
    """One set of spans for the text: windows' spans of a kind that overlap become one, surer ones
    are taken first, and base spans come before all; cards need valid digits, addresses four numbers, phones enough digits. Spans without a signal go first of all,
    so that windows without one have no say."""
    merged: list[list] = []
    for kind, a, b, p in sorted(f for f in found if SIGNAL.search(text, f[1], f[2])):
        if merged and merged[-1][0] == kind and a < merged[-1][2]:
            merged[-1][2], merged[-1][3] = max(b, merged[-1][2]), max(p, merged[-1][3])
        else:
            merged.append([kind, a, b, p])
    # spans taken so far as disjoint stretches in order
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    out = list(base)
    for kind, a, b, p in sorted(merged, key=lambda s: (-s[3], s[1], s[0])):
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        at = bisect.bisect_left(starts, b)  # the stretch before is the only one that can reach beyond ``a``
        if p >= CONFIDENCE and SIGNAL.search(text, a, b) and b - a >= 5 and _plausible(kind, text[a:b]) and (at == 0 or ends[at - 1] <= a):
            starts.insert(at, a), ends.insert(at, b)
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def spans_of(texts: list[str], net: Tagger | None, skip_bare_windows: bool = True) -> list[tuple[list, list]]:
    """Base spans, and all spans, of each text."""
    bases = [base_spans(t) for t in texts]
    if net is None:
        return [(b, b) for b in bases]
    starts = [(signal_windows(t) if skip_bare_windows else list(window_starts(len(t)))) if t else [] for t in texts]
    found = read_windows(net, [(classes(t) if s else np.empty(0, np.uint8), s) for t, s in zip(texts, starts, strict=True)])
    return [(b, reconcile(t, b, f) if s else b) for t, b, s, f in zip(texts, bases, starts, found, strict=True)]


def all_spans(text: str | None, net: Tagger | None, skip_bare_windows: bool = True) -> tuple[list, list]:
    """Base spans, and all spans, of one text."""
    return spans_of([text or ""], net, skip_bare_windows)[0]


def training_sample(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, max_text: int = MAX_TEXT) -> DataFrame:
    """A bounded sample outside fold 0 of texts with a digit or an ``@``: smallest hashes of their ids, up to ``max_chars``
    characters in all; longer texts than ``max_text`` do not count."""
    rows = docs.filter("doc_id is not null").filter(fold(F.col("doc_id")) != 0).filter(F.col("text").rlike("[0-9@]"))
    rows = rows.filter(F.length("text") <= max_text)
    sizes = rows.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_docs)
    upto = F.sum("n").over(W.orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))  # over at most max_docs rows of numbers
    ids = sizes.withColumn("upto", upto).filter(F.col("upto") <= max_chars)
    return rows.join(F.broadcast(ids.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))


def fit(docs: DataFrame) -> dict[str, np.ndarray] | None:
    """Train on the bounded sample, in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"net": [pickle.dumps(train(rows.sort_values("doc_id")["text"].tolist()))]})

    found = training_sample(docs).groupBy().applyInPandas(run, "net binary").collect()
    return pickle.loads(found[0].net) if found else None


def find_spans(docs: DataFrame, net: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Spans of every row: ``doc_id``, ``base`` and ``spans``, arrays of (kind, start, end) in code points.

    Defined cases: a null text counts as empty and has no spans; a text without
    digit, ``@`` and "dot" has none; a text of any length is read whole; where no text has any, the network is left out and
    both columns agree; rows with a null id and repeated rows are each read;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    net = net or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = "array<struct<kind: string, start: int, end: int>>"

    @F.pandas_udf(f"base {kind}, spans {kind}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value) if shared.value else None
        pack = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for texts in batches:
            rows, some, size = [], [], 0
            for t in texts:
                some.append(t or "")
                size += len(some[-1])
                if size >= TOGETHER:
                    rows += spans_of(some, tagger)
                    some, size = [], 0
            rows += spans_of(some, tagger)
            yield pd.DataFrame({"base": [pack(b) for b, _ in rows], "spans": [pack(s) for _, s in rows]})

    return docs.select("doc_id", run("text").alias("s")).select("doc_id", "s.*")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_spans``: ``n_spans`` counts all spans, the other counts those of the patterns."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))

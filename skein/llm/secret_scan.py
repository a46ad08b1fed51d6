"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

Patterns find the base spans, which always stay.  Candidates are all that a key may be: the
base matches, those of their patterns that are too short to be base spans, shorter runs of
hexadecimal digits, and runs of eight key characters or more with a digit or with changing
case.  A network in numpy reads each candidate with its surroundings: character embeddings,
one convolution, maxima over the candidate and over its surroundings, two dense layers.  A
candidate of more than ``INSIDE`` characters is read in overlapping views, over the whole and
over its long parts between separators; its largest probability counts, and the whole
candidate is the span.  What reaches the threshold is a span of kind ``model``, unless base
spans or another one cover it wholly.  The network is trained on labelled findings (a generated
set of fixed seed unless others are given, of which at most ``FINDINGS`` are used), on the
surest view of a key and on all views of others; Platt scaling calibrates it on findings apart,
and the threshold is the highest that keeps the recall there at ``RECALL``, of candidates with
one view and of those with several.

Defined cases: a null text is empty and has no spans; spans are code points, end
exclusive; overlapping spans of different kinds all stay, equal candidates of several kinds
are one; repeated rows are scanned one by one; a very long text is scanned whole, some hundred
candidates at a time; an empty table gives no rows; other columns, whatever their names, pass
through ``redact`` unchanged and are not read by ``report``.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The contract's patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_KEY = "A-Za-z0-9+/_=-"
_SHORT_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{8,}")
_RUN = re.compile(rf"(?<![{_KEY}])(?=[{_KEY}]*(?:[0-9]|[a-z][A-Z]))[{_KEY}]{{8,}}")
#: Long parts of a long candidate, between separators.
_PARTS = [re.compile(rf"(?<![{k}])(?=[{k}]*[0-9])(?=[{k}]*[A-Za-z])[{k}]{{20,}}") for k in ("A-Za-z0-9+_-", "A-Za-z0-9+")]

Span = tuple[int, int, int]  # start, kind, end


def found_in(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans (leftmost matches of each kind that do not overlap; too short ones are dropped), and all candidates, sorted."""
    base: list[Span] = []
    asked: set[tuple[int, int]] = set()
    low = text.lower()
    if any(w in low for w in _WORDS):
        for m in ASSIGN.finditer(text):
            asked.add(m.span(2))
            if len(m[2]) >= 12:
                base.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            asked.add(m.span())
            if m.end() - m.start() >= 18:
                base.append((m.start(), 1, m.end()))
    for m in _SHORT_HEX.finditer(text):
        asked.add(m.span())
        if m.end() - m.start() >= 16:  # a run is maximal, so a short one never hides a long one
            base.append((m.start(), 2, m.end()))
    asked.update(m.span() for m in _RUN.finditer(text))
    return sorted(base), sorted(asked)


def base_spans(text: str) -> list[Span]:
    return found_in(text)[0]


def uncovered(spans: list[tuple[int, int]], base: list[Span]) -> list[tuple[int, int]]:
    """The spans (sorted) that neither base spans together nor a longer one of their own cover wholly."""
    left, reach, k, last = [], 0, 0, -1
    for i, j in sorted(spans, key=lambda s: (s[0], -s[1])):
        reach = max(reach, i)  # base spans cover the text from i to here
        while k < len(base) and base[k][0] <= reach:
            reach = max(reach, base[k][2])
            k += 1
        if reach < j and j > last:
            left.append((i, j))
            last = j
    return left


# ---- the network

BEFORE, INSIDE, AFTER = 24, 48, 12
STEP = 12
LENGTH = BEFORE + INSIDE + AFTER
EMBED, WIDTH, FILTERS, DENSE = 12, 5, 24, 24
FINDINGS = 20_000
RECALL = 0.98
_SYMBOLS = {c: i + 2 for i, c in enumerate(string.printable[:95])}  # 0: nothing there; 1: any other character


def views(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``INSIDE`` characters that together show all of a candidate."""
    spans = {(start, stop): None}
    if stop - start > INSIDE:
        spans |= dict.fromkeys(m.span() for part in _PARTS for m in part.finditer(text, start, stop))
    for i, j in spans:
        for at in (*range(i, j - INSIDE, STEP), max(i, j - INSIDE)):
            yield at, min(at + INSIDE, j)


def window(text: str, start: int, stop: int) -> np.ndarray:
    """Codes of a view and its surroundings; a span of more than ``INSIDE`` characters is for ``views`` to cut."""
    stop = min(stop, start + INSIDE)
    inside = text[start:stop]
    before = text[max(0, start - BEFORE) : start]
    codes = np.zeros(LENGTH, np.int64)
    for at, part in ((BEFORE - len(before), before), (BEFORE, inside), (BEFORE + INSIDE, text[stop : stop + AFTER])):
        codes[at : at + len(part)] = [_SYMBOLS.get(c, 1) for c in part]
    return codes


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    last: np.ndarray
    last_bias: np.ndarray
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.first, self.first_bias, self.last, self.last_bias]

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.embed[codes]
        wide = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), LENGTH - WIDTH + 1, WIDTH * EMBED)
        h = np.maximum(0, wide @ self.conv + self.conv_bias)
        inner = h[:, BEFORE : BEFORE + INSIDE]
        outer = np.concatenate([h[:, :BEFORE], h[:, BEFORE + INSIDE :]], axis=1)
        i, o = inner.argmax(axis=1), outer.argmax(axis=1)
        mean = inner.mean(axis=1)
        pooled = np.concatenate([np.take_along_axis(inner, i[:, None], 1)[:, 0], np.take_along_axis(outer, o[:, None], 1)[:, 0], mean], axis=1)
        d = np.maximum(0, pooled @ self.first + self.first_bias)
        return d @ self.last + self.last_bias[0], (wide, h, i, o, pooled, d)

    def backward(self, codes: np.ndarray, kept: tuple, slope: np.ndarray) -> list[np.ndarray]:
        """Gradients by the parameters, for a loss with ``slope`` by the raw score."""
        wide, h, i, o, pooled, d = kept
        by_d = np.outer(slope, self.last) * (d > 0)
        by_pool = by_d @ self.first.T
        by_h = np.zeros_like(h)
        row, f = np.arange(len(codes))[:, None], np.arange(FILTERS)[None]
        by_h[:, BEFORE : BEFORE + INSIDE] += by_pool[:, None, 2 * FILTERS :] / INSIDE
        by_h[row, BEFORE + i, f] += by_pool[:, :FILTERS]
        by_h[row, np.where(o < BEFORE, o, o + INSIDE), f] += by_pool[:, FILTERS : 2 * FILTERS]
        by_h *= h > 0
        flat = by_h.reshape(-1, FILTERS)
        by_wide = (flat @ self.conv.T).reshape(len(codes), -1, WIDTH, EMBED)
        by_x = np.zeros((len(codes), LENGTH, EMBED))
        for k in range(WIDTH):
            by_x[:, k : k + by_wide.shape[1]] += by_wide[:, :, k]
        by_embed = np.zeros_like(self.embed)
        np.add.at(by_embed, codes, by_x)
        return [by_embed, wide.reshape(-1, WIDTH * EMBED).T @ flat, flat.sum(axis=0), pooled.T @ by_d, by_d.sum(axis=0), d.T @ slope, np.array([slope.sum()])]

    def probability(self, codes: np.ndarray) -> np.ndarray:
        raw = self.forward(codes)[0]
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.offset, -30, 30)))


def _new_network(rng: np.random.Generator) -> Network:
    he = lambda *shape: rng.normal(0, np.sqrt(2 / shape[0]), shape)
    return Network(rng.normal(0, 0.3, (97, EMBED)), he(WIDTH * EMBED, FILTERS), np.zeros(FILTERS), he(3 * FILTERS, DENSE), np.zeros(DENSE), he(DENSE, 1)[:, 0], np.zeros(1))


def _raw(net: Network, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([net.forward(codes[at : at + 512])[0] for at in range(0, len(codes), 512)])


def train(codes: np.ndarray, labels: np.ndarray, rounds: int = 5, batch: int = 64, seed: int = 11, of: np.ndarray | None = None) -> Network:
    """Adam on three quarters of the findings; calibration and threshold on the others.

    ``of``: the finding of each view in ``codes``, ascending; without it each has one view.
    """
    rng = np.random.default_rng(seed)
    first = np.searchsorted(np.arange(len(codes)) if of is None else of, np.arange(len(labels) + 1))
    of = np.repeat(np.arange(len(labels)), np.diff(first))
    order = rng.permutation(len(labels))[:FINDINGS]
    apart, own = order[: len(order) // 4], order[len(order) // 4 :]
    shown = lambda findings: np.concatenate([np.arange(first[f], first[f + 1]) for f in findings])
    net = _new_network(rng)
    mean, square, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    for _ in range(rounds):
        used = shown(own)
        if len(used) > len(own):  # of a key its surest view
            raw = np.full(len(codes), -np.inf)
            raw[used] = _raw(net, codes[used])
            used = np.concatenate([shown(own[labels[own] == 0]), [first[f] + raw[first[f] : first[f + 1]].argmax() for f in own[labels[own] == 1]]]).astype(int)
        rng.shuffle(used)
        for at in range(0, len(used), batch):
            c, y = codes[used[at : at + batch]], labels[of[used[at : at + batch]]]
            raw, kept = net.forward(c)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(c)
            step += 1
            for p, m, v, g in zip(net.parameters(), mean, square, net.backward(c, kept, slope), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    ends = np.cumsum([0, *(first[apart + 1] - first[apart])])[:-1]
    raw, y = np.maximum.reduceat(_raw(net, codes[shown(apart)]), ends), labels[apart]
    for _ in range(200):  # Platt scaling by gradient steps
        off = 1 / (1 + np.exp(-np.clip(net.scale * raw + net.offset, -30, 30))) - y
        net.scale -= 0.1 * float((off * raw).mean() + 1e-3 * net.scale)
        net.offset -= 0.1 * float(off.mean())
    sure, many = 1 / (1 + np.exp(-np.clip(net.scale * raw + net.offset, -30, 30))), first[apart + 1] - first[apart] > 1
    kept = [np.sort(sure[(y == 1) & (many == m)]) for m in (False, True)]
    net.threshold = float(min((k[int((1 - RECALL) * len(k))] for k in kept if len(k)), default=0.5))
    return net


def labelled_findings(n: int = 6000, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """Generated findings (text, start, stop, label): keys of many kinds, and runs of key characters that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    any_of = lambda *choices: choices[rng.integers(len(choices))]
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    word = lambda: pick("etaoinshrdlucmfw", int(rng.integers(2, 9)))
    number = lambda k: pick(string.digits, k)
    mark = lambda: any_of(" = '", ": ", "=", '":"', ' = "', "='")
    keys = (  # body, and whether its lead alone tells it
        (lambda: any_of("ghp_", "sk_live_", "xoxb-", "glpat-", "AIza", "SG-", "") + pick(alnum + "+/" * int(rng.integers(2)), int(rng.integers(24, 64))), False),
        (lambda: any_of("ghp_", "sk_live_", "xoxb-", "glpat-", "AIza", "SG-") + pick(alnum + "+/" * int(rng.integers(2)), int(rng.integers(24, 64))), False),
        (lambda: pick(alnum, int(rng.integers(12, 24))), False),
        (lambda: pick(hexes, any_of(16, 24, 32, 40, 64)), True),
        (lambda: word()[:6] + pick(alnum, int(rng.integers(4, 9))) + number(2), True),
        (lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), False),
    )
    told = ("key", "auth", "Authorization: Bearer", "credential", "pwd", "client_key", "password", "secret", "token", "api_key", "passwd", "apikey")
    said = (*told, "private", "access", "sig")
    calm = ("id", "see", "commit", "file", "path", "uuid", "build", "ref", "section", "from", "on", "call", "card", "at", "page", "item")
    none = (
        lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)),
        lambda: "/".join(word() for _ in range(6)) + f"/{rng.integers(1000)}",
        lambda: "_".join(word() for _ in range(5)) + f"_{rng.integers(99)}",
        lambda: "-".join(word() for _ in range(5)) + f"-{rng.integers(2030)}",
        lambda: pick("-=_", 1) * int(rng.integers(20, 60)) + f"{word()}{rng.integers(9)}",
        lambda: "".join(word().title() for _ in range(any_of(2, 3, 5))) + any_of("", f"{rng.integers(99)}"),
        lambda: word() + "".join(word().title() for _ in range(2)),
        lambda: f"{rng.integers(1900, 2030)}-{word()}/" + word() * 4,
        lambda: f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}" + any_of("", f"T{rng.integers(10, 24)}"),
        lambda: number(any_of(8, 9, 10, 12)),
        lambda: number(16),
        lambda: "-".join(number(4) for _ in range(4)),
        lambda: any_of("", "+1-", "+49-") + f"{number(3)}-{number(3)}-{number(4)}",
        lambda: word() + word() + number(2),
        lambda: "v" + number(1) + "-" + word() + "-rc" + number(1),
        lambda: pick(hexes, any_of(8, 12, 16, 40)),
    )
    found = []
    for i in range(n):
        secret = i % 2
        if secret:
            body, by_lead = any_of(*keys)
            lead = any_of(*told) + mark() if by_lead else any_of(*said) + any_of(mark(), " ")
            body = body()
        else:
            body = any_of(*none)()
            lead = " ".join(word() for _ in range(2)) + any_of(" " + any_of(*calm), "", ",", ".") + any_of(" ", ": ", "/", " (", " ")
        before = " ".join(word() for _ in range(4)) + " " + lead
        text = f"{before}{body}{any_of('', chr(39), chr(34), '.', ' ', ',')} {word()} {word()}"
        found.append((text, len(before), len(before) + len(body), secret))
    return found


def long_findings(n: int = 1200, seed: int = 6) -> list[tuple[str, int, int, int]]:
    """Generated findings in long paths: with a key among the parts, and with none."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    word = lambda: "".join(pick(string.ascii_lowercase, 1) + pick("aeiou", 1) + pick("rnstlcm", 1) * int(rng.integers(2)) for _ in range(rng.integers(1, 5)))
    calm = (
        word,
        lambda: f"v{rng.integers(9)}",
        lambda: "-".join(word() for _ in range(3)),
        lambda: f"{word()}_{rng.integers(2030)}",
        lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: "".join(word().title() for _ in range(4)) + f"{rng.integers(99)}",
        lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1, 13)}-{rng.integers(1, 29)}",
    )
    found = []
    for i in range(n):
        parts = [calm[rng.integers(len(calm))]() for _ in range(int(rng.integers(7, 18)))]
        if i % 2:
            parts.insert(int(rng.integers(len(parts))), pick(string.ascii_letters + string.digits + "-_" * int(rng.integers(2)), int(rng.integers(24, 64))))
        body, before = "/".join(parts) + f"/{rng.integers(99)}", word() + (" ", ": ", " =")[rng.integers(3)]
        found.append((f"{before}{body} {word()} {word()}", len(before), len(before) + len(body), i % 2))
    return found


def fit(spark: SparkSession, findings: list[tuple[str, int, int, int]] | None = None) -> Network:
    """A network trained in one task; ``findings``: text, start, stop, label."""

    def trained(_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = findings if findings is not None else labelled_findings() + long_findings()
        shown = [(n, i, j) for n, (text, start, stop, _) in enumerate(known) for i, j in views(text, start, stop)]
        net = train(np.stack([window(known[n][0], i, j) for n, i, j in shown]), np.array([y for *_, y in known], float), of=np.array([n for n, *_ in shown]))
        parts = [*net.parameters(), np.array([net.scale, net.offset, net.threshold])]
        yield pd.DataFrame({"shape": [list(p.shape) for p in parts], "values": [p.ravel() for p in parts]})

    rows = spark.range(1, numPartitions=1).mapInPandas(trained, "shape array<long>, values array<double>").collect()  # eight rows
    *parts, ends = [np.array(r["values"]).reshape(r["shape"]) for r in rows]
    return Network(*parts, *ends.tolist())


# ---- scans


def scan(texts: list[str | None], net: Network) -> list[tuple[list[Span], list[tuple[int, int, float]]]]:
    """For each text all spans, by start and kind, and every candidate with its probability."""
    base, runs, per_text = [], [], []
    for at, text in enumerate(texts):
        spans, asked = found_in(text or "")
        base.append(spans)
        runs += [(at, i, j) for i, j in asked]
        per_text.append(len(asked))
    best = np.zeros(len(runs))
    views_of = ((n, k, m) for n, (at, i, j) in enumerate(runs) for k, m in views(texts[at], i, j))
    for part in itertools.batched(views_of, 512):
        np.maximum.at(best, [n for n, *_ in part], net.probability(np.stack([window(texts[runs[n][0]], k, m) for n, k, m in part])))
    found, at = [], 0
    for spans, n in zip(base, per_text, strict=True):
        scored = [(i, j, p) for (_, i, j), p in zip(runs[at : at + n], best[at : at + n].tolist(), strict=True)]
        model = uncovered([(i, j) for i, j, p in scored if p >= net.threshold], spans)
        found.append((sorted([*spans, *((i, 3, j) for i, j in model)]), scored))
        at += n
    return found


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few hundred rows, which bounds what is scanned at once."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)


def _reported(net: Network):
    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            both = scan(b.column("text").to_pylist(), net)
            found = [x for x, _ in both]
            base = [[s for s in x if s[1] < 3] for x in found]
            counts = [pa.array([sum(k == kind for _, k, _ in x) for x in base], pa.int64()) for kind in range(3)]
            digests = pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base], pa.string())
            scores = pa.array([",".join(f"{i}:{j}:{p:.3f}" for i, j, p in x) for _, x in both], pa.string())
            columns = [b.column("doc_id"), *counts, digests, pa.array([_joined(x) for x in found], pa.string()), pa.array([len(x) for _, x in both], pa.int64()), scores]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_scored", "scores"])

    return reported


def report(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Contract rows: doc_id, n_assign, n_access, n_hex, base_sha256, spans; and n_scored and scores (start:end:probability) of all candidates."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = _reported(net or fit(docs.sparkSession))
    return docs.select("doc_id", "text").mapInArrow(found, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_scored long, scores string")


def masked(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    parts, at = [], 0
    for i, _, j in sorted(spans):
        if i >= at:
            parts += (text[at:i], mark)
        at = max(at, j)
    return "".join([*parts, text[at:]])


def _redacted(net: Network):
    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            texts = b.column("text").to_pylist()
            new = [masked(t, s) if s else t for t, (s, _) in zip(texts, scan(texts, net), strict=True)]
            yield b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(new, b.schema.field("text").type))

    return redacted


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``docs`` with every secret masked in ``text``; an ``n_chars`` column is counted anew."""
    out = docs.mapInArrow(_redacted(net or fit(docs.sparkSession)), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out

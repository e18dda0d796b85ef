"""Secret scan: base patterns, and a character convolutional network over every other candidate with its context.

Candidates are the runs of ``LEAST`` or more characters of ``[A-Za-z0-9+/_.=-]``, or what base spans leave of them. The
network (numpy) slides over the whole of a candidate: it reads ``WINDOW`` characters at a time, with the characters before and
after them, and a longer candidate in windows that overlap by half. Windows that score high enough make the span, joined where they
overlap. The network is trained on the driver, on labelled findings: what a base span covers of a run is a labelled secret,
other runs of the corpus are not, each side a bounded sample of ``SAMPLE`` rows (the smallest hashes of the windows, whatever the
partitioning), and ``DRAWN`` rows for each side are drawn from the fixed forms below with a fixed seed, alone and inside longer
runs, so that secrets of forms unknown to the patterns are seen and an empty corpus still has a model. A fifth of the rows
calibrates the score (Platt) and sets the threshold: the highest one that keeps ``RECALL`` of the labelled secrets, where half of
what may be lost is kept back for the error of that sample.

Every text is read whole, in two passes without a shuffle: one samples, one scans and scores. Null text is empty and has no
spans; repeated rows give repeated results; further columns aren't read by ``scan``. Offsets count code points.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 2000
DRAWN = 3000
RECALL = 0.98
#: Characters of a candidate, of a window, and around it; from one window to the next of a long candidate.
LEAST, WINDOW, AROUND, STEP = 16, 64, 24, 32

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = re.compile(r"(?ai:passw|secret|token|api)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order; kinds are numbered as in ``KINDS``."""
    out = []
    if ASSIGN_WORDS.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, covered by a base span) of all parts of runs that are long enough."""
    begins, ends = [], []  # base spans, merged where they overlap
    for a, _, b in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    out = []
    for m in RUN.finditer(text):
        at, k = m.start(), bisect.bisect_right(ends, m.start())
        while k < len(begins) and begins[k] < m.end():
            out += [(at, begins[k], False), (max(at, begins[k]), min(ends[k], m.end()), True)]
            at, k = min(ends[k], m.end()), k + 1
        out.append((at, m.end(), False))
    return [c for c in out if c[1] - c[0] >= LEAST]


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of a candidate that the network reads, which cover all of it."""
    if end - start <= WINDOW:
        return [(start, end)]
    return [(a, a + WINDOW) for a in [*range(start, end - WINDOW, STEP), end - WINDOW]]


def window(text: str, start: int, end: int) -> str:
    """What the network reads of a stretch: the characters before, the stretch itself and the characters after it, padded."""
    return (text[max(0, start - AROUND):start].rjust(AROUND, "\0") + text[start:end].ljust(WINDOW, "\0")
            + text[end:end + AROUND].ljust(AROUND, "\0"))


# ------------------------------------------------------------------ labelled findings

def drawn(n: int, seed: int = 7) -> tuple[list[str], list[str]]:
    """Windows of secrets and of harmless runs in fixed public forms, with neutral and telling contexts."""
    rng = random.Random(seed)
    letters, digits = string.ascii_letters, string.digits

    def some(alphabet, k):
        return "".join(rng.choices(alphabet, k=k))

    def word():
        return some(string.ascii_lowercase, rng.randint(2, 9))

    secret = [lambda: some(letters + digits + "+/", rng.choice([24, 32, 40, 44, 64])), lambda: "ghp_" + some(letters + digits, 36),
              lambda: "sk_live_" + some(letters + digits, 24), lambda: "AIza" + some(letters + digits + "_-", 35),
              lambda: "xoxb-" + some(digits, 12) + "-" + some(letters + digits, 24), lambda: some("0123456789abcdef", rng.choice([32, 40, 64])),
              lambda: "eyJ" + some(letters + digits, 30) + "." + some(letters + digits + "_-", 40), lambda: some(letters + digits, rng.randint(20, 40)),
              lambda: some(letters, rng.randint(28, 40))]
    plain = [lambda: "/".join(word() for _ in range(4)) + f"/{rng.randint(1, 999)}", lambda: f"{word()}.{word()}.example.{rng.choice(['com', 'org'])}/{rng.randint(1, 99)}",
             lambda: f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{word()}-{word()}", lambda: some(digits, rng.randint(16, 24)),
             lambda: f"{word()}_{word()}_{word()}_v{rng.randint(1, 20)}", lambda: f"{word()}{word()}{word()}{rng.randint(1, 9999)}",
             lambda: "=" * rng.randint(15, 40) + str(rng.randint(0, 9)), lambda: "-".join(some(digits, 4) for _ in range(4)),
             lambda: f"{word()}.{rng.randint(1, 99)}{'.' * 16}", lambda: f"{word()}-{word()}.{word()}.{rng.randint(1, 99)}.{rng.randint(1, 99)}",
             lambda: "".join(word() for _ in range(4)) + word()[:4], lambda: "".join(word().title() for _ in range(4)), lambda: rng.choice("-_=.+/") * rng.randint(16, 80),
             lambda: "_".join(word() for _ in range(4)), lambda: "-".join(word() for _ in range(4)), lambda: ".".join(word() for _ in range(5)),
             lambda: "/".join(word() for _ in range(12)), lambda: "_".join(word().upper() for _ in range(4))]
    contexts = [lambda: " ".join(word() for _ in range(4)) + " ", lambda: f"{word()} = \"", lambda: f"{word()}: ", lambda: f"https://{word()}.", lambda: "\n"]

    def make(forms, inside):
        rows = []
        for i in range(n):
            run, context, after = forms[i % len(forms)](), rng.choice(contexts)(), rng.choice(["", '"', "\n", " ", " " + word(), "'," + word()])
            if inside and i % 3 == 0:  # a secret within a longer run, wherever a window lies over it
                around = "/".join(word() for _ in range(8)) + "/"
                text = context + around + run + "/" + around + after
                start = len(context) + len(around) - rng.randint(0, max(0, WINDOW - len(run)))
                rows.append(window(text, start, min(len(text) - len(after), start + WINDOW)))
                continue
            a, b = rng.choice(windows(len(context), len(context) + len(run)))
            rows.append(window(context + run + after, a, b))
        return rows

    return make(secret, True), make(plain, False)


def labelled(docs: DataFrame, text: str = "text") -> tuple[list[str], list[str]]:
    """The bounded sample of labelled windows of the corpus."""

    def sample(batches):
        kept = {False: {}, True: {}}
        for batch in batches:
            for source in batch.column(0).to_pylist():
                if source:
                    for start, end, covered in candidates(source, base_spans(source)):
                        for a, b in windows(start, end):
                            w = window(source, a, b)
                            kept[covered][w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) >> 1
            for label, rows in kept.items():
                if len(rows) > 4 * SAMPLE:
                    kept[label] = dict(sorted(rows.items(), key=lambda r: r[1])[:SAMPLE])
        rows = [(w, h, label) for label, some in kept.items() for w, h in sorted(some.items(), key=lambda r: r[1])[:SAMPLE]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["window", "hash", "label"])

    found = stored(docs.select(docs[text].alias("text")).mapInArrow(sample, "window string, hash bigint, label boolean"), "findings")
    top = found.groupBy("label", "window", "hash").agg(F.count(F.lit(1)))
    yes, no = ([r["window"] for r in top.where(F.col("label") == label).orderBy("hash", "window").limit(SAMPLE).collect()]
               for label in (True, False))
    return yes, no


# ------------------------------------------------------------------ the network

def encode(windows: list[str]) -> np.ndarray:
    """Character numbers: printable ASCII from 1, padding 0, everything else 96."""
    width = WINDOW + 2 * AROUND
    raw = np.frombuffer("".join(windows).encode("utf-32-le", "replace"), np.uint32).reshape(-1, width)
    return np.where(raw == 0, 0, np.where((raw >= 32) & (raw < 127), raw - 31, 96)).astype(np.int64)


class Network:
    """Embedding, convolutions over the window and over the characters before and after it, their largest and mean responses, and
    one dense layer."""

    WIDTH, DIM, FILTERS, HIDDEN = 5, 8, 24, 24

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        k = self.WIDTH * self.DIM
        self.w = {"e": normal(97, self.DIM, scale=0.5), "c0": normal(k, self.FILTERS, scale=k ** -0.5), "b0": np.zeros(self.FILTERS, np.float32),
                  "c1": normal(k, self.FILTERS, scale=k ** -0.5), "b1": np.zeros(self.FILTERS, np.float32),
                  "c2": normal(k, self.FILTERS, scale=k ** -0.5), "b2": np.zeros(self.FILTERS, np.float32),
                  "h": normal(6 * self.FILTERS, self.HIDDEN, scale=0.2), "bh": np.zeros(self.HIDDEN, np.float32),
                  "o": normal(self.HIDDEN, scale=0.3), "bo": np.zeros(1, np.float32)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _parts(self, x):
        return ("0", x[:, :AROUND]), ("1", x[:, AROUND:AROUND + WINDOW]), ("2", x[:, AROUND + WINDOW:])

    def forward(self, x: np.ndarray, keep: bool = False):
        w, pooled, memo = self.w, [], {}
        for name, part in self._parts(x):
            e = w["e"][part]
            n = part.shape[1] - self.WIDTH + 1
            columns = np.concatenate([e[:, i:i + n] for i in range(self.WIDTH)], axis=2)
            r = np.maximum(columns @ w["c" + name] + w["b" + name], 0)
            pooled += [r.max(1), r.mean(1)]
            memo[name] = (part, columns, r, r.argmax(1)) if keep else None
        f = np.concatenate(pooled, axis=1)
        a = f @ w["h"] + w["bh"]
        z = np.maximum(a, 0) @ w["o"] + w["bo"]
        return (z, f, a, memo) if keep else z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, g = self.w, {k: np.zeros_like(v) for k, v in self.w.items()}
        z, f, a, memo = self.forward(x, keep=True)
        dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        h = np.maximum(a, 0)
        g["o"], g["bo"] = h.T @ dz, dz.sum(keepdims=True)
        da = dz[:, None] * w["o"] * (a > 0)
        g["h"], g["bh"] = f.T @ da, da.sum(0)
        df = da @ w["h"].T
        for i, (name, _) in enumerate(self._parts(x)):
            part, columns, r, top = memo[name]
            dmax, dmean = (df[:, (2 * i + j) * self.FILTERS:(2 * i + j + 1) * self.FILTERS] for j in (0, 1))
            dr = np.repeat(dmean[:, None] / r.shape[1], r.shape[1], axis=1)
            np.put_along_axis(dr, top[:, None], np.take_along_axis(dr, top[:, None], 1) + dmax[:, None], 1)
            dr *= r > 0
            flat = dr.reshape(-1, self.FILTERS)
            g["c" + name], g["b" + name] = columns.reshape(-1, columns.shape[2]).T @ flat, flat.sum(0)
            dc = (flat @ w["c" + name].T).reshape(columns.shape)
            for j in range(self.WIDTH):
                np.add.at(g["e"], part[:, j:j + r.shape[1]], dc[:, :, j * self.DIM:(j + 1) * self.DIM])
        return g

    def probability(self, windows: list[str]) -> np.ndarray:
        z = np.concatenate([self.forward(encode(windows[i:i + 2048])) for i in range(0, len(windows), 2048)]) if windows else np.zeros(0)
        return 1 / (1 + np.exp(-(self.slope * z + self.shift)))


def fit(yes: list[str], no: list[str], epochs: int = 16, seed: int = 5) -> Network:
    """Train, calibrate and set the threshold. Half of the secrets are also shown without context, so that the run itself is
    learned and not only the word before it."""
    rng = np.random.default_rng(seed)
    drawn_yes, drawn_no = drawn(DRAWN)
    bare = ["\0" * AROUND + w[AROUND:AROUND + WINDOW] + "\0" * AROUND for w in yes[::2]]
    x = encode(yes + bare + drawn_yes + no + drawn_no)
    y = np.concatenate([np.ones(len(yes) + len(bare) + len(drawn_yes)), np.zeros(len(no) + len(drawn_no))]).astype(np.float32)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5:]
    net = Network()
    m, v, t = {k: np.zeros_like(a) for k, a in net.w.items()}, {k: np.zeros_like(a) for k, a in net.w.items()}, 0
    for _ in range(epochs):
        rng.shuffle(used)
        for i in range(0, len(used), 128):
            rows = used[i:i + 128]
            t += 1
            for k, g in net.gradients(x[rows], y[rows]).items():  # Adam
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.w[k] -= (0.004 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    z, truth = np.concatenate([net.forward(x[held[i:i + 2048]]) for i in range(0, len(held), 2048)]).astype(float), y[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt scaling by Newton steps, slightly regularised
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = p * (1 - p)
        g0, g1 = ((p - truth) * z).sum() + 1e-2 * (a - 1), (p - truth).sum() + 1e-2 * b
        h00, h01, h11 = (s * z * z).sum() + 1e-2, (s * z).sum(), s.sum() + 1e-2
        det = h00 * h11 - h01 * h01
        a, b = a - np.clip((h11 * g0 - h01 * g1) / det, -1, 1), b - np.clip((h00 * g1 - h01 * g0) / det, -1, 1)
    net.slope, net.shift = max(a, 1e-3), b
    p = np.sort(1 / (1 + np.exp(-(net.slope * z[truth == 1] + net.shift))))
    net.threshold = float(min(p[int((1 - RECALL) / 2 * len(p))], 0.999999)) if len(p) else 0.5
    return net


# ------------------------------------------------------------------ the scan

def spans_of_all(texts: list[str], net: Network) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans, and all spans with those that the network adds. All windows are scored together."""
    out, where, read = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, list(base)))
        for start, end, covered in candidates(text, base):
            if not covered:
                for a, b in windows(start, end):
                    where.append((i, a, b))
                    read.append(window(text, a, b))
    hits = net.probability(read) >= net.threshold
    last = None  # (text, start, end) of the span that may go on
    for k in np.flatnonzero(hits).tolist():
        i, a, b = where[k]
        if last and last[0] == i and a < last[2]:
            last = (i, last[1], b)
            out[i][1][-1] = (last[1], 3, b)
        else:
            last = (i, a, b)
            out[i][1].append((a, 3, b))
    return [(base, sorted(every)) for base, every in out]


def spans_of(text: str, net: Network) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    return spans_of_all([text], net)[0]


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def trained(docs: DataFrame, text: str = "text") -> Network:
    return fit(*labelled(docs, text))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", net: Network | None = None) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net or trained(docs, text))

    def run(batches):
        for batch in batches:
            rows = []
            for base, every in spans_of_all([source or "" for source in batch.column(1).to_pylist()], shared.value):
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(every)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds))], names=names)

    names = ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"key {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("key", key)


def masked(text: str, net: Network, mark: str = "[secret]") -> str:
    return _masked(text, spans_of(text, net)[1], mark)


def _masked(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", net: Network | None = None) -> DataFrame:
    """All rows and columns, with every secret in the text replaced by a mark; null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(net or trained(docs, text))
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = spans_of_all([t or "" for t in texts], shared.value)
            new = [None if t is None else _masked(t, every) for t, (_, every) in zip(texts, found)]
            columns = [pa.array(new, batch.column(place).type) if i == place else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

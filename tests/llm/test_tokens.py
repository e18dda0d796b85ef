"""Packing, language model and secrets."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkverbs.llm import language_model, packing, secrets
from tests.llm.conftest import ODD

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["", " ", "\n\n", "a  b", "don't we'll I'VE", "x \n\ny", "a  b　　c", "end <|endoftext|> more<|endoftext|>", "word.word,word! (x) a_b a'b '' 12a3",
         "tab\t\tnew\r\n \r\n line  ", "äöü ß. 你好 世界。 \U0001f600\U0001f600 é", "—.— x", "a\x85b \x1c\x1f c", "trailing   ", "   leading", "it's’s o'clock"]


def test_ids_are_those_of_the_tokenizer():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab .,'\n\tä  1<|>dst", k=rng.randint(1, 60))) for _ in range(2000)]
    ids, counts = packing.Encoder.at(public_tokenizers.path("byte_bpe_50k.json")).encode(pa.array(texts))
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, packed, size):
    by_row = Counter()
    for r in rows:
        ids = np.array(TOKENIZER.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        head = len(ids) - (-(-len(ids) // size) - 1) * size
        edges = [0, *range(head, len(ids) + 1, size)]
        by_row.update((str(r[0]), i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:])))
    assert by_row == Counter((str(p[0]), p.piece, p.start, p.length, p.ids_crc32) for p in packed)
    places = defaultdict(list)
    for p in packed:
        places[p.sequence_id].append((p.offset, p.length))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= size
    return places


def best_fit_decreasing(lengths, size):
    """Number of sequences of the serial algorithm."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(size - n)
    return len(gaps)


@pytest.mark.parametrize("size", [7, 64])
def test_packing(docs, size):
    rng = random.Random(size)
    rows = ODD + [(100 + i, " ".join(rng.choices(["word", "the", "x1", "äh"], k=rng.randint(0, 60))), "en", "s") for i in range(150)]
    packed = packing.pack(docs(rows), size=size).collect()
    places = check_packing(rows, packed, size)
    assert len(places) == best_fit_decreasing([p.length for p in packed], size)


def test_sequences_hold_the_ids(docs):
    rows = ODD + [(50, "some words " * 40, "en", "s")]
    got = packing.sequences(packing.pack(docs(rows), size=32, keep_ids=True)).collect()
    ids = [x for _, t, *_ in rows for x in TOKENIZER.encode(t or "", add_special_tokens=False).ids + [0]]
    assert Counter(x for r in got for x in r.input_ids) == Counter(ids) and all(len(r.input_ids) <= 32 for r in got)
    assert packing.pack(docs([])).count() == 0


def test_the_tokenizer_gets_many_stretches_at_once():
    """Unknown stretches are handed over joined, with the ids that each has by itself; also where a special token is in one."""
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    given = []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            given.append(len(texts))
            return TOKENIZER.encode_batch_fast(texts, **more)

    encoder.tokenizer = Counting()
    some = [f" word{i}" for i in range(500)] + ["\n\n", "  ", "a", "'s", " ä\u00a0", "<|", "|>", " <|endoftext", "", "x y\t"] + ["\x00", " 😀", "don", "'t"] * 5
    want = [np.array(TOKENIZER.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in some]
    assert encoder._encoded(some) == want and given[-1] <= len(some) / 10
    some.append("a <|endoftext|> b")
    assert encoder._encoded(some) == [*want, np.array(TOKENIZER.encode(some[-1], add_special_tokens=False).ids, "<u4").tobytes()]


def test_sweep_equals_serial_best_fit():
    rng = random.Random(5)
    for size in (10, 64, 100):
        for _ in range(60):
            lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 200))]
            runs, n = packing.sweep(Counter(lengths), size)
            assert n == best_fit_decreasing(lengths, size)
            assert sum(r[4] for r in runs) == len(lengths)


def test_scores_against_plain_loops(docs):
    rng = random.Random(2)
    rows = ODD + [(100 + i, " ".join(rng.choices(["The", "the", "cat", "sat", "on", f"r{i}", "mät"], k=30)), "en", "s") for i in range(40)]
    rows += [(200 + i, " ".join(f"w{rng.randint(0, 40) ** 2}" for _ in range(200)), "en", "s") for i in range(20)]
    rows.append((300, " ".join(f"x{i}" for i in range(30_000)), "en", "s"))  # a very long text; the order of its words is tied
    frame = docs(rows)

    def split(text):
        return re.findall(r"[^\x20\x09-\x0D]+", text or "")

    def lower(word):
        return re.sub("[A-Z]", lambda m: m[0].lower(), word)

    model = language_model.train(frame)

    def naive(text):
        words = [lower(w) for w in split(text)]
        s = [0] + [model.symbols.of.get(w) or 1 + language_model.TOP + zlib.crc32(w.encode()) % language_model.BUCKETS for w in words] + [0]
        return len(words), sum(float(model.table[s[i], s[i + 1], s[i + 2]]) + share(w) for i, w in enumerate(words))

    slots, types, buckets = Counter(), Counter(), Counter()
    for w, n in Counter(lower(w) for _, t, *_ in rows for w in split(t)).items():
        if w not in model.symbols.of:
            slots[zlib.crc32(w.encode()) % language_model.SLOTS] += n
            types[zlib.crc32(w.encode()) % language_model.SLOTS] += 1
            buckets[zlib.crc32(w.encode()) % language_model.BUCKETS] += n

    def share(w):
        if w in model.symbols.of:
            return 0.0
        h = zlib.crc32(w.encode())
        slot, bucket = h % language_model.SLOTS, h % language_model.BUCKETS
        assert slots[slot]  # every word is one of the corpus here
        return math.log(slots[slot] / types[slot] / (buckets[bucket] + 1))

    got = sorted((str(r[0]), r[1], round(r[2], 4), r[3] is None) for r in language_model.score(frame, model=model).collect())
    assert got == sorted((str(i), naive(t)[0], round(naive(t)[1], 4), naive(t)[0] == 0) for i, t, *_ in rows)
    assert language_model.score(docs([])).count() == 0


def test_shares_add_up_and_follow_frequency(docs):
    """Over all slots of a bucket the parts add up to one; a frequent word is worth more than a rare one, an unknown one less."""
    lm = language_model
    rng = np.random.default_rng(5)
    slot = rng.choice(lm.SLOTS, 500, replace=False)
    n, types = rng.integers(1, 1000, 500), rng.integers(1, 3, 500)
    share = lm.shares(slot, n, types)
    words = np.ones(lm.SLOTS)
    words[slot] = types
    assert share[lm.SLOTS] == 0
    assert np.allclose((np.exp(share[:-1].astype(float)) * words).reshape(-1, lm.BUCKETS).sum(0), 1, atol=1e-3)
    none = lm.shares(*[np.zeros(0, np.int64)] * 3)
    assert np.allclose(np.exp(none[:-1].astype(float)).reshape(-1, lm.BUCKETS).sum(0), 1, atol=1e-3)

    top = [f"t{i} " * 5000 for i in range(lm.TOP)]  # the words that are symbols of their own
    model = lm.train(docs([(1, "".join(top) + "often " * 900 + "seldom " * 3, "en", "s")]))
    assert "often" not in model.symbols.of
    often, seldom, never = (float(model.share[zlib.crc32(w) % lm.SLOTS]) for w in (b"often", b"seldom", b"never"))
    assert zlib.crc32(b"often") % lm.BUCKETS == zlib.crc32(b"seldom") % lm.BUCKETS or often == pytest.approx(math.log(900 / 901))
    assert zlib.crc32(b"often") % lm.BUCKETS == zlib.crc32(b"seldom") % lm.BUCKETS or seldom == pytest.approx(math.log(3 / 4))
    assert never < seldom <= often


def test_words_of_one_slot_have_their_own_shares(docs, monkeypatch):
    """Two words that are hashed alike, one frequent and one rare, each with its own count; also if the tasks hold few words."""
    lm = language_model
    met, i = {}, 0
    while True:
        w = f"v{i}"
        slot, i = zlib.crc32(w.encode()) % lm.SLOTS, i + 1
        if slot in met:
            often, seldom = met[slot], w
            break
        met[slot] = w
    top = " ".join(f"t{i} " * 3000 for i in range(lm.TOP))
    rows = [(1, top, "en", "s"), (2, f"{often} " * 900, "en", "s"), (3, f"{seldom} " * 3, "en", "s"), (3, seldom, "en", "s"), (None, None, "en", "s")]
    rows.append((4, " ".join(f"u{i} " * 2 for i in range(50)), "en", "s"))
    other = [*rows[1:], (9, "nowhere else", "en", "s")]
    bucket = zlib.crc32(often.encode()) % lm.BUCKETS
    total = 904 + sum(2 for i in range(50) if zlib.crc32(f"u{i}".encode()) % lm.BUCKETS == bucket)
    symbol, got = 1 + lm.TOP + bucket, []
    for common in (lm.COMMON, 10, 0):
        monkeypatch.setattr(lm, "COMMON", common)
        model = lm.train(docs(rows))
        assert (model.rest is None) == (common > 10) and len(model.scorer.common) <= lm.TOP + common
        got.append(sorted((str(r.doc_id), r.n_tokens, round(r.log_prob, 6), r.mean_log_prob is None) for r in lm.score(docs(other), model=model).collect()))
        one = {r.n_tokens: r.log_prob for r in lm.score(docs(rows), model=model).collect()}
        assert one[1] == pytest.approx(float(model.table[0, symbol, 0]) + math.log(4 / (total + 1)), abs=1e-4)
        inside = float(model.table[0, symbol, symbol]) + float(model.table[symbol, symbol, 0]) + 898 * float(model.table[symbol, symbol, symbol])
        assert one[900] == pytest.approx(inside + 900 * math.log(900 / (total + 1)), rel=1e-4)
    assert got[0] == got[1] == got[2] and len(got[0]) == len(other)


def test_counts_are_those_of_all_texts(docs):
    frame = docs(ODD)
    words = {r.word: r.n for r in language_model.vocabulary(frame).collect()}
    assert words == Counter(w.lower() for _, t, *_ in ODD for w in (t or "").split())
    symbols = language_model.Symbols(["one", "two"])
    assert sum(r.n for r in language_model.contexts(frame, symbols).collect()) == sum(words.values())


def test_network_learns_from_both_sides():
    """A token that its two neighbours determine together is predicted far better than by its frequency."""
    s = language_model.SYMBOLS
    counts = np.zeros((s, s, s - 1))
    for a in range(1, 9):
        for b in range(1, 9):
            counts[a, b, (a + b) % 8] = 10
    net = language_model.Network()
    losses = net.fit(counts, steps=300)
    assert losses[0] > 1.9 and losses[-1] < 0.5
    assert np.allclose(np.exp(net.table()[:, 1:, :].astype(float)).sum(1), 1, atol=1e-4)


BASE = [("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]


def brute_base(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m))


def test_base_spans_against_brute_force(docs):
    rng = random.Random(6)
    bits = ["token = \"", "Password: ", "API_KEY='", "apikey=", "secret", " = ", "AKIA" + "ABCD1234" * 2, "AKIAB", "deadbeef" * 5, "0a1", "äſ ", "\n", "'", "hunter2hunter2 ", "Key"]
    rows = ODD + [(100 + i, "".join(rng.choices(bits, k=rng.randint(1, 25))), "en", "s") for i in range(300)] + [(900, "x " * 100_000 + "f" * 40, "en", "s")]
    net = secrets.fit([], [], epochs=1)
    for r in secrets.scan(docs(rows), net=net).collect():
        said = set(r.spans.split(",")) if r.spans else set()
        texts = [t for i, t, *_ in rows if i == r.doc_id]
        want = [brute_base(t) for t in texts]
        joined = [",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in w) for w in want]
        assert r.base_sha256 in [hashlib.sha256(j.encode()).hexdigest() for j in joined]
        k = [hashlib.sha256(j.encode()).hexdigest() for j in joined].index(r.base_sha256)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == i for x in want[k]) for i in range(3))
        assert {x for x in said if not x.startswith("cnn")} == set(joined[k].split(",")) - {""}


@pytest.fixture(scope="module")
def net():
    return secrets.fit([], [])


def test_network_on_held_out_findings(net):
    yes, no = secrets.drawn(1500, seed=1234)
    p, q = net.probability(yes), net.probability(no)
    assert (p >= net.threshold).mean() >= secrets.RECALL and (q >= net.threshold).mean() <= 0.04


KEY = "ghp_x8Kq2LmZ0vT5bN7cR1wY4dJ6fH9gS3aPqE2u"


@pytest.mark.parametrize("text", ["a/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p/q/" + KEY + "/a/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p/q", "path/" * 40 + KEY + "/path" * 40,
                                  "https://host.example/download/file?sig=" + KEY, KEY, "say " + KEY + " twice " + KEY])
def test_every_character_is_read(net, text):
    base, every = secrets.spans_of(text, net)
    spans = [(a, b) for a, k, b in every if k == 3]
    for at in [m.start() for m in re.finditer(KEY, text)]:
        assert any(a <= at and at + len(KEY) <= b for a, b in spans)
    assert KEY not in secrets.masked(text, net)


def test_candidates_cover_what_base_spans_leave():
    text = "x" * 20 + "token=abcdefgh1234" + "=" * 3 + " " + "AKIA" + "A1" * 10 + "-rest-of-the-run-goes-on " + "short -" + "z" * 200
    base = secrets.base_spans(text)
    taken = {i for a, _, b in base for i in range(a, b)}
    got = secrets.candidates(text, base)
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]{16,}", text):
        rest = [i for i in range(*m.span()) if i not in taken]
        for i in rest:
            alone = next(iter([j for j in range(i, m.end() + 1) if j in taken or j == m.end()])) - next(iter([j for j in range(i, m.start() - 2, -1) if j in taken or j < m.start()])) - 1
            assert alone < 16 or any(a <= i < b and not covered for a, b, covered in got)
    assert all(covered == (a in taken) for a, b, covered in got)
    assert {i for a, b in secrets.windows(5, 300) for i in range(a, b)} == set(range(5, 300))


def test_gradients_are_right():
    net = secrets.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = secrets.encode(secrets.drawn(4)[0]), np.array([1, 0, 1, 1.0])

    def loss():
        z = net.forward(x)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    got, rng = net.gradients(x, y), np.random.default_rng(0)
    for name, w in net.w.items():
        at = tuple(rng.integers(0, n) for n in w.shape) if name != "e" else (int(x[0, 30]), 3)
        old = w[at]
        w[at] = old + 1e-6
        up = loss()
        w[at] = old - 1e-6
        down = loss()
        w[at] = old
        assert math.isclose((up - down) / 2e-6, got[name][at], rel_tol=1e-2, abs_tol=1e-6)


def test_redaction(docs):
    text = 'before token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" after'
    net = secrets.fit([], [], epochs=2)
    out = secrets.redact(docs([(1, text, "en", "s"), (2, None, "en", "s"), (3, "clean words", "en", "s")]), net=net)
    assert out.columns == docs([]).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: 'before [secret]" after', 2: None, 3: "clean words"}
    assert secrets.scan(docs([])).count() == 0

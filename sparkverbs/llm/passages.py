"""Removal of passages that an earlier document has: a suffix array of the places where documents can agree, sorted by comparing
hashes.

A passage is ``LENGTH`` bytes of UTF-8. A byte goes if a passage that covers it also starts in a document with a smaller id.

1. *Places.* Of all grams of ``GRAM`` bytes in a passage, the one with the smallest hash (the last of several) is its place.
   Equal passages have equal places, so passages of two documents can only agree around places with equal grams. Grams
   that occur in one document only are left out: every slice of texts sends on each of its grams once, and what is found twice
   in a slice needs no answer.
2. *Contexts.* Around each place that is left, the bytes that its passages can reach make a context. Equal contexts within a
   slice are sent once, with the smallest id; all passages of the others are known to be repeated. Contexts are dealt out by gram.
3. *Suffix arrays.* The suffixes that start at places are sorted among those with equal grams, and so are the
   reversed prefixes that end there. Two suffixes are compared by a binary search over prefix hashes (a polynomial over
   64-bit numbers): the longest common extension takes log2(LENGTH) probes, and the byte after it decides. A merge sort
   finds the rank of every suffix of a run in its sibling run that way, for all runs of a level at once. Afterwards neighbours
   are compared byte by byte; where a collision has misled the sort, the group is sorted again by its bytes.
4. *Passages.* With o bytes before the place and LENGTH - o after it, equal passages are those that lie in one run of the
   suffix array (neighbours share LENGTH - o bytes) and in one run of the prefix array (neighbours share o bytes). Of each such
   set only the smallest id keeps its bytes.

What is kept of a text is bytes, not text: a cut can split a character. Null text counts as empty. A row without id is kept
whole and removes nothing. Rows that share an id are one document as far as ids are compared, but each is cut by itself (rows of
one id are told apart by the crc32 of their texts). Repeated rows, empty texts and empty tables need no special case. Other
columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import raw, slices
from .common import stored

LENGTH, GRAM = 50, 24
#: Bytes before a place that a passage can reach.
BEFORE = LENGTH - GRAM
#: Text bytes of a slice, text bytes for each partition at least, contexts that are sorted at once.
SLICE, PARTITION, PIECE = 4 << 20, 96 << 20, 50_000
#: Ids up to which the documents to look at are sent to every executor; beyond, all are shuffled.
SMALL = 1_000_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
U32 = np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U32)) * _MIX[4]
    return h ^ (h >> np.uint64(29))


def home(ids, n: int):
    """The partition of an id; the same for numpy and for columns."""
    if isinstance(ids, Column):
        return F.pmod(ids.bitwiseXOR(F.shiftright(ids, 17)).bitwiseXOR(F.shiftright(ids, 34)), F.lit(n)).cast("int")
    return np.mod(ids ^ (ids >> 17) ^ (ids >> 34), n)


def dealt(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Each place in a partition of its own, sorted by place: a hash of the place would put several into some tasks."""
    return rows.repartitionById(n, F.col("place")).sortWithinPartitions("place", *order)


# ------------------------------------------------------------------ places

def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the gram at every byte."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    h = words[:n] * _MIX[0]
    for k in range(1, GRAM // 8):
        h += words[8 * k:8 * k + n] * _MIX[k]
    return mixed(h)


def places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the places of all passages are, and the hashes of their grams. Texts lie in ``data`` from ``at`` on."""
    h = gram_hashes(data)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = (h >> U32 << U32) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    width = 1
    while 2 * width <= BEFORE + 1:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = BEFORE + 1 - width
    key = np.minimum(key[:n], key[rest:rest + n])
    inside = np.zeros(n + 1, np.int32)
    first, last = at[:-1], at[1:] - LENGTH + 1
    full = last > first
    np.add.at(inside, first[full], 1)
    np.add.at(inside, last[full], -1)
    found = 0xFFFFFFFF - (key[np.cumsum(inside[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    found = found[np.flatnonzero(np.diff(found, prepend=-1))]
    return found, h[found]


def _by(place: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(value, where it stands) for each value below ``n`` that occurs."""
    order = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p]:edges[p + 1]]


def six(h: np.ndarray) -> bytes:
    """The upper six bytes of each hash: with the partition they tell grams apart well enough to look at their contexts."""
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_MARKS = "place int, kind tinyint, hashes binary, ids binary, several binary"


def _marks(n: int):
    """Grams of each slice by partition (kind 0), and (kind 1) those that are known to be in several documents, by partition of
    the document."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                data, at = raw(texts)
                found, h = places(data, at)
                if not len(found):
                    continue
                row = np.searchsorted(at, found, "right") - 1
                ids = part.column("id").to_numpy(zero_copy_only=False)[row]
                order = np.lexsort((ids, h))
                new = np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0)))
                size = np.diff(np.append(new, len(h)))
                several = np.minimum.reduceat(ids[order], new) != np.maximum.reduceat(ids[order], new)
                known = order[np.repeat(several, size)]
                one, flag = order[new], several
                back = np.argsort(one)  # in the order of the texts, so that equal ids are neighbours
                one, flag = one[back], flag[back]
                for p, x in _by((h[one] % np.uint64(n)).astype(np.int64), n):
                    yield _row(_MARKS, p, 0, six(h[one[x]]), ids[one[x]].astype("<i8").tobytes(), flag[x].tobytes())
                for p, x in _by(home(ids[known], n), n):
                    yield _row(_MARKS, p, 1, six(h[known[x]]), ids[known[x]].astype("<i8").tobytes(), None)

    return run


def _row(schema: str, *values) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "tinyint": pa.int8(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields)], names=[n for n, _ in fields])


def _by_place(batches):
    """(place, its rows) of a partition that is sorted by place."""
    place, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["place"] != place:
                yield place, held
                held = []
            place = r["place"]
            held.append(r)
    if held:
        yield place, held


def _answers(n: int):
    """Of the grams that came to a partition, those of several documents, sent to the documents that don't know yet. Kind 1
    passes through."""

    def run(batches):
        for _, rows in _by_place(batches):
            mine = []
            for r in rows:
                if r["kind"] == 1:
                    yield _row(_WANTED, r["place"], r["hashes"], r["ids"])
                else:
                    mine.append(r)
            if not mine:
                continue
            h = np.concatenate([from_six(r["hashes"]) for r in mine])
            ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in mine])
            flag = np.concatenate([np.frombuffer(r["several"], bool) for r in mine])
            order = np.argsort(h, kind="stable")
            new = np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0)))
            size = np.diff(np.append(new, len(h)))
            shared = np.minimum.reduceat(ids[order], new) != np.maximum.reduceat(ids[order], new)
            shared |= np.logical_or.reduceat(flag[order], new)
            tell = order[np.repeat(shared, size)]
            tell = np.sort(tell[~flag[tell]])
            for p, x in _by(home(ids[tell], n), n):
                yield _row(_WANTED, p, six(h[tell[x]]), ids[tell[x]].astype("<i8").tobytes())

    return run


_WANTED = "place int, hashes binary, ids binary"


# ------------------------------------------------------------------ contexts

_CONTEXTS = ("place int, kind tinyint, hashes binary, text binary, before binary, after binary, owners binary, of binary, "
             "ids binary, marks binary, starts binary, lengths binary")


def _pair(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mixed((h >> np.uint64(16)) + ids.astype(np.uint64) * _MIX[1])


def slice_contexts(data: np.ndarray, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes around places (zeros beyond the ends of a text), and how many belong to the text before and from the place."""
    row = np.searchsorted(at, found, "right") - 1
    before = np.minimum(BEFORE, found - at[row])
    after = np.minimum(LENGTH, at[row + 1] - found)
    step = np.arange(-BEFORE, LENGTH, dtype=np.int8)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(data, (BEFORE, LENGTH)), BEFORE + LENGTH)
    text = around[found]
    text[(step < -before[:, None].astype(np.int8)) | (step >= after[:, None].astype(np.int8))] = 0
    return text, before, after


def _contexts(n: int):
    """Contexts of the wanted places by partition of their gram (kind 0), and passages that a slice knows to be repeated by
    partition of the document (kind 1). Rows come sorted by place, what is wanted before the texts."""

    def run(batches):
        place, wanted, of = None, [], None
        for batch in batches:
            for r, some in _stretches(batch):
                if r != place:
                    place, wanted, of = r, [], None
                if some.column("kind")[0].as_py() == 0:
                    wanted += [_pair(from_six(h), np.frombuffer(i, "<i8")) for h, i in zip(some.column("hashes").to_pylist(), some.column("ids").to_pylist())]
                    continue
                if not wanted:
                    continue
                of = np.unique(np.concatenate(wanted)) if of is None else of
                for part, texts in slices(some, "text", SLICE):
                    yield from _slice(part.column("id").to_numpy(zero_copy_only=False), texts, of, n)

    return run


def _stretches(batch: pa.RecordBatch):
    """(place, rows) of the parts of a batch that agree in place and kind."""
    key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "kind")])
    edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(key[0, a]), batch.slice(a, b - a)


def _slice(ids: np.ndarray, texts: pa.Array, wanted: np.ndarray, n: int):
    data, at = raw(texts)
    found, h = places(data, at)
    if not len(found):
        return
    row = np.searchsorted(at, found, "right") - 1
    pair = _pair(h, ids[row])
    keep = wanted[np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)] == pair
    found, h, row = found[keep], h[keep], row[keep]
    if not len(found):
        return
    mark = np.array([zlib.crc32(t) for t in texts.cast(pa.binary()).to_pylist()], np.uint32)
    text, before, after = slice_contexts(data, at, found)
    whole = np.zeros((len(text), 80), np.uint8)
    whole[:, :text.shape[1]] = text
    whole[:, -2], whole[:, -1] = before, after
    total = mixed((whole.view("<u8") * (_MIX[0] * (2 * np.arange(10, dtype=np.uint64) + np.uint64(1)))).sum(1, dtype=np.uint64))
    owner = ids[row]
    order = np.lexsort((owner, total))
    new = np.concatenate(([True], np.diff(total[order]) != 0))
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    group = np.cumsum(new)
    chance = group[~(whole[order] == whole[head]).all(1)]
    new |= np.isin(group, chance)  # contexts whose hashes are equal by chance stand by themselves
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    repeated = owner[order] > owner[head]
    start = found - at[row]

    gone = order[repeated]
    for p, x in _by(home(owner[gone], n), n):
        g = gone[x]
        yield _row(_CONTEXTS, p, 1, *[None] * 6, *_spans(owner[g], mark[row[g]], start[g] - before[g], before[g] + after[g]))
    own, lead = order[~repeated], head[~repeated]
    for p, x in _by((h[own] % np.uint64(n)).astype(np.int64), n):
        o, l = own[x], lead[x]
        first, of = np.unique(l, return_inverse=True)
        yield _row(_CONTEXTS, p, 0, h[first].astype("<u8").tobytes(), pa.compress(text[first].tobytes(), "zstd", asbytes=True),
                   before[first].astype(np.uint8).tobytes(), after[first].astype(np.uint8).tobytes(), owner[first].astype("<i8").tobytes(),
                   of.astype("<u4").tobytes(), *_spans(owner[o], mark[row[o]], start[o], np.zeros(len(o))))


def _spans(ids, marks, starts, lengths) -> tuple[bytes, bytes, bytes, bytes]:
    return ids.astype("<i8").tobytes(), marks.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), lengths.astype(np.uint8).tobytes()


# ------------------------------------------------------------------ suffix arrays

class Suffixes:
    """Strings (the rows of a matrix, each with its length) that are compared by hashes of their prefixes."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, letters: np.ndarray, lengths: np.ndarray):
        self.letters, self.lengths = letters, lengths.astype(np.int64)
        self.prefix = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
        power = 1
        for k in range(letters.shape[1]):
            value = mixed(letters[:, k].astype(np.uint64) + np.uint64(1))  # bytes become odd-looking 64-bit numbers
            self.prefix[:, k + 1] = self.prefix[:, k] + value * np.uint64(power)
            power = power * self.BASE % 2 ** 64

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of each pair, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.lengths[x], self.lengths[y])
        for _ in range(int(self.letters.shape[1]).bit_length()):
            middle = (low + high + 1) // 2
            equal = self.prefix[x, middle] == self.prefix[y, middle]
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether x comes strictly before y."""
        n = self.common(x, y)
        ended = n == np.minimum(self.lengths[x], self.lengths[y])
        at = np.minimum(n, self.letters.shape[1] - 1)
        return np.where(ended, self.lengths[x] < self.lengths[y], self.letters[x, at] < self.letters[y, at])

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array within each group (groups are numbered in ascending order), and how many bytes each suffix shares with
        the one before it in its group (-1 for the first)."""
        n = len(group)
        order = np.arange(n)
        head = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(head, n))
        start, size = np.repeat(head, size), np.repeat(size, size)
        width = 1
        while width < size.max(initial=0):
            order = self._merge(order, start, size, width)
            width *= 2
        return self._verified(order, group, start)

    def _merge(self, order, start, size, width):
        p = np.flatnonzero(size > width)
        local = np.arange(len(order))[p] - start[p]
        run = local // width
        left = run % 2 == 0
        low = np.where(left, (run + 1) * width, (run - 1) * width)
        high = np.minimum(np.where(left, (run + 2) * width, run * width), size[p])
        first = low = np.minimum(low, size[p])
        high = np.maximum(high, low)
        open_ = np.flatnonzero(low < high)
        low, high = low.copy(), high.copy()
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            mine, other = order[p[open_]], order[start[p[open_]] + middle]
            # equal suffixes of the left run come first
            passed = np.where(left[open_], self.before(other, mine), ~self.before(mine, other))
            low[open_] = np.where(passed, middle + 1, low[open_])
            high[open_] = np.where(passed, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        target = start[p] + run // 2 * 2 * width + (local - run * width) + (low - first)
        out = order.copy()
        out[target] = order[p]
        return out

    def _verified(self, order, group, start):
        n = len(order)
        share = np.full(n, -1, np.int64)
        wrong = group[np.bincount(order, minlength=n) != 1]  # ranks that contradict each other
        inner = np.flatnonzero(start != np.arange(n))
        if len(inner):
            x, y = order[inner - 1], order[inner]
            most = np.minimum(self.lengths[x], self.lengths[y])
            step = np.arange(self.letters.shape[1])
            differ = (self.letters[x] != self.letters[y]) | (step >= most[:, None])
            exact = np.where(differ.any(1), np.argmax(differ, axis=1), self.letters.shape[1])
            share[inner] = exact
            at = np.minimum(exact, self.letters.shape[1] - 1)
            sorted_ = np.where(exact == most, self.lengths[x] <= self.lengths[y], self.letters[x, at] < self.letters[y, at])
            wrong = np.concatenate((wrong, group[y[~sorted_]]))
        for g in np.unique(wrong).tolist():  # a collision of prefix hashes: by bytes
            at = np.flatnonzero(group == g)
            mine = sorted(at.tolist(), key=lambda i: self.letters[i, :self.lengths[i]].tobytes())
            order[at] = mine
            for a, i, j in zip(at[1:], mine, mine[1:]):
                most = int(min(self.lengths[i], self.lengths[j]))
                differ = np.flatnonzero(self.letters[i, :most] != self.letters[j, :most])
                share[a] = differ[0] if len(differ) else most
        return order, share


def repeated_passages(text: np.ndarray, before: np.ndarray, after: np.ndarray, group: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context how many bytes before its place, and up to where after it, passages that a smaller owner has reach
    (0 and 0: none)."""
    n = len(text)
    back, ahead = np.full(n, -1, np.int64), np.full(n, LENGTH + 1, np.int64)
    suffixes, shared_after = Suffixes(text[:, BEFORE:], after).sort(group)
    prefixes, shared_before = Suffixes(text[:, :BEFORE][:, ::-1], before).sort(group)
    right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(BEFORE + 1):
        right[suffixes] = np.cumsum(shared_after < LENGTH - o)
        left[prefixes] = np.cumsum(shared_before < o)
        some = np.flatnonzero((before >= o) & (after >= LENGTH - o))
        some = some[np.bincount(right[some], minlength=n + 1)[right[some]] > 1]
        if not len(some):
            continue
        key = right[some] * (n + 1) + left[some]
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        least = np.repeat(np.minimum.reduceat(owner[some][order], new), np.diff(np.append(new, len(order))))
        gone = some[order][owner[some][order] > least]
        back[gone] = np.maximum(back[gone], o)
        ahead[gone] = np.minimum(ahead[gone], o)
    hit = back >= 0
    return np.where(hit, back, 0), np.where(hit, LENGTH - ahead, 0)


_PLACED = "place int, ids binary, marks binary, starts binary, lengths binary"


def _repeats(n: int):
    """Repeated stretches by partition of their document; kind 1 passes through."""

    def run(batches):
        for _, rows in _by_place(batches):
            mine = []
            for r in rows:
                if r["kind"] == 1:
                    yield _row(_PLACED, r["place"], r["ids"], r["marks"], r["starts"], r["lengths"])
                else:
                    mine.append(r)
            if mine:
                yield from _repeats_of(mine, n)

    return run


def _repeats_of(rows: list[dict], n: int):
    sizes = [len(r["owners"]) // 8 for r in rows]
    width = BEFORE + LENGTH
    h = np.concatenate([np.frombuffer(r["hashes"], "<u8") for r in rows])
    text = np.concatenate([np.frombuffer(pa.decompress(r["text"], s * width, "zstd", asbytes=True), np.uint8) for r, s in zip(rows, sizes)]).reshape(-1, width)
    before, after = (np.concatenate([np.frombuffer(r[c], np.uint8) for r in rows]).astype(np.int64) for c in ("before", "after"))
    owner = np.concatenate([np.frombuffer(r["owners"], "<i8") for r in rows])
    base = np.cumsum([0, *sizes[:-1]])
    of = np.concatenate([np.frombuffer(r["of"], "<u4").astype(np.int64) + b for r, b in zip(rows, base)])
    ids, marks, starts = (np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in (("ids", "<i8"), ("marks", "<u4"), ("starts", "<u4")))

    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0)))
    size = np.diff(np.append(new, len(h)))
    several = np.minimum.reduceat(owner[order], new) != np.maximum.reduceat(owner[order], new)
    back, ahead = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    new, size = new[several], size[several]
    piece = np.cumsum(size) // PIECE
    for a in np.split(np.arange(len(new)), np.flatnonzero(np.diff(piece)) + 1) if len(new) else []:
        at = np.concatenate([order[s:s + k] for s, k in zip(new[a].tolist(), size[a].tolist())])
        group = np.repeat(np.arange(len(a)), size[a])
        back[at], ahead[at] = repeated_passages(text[at], before[at], after[at], group, owner[at])
    hit = np.flatnonzero(ahead[of] > 0)
    for p, x in _by(home(ids[hit], n), n):
        o = hit[x]
        yield _row(_PLACED, p, *_spans(ids[o], marks[o], starts[o].astype(np.int64) - back[of[o]], back[of[o]] + ahead[of[o]]))


# ------------------------------------------------------------------ cutting

def _cut(kind: str):
    """Texts without their repeated stretches. Rows come sorted by place, stretches before texts."""
    names = ["key", "kept", "n_bytes", "removed_from", "removed_to"]

    def run(batches):
        place, held, spans = None, [], None
        for batch in batches:
            for p, some in _stretches(batch):
                if p != place:
                    place, held, spans = p, [], None
                if some.column("kind")[0].as_py() == 0:
                    held += [[np.frombuffer(some.column(c)[i].as_py(), k) for c, k in (("ids", "<i8"), ("marks", "<u4"), ("starts", "<u4"), ("lengths", np.uint8))]
                             for i in range(some.num_rows)]
                    continue
                spans = Spans(held) if spans is None else spans
                for part, texts in slices(some, "text", SLICE):
                    yield pa.RecordBatch.from_arrays([part.column("key"), *spans.cut(part.column("id").to_pylist(), texts)], names=names)

    return run


class Spans:
    """Repeated stretches by id and mark."""

    def __init__(self, held: list[list[np.ndarray]]):
        ids, marks, starts, lengths = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((starts, marks, ids))
        self.starts, self.ends = starts[order].astype(np.int64), starts[order].astype(np.int64) + lengths[order]
        ids, marks = ids[order], marks[order]
        new = np.flatnonzero((np.diff(ids, prepend=0) != 0) | (np.diff(marks.astype(np.int64), prepend=-1) != 0))
        self.of = {k: (a, b) for k, a, b in zip(zip(ids[new].tolist(), marks[new].tolist()), new.tolist(), [*new[1:].tolist(), len(ids)])}
        self.ids = set(ids[new].tolist())

    def cut(self, ids: list, texts: pa.Array) -> list[pa.Array]:
        data, at = raw(texts)
        mark = np.zeros(len(data) + 1, np.int32)
        for row, i in enumerate(ids):
            if i in self.ids:
                a, b = self.of.get((i, zlib.crc32(data[at[row]:at[row + 1]])), (0, 0))
                np.add.at(mark, self.starts[a:b] + at[row], 1)
                np.add.at(mark, self.ends[a:b] + at[row], -1)
        gone = np.cumsum(mark[:-1]) > 0
        first, last = gone.copy(), gone.copy()
        first[1:] &= ~gone[:-1]
        last[:-1] &= ~gone[1:]
        begin, end = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]]
        first[begin], last[end - 1] = gone[begin], gone[end - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        edges = np.searchsorted(starts, at)
        base = np.repeat(at[:-1], np.diff(edges))
        kept = np.concatenate(([0], np.cumsum(~gone)))[at]
        offsets = pa.py_buffer(kept.astype(np.int32))
        bytes_ = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        lists = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array((x - base).astype(np.int32))) for x in (starts, ends)]
        return [bytes_, pa.array(np.diff(at)), *lists]


def _narrowed(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The documents with one of the ids, and the others; all and none if the ids are too many to send to every executor."""
    ids = ids.select(F.col("id").alias("__id"))
    if ids.count() > SMALL:
        return docs, None
    on = docs["id"] == F.col("__id")
    return docs.join(F.broadcast(ids), on, "left_semi"), docs.join(F.broadcast(ids), on, "left_anti")


def _listed(rows: DataFrame, n: int) -> DataFrame:
    """Each id in the column of packed ids once; the rows of a place hold the ids of that place."""

    def fewer(batches):
        for batch in batches:
            packed = [np.unique(np.frombuffer(b, "<i8")).tobytes() for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(packed, pa.binary())], names=["place", "ids"])

    def each(batches):
        for _, held in _by_place(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.frombuffer(r["ids"], "<i8") for r in held])))], names=["id"])

    packed = dealt(rows.select("place", "ids").mapInArrow(fewer, "place int, ids binary"), n)
    return stored(packed.mapInArrow(each, "id bigint"), "ids")


def _beside(docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Packed rows (kind 0) and the texts of documents (kind 1), by partition of the document."""
    texts = docs.select(home(F.coalesce("id", F.lit(0).cast("bigint")), n).alias("place"), F.lit(1).cast("tinyint").alias("kind"), "key", "id", "text")
    both = rows.withColumn("kind", F.lit(0).cast("tinyint")).unionByName(texts, allowMissingColumns=True)
    return dealt(both, n, "kind")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept, n_bytes, removed_from, removed_to): what is left of each text as bytes, its length before, and the removed
    stretches as first and end byte."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    docs = docs.select(docs[key].alias("key"), docs[key].cast("bigint").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION + 1)
    long = docs.where(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH))

    marks = dealt(long.select("id", "text").mapInArrow(_marks(n), _MARKS), n)
    wanted = stored(marks.mapInArrow(_answers(n), _WANTED), "wanted")
    some, _ = _narrowed(long, _listed(wanted, n))
    contexts = _beside(some, wanted, n).select("place", "kind", "hashes", "ids", "id", "text").mapInArrow(_contexts(n), _CONTEXTS)
    contexts = dealt(contexts, n)
    spans = stored(contexts.mapInArrow(_repeats(n), _PLACED), "repeats")

    cut, whole = _narrowed(docs, _listed(spans, n))
    schema = f"key {kind}, kept binary, n_bytes bigint, removed_from array<int>, removed_to array<int>"
    out = _beside(cut, spans, n).mapInArrow(_cut(kind), schema)
    if whole is not None:
        none = F.array().cast("array<int>")
        out = out.unionByName(whole.select("key", F.col("text").cast("binary").alias("kept"), F.octet_length("text").cast("bigint").alias("n_bytes"),
                                           none.alias("removed_from"), none.alias("removed_to")))
    return out.withColumnRenamed("key", key)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    cut = remove_repeats(docs, key, text)
    return cut.select(key, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("removed_from").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 49)) AS i FROM d)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE doc_id > least),
step AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hits),
part AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM step),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM part GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
cut AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
               string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept
        FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

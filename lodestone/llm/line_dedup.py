"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words.  A line is removed if a line before
it, in the order of document id and line number, has a Jaccard similarity of at
least ``percent`` / 100; a line of fewer than ``least`` different words is never
removed and removes none.

Words are ordered by rarity.  The counts behind that order cover all documents
and stand, as logarithms of a byte, in a hashed table of fixed size (16 MB); any
order gives the same result, and a collision only makes a word look less rare.
Each line that is the first of its set in its task writes keys for the words of
its prefix, but for words that occur once.  A word more frequent than ``hot`` makes
no key alone: lines that match share a second word in a prefix longer by one, so
such a word makes one key with each word behind it there.  So the buckets of
single words stay small however large the corpus is, and only similar lines fill
those of pairs.

Within a bucket, lines are candidates if their lengths and positions allow a match
(a window over the lines by length), a parity sketch doesn't forbid it, and they do
not have the word before the key's in common too, in whose bucket they meet.  A
line keeps its ``keep`` nearest candidates before it: one, so a group of similar
lines makes no more pairs than it has lines.  A wider parity sketch drops
more of them; then the ``FIRST`` nearest of each line are verified by whole sets,
then the others of the lines without a match.  A line that had more candidates in
a bucket, or stands in a bucket of more than ``whole`` lines, where all are compared
with the ``lead`` earliest, is open.  For the open lines that found no match, which
are few, the texts are read again for all lines of their buckets, and a last round
compares them in blocks, the buckets of one first word together.  A bucket that is large within one task
is compared there and sends its earliest lines on, so that no task gathers a group.
Equal sets need no candidates: all but the first are removed.

Memory: a task holds a slice of text of 1 MB, or one longer text, with some forty
times its bytes, besides the table.

Defined cases.  Lines are parted by newlines.  Null has no lines and stays null;
the empty text has one empty line.  Rows with one id are one document.  Lines of
rows with a null id are never removed and remove none.  The columns of ``docs``
are kept whatever their names.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_name, give_back, lowered, mix, pieces, saved, shuffle_parts, sorted_runs, text_slices, word_hashes, words

_U = np.uint64
COUNTERS = 1 << 24
SLICE = 1 << 16  # counters that travel together
BITS = 1 << 23
COUNTED = 1 << 20  # words a task holds before it counts them
FLUSH = 1 << 18  # keys a task holds before it packs them
FINE = 8
PAIRS = 1 << 18  # candidate pairs looked at together
ONCE = 8  # on the logarithmic scale: words counted once
FIRST = 1  # candidates of a line that are verified at once
WIDE = 2  # bits of the wide sketch for each word of a line
BLOCK = 1024  # lines of a bucket that an open line is compared with at once
SETS, KEYS, ROWS = 0, 1, 2


class Limits(NamedTuple):
    """What divides the ways a line is compared; no limit changes a result."""

    hot: int = 80  # rarity of frequent words, on the logarithmic scale: 1,023 counted
    whole: int = 1024  # lines of a bucket that are all compared
    lead: int = 64  # earliest lines of a larger one
    keep: int = 1  # candidates of a line in a bucket
    local: int = 256  # lines of a bucket within one task, of which half travel on


LIMITS = Limits()

_SET = np.dtype([("s1", "<u8"), ("s2", "<u8"), ("doc", "<i8"), ("line", "<i4")], align=True)
_KEY = np.dtype([("k", "<u8"), ("doc", "<i8"), ("sk", "<u8"), ("sl", "<u8"), ("set", "<u4"), ("line", "<i4"), ("n", "<i4"), ("at", "<i4"), ("pv", "<u4"), ("tail", "u1")], align=True)


def planes_of(column: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: bytes that
    are mostly 0 stand together and pack well."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes()


def entries_of(body: bytes, kind: np.dtype) -> np.ndarray:
    """Rows from a body that has them column by column, each in planes of bytes."""
    n = len(body) // sum(kind[c].itemsize for c in kind.names)
    out, at, flat = np.empty(n, kind), 0, np.frombuffer(body, np.uint8)
    for c in kind.names:
        width = kind[c].itemsize
        planes = flat[at : at + width * n].reshape(width, n)
        out[c] = np.ascontiguousarray(planes.T).view(kind[c]).ravel()
        at += width * n
    return out


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the lines (with the end), and row and number of each line."""
    ends = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, ends, side="right") - 1])
    start = np.concatenate([offsets[:-1], ends + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    return np.append(start, len(data)), row, np.arange(len(row)) - first[row]


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> _U(40)).astype(np.uint32)


class Lines:
    """The different words of the lines of a slice, rarest first."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row and number of each line, its offset among the words (with the
        end), and the hash and rarity of each word."""
        at, row, number = lines_of(data, offsets)
        data = lowered(data)
        starts, ends, first = words(data, at)
        h = word_hashes(data, starts, ends)
        line = np.repeat(np.arange(len(row), dtype=_U), np.diff(first))
        rare = self.counts[bucket_of(h)]
        # One key for line, rarity and hash; where the bits that fit leave
        # different words equal, the full order decides.
        room = _U(56 - len(row).bit_length())
        short = (line << (room + _U(8))) | (rare.astype(_U) << room) | (h >> (_U(64) - room))
        order = np.argsort(short)
        key, h = short[order], h[order]
        same = key[1:] == key[:-1]
        if np.any(same & (h[1:] != h[:-1])):
            h = word_hashes(data, starts, ends)
            order = np.lexsort((h, rare, line))
            key, h = short[order], h[order]
            same = (h[1:] == h[:-1]) & (line[order][1:] == line[order][:-1])
        keep = np.append(True, ~same) if len(h) else np.zeros(0, bool)
        key, h = key[keep], h[keep]
        first = np.searchsorted(key, np.arange(len(row) + 1, dtype=_U) << (room + _U(8)))
        return row, number, first, h, ((key >> room) & _U(255)).astype(np.uint8)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of one task, COUNTED words at a time: for each slice the
    places and counts of those that are not 0."""
    held, total = [], 0

    def flush() -> pa.RecordBatch:
        nonlocal held, total
        at, n = np.unique(np.concatenate(held), return_counts=True)
        held, total = [], 0
        place, n = (at % SLICE).astype("<u2"), n.astype("<u4")
        cuts = np.searchsorted(at, np.arange(0, COUNTERS + 1, SLICE)).tolist()
        some = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        bodies = [place[a:b].tobytes() + n[a:b].tobytes() for _, a, b in some]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in some], pa.int64()), pa.array(bodies, pa.binary())], names=["slice", "body"])

    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0)):
            data = lowered(data)
            starts, ends, _ = words(data, offsets)
            held.append(bucket_of(word_hashes(data, starts, ends)))
            total += len(held[-1])
            if total >= COUNTED:
                yield flush()
        give_back()
    if held:
        yield flush()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters, sorted by slice, as a byte each: 8 log2(1 + count)."""
    slot, out = None, np.zeros(SLICE, np.int64)

    def row() -> pa.RecordBatch:
        body = np.minimum(255, np.round(8 * np.log2(1.0 + out))).astype(np.uint8).tobytes()
        body = pa.compress(body, "zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([body], pa.binary())], names=["slice", "body"])

    for batch in batches:
        for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i != slot:
                if slot is not None:
                    yield row()
                slot = i
                out[:] = 0
            n = len(body) // 6
            out[np.frombuffer(body, "<u2", n)] += np.frombuffer(body, "<u4", n, 2 * n)
    if slot is not None:
        yield row()


def word_counts(docs: DataFrame) -> np.ndarray:
    """The rarity table over all texts, COUNTERS bytes whatever their size."""
    sums = docs.select("text").mapInArrow(_count, "slice long, body binary").repartition("slice").sortWithinPartitions("slice")
    out = np.zeros((COUNTERS // SLICE, SLICE), np.uint8)
    for batch in sums.mapInArrow(_slices, "slice long, body binary").toArrow().to_batches():  # COUNTERS bytes at most, packed
        for slot, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out[slot] = np.frombuffer(pa.decompress(body.as_buffer(), SLICE, "zstd"), np.uint8)
    return out.ravel()


def spots(x: np.ndarray) -> np.ndarray:
    return (mix(x.astype(_U)) % _U(BITS)).astype(np.int64)


def line_spots(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return spots(mix(doc.astype(_U)) + line.astype(_U))


def word_spots(key: np.ndarray) -> np.ndarray:
    """By the upper bits, which a key has from its first word."""
    return (key.astype(_U) >> _U(64 - BITS.bit_length() + 1)).astype(np.int64)


def repeats(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by set, document and line, and within it which rows are the first
    of their set and which are other lines than that."""
    order = np.lexsort((sets["line"], sets["doc"], sets["s2"], sets["s1"]))
    s = sets[order]
    fresh = np.append(True, (s["s1"][1:] != s["s1"][:-1]) | (s["s2"][1:] != s["s2"][:-1])) if len(s) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    return order, fresh, (s["doc"] != s["doc"][lead]) | (s["line"] != s["line"][lead])


def keys_of(first: np.ndarray, n: np.ndarray, h: np.ndarray, rare: np.ndarray, percent: int, hot: int) -> tuple[np.ndarray, ...]:
    """For lines of ``n`` words from ``first``: line, position and key, and a
    hash of the prefix's word before the key's, or between its two; 0: none."""
    own = (percent * n + 99) // 100
    prefix = n - own + 1
    line = np.repeat(np.arange(len(n)), prefix)
    at = np.arange(len(line)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    word = first[line] + at
    much = rare[word] >= hot
    single = np.flatnonzero(~much & (rare[word] > ONCE))
    before = lambda of, some: np.where(some, ((h[np.maximum(of - 1, 0)] >> _U(8)) & _U(0xFFFFFFFF)) | _U(1), _U(0))
    # A key's upper half is that of its first word, by which open lines are kept.
    upper = lambda of: mix(h[of]) & _U(0xFFFFFFFF00000000)
    parts_ = [(line[single], at[single], mix(h[word[single]]), before(word[single], at[single] > 0))]
    much = np.flatnonzero(much)
    if len(much):
        behind = (prefix[line] - at)[much]  # words behind, in the prefix longer by one
        src = np.repeat(much, behind)
        step = np.arange(len(src)) - np.repeat(np.cumsum(behind) - behind, behind) + 1
        inside = at[src] + step < n[line[src]]
        src, step = src[inside], step[inside]
        pv = np.where(step > 1, before(word[src] + step, step > 1), before(word[src], at[src] > 0))
        parts_.append((line[src], at[src], upper(word[src]) | (mix(h[word[src]] * _U(3) + mix(h[word[src] + step])) >> _U(32)), pv))
    return tuple(np.concatenate(x) for x in zip(*parts_, strict=True))


def keyed(lines: Lines, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, percent: int, least: int, limits: Limits, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of the lines of ``least`` words, entries for the keys of those that are
    the first of their set, and the set of each entry.  ``base``: the number of
    the first line of each row, where that is not 0."""
    hot = limits.hot if (percent * least + 99) // 100 >= 2 else 256  # a match then shares two words at least
    row, number, first, h, rare = lines.cut(data, offsets)
    n = np.diff(first)
    use = np.flatnonzero(n >= least)
    sets = np.empty(len(use), _SET)
    if not len(use):
        return sets, np.empty(0, _KEY), use
    # Lines without words have no run of their own here.
    solid = np.flatnonzero(n > 0)
    place_in = np.searchsorted(solid, use)
    sets["s1"] = np.add.reduceat(h, first[solid])[place_in]
    sets["s2"] = np.add.reduceat(mix(h), first[solid])[place_in]
    sets["doc"], sets["line"] = ids[row[use]], number[use] + (base[row[use]] if base is not None else 0)
    bit, low = _U(1) << (h >> _U(3) & _U(63)), (h >> _U(9) & _U(1)) == 0
    parity = [np.bitwise_xor.reduceat(np.where(half, bit, _U(0)), first[solid])[place_in] for half in (low, ~low)]
    order, fresh, _ = repeats(sets)
    fresh = order[fresh]
    size = n[use[fresh]]
    line, at, key, pv = keys_of(first[use[fresh]], size, h, rare, percent, hot)
    entry = np.empty(len(key), _KEY)
    entry["k"], entry["at"], entry["n"], entry["pv"], entry["tail"] = key, at, size[line], pv, 0
    line = fresh[line]
    entry["set"], entry["sk"], entry["sl"] = sets["s1"][line] & _U(0xFFFFFFFF), parity[0][line], parity[1][line]
    entry["doc"], entry["line"] = sets["doc"][line], sets["line"][line]
    return sets, entry, line


def _pack(counts, percent: int, least: int, parts: int, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines(counts.value)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sets, keys, the set of each key
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, total
            base = np.cumsum([0, *(len(s) for s, _, _ in held)])
            sets, keys = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            owner = np.concatenate([h[2] + b for h, b in zip(held, base, strict=False)])
            held, total = [], 0
            order, fresh, late = repeats(sets)
            first = np.zeros(len(sets), bool)
            first[order[fresh]] = True
            keys = keys[first[owner]]
            keys, rows = met_here(keys, percent, limits)
            late = sets[order[late]]
            rows.append(_rows(EQUAL, len(late), doc=late["doc"], line=late["line"]))
            sets = sets[first]
            out = [(int(x.num_rows) % parts, ROWS, packed_rows(x)) for x in rows]
            for kind, some, by in ((SETS, sets, sets["s1"]), (KEYS, keys, keys["k"])):
                part = ((by >> _U(9)) % _U(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
                order = np.argsort(part, kind="stable")
                cols = [some[c][order] for c in some.dtype.names]
                cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                out += [(i, kind, b"".join(planes_of(c[a:b]) for c in cols)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            del sets, keys, some, by, order, cols  # what is packed needs no second place
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int8()), pa.array(cols[2], pa.binary())], names=["part", "kind", "body"])

        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo).to_numpy()
                sets, entry, line = keyed(lines, data, offsets, ids, percent, least, limits)
                if not len(sets):
                    continue
                held.append((sets, entry, line))
                total += len(entry) + len(sets)
                if total >= FLUSH:
                    yield flush()
            give_back()
        if held:
            yield flush()

    return run


def by_line(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The rank of each row by document and line."""
    rank = np.empty(len(doc), np.uint64)
    low = doc.min(initial=0)
    if doc.max(initial=0) - float(low) < 2**31:  # both fit one number
        order = np.argsort(((doc - low).astype(_U) << _U(32)) + line.astype(_U))
    else:
        order = np.lexsort((line, doc))
    rank[order] = np.arange(len(doc), dtype=_U)
    return rank


def runs_by(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries that share a key with another, sorted by key, document and
    line, one for each set; heads and sizes of the runs."""
    order = np.argsort(entries["k"])
    k = entries["k"][order]
    same = np.append(False, k[1:] == k[:-1]) if len(k) else np.zeros(0, bool)
    shared = same | np.append(same[1:], False) if len(k) else same  # most stand alone
    entries, same = entries[order[shared]], same[shared]
    run_ = np.cumsum(~same).astype(_U)
    order = np.argsort((run_ << _U(32)) + by_line(entries["doc"], entries["line"]))
    own = mix(entries["sk"][order] + mix(entries["sl"][order]) + entries["set"][order].astype(_U) * _U(0x9E3779B97F4A7C15)) + mix(run_[order])
    order = order[np.sort(np.unique(own, return_index=True)[1])]
    entries, run_ = entries[order], run_[order]
    heads = np.flatnonzero(np.append(True, run_[1:] != run_[:-1])) if len(entries) else np.zeros(0, np.int64)
    return entries, heads, np.diff(np.append(heads, len(entries)))


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of entries differ: never more than the words."""
    return np.bitwise_count(x["sk"] ^ y["sk"]).astype(np.int64) + np.bitwise_count(x["sl"] ^ y["sl"])


def may_match(percent: int, x: np.ndarray, y: np.ndarray, places: bool = True) -> np.ndarray:
    """Whether sizes, positions and sketches of two entries allow a match."""
    p = percent
    n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
    ok = np.minimum(n, m) * 100 >= p * np.maximum(n, m)
    if places:
        ok &= np.minimum(n - x["at"], m - y["at"]) * (100 + p) >= p * (n + m)
    return ok & (apart(x, y) * (100 + p) <= (100 - p) * (n + m))


def _windows(entries: np.ndarray, run_: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one run whose sizes allow a match, sorted here by run
    and size: index pairs, about PAIRS at a time."""
    order = np.lexsort((entries["n"], run_))
    n, at = entries["n"][order].astype(np.int64), entries["at"][order].astype(np.int64)
    most = np.minimum(100 * n // percent, (n - at) * (100 + percent) // percent - n)
    place = (run_[order].astype(np.int64) << 32) + n
    ends = np.searchsorted(place, (run_[order].astype(np.int64) << 32) + most, side="right")
    index = np.arange(len(order))
    counts = np.maximum(ends - index - 1, 0)
    total = np.cumsum(counts)
    start = 0
    while start < len(order):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
        c = counts[start:stop]
        i = np.repeat(np.arange(start, stop), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        yield order[i], order[j]
        start = stop


def _nearest(entries: np.ndarray, late: np.ndarray, early: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` nearest earlier entries of each later one, and whether there
    were more."""
    far = apart(entries[late], entries[early])
    order = np.lexsort((early, far, late))
    late, early = late[order], early[order]
    top = np.append(True, late[1:] != late[:-1])
    heads = np.flatnonzero(top)
    sizes = np.diff(np.append(heads, len(late)))
    rank = np.arange(len(late)) - np.repeat(heads, sizes)
    return late[rank < keep], early[rank < keep], late[heads[sizes > keep]]


def meet(entries: np.ndarray, percent: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """What the buckets of ``entries`` yield: for each line its nearest candidates,
    or that it is open without one.  In a bucket that lines have stayed away from,
    those are open that have so many before them that some of them can have stayed."""
    tails = np.unique(entries["k"][entries["tail"] > 0])
    entries, heads, sizes = runs_by(entries)
    if not len(entries):
        return
    run_ = np.repeat(np.arange(len(heads)), sizes)
    large = np.repeat(sizes > limits.whole, sizes)
    rank = np.arange(len(run_)) - np.repeat(heads, sizes)
    is_open = (large & (rank > limits.lead)) | (np.repeat(np.isin(entries["k"][heads], tails), sizes) & (rank >= limits.local // 2))
    small = np.flatnonzero(~large)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def nearest() -> None:
        late, early, more = _nearest(entries, *(np.concatenate(x) for x in zip(*found, strict=True)), limits.keep)
        is_open[more] = True
        found[:] = [(late, early)]

    field = {c: np.ascontiguousarray(entries[c]) for c in ("n", "at", "sk", "sl", "pv", "doc", "line")}

    def passed(i: np.ndarray, j: np.ndarray) -> None:
        """As ``may_match``, by columns and the cheap tests first."""
        n, m = (field["n"][x].astype(np.int64) for x in (i, j))
        ok = (np.minimum(n, m) * 100 >= percent * np.maximum(n, m)) & (np.minimum(n - field["at"][i], m - field["at"][j]) * (100 + percent) >= percent * (n + m))
        # Lines with one word before this one in common meet in its bucket.
        ok &= (field["pv"][i] != field["pv"][j]) | (field["pv"][i] == 0)
        i, j, most = i[ok], j[ok], (100 - percent) * (n + m)[ok]
        far = np.bitwise_count(field["sk"][i] ^ field["sk"][j]).astype(np.int64) + np.bitwise_count(field["sl"][i] ^ field["sl"][j])
        ok = far * (100 + percent) <= most
        i, j = i[ok], j[ok]
        ok = (field["doc"][i] != field["doc"][j]) | (field["line"][i] != field["line"][j])
        i, j = i[ok], j[ok]
        found.append((np.maximum(i, j), np.minimum(i, j)))  # runs are in the order of the lines
        if sum(len(x) for x, _ in found) > 4 * PAIRS:
            nearest()

    for i, j in _windows(entries[small], run_[small], percent):
        passed(small[i], small[j])
    for head, size in zip(heads[sizes > limits.whole].tolist(), sizes[sizes > limits.whole].tolist(), strict=True):
        for lo in range(head, head + size, PAIRS // limits.lead):
            i = np.arange(lo, min(lo + PAIRS // limits.lead, head + size))
            i, j = np.repeat(i, limits.lead), np.tile(np.arange(head, head + limits.lead), len(i))
            passed(i[i > j], j[i > j])
    if sum(len(x) for x, _ in found):
        nearest()
        late, early = found[0]
        b, a = entries[late], entries[early]
        yield _rows(PAIR, len(b), doc=b["doc"], line=b["line"], doc0=a["doc"], line0=a["line"], key=b["k"].astype(np.int64), open=is_open[late])
        is_open[late] = False
    if is_open.any():
        yield _open(entries[is_open])


def met_here(entries: np.ndarray, percent: int, limits: Limits) -> tuple[np.ndarray, list[pa.RecordBatch]]:
    """The entries that travel on, and what the buckets that are large within this
    task yield: there all but the earliest lines stay, open."""
    order = np.argsort(entries["k"])
    k = entries["k"][order]
    heads = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(k)))
    if not (sizes > limits.local).any():
        return entries, []
    inside = np.zeros(len(entries), bool)
    inside[order[np.repeat(sizes > limits.local, sizes)]] = True
    many, heads, sizes = runs_by(entries[inside])
    rank = np.arange(len(many)) - np.repeat(heads, sizes)
    travels = (rank < limits.local // 2) | np.repeat(sizes <= limits.local, sizes)
    out = list(meet(many, percent, limits))
    many["tail"] |= np.repeat(sizes > limits.local, sizes)
    stays = many[~travels]
    if len(stays):
        out.append(_open(stays))
    return np.concatenate([entries[~inside], many[travels]]), out


EQUAL, PAIR, OPEN = 0, 1, 2
_FOUND = "kind int, doc long, line int, doc0 long, line0 int, key long, open boolean"
_KINDS = {"doc": pa.int64(), "line": pa.int32(), "doc0": pa.int64(), "line0": pa.int32(), "key": pa.int64(), "open": pa.bool_()}


def _rows(kind: int, size: int, **cols: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.full(size, kind, np.int32))]
    arrays += [pa.array(np.ascontiguousarray(cols[c]), t) if c in cols else pa.nulls(size, t) for c, t in _KINDS.items()]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", *_KINDS])


def _open(some: np.ndarray) -> pa.RecordBatch:
    return _rows(OPEN, len(some), key=some["k"].astype(np.int64), doc=some["doc"], line=some["line"], open=np.ones(len(some), bool))


def packed_rows(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _match(percent: int, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_ in sorted_runs(batches):
            sets, keys = [], []
            for kind, body in zip(run_.column("kind").to_pylist(), run_.column("body").to_pylist(), strict=True):
                if kind == ROWS:
                    yield from pa.ipc.open_stream(body)
                else:
                    (keys if kind == KEYS else sets).append(entries_of(body, _KEY if kind == KEYS else _SET))
            if sets:
                s = np.concatenate(sets)
                order, _, late = repeats(s)
                s = s[order[late]]
                yield _rows(EQUAL, len(s), doc=s["doc"], line=s["line"])
            if keys:
                yield from meet(np.concatenate(keys), percent, limits)
        give_back()

    return run


def _members(counts, starting, wanted, percent: int, least: int, limits: Limits):
    """The lines of the wanted buckets by the key's first word, one for each set and
    slice.  Only lines with a word that such a key starts with are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines(counts.value)
        begins, full = (np.unpackbits(np.frombuffer(x.value, np.uint8)).view(bool) for x in (starting, wanted))
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo).to_numpy()
                at, row, number = lines_of(data, offsets)
                data = lowered(data)
                starts, ends, first = words(data, at)
                hit = np.flatnonzero(begins[word_spots(mix(word_hashes(data, starts, ends)))])
                use = np.unique(np.searchsorted(first, hit, side="right") - 1)
                if not len(use):
                    continue
                own = np.concatenate([data[at[i] : at[i + 1]] for i in use.tolist()])
                # Each line is a row here; what follows its newline is a line without words.
                _, some, _ = keyed(lines, own, np.append(0, np.cumsum(at[use + 1] - at[use])), ids[row[use]], percent, least, limits, number[use])
                some = some[full[spots(some["k"])]]
                same = np.rec.fromarrays([some["k"] >> _U(32), some["doc"], some["line"]])
                some = some[np.unique(same, return_index=True)[1]]
                cols = [(some["k"] >> _U(32)).astype(np.int64), some["doc"], some["line"], some["n"], some["sk"].astype(np.int64), some["sl"].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["key", "doc", "line", "n", "sk", "sl"])
            give_back()

    return run


def _cross(percent: int):
    """Pairs of an open line, one of those that ask, and an earlier line of a block
    that sizes and sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_ in sorted_runs(batches):
            e = np.empty(run_.num_rows, [("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("sk", "<u8"), ("sl", "<u8"), ("asks", "?")])
            for c in e.dtype.names:
                x = run_.column(c).combine_chunks().to_numpy(zero_copy_only=False)
                e[c] = x.view(_U) if c in ("sk", "sl") else x
            asks, e = e[e["asks"]], e[~e["asks"]]
            for q in asks:
                j = np.flatnonzero((e["doc"] < q["doc"]) | ((e["doc"] == q["doc"]) & (e["line"] < q["line"])))
                j = j[may_match(percent, q, e[j], places=False)]
                if len(j):
                    cols = [np.full(len(j), q["doc"]), np.full(len(j), q["line"]), e["doc"][j], e["line"][j]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=_ENDS)

    return run


def _bitmap(spots_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            bits[spots_of(*cols)] = True
        yield _bits(np.packbits(bits))

    return run


def _bits(packed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pa.compress(packed.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["bits"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BITS // 8, np.uint8)
    for batch in batches:
        for body in batch.column(0):
            total |= np.frombuffer(pa.decompress(body.as_buffer(), len(total), "zstd"), np.uint8)
    yield _bits(total)


def bitmap(rows: DataFrame, spots_of):
    """A bitmap of fixed size, broadcast: of lines (doc, line), of documents, of
    keys or of their first words.  One task unites those of at most 16 tasks, so one
    of 1 MB reaches the driver: 16 at once, and their copies, swelled its heap."""
    parts = rows.coalesce(16).mapInArrow(_bitmap(spots_of), "bits binary").repartition(1)
    total = bytes(BITS // 8)
    for body in parts.mapInArrow(_united, "bits binary").toArrow().column(0):  # one, or none without a task
        total = pa.decompress(body.as_buffer(), len(total), "zstd", asbytes=True)
    return rows.sparkSession.sparkContext.broadcast(total)


def wide(h: np.ndarray) -> bytes:
    """The parity of the words that fall on each bit of a sketch whose width, a
    power of two, follows their number."""
    bits = 1 << max(8, (WIDE * len(h) - 1).bit_length())
    at = (mix(h) % _U(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def distance(x: bytes, y: bytes) -> int:
    """Bits in which wide sketches differ, the wider folded onto the other."""
    a, b = (np.frombuffer(z, _U) for z in (x, y))
    if len(a) != len(b):
        a, b = sorted((a, b), key=len)
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _sets(wanted):
    """Sets and wide sketches of the wanted lines; no other line is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo).to_numpy()
                at, row, number = lines_of(data, offsets)
                use = np.flatnonzero(bits[line_spots(ids[row], number)])
                if not len(use):
                    continue
                own = np.concatenate([data[at[i] : at[i + 1]] for i in use.tolist()])
                own = lowered(own)
                starts, ends, first = words(own, np.append(0, np.cumsum(at[use + 1] - at[use])))
                h = word_hashes(own, starts, ends)
                sets = [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                cols = [pa.array(ids[row[use]]), pa.array(number[use].astype(np.int32)), pa.array([len(x) for x in sets], pa.int32())]
                cols += [pa.array([wide(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "line", "n", "sk", "body"])
            give_back()

    return run


def _closer(percent: int):
    """Drops pairs whose wide sketches forbid a match; ``far`` orders the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (4, 5))
            far = np.array([distance(x, y) for x, y in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)], np.int64)
            keep = far * (100 + percent) <= (100 - percent) * (n + m)
            out = batch.select([0, 1, 2, 3]).append_column("far", pa.array(far / np.maximum(n + m, 1)))
            yield out.filter(pa.array(keep))

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


_ENDS = ["doc", "line", "doc0", "line0"]


def _early(sets: DataFrame, *more: str) -> DataFrame:
    return sets.select(F.col("doc").alias("doc0"), F.col("line").alias("line0"), *[F.col(c).alias(f"{c}0") for c in more])


def _of_lines(wanted):
    """Rows of a table of lines that are in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[line_spots(batch.column(0).to_numpy(), batch.column(1).to_numpy())]))

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("doc", "line").union(pairs.select(F.col("doc0").alias("doc"), F.col("line0").alias("line")))


def _matching(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(doc, line) of the lines that match one of theirs in ``pairs``, a table
    that was written out."""
    kinds = "doc long, line int, n int, sk binary, body binary"
    sets = saved(docs.mapInArrow(_sets(bitmap(_ends(pairs), line_spots)), kinds))
    near = pairs.join(sets.select("doc", "line", "n", "sk"), ["doc", "line"]).join(_early(sets, "n", "sk"), ["doc0", "line0"])
    near = near.select(*_ENDS, "n", "n0", "sk", "sk0").mapInArrow(_closer(percent), "doc long, line int, doc0 long, line0 int, far double")
    nearest = Window.partitionBy("doc", "line").orderBy("far", "doc0", "line0")
    near = saved(near.withColumn("place", F.row_number().over(nearest)))

    def exact(some: DataFrame) -> DataFrame:
        own = sets.select("doc", "line", "body").mapInArrow(_of_lines(bitmap(_ends(some), line_spots)), "doc long, line int, body binary")
        # Merged at every size: a broadcast would put both Python steps, and so two workers, into one task.
        full = some.hint("merge").join(own, ["doc", "line"]).join(_early(own, "body").hint("merge"), ["doc0", "line0"])
        return saved(full.select("doc", "line", "body", "body0").mapInArrow(_exact(percent), "doc long, line int").distinct())

    gone = exact(near.where(F.col("place") <= FIRST).select(*_ENDS))
    others = saved(near.where(F.col("place") > FIRST).select(*_ENDS).join(gone, ["doc", "line"], "left_anti"))
    return gone if others.isEmpty() else gone.union(exact(others))


def removals(docs: DataFrame, percent: int, least: int, limits: Limits = LIMITS) -> DataFrame:
    """(doc, line) of the lines to remove, without repeats; ``docs``: id, text."""
    docs = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(word_counts(docs))
    packed = docs.mapInArrow(_pack(counts, percent, least, FINE * shuffle_parts(spark), limits), "part long, kind byte, body binary")
    packed = packed.repartition(shuffle_parts(spark), "part").sortWithinPartitions("part")
    found = saved(packed.mapInArrow(_match(percent, limits), _FOUND), ["kind"])
    equal, pairs = (found.where(F.col("kind") == k) for k in (EQUAL, PAIR))
    equal = equal.select("doc", "line").distinct()
    gone = equal.union(_matching(docs, saved(pairs.select(*_ENDS).distinct().join(equal, ["doc", "line"], "left_anti")), percent)).distinct()
    gone = saved(gone)
    asking = saved(found.where("open").select("key", "doc", "line").join(gone, ["doc", "line"], "left_anti").distinct())
    if asking.isEmpty():
        return gone
    some = _members(counts, bitmap(asking.select("key"), word_spots), bitmap(asking.select("key"), spots), percent, least, limits)
    own = ["key", "doc", "line", "n", "sk", "sl"]
    members = docs.mapInArrow(some, "key long, doc long, line int, n int, sk long, sl long").distinct()
    asking = asking.select(F.shiftrightunsigned("key", 32).alias("key"), "doc", "line").distinct().withColumn("open", F.lit(True))
    left = members.join(asking, ["key", "doc", "line"], "left")
    left = saved(left.select(*own, F.coalesce("open", F.lit(False)).alias("open")))
    part = lambda s: F.sum(F.pmod(F.xxhash64("doc", "line", "open", F.lit(s)), F.lit(1 << 31)))
    keys = left.groupBy("key").agg(F.count(F.lit(1)).alias("n_"), F.max("open").alias("open"), part(1).alias("s1"), part(2).alias("s2")).where("open")
    # Of the buckets with the same lines one is enough.
    keys = keys.groupBy("n_", "s1", "s2").agg(F.min("key").alias("key"), F.ceil(F.col("n_") / BLOCK).cast("int").alias("blocks"))
    keys = saved(keys.select("key", "blocks"))
    if keys.isEmpty():
        return gone
    # A line stands in one block of its bucket; the open ones ask in each.
    left = left.join(keys, "key")
    block = F.pmod(F.xxhash64("doc", "line"), F.col("blocks")).cast("int")
    asked = left.select("*", block.alias("block"), F.lit(False).alias("asks"))
    asks = left.where("open").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"))
    dealt = asked.unionByName(asks).select(F.xxhash64("key", "block").alias("unit"), "doc", "line", "n", "sk", "sl", "asks")
    dealt = dealt.repartition("unit").sortWithinPartitions("unit")
    again = saved(dealt.mapInArrow(_cross(percent), "doc long, line int, doc0 long, line0 int").distinct())
    return gone if again.isEmpty() else gone.union(_matching(docs, again, percent)).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least: int = 5, counted: bool = False, limits: Limits = LIMITS) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text; with ``counted``
    also n_lines (before) and n_removed.  Documents that lose no line, by a bitmap
    of fixed size, are passed on where they are; only the others are shuffled, by a
    merge join at every size, since the lists grow with the corpus."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    late, key = clean_name(docs, "late_"), clean_name(docs, "key_")
    lists = removals(slim, percent, least, limits).groupBy(F.col("doc").alias(key)).agg(F.collect_list("line").alias(late))  # at most a document's lines
    lists = saved(lists)
    touched = bitmap(lists.select(key), spots)
    at = docs.columns.index(text_col)
    extra = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())] if counted else []

    def counted_lines(text: pa.Array) -> pa.Array:
        lines = pc.add(pc.cast(pc.count_substring(text, "\n"), pa.int64()), 1)
        return pc.fill_null(lines, 0)

    def split(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.unpackbits(np.frombuffer(touched.value, np.uint8)).astype(bool)
            for batch in pieces(batches, 1024):
                ids = batch.column(batch.num_columns - 1)
                hit = bits[spots(pc.fill_null(ids, 0).to_numpy())] & pc.is_valid(ids).to_numpy(zero_copy_only=False)
                kept = batch.filter(pa.array(hit == inside))
                if inside:
                    yield kept
                    continue
                cols, names = kept.columns[:-1], kept.schema.names[:-1]
                if counted:
                    cols = [*cols, counted_lines(kept.column(at)), pa.array(np.zeros(kept.num_rows, np.int64))]
                    names = [*names, "n_lines", "n_removed"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

        return run

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            texts, before, after = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                if drop and lines:
                    drop = set(drop)
                    kept = [x for i, x in enumerate(lines) if i not in drop]
                else:
                    kept = lines
                texts.append(None if text is None else "\n".join(kept) if len(kept) < len(lines) else text)
                before.append(len(lines))
                after.append(len(lines) - len(kept))
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            names = batch.schema.names[:-1]
            if counted:
                cols += [pa.array(before, pa.int64()), pa.array(after, pa.int64())]
                names = [*names, "n_lines", "n_removed"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    keyed = docs.withColumn(key, F.col(id_col).cast("long"))
    out = T.StructType([*docs.schema.fields, *extra])
    whole = keyed.mapInArrow(split(False), out)
    some = keyed.mapInArrow(split(True), keyed.schema).join(lists.hint("merge"), key, "left").select(*docs.columns, late)
    return whole.union(some.mapInArrow(rewrite, out))

"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document is the set of 64-bit hashes of its word shingles.  Two sets of sizes s
and l whose Jaccard similarity is at least p/100 differ in at most
H = (100 - p)(s + l) / (100 + p) elements.  Sizes fall into bands; each band cuts
the universe of hashes into m segments, and gives segment i an allocation a_i of
1 (its subset has to be equal) or 2 (its one-deletion neighbourhood has to meet).
If the allocations of a document's non-empty segments exceed H, similar documents
agree in one of them.  A document indexes the keys of its segments in its own
band and probes the lower bands that hold sizes it can match.  How many segments
of a band have allocation 2 is chosen by a cost model of rows written and chance
meetings.  Within that, a document rests its guarantee on its largest segments,
as many as H asks for: small ones are where unrelated documents meet.  A pair
counts only where one of the two has chosen the segment.  A document too unevenly cut for the guarantee also writes keys for its
empty segments; two such documents meet there.

What a bucket (the documents of one key) yields:

1. Every member is paired with two leaders of the bucket, the smallest by hash.
   Parity sketches (an upper bound of the difference that never misses) drop
   most pairs; each document's best is verified exactly, and components follow.
2. Buckets that still hold several components pair the members of different
   components, in blocks: first each member with the one whose sketch is nearest,
   which joins most components of a large group; then, over the components that
   follow, all pairs.  Pairs that pass the sketches are verified exactly.

So each linked pair is verified or already connected, while a large group of near
copies costs a few pairs a member.  Keys travel packed, many to a row; a task
keeps one leader of a key that it meets often and passes the other members by.

Defined cases.  Null is the empty text.  A text with fewer words than a shingle
has one shingle, all its words; without words the set is empty and linked with
nothing.  Rows with one id are one vertex, each with its own set size.  A null id
is linked with nothing and has a null component.  Further columns are ignored.
An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, give_back, lowered, mix, saved, shuffle_parts, sorted_runs, text_slices, word_hashes, words
from .graph import connected_components

_U = np.uint64
_STEP = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]
SKETCH = 1024  # bits
BLOCK = 1024  # documents of a bucket that are compared at once
FLUSH = 1 << 18  # keys a task holds before it packs them
FINE = 8  # packed parts for each shuffle partition
# Bits of a key's role; TAKEN: already passed on as member; CHOSEN: one of the
# segments that the document's own guarantee rests on.
PROBE, TAKEN, CHOSEN = 1, 2, 4
MEMBER, EDGE, DOC, COPY, KEYS = 0, 1, 2, 3, 4


class Shingler:
    """Sets of the texts of a slice."""

    def __init__(self, size: int) -> None:
        self.size = size

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        data = lowered(data)
        starts, ends, first = words(data, offsets)
        w = word_hashes(data, starts, ends)
        k = self.size
        step = [_U((_STEP[j % 4] * (2 * j + 1)) % (1 << 64)) for j in range(k)]
        whole = max(0, len(w) - k + 1)
        shingles = np.zeros(whole, _U)
        for j in range(k):
            shingles += w[j : j + whole] * step[j]
        shingles = mix(shingles)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(shingles[a : b - k + 1])
            elif b > a:
                short = np.array([sum(int(x) * int(step[j]) for j, x in enumerate(w[a:b])) + (b - a)], dtype=object) % (1 << 64)
                yield mix(short.astype(_U))
            else:
                yield np.zeros(0, _U)


class Layout:
    """Bands of set sizes with their segments and allocations."""

    def __init__(self, percent: int, ratio: float = 1.4) -> None:
        self.p = percent
        self.low = [1]
        while self.low[-1] < 1 << 31:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * ratio)))
        self.plan = [self._allocate(lo, hi - 1) for lo, hi in zip(self.low, self.low[1:], strict=False)]
        self.edges = np.array(self.low)

    def tolerance(self, s: int, size: int) -> int:
        """Most elements in which sets of these sizes can differ if linked."""
        return (100 - self.p) * (s + size) // (100 + self.p)

    def _allocate(self, low: int, high: int) -> tuple[int, int]:
        """(segments, how many of them have allocation 2) of least cost."""
        need = self.tolerance(high, high * 100 // self.p) + 1
        need += 2 + need // 8  # room for empty segments
        size = (low + high) / 2
        best = (math.inf, need, 0)
        for two in range(need // 2 + 1):
            m = need - two
            each = size / m
            rows = (m - two) + two * (1 + each)
            chance = 4 * m * math.exp(-each / 2)
            best = min(best, (rows + chance, m, two))
            if two > 64:
                break
        return best[1], best[2]

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def keys(self, h: np.ndarray, v: np.ndarray, band: int, differ: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the sorted set ``h`` (``v``: its mixed values) in a band,
        where partners differ in at most ``differ`` elements, and which of them
        are chosen."""
        m, two = self.plan[band]
        segment = ((h >> _U(32)) * _U(m)) >> _U(32)
        heads = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sums = np.add.reduceat(v, heads)
        ids = segment[heads]
        tag = lambda s: (s + _U(1)) * _U(_STEP[0]) + _U(((band + 1) * _STEP[1]) % (1 << 64))
        sizes = np.diff(np.r_[heads, len(h)])
        wide = (ids < two) & (sizes >= 2)
        weight = 1 + wide
        order = np.argsort(-sizes, kind="stable")
        enough = int(np.searchsorted(np.cumsum(weight[order]), differ + 1)) + 1
        chosen = np.zeros(len(ids), bool)
        chosen[order[:enough]] = True
        out, marks = [mix(sums + tag(ids))], [chosen]
        if two:
            within = np.repeat(np.arange(len(ids)), sizes)
            spare = np.flatnonzero(wide[within])
            out.append(mix(sums[within[spare]] - v[spare] + tag(segment[spare])))
            marks.append(chosen[within[spare]])
        if enough > len(ids):  # the segments that are not empty don't suffice
            bare = np.setdiff1d(np.arange(m, dtype=_U), ids)
            if two:
                bare = np.r_[bare, ids[(ids < two) & (sizes == 1)]]
            out.append(mix(tag(bare)))
            marks.append(np.ones(len(bare), bool))
        return np.concatenate(out), np.concatenate(marks)

    def emit(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and roles of a set, for its own band and those it probes."""
        n = len(h)
        v = mix(h ^ _U(_STEP[3]))
        own = self.band(n)
        keys, chosen = self.keys(h, v, own, self.tolerance(n, n * 100 // self.p))
        yield keys, chosen * np.uint8(CHOSEN)
        for band in range(self.band(-(-self.p * n // 100)), own):
            keys, chosen = self.keys(h, v, band, self.tolerance(n, self.low[band + 1] - 1))
            yield keys, chosen * np.uint8(CHOSEN) + np.uint8(PROBE)


def sketch(h: np.ndarray) -> bytes:
    """The parity of the elements that fall on each of SKETCH bits."""
    at = (h * _U(_STEP[2])) >> _U(54)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


_PACK = np.dtype([("k", "<u8"), ("id", "<i8"), ("n", "<i4"), ("role", "u1")])


def leaders(ids: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two leaders of each run, rows being sorted by key and
    hash of id."""
    return heads, np.minimum(heads + 1, heads + sizes - 1)


def _may_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether one role indexes and one has chosen the key."""
    return ((x & y & PROBE) == 0) & ((x | y) & CHOSEN > 0)


def runs_of(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``entries`` sorted by key and hash of id, with heads and sizes of runs."""
    entries = entries[np.lexsort((mix(entries["id"].astype(_U)), entries["k"]))]
    k = entries["k"]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return entries, heads, np.diff(np.r_[heads, len(k)])


def led(entries: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Links from the members of runs to their leaders, without repeats."""
    pairs = []
    for lead in leaders(entries["id"], heads, sizes):
        a, b = entries["id"], np.repeat(entries["id"][lead], sizes)
        keep = (a != b) & _may_link(entries["role"], np.repeat(entries["role"][lead], sizes))
        pairs.append(np.stack([a[keep], b[keep]], axis=1))
    return np.unique(np.concatenate(pairs), axis=0)


def _pack(size: int, percent: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, layout = Shingler(size), Layout(percent)
        held: list[np.ndarray] = []
        total, turn = 0, 0
        docs: list[tuple[int | None, int, bytes | None]] = []
        copies: list[tuple[int, int]] = []
        seen: dict[tuple[int, int, int], int] = {}

        def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int8()), pa.array(cols[2], pa.binary())], names=["part", "kind", "body"])

        def flush() -> pa.RecordBatch:
            nonlocal held, total, turn
            turn += 1
            out: list[tuple[int, int, bytes]] = []
            if held:
                entries, heads, sizes = runs_of(np.concatenate(held))
                held, total = [], 0
                often = sizes > 1
                inside = np.repeat(often, sizes)
                if often.any():
                    many = entries[inside]
                    own_sizes = sizes[often]
                    own_heads = np.cumsum(own_sizes) - own_sizes
                    spread = int(entries["k"][0] % _U(parts))
                    out.append((spread, MEMBER, many.tobytes()))
                    out.append((spread, EDGE, led(many, own_heads, own_sizes).tobytes()))
                sent = entries[heads]
                sent["role"] = np.where(often, sent["role"] | TAKEN, sent["role"])
                # The leader stands for members of either role.
                indexed = np.maximum.reduceat((entries["role"] & PROBE == 0).astype(np.uint8), heads)
                sent["role"] = np.where(indexed > 0, sent["role"] & ~np.uint8(PROBE), sent["role"])
                sent["role"] |= np.bitwise_or.reduceat(entries["role"] & np.uint8(CHOSEN), heads)
                part = (sent["k"] >> _U(7)) % _U(parts)
                order = np.argsort(part, kind="stable")
                sent, part = sent[order], part[order]
                cuts = np.searchsorted(part, np.arange(parts + 1, dtype=_U))
                out += [(i, KEYS, sent[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
            for kind, found in ((DOC, docs), (COPY, copies)):
                if found:
                    body = np.array(copies, np.int64).tobytes() if kind == COPY else packed_docs(docs)
                    out.append(((turn * 7919 + int(found[0][0] or 0)) % parts, kind, body))
                    found.clear()
            return rows(out)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, data, offsets in text_slices(batch.column(1)):
                for i, h in enumerate(shingler.sets(data, offsets)):
                    id_ = ids[lo + i]
                    docs.append((id_, len(h), sketch(h) if len(h) else b""))
                    if id_ is None or not len(h):
                        continue
                    mark = (len(h), int(mix(h).sum(dtype=_U)), int(mix(h ^ _U(_STEP[1])).sum(dtype=_U)))
                    if mark in seen:
                        copies.append((id_, seen[mark]))
                        continue
                    seen[mark] = id_
                    for keys, roles in layout.emit(h):
                        entry = np.empty(len(keys), _PACK)
                        entry["k"], entry["id"], entry["n"], entry["role"] = keys, id_, len(h), roles
                        held.append(entry)
                        total += len(keys)
                    if total >= FLUSH:
                        yield flush()
            if len(docs) > 20_000:
                yield flush()
            give_back()
            if len(seen) > 500_000:
                seen.clear()
        yield flush()

    return run


_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i4"), ("sk", f"V{SKETCH // 8}")])


def packed_docs(docs: list[tuple[int | None, int, bytes | None]]) -> bytes:
    out = np.zeros(len(docs), _DOC)
    out["id"] = [d[0] or 0 for d in docs]
    out["null"] = [d[0] is None for d in docs]
    out["n"] = [d[1] for d in docs]
    out["sk"] = np.frombuffer(b"".join(d[2] or bytes(SKETCH // 8) for d in docs), f"V{SKETCH // 8}")
    return out.tobytes()


_OUT = "kind int, k long, a long, b long, n int, role int, sk binary"


def _rows(kind: int, size: int, **cols) -> pa.RecordBatch:
    kinds = {"k": pa.int64(), "a": pa.int64(), "b": pa.int64(), "n": pa.int32(), "role": pa.int32(), "sk": pa.binary()}
    arrays = [pa.array(np.full(size, kind, np.int32))]
    arrays += [cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], t) if c in cols else pa.nulls(size, t) for c, t in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", *kinds])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members and leader links of the buckets of more than one document."""
    links: list[np.ndarray] = []

    def flushed() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(links), axis=0)
        links.clear()
        return _rows(EDGE, len(pairs), a=np.ascontiguousarray(pairs[:, 0]), b=np.ascontiguousarray(pairs[:, 1]))

    def members(found: np.ndarray) -> pa.RecordBatch:
        plain = (found["role"] & (PROBE | CHOSEN)).astype(np.int32)
        return _rows(MEMBER, len(found), k=found["k"].astype(np.int64), a=found["id"].astype(np.int64), n=found["n"].astype(np.int32), role=plain)

    for run_ in sorted_runs(batches):
        kinds = run_.column("kind").to_pylist()
        bodies = run_.column("body").to_pylist()
        keys = []
        for kind, body in zip(kinds, bodies, strict=True):
            if kind == KEYS:
                keys.append(np.frombuffer(body, _PACK))
            elif kind == MEMBER:
                yield members(np.frombuffer(body, _PACK))
            elif kind == EDGE:
                links.append(np.frombuffer(body, np.int64).reshape(-1, 2))
            elif kind == COPY:
                pairs = np.frombuffer(body, np.int64).reshape(-1, 2)
                yield _rows(COPY, len(pairs), a=np.ascontiguousarray(pairs[:, 0]), b=np.ascontiguousarray(pairs[:, 1]))
            else:
                docs = np.frombuffer(body, _DOC)
                ids = pa.array(docs["id"].astype(np.int64), mask=docs["null"].astype(bool))
                yield _rows(DOC, len(docs), a=ids, n=docs["n"].astype(np.int32), sk=[x.tobytes() for x in docs["sk"]])
        if keys:
            entries, heads, sizes = runs_of(np.concatenate(keys))
            often = (sizes > 1) & (np.bitwise_or.reduceat(entries["role"], heads) & CHOSEN > 0)
            if often.any():
                many = entries[np.repeat(often, sizes)]
                own_sizes = sizes[often]
                links.append(led(many, np.cumsum(own_sizes) - own_sizes, own_sizes))
                yield members(many[many["role"] & TAKEN == 0])
        if sum(map(len, links)) > 1_000_000:
            yield flushed()
    if links:
        yield flushed()
    give_back()


def _near(layout: Layout):
    """Drops pairs (a, b, n, m, x, y) whose sizes or sketches forbid a link;
    what is left has the distance of the sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), _U).reshape(len(a), -1) for i in (4, 5))
            far = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)
            keep = _fit(layout, n.astype(np.int64), m.astype(np.int64), far)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array((far - n - m)[keep].astype(np.int64))], names=["a", "b", "far"])

    return run


def _fit(layout: Layout, n: np.ndarray, m: np.ndarray, far: np.ndarray) -> np.ndarray:
    p = layout.p
    return (far * (100 + p) <= (100 - p) * (n + m)) & (np.minimum(n, m) * 100 >= p * np.maximum(n, m))


def _cross(layout: Layout, best: bool):
    """Pairs of different components within the blocks of a bucket: all, or with
    ``best`` for each document the one whose sketch is nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_ in sorted_runs(batches):
            if run_.num_rows < 2:
                continue
            a, n, role, comp, side = (run_.column(c).combine_chunks().to_numpy() for c in ("a", "n", "role", "comp", "side"))
            n = n.astype(np.int64)
            x = np.frombuffer(b"".join(run_.column("sk").to_pylist()), _U).reshape(len(a), -1)
            found = []
            whole = not side.any()
            for i in range(len(a)):
                j = np.arange(len(a)) if whole else np.flatnonzero(side != side[i])
                if not best:
                    j = j[j > i]
                j = j[(comp[j] != comp[i]) & _may_link(role[i], role[j])]
                j = j[np.minimum(n[i], n[j]) * 100 >= layout.p * np.maximum(n[i], n[j])]
                if len(j):
                    far = np.bitwise_count(x[j] ^ x[i]).sum(axis=1).astype(np.int64)
                    fit = _fit(layout, n[i], n[j], far)
                    j, far = j[fit], far[fit]
                if len(j):
                    j = j[np.lexsort((a[j], far / (n[i] + n[j])))][:1] if best else j
                    found.append(np.stack([np.full(len(j), a[i]), a[j]], axis=1))
            if found:
                pairs = np.sort(np.concatenate(found), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    return run


BITS = 1 << 23  # of the bitmap of wanted ids, 1 MB whatever their number


def _spots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(_U)) % _U(BITS)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS, bool)
    for batch in batches:
        bits[_spots(batch.column(0).to_numpy())] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


def _wanted_sets(size: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        shingler = Shingler(size)
        for batch in batches:
            batch = batch.filter(pa.array(want[_spots(batch.column(0).to_numpy())]))
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                bodies = [h.tobytes() for h in shingler.sets(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(bodies, pa.binary())], names=["id", "body"])

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


def verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) that are links, by their whole sets.
    ``docs`` has id and text.  A bitmap of fixed size keeps most documents that
    no pair needs out of the shuffle; the joins settle the rest."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().coalesce(16)
    total = np.zeros(BITS // 8, np.uint8)
    for row in ids.mapInArrow(_marked, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], np.uint8)
    bits = docs.sparkSession.sparkContext.broadcast(total.tobytes())
    sets = docs.where(F.col("id").isNotNull()).mapInArrow(_wanted_sets(size, bits), "id long, body binary")
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("body").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(_exact(percent), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    layout = Layout(percent)
    parts = FINE * shuffle_parts(docs.sparkSession)
    packed = docs.mapInArrow(_pack(size, percent, parts), "part long, kind byte, body binary")
    packed = packed.repartition(shuffle_parts(docs.sparkSession), "part").sortWithinPartitions("part")
    out = saved(packed.mapInArrow(_buckets, _OUT), ["kind"])
    of = lambda kind: out.where(F.col("kind") == kind)
    own = of(DOC).select(F.col("a").alias("id"), "n", "sk")

    edges = of(EDGE).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = own.select(F.col("id").alias("a"), "n", F.col("sk").alias("x"))
    right = own.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sk").alias("y"))
    near = edges.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_near(layout), "a long, b long, far long")
    both = near.select("a", "b", "far").union(near.select(F.col("b"), F.col("a"), "far"))
    best = both.groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b"))
    links = saved(verified(docs, saved(best.distinct()), size, percent))
    links = links.union(of(COPY).select("a", "b"))

    def crossing(links: DataFrame, best: bool) -> DataFrame:
        """Links found among the buckets' members of different components."""
        comps = saved(connected_components(links))
        members = of(MEMBER).select("k", F.col("a").alias("id"), "n", "role").join(comps, "id", "left")
        members = saved(members.select("k", F.col("id").alias("a"), "n", "role", F.coalesce("component_id", "id").alias("comp")))
        part = lambda s: F.sum(F.pmod(F.xxhash64("a", "role", F.lit(s)), F.lit(1 << 31)))
        mixed = members.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"), F.max(F.col("role").bitwiseAND(CHOSEN)).alias("chosen"), part(1).alias("s1"), part(2).alias("s2"))
        # Of the buckets with the same members in the same roles one is enough.
        mixed = mixed.where("lo <> hi AND chosen > 0").groupBy("c", "s1", "s2").agg(F.min("k").alias("k")).select("k", F.col("c").alias("n_"))
        mixed = saved(mixed)
        rest = members.join(mixed.select("k"), "k").join(own.select(F.col("id").alias("a"), "sk"), "a")
        dealt = block_pairs(rest, ["k"], F.xxhash64("a"), BLOCK, mixed)
        dealt = dealt.select("unit", "a", "n", "role", "comp", "side", "sk").repartition("unit").sortWithinPartitions("unit")
        return verified(docs, saved(dealt.mapInArrow(_cross(layout, best), "a long, b long").distinct()), size, percent)

    for best_only in (True, False):
        links = saved(links.union(crossing(links, best_only)))
    comps = connected_components(links)
    result = own.select("id", "n").join(comps, "id", "left")
    return result.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))

"""BPE encoding and decoding with a given vocabulary file.

The text is cut as the vocabulary's own file says: marked special strings in
the raw text, then NFC, white space to one space, lower case, then runs of
letters, single digits, contractions and runs of other signs, each as bytes in
the printable byte alphabet with an end-of-word mark on its last part.

Words are merged by a contiguous rank array: a block of words of similar length
is a matrix of parts beside a matrix of the ranks of adjacent parts.  In every
round each row scans its ranks for the first minimum, merges those two parts,
deletes the boundary between them and refreshes the ranks on either side.  A
word of more than ``SHORT`` parts has a heap of ranks over linked parts instead,
which gives the same merges.  Pieces that were encoded lately are kept in two
generations of bounded size.

Defined cases.  Null is the empty text: no ids, '' decoded.  Texts have no
length limit.  Rows are encoded one by one, so repeated rows and further columns
do not matter; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back

SHORT = 64  # parts of a word in the matrix form
KEPT = 150_000  # pieces in one generation of the cache
BLOCK = 8192  # words merged together
# The white space of Unicode.
WHITE = "\t\n\v\f\r \x85\xa0                　"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + more)
            more += 1
    return out


class Bpe:
    """A vocabulary with its merge table, made once in each worker."""

    def __init__(self, spec: dict) -> None:
        import regex

        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.strings = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for text, i in vocab.items():
            self.strings[i] = text
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.strings[i] = text
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + self.end] for c in alphabet], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.n = len(self.strings)
        key = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # The last of repeated pairs counts, as in a mapping built in order.
        unique = {k: i for i, k in enumerate(key.tolist())}
        order = np.array(sorted(unique.values(), key=lambda i: key[i]), np.int64)
        self.keys, self.ranks, self.made = key[order], order, made[order]
        self.none = len(pairs)
        self.table = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made, strict=True)}
        cut = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(cut).findall
        marks = sorted(self.special, key=len, reverse=True)
        self.hint = os.path.commonprefix(marks)  # what every special string begins with
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        white = WHITE
        if text.isascii():
            white = WHITE[:6]
        else:
            # Characters are lowered one by one, so sigma has one form.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        for c in white:
            text = text.replace(c, " ")
        return text.lower()

    # ---- merging

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``none`` where there is no merge) and merged id."""
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], self.none), self.made[at]

    def merge_block(self, parts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``parts``: a word a row, -1 behind its end.  Merged in place."""
        width = parts.shape[1]
        rank = np.full(parts.shape, self.none, np.int64)
        into = np.zeros(parts.shape, np.int64)
        if width > 1:
            rank[:, :-1], into[:, :-1] = self.lookup(parts[:, :-1], parts[:, 1:])
        live = np.arange(len(parts))
        while len(live):
            at = rank[live].argmin(axis=1)
            go = rank[live, at] < self.none
            live, at = live[go], at[go]
            if not len(live):
                break
            parts[live, at] = into[live, at]
            # Delete the boundary at + 1: what is behind moves up by one.
            for i in range(int(at.min()) + 1, width - 1):
                moved = live[at < i]
                parts[moved, i], rank[moved, i], into[moved, i] = parts[moved, i + 1], rank[moved, i + 1], into[moved, i + 1]
            parts[live, width - 1] = -1
            rank[live, width - 1] = self.none
            # The merge at ``at`` used the rank between it and the part deleted.
            count[live] -= 1
            right = np.minimum(at + 1, width - 1)
            rank[live, at], into[live, at] = self.lookup(parts[live, at], np.where(right > at, parts[live, right], -1))
            before = at > 0
            l, a = live[before], at[before]
            rank[l, a - 1], into[l, a - 1] = self.lookup(parts[l, a - 1], parts[l, a])
        return parts, count

    def merge_long(self, parts: list[int]) -> list[int]:
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(*self.table[k], i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (k := parts[i] * self.n + parts[i + 1]) in self.table]
        heap = [(r, i, m, a, b) for r, m, i, a, b in heap]
        heapq.heapify(heap)
        end = len(parts)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= end or parts[j] != b:
                continue
            parts[i], parts[j] = made, -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < end and (hit := self.table.get(parts[x] * self.n + parts[y])):
                    heapq.heappush(heap, (hit[0], x, hit[1], parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        short = order[sizes[order] <= SHORT]
        for lo in range(0, len(short), BLOCK):
            rows = short[lo : lo + BLOCK]
            count = sizes[rows]
            parts = np.full((len(rows), int(count[-1])), -1, np.int64)
            inside = np.arange(parts.shape[1])[None, :] < count[:, None]
            parts[inside] = self.inner[np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)]
            at = (np.arange(len(rows)), count - 1)
            parts[at] = self.last[np.fromiter((words[i][-1] for i in rows), np.int64, len(rows))]
            parts, count = self.merge_block(parts, count.copy())
            flat = parts[np.arange(parts.shape[1])[None, :] < count[:, None]].astype("<u4").tobytes()
            ends = np.cumsum(count * 4).tolist()
            start = 0
            for i, end in zip(rows.tolist(), ends, strict=True):
                out[i] = flat[start:end]
                start = end
        for i in order[len(short) :].tolist():
            parts = [*self.inner[np.frombuffer(words[i][:-1], np.uint8)].tolist(), int(self.last[words[i][-1]])]
            out[i] = np.array(self.merge_long(parts), "<u4").tobytes()
        return out

    # ---- texts

    def cut(self, chunk: str) -> list[str]:
        """The pieces of a text without white space."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1:] in ".,!:;" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pieces(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Puts the ids of ``chunks`` (texts without white space) into the cache."""
        names = list(chunks)
        pieces = list(map(self.cut, names))
        words = dict.fromkeys(p for ps in pieces for p in ps)
        words = dict(zip(words, self.encode_words([p.encode() for p in words]), strict=True))
        for name, ps in zip(names, pieces, strict=True):
            self.new[name] = words[ps[0]] if len(ps) == 1 else b"".join([words[p] for p in ps])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if len(self.new) > KEPT:
            self.old, self.new = self.new, {}
        # The key of a special string has a blank, which no chunk has.
        self.new.update({" " + t: np.array([i], "<u4").tobytes() for t, i in self.special.items()})
        cut: list[list[str]] = []
        seen: set[str] = set()
        for text in texts:
            if text and self.marks and self.hint in text:
                row = []
                for i, span in enumerate(self.marks.split(text)):
                    row.extend([" " + span] if i % 2 else self.normal(span).split(" "))
            else:
                row = self.normal(text).split(" ") if text else []
            seen.update(row)
            cut.append(row)
        missing = seen - self.new.keys()
        known = missing & self.old.keys()
        self.new.update(zip(known, map(self.old.__getitem__, known), strict=True))
        self.learn(missing - known)
        get = self.new.__getitem__
        return [b"".join(map(get, row)) for row in cut]

    def decode(self, ids: bytes) -> str:
        """The strings of the ids with a blank between them: the vocabulary's
        file names no decoder, and that is what the absence of one means."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_spec(path: str) -> dict:
    """The vocabulary file; refused where it asks for what is not built here."""
    spec = json.loads(Path(path).read_text())
    model = spec["model"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    odd = [model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") or odd:
        raise ValueError(f"not a vocabulary of the kind built here: {path}")
    return spec


_HELD: dict[str, Bpe] = {}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also the
    ids (array<int>) and the decoded text."""
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _HELD:
            _HELD.clear()
            _HELD[path] = Bpe(spec.value)
        bpe = _HELD[path]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                encoded = bpe.encode_batch(part.column(1).to_pylist())
                decoded = [bpe.decode(x) for x in encoded]
                cols = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in encoded]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    cols += [pa.array([np.frombuffer(x, "<i4") for x in encoded], pa.list_(pa.int32())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            give_back()

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)

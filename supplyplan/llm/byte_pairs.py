"""Byte-level BPE encoding and decoding by prefix tables (operator 13).

Every prefix of a byte string has one valid encoding, so one last token; the encoding of the whole is read backwards
from it. A table of last tokens grows with appended bytes without a second look at the earlier ones, and after an
edit it is filled anew only until it agrees with the old one for as many places as the longest token has bytes.

Texts are split by the vocabulary's pattern first, and each distinct piece is encoded once per worker. Documents
don't meet, so nothing is shuffled; a task holds one block of texts, its distinct pieces and the vocabulary.

Defined results: a null text counts as empty and has no ids; special tokens are ordinary text; repeated rows are
encoded each; a null doc_id stays null; a piece of any length costs time in proportion to it; an empty table gives
no rows; extra columns are ignored. Null ids decode to null, and an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import arrow_map, give_back
from .textcodes import gather
from .tokens import Encoder

#: remembered answers on neighbouring tokens
MEMO = 1 << 20
#: bytes of text, or ids, that are worked on at once
BLOCK = 1 << 18


class Vocabulary:
    """Tokens in the order of their merges; the id of a token is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.texts = [b""] * (max(ranks.values()) + 1)
        for text, k in ranks.items():
            self.texts[k] = text
        self.longest = max(map(len, ranks))
        self.step: dict[int, int] = {}  # (node of the trie of reversed tokens, byte) -> node
        self.token_at = [-1]
        for text, k in ranks.items():
            node = 0
            for byte in reversed(text):
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.step[key]
            self.token_at[node] = k
        self.memo: dict[int, bool] = {}
        self.parts: list[tuple[int, int] | None] = [None] * len(self.texts)
        for k in sorted(ranks.values()):
            text = self.texts[k]
            for cut in range(1, len(text)):
                left, right = ranks.get(text[:cut], k), ranks.get(text[cut:], k)
                if left < k and right < k and self._apart(left, right, k):
                    self.parts[k] = left, right
                    break
            else:
                if len(text) > 1:
                    raise ValueError(f"token {k} is no merge of two earlier ones")

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """True if no merge before `limit` joins the two tokens.

        The merges that made them are taken back, the latest first. What then touches at the border must not be a
        token of an earlier rank. Of equal ranks the left merge comes first: a border merge that is as early as the
        one within the right token would win, one that is as early as the one within the left token would not.
        """
        ranks, texts, parts = self.ranks, self.texts, self.parts
        while True:
            if ranks.get(texts[left] + texts[right], limit) < limit:
                return False
            if left > right and parts[left]:
                limit, left = left, parts[left][1]
            elif parts[right]:
                limit, right = right + 1, parts[right][0]
            else:
                return True

    def follows(self, left: int, right: int) -> bool:
        """True if `right` can come after `left` in an encoding."""
        key = left << 32 | right
        if key not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[key] = self._apart(left, right, len(self.texts))
        return self.memo[key]

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode_batch(self, texts: list[str], **_) -> list[SimpleNamespace]:
        """Ids of texts, as the block encoder of `tokens` asks for them. Pieces in sorted order share a table's beginning."""
        split = [[piece.encode() for piece in self.pieces(text)] for text in texts]
        ids, table = {}, Prefixes(self)
        for piece in sorted(set().union(*split)):
            head = shared(table.data, piece)
            table.replace(head, len(table.data), piece[head:])
            ids[piece] = table.ids()
        return [SimpleNamespace(ids=[t for piece in own for t in ids[piece]]) for own in split]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    if b.startswith(a):
        return len(a)
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


class Prefixes:
    """One piece, with the last token of each of its prefixes (-1 for the empty one)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _fill(self, until=None) -> None:
        """The places without a last token: the one token that ends there and may follow what ends before it."""
        v, data, last = self.vocabulary, self.data, self.last
        step, token_at, memo, follows = v.step, v.token_at, v.memo, v.follows
        for end in range(len(last), len(data) + 1):
            if until and until(end):
                return
            node = 0
            for s in range(end - 1, -1, -1):
                node = step[node << 8 | data[s]]
                token, before = token_at[node], last[s]
                if token < 0:
                    continue
                fits = before < 0 or memo.get(before << 32 | token)
                if fits is None:
                    fits = follows(before, token)
                if fits:
                    last.append(token)
                    break

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill()

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put `new` for the bytes [start, end); returns how many places were filled anew."""
        old, edge, shift = self.last, start + len(new), start + len(new) - end
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start + 1]
        same, done, longest = 0, len(self.data), self.vocabulary.longest

        def agrees(at: int) -> bool:
            nonlocal same, done
            same = same + 1 if at > edge and old[at - 1 - shift] == self.last[at - 1] else 0
            if same >= longest:
                self.last += old[at - shift:]
                done = at - 1
            return same >= longest

        self._fill(agrees if end < len(old) - 1 else None)
        return done - start

    def ids(self) -> list[int]:
        out, end, texts = [], len(self.data), self.vocabulary.texts
        while end:
            out.append(self.last[end])
            end -= len(texts[out[-1]])
        return out[::-1]


class EncodedText:
    """A text under edits: its pieces with their tables. Only pieces that an edit touches are encoded anew."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text, self.starts, self.tables = vocabulary, "", [], []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put `new` for the characters [start, end).

        A match of the pattern sees one character beyond its end. So splitting starts again one piece before the
        edit, and ends where it meets a border of the old pieces behind the edit.
        """
        shift = start + len(new) - end
        old = {s: k for k, s in enumerate(self.starts)}
        first = max(0, bisect_right(self.starts, max(0, start - 1)) - 2)
        text = self.text[:start] + new + self.text[end:]
        begin = self.starts[first] if self.starts else 0
        fresh, rest = [], len(self.starts)
        for m in self.vocabulary.pattern.finditer(text, begin):
            if m.start() >= start + len(new) and m.start() - shift in old:
                rest = old[m.start() - shift]
                break
            fresh.append(m)
        touched = {table.data: table for table in self.tables[first:rest]}
        self.tables[first:rest] = [self._table(m[0].encode(), touched) for m in fresh]
        self.starts = self.starts[:first] + [m.start() for m in fresh] + [s + shift for s in self.starts[rest:]]
        self.text = text

    def _table(self, data: bytes, touched: dict[bytes, Prefixes]) -> Prefixes:
        """A table of the bytes; the old table that shares most of its beginning is edited rather than filled from nothing."""
        table, head = None, 0
        for old in touched:
            if shared(old, data) > head:
                table, head = touched[old], shared(old, data)
        if table is None:
            return Prefixes(self.vocabulary, data)
        touched.pop(table.data)
        old, tail = table.data, 0
        while tail < min(len(old), len(data)) - head and old[-1 - tail] == data[-1 - tail]:
            tail += 1
        table.replace(head, len(old) - tail, data[head:len(data) - tail])
        return table

    def ids(self) -> list[int]:
        return [t for table in self.tables for t in table.ids()]


_vocabularies: dict[str, Vocabulary] = {}


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file, once per process; by default the one that the public tokenizers install."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _vocabularies:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _vocabularies[path] = Vocabulary(ranks, public_tokenizers.PATTERN)
    return _vocabularies[path]


class _BlockEncoder(Encoder):
    """The block encoder of `tokens`, its distinct pieces encoded by prefix tables."""

    def __init__(self, vocabulary: Vocabulary):
        self.library = vocabulary
        self._clear()

    def _fresh(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = [e.ids for e in self.library.encode_batch(strings)]
        return np.array([t for ids in new for t in ids], np.uint32), np.array([len(ids) for ids in new], np.int64)


def _runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of together about `limit`; a larger row is alone."""
    lo, held = 0, 0
    for k, size in enumerate(sizes):
        if k > lo and held + size > limit:
            yield lo, k
            lo, held = k, 0
        held += size
    if sizes:
        yield lo, len(sizes)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    encode = _BlockEncoder(load(path)).encode
    for batch in batches:
        texts = [t or "" for t in batch["text"].to_pylist()]
        for lo, hi in _runs([len(t) for t in texts], BLOCK):
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(lo, hi - lo), _lists(encode(texts[lo:hi]))], ["doc_id", "ids"])
    give_back()


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every text; `path` is a file of ranks that every executor has."""
    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), lambda it: _encoded(it, path),
                     "doc_id bigint, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    texts = load(path).texts
    lens = np.array([len(t) for t in texts], np.int64)
    starts, data = np.cumsum(lens) - lens, np.frombuffer(b"".join(texts), np.uint8)
    for batch in batches:
        column = batch["ids"]
        for lo, hi in _runs(np.diff(column.offsets.to_numpy()).tolist(), BLOCK):
            part = column.slice(lo, hi - lo)
            ids = part.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and (part.flatten().null_count or ids.min() < 0 or ids.max() >= len(texts) or not lens[ids].all()):
                raise ValueError("an id is not in the vocabulary")
            sizes = lens[ids] if len(ids) else lens[:0]
            cuts = np.concatenate([[0], np.cumsum(np.diff(part.offsets.to_numpy()))])
            ends = np.concatenate([[0], np.cumsum(sizes)])[cuts]
            raw = data[gather(starts[ids], sizes)].tobytes() if len(ids) else b""
            out = [raw[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], part.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), part, pa.array(out, pa.binary())],
                                             ["doc_id", "ids", "decoded"])
    give_back()


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for."""
    return arrow_map(tokens.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")),
                     lambda it: _decoded(it, path), "doc_id bigint, ids array<int>, decoded binary")


def _edited(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    vocabulary = load(path)
    for batch in batches:
        rows = []
        for text, edits in zip(batch["text"].to_pylist(), batch["edits"].to_pylist()):
            own = EncodedText(vocabulary, text or "")
            for e in edits or ():
                start = min(max(0, e["start"] or 0), len(own.text))
                own.replace(start, min(max(start, e["end"] or 0), len(own.text)), e["new"] or "")
            rows.append((own.text, own.ids()))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))],
            ["doc_id", "text", "ids"])


def edited(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text and ids after `edits`, an array of (start, end, new) in characters, applied one after the other.

    A null bound counts as 0 and a null `new` as empty; bounds beyond the text are drawn in.
    """
    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text", "edits"), lambda it: _edited(it, path),
                     "doc_id bigint, text string, ids array<int>")

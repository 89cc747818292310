"""Token ids of a byte-level BPE vocabulary for blocks of texts.

The vocabulary splits texts into pre-tokens before it merges bytes, and a pre-token's ids don't depend on its
neighbours. So texts are cut into pre-tokens in numpy, and the `tokenizers` library encodes each distinct one once
per worker. Texts with code points outside the plain ranges go through the library whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from .textcodes import gather, prefix, run_hash

OTHER, LETTER, NUMBER, SPACE = range(4)
#: ranges of code points whose classes Unicode versions agree on: Latin to Cyrillic, general punctuation
PLAIN = ((0x0000, 0x0530), (0x2000, 0x2070))
#: Unicode White_Space in those ranges
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
#: what may follow an apostrophe as one pre-token
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
#: distinct pre-tokens that a worker remembers, some 20 MB
CACHE_ENTRIES = 1 << 19


def _classes() -> tuple[np.ndarray, np.ndarray]:
    size = PLAIN[-1][1] + 1
    kind, plain = np.zeros(size, np.uint8), np.zeros(size, bool)
    for lo, hi in PLAIN:
        plain[lo:hi] = True
        for c in range(lo, hi):
            kind[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    kind[WHITE] = SPACE
    return kind, plain


_KIND, _PLAIN = _classes()


def pretoken_starts(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts laid end to end; bounds are the texts' starts and the end."""
    n = len(codes)
    kind = _KIND[codes]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    opens = edge[:n].copy()
    opens[1:] |= kind[1:] != kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = codes[:-1] == 0x20
    after_blank &= ~edge[:n]
    runs = np.flatnonzero(opens)
    ends = np.append(runs[1:], n)
    start = np.zeros(n + 1, bool)
    white = kind[runs] == SPACE
    start[runs[white]] = True
    # the last blank of a longer run stands apart, or goes to the word after it
    longer = white & (ends - runs > 1) & ~edge[ends]
    start[ends[longer] - 1] = True
    start[runs[~white & ~after_blank[runs]]] = True
    single = runs[~white & (ends - runs == 1) & ~after_blank[runs]]
    for p in single[codes[single] == 0x27].tolist():
        for tail in ENDINGS:
            end = p + 1 + len(tail)
            if end <= n and not edge[p + 1:end].any() and all(codes[p + 1 + j] == ord(x) for j, x in enumerate(tail)):
                start[p + 1] = False
                if end < n:
                    start[end] |= bool(kind[end] == LETTER) or bool(edge[end])
                break
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of texts; one per worker, with the ids of the pre-tokens it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are ordinary text
        self._clear()

    def _clear(self) -> None:
        self.keys, self.offs, self.lens, self.ids = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.uint32))

    def _fresh(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings, one after the other, and how many each has."""
        # as the words of one text: one answer of the library in place of one for each string
        new = self.library.encode(strings, is_pretokenized=True, add_special_tokens=False)
        lens = np.bincount(np.array(new.word_ids, np.int64), minlength=len(strings)).astype(np.int64)
        return np.array(new.ids, np.uint32), lens

    def _learn(self, keys: np.ndarray, strings: list[str]) -> None:
        if len(self.keys) > CACHE_ENTRIES:
            self._clear()
        flat, lens = self._fresh(strings)
        at = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys, self.lens = np.insert(self.keys, at, keys), np.insert(self.lens, at, lens)
        self.offs = np.insert(self.offs, at, len(self.ids) + np.cumsum(lens) - lens)
        self.ids = np.concatenate([self.ids, flat])

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return at, np.zeros(len(keys), bool)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == keys

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        odd = np.flatnonzero(~_PLAIN[np.minimum(codes, len(_PLAIN) - 1)])
        slow = sorted(set((np.searchsorted(bounds, odd, "right") - 1).tolist()))
        if slow:
            for k, e in zip(slow, self.library.encode_batch([texts[k] for k in slow], add_special_tokens=False)):
                out[k] = np.array(e.ids, np.uint32)
            away = set(slow)
            rest = [k for k in range(len(texts)) if k not in away]
            for k, ids in zip(rest, self.encode([texts[k] for k in rest])) if rest else ():
                out[k] = ids
            return out
        if not len(codes):
            return out
        starts = pretoken_starts(codes, bounds)
        ends = np.append(starts[1:], len(codes))
        keys, first, which = np.unique(run_hash(prefix(codes), starts, ends), return_index=True, return_inverse=True)
        at, known = self._find(keys)
        if not known.all():
            joined, new = "".join(texts), ~known
            self._learn(keys[new], [joined[starts[k]:ends[k]] for k in first[new].tolist()])
            at, known = self._find(keys)
            if not known.all():  # the cache was cleared: learn the block's pre-tokens anew
                self._learn(keys[~known], [joined[starts[k]:ends[k]] for k in first[~known].tolist()])
                at, _ = self._find(keys)
        lens = self.lens[at][which]
        ids = self.ids[gather(self.offs[at][which], lens)]
        cuts = np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

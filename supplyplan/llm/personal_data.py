"""Personal data (operator 9): base patterns, and a character-level bidirectional LSTM with CRF transitions.

The base patterns find their spans in every whole text. The network, trained in numpy on spans they label in a
bounded sample of rows, adds spans of the same kinds in other spellings. Texts are read in overlapping windows; each
window is decoded by Viterbi, and every character takes its tag from the window in whose core it lies, so that
spans are reconciled over the whole text. A span holds a digit or an @ by construction, so windows without either
are not decoded. Added spans never overlap base ones and must pass the same checks of digits and parts.

Defined results: a null text counts as empty and has no spans; repeated rows are judged alike; a null doc_id stays
null; with nothing to train on only base spans are found; an empty table gives no rows; extra columns are ignored.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import sigmoid
from .shipping import arrow_map

KINDS = ("email", "ip", "card", "phone")
#: of an email, the run of letters before the @ and what follows it; a match of the others can't begin within a run of digits,
#: so that each of these reads a text once, whatever its runs
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]++"), re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_TRIGGER = re.compile(r"[0-9@]")

#: rows whose windows the network may be trained on, and the number of these windows
SAMPLE, SAMPLE_WINDOWS = 2_000, 2_400
WINDOW, MARGIN = 128, 16
CORE = WINDOW - 2 * MARGIN
HIDDEN = 12
TAGS = 1 + 2 * len(KINDS)
_ALPHABET = 100  # 0 is padding, 1..95 printable ASCII, then line ends, other spaces, letters, the rest
_DECODED_AT_ONCE = 512


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def passes(kind: str, s: str) -> bool:
    """The check that a match of the kind's pattern must pass."""
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in s.split(".")))
    if kind == "card":
        return 13 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return True


def _may_add(kind: str, s: str) -> bool:
    """The check for spans that only the network has found."""
    if kind == "email":
        return s.count("@") == 1 and s[0] != "@" != s[-1] and not re.search(r"\s", s)
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(\s?\.\s?[0-9]+){3}", s)) and passes(kind, re.sub(r"\s", "", s))
    return passes(kind, s) and s[-1].isdigit()


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of local part, @ and a domain of two labels or more, leftmost and not overlapping."""
    end = 0
    for run in _LOCAL.finditer(text):
        start = max(run.start(), end)  # an earlier email's domain may reach into the run
        if start < run.end() and (m := _DOMAIN.match(text, run.end())):
            end = m.end()
            yield start, end


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if not _TRIGGER.search(text):
        return out
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        found = emails(text) if kind == "email" else (m.span() for m in PATTERNS[kind].finditer(text))
        out += [(kind, a, b) for a, b in found if kind == "email" or passes(kind, text[a:b])]
    return out


def _class_table() -> np.ndarray:
    t = np.full(0x110000, 98, np.uint8)
    t[0x20:0x7F] = np.arange(1, 96)
    t[[0x0A, 0x0D]] = 96
    t[[0x09, 0xA0, 0x202F, 0x3000, *range(0x2000, 0x200B)]] = 97
    t[0x00C0:0x0250] = 99
    return t


_CLASS = _class_table()


def codes(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def window_starts(text: str) -> list[int]:
    """Starts of the windows to decode: on a grid of cores, those that hold a digit or an @."""
    out: set[int] = set()
    for m in _TRIGGER.finditer(text):
        p = m.start() + MARGIN
        out.update(range(max(0, -(-(p - WINDOW + 1) // CORE)) * CORE - MARGIN, m.start() + 1, CORE))
    return sorted(out)


def cut(all_codes: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.uint8)
    lo, hi = max(start, 0), min(start + WINDOW, len(all_codes))
    out[lo - start:hi - start] = all_codes[lo:hi]
    return out


class Tagger:
    """Parameters of the network: two LSTM directions, emissions and transitions."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {k: r.normal(0, s, shape).astype(np.float32) for k, s, shape in (
            ("xf", 0.3, (_ALPHABET, 4 * h)), ("xb", 0.3, (_ALPHABET, 4 * h)), ("hf", 0.2, (h, 4 * h)),
            ("hb", 0.2, (h, 4 * h)), ("w", 0.2, (2 * h, TAGS)))}
        self.p |= {"b": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        for k in ("xf", "xb"):
            self.p[k][:, h:2 * h] += 1  # forget gates begin open

    @staticmethod
    def barred() -> np.ndarray:
        """Transitions that can't be: into the inside of a kind from anything but that kind."""
        m = np.zeros((TAGS, TAGS), np.float32)
        for inside in range(2, TAGS, 2):
            m[:, inside] = -1e4
            m[[inside - 1, inside], inside] = 0
        return m

    def _run(self, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool):
        n, steps = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, saved = np.empty((steps, n, HIDDEN), np.float32), []
        for s in range(steps):
            z = wx[x[:, s]] + h @ wh
            gates = sigmoid(z[:, :3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN:])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            before, hb = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[s] = h
            if keep:
                saved.append((hb, before, i, f, o, g, tc))
        return out, saved

    def emissions(self, x: np.ndarray, keep: bool = False):
        p = self.p
        forth, sf = self._run(x, p["xf"], p["hf"], keep)
        back, sb = self._run(x[:, ::-1], p["xb"], p["hb"], keep)
        hidden = np.concatenate([forth, back[::-1]], 2)
        return hidden @ p["w"] + p["b"], hidden, sf, sb

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags of windows, by Viterbi."""
        e = self.emissions(x)[0]
        steps, n, _ = e.shape
        trans = self.p["t"] + self.barred()
        best = e[0].copy()
        best[:, 2::2] -= 1e4
        came = np.empty((steps, n, TAGS), np.uint8)
        for s in range(1, steps):
            paths = best[:, :, None] + trans
            came[s] = paths.argmax(1)
            best = np.take_along_axis(paths, came[s][:, None, :].astype(np.int64), 1)[:, 0] + e[s]
        tags = np.empty((n, steps), np.uint8)
        tags[:, -1] = best.argmax(1)
        for s in range(steps - 1, 0, -1):
            tags[:, s - 1] = came[s][np.arange(n), tags[:, s]]
        return tags

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p = self.p
        n, steps = x.shape
        e, hidden, sf, sb = self.emissions(x, True)
        trans = p["t"] + self.barred()
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        alpha[0][:, 2::2] -= 1e4

        def logsum(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis, keepdims=True)
            return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

        for s in range(1, steps):
            alpha[s] = logsum(alpha[s - 1][:, :, None] + trans, 1) + e[s]
        for s in range(steps - 2, -1, -1):
            beta[s] = logsum(trans + (e[s + 1] + beta[s + 1])[:, None, :], 2)
        z = logsum(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        dt = np.zeros_like(p["t"])
        for s in range(1, steps):
            dt += np.exp(alpha[s - 1][:, :, None] + trans + (e[s] + beta[s])[:, None, :] - z[:, None, None]).sum(0)
        gold = e[np.arange(steps)[:, None], np.arange(n)[None, :], y.T].sum() + trans[y[:, :-1], y[:, 1:]].sum()
        de[np.arange(steps)[:, None], np.arange(n)[None, :], y.T] -= 1
        np.subtract.at(dt, (y[:, :-1], y[:, 1:]), 1)
        g = {"t": dt, "b": de.sum((0, 1)), "w": np.einsum("snh,snk->hk", hidden, de)}
        dh = de @ p["w"].T
        for k, saved, d, xs in (("f", sf, dh[:, :, :HIDDEN], x), ("b", sb, dh[::-1, :, HIDDEN:], x[:, ::-1])):
            wh, dx, dwh = p["h" + k], np.zeros_like(p["x" + k]), np.zeros_like(p["h" + k])
            carry_h, carry_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for s in range(steps - 1, -1, -1):
                hb, before, i, f, o, gg, tc = saved[s]
                total = d[s] + carry_h
                dc = carry_c + total * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), total * tc * o * (1 - o),
                                     dc * i * (1 - gg * gg)], 1)
                np.add.at(dx, xs[:, s], dz)
                dwh += hb.T @ dz
                carry_h, carry_c = dz @ wh.T, dc * f
            g["x" + k], g["h" + k] = dx, dwh
        return float((z.sum() - gold) / n), {k: v / n for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 3) -> float:
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        steps, k, loss = epochs * -(-len(x) // batch), 0, 0.0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                part = order[at:at + batch]
                loss, g = self.gradient(x[part], y[part])
                k += 1
                size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for name, a in g.items():
                    a = a * min(1.0, 5.0 / (size + 1e-9))
                    m[name] += 0.1 * (a - m[name])
                    v[name] += 0.01 * (a * a - v[name])
                    self.p[name] -= (rate * (1 - (k - 1) / steps) * (m[name] / (1 - 0.9 ** k))
                                     / (np.sqrt(v[name] / (1 - 0.99 ** k)) + 1e-8)).astype(np.float32)
        return loss


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, at, xs, ys = [], [], [], []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            all_codes = codes(text)
            tags = np.zeros(len(all_codes), np.uint8)
            for kind, a, b in base_spans(text):
                k = 1 + 2 * KINDS.index(kind)
                tags[a:b] = k + 1
                tags[a] = k
            for start in window_starts(text):
                y = cut(tags, start)
                if y[0] and not y[0] % 2:  # a span that began before the window begins with it
                    y[0] -= 1
                docs.append(doc)
                at.append(start)
                xs.append(cut(all_codes, start).tobytes())
                ys.append(y.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(at, pa.int64()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())],
            ["doc", "at", "x", "y"])


def fit(docs: DataFrame, sample: int = SAMPLE, windows: int = SAMPLE_WINDOWS) -> Tagger | None:
    """Train on at most `windows` windows of at most `sample` rows that hold a digit or an @."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").filter(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    found = arrow_map(rows.join(F.broadcast(chosen), "doc_id", "left_semi"), _training_windows,
                      "doc bigint, at bigint, x binary, y binary")
    table = found.orderBy(F.xxhash64("doc", "at"), "doc", "at", "x").limit(windows).toArrow()
    if not table.num_rows:
        return None
    x, y = (np.frombuffer(b"".join(table[k].to_pylist()), np.uint8).reshape(-1, WINDOW) for k in ("x", "y"))
    if not y.any():
        return None
    tagger = Tagger()
    tagger.train(x, y.astype(np.int64))
    return tagger


def tag_texts(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """Spans that the network finds in each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    tags_of: dict[int, np.ndarray] = {}
    queue: list[tuple[int, int, np.ndarray]] = []

    def decode() -> None:
        tags = tagger.decode(np.stack([w for _, _, w in queue]))
        for (k, start, _), own in zip(queue, tags):
            lo, hi = start + MARGIN, min(start + MARGIN + CORE, len(texts[k]))  # the core is this window's alone
            tags_of.setdefault(k, np.zeros(len(texts[k]), np.uint8))[lo:hi] = own[MARGIN:MARGIN + hi - lo]
        queue.clear()

    for k, text in enumerate(texts):
        starts = window_starts(text)
        if starts:
            all_codes = codes(text)
            for start in starts:
                queue.append((k, start, cut(all_codes, start)))
                if len(queue) == _DECODED_AT_ONCE:
                    decode()
    if queue:
        decode()
    for k, tags in tags_of.items():
        kind = (tags.astype(np.int16) + 1) // 2
        opens = (kind > 0) & ((tags % 2 == 1) | (np.concatenate([[0], kind[:-1]]) != kind))
        for a in np.flatnonzero(opens).tolist():
            b = a + 1
            while b < len(tags) and kind[b] == kind[a] and not opens[b]:
                b += 1
            out[k].append((KINDS[kind[a] - 1], a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    out = [(base_spans(t), []) for t in texts]
    if tagger is not None:
        for text, (base, added), found in zip(texts, out, tag_texts(texts, tagger)):
            added += [(kind, a, b) for kind, a, b in found
                      if all(b <= x or a >= y for _, x, y in base) and _may_add(kind, text[a:b])]
    return out


def _find(batches: Iterator[pa.RecordBatch], tagger: Tagger | None, per: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, per):
            part = batch.slice(lo, per)
            rows = []
            for base, added in find_spans([t or "" for t in part["text"].to_pylist()], tagger):
                own = joined(base)
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS),
                             hashlib.sha256(own.encode()).hexdigest(), joined(base + added)))
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def personal_data(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans as text."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # a fixed number of parameters
    return arrow_map(docs.select("doc_id", "text"), lambda it: _find(it, shared.value),
                     f"doc_id {dict(docs.dtypes)['doc_id']}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                     "base_sha256 string, spans string")

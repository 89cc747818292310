"""Every operator against a brute-force version, over texts with every odd case."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from llm_texts import docs, rows  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from supplyplan.llm import (
    decontaminate, exact_dedup, language, line_dedup, near_dedup, packing, personal_data, quality, repeats, substring_dedup,
    suffix_dedup,
)

sha = lambda b: hashlib.sha256(b).hexdigest()
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(text):
    return NORMAL.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_id(df):
    """Rows by doc_id; repeated rows must agree."""
    out = {}
    for r in df.collect():
        assert out.setdefault(r.doc_id, r) == r
    return out


def covered(tokens_of, width):
    """Tokens covered by a window that also starts earlier, for {doc: tokens}."""
    seen, out = set(), {}
    for k in sorted(tokens_of):
        t, gone = tokens_of[k], set()
        for i in range(len(t) - width + 1):
            w = tuple(t[i:i + width])
            if w in seen:
                gone.update(range(i, i + width))
            seen.add(w)
        out[k] = gone
    return out


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_substring(docs, rows, limit):
    got = by_id(substring_dedup.substring_dedup(docs, index_words=limit))
    words = {k: (t or "").encode().split() for k, t in rows}
    for k, gone in covered(words, 20).items():
        kept = b" ".join(w for i, w in enumerate(words[k]) if i not in gone)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(words[k]), len(gone), sha(kept)), k
    assert None in got and got[None].n_words == 3


@pytest.mark.parametrize("limit", [1 << 21, 2000])
def test_suffixes(docs, rows, limit):
    got = by_id(suffix_dedup.suffix_dedup(docs, bucket_bytes=limit))
    data = {k: (t or "").encode() for k, t in rows}
    for k, gone in covered(data, 100).items():
        kept = bytes(b for i, b in enumerate(data[k]) if i not in gone)
        spans = sum(i - 1 not in gone for i in gone)
        assert (got[k].n_bytes, got[k].n_removed, len(got[k].removed), got[k].kept_sha256) == (
            len(data[k]), len(gone), spans, sha(kept)), k


@pytest.mark.parametrize("module, width, gram, read, size", [
    (substring_dedup, 20, 6, repeats.word_tokens, 4), (suffix_dedup, 100, 32, repeats.byte_tokens, 1)])
def test_passage_in_a_third_of_the_rows(spark, module, width, gram, read, size):
    r = np.random.default_rng(5)
    word = lambda: f"q{r.integers(1 << 40):x}"
    passage = " ".join(word() for _ in range(40))
    # over the passage's edge half of the documents go on alike, so that windows repeat in segments that don't
    rows = [(k, " ".join([*(word() for _ in range(30)), *(["same end"] * (k % 6 == 0) + [passage, "like this"] if k % 3 == 0 else []),
                          *(word() for _ in range(30))])) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    limit = 40 * width
    segments, _ = repeats.candidate_segments(docs, repeats.Unit(width, gram, read), size, limit)
    held = segments.groupBy("anchor").agg(F.sum(F.length("tokens") / size).alias("tokens")).agg(F.max("tokens")).first()[0]
    assert held <= limit  # nothing that is indexed or sorted at once is larger
    words = module is substring_dedup
    got = by_id(substring_dedup.substring_dedup(docs, index_words=limit) if words else suffix_dedup.suffix_dedup(docs, bucket_bytes=limit))
    tokens = {k: t.encode().split() if words else t.encode() for k, t in rows}
    gone = covered(tokens, width)
    assert sum(map(len, gone.values())) > 79 * width
    for k, t in tokens.items():
        kept = [x for i, x in enumerate(t) if i not in gone[k]]
        assert (got[k].n_removed, got[k].kept_sha256) == (len(gone[k]), sha(b" ".join(kept) if words else bytes(kept))), k


def test_wavelet_ranks():
    r = np.random.default_rng(0)
    symbols = r.integers(0, 37, 500)
    m = substring_dedup.WaveletMatrix(symbols, 37)
    q, lo = r.integers(0, 37, 200), r.integers(0, 501, 200)
    a, b = m.ranks(q, lo, np.full(200, 500))
    assert a.tolist() == [int((symbols[:p] == s).sum()) for s, p in zip(q, lo)]
    assert b.tolist() == [int((symbols == s).sum()) for s in q]


@pytest.mark.parametrize("shard_words", [100_000, 30])
def test_decontamination(spark, docs, rows, shard_words):
    items = [(1, rows[5][1]), (2, " ".join(rows[8][1].split()[10:40])), (3, "one"), (4, None), (5, "..."), (3, "one"),
             (6, "don't say"), (7, "spin spin spin")]
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), shard_words=shard_words)
    got = by_id(found)
    for k, t in rows:
        w, hit, ids = normal_words(t), set(), set()
        for item, text in items:
            own = normal_words(text)
            m = min(13, len(own))
            grams = {tuple(own[i:i + m]) for i in range(len(own) - m + 1)} if own else ()
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in grams:
                    hit.update(range(i, i + m))
                    ids.add(str(item))
        assert (got[k].n_words, got[k].n_hit, sorted(got[k]["items"])) == (len(w), len(hit), sorted(ids)), k
        assert got[k].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    clean = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), shard_words=shard_words)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id is not None) == sorted(
        [k for k in got if k is not None and not got[k].contaminated])
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(found.filter("n_hit > 0"), longest=1000).collect()}
    assert cut[3] == ""
    none = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("n_hit > 0 OR contaminated").count() == 0


@pytest.mark.parametrize("digits", [64, 1])
def test_exact(spark, docs, rows, tmp_path, digits):
    """With one digit of the digest nearly all hits are collisions, told apart by their bytes."""
    from pyspark.sql import functions as F

    docs.write.parquet(str(tmp_path / "d"))
    got = [r for r in exact_dedup.exact_dedup(spark, str(tmp_path / "d"), lambda c: F.substring(F.sha2(c, 256), 1, digits)).collect()]
    texts = dict(rows) | {None: "no id here"}
    groups = {}
    for k in [*dict(rows), 8, None]:
        groups.setdefault(texts[k] or "", []).append(k)
    assert len(got) == len(rows) + 2
    for r in got:
        own = groups[texts[r.doc_id] or ""]
        best = max((k for k in own if k is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(own)), r
    assert sum(r.kept for r in got) == len(groups)


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_lines(spark, docs, rows):
    line = "a sentence of more than thirty-two bytes, number "
    more = [(100 + k, line + s) for k, s in enumerate(["12345678", "12345679", "1234567", "99999999", "12345x7y", "2345678"])]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = by_id(every.join(line_dedup.removed_lines(every).withColumnRenamed("doc", "doc_id"), "doc_id", "left").select("doc_id", "removed"))
    first = {}
    for k, t in [*rows, *more]:
        for i, x in enumerate((t or "").encode().split(b"\n")):
            if x.strip(b" \t\x0b\x0c\r"):
                first.setdefault(x, (k, i))
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = [x for x in first if 32 <= len(x) < 300]
    for x, y in combinations(near, 2):
        if abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
            a, b = sorted((find(x), find(y)), key=first.get)
            root[b] = a
    for k, t in [*rows, *more]:
        own = [(i, *first[find(x)]) for i, x in enumerate((t or "").encode().split(b"\n"))
               if x.strip(b" \t\x0b\x0c\r") and first[find(x)] != (k, i)]
        assert [(r.line, r.first_doc, r.first_line) for r in got[k].removed or []] == own, k
    kept = line_dedup.line_dedup(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 9").count() == 0
    assert kept.filter("doc_id = 12").first().text == "same line of some length that repeats itself"
    assert {0, 1, 2} <= {r.doc_id for r in kept.collect()}


def test_links_of_lines(spark):
    r, line = np.random.default_rng(3), "a sentence of more than thirty-two bytes that varies"
    texts = ["".join("#" if p in at else c for p, c in enumerate(line)) for at in (
        set(r.choice(len(line), k % 3, replace=False).tolist()) for k in range(300))]
    texts += [t + "!" for t in texts[:20]] + [texts[5]]
    got = by_id(line_dedup.linked_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumnRenamed("doc", "doc_id"))
    distinct = set(texts)
    want = {t: sum(t != o and distance(t, o) <= 2 for o in distinct) for t in distinct}
    assert max(want.values()) > 150 > min(want.values())
    assert {k: [x.n_links for x in got[k].linked] for k in got} == {k: [want[t]] * (want[t] > 0) for k, t in enumerate(texts)}


def test_edit_distance():
    import random

    r = random.Random(1)
    for _ in range(3000):
        a, b = (bytes(r.choices(b"abc", k=r.randrange(11))) for _ in range(2))
        for t in (1, 2, 3):
            d = distance(a, b)
            assert line_dedup.edit_distance(a, b, t) == d if d <= t else line_dedup.edit_distance(a, b, t) > t


def test_near_duplicates(spark, docs, rows):
    r = np.random.default_rng(4)
    base, more = [f"w{k}" for k in range(90)], []
    for k in range(60):  # near copies of one text that often resemble it more than each other
        w = list(base)
        for p in r.integers(0, 90, 1 + k % 2):
            w[p] = f"x{k}"
        more.append((200 + k, " ".join(w)))
    every = docs.select("doc_id", "text").union(spark.createDataFrame([*more, (199, " ".join(base))], "doc_id long, text string"))
    got = by_id(near_dedup.near_dedup(every))
    texts = dict(rows) | dict(more) | {199: " ".join(base)}
    grams = {}
    for k, t in texts.items():
        w = normal_words(t)
        grams[k] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else None
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        if grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {k: got[k].class_id for k in texts} == {k: find(k) for k in texts}
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {k for k in dict(rows) if find(k) == k}


def test_moved_passages(spark):
    r = np.random.default_rng(11)
    fresh = iter(range(1 << 30))
    draw = lambda n: [f"v{next(fresh)}" for _ in range(n)]

    def edited(w, edits):
        w = list(w)
        for p in r.choice(len(w), edits, replace=False):
            w[p] = draw(1)[0]
        return w

    pairs = []
    for k in range(60):
        w = draw(int(r.integers(400, 501)))
        pairs.append((w, edited(w[len(w) // 2:] + w[:len(w) // 2], k % 8)))  # halves swapped
        w = draw(int(r.integers(400, 501)))
        parts = [w[i * len(w) // 8:(i + 1) * len(w) // 8] for i in range(8)]
        pairs.append((w, [x for i in r.permutation(8) for x in parts[i]]))  # paragraphs shuffled
        short = draw(int(r.integers(8, 14)))
        pairs.append((short, [*short, *draw(1)]))  # few shingles, the least of them 4 of 5
    rows = [(2 * k + side, " ".join(pair[side])) for k, pair in enumerate(pairs) for side in (0, 1)]
    got = by_id(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    sets = {k: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.split()) for k, t in rows)}
    linked = {k: len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1]) for k in range(len(pairs))}
    assert 100 < sum(linked.values())
    assert {k: got[2 * k + 1].class_id == 2 * k for k in linked} == linked


def test_aligned_similarity():
    a = np.arange(200, dtype=np.uint32)
    b = np.concatenate([a[:50], [999], a[52:], [7777]]).astype(np.uint32)
    assert near_dedup.aligned(a, b) == 198 / (200 + 200 - 198)
    assert near_dedup.aligned(a, a) == 1 and near_dedup.aligned(a, a[::-1].copy()) < 0.8
    moved = np.concatenate([a[100:], a[:100]])
    assert near_dedup.similarity(a, moved) == 1  # moved halves: the sets decide


@pytest.mark.parametrize("items", [100_000, 3])
def test_packing(docs, rows, items):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {k: t.encode(x or "", add_special_tokens=False).ids + [0] for k, x in [*rows, (None, "no id here")]}
    got = packing.best_fit_packing(docs, items=items).collect()
    want = []
    for k in [*dict(rows), 8, None]:
        n = len(ids[k])
        cuts = [0, *range(n % 2048 or 2048, n + 1, 2048)]
        want += [(k, p, a, b - a, zlib.crc32(np.array(ids[k][a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=lambda x: (str(x[0]), x[1:])) == sorted(
        want, key=lambda x: (str(x[0]), x[1:]))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    if items > 3:
        assert len(bins) <= 1 + -(-sum(r.length for r in got) // 2048)


def test_best_fit():
    lengths = np.array([5, 7, 3, 10, 5, 2, 8])
    bins, n = packing.best_fit(lengths, 10)
    assert n == 4 and all(lengths[bins == b].sum() <= 10 for b in range(n))


def test_pretokens_match_the_library():
    import random

    import public_tokenizers

    from supplyplan.llm.tokens import Encoder

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    parts = ["a", "é", " ", "  ", "\n", "'", "s", "re", "'ll", "1", "!", "\t", " ", "Ж", "—", "<|endoftext|>", "日", "😀", "\x1c", "'d"]
    texts = ["".join(r.choices(parts, k=r.randrange(12))) for _ in range(4000)]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]


def test_personal_data(docs, rows):
    tagger = personal_data.fit(docs)
    for model in (tagger, None):
        got = by_id(personal_data.personal_data(docs, model))
        r = got[19]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
        text = dict(rows)[19]
        at = lambda kind, s: f"{kind}:{text.index(s)}:{text.index(s) + len(s)}"
        own = ",".join([at("email", "a.b@mail.example.com"), at("ip", "10.1.2.3"), at("card", "4111 1111 1111 1111"),
                        at("phone", "+1 (555) 010-9999")])
        assert r.base_sha256 == sha(own.encode()) and set(own.split(",")) <= set(r.spans.split(","))
        assert got[0].spans == "" and got[0].base_sha256 == sha(b"")


def test_tagger_learns_spans():
    """Held-out windows: the network finds what the patterns label, and its gradient is that of its loss."""
    import random

    r = random.Random(5)

    def window():
        kind = r.randrange(3)
        s = {0: f"u{r.randrange(99)}@m{r.randrange(9)}.example.com", 1: ".".join(str(r.randrange(256)) for _ in range(4)),
             2: f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}"}[kind]
        return " ".join(r.choices(["the", "of", "thing", "in"], k=r.randrange(3, 9))) + " " + s + " and so on"

    texts = [window() for _ in range(600)]
    xs, ys = [], []
    for t in texts[:500]:
        tags = np.zeros(len(t), np.uint8)
        for kind, a, b in personal_data.base_spans(t):
            tags[a:b] = 2 + 2 * personal_data.KINDS.index(kind)
            tags[a] -= 1
        xs.append(personal_data.cut(personal_data.codes(t), -16))
        ys.append(personal_data.cut(tags, -16))
    x, y = np.stack(xs), np.stack(ys).astype(np.int64)
    tagger = personal_data.Tagger()
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    loss, g = tagger.gradient(x[:4], y[:4])
    for name, at in (("w", (3, 2)), ("t", (0, 1)), ("hf", (1, 5)), ("xb", (int(x[0, 60]), 3))):
        kept = tagger.p[name][at]
        tagger.p[name][at] = kept + 1e-4
        up = tagger.gradient(x[:4], y[:4])[0]
        tagger.p[name][at] = kept - 1e-4
        down = tagger.gradient(x[:4], y[:4])[0]
        tagger.p[name][at] = kept
        assert abs((up - down) / 2e-4 - g[name][at]) < 1e-2 * max(1, abs(g[name][at]))
    tagger = personal_data.Tagger()
    tagger.train(x, y, epochs=12)
    found = personal_data.tag_texts(texts[500:], tagger)
    base = [personal_data.base_spans(t) for t in texts[500:]]
    assert np.mean([set(b) <= set(f) for b, f in zip(base, found)]) > 0.9


SMALL, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_quality(spark, docs):
    every, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.filter("doc_id % 4 <> 1"), labels.filter("doc_id % 4 = 1")
    model = quality.fit(every, quality.graded(train))
    scored = quality.score(every, model).join(quality.graded(test), "doc_id").collect()
    right = np.mean([(r.p_best >= 0.5) == (r.grade == 2) for r in scored])
    assert len(scored) > 50 and right > 0.9
    assert all(0 <= r.expected_grade <= 2 for r in scored) and list(model.thresholds) == sorted(model.thresholds)
    odd = by_id(quality.score(docs, model))
    assert odd[0].p_best == odd[1].p_best
    kept = quality.select_good(docs, model)
    assert kept.columns == docs.columns
    nothing = quality.fit(docs, quality.graded(labels.limit(0)))
    assert quality.select_good(docs, nothing).count() == docs.count()


def test_language(spark, docs):
    every = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language.predict(every, language.fit(every)).join(every.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 for r in got)
    odd = by_id(language.predict(docs, language.fit(docs)))
    assert odd[0].lang_pred == odd[1].lang_pred == odd[2].lang_pred == "und" and odd[3].lang_pred == "en"
    assert odd[None].held_out is False
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.limit(0))).collect()} == {"und"}


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    none.write.parquet(str(tmp_path / "none"))
    items = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    for df in (substring_dedup.substring_dedup(none), suffix_dedup.suffix_dedup(none), decontaminate.contamination(none, items),
               line_dedup.line_dedup(none), near_dedup.near_dedup(none), packing.best_fit_packing(none),
               personal_data.personal_data(none, personal_data.fit(none)), language.predict(none, language.fit(none)),
               exact_dedup.exact_dedup(spark, str(tmp_path / "none"))):
        assert df.count() == 0

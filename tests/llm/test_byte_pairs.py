"""Operator 13 against the public tokenizer library, and its tables under appends and edits."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from llm_texts import docs, rows  # noqa: F401  (fixtures)

from conftest import SMALL
from supplyplan.llm import byte_pairs, queries

ALPHABET = "abcdeiorstnl '-=_0129\u00e9\u00fc\u00f1\n\t\u65e5\u672c \U0001f600.!"
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def vocabulary():
    return byte_pairs.load()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def scrambled(r, n):
    return "".join(r.choice(ALPHABET) for _ in range(r.randrange(n)))


def test_every_token_is_its_own_encoding(vocabulary):
    assert all(byte_pairs.Prefixes(vocabulary, t).ids() == [k] for k, t in enumerate(vocabulary.texts))


def test_random_texts(vocabulary, library):
    r = random.Random(1)
    texts = [scrambled(r, 60) for _ in range(3000)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(80))) for _ in range(3000)]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert [e.ids for e in vocabulary.encode_batch(texts)] == library.encode_ordinary_batch(texts)


def test_long_piece(vocabulary, library):
    for text in ("a" * 300_000, "-" * 50_000, "".join(random.Random(2).choice("etaoin") for _ in range(50_000))):
        assert byte_pairs.Prefixes(vocabulary, text.encode()).ids() == library.encode_ordinary(text)


def test_appends_equal_one_encoding(vocabulary):
    r = random.Random(3)
    whole = b"".join(scrambled(r, 9).encode() for _ in range(200))
    grown = byte_pairs.Prefixes(vocabulary)
    for k in range(0, len(whole), 7):
        grown.append(whole[k:k + 7])
        assert grown.last == byte_pairs.Prefixes(vocabulary, grown.data).last


def test_edit_of_a_piece_is_local(vocabulary):
    r = random.Random(4)
    table = byte_pairs.Prefixes(vocabulary, bytes(r.choice(b"etaoinsr") for _ in range(20_000)))
    for _ in range(50):
        start = r.randrange(len(table.data))
        end = min(len(table.data), start + r.randrange(4))
        filled = table.replace(start, end, bytes(r.choice(b"etaoinsr") for _ in range(r.randrange(4))))
        assert filled < 400
        assert table.last == byte_pairs.Prefixes(vocabulary, table.data).last


def test_edits_of_texts(vocabulary, library):
    r = random.Random(5)
    for _ in range(300):
        own = byte_pairs.EncodedText(vocabulary, scrambled(r, 200))
        for _ in range(5):
            start = r.randrange(len(own.text) + 1)
            end = r.randrange(start, min(len(own.text), start + 9) + 1)
            text, new = own.text, scrambled(r, 9)
            own.replace(start, end, new)
            assert own.text == text[:start] + new + text[end:]
            assert own.ids() == library.encode_ordinary(own.text)
        own.append(" more")
        assert own.ids() == library.encode_ordinary(own.text)


def test_documents(spark, docs, rows, library):
    tokens = byte_pairs.encoded(docs)
    assert tokens.columns == ["doc_id", "ids"]
    texts = dict(rows) | {None: "no id here"}
    got = byte_pairs.decoded(tokens).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == library.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    assert byte_pairs.decoded(byte_pairs.encoded(docs.limit(0))).count() == 0


def test_odd_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_pairs.decoded(rows).collect()} == {1: None, 2: b""}
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_pairs.decoded(spark.createDataFrame([(1, [50_256])], "doc_id long, ids array<int>")).collect()


def test_edited_documents(spark, library):
    rows = [(1, "the quick brown fox", [(4, 9, "slow"), (0, 0, "See ")]), (2, None, [(None, None, "new")]), (3, "kept", None),
            (4, "short", [(90, 99, " tail"), (2, None, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>")
    got = {r.doc_id: r for r in byte_pairs.edited(docs).collect()}
    assert {k: r.text for k, r in got.items()} == {1: "See the slow brown fox", 2: "new", 3: "kept", 4: "short tail"}
    assert all(r.ids == library.encode_ordinary(r.text) for r in got.values())


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op13_byte_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))


def test_new_pre_tokens_go_to_the_library_in_one_call():
    """Ids equal the library's on whole texts, and a block asks it once, whatever the number of pre-tokens."""
    import public_tokenizers

    from supplyplan.llm.tokens import Encoder

    one = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    library, calls = one.library, []

    class Counted:
        def __getattr__(self, name):
            return lambda *a, **b: calls.append(len(a[0]) if name == "encode_batch" else 1) or getattr(library, name)(*a, **b)

    one.library = Counted()
    texts = ["", " ", "it's  a\n\n test", "<|endoftext|> x", "Über-größe 12345 'll", "a" * 300, "don't don't", "—   z \t"]
    got = [x.tolist() for x in one.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sum(calls) == 1


def test_block_encoder_learns_pieces_by_prefix_tables(vocabulary, library):
    """The block encoder runs on the vocabulary alone, also where its cache is cleared between blocks."""
    encoder = byte_pairs._BlockEncoder(vocabulary)
    texts = ["", " ", "it's  a\n\n test", "<|endoftext|> x", "Über-größe 12345 'll", "a" * 300, "don't don't", "日本語 z \t"]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == library.encode_ordinary_batch(texts)
        encoder._clear()
    assert [x.tolist() for x in encoder.encode(["", ""])] == [[], []]

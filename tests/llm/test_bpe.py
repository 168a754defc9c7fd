"""Byte-pair encoding and token counts against the tokenizer library."""

import hashlib
import random

import numpy as np
import pytest

from sparklore.llm import bpe

P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, n_tokens string, n_bytes string, decoded string, k0 string, r0 string"
TEXTS = [None, "", " ", "a", "Hello world's  end\n\n x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "é漢字 ñ 12³ ½", "\x85\x1c　 x",
         "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 300 + "x", "=-" * 2000, "\U0001f600" * 200, "\x00\x01", "same", "same"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def vocabulary():
    with open(FILE, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z", "u", "v", "w") for i, t in enumerate(texts)], SCHEMA)


def test_random_texts(library, vocabulary):
    rng = random.Random(5)
    encoder, counter = bpe.Encoder(vocabulary), bpe.Counter(vocabulary)
    letters = "abc 's  \n\tthe and ing 12é漢字ñ!!==--\r　\x85\x1c<|endoftext|>'ll"
    for t in [t for t in TEXTS if t is not None] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]:
        want = library.encode(t, add_special_tokens=False).ids
        written, ids = encoder.encode(t)
        assert ids.tolist() == want and written == ",".join(map(str, want))
        assert counter.count(t) == len(want)
        assert vocabulary.decode(ids).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_pre_tokens_of_all_characters(vocabulary):
    from tokenizers import pre_tokenizers
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for c in [*range(0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x11000, 7), *range(0x11380, 0x11400), *range(0x16130, 0x16140)]:
        if 0xD800 <= c < 0xE000:
            continue
        s = f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}"
        got = [t for p in vocabulary.pieces(s) for t in vocabulary.pre_tokens(p)]
        assert got == [s[a:b] for _, (a, b) in split.pre_tokenize_str(s)], hex(c)


def test_tables_start_anew_when_full(library, vocabulary):
    encoder = bpe.Encoder(vocabulary)
    encoder.known._most = encoder.pre_tokens._most = 3
    t = "one two three four five six one two three " * 3
    assert encoder.encode(t)[1].tolist() == library.encode(t, add_special_tokens=False).ids


def test_operators(spark, library):
    table = docs(spark, TEXTS)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    encoded = bpe.encode(table, FILE)
    assert set(encoded.columns) == set(table.columns)
    assert [r["ids"] for r in encoded.orderBy("doc_id").collect()] == want
    back = bpe.decode(encoded, FILE, text="decoded").orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == [t or "" for t in TEXTS]
    assert [r["text"] for r in back] == TEXTS and {r["k0"] for r in back} == {"v"}
    digests = bpe.digests(table, FILE, keep=["doc_id"]).orderBy("doc_id").collect()
    for r, ids, t in zip(digests, want, TEXTS):
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    counts = bpe.count_tokens(table, FILE, limit=3).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts] == [
        (len((t or "").encode()), len(ids), len(ids) > 3) for t, ids in zip(TEXTS, want)]
    assert bpe.encode(table.limit(0), FILE).collect() == [] == bpe.count_tokens(table.limit(0), FILE).collect()


def test_decode_of_odd_ids(spark):
    rows = spark.createDataFrame([(None,), ([],), ([50256, None, -1, 99999999, 64],), ([220 - 220 + 187],)], "ids array<int>")
    got = [r["text"] for r in bpe.decode(rows, FILE).collect()]
    assert got[0] is None and got[1] == "" and got[2].startswith("<|endoftext|>") and got[3] == "�"


def test_offsets(vocabulary):
    ids = np.array([50256, 0, 1, 262])
    assert vocabulary.decode(ids) == b"".join(vocabulary.text_of[i] for i in ids)


def test_digests_keep_more_pieces_than_the_ids_of_the_pipeline(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 10)
    with open(FILE, encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    text = " ".join(f"word{i}" for i in range(25))
    large, small = bpe.Encoder(vocabulary, bpe.DIGEST_TABLES), bpe.Encoder(vocabulary)
    assert large.encode(text)[0] == small.encode(text)[0]
    assert len(large.known) == 25 and len(small.known) <= 10

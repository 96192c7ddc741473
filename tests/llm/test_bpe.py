"""BPE by forced boundaries against the tokenizers library."""

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from promptmill.llm.bpe import Tokenizer, decoded, digests, encoded  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCÉéßñΣσς '<|>endoftxsr123²³Ⅷ日本̧́​\xa0\n\t!?—…€😀🏽ԀА"
HARD = ["", " \n", "I'LL don't 'S 's ’s", "<|endoftext|>x<|startoftext|><|ENDOFTEXT|> <|endoftext|", "Σίσυφος ΟΔΟΣ",
        "İstanbul ß ẞ ﬁ ŉ", "日本語 한국어 ไทย", "a" * 5000, "x" * 63 + "!" * 200, "\x00\x01\x7f\x85 \xa0 x", "ͅ", "Ᲊ\U00010d50"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return Tokenizer(file.read())


def texts(seed):
    rng = random.Random(seed)
    return HARD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 80))) for _ in range(500)]


def test_ids_and_decoding_equal_the_library(own, library):
    for text in texts(1):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert own.decoded(want) == library.decode(want, skip_special_tokens=False)


def test_no_token_spans_a_cut(own):
    for token in list(own.vocab)[::7]:
        assert len(own.split(own.symbols_of_token(token))) == 1


def test_cuts_are_found(own):
    letters = tuple("qzxjqvkxq")
    assert len(own.split(letters)) > 1
    assert [s for f in own.split(letters) for s in f] == list(letters)


def test_rows(spark, library):
    import hashlib
    import struct
    rows = [(i, t, 1) for i, t in enumerate(texts(2))] + [(7, None, 1), (None, "null id", 2), (7, "same id", 2), (7, "same id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, digests(docs, PATH).collect()), key=key) == sorted(want, key=key)
    back = decoded(encoded(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted(
        (i or -1, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t, _ in rows)
    assert digests(docs.limit(0), PATH).count() == 0

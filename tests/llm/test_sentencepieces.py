"""Encoding by backtracking against the sentencepiece library."""

import hashlib
import random
import time

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from promptmill.llm.sentencepieces import PieceModel, decoded, digests, encoded, pieces_of  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "abcdefghij ABC  \n\t▁éß日本語😀<s></s><unk>0x0A한국어ا\x00\x01aeiou,.!?%%%​�"
HARD = ["", " ", "  ", "\n", " a", "▁", "a▁b", "<s>", "<0x0A>", "�", "x" * 3000, "ab" * 2000, "日本" * 900, " " * 500]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as file:
        return PieceModel(file.read())


def texts(seed):
    rng = random.Random(seed)
    spaces = [f"x{' ' * n}y" for n in range(70)] + ["a" * n for n in range(70)]
    return HARD + spaces + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]


def test_equals_the_library(own, library):
    for text in texts(1):
        want = library.encode(text)
        assert own.encode(text) == want, text
        assert own.decode(want) == library.decode(want), text


def test_without_cutting_words(own, library):
    with open(PATH, "rb") as file:
        uncut = PieceModel(file.read())
    uncut.cut_words = False
    for text in texts(2)[::5]:
        assert uncut.encode(text) == library.encode(text), text


def test_any_ids_decode_alike(own, library):
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(259) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_steps_back_and_marks_places(own):
    """The longest piece is not always part of the encoding."""
    stepped = [w for w in ("▁thathe", "▁oucheaué", "▁inthedstsh", "▁anderbleinea", "▁osgagaque") if own.known(w)[0] != max(
        (w[:n] for n in range(1, len(w) + 1) if w[:n] in own.shorter), key=len)]
    assert stepped
    for word in stepped:
        assert own.known(word) == own.merged(word)


def test_a_very_long_word_takes_linear_time(own):
    def took(n):
        word = "".join(random.Random(n).choice("thearonsic") for _ in range(n))
        own.compatible.clear()
        began = time.perf_counter()
        assert "".join(own.known(word)) == word
        return time.perf_counter() - began
    took(20_000)
    assert took(400_000) < 40 * max(took(40_000), 0.05)


def test_rows(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(texts(4)[:400])] + [(7, None, 1), (None, "null id", 2), (7, "same id", 2), (7, "same id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, digests(docs, PATH).collect()), key=key) == sorted(want, key=key)
    back = decoded(encoded(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, library.decode(library.encode(t or ""))) for i, t, _ in rows)
    assert digests(docs.limit(0), PATH).count() == 0


def test_other_models_are_refused():
    with open(PATH, "rb") as file:
        assert len(pieces_of(file.read())) == 32000
    with pytest.raises(ValueError):
        pieces_of(b"")


def test_tasks_of_a_worker_share_a_model(own):
    """The model is built once a process, not once a task; another file gets its own."""
    from promptmill.llm import sentencepieces
    with open(PATH, "rb") as file:
        data = file.read()
    first, second = sentencepieces._opened(data)(), sentencepieces._opened(bytes(bytearray(data)))()
    assert first is second and first.encode("a shared word") == own.encode("a shared word")
    assert "▁shared" in second.words
    # An unknown field at the end of the file changes nothing but the bytes.
    assert sentencepieces._opened(data + b"\x98\x06\x00")() is not first

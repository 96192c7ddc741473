"""Exact encoding with a merge-type piece model by backtracking, and decoding.

Such a model merges the neighbours whose joint piece has the highest score, leftmost first, until no joint piece is left.
A sequence of pieces is what it gives exactly if each piece merges to itself and every two neighbours, merged
again from their letters, come out as these two. So a text is encoded from left to right: at each place
the longest piece (found by Aho-Corasick) is tried first, then shorter ones; a piece is taken if it is
compatible with the one before; a place from which none goes on is marked in a bitfield, and the
encoder steps back. Any reached place has one way to it, so a marked place never needs another visit.

Letters that no piece holds never merge: they stand for themselves and become bytes. A mark of white space after
another letter is never inside a piece where the vocabulary has none such; there texts are cut into
words, which are encoded once a worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.common import Memo, mapped

SPACE = "▁"
#: Words, and pairs of pieces, that a worker remembers; others are worked out anew, never left out.
HELD = 400_000
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = varint() if wire == 2 else 8 if wire == 1 else 4
        yield key >> 3, data[at:at + size]
        at += size


def pieces_of(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) in order of ids. Models are refused whose text rules are others than those built here."""
    import struct
    found = []
    trainer, normalizer = {}, {}
    for number, value in fields(data):
        if number == 1:
            told = dict(fields(value))
            found.append((told[1].decode(), struct.unpack("<f", told.get(2, b"\0\0\0\0"))[0], told.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normalizer = dict(fields(value))
    merges, fallback, suffixed = trainer.get(3) == 2, trainer.get(35), trainer.get(24)
    if not merges or not fallback or suffixed or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("a merge model with byte fallback, identity rules and a leading space is needed")
    if any(kind in (DEFINED, UNUSED) for _, _, kind in found):
        raise ValueError("pieces defined by the user or out of use are not supported")
    return found


class PieceModel:
    """Ids of texts, and texts of ids."""

    def __init__(self, data: bytes):
        import ahocorasick
        listed = pieces_of(data)
        self.ids = {p: i for i, (p, _, kind) in enumerate(listed) if kind == NORMAL}
        self.scores = {p: score for p, score, kind in listed if kind == NORMAL}
        self.bytes = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(listed) if kind == BYTE}
        #: What an id decodes to: a text, or one byte.
        self.spelled = [p.replace(SPACE, " ") if kind == NORMAL else bytes([int(p[3:-1], 16)]) if kind == BYTE
                        else " ⁇ " if kind == UNKNOWN else "" for p, _, kind in listed]
        self.leading = [kind == NORMAL and p.startswith(SPACE) for p, _, kind in listed]
        self.longest = max(map(len, self.ids), default=0)
        # A letter that only longer pieces hold is a symbol too, without an id of its own.
        self.letters = {c for p in self.ids for c in p}
        #: Pieces that merge to themselves; others are never the outcome of a merge.
        self.found = ahocorasick.Automaton()
        self.shorter: dict[str, str | None] = {}
        whole = {c for c in self.letters} | {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        for piece in whole:
            self.found.add_word(piece, piece)
        self.found.make_automaton()
        for piece in whole:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in whole), None)
        self.cut_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.compatible: Memo = Memo(self._compatible, HELD)
        self.words: Memo = Memo(self._word, HELD)

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text of letters that pieces hold."""
        symbols, score = list(text), self.scores.get
        gains = [score(a + b) for a, b in zip(symbols, symbols[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, gain in enumerate(gains):
                if gain is not None and (best is None or gain > best):
                    best, at = gain, i
            if at < 0:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score(symbols[at - 1] + symbols[at])
            if at < len(gains):
                gains[at] = score(symbols[at] + symbols[at + 1])

    def _compatible(self, pair: tuple[str, str]) -> bool:
        return self.merged(pair[0] + pair[1]) == [*pair]

    def known(self, text: str) -> list[str]:
        """The pieces of a text all of whose letters are held by pieces."""
        size = len(text)
        if size == 1 or (size <= self.longest and text in self.shorter):
            return [text]
        longest = [""] * size
        for end, piece in self.found.iter(text):
            # Ends rise, so what stays at a place is the longest piece from there.
            longest[end + 1 - len(piece)] = piece
        failed, any_failed, shorter, fits = bytearray(size // 8 + 1), False, self.shorter, self.compatible
        taken: list[str] = []
        at, before, piece = 0, None, longest[0]
        while True:
            while piece is not None:
                end = at + len(piece)
                if not (any_failed and failed[end >> 3] & 1 << (end & 7)) and (before is None or fits[before, piece]):
                    break
                piece = shorter[piece]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                piece = taken.pop()
                at -= len(piece)
                before = taken[-1] if taken else None
                piece = shorter[piece]
                continue
            taken.append(piece)
            if end == size:
                return taken
            at, before, piece = end, piece, longest[end]

    def _word(self, word: str) -> tuple[tuple[int, ...], str, str]:
        """Ids of a word, the same as decimal numbers joined by commas, and what they decode to with its leading space.

        A word's bytes are whole letters, so words decode each for itself.
        """
        ids: list[int] = []
        lo = 0
        if not self.letters.issuperset(word):
            for at, letter in enumerate(word):
                if letter not in self.letters:
                    if at > lo:
                        ids += self._ids(self.known(word[lo:at]))
                    ids += [self.bytes[b] for b in letter.encode()]
                    lo = at + 1
        if lo < len(word):
            ids += self._ids(self.known(word[lo:] if lo else word))
        return tuple(ids), ",".join(map(str, ids)), self._text(ids)

    def _text(self, ids: Iterable[int]) -> str:
        spelled, out, run = self.spelled, [], b""
        for i in ids:
            piece = spelled[i]
            if isinstance(piece, bytes):
                run += piece
                continue
            if run:
                out.append(letters_of(run))
                run = b""
            out.append(piece)
        return "".join(out) + (letters_of(run) if run else "")

    def _ids(self, taken: list[str]) -> list[int]:
        out = []
        for piece in taken:
            i = self.ids.get(piece)
            out += [i] if i is not None else [self.bytes[b] for b in piece.encode()]
        return out

    def encoded(self, text: str) -> list[tuple[tuple[int, ...], str, str]]:
        """The words of a whole text, in order."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        words = self.words
        return [words[w] for w in (_MARKED.findall(marked) if self.cut_words else [marked])]

    def encode(self, text: str) -> list[int]:
        return [i for word in self.encoded(text) for i in word[0]]

    def decode(self, ids: list[int]) -> str:
        """Pieces put together, the leading space taken off; bytes that are no letter become U+FFFD each."""
        text = self._text(ids)
        first = next((i for i in ids if self.spelled[i]), None)
        return text[1:] if first is not None and self.leading[first] else text


#: Marks of white space and what follows them.
_MARKED = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def letters_of(data: bytes) -> str:
    """UTF-8, each byte that is no part of a letter as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return "".join("�" if "\udc80" <= c <= "\udcff" else c for c in data.decode(errors="surrogateescape"))


@lru_cache(maxsize=1)
def _held(data: bytes) -> PieceModel:
    """The model of a process: tasks that a worker runs one after the other share it, and the words it remembers."""
    return PieceModel(data)


def _opened(data: bytes) -> Callable[[], PieceModel]:
    held: list[PieceModel] = []

    def get() -> PieceModel:
        if not held:
            held.append(_held(data))
        return held[0]

    return get


def _model(path: str) -> bytes:
    with open(path, "rb") as file:  # a parameter of the job, read by the driver
        return file.read()


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): every whole text as ids of pieces, without ids of begin or end.

    ``path`` names a model file that the driver can read; it goes to executors as part of the task (less than 1 MB).
    Null and empty texts have no ids. Every row is encoded, repeated or not; null ids stay null; other columns are not read.
    A text is cut into words where no piece can cross; one very long word takes memory and time in proportion to its length.
    """
    get = _opened(_model(path))

    def piece(columns):
        return columns[0], [get().encode(t.decode()) if t else [] for t in columns[1]]

    return mapped(docs.select(F.col(id_column).cast("long"), F.col(text_column)), piece, "doc_id long, ids array<int>")


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null lists decode to an empty text, ids of begin and end to nothing."""
    get = _opened(_model(path))
    return mapped(encodings.select("doc_id", "ids"), lambda c: (c[0], [get().decode(i or []) for i in c[1]]), "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded in one pass."""
    get = _opened(_model(path))

    def piece(columns):
        n, of_ids, of_text = [], [], []
        for text in columns[1]:
            words = get().encoded(text.decode()) if text else []
            n.append(sum([len(w[0]) for w in words]))
            of_ids.append(hashlib.sha256(",".join([w[1] for w in words]).encode()).hexdigest())
            # The leading space is not part of the text.
            of_text.append(hashlib.sha256("".join([w[2] for w in words])[1:].encode()).hexdigest())
        return columns[0], n, of_ids, of_text

    return mapped(docs.select(F.col(id_column).cast("long"), F.col(text_column)), piece,
                  "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""BPE encoding by forced boundaries, and decoding.

Two symbols (bytes, the last of a word with its end mark) that stand side by side inside no token
of the vocabulary can never be merged across, so the place between them is a cut in every
encoding. Words are split at these cuts, the fragments encoded on their own (each distinct one
once per task) and their ids put together again.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import struct
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.common import Memo, mapped


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 as itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


def _lowered(text: str) -> str:
    """Lower case letter by letter: no letter depends on its neighbours."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


#: Texts with letters from here on are composed, lowered and cut into words by the tokenizers library,
#: whose tables of letters may be of another year than Python's.
RARE = "\u0500"
#: Words that a task remembers; others are encoded anew.
HELD_WORDS = 400_000
#: Symbols of a fragment from which merges go through a heap.
LONG_FRAGMENT = 64


class Tokenizer:
    """A tokenizer file of words with an end mark: composed and lowered text, words by its pattern, byte letters."""

    def __init__(self, source: str):
        import regex
        import tokenizers
        spec = json.loads(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Of two tokens, as one number: rank of their merge, and the token it makes.
        self.shift = max(self.vocab.values()).bit_length()
        self.ranks = {self.vocab[a] << self.shift | self.vocab[b]: k for k, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        cut = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or cut["behavior"] != "Removed" or not cut["invert"] or model.get("byte_fallback"):
            raise ValueError("a word BPE file with an end mark is needed")
        self.words = regex.compile(cut["pattern"]["Regex"], regex.V1).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        #: Symbol pairs that stand side by side inside some token.
        self.inside = {pair for token in self.vocab for s in [self.symbols_of_token(token)] for pair in zip(s, s[1:], strict=False)}
        #: The same by ids, with the rank of the pair's merge (or none), and ids of each byte inside a word and at its end.
        self.starts = {self.vocab[a] << self.shift | self.vocab[b]: self.ranks.get(self.vocab[a] << self.shift | self.vocab[b], len(merges))
                       for a, b in self.inside if a in self.vocab and b in self.vocab}
        self.first, self.last = ([self.vocab.get(self.letters[b] + end) for b in range(256)] for end in ("", self.end))
        self.byte = {letter: b for b, letter in self.letters.items()}
        # An id in four little-endian bytes, and what it decodes to.
        self.packed = {i: struct.pack("<I", i) for i in self.tokens}
        self.shown = {i: t.encode() for i, t in self.tokens.items()}
        self.fragments: Memo = Memo(self._encode_fragment)
        self.pieces: Memo = Memo(self._encode_word, HELD_WORDS)
        self.spelled: Memo = Memo(self._encode_letters)
        self.rare = tokenizers.Tokenizer.from_str(source)

    def symbols_of_token(self, token: str) -> tuple[str, ...]:
        if token.endswith(self.end) and len(token) > len(self.end):
            bare = token[:-len(self.end)]
            return (*bare[:-1], bare[-1] + self.end)
        return tuple(token)

    def split(self, symbols: tuple[str, ...]) -> list[tuple[str, ...]]:
        """Fragments between forced boundaries."""
        cuts = [0, *(i + 1 for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair not in self.inside), len(symbols)]
        return [symbols[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _encode_fragment(self, ids: tuple[int, ...]) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        return self._merged([*ids], [self.starts.get(a << self.shift | b, len(self.made)) for a, b in itertools.pairwise(ids)])

    def _merged(self, ids: list[int], ranks: list[int]) -> list[int]:
        if len(ids) > LONG_FRAGMENT:
            return self._encode_long(ids)
        rank, made, none, shift = self.ranks.get, self.made, len(self.made), self.shift
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            new = ids[i] = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << shift | new, none)
            if i < len(ranks):
                ranks[i] = rank(new << shift | ids[i + 1], none)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, so that time grows with the length and not with its square."""
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.ranks.get(a << self.shift | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or self.ranks.get(ids[i] << self.shift | ids[j]) != rank:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.ranks.get(ids[k] << self.shift | ids[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
        return [i for i in ids if i >= 0]

    def _encode_bytes(self, data: bytes) -> tuple[int, bytes, bytes]:
        """Number of tokens of a word, their ids in four little-endian bytes each, their decoded text."""
        first, shift, start = self.first, self.shift, self.starts.get
        ids = [first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if None in ids:
            # Symbols without a token are left out once they have cut the word.
            symbols = [self.letters[b] for b in data]
            symbols[-1] += self.end
            ids = [i for part in self.split(tuple(symbols)) for i in self.fragments[tuple([self.vocab[s] for s in part if s in self.vocab])]]
        else:
            # Ranks of the neighbours' merges; forced boundaries have none at all.
            ranks = [start(a << shift | b, -1) for a, b in itertools.pairwise(ids)]
            if -1 in ranks:
                cuts = [0, *(k + 1 for k, r in enumerate(ranks) if r < 0), len(ids)]
                ids = [i for lo, hi in itertools.pairwise(cuts) for i in self.fragments[tuple(ids[lo:hi])]]
            else:
                ids = self._merged(ids, ranks)
        packed, shown = self.packed, self.shown
        return len(ids), b"".join([packed[i] for i in ids]), b" ".join([shown[i] for i in ids])

    def _encode_letters(self, letters: str) -> tuple[int, bytes, bytes]:
        return self._encode_bytes(bytes([self.byte[c] for c in letters]))

    def _encode_word(self, word: str) -> tuple[int, bytes, bytes]:
        return self._encode_bytes(word.encode())

    def encoded(self, text: str) -> list[tuple[int, bytes, bytes]]:
        """The pieces of a whole text in order, words without a token left out."""
        parts = self.specials.split(text) if self.specials and "<" in text else [text]
        out = []
        for part in parts:
            if part in self.special:
                i = self.special[part]
                out.append((1, struct.pack("<I", i), part.encode()))
            elif part and max(part) >= RARE:
                out += [self.spelled[w] for w, _ in self.rare.pre_tokenizer.pre_tokenize_str(self.rare.normalizer.normalize_str(part))]
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part)
                pieces = self.pieces
                out += [pieces[w] for w in self.words(_lowered(part))]
        return [p for p in out if p[0]]

    def encode(self, text: str) -> list[int]:
        joined = b"".join(p[1] for p in self.encoded(text))
        return list(struct.unpack(f"<{len(joined) // 4}I", joined))

    def decoded(self, ids: list[int]) -> str:
        """Tokens joined by one space; the file names no decoder that would undo byte letters."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def _opened(source: str) -> Callable[[], Tokenizer]:
    held: list[Tokenizer] = []

    def get() -> Tokenizer:
        if not held:
            held.append(Tokenizer(source))
        return held[0]

    return get


def _source(path: str) -> str:
    with open(path, encoding="utf-8") as file:  # a parameter of the job, read by the driver
        return file.read()


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, *keep): every whole text as token ids.

    ``path`` names a tokenizer file that the driver can read; it goes to executors as part of the
    task (less than 2 MB). Null and empty texts have no ids. Every row is encoded, repeated or not;
    null ids stay null; string columns in ``keep`` go along, others are ignored.
    """
    get = _opened(_source(path))

    def piece(columns):
        ids, texts, *others = columns
        return ids, [get().encode(t.decode()) if t else [] for t in texts], *others

    carried = [f"_c{k}" for k in range(len(keep))]
    out = mapped(docs.select(F.col(id_column).cast("long"), F.col(text_column), *(F.col(c).alias(a) for c, a in zip(keep, carried, strict=True))),
                 piece, ", ".join(["doc_id long, ids array<int>", *(f"{c} string" for c in carried)]))
    return out.withColumnsRenamed(dict(zip(carried, keep, strict=True)))


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null lists decode to an empty text, ids outside the vocabulary to nothing."""
    get = _opened(_source(path))
    return mapped(encodings.select("doc_id", "ids"), lambda c: (c[0], [get().decoded(i or []) for i in c[1]]),
                  "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded in one pass."""
    get = _opened(_source(path))

    def piece(columns):
        ids, texts = columns
        n, of_ids, of_text = [], [], []
        for text in texts:
            pieces = get().encoded(text.decode()) if text else []
            n.append(sum(p[0] for p in pieces))
            of_ids.append(hashlib.sha256(b"".join([p[1] for p in pieces])).hexdigest())
            of_text.append(hashlib.sha256(b" ".join([p[2] for p in pieces])).hexdigest())
        return ids, n, of_ids, of_text

    return mapped(docs.select(F.col(id_column).cast("long"), F.col(text_column)), piece,
                  "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Byte-level BPE: exact backtracking encoder and offset-table decoder.

Encoding a pre-token walks it left to right.  An Aho-Corasick automaton over
the vocabulary gives, for each start, the longest token that begins there.  A
token is accepted when it and the token before it are a *compatible pair*,
that is when byte-pair merging of their joined bytes would leave exactly that
boundary.  When it is not compatible the next shorter token is tried, and when
none is left the walk backs up one token and never ends a token at that
position again.  Every position is given up at most once, so the work is
linear, and the result equals merging pairs in rank order.

Text is cut into *chunks* at single spaces that a non-space follows.  The
pre-tokenizer's pattern always ends a pre-token before such a space (the space
belongs to what follows), so chunks can be encoded apart and remembered.  A
text with a chunk that is empty or begins with white space is cut by the
pattern itself instead.  A bounded number of words is remembered, so a worker's
memory is bounded; the results do not depend on it.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

#: Remembered words per Python worker of an encoder that the library's model serves.
CACHE_ENTRIES = 1_200_000
#: Remembered words, and token pairs, where the vocabulary and its automaton are in memory too.
CACHE_BACKTRACKING = 400_000
#: After a word these always make one pre-token.
MARKS = ".,;:!?*#%&$@()[]{}<>/=+-_|~^\""
#: Longest word that is remembered, in characters.
CACHE_WORD = 64

# The byte-level pre-tokenizer's pattern (\s as White_Space).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: the character that stands for each byte.

    Printable bytes stand for themselves, the others in order for 256, 257, ...
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    table.update({chr(256 + i): b for i, b in enumerate(hidden)})
    return table


class Vocabulary:
    """Tokens of a byte-level BPE file: bytes, ranks, splits and offsets."""

    def __init__(self, spec: dict):
        alphabet = byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(alphabet[c] for c in token)

        model = spec["model"]
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.rank: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            left, right = raw(left), raw(right)
            whole = ids[left + right]
            self.merged[ids[left], ids[right]] = rank
            if whole not in self.split:
                self.split[whole] = (ids[left], ids[right])
                self.rank[whole] = rank
        size = max([*ids.values(), *self.special.values()]) + 1
        pieces: list[bytes] = [b""] * size
        for token, i in ids.items():
            pieces[i] = token
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.pieces = pieces
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.decimal = [str(i) for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        reachable = set(self.split) | {i for t, i in ids.items() if len(t) == 1}
        self.length = {i: len(t) for t, i in ids.items()}
        for token, i in ids.items():
            if i in reachable:
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = {i: self._shorter(t, ids, reachable) for t, i in ids.items()}
        self.compatible: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _shorter(token: bytes, ids: dict[bytes, int], reachable: set[int]) -> int | None:
        for n in range(len(token) - 1, 0, -1):
            if (i := ids.get(token[:n])) is not None and i in reachable:
                return i
        return None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps a boundary between the two tokens.

        Undoes the later of the two merges step by step; if a pair across the
        boundary could have merged before the merge that was undone, the
        boundary would not be there.  Equal ranks: the left merge comes first.
        """
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= CACHE_BACKTRACKING:
                self.compatible.clear()
            known = self.compatible[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        rank, split, merged = self.rank, self.split, self.merged
        limit = float("inf")  # a pair across blocks if its rank is below this
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            r_left, r_right = rank.get(left, -1), rank.get(right, -1)
            if r_left > r_right:
                limit, left = r_left, split[left][1]
            elif r_right >= 0:
                limit, right = r_right + 1, split[right][0]  # of equal pairs the left one merges first
            else:
                return True

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as its UTF-8 bytes read as Latin-1."""
        n = len(piece)
        if not n:
            return []
        longest = self.automaton.iter_long  # every byte is a token: the first match starts where asked
        length, shorter, fits = self.length, self.shorter, self.fits
        may_end = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, next(longest(piece, 0))[1]
        while True:
            end = at + length[token]
            if may_end[end] and (not out or fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, next(longest(piece, end))[1]
                continue
            smaller = shorter[token]
            if smaller is not None:
                token = smaller
                continue
            may_end[at] = 0
            token = out.pop()
            at -= length[token]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of ids, by the offset table."""
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


class _Uneven(Exception):
    """A chunk that cannot be told apart from the white space before it."""


class _Words(dict):
    """Chunk after a space -> its ids as bytes.

    Only words (letters alone) are remembered, in two generations: when the
    younger is full it becomes the older, and what is asked for again moves
    back.  Other chunks are put together from their words and marks.
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if chunk.isalpha():
                ids = self.encoder.ids(" " + chunk)
            elif not chunk or chunk[0].isspace():
                raise _Uneven
            else:
                word = chunk.rstrip(MARKS)
                if word.isalpha():
                    return self[word] + self.encoder.piece(chunk[len(word) :])
                before, line, after = chunk.partition("\n")
                if after and "\n" not in after:
                    a, b = before.rstrip(MARKS), after.rstrip(MARKS)
                    if a.isalpha() and b.isalpha():
                        piece = self.encoder.piece
                        return b"".join((self[a], piece(before[len(a) :]), piece(line), piece(b), piece(after[len(b) :])))
                return self.encoder.pieces(" " + chunk)
        if len(chunk) <= CACHE_WORD:
            if len(self) >= self.encoder.entries // 2:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Whole texts to ids.  ``piece_ids`` encodes one pre-token; ``entries`` words are remembered."""

    def __init__(self, size: int, special: dict[str, int], piece_ids, entries: int = CACHE_ENTRIES):
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special, self.piece_ids, self.entries = special, piece_ids, entries
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.words, self.marks = _Words(self), {}

    def ids(self, piece: str) -> bytes:
        return np.asarray(self.piece_ids(piece), self.dtype).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a pre-token."""
        if piece[:1] == " " and piece[1:].isalpha():
            return self.words[piece[1:]]
        ids = self.marks.get(piece)
        if ids is None:
            ids = self.ids(piece)
            if len(self.marks) >= self.entries // 8:
                self.marks.clear()
            if len(piece) <= CACHE_WORD:
                self.marks[piece] = ids
        return ids

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.find(text)))

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return self.pieces(first) + b"".join(map(self.words.__getitem__, rest))
        except _Uneven:
            return self.pieces(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian integers of ``dtype``; null and empty: none."""
        if not text:
            return b""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for part in self.cut(text):
            known = self.special.get(part)
            out.append(self._plain(part) if known is None else np.asarray([known], self.dtype).tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


@lru_cache(maxsize=2)
def backtracking_encoder(path: str) -> Encoder:
    """Encoder by compatible longest matches (one per worker and file)."""
    v = vocabulary(path)
    return Encoder(len(v.pieces), v.special, lambda piece: v.encode_piece(piece.encode().decode("latin-1")), CACHE_BACKTRACKING)


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """Encoder whose pre-tokens the tokenizers library's model encodes."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    shown = {byte: char for char, byte in byte_alphabet().items()}
    table = {byte: shown[byte] for byte in range(256)}
    special = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
    merge = t.model.tokenize
    return Encoder(
        t.get_vocab_size(with_added_tokens=True),
        special,
        lambda piece: [x.id for x in merge(piece.encode().decode("latin-1").translate(table))],
    )


@lru_cache(maxsize=2)
def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)

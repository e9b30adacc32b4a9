"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of its bytes exactly if each two neighbours are,
as no merge then crosses a border. So encoding is a walk over all ways to cut the bytes
into tokens with allowed neighbours: a nondeterministic transducer whose paths end in
one complete cut at every byte. Its determinised states are sets of paths; what all
paths of a state agree on is emitted, so output lags behind input only by as many
bytes as the longest token has. States and arcs are built when first met and kept.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import regex

#: Folder of the vocabulary files; see ``tokenizer_path``.
TOKENIZER_DIR = os.environ.get("LOOMDEX_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: States kept at most; the walk starts over with an empty table beyond it.
STATES_KEPT = 250_000
#: Pieces of text whose tokens are remembered, and the longest such piece.
PIECES_KEPT, PIECE_LENGTH = 300_000, 48

Path = tuple[tuple[int, ...], int]


def tokenizer_path(name: str) -> str:
    """Full path of a vocabulary file, given by name or by path."""
    return name if os.path.isabs(name) else os.path.join(TOKENIZER_DIR, name)


def byte_alphabet() -> dict[str, int]:
    """Byte of each letter of the vocabulary file: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class Vocabulary:
    """Tokens of a merge table: their bytes, their parts, and which may be neighbours."""

    def __init__(self, file: str) -> None:
        with open(tokenizer_path(file), encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, ids = byte_alphabet(), model["vocab"]
        made = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for n, (left, right) in enumerate(made):
            token, pair = ids[left + right], (ids[left], ids[right])
            self.merged[pair] = n
            if token not in self.parts:
                self.rank[token], self.parts[token] = n, pair
        self.bytes: dict[int, bytes] = {}
        for text, i in ids.items():
            if i in self.parts or len(text) == 1:
                self.bytes[i] = bytes(letters[c] for c in text)
        # A trie over the tokens' bytes: arcs per node, and the token that ends at a node.
        self.arcs: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for i, data in self.bytes.items():
            node = 0
            for b in data:
                if b not in self.arcs[node]:
                    self.arcs[node][b] = len(self.arcs)
                    self.arcs.append({})
                    self.token.append(None)
                node = self.arcs[node][b]
            self.token[node] = i
        self._whole: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The pieces that lie at one side of ``token`` while it is being merged: (piece, from rank, until rank)."""
        spine, until = [], float("inf")
        while True:
            born = self.rank.get(token, -1)
            spine.append((token, born, until))
            if token not in self.parts:
                return spine
            token, until = self.parts[token][side], born

    @lru_cache(maxsize=500_000)  # noqa: B019
    def neighbours(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together are encoded as just these tokens.

        Two pieces at the border merge if their merge comes before either grows within
        its own token; of equal merges the one further left comes first.
        """
        for a, a_from, a_until in self._edge(left, 1):
            for b, b_from, b_until in self._edge(right, 0):
                if a_from >= b_until or b_from >= a_until:
                    continue
                cross = self.merged.get((a, b))
                if cross is not None and cross < a_until and cross <= b_until:
                    return False
        return True


class Transducer:
    """The lazily determinised transducer of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset[Path], int] = {}
        self.paths: list[frozenset[Path]] = []
        self.next: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.last: list[tuple[int, ...]] = []
        self._state(frozenset({((), 0)}))

    def _state(self, paths: frozenset[Path]) -> int:
        number = self.numbers.get(paths)
        if number is None:
            number = self.numbers[paths] = len(self.paths)
            self.paths.append(paths)
            self.next.append({})
            self.last.append(next((tokens for tokens, node in paths if node == 0), ()))
        return number

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Build the arc of ``byte``: the new state and the tokens that are now certain."""
        v, found = self.vocabulary, set()
        for tokens, node in self.paths[state]:
            child = v.arcs[node].get(byte)
            if child is None:
                continue
            token = v.token[child]
            if token is not None and (not tokens or v.neighbours(tokens[-1], token)):
                found.add((tokens + (token,), 0))
            if v.arcs[child]:
                found.add((tokens, child))
        sure = 0
        first = next(iter(found))[0]
        # The last token of a path stays, since it decides which tokens may follow.
        while all(len(t) > sure + 1 and t[sure] == first[sure] for t, _ in found):
            sure += 1
        arc = (self._state(frozenset((t[sure:], n) for t, n in found)), first[:sure])
        self.next[state][byte] = arc
        return arc

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Tokens of the bytes of one piece of text."""
        if len(self.paths) > STATES_KEPT:
            self._reset()
        out: list[int] = []
        state, arcs = 0, self.next
        for byte in data:
            arc = arcs[state].get(byte) or self._arc(state, byte)
            state = arc[0]
            if arc[1]:
                out += arc[1]
        return (*out, *self.last[state])


class Encoder(dict):
    """Encodes texts; remembers the tokens of short pieces, as a dict from piece to tokens."""

    def __init__(self, file: str) -> None:
        super().__init__()
        self.vocabulary = Vocabulary(file)
        self.transducer = Transducer(self.vocabulary)
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        tokens = self.transducer.encode(piece.encode())
        if len(piece) <= PIECE_LENGTH:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = tokens
        return tokens

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; none for null and empty texts."""
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        return sum(map(len, map(self.__getitem__, self.split(text)))) if text else 0


@lru_cache(maxsize=4)
def encoder(file: str) -> Encoder:
    """The encoder of a vocabulary file, kept for the life of a Python worker."""
    return Encoder(file)


class Utf8Machine:
    """Incremental UTF-8: takes bytes in any portions and gives the characters that are complete.

    The state is the number of bytes still missing, the range allowed for the next one,
    and the bits so far. A byte that can't follow gives U+FFFD for what came before and
    is looked at anew.
    """

    def __init__(self) -> None:
        self.missing, self.low, self.high, self.bits = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.missing:
                if self.low <= byte <= self.high:
                    self.bits, self.missing = self.bits << 6 | byte & 0x3F, self.missing - 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.bits))
                    continue
                out.append("�")
                self.missing, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.missing, self.bits = 1, byte & 0x1F
            elif 0xE0 <= byte <= 0xEF:
                self.missing, self.bits = 2, byte & 0x0F
                self.low, self.high = 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                self.missing, self.bits = 3, byte & 0x07
                self.low, self.high = 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """U+FFFD if the input stopped within a character."""
        cut, self.missing = "�" if self.missing else "", 0
        self.low, self.high = 0x80, 0xBF
        return cut


def decode(file: str, ids: Iterable[int]) -> str:
    """Text of ids, decoded as a stream: tokens may end within a character."""
    names, machine = encoder(file).vocabulary.bytes, Utf8Machine()
    return "".join(chain((machine.feed(names[i]) for i in ids), (machine.end(),)))

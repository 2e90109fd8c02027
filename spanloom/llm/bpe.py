"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece there is exactly one token that can stand last in the prefix's encoding: the token that ends
there, and that the merges would not have joined or split differently together with the last token of what precedes it.
Storing that token per prefix gives the encoding by walking back, makes appends exact (older entries never change) and
lets an edit re-encode only from the edited place until old and new entries agree again.
"""

from __future__ import annotations

import base64
import re
from array import array

import regex

#: The split of byte_bpe_50k, and the same split for texts of ASCII characters only.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""


def _ranges(property_: str) -> str:
    """The characters below U+10000 with a property, as ranges of a character class."""
    match, out, start = regex.compile(property_).match, [], None
    for c in range(0x10001):
        has = c < 0x10000 and not 0xD800 <= c < 0xE000 and match(chr(c)) is not None
        if has and start is None:
            start = c
        elif not has and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


def _plane_pattern() -> str:
    """PATTERN for texts below U+10000, in a form that the standard library matches by table lookup."""
    letters, numbers, spaces = (_ranges(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"


DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary is sent to every executor, so its file's size is checked.
MAX_VOCABULARY_BYTES = 32 << 20
#: Pieces kept by a worker; a full cache is emptied, which changes no result.
CACHE_PIECES = 400_000


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: larger than {MAX_VOCABULARY_BYTES} bytes")
    return raw


class Vocabulary:
    """Ranks, the two halves of each token, and which neighbours the merges leave alone."""

    def __init__(self, raw: bytes) -> None:
        self.ranks: dict[bytes, int] = {}
        for line in raw.splitlines():
            if line:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {r: b for b, r in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        #: Every beginning of a token -> the token that it is, or -1.
        self.starts: dict[bytes, int] = {}
        for b in self.ranks:
            for k in range(1, len(b)):
                self.starts.setdefault(b[:k], -1)
        self.starts |= self.ranks
        self._halves: dict[int, tuple[int, int]] = {}
        self._valid: dict[tuple[int, int], bool] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; a single byte is its own halves."""
        got = self._halves.get(token)
        if got is None:
            parts = [self.ranks[bytes([b])] for b in self.tokens[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(self.tokens[parts[i]] + self.tokens[parts[i + 1]], 1 << 60))
                parts[best : best + 2] = [self.ranks[self.tokens[parts[best]] + self.tokens[parts[best + 1]]]]
            got = self._halves[token] = (parts[0], parts[-1])
        return got

    def neighbours(self, left: int, right: int) -> bool:
        """Whether encoding ``left + right`` gives these two tokens again."""
        key = (left, right)
        got = self._valid.get(key)
        if got is None:
            if len(self._valid) > 1_000_000:
                self._valid.clear()
            got = self._valid[key] = self._unmerged(left, right)
        return got

    def _unmerged(self, left: int, right: int) -> bool:
        # Undo the merges of both sides, latest first; a merge across the border that comes earlier than the one just undone would have won.
        ranks, tokens, known = self.ranks, self.tokens, self._halves
        bound = 1 << 60
        while True:
            if ranks.get(tokens[left] + tokens[right], bound) < bound:
                return False
            a, b = known.get(left) or self.halves(left), known.get(right) or self.halves(right)
            if a[0] != left and (left > right or b[0] == right):
                bound, left = left, a[1]
            elif b[0] != right:
                bound, right = right + 1, b[0]
            else:
                return True

    def extend(self, data: bytes, last: list[int] | array, start: int) -> None:
        """Fill ``last[i]`` for the prefixes that end after ``start``; entries up to ``start`` are given."""
        # Tokens are pushed forward from every place along the prefixes that any token has, so random text costs a few look-ups a byte.
        starts, valid, unmerged = self.starts, self._valid, self.neighbours
        n = len(data)
        for j in range(max(0, start - self.longest + 1), n):
            left, end = last[j], j + 1
            token = starts.get(data[j:end])
            while token is not None:
                if token >= 0 and end > start and last[end] < 0:
                    if j == 0:
                        last[end] = token
                    else:
                        ok = valid.get((left, token))
                        if ok or ok is None and unmerged(left, token):
                            last[end] = token
                if end == n:
                    break
                end += 1
                token = starts.get(data[j:end])

    def walk(self, last: list[int] | array, end: int) -> list[int]:
        ids = []
        while end > 0:
            ids.append(last[end])
            end -= len(self.tokens[last[end]])
        ids.reverse()
        return ids

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last = [-1] * (len(data) + 1)
        self.extend(data, last, 0)
        return self.walk(last, len(data))


class _Pieces(dict):
    """Piece of text -> its ids as packed integers."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.vocabulary.piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(self) >= CACHE_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """Texts to ids. Special tokens' strings are ordinary text; null and empty texts have no ids."""

    def __init__(self, raw: bytes) -> None:
        self.vocabulary = Vocabulary(raw)
        self._pieces = _Pieces(self.vocabulary)
        self._ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self._plane = re.compile(_plane_pattern()).findall
        self._any = regex.compile(PATTERN).findall
        self._beyond = re.compile("[\U00010000-\U0010ffff]").search

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self._ascii(text)
        return (self._any if self._beyond(text) else self._plane)(text)

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self._pieces.__getitem__, self.split(text)))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def count(self, text: str | None) -> int:
        return len(self.packed(text)) // 4

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.vocabulary.tokens[i] for i in ids)


class EditableEncoding:
    """The encoding of one text under appends and replacements, recomputed only near the change.

    Pieces before a change keep their tables as long as the split agrees; a changed piece keeps the entries of the prefix
    that it shares with its older form.
    """

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder, self.text = encoder, ""
        self.pieces: list[str] = []
        self.tables: list[array] = []
        self.computed = 0  # prefixes filled so far
        self.append(text)

    def ids(self) -> list[int]:
        walk = self.encoder.vocabulary.walk
        return [t for last in self.tables for t in walk(last, len(last) - 1)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, by: str) -> None:
        text = self.text[:start] + by + self.text[end:]
        # A piece depends on its own characters and on the one behind it: pieces that end two characters before the change stay.
        keep, at = 0, 0
        while keep < len(self.pieces) and at + len(self.pieces[keep]) + 2 <= start:
            at += len(self.pieces[keep])
            keep += 1
        if keep:  # spaces before the kept border may join the next piece
            keep -= 1
            at -= len(self.pieces[keep])
        old, tables = self.pieces[keep:], self.tables[keep:]
        ends, pos = {}, at  # border in the new text -> index of the old piece that starts there
        for k, piece in enumerate(old):
            if pos >= end:
                ends[pos - end + start + len(by)] = k
            pos += len(piece)
        new_pieces, new_tables, pos = [], [], at
        pattern = regex.compile(PATTERN)
        k = 0
        while pos < len(text):
            if pos in ends and pos >= start + len(by):
                new_pieces += old[ends[pos] :]
                new_tables += tables[ends[pos] :]
                break
            piece = pattern.match(text, pos).group()
            new_pieces.append(piece)
            new_tables.append(self._table(piece, old[k] if k < len(old) else "", tables[k] if k < len(old) else None))
            pos += len(piece)
            k += 1
        self.text = text
        self.pieces[keep:], self.tables[keep:] = new_pieces, new_tables

    def _table(self, piece: str, old: str, table: array | None) -> array:
        data, before = piece.encode("utf-8", "surrogatepass"), old.encode("utf-8", "surrogatepass")
        same = 0
        while same < min(len(data), len(before)) and data[same] == before[same]:
            same += 1
        last = array("i", [-1]) * (len(data) + 1)
        if table is not None:
            last[: same + 1] = table[: same + 1]
        self.encoder.vocabulary.extend(data, last, same)
        self.computed += len(data) - same
        return last

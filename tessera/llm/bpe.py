"""BPE encoding and decoding, equal to the tokenizers library's results.

A tokenizer file is read by the library. Its vocabulary also drives a merge table for single pieces, so that the
words of ordinary text (printable ASCII and Latin-1 letters) are looked up in a bounded table of pieces instead of
being merged anew; any other text goes to the library itself. A piece ends where a non-space is followed by a
space: there both kinds of pre-tokenizer always split, so pieces are independent.

Long texts use tree concatenation (byte-level files): halves are encoded in parallel as rows of their own, then
joined pairwise. At each join the tokens next to the cut are encoded again as one window, which grows until it begins
and ends with the tokens that the two sides have there. Then every two neighbours in the joined sequence also stand
side by side in the encoding of a side or of the window; a sequence in which all neighbours can stand side by side is
the encoding of the whole. A join costs its window, with or without white space in the text.

Piece tables are bounded and emptied when a task ends (``Codec.task``).

Defined results: null counts as empty text and has no ids. Texts of any length are encoded whole. Files with an
end-of-word mark are encoded and decoded by words, each text in one task, and decoded by the library.
"""

from __future__ import annotations

import contextlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np

#: At most some 30 MB a worker.
CACHE_PIECES = 150_000
#: Pieces longer than this are not kept in the table; from LONG_PIECE bytes on they are merged as a tree.
CACHE_CHARS = 48
LONG_PIECE = 4096
#: Texts longer than this are cut in halves until no part is longer.
LEAF_CHARS = 16_384
NO_LEAF = (1 << 31) - 1
#: Tokens on each side of a cut that are encoded again first, and how many must be the same on each side.
WINDOW_TOKENS = 24
SAME_TOKENS = 2
_ODD = re.compile(r"[^\t\n\x0b\x0c\r -~¡-¬®-ÿ]")
_SPACED = re.compile(r"\s[ ]|^[ ]|[ ]$")
_BREAK = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def marks_words(path: str) -> bool:
    """Whether a tokenizer file marks ends of words."""
    with open(path, encoding="utf-8") as f:
        return bool(json.load(f)["model"]["end_of_word_suffix"])


class _Pieces(dict):
    """Piece -> ids as little-endian unsigned 32-bit bytes; grows up to a bound."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(self) < self.limit and len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one tokenizer file (byte-level BPE, with or without an end-of-word mark)."""

    _made: dict[str, "Codec"] = {}

    @classmethod
    def of(cls, path: str) -> "Codec":
        """One for each worker process, kept over batches and tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.suffix = model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        end = b"\xff" if self.suffix else b""  # never a byte of UTF-8, so it can stand for the end of a word
        self.of_id: dict[int, bytes] = {}
        ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if token in self.special:
                continue
            whole = bool(self.suffix) and token.endswith(self.suffix)
            raw = bytes(alphabet[c] for c in (token[: -len(self.suffix)] if whole else token))
            self.of_id[i] = raw + (b" " if whole else b"")
            ranks[raw + (end if whole else b"")] = i
        for b in range(256):
            ranks.setdefault(bytes([b]), (1 << 24) + b)
        self.bytes_of = self.of_id | {i: c.encode() for c, i in self.special.items()}
        self.vocab_size = max(self.bytes_of) + 1
        self.encoded = 0
        if self.suffix:
            import regex

            self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            pattern = r"[\s\S]+"
        else:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.merges = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(self.special))
        self._one = self.merges._encode_single_piece
        self.after_space = _Pieces(lambda p: self._piece(" " + p), CACHE_PIECES)
        self.at_start = _Pieces(self._piece, CACHE_PIECES // 8)
        self.words = _Pieces(self._words, CACHE_PIECES)

    def _merge(self, raw: bytes) -> list[int]:
        return tree_merge(self._one, raw, self.of_id) if len(raw) > LONG_PIECE else self._one(raw)

    def _piece(self, piece: str) -> bytes:
        if len(piece) > LONG_PIECE:
            return as_bytes(self._parts(piece))
        core = piece[1:] if piece[0] == " " else piece
        if core.isalpha():  # one pre-token
            return as_bytes(self._one(piece.encode()))
        if core and core[-1] in ".," and core[:-1].isalpha():  # two
            return (self.after_space[core[:-1]] if piece[0] == " " else self.at_start[core[:-1]]) + self.at_start[core[-1]]
        return as_bytes(self.merges.encode(piece, allowed_special="all"))

    def _parts(self, piece: str) -> list[int]:
        """A long piece without the library's loops over its whole length."""
        import regex

        pattern, out, at = regex.compile(self.merges._pat_str), [], 0
        for m in [*(self.marks.finditer(piece) if self.marks else ()), None]:
            for part in pattern.findall(piece[at : m.start() if m else len(piece)]):
                out += self._merge(part.encode())
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def _words(self, chunk: str) -> bytes:
        """Ids of a lower-case chunk without white space."""
        if chunk.isalpha():
            return as_bytes(self._merge(chunk.encode() + b"\xff"))
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return self.words[chunk[:-1]] + self.words[chunk[-1]]
        ids: list[int] = []
        for word in self.split.findall(chunk):
            ids += self._merge(word.encode() + b"\xff")
        return as_bytes(ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _ODD.search(text) or self.suffix and self.marks and self.marks.search(text):
            return as_bytes(self.library.encode(text, add_special_tokens=False).ids)
        if self.suffix:
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        if _SPACED.search(text):
            # white space in a row: cut after it only where a space follows a non-space
            pieces = _BREAK.split(text)
            return b"".join(map(self.at_start.__getitem__, pieces))
        first, *rest = text.split(" ")
        return self.at_start[first] + b"".join(map(self.after_space.__getitem__, rest))

    @contextlib.contextmanager
    def task(self):
        """The codec for one task; its piece tables are emptied at the end."""
        try:
            yield self
        finally:
            for table in (self.after_space, self.at_start, self.words):
                table.clear()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included, as the library gives it."""
        if self.suffix:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        return self._raw(ids).decode("utf-8", errors="replace")

    def _raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def _starts_character(self, i: int) -> bool:
        raw = self.bytes_of[int(i)]
        return not raw or raw[0] & 0xC0 != 0x80

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the text of both, from the ids of both; ``encoded`` counts the bytes that were encoded again."""
        reach_left = reach_right = WINDOW_TOKENS
        while True:
            i, j = max(0, len(left) - reach_left), min(len(right), reach_right)
            while i > 0 and not self._starts_character(left[i]):
                i -= 1
            while j < len(right) and not self._starts_character(right[j]):
                j += 1
            raw = self._raw(left[i:]) + self._raw(right[:j])
            self.encoded += len(raw)
            window = np.frombuffer(self.encode(raw.decode()), "<u4")
            n, m = min(SAME_TOKENS, len(left) - i), min(SAME_TOKENS, j)
            left_agrees = i == 0 or len(window) > n and (window[:n] == left[i : i + n]).all()
            right_agrees = j == len(right) or len(window) > m and (window[len(window) - m :] == right[j - m : j]).all()
            if left_agrees and right_agrees:
                return np.concatenate([left[:i], window, right[j:]])
            reach_left, reach_right = reach_left if left_agrees else 2 * reach_left, reach_right if right_agrees else 2 * reach_right


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def tree_merge(merge, raw: bytes, of_id: dict[int, bytes], leaf: int = LONG_PIECE) -> list[int]:
    """Ids of one unbroken piece: its halves are merged, then windows around the joint grow until the pairs of
    tokens at both of their ends encode to themselves."""
    if len(raw) <= leaf:
        return merge(raw)
    left = tree_merge(merge, raw[: len(raw) // 2], of_id, leaf)
    right = tree_merge(merge, raw[len(raw) // 2 :], of_id, leaf)

    def stays(x: int, y: int) -> bool:
        return merge(_raw(x) + _raw(y)) == [x, y]

    def _raw(i: int) -> bytes:
        whole = of_id[i]
        return whole[:-1] + b"\xff" if raw.endswith(b"\xff") and whole.endswith(b" ") else whole

    i = j = 4
    while True:
        i, j = min(i, len(left)), min(j, len(right))
        window = merge(b"".join(map(_raw, left[len(left) - i :] + right[:j])))
        left_agrees = i == len(left) or stays(left[-i - 1], window[0])
        right_agrees = j == len(right) or stays(window[-1], right[j])
        if left_agrees and right_agrees:
            return left[: len(left) - i] + window + right[j:]
        i, j = i if left_agrees else 2 * i, j if right_agrees else 2 * j


def leaves(text: str, size: int = LEAF_CHARS) -> Iterator[str]:
    """Halves of halves, in order, none longer than ``size``."""
    if len(text) <= size:
        yield text
    else:
        yield from leaves(text[: len(text) // 2], size)
        yield from leaves(text[len(text) // 2 :], size)


def join_leaves(codec: Codec, parts: list[np.ndarray]) -> np.ndarray:
    """Pairs of neighbours are joined until one is left."""
    while len(parts) > 1:
        parts = [codec.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]

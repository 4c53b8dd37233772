"""Token ids of whole texts from a memo of the chunks between spaces.

A vocabulary without a token that goes on behind a space codes the stretches between spaces
one by one, so each distinct stretch is coded by its library once per worker. Where a text has
white space that such a cut might change, the library codes the whole text. Memos start anew
when they are full, so a worker's memory does not grow with the corpus.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Callable

import numpy as np

from gradeweave.llm.tokens import PIECES, line_feed, packed

# Chunks kept per worker and vocabulary.
MEMO = 600_000

# Chunks coded by one call of the library.
_AT_ONCE = 2_000
_JOINED = 200

# Runs of white space that end in a space: a cut before that space may change the ids.
_RUN = re.compile(r"\s \s|  ")
_BLANK = re.compile(r"\s")

# The rule by which the word vocabulary cuts, and its parts of printable ASCII without capitals.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(rb"[!-@\[-~]+")
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

# Stands between chunks that are coded together.
_MARK = b"\x01"


def kept(name: str, make: Callable[[], object]) -> types.SimpleNamespace:
    """What ``make`` gave in this worker process the first time; it stays from task to task.

    Functions of this package reach the workers by value, so a global of theirs would be made
    anew for each task.
    """
    name = f"gradeweave_kept_{name}"
    if name not in sys.modules:
        holder = types.ModuleType(name)
        holder.made = make()
        sys.modules[name] = holder
    return sys.modules[name].made


def _library(path: str, plain: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    return tokenizer


def _bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return np.frombuffer(array("I", ids), np.uintc).astype("<u4").tobytes()


class WordCoder:
    """Ids of a vocabulary that drops white space and lower-cases, as the library gives them
    without special tokens being added (their strings in a text are found)."""

    def __init__(self, path: str, memo: int = MEMO):
        self.memo = memo
        self.library, self.ids, self.mark, self.parts = kept(f"words_{path}", lambda: _words(path))

    def codes(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.ids) > self.memo:
            self.ids.clear()
            if self.parts is not None:
                self.parts.clear()
        lowered = list(map(_lowered, texts))
        cut = [text.split() for text in lowered]
        self._learn(
            set().union(*cut).difference(self.ids), any(_touchy(text) for text in lowered)
        )
        return [b"".join(map(self.ids.__getitem__, chunks)) for chunks in cut]

    def _learn(self, new: set[bytes], touchy: bool) -> None:
        alone = {chunk for chunk in new if _touchy(chunk)} if touchy else set()
        rest = new - alone
        if self.parts is not None:
            plain = list(filter(_PLAIN.fullmatch, rest))
            for chunk in plain:
                self.ids[chunk] = b"".join(map(self._part, _PARTS.findall(chunk)))
            rest = rest.difference(plain)
        if self.mark is None:
            alone, rest = alone | rest, set()
        for chunk in alone:
            self.ids[chunk] = self._by_library(chunk.decode())
        rest = list(rest)
        for i in range(0, len(rest), _JOINED):
            self._learn_joined(rest[i : i + _JOINED])

    def _part(self, part: bytes) -> bytes:
        """The ids of a part that the vocabulary codes by itself."""
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = packed(self.library.model.tokenize(part.decode()))
        return ids

    def _learn_joined(self, chunks: list[bytes]) -> None:
        """Code chunks as one text, with a mark between them that none of them holds."""
        joined = (b" " + _MARK + b" ").join(chunks)
        data = self._by_library(joined.decode())
        at = np.flatnonzero(np.frombuffer(data, "<u4") == self.mark)
        if len(at) != len(chunks) - 1:
            for chunk in chunks:
                self.ids[chunk] = self._by_library(chunk.decode())
            return
        bounds = (4 * at).tolist()
        for chunk, i, j in zip(chunks, [0, *[x + 4 for x in bounds]], [*bounds, len(data)]):
            self.ids[chunk] = data[i:j]

    def _by_library(self, text: str) -> bytes:
        return _bytes(self.library.encode(text, add_special_tokens=False).ids)


def _words(path: str) -> tuple:
    """The library, the memo, the mark's id if it is coded as one, and a memo of parts if the
    library cuts by the rule known here and leaves printable ASCII as it is."""
    library = _library(path, False)
    mark = library.encode(_MARK.decode(), add_special_tokens=False).ids
    cutters = _state(library.pre_tokenizer).get("pretokenizers", [])
    normalizers = _state(library.normalizer).get("normalizers", [])
    known = (
        [x["type"] for x in cutters] == ["Split", "ByteLevel"]
        and cutters[0]["pattern"] == {"Regex": _RULE}
        and cutters[0]["invert"]
        and cutters[0]["behavior"] == "Removed"
        and not (cutters[1]["add_prefix_space"] or cutters[1]["use_regex"])
        and [x["type"] for x in normalizers] == ["NFC", "Replace", "Lowercase"]
        and normalizers[1]["pattern"] == {"Regex": r"\s+"}
    )
    return library, {}, mark[0] if len(mark) == 1 else None, {} if known else None


def _state(part) -> dict:
    """The settings of a part of a tokenizer."""
    return json.loads(part.__getstate__()) if part else {}


def _touchy(data: bytes) -> bool:
    """May hold a combining mark, a special token or the mark between chunks."""
    return b"<|" in data or b"\xcc" in data or b"\xcd" in data or _MARK in data


def _lowered(text: str) -> bytes:
    """Capitals are the library's to lower; A to Z are lowered before, to have fewer chunks.

    Not before a combining mark, which a small letter may be composed with and a capital not,
    nor where a special token might come about.
    """
    data = text.encode()
    return data if _touchy(data) else data.lower()


class PairCoder:
    """Ids of a text by a byte-level vocabulary and by a piece vocabulary, and their bytes.

    The byte-level one codes a space and the text; the piece one adds that space itself.
    Strings of special tokens are plain text to both.
    """

    def __init__(self, byte_path: str, piece_path: str, memo: int = MEMO):
        self.memo = memo
        self.name = f"{byte_path}_{piece_path}"
        made = kept(f"pair_{self.name}", lambda: _pair(byte_path, piece_path))
        self.byte, self.piece, self.bytes_a, self.bytes_b, self.whole_pieces, self.ids = made[:6]
        # Ids of the pre-tokens of plain chunks, None if the byte-level rule is not the one known.
        self.parts: dict[str, bytes] | None = made[6]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def by_library(self, text: str) -> tuple[bytes, bytes]:
        """Ids of one text, by the libraries alone."""
        a = self.byte.encode(" " + text, add_special_tokens=False).ids
        return _bytes(a), _bytes(self.piece.encode(text))

    def codes(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        if len(self.ids) > self.memo:
            self.ids.clear()
            if self.parts is not None:
                self.parts.clear()
        cut = [None if self.whole(text) else text.split(" ") for text in texts]
        self._learn(set().union(*(chunks for chunks in cut if chunks)).difference(self.ids))
        coded = []
        for text, chunks in zip(texts, cut):
            if chunks is None:
                coded.append(self.by_library(text))
            else:
                both = list(map(self.ids.__getitem__, chunks))
                coded.append((b"".join([x[0] for x in both]), b"".join([x[1] for x in both])))
        return coded

    def of_chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of distinct stretches between spaces, each with the space before it; only those
        of their pre-tokens are kept."""
        if self.parts is not None and len(self.parts) > self.memo:
            self.parts.clear()
        self._learn(set(chunks).difference(self.ids))
        return list(map(self.ids.pop, chunks))

    def whole(self, text: str) -> bool:
        """Must it be coded as a whole?"""
        return (
            not text
            or self.whole_pieces
            or "▁" in text
            or _RUN.search(text) is not None
            or _BLANK.match(text) is not None
            or text.endswith(" ")
        )

    def _learn(self, new: set[str]) -> None:
        # White space other than the space is not printable.
        blank = {x for x in new if not x or not x.isprintable() and _BLANK.search(x)}
        for chunk in blank:
            self.ids[chunk] = self.by_library(chunk)
        rest = new - blank
        plain = [] if self.parts is None else [x for x in rest if x.isascii() and x.isprintable()]
        rest = list(rest.difference(plain))
        for i in range(0, len(rest), _AT_ONCE):
            self._learn_joined(rest[i : i + _AT_ONCE])
        for i in range(0, len(plain), _AT_ONCE):
            self._learn_plain(plain[i : i + _AT_ONCE])

    def _learn_plain(self, chunks: list[str]) -> None:
        """``_learn_joined`` of printable ASCII: its pre-tokens are coded once each."""
        ends = np.cumsum([len(chunk) + 1 for chunk in chunks])
        ids = _bytes(self.piece.encode(" ".join(chunks)))
        at = np.cumsum(self.length_b[np.frombuffer(ids, "<u4")])
        cut = np.searchsorted(at, ends)
        if at[-1] != ends[-1] or (at[cut] != ends).any():
            for chunk in chunks:
                self.ids[chunk] = self.by_library(chunk)
            return
        bounds = (4 * (cut + 1)).tolist()
        for chunk, i, j in zip(chunks, [0, *bounds], bounds):
            pieces = PIECES.findall(" " + chunk)
            self.ids[chunk] = b"".join(map(self._part, pieces)), ids[i:j]

    def _part(self, piece: str) -> bytes:
        ids = self.parts.get(piece)
        if ids is None:
            coded = self.byte.model.tokenize(piece.replace(" ", "\u0120"))
            ids = self.parts[piece] = packed(coded)
        return ids

    def _learn_joined(self, chunks: list[str]) -> None:
        """Code chunks as one text and cut its ids where the chunks end, if both libraries
        gave back its bytes and end a token there; else one by one."""
        ends = np.cumsum([len(chunk.encode()) + 1 for chunk in chunks])
        both = []
        for ids, length in zip(self.by_library(" ".join(chunks)), (self.length_a, self.length_b)):
            at = np.cumsum(length[np.frombuffer(ids, "<u4")])
            cut = np.searchsorted(at, ends)
            if at[-1] != ends[-1] or (at[cut] != ends).any():
                for chunk in chunks:
                    self.ids[chunk] = self.by_library(chunk)
                return
            both.append((ids, np.concatenate(([0], 4 * (cut + 1))).tolist()))
        (a, i), (b, j) = both
        for k, chunk in enumerate(chunks):
            self.ids[chunk] = a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]


def _pair(byte_path: str, piece_path: str) -> tuple:
    import sentencepiece

    byte = _library(byte_path, True)
    piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    of_a = byte_level()
    bytes_a = [b""] * byte.get_vocab_size()
    for token, number in byte.get_vocab().items():
        plain = all(c in of_a for c in token)
        bytes_a[number] = bytes(of_a[c] for c in token) if plain else token.encode()
    bytes_b, runs_on = [], False
    for number in range(piece.get_piece_size()):
        token = piece.id_to_piece(number)
        if piece.is_byte(number):
            bytes_b.append(bytes([int(token[3:5], 16)]))
        else:
            bytes_b.append(token.replace("▁", " ").encode())
            runs_on = runs_on or "▁" in token.lstrip("▁")
    known = line_feed(byte) is not None
    return byte, piece, bytes_a, bytes_b, runs_on, {}, {} if known else None


def byte_level() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1
    letters are themselves, the others follow from U+0100 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}

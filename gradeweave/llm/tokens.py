"""Token ids of whole texts by the tokenizers library, with a memo of the words seen.

A byte-level tokenizer first cuts a text into pre-tokens and codes each by itself. Texts made
of well-known characters only are cut here by the same rule, and each distinct pre-token is
coded by the library once per worker. A text with any other character goes to the library
as a whole, so no text depends on how two libraries class a rare character; so does a text
with an added token of the vocabulary, which the library finds before it cuts.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The cutting rule of byte-level BPE vocabularies, for the known characters (fixed values).
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_KNOWN = re.compile(rf"[\t\n -~{_LETTERS}]*")
PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \t\n{_LETTERS}0-9]+"
    r"|[ \t\n]+(?![^ \t\n])|[ \t\n]+"
)
# White space before a space that white space or nothing follows: a cut there may change the ids.
_RUN = re.compile(r"[ \t\n] (?![^ \t\n])")

# Pre-tokens kept per worker before the memo starts anew.
MEMO = 1_000_000

# Pre-tokens coded by one call.
_AT_ONCE = 2_000


class Pieces(dict):
    """The ids of pre-tokens, coded by the vocabulary's model when first asked for."""

    def __init__(self, model):
        self.tokenize = model.tokenize
        self.letters = shown_bytes()

    def __missing__(self, piece: str) -> bytes:
        # As it stands in the vocabulary.
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", "\u0120")
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        found = self[piece] = packed(self.tokenize(letters))
        return found


class Chunks(dict):
    """The ids of stretches between spaces, with the space before them."""

    def __init__(self, pieces: Pieces):
        self.piece = pieces.__getitem__

    def __missing__(self, chunk: str) -> bytes:
        found = self[chunk] = b"".join(map(self.piece, PIECES.findall(" " + chunk)))
        return found


def _worker_memo(path: str) -> types.ModuleType:
    """The tokenizer and the memos of this worker process, kept from task to task."""
    name = f"gradeweave_memo_{path}"
    if name not in sys.modules:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        held = types.ModuleType(name)
        held.tokenizer = Tokenizer.from_file(path)
        added = held.tokenizer.get_added_tokens_decoder().values()
        held.added = [token.content for token in added]
        held.line_feed = line_feed(held.tokenizer)
        held.ids = Pieces(held.tokenizer.model)
        held.chunks = Chunks(held.ids)
        sys.modules[name] = held
    return sys.modules[name]


def shown_bytes() -> dict[int, str]:
    """The letter of a byte-level vocabulary that stands for each byte: printable Latin-1
    letters are themselves, the others follow from U+0100 in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def packed(tokens: list) -> bytes:
    """The ids of a model's tokens as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(tokens)}I", *[token.id for token in tokens])


def line_feed(tokenizer) -> int | None:
    """The id of a line feed, if the tokenizer is known to cut by the byte-level rule; then a line
    feed between two pre-tokens is one itself, and no other pre-token has its id."""
    cutter = tokenizer.pre_tokenizer and json.loads(tokenizer.pre_tokenizer.__getstate__())
    known = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if tokenizer.normalizer or not cutter or known.items() - cutter.items():
        return None
    ids = tokenizer.encode("\n", add_special_tokens=False).ids
    return ids[0] if len(ids) == 1 else None


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, at most about ``size`` bytes of text at a time."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    number = np.cumsum(lengths, dtype=np.int64) // size
    starts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for i, j in zip(starts, starts[1:]):
        yield batch.slice(i, j - i)


def stretches(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct stretches between spaces; which of them follow each other in the texts; and
    where each text starts and ends among these."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), bounds - bounds[0]


def gathered(parts: list[bytes], width: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, of ``width`` bytes, of the parts in the order of ``index``; and where each
    part starts, with the end of the last."""
    numbers = np.frombuffer(b"".join(parts), f"<u{width}")
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    start = np.cumsum(size) - size
    ends = np.concatenate(([0], np.cumsum(size[index])))
    shift = np.repeat(start[index] - ends[:-1], size[index])
    return numbers[shift + np.arange(len(shift))], ends


class Coder:
    """Codes texts as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, memo: int = MEMO):
        self.held = _worker_memo(path)
        self.memo = memo

    def whole(self, text: str) -> bytes:
        """By the library alone."""
        ids = self.held.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def codes(self, texts: list[str]) -> list[bytes]:
        held = self.held
        if len(held.ids) > self.memo:
            held.ids.clear()
        if len(held.chunks) > self.memo // 2:
            held.chunks.clear()
        known = [
            _KNOWN.fullmatch(text) is not None and not any(a in text for a in held.added)
            for text in texts
        ]
        if held.line_feed is None:
            self._learn([text for text, is_known in zip(texts, known) if is_known])
        coded, heads, tails = [], [], []
        for text, is_known in zip(texts, known):
            head, space, tail = text.partition(" ")
            if not is_known:
                coded.append(self.whole(text))
            elif not space or held.line_feed is None or _RUN.search(text):
                coded.append(self._pieces(text))
            else:
                coded.append(None)
                heads.append(self._pieces(head))
                tails.append(tail)
        split = iter([a + b for a, b in zip(heads, self._tails(tails))] if tails else ())
        return [next(split) if ids is None else ids for ids in coded]

    def _pieces(self, text: str) -> bytes:
        """The ids of a text of known characters, by its pre-tokens."""
        return b"".join(map(self.held.ids.__getitem__, PIECES.findall(text)))

    def _tails(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with a space before it. No pre-token goes on behind a space, so
        each stretch between spaces is cut once for all texts."""
        chunks, index, bounds = stretches(texts)
        codes = list(map(self.held.chunks.__getitem__, chunks))
        data, ends = gathered(codes, 4, index)
        data, ends = data.tobytes(), (4 * ends[bounds]).tolist()
        return [data[i:j] for i, j in zip(ends, ends[1:])]

    def _learn(self, texts: list[str]) -> None:
        """Code the new pre-tokens, where the vocabulary's model may not be asked directly."""
        new = set().union(*map(PIECES.findall, texts)).difference(self.held.ids)
        # White space is coded by itself: between line feeds it would be cut otherwise.
        spaces = {piece for piece in new if piece.isspace()}
        for piece in spaces:
            self.held.ids[piece] = self.whole(piece)
        rest = list(new - spaces)
        for i in range(0, len(rest), _AT_ONCE):
            self._learn_lines(rest[i : i + _AT_ONCE])

    def _learn_lines(self, pieces: list[str]) -> None:
        """Code pre-tokens as the lines of one text; a line feed is a pre-token there."""
        coded = self.held.tokenizer.encode("\n".join(pieces), add_special_tokens=False)
        # Where each line starts and ends, by the pre-tokens.
        word = np.array(coded.word_ids, np.int64)
        if word[-1] != 2 * len(pieces) - 2:
            raise ValueError("the tokenizer does not cut like a byte-level BPE")
        bounds = np.searchsorted(word, np.arange(2 * len(pieces)))
        starts, ends = bounds[::2], bounds[1::2]
        data = np.array(coded.ids, "<u4").tobytes()
        for piece, i, j in zip(pieces, (4 * starts).tolist(), (4 * ends).tolist()):
            self.held.ids[piece] = data[i:j]

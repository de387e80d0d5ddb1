"""Byte-level BPE with an exact memo of chunks.

A single space between two non-white characters always starts a pre-token of
this vocabulary's splitting pattern, and merges never cross pre-tokens. A text
may thus be cut before such spaces, and each different chunk be encoded once. New
chunks go through ``tiktoken`` where the vocabulary has a file of ranks beside it: of
a text it makes the ids that the ``tokenizers`` library makes, with less work. A test
compares all merges and the classes of all characters. Other vocabularies go through
the library.

Many texts at once are cut and put together again in Arrow: each different chunk of them
is merged once, all in one call, and no chunk becomes a Python object. Texts with another
kind of space go one by one, through the memo.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Sequence
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import only_one

END_ID = 2
#: Entries of the memo of a worker process. A full one becomes the one before, which words that occur again
#: are taken over from, and the one before that goes: frequent words stay.
MEMO_ENTRIES = 150_000
#: Longer chunks are encoded each time, so that the memo's memory is bounded.
MEMO_CHARS = 48
#: Longer texts without a place to cut go through the library: splitting a very long run of white space overflows tiktoken's stack.
TEXT_CHARS = 100_000

_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The same for Arrow, whose classes know ASCII alone: white characters (as in Python) at an end of a chunk, or nothing in it.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = rf"\A{_WHITE}|{_WHITE}\z|\A\z"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PACK = [struct.Struct(f"<{k}I").pack for k in range(16)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Library:
    """Ids of a pre-token and of any text, by the library as a whole."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def text(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def tokenize(self, piece: bytes) -> list[int]:
        return self.text(piece.decode())


class _Ranks:
    """The same by the ranks of merges."""

    def __init__(self, path: Path):
        import public_tokenizers
        import tiktoken

        with path.open("rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(path.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.text, self.tokenize = encoding._core_bpe.encode_ordinary, encoding._core_bpe.encode_single_piece
        self._all = encoding.encode_to_numpy
        #: Bytes of each token.
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._bytes[list(ranks.values())] = [len(token) for token in ranks]

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks with a space before each, which are safe to encode alone, in a row; and how many each has."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        ids = self._all(" " + pc.binary_join(row, " ")[0].as_py(), disallowed_special=()).astype("<u4", copy=False)
        ends = np.cumsum(pc.binary_length(words).to_numpy() + 1, dtype=np.int64)
        return ids, np.diff(np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1, prepend=0)


class _Memo(dict):
    """Ids by chunk. A chunk that isn't there is taken from the memo before or encoded as it is looked up."""

    __slots__ = ("before", "encode", "long", "tokenize")

    def __init__(self, encode: Callable[[str], bytes | None], tokenize: Callable[[str], list], before: dict[str, bytes | None]):
        super().__init__()
        self.encode, self.tokenize, self.before = encode, tokenize, before
        #: Long chunks of the text at hand.
        self.long: dict[str, bytes | None] = {}

    def known(self, p: str) -> bytes | None:
        return self.get(p) or self.before.get(p)

    def __missing__(self, p: str) -> bytes | None:
        if len(p) > MEMO_CHARS:
            if p not in self.long:
                self.long[p] = self.encode(p)
            return self.long[p]
        ids = self.before.get(p)
        if ids is None:
            if p.isascii() and p.isalpha() and len(p) < len(_PACK):  # the usual word, with no call more than needed
                found = self.tokenize(b" " + p.encode())
                ids = _PACK[len(found)](*found)
            else:
                ids = self.encode(p)
        self[p] = ids
        return ids


class ChunkEncoder:
    """Texts to little-endian uint32 ids, equal to encoding each text as a whole."""

    def __init__(self, path: str):
        self._path = path
        ranks = Path(path).with_suffix(".tiktoken")
        self._model = _Ranks(ranks) if ranks.exists() else _Library(self._tokenizer)
        self._text = self._model.text
        self._ends: dict[str, bytes] = {}
        self._memo = _Memo(self._ids, self._model.tokenize, {})

    @cached_property
    def _tokenizer(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self._path)
        out.encode_special_tokens = True
        return out

    @classmethod
    def shared(cls, path: str) -> ChunkEncoder:
        return only_one("tokens", path, lambda: cls(path))

    def _raw(self, chunk: str) -> bytes:
        if len(chunk) > TEXT_CHARS:
            return self._packed(_Library(self._tokenizer).text(chunk))
        return self._packed(self._text(chunk))

    def _ids(self, p: str) -> bytes | None:
        """Ids of a chunk with a space before it; None if it isn't safe to encode alone."""
        if p.isalpha():
            return self._word(p)
        if not p or p[0].isspace() or p[-1].isspace():
            return None
        known = self._by_word(p)
        if known is None:
            line, _, rest = p.partition("\n")  # alone between characters that aren't white, a pre-token
            if rest and not rest[0].isspace() and not line[-1].isspace():
                known = self._memo.known(line) or (self._word(line) if line.isalpha() else self._by_word(line))
                if known is not None:
                    return known + self._end("\n") + self._raw(rest)
            return self._raw(" " + p)
        return known

    def _by_word(self, p: str) -> bytes | None:
        """Ids of a word and marks after it; None for any other chunk."""
        w = p.rstrip(_MARKS)
        if w.isalpha() and len(p) - len(w) <= 4:
            return (self._memo.known(w) or self._word(w)) + self._end(p[len(w) :])
        return None

    def _end(self, end: str) -> bytes:
        """Ids of a run of marks, which is one pre-token, or of a line's end."""
        if end not in self._ends:
            if len(self._ends) > 10_000:
                self._ends.clear()
            self._ends[end] = self._raw(end)
        return self._ends[end]

    def _word(self, letters: str) -> bytes:
        return self._packed(self._model.tokenize(b" " + letters.encode()))

    @staticmethod
    def _packed(found: Sequence[int]) -> bytes:
        n = len(found)
        return _PACK[n](*found) if n < len(_PACK) else np.array(found, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as bytes, without an end id; null is empty."""
        if not text:
            return b""
        memo = self._memo
        if len(memo) > MEMO_ENTRIES:
            memo.before = {}
            memo = self._memo = _Memo(self._ids, self._model.tokenize, memo)
        parts = text.split(" ")
        first = parts[0]
        if not first or first[-1].isspace():
            return self._by_cuts(text)
        del parts[0]
        try:
            return self._raw(first) + b"".join(map(memo.__getitem__, parts))
        except TypeError:  # a part that isn't safe to encode alone
            return self._by_cuts(text)
        finally:
            memo.long.clear()

    def encode_all(self, texts: pa.Array, after: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``texts`` in a row, each text's with the ids ``after`` behind them; and where each begins, with the end of all."""
        tail = self._packed(after)
        if not len(texts) or not isinstance(self._model, _Ranks):
            found = [self.encode(t) + tail for t in texts.to_pylist()]
            return np.frombuffer(b"".join(found), "<u4"), np.cumsum([0, *map(len, found)]) // 4
        texts = texts.cast(pa.string()).fill_null("")
        cut = pc.split_pattern(texts, " ")
        starts, chunks = cut.offsets.to_numpy().astype(np.int64), cut.flatten().dictionary_encode()
        which, distinct = chunks.indices.to_numpy(), chunks.dictionary
        unsafe = pc.or_(pc.match_substring_regex(distinct, _UNSAFE), pc.greater(pc.binary_length(distinct), TEXT_CHARS)).to_numpy(zero_copy_only=False)
        needed, alone = ~unsafe, np.zeros(len(texts), bool)
        if unsafe.any():
            alone = np.logical_or.reduceat(unsafe[which], starts[:-1])
            needed[:] = False
            needed[which[np.repeat(~alone, np.diff(starts))]] = True
        ids, n = self._model.words(distinct.filter(pa.array(needed)))
        first = pc.list_element(cut, 0)
        own = [self.encode(texts[k].as_py()) if apart else self._raw(first[k].as_py()) for k, apart in enumerate(alone)]

        # entries: the distinct chunks, what comes after a text, nothing, and for each text its first chunk or all of it
        counts = np.zeros(len(distinct) + 2 + len(own), np.int64)
        counts[: len(distinct)][needed] = n
        counts[len(distinct)] = len(tail) // 4
        counts[len(distinct) + 2 :] = [len(x) // 4 for x in own]
        offsets = np.concatenate(([0], np.cumsum(counts * 4)))
        data = b"".join([ids.tobytes(), tail, *own])
        entries = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

        order = np.insert(which, starts[1:], len(distinct))
        starts += np.arange(len(starts))
        for k in np.flatnonzero(alone):
            order[starts[k] : starts[k + 1] - 1] = len(distinct) + 1
        order[starts[:-1]] = np.arange(len(own)) + len(distinct) + 2
        found = entries.take(pa.array(order))
        _, ends, data = found.buffers()
        starts = np.frombuffer(ends, np.int64, len(order) + 1)[starts] // 4
        return np.frombuffer(data or b"", "<u4", starts[-1]), starts

    def _by_cuts(self, text: str) -> bytes:
        """The general case: cuts only where both neighbours of a space are not white."""
        first, *rest = _SAFE_CUT.split(text)
        memo = self._memo
        found = {c: memo.get(c) or self._ids(c) or self._raw(" " + c) for c in set(rest)}
        return b"".join([self._raw(first), *(found[c] for c in rest)])

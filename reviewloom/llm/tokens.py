"""Token ids of whole texts by the tokenizers library, remembered by piece.

The library's pre-tokenizers never join what stands on both sides of certain white space, so a text's ids are the
ids of its pieces in a row. Texts repeat their words far more often than not: each task keeps a bounded memo of
piece -> ids and asks the library only for pieces that are not in it.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker a core

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Bytes of the newer half of a memo. Once it is full, it becomes the older half, whose pieces go unless they recur.
MEMO_BYTES = 48 << 20
#: What a piece takes besides its characters and ids: two objects and a place in the table.
_ENTRY_BYTES = 150
#: glibc's call that gives freed memory back, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform.startswith("linux") else None
#: Fixed value: marks that end a word in ordinary prose and are one run of the pre-tokenizers' punctuation class.
_TAIL = ".,;:!?%&*$#|"
_NEWLINE = "\n"
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


class _Memo(dict):
    """piece -> ids; a piece that is not there is made and kept, so that a text's pieces are looked up in one go."""

    __slots__ = ("make", "older", "held", "most")

    def __init__(self, make: Callable[[str], bytes], most: int, older: dict[str, bytes]):
        self.make, self.most, self.older, self.held = make, most, older, 0

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            got = self.make(piece)
        self[piece] = got
        self.held += _ENTRY_BYTES + len(piece) + len(got)
        return got

    def room(self) -> _Memo:
        """This memo, or once it is full a new one that has this one as its older half."""
        if self.held <= self.most:
            return self
        self.older = {}
        return _Memo(self.make, self.most, self)


class _Uneven(Exception):
    """White space stands so that a text can't be cut at every blank and line end."""


def _byte_letters() -> dict[int, str]:
    """The rule of byte-level BPE: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in kept}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """ids(text): little-endian unsigned 32-bit ids as the library gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._letters = _byte_letters()
        self._tokenize = self.tokenizer.model.tokenize
        self._spell: Callable[[str], bytes] = self._literal
        part = lambda p: json.loads(p.__getstate__()) if p is not None else None
        pre, norm = part(self.tokenizer.pre_tokenizer) or {}, part(self.tokenizer.normalizer)
        steps = [s.get("type") for s in (norm or {}).get("normalizers", [])]
        drops = any(p.get("behavior") == "Removed" and p.get("invert") for p in pre.get("pretokenizers", []))
        if steps == ["NFC", "Replace", "Lowercase"] and drops:
            self.ids, self._spell = self._ids_words, self._word
        elif norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.ids, self._spell = self._ids_bytes, self._spaced
        else:
            self.ids = self._whole
        self.rest()

    def rest(self) -> None:
        """Forgets all pieces. Tasks end with it, so that a worker that waits for its next one holds little memory."""
        self._memo = _Memo(self._spell, MEMO_BYTES, {})
        self._plain = _Memo(self._literal, MEMO_BYTES // 3, {})
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _model(self, piece: str) -> bytes:
        """Ids of one pre-token by the library's model itself."""
        mapped = piece if piece.isascii() and " " not in piece else piece.encode().decode("latin-1").translate(self._letters)
        ids = array("I", [t.id for t in self._tokenize(mapped)])
        return ids.tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    @staticmethod
    def _letters_only(word: str) -> bool:
        """A run of letters long settled in Unicode, on whose class all libraries agree."""
        return word.isalpha() and (word.isascii() or max(word) < "Ⰰ")

    # words in lower case, white space dropped: any white space separates

    def _word(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self._model(piece.lower())
        if not piece:
            return b""
        core = piece.rstrip(_TAIL)
        if not self._letters_only(core) or not core.isascii() and not self._letters_only(core.lower()):
            return self._whole(piece)  # a capital can turn into a letter and a mark
        if len(core) < len(piece):
            return self._memo[core] + self._memo[piece[len(core) :]]
        low = "".join(c.lower() for c in core)
        if unicodedata.is_normalized("NFC", core) and unicodedata.is_normalized("NFC", low) and self._letters_only(low):
            return self._model(low)
        return self._whole(piece)

    def _ids_words(self, text: str) -> bytes:
        memo = self._memo = self._memo.room()
        return b"".join(map(memo.__getitem__, text.replace(_NEWLINE, " ").split(" ")))

    # byte-level: a single blank belongs to what follows it, a single line end stands alone

    def _literal(self, piece: str) -> bytes:
        core = piece.rstrip(_TAIL)
        if core == piece and self._letters_only(core):
            return self._model(core)
        if core and core != piece and self._letters_only(core):
            return self._plain[core] + self._whole(piece[len(core) :])
        return self._whole(piece)

    def _spaced(self, key: str) -> bytes:
        """Ids of a key of the memo: a word after one blank, or a line end with the word after it."""
        if key.isalpha() and key.isascii():
            return self._model(" " + key)
        word = key[1:] if key[:1] == _NEWLINE else key
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Uneven
        if word is not key:
            return self._plain[_NEWLINE] + self._plain[word]
        core = word.rstrip(_TAIL)
        if not self._letters_only(core):
            return self._whole(" " + word)
        if len(core) == len(word):
            return self._model(" " + core)
        return self._memo[core] + self._plain[word[len(core) :]]

    def _ids_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        memo, plain = self._memo, self._plain = self._memo.room(), self._plain.room()
        first, *keys = text.replace(_NEWLINE, " \n").split(" ")
        try:
            if not first or first[0].isspace() or first[-1].isspace():
                raise _Uneven
            return plain[first] + b"".join(map(memo.__getitem__, keys))
        except _Uneven:
            return b"".join(map(plain.__getitem__, _SAFE_CUT.split(text)))

    def decode(self, ids: bytes) -> str:
        return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker, which serves many tasks."""
    return Encoder(path)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each closed once its binary and string values hold most_bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

"""Fill-in-middle transformation: texts cut at unit boundaries that a wavelet matrix over character classes locates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .tokens import in_batches

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Classes of characters: line ends, other white space, marks that end a sentence, all else.
NEWLINE, BLANK, STOP, OTHER = range(4)
_CLASS_BITS = 2
#: Code points whose classes are found at a time.
_STEP = 1 << 20
#: Bits a block of the rank directory.
_BLOCK = 512
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _table() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[[ord(c) for c in " \t\r\v\f"]] = BLANK
    table[[ord(c) for c in ".!?"]] = STOP
    table[ord("\n")] = NEWLINE
    return table


_TABLE = _table()


def classes(text: str) -> np.ndarray:
    """The class of each code point."""
    if text.isascii():
        return _TABLE[np.frombuffer(text.encode(), np.uint8)]
    out = np.empty(len(text), np.uint8)
    for at in range(0, len(text), _STEP):
        points = np.frombuffer(text[at : at + _STEP].encode("utf-32-le", "surrogatepass"), "<u4")
        out[at : at + _STEP] = np.where(points < 256, _TABLE[np.minimum(points, 255)], OTHER)
    return out


class Bits:
    """A bit vector with a directory of ranks: one count a block and packed bits."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        self.packed = np.packbits(bits)
        counts = np.add.reduceat(bits, np.arange(0, self.n, _BLOCK), dtype=np.int64) if self.n else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)]).tolist()

    def ones(self, i: int) -> int:
        """Set bits among the first i."""
        block, rest = divmod(i, _BLOCK)
        if not rest:
            return self.before[block]
        at = block * _BLOCK // 8
        part = int.from_bytes(self.packed[at : at + (rest + 7) // 8].tobytes(), "big")
        return self.before[block] + (part >> (-rest % 8)).bit_count()


class WaveletMatrix:
    """rank(c, i): how often class c stands among the first i characters; select(c, k): the place of its k-th one.

    Level by level, from the highest bit of a class, the bits of all characters are kept and the characters dealt out
    stably, zeros first.
    """

    def __init__(self, classes: np.ndarray, bits: int = _CLASS_BITS):
        self.n, self.levels = len(classes), []
        row = classes
        for shift in range(bits - 1, -1, -1):
            bit = (row >> shift & 1).astype(bool)
            level = Bits(bit)
            self.levels.append((shift, level, self.n - level.before[-1]))
            row = np.concatenate([row[~bit], row[bit]])

    def rank(self, c: int, i: int) -> int:
        start, end = 0, i
        for shift, bits, zeros in self.levels:
            a, b = bits.ones(start), bits.ones(end)
            start, end = (zeros + a, zeros + b) if c >> shift & 1 else (start - a, end - b)
        return end - start

    def select(self, c: int, k: int) -> int:
        """Bisection on ranks: the least place with k of class c before and at it, k from 1."""
        return bisected(lambda i: self.rank(c, i), self.n, k) - 1


def bisected(count: Callable[[int], int], n: int, k: int) -> int:
    """The least i of 0..n with count(i) >= k; count never falls. n + 1 if there is none."""
    low, high = 0, n + 1
    while low < high:
        mid = (low + high) // 2
        if count(mid) >= k:
            high = mid
        else:
            low = mid + 1
    return low


class Units:
    """A text's units: total of them, and end(k), the characters in the first k."""

    def __init__(self, matrix: WaveletMatrix, text: str, kind: str):
        self.matrix, self.text, self.kind = matrix, text, kind
        self.total = self.ends(matrix.n)

    def ends(self, i: int) -> int:
        """Units that end within the first i characters, by sums of ranks.

        A line ends with its line end, a character with itself, a word or a run of blanks where the other begins, all
        of them with the text.
        """
        m = self.matrix
        if self.kind == "char":
            return sum(m.rank(c, i) for c in range(1 << _CLASS_BITS))
        open_end = i == m.n > 0 and not self.text.endswith("\n")
        return m.rank(NEWLINE, i) + int(open_end)

    def end(self, k: int) -> int:
        if k <= 0:
            return 0
        if self.kind == "line" and k <= self.matrix.rank(NEWLINE, self.matrix.n):
            return self.matrix.select(NEWLINE, k) + 1
        return min(bisected(self.ends, self.matrix.n, k), self.matrix.n)


class Words(Units):
    """Runs of white space with the word after them: a unit ends where a word does, before white space or at the end.

    Places where a word ends are counted by the ranks of a second matrix, whose class 1 marks a character that is not
    white space and has white space or nothing after it.
    """

    def __init__(self, classes: np.ndarray, text: str):
        word = classes >= STOP
        last = word.copy()
        last[:-1] &= ~word[1:]
        self.trailing = len(text) > 0 and not word[-1]
        super().__init__(WaveletMatrix(last.astype(np.uint8), 1), text, "word")

    def ends(self, i: int) -> int:
        return self.matrix.rank(1, i) + int(self.trailing and i == self.matrix.n)


def units(text: str, kind: str) -> Units:
    """Units of kind line ([^\\n]*\\n|[^\\n]+), word (\\s*\\S+|\\s+ at the end, of the white space above) or char."""
    kinds = classes(text)
    return Words(kinds, text) if kind == "word" else Units(WaveletMatrix(kinds), text, kind)


def infilled(docs: DataFrame, seed: int = 7, unit: str = "line", rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each document: n units, cut in two places.

    Four numbers h1 to h4 are the first 8-digit groups of the SHA-256 of "seed:doc_id". The prefix ends after the
    smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. Of each hundred, about `rate`
    documents change form (h3), and of those `spm_rate` have the suffix first (spm, h4), the others the prefix (psm):
    <P>prefix<S>suffix<M>middle or <S>suffix<P>prefix<M>middle. A text that is empty or holds one of the marks stays as
    it is: form plain, without cuts.

    A null text is empty; a null doc_id counts as an empty one in the hash; repeated rows give a row each; an empty
    table gives no rows; other columns are ignored.
    """
    if unit not in ("line", "word", "char"):
        raise ValueError(f"no such unit: {unit}")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    marked = re.compile("|".join(map(re.escape, MARKS)))
    p, s, m = MARKS

    def cut(doc_id: int | None, text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        own = units(text, unit)
        n = own.total
        if not text or marked.search(text) or h3 % 100 >= rate:
            return doc_id, n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = own.end(first), own.end(second)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        form = "spm" if h4 % 100 < spm_rate else "psm"
        return doc_id, n, form, a, b - a, (f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (cut(*(c.as_py() for c in row)) for b in batches for row in zip(*b.columns, strict=True))
        yield from in_batches(rows, _SCHEMA)

    kept = texts(docs, id_col, text_col).select("doc_id", "text", *drawn)
    return kept.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A mark can't arise where two parts meet, since none overlaps another."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands after the first mark, after the second, and after the one for the middle."""
        body = F.substr(output, F.lit(len(first) + 1))
        at = F.locate(second, body)
        rest = F.substr(body, at + len(second))
        end = F.locate(MARKS[2], rest)
        return F.left(body, at - 1), F.left(rest, end - 1), F.substr(rest, end + len(MARKS[2]))

    prefix, suffix, middle = parts(MARKS[0], MARKS[1])
    suffix2, prefix2, middle2 = parts(MARKS[1], MARKS[0])
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)

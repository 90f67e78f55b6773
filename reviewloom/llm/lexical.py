"""Ranked lexical search: an inverted index in segments, and accumulator-limited term-at-a-time scoring over it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few, texts, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates terms: ASCII but for digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text after which a task closes a segment; a longer text is a segment by itself.
SEGMENT_BYTES = 12 << 20
#: Terms of items that are searched for in one go.
BLOCK_TERMS = 1 << 18
#: Postings of an item's rarest terms, over k, from which the floor of its scores is found.
FLOOR_POSTINGS = 64
_INDEX = "segment long, term string, docs array<int>, tfs array<int>, ids array<long>"
_I32 = pa.list_(pa.int32())


def _lowered(text: Column) -> Column:
    """text with only A-Z in lower case."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _split(text: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The terms of all texts in a row, and how many each text has."""
    pieces = pc.split_pattern_regex(text, _BETWEEN)
    flat, owner = pc.list_flatten(pieces), pc.list_parent_indices(pieces).to_numpy()
    there = pc.not_equal(flat, "")
    owner = owner[there.to_numpy(zero_copy_only=False)]
    return np.bincount(owner, minlength=len(text)), flat.filter(there).dictionary_encode()


class _Segment:
    """Documents and their terms until a segment is closed."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.terms: list[pa.DictionaryArray] = []
        self.size = 0

    def add(self, ids: pa.Array, text: pa.Array) -> None:
        lengths, terms = _split(text)
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.terms.append(terms)
        self.size += text.nbytes

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """First a row without term: the identifiers and, as tfs, the lengths of the documents; then one for each term."""
        lengths = np.concatenate(self.lengths)
        docs = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        terms = pa.chunked_array(self.terms).unify_dictionaries()
        words = terms.chunk(0).dictionary
        codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in terms.chunks]).astype(np.int64)
        keys, tfs = np.unique(codes * max(1, len(lengths)) + docs, return_counts=True)
        codes, docs = np.divmod(keys, max(1, len(lengths)))
        ends = np.searchsorted(codes, np.arange(len(words) + 1))
        ids = pa.concat_arrays(self.ids)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        yield self._batch(number, pa.nulls(1, pa.string()), pa.nulls(1, _I32), one(pa.array(lengths, pa.int32())), one(ids.cast(pa.int64())))
        docs, tfs = pa.array(docs, pa.int32()), pa.array(tfs, pa.int32())
        step = 1 << 15
        for at in range(0, len(words), step):
            cuts = ends[at : at + step + 1]
            own = slice(cuts[0], cuts[-1])
            lists = [pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), x[own]) for x in (docs, tfs)]
            yield self._batch(number, words.slice(at, step), *lists, pa.nulls(len(cuts) - 1, pa.list_(pa.int64())))

    @staticmethod
    def _batch(number: int, terms: pa.Array, docs: pa.Array, tfs: pa.Array, ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), number)), terms, docs, tfs, ids], names=["segment", "term", "docs", "tfs", "ids"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """An inverted index of all terms of all documents, written to the shared folder.

    Terms are runs of ASCII digits, letters and all other characters beyond ASCII; A-Z alone are lowered. Documents are
    cut into segments of about segment_bytes of text; a segment has a row for each of its terms, with the places of the
    documents that hold it (docs) and how often (tfs), and one row without term, with the documents' identifiers (ids)
    and numbers of terms (tfs). A row is no longer than a segment, however common its term.

    A null text has no terms; a row with a null doc_id and each of repeated rows is a document; an empty table has no
    segments; other columns are ignored.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, segment = TaskContext.get().partitionId() << 32, _Segment()
        for b in batches:
            if b.num_rows:
                segment.add(b.column(0), b.column(1))
            if segment.size >= segment_bytes:
                yield from segment.rows(number)
                number, segment = number + 1, _Segment()
        if segment.ids:
            yield from segment.rows(number)

    lowered = texts(docs, id_col, text_col).select("doc_id", _lowered(F.col("text")).alias("text"))
    return written(lowered.mapInArrow(index, _INDEX), "lexical-index")


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class _Search:
    """Term-at-a-time over one segment's postings."""

    def __init__(self, index: pa.Table, n_docs: int, n_terms: int):
        head = index.filter(pc.is_null(index.column("term")))
        self.ids = head.column("ids").combine_chunks().flatten()
        lengths = head.column("tfs").combine_chunks().flatten().to_numpy()
        m = 50 + 50 * lengths.astype(np.int64) * n_docs // max(1, n_terms)
        rows = index.filter(pc.is_valid(index.column("term"))).combine_chunks()
        self.postings: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}
        if rows.num_rows:
            docs, tfs = (rows.column(c).combine_chunks() for c in ("docs", "tfs"))
            ends = docs.offsets.to_numpy() - docs.offsets[0].as_py()
            docs, tfs = docs.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
            impact = _impact(tfs, m[docs])
            most = np.maximum.reduceat(impact, ends[:-1]).tolist()
            for i, term in enumerate(rows.column("term").to_pylist()):
                own = slice(ends[i], ends[i + 1])
                self.postings[term] = docs[own], impact[own], most[i]
        self.scores = np.zeros(len(self.ids), np.int64)

    def best(self, terms: list[tuple[str, int]], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the k best: terms, rarest first, with their weights.

        Every document of a term gets an accumulator until what the terms left can add is below the floor or the k-th
        best partial score so far: no document without an accumulator can then reach the k best. From there on only
        documents that have one are added to. A floor is a score that k documents are known to reach.
        """
        own = [(w, *self.postings[t]) for t, w in terms if w and t in self.postings]
        scores, floor = self.scores, max(floor, 1)
        left, made, at = sum(w * most for w, _, _, most in own), 0, 0
        while at < len(own) and left >= floor and not (made > left and self._kth(k) > left):
            w, docs, impact, most = own[at]
            scores[docs] += w * impact
            made, left, at = made + w * most, left - w * most, at + 1
        for w, docs, impact, _ in own[at:]:
            held = scores[docs] > 0
            scores[docs[held]] += w * impact[held]
        found = np.flatnonzero(scores >= floor)
        total = scores[found]
        scores[:] = 0
        if len(total) > k:
            near = total >= np.partition(total, -k)[-k]
            found, total = found[near], total[near]
        return found, total

    def _kth(self, k: int) -> int:
        """The k-th best partial score, 0 with fewer accumulators."""
        partial = self.scores[self.scores > 0]
        return int(np.partition(partial, -k)[-k]) if len(partial) >= k else 0


def search(index: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents of highest score above 0, ties to the smaller
    doc_id.

    N counts the documents with a term, L all terms, n a document's, df the documents of a term; a term weighs
    w = floor(1000 ln((2N + 2) / (2 df + 1))), and a document's score sums w * ((10^9 tf) div (1000 tf + 20 m)) over an
    item's terms, each once, with m = 50 + (50 n N) div L.

    First, from the postings of an item's rarest terms (as many terms as hold about FLOOR_POSTINGS * k of them, however
    large the table), the k-th best sum is found: a floor of its scores. Then each segment is searched term at a time,
    rarest first; accumulators are made until the terms left can't reach the floor or the segment's own k-th best, and
    those there are get exact scores from the other terms. Only documents that reach the floor leave a segment.

    Items are searched in blocks of about block_terms terms, which the driver and each task hold; one pass over the
    index each. An item without terms, and so a null text, gives no rows; rows that repeat an item_id, null too, are
    one item of all their terms. Documents without doc_id count, are ranked after others of equal score, and repeated
    ones each; ties of those are in any order. An empty index or table of items gives no rows.
    """
    spark = index.sparkSession
    words = F.explode(F.regexp_extract_all(_lowered(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(_TERM), F.lit(0)))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), words.alias("term")).distinct()
    blocks = 1 + asked.count() // block_terms
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "lexical-asked")
    heads, rows = index.filter("term is null"), index.filter("term is not null")
    of_docs = heads.select(F.explode("tfs").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"))
    n_docs, n_terms = of_docs.first()
    vocabulary = written(asked.select("term").distinct(), "lexical-vocabulary")
    mine = written(rows.join(few(vocabulary), "term", "left_semi").select("segment", "term", "docs", "tfs", "ids").unionByName(heads), "lexical-postings")
    df = written(mine.filter("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df")), "lexical-df")

    def block(number: int) -> DataFrame:
        own = asked.filter(F.col("block") == number).join(df, "term").select("item_id", "term", "df")
        rarest = F.sum("df").over(W.partitionBy("item_id").orderBy("df", "term"))
        queries: dict[int | None, list[tuple[str, int]]] = {}
        floor_terms = []
        for r in own.withColumn("upto", rarest).orderBy("item_id", "df", "term").collect():
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
            queries.setdefault(r.item_id, []).append((r.term, weight))
            if r.upto <= FLOOR_POSTINGS * k:
                floor_terms.append((r.item_id, r.term, weight))
        floors = _floors(floor_terms)
        plan = [(i, terms, floors.get(i, 0)) for i, terms in queries.items()]

        def run(segment: pa.Table) -> pa.Table:
            at = _Search(segment, n_docs, n_terms)
            found = [(i, *at.best(terms, floor, k)) for i, terms, floor in plan]
            found = [f for f in found if len(f[1])]
            docs = np.concatenate([d for _, d, _ in found]) if found else np.zeros(0, np.int64)
            items = [pa.array([i] * len(d), pa.int64()) for i, d, _ in found]
            scores = np.concatenate([s for _, _, s in found]) if found else np.zeros(0, np.int64)
            return pa.table({"item_id": pa.concat_arrays(items) if items else pa.nulls(0, pa.int64()), "doc_id": at.ids.take(pa.array(docs, pa.int64())), "score": pa.array(scores, pa.int64())})

        return mine.groupBy("segment").applyInArrow(run, "item_id long, doc_id long, score long")

    def _floors(chosen: list[tuple[int | None, str, int]]) -> dict[int | None, int]:
        """The k-th best sum over the chosen terms, of items with as many documents; a sum of parts is no more than the score."""
        terms = spark.createDataFrame(chosen, "item_id long, term string, w long") if chosen else None
        if terms is None:
            return {}
        held = mine.filter("term is not null").join(F.broadcast(terms), "term")  # at most block_terms rows
        each = held.select("item_id", "w", "segment", F.explode(F.arrays_zip("docs", "tfs")).alias("p")).select("item_id", "w", "segment", "p.docs", "p.tfs")
        lengths = heads.select("segment", F.posexplode("tfs").alias("docs", "n"))
        m = F.expr(f"50 + (50L * n * {n_docs}L) div {n_terms}L")
        part = F.expr("w * ((1000000000L * tfs) div (1000L * tfs + 20L * m))")
        sums = each.join(lengths, ["segment", "docs"]).withColumn("m", m).groupBy("item_id", "segment", "docs").agg(F.sum(part).alias("s"))
        place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("s")))
        return {r.item_id: r.s for r in sums.withColumn("place", place).filter(F.col("place") == k).select("item_id", "s").collect()}

    found = block(0)
    for number in range(1, blocks):
        found = found.unionByName(block(number))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

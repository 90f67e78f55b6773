"""BPE encoding and decoding by tree concatenation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .tokens import Encoder, encoder, in_batches

LEAF_CHARS = 65_536
_FIRST_WINDOW = 64


def _hard_cuts(text: str) -> list[int]:
    """Places before one blank or line end between two other characters: no pre-token spans them."""
    return [i for i in range(1, len(text) - 1) if text[i] in " \n" and not text[i - 1].isspace() and not text[i + 1].isspace()]


def concatenated(enc: Encoder, left: tuple[str, bytes], right: tuple[str, bytes]) -> tuple[str, bytes]:
    """Text and ids of two neighbours from their own texts and ids.

    A window around the join is encoded anew, between a hard cut on its left and one on its right. It grows
    until there are such cuts and until, outside the join, the ids of either side are the ones that it already
    has; in the end it holds both texts, and its ids are theirs.
    """
    (lt, li), (rt, ri) = left, right
    w = _FIRST_WINDOW
    while w < len(lt) or w < len(rt):
        tail, head = lt[-w:], rt[:w]
        p = 0 if w >= len(lt) else next(iter(_hard_cuts(tail)), None)
        q = len(rt) if w >= len(rt) else next(reversed(_hard_cuts(head)), None)
        if p is not None and q is not None:
            a, b = enc.ids(tail[p:]), enc.ids(head[:q])
            if li.endswith(a) and ri.startswith(b):
                return lt + rt, li[: len(li) - len(a)] + enc.ids(tail[p:] + head[:q]) + ri[len(b) :]
        w *= 2
    return lt + rt, enc.ids(lt + rt)


def tree_ids(enc: Encoder, nodes: list[tuple[str, bytes]]) -> bytes:
    """Ids of the whole from encoded leaves, neighbours joined level by level."""
    while len(nodes) > 1:
        pairs = [concatenated(enc, *nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        nodes = pairs
    return nodes[0][1]


def encode(docs: DataFrame, tokenizer: str, leaf_chars: int = LEAF_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of every whole text as little-endian unsigned 32-bit integers.

    tokenizer is the path of a file of the tokenizers library. Texts of up to leaf_chars characters are encoded
    where they are read. A longer text is halved until its leaves are that short; the leaves are encoded in
    parallel, then brought together by document and joined up the tree. Only long texts are shuffled. The ids
    are those of the whole text in every case.

    A null or empty text has empty ids; an empty table gives no rows; repeated rows give a row each; other
    input columns are ignored.
    """
    src = texts(docs, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        rows = ((i.as_py(), enc.ids(t.as_py())) for b in batches for i, t in zip(b.column(0), b.column(1), strict=True))
        yield from in_batches(rows, schema)
        enc.rest()

    leaf_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.int32()), ("text", pa.string()), ("ids", pa.binary())])

    def leaves_encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        rows = ((*r.values(), enc.ids(r["text"])) for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
        yield from in_batches(rows, leaf_schema)
        enc.rest()

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf")
        nodes = list(zip(pdf["text"], pdf["ids"], strict=True))
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "ids": [tree_ids(encoder(tokenizer), nodes)]})

    chars = F.length("text")
    short = src.filter(chars <= leaf_chars).mapInArrow(whole, "doc_id long, ids binary")
    n = F.pow(F.lit(2), F.ceil(F.log2(F.col("chars") / F.lit(float(leaf_chars))))).cast("int")
    long = (
        src.filter(chars > leaf_chars)
        .withColumn("chars", chars)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("leaves", n)
        .select("row", "doc_id", "text", "chars", "leaves", F.explode(F.sequence(F.lit(0), F.col("leaves") - 1)).alias("leaf"))
    )
    at = lambda i: (F.col("chars").cast("long") * i / F.col("leaves")).cast("int")
    leaf = F.col("leaf")
    pieces = long.select("row", "doc_id", "leaf", F.substring(F.col("text"), at(leaf) + 1, at(leaf + 1) - at(leaf)).alias("text"))
    parts = pieces.repartition("row", "leaf").mapInArrow(leaves_encoded, "row long, doc_id long, leaf int, text string, ids binary")
    return short.unionByName(parts.groupBy("row").applyInPandas(joined, "doc_id long, ids binary"))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded with a column `decoded`: the text of column `ids`, special tokens kept. Other columns pass through
    but for one named decoded, which is replaced; null ids count as empty."""
    kept = [c for c in encoded.columns if c != "decoded"]
    src = encoded.select(*[c for c in kept if c != "ids"], F.coalesce("ids", F.lit(b"")).alias("ids"))

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            schema = pa.schema([*b.schema, pa.field("decoded", pa.string())])
            rows = ((*r.values(), enc.decode(r["ids"])) for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
            yield from in_batches(rows, schema)

    return src.mapInArrow(texts_of, src.withColumn("decoded", F.lit("")).schema)

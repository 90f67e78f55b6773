"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encode
from .common import compact, discarded, few, fresh, written

CAPACITY = 2048
#: Lengths, and so the rows of a round, are bounded by this.
MOST_CAPACITY = 1 << 16
#: Ranges of sizes that are swept side by side before what they leave is swept as one.
RANGES = 8
_PIECE, _GAP, _PLACED = 0, 1, 2
_RUNS = "kind int, size int, at long, n long, sequence long, offset int"


def swept(runs: list[tuple[int, int, int, int]], capacity: int) -> list[tuple]:
    """One sweep over the runs (kind, size, at, n) of a range of sizes: rows of _RUNS.

    A piece run stands for the n pieces of length `size` with ranks from `at` on, a gap run for the n sequences from
    `at` on that have `size` left. Sizes go upward, so that each gap, smallest first, takes the longest piece that
    fits it and that no smaller gap has taken; where both want more than there is, ranks decide. What it has left
    is a gap of its own at once. Left-over pieces and gaps are returned for the next round.
    """
    waiting: list[list[int]] = []  # [length, rank, number], longest last
    out: list[tuple] = []
    for size, kind, at, n in sorted((s, k, a, n) for k, s, a, n in runs):
        if kind == _PIECE:
            waiting.append([size, at, n])
            continue
        work = [(size, at, n)]
        while work:
            gap, first, number = work.pop()
            while number:
                place = bisect_right(waiting, [gap, 1 << 62]) - 1
                if place < 0:
                    out.append((_GAP, gap, first, number, None, None))
                    break
                length, rank, there = waiting[place]
                k = min(number, there)
                out.append((_PLACED, length, rank, k, first, capacity - gap))
                if gap > length:
                    work.append((gap - length, first, k))
                first, number = first + k, number - k
                if k == there:
                    del waiting[place]
                else:
                    waiting[place] = [length, rank + k, there - k]
    return out + [(_PIECE, length, rank, n, None, None) for length, rank, n in waiting]


def _opened(state: DataFrame, new: int, before: int, capacity: int) -> DataFrame:
    """state after its `new` longest pieces have opened sequences, numbered from `before` on; one row a length is ordered."""
    pieces, gaps = state.filter(F.col("kind") == _PIECE), state.filter(F.col("kind") == _GAP)
    earlier = F.sum("n").over(W.orderBy(F.desc("size"), "at").rowsBetween(W.unboundedPreceding, -1))
    ranked = pieces.withColumn("earlier", F.coalesce(earlier, F.lit(0))).withColumn("k", F.greatest(F.lit(0), F.least("n", F.lit(new) - F.col("earlier"))))
    run = lambda kind, size, at, n, sequence, offset: F.struct(*[c.cast(t).alias(name) for c, (name, t) in zip((F.lit(kind), size, at, n, sequence, offset), (x.split() for x in _RUNS.split(", ")), strict=True)])
    first, none, size, k = F.lit(before) + F.col("earlier"), F.lit(None), F.col("size"), F.col("k")
    rows = F.array(
        run(_PLACED, size, F.col("at"), k, first, F.lit(0)),
        run(_GAP, F.lit(capacity) - size, first, k, none, none),
        run(_PIECE, size, F.col("at") + k, F.col("n") - k, none, none),
    )
    return ranked.select(F.inline(rows)).filter("n > 0 and size > 0").unionByName(gaps)


def _rounds(counts: DataFrame, capacity: int) -> DataFrame:
    """(size, at, n, sequence, offset): where the n pieces of length `size` with ranks from `at` on stand, from counts
    (size, n). The runs are tables of a few rows for each length at any number of pieces."""

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(swept([tuple(map(int, r)) for r in pdf[["kind", "size", "at", "n"]].itertuples(index=False)], capacity), columns=[c.split()[0] for c in _RUNS.split(", ")])
        return out.astype({"sequence": "Int64", "offset": "Int32"})

    state = counts.select(F.lit(_PIECE).alias("kind"), "size", F.lit(0).cast("long").alias("at"), "n", F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("int").alias("offset"))
    placed: list[DataFrame] = []
    opened, ranges = 0, RANGES
    new = state.agg(F.coalesce(F.sum(F.when(2 * F.col("size") > capacity, F.col("n"))), F.lit(0))).first()[0]
    while True:
        begun = _opened(state, new, opened, capacity) if new else state
        opened += new
        lane = ((F.col("size") - 1) * ranges / capacity).cast("int")
        todo = begun.filter(F.col("kind") < _PLACED).withColumn("lane", lane)
        done = compact(begun.filter(F.col("kind") == _PLACED).unionByName(todo.groupBy("lane").applyInPandas(sweep, _RUNS)), "pack-round")
        placed.append(done)
        left = F.col("kind") == _PIECE
        matches, pieces, tokens = done.agg(
            F.count_if(F.col("kind") == _PLACED), F.coalesce(F.sum(F.when(left, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(left, F.col("n") * F.col("size"))), F.lit(0))
        ).first()
        if not pieces:
            break
        state = done.filter(F.col("kind") < _PLACED)
        new = max(1, tokens // capacity) if ranges == 1 and not matches else 0
        ranges = 1 if ranges > 1 else RANGES
    whole = placed[0]
    for more in placed[1:]:
        whole = whole.unionByName(more)
    plan = compact(whole.filter(F.col("kind") == _PLACED).drop("kind"), "pack-plan")
    discarded(*placed)
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and its end id, cut only where longer than capacity.

    A null or empty text gives one piece, the end id; repeated rows give their pieces each.
    """
    step = F.lit(capacity)
    ids = F.concat("ids", F.lit(int(end_id).to_bytes(4, "little")))
    whole = encode(docs, tokenizer, id_col=id_col, text_col=text_col).select("doc_id", ids.alias("all"))
    n = (F.octet_length("all") / 4).cast("long")
    cut = whole.select("doc_id", "all", F.explode(F.sequence(F.lit(0), ((n - 1) / step).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    part = F.substring(F.col("all"), (start * 4 + 1).cast("int"), F.lit(capacity * 4))
    return cut.select("doc_id", "piece", start.alias("start"), (F.octet_length(part) / 4).cast("long").alias("length"), part.alias("ids"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset: as few sequences of at most capacity as best fit finds, gapless from 0.

    Pieces of one length are interchangeable, so the sorted pieces are runs of ranks, one for each length, and the
    sorted gaps runs of sequences. Each round sweeps ranges of sizes side by side for best successors (swept) and
    leaves pieces and gaps to the next, which sweeps one range of all sizes, and so on. When nothing fits, the
    longest pieces open as many sequences as the rest must fill at least. A round is a table of at most some rows
    a length, however many pieces there are; nothing is gathered by sequence, or by length in one task, so that a
    length that a third of the pieces have is as cheap as any. Pieces then look their ranks up.

    Lengths are 1 to capacity, else, and for null, an error is raised; equal pieces get places of their own; an
    empty table gives no rows; other columns are carried, but columns named sequence_id and offset are replaced.
    """
    if not 0 < capacity <= MOST_CAPACITY:
        raise ValueError(f"capacity must be from 1 to {MOST_CAPACITY}")
    src = pieces.drop("sequence_id", "offset")
    len_, task_, row_, own_, rank_ = (fresh(src, c) for c in ("_len", "_task", "_row", "_own", "_rank"))
    length = F.col(length_col).cast("int")
    checked = F.when(length.between(1, capacity), length).otherwise(F.raise_error(F.lit("a piece's length is out of range")).cast("int"))
    table = written(src.select("*", checked.alias(len_), F.spark_partition_id().alias(task_), F.monotonically_increasing_id().alias(row_)), "pack-pieces")
    ranked = table.withColumn(own_, F.row_number().over(W.partitionBy(task_, len_).orderBy(row_)) - 1)
    per_task = table.groupBy(task_, len_).agg(F.count("*").alias("_n"))
    firsts = per_task.select(task_, len_, (F.sum("_n").over(W.partitionBy(len_).orderBy(task_)) - F.col("_n")).alias("_first"))
    plan = _rounds(per_task.groupBy(F.col(len_).alias("size")).agg(F.sum("_n").alias("n")), capacity)
    runs = few(plan.select(*[F.col(c).alias(f"_run_{c}") for c in plan.columns]))
    known = ranked.alias("p").join(firsts.alias("f"), (F.col(f"p.{task_}") == F.col(f"f.{task_}")) & (F.col(f"p.{len_}") == F.col(f"f.{len_}")))
    known = known.select("p.*", (F.col(f"p.{own_}") + F.col("f._first")).alias(rank_)).alias("p")
    rank = F.col(f"p.{rank_}")
    here = (F.col(f"p.{len_}") == F.col("_run_size")) & (rank >= F.col("_run_at")) & (rank < F.col("_run_at") + F.col("_run_n"))
    return known.join(runs, here).select(
        *[F.col(f"p.{c}") for c in src.columns], (F.col("_run_sequence") + rank - F.col("_run_at")).alias("sequence_id"), F.col("_run_offset").cast("long").alias("offset")
    )

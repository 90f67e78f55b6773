"""N-gram Jaccard join by prefix filters under several global orders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import compact, discarded, few, held, texts, written
from .components import components
from .tokens import in_batches
from .words import mixed, shingles, word_hashes

#: Members up to which a prefix token's bucket is joined with itself; above, members meet its leader only.
BUCKET = 128
#: After each round buckets up to twice as large are joined with themselves, to so many times the first size.
_MOST_GROWTH = 8
#: Light members up to which they are joined with all of a larger bucket.
_FEW_LIGHTS = 16
#: Pairs of one member that meet its set in one task; the set is copied for more.
_PAIRS_A_COPY = 128
_KEY = ["n", "sig1", "sig2"]


class _Rule:
    """Sets link when b * intersection >= a * union, all integers; so their difference is at most
    (sum of sizes) * (b - a) / (b + a)."""

    def __init__(self, shingle: int, a: int, b: int):
        self.shingle, self.a, self.b = shingle, a, b
        self.least = -(-a // (b - a))  # smaller sets link with equal ones only
        self.ranked = np.uint64(min((1 << 64) - 1, ((b - a) << 65) // b))  # tokens below it, two prefixes' worth, are ranked by frequency

    def prefix(self, n: int) -> int:
        return n + (-self.a * n) // self.b + 1

    def linked(self, both: int, n: int, m: int) -> bool:
        return self.b * both >= self.a * (n + m - both)

    def difference(self, n: Column, m: Column) -> Column:
        return F.floor((n + m) * (self.b - self.a) / (self.b + self.a))

    def sizes(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * self.b >= F.greatest(n, m) * self.a


def _long(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _signed(s: np.ndarray) -> tuple[int, int, int]:
    """Size and signature of a set: the key of all texts that have it."""
    sig = np.array([mixed(s).sum(dtype=np.uint64), mixed(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return len(s), int(sig[0]), int(sig[1])


def _shingled(rule: _Rule):
    """A number, unique in the table, and the key of each text's set; also its tokens of class 0, which come first
    in every order, and the start of the others where class 0 can't fill a prefix."""
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("first", pa.binary()), ("rest", pa.list_(pa.int64()))]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                s = shingles(word_hashes(t.as_py()), rule.shingle)
                k = int(np.searchsorted(s, rule.ranked)) if len(s) >= rule.least else 0
                lacking = rule.prefix(len(s)) - k if len(s) >= rule.least else 0
                yield row, i.as_py(), *_signed(s), s[:k].tobytes(), _long(s[k : k + lacking]).tolist() if lacking > 0 else []
                row += 1

    return lambda batches: in_batches(rows(batches), schema)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tok) of the tokens in column `first`."""
    for b in batches:
        docs, first = b.column(0).to_numpy(), b.column(1)
        sizes = np.array([len(f.as_buffer()) // 8 for f in first], np.int64)
        toks = np.frombuffer(b"".join(f.as_buffer() for f in first), np.int64)
        owner = np.repeat(docs, sizes)
        for at in range(0, max(1, len(toks)), 1 << 18):
            part = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(owner[part]), pa.array(toks[part])], names=["doc", "tok"])


def _shared(tokens: DataFrame, *group: str) -> DataFrame:
    """(*group, doc, shared): array<struct<df,tok>> of a member's tokens that others of its group have too."""
    df = tokens.groupBy(*group, "tok").agg(F.count("*").alias("df")).filter("df > 1")
    return tokens.join(df, [*group, "tok"]).groupBy(*group, "doc").agg(F.collect_list(F.struct("df", "tok")).alias("shared"))


def _prefixes(members: DataFrame, slots: Column) -> DataFrame:
    """members (grp, doc, n, size, ranked, shared, rest, tied) with prefixes under three orders of the tokens.

    A member's unshared tokens come first in every order. Then order a has rare tokens first, orders b and c
    follow two hashes. What rest holds comes last.
    """
    take = F.greatest(slots - (F.col("ranked") - F.size("shared")), F.lit(0)).cast("int")

    def prefix(keys: Column) -> Column:
        return F.concat(F.transform(F.slice(F.array_sort(keys), F.lit(1), take), lambda s: s["tok"]), F.col("rest"))

    hashed = lambda seed: F.transform("shared", lambda s: F.struct(F.xxhash64(s["tok"], F.lit(seed)).alias("h"), s["tok"].alias("tok")))
    return members.select(
        "grp", "doc", "n", "size", "tied",
        (F.col("ranked") - F.size("shared")).alias("own"),
        prefix(F.col("shared")).alias("a"), prefix(hashed(1)).alias("b"), prefix(hashed(2)).alias("c"),
    ).filter(F.size("a") > 0)


def _candidates(rule: _Rule, members: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) that pass every filter, and (x, y) of members y with leaders x.

    Tokens of its own set a member apart from all others, so that two members link only if one of them is light, with
    few of its own for its size. Buckets without a light member are left out, in large ones with few lights those
    meet all members, and the members of large ones with many lights meet a leader, the one with the fewest own.
    """
    light = F.col("own") * (rule.b + rule.a) <= F.col("n") * (rule.b - rule.a)
    posts = members.select("grp", F.explode("a").alias("tok"), "doc", "n", "size", "own", "tied", light.alias("light"))
    buckets = (
        posts.groupBy("grp", "tok")
        .agg(F.count("*").alias("m"), F.count_if("light").alias("lights"), F.min(F.struct("own", "doc")).alias("lead"))
        .filter("m > 1 and lights > 0")
    )
    held = posts.join(buckets, ["grp", "tok"])
    whole, few = F.col("m") <= bucket, F.col("lights") <= _FEW_LIGHTS
    side = lambda rows, s, *more: rows.select("grp", "tok", *more, *[F.col(c).alias(f"{c}{s}") for c in ("doc", "n", "size", "own", "tied", "light")])
    sides = [side(held.filter(whole | (few & F.col("light"))), "x", "m"), side(held.filter(whole | few), "y")]
    reach = F.least(F.col("sizex") - F.col("ownx"), F.col("sizey") - F.col("owny"))  # of the intersection
    most = rule.difference(F.col("nx"), F.col("ny"))
    fits = (
        ((F.col("docx") < F.col("docy")) | ((F.col("m") > bucket) & ~F.col("lighty")))
        & rule.sizes(F.col("nx"), F.col("ny"))
        & ~(F.col("tiedx") & F.col("tiedy"))
        & (F.col("ownx") + F.col("owny") <= most)
        & (2 * reach >= F.col("sizex") + F.col("sizey") - most)
    )
    l, r = sides[0].alias("l"), sides[1].alias("r")
    met = l.join(r, (F.col("l.grp") == F.col("r.grp")) & (F.col("l.tok") == F.col("r.tok")) & fits)
    pairs = met.select(F.col("l.grp").alias("grp"), F.least("docx", "docy").alias("x"), F.greatest("docx", "docy").alias("y")).distinct()
    for side in "xy":
        other = members.select("grp", F.col("doc").alias(side), F.col("b").alias(f"b{side}"), F.col("c").alias(f"c{side}"))
        pairs = pairs.join(other, ["grp", side])
    pairs = pairs.filter(F.arrays_overlap("bx", "by") & F.arrays_overlap("cx", "cy")).select("x", "y").distinct()
    stars = held.filter(~whole & ~few & (F.col("doc") != F.col("lead.doc"))).select(F.col("lead.doc").alias("x"), F.col("doc").alias("y")).distinct()
    return pairs, stars


def _with_sets(pairs: DataFrame, made: DataFrame, side: str, other: str, temporary: list[DataFrame]) -> DataFrame:
    """pairs with the set of one side, s<side>. A set that many pairs ask for has a copy for each _PAIRS_A_COPY of
    them, so that no task gets all pairs of a leader."""
    often = pairs.groupBy(side).agg(F.ceil(F.count("*") / _PAIRS_A_COPY).cast("int").alias("copies")).filter("copies > 1")
    often = compact(often, "jaccard-often")
    temporary.append(often)
    often = few(often)
    sets = (
        made.select(F.col("row").alias(side), F.col("tokens").alias(f"s{side}"))
        .join(often, side, "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
        .drop("copies")
    )
    dealt = pairs.join(often, side, "left").withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int"))
    return dealt.drop("copies").join(sets, [side, "copy"]).drop("copy")


def _verified(rule: _Rule, src: DataFrame, every: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (x, y, star) with linked and, for stars, what y's set has more and less than x's; sets are made anew for the texts in pairs.

    Tables of numbers are written, not held: a held table's plan is part of every plan above it, once for each use, and
    the driver keeps all of them with their metrics."""
    rows = compact(pairs.select(F.col("x").alias("row")).union(pairs.select("y")).distinct(), "jaccard-rows")
    wanted = compact(every.select("row", "doc_id", *_KEY).join(few(rows), "row", "left_semi"), "jaccard-wanted")
    ids = compact(wanted.select(F.col("doc_id").alias("id")).distinct(), "jaccard-ids")
    set_schema = pa.schema([("n", pa.int32()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("tokens", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (shingles(word_hashes(t.as_py()), rule.shingle) for b in batches for t in b.column(0))
        return in_batches(((*_signed(s), s.tobytes()) for s in found), set_schema)

    asked = src.join(few(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    keyed = asked.mapInArrow(sets, "n int, sig1 long, sig2 long, tokens binary").join(few(wanted).select("row", *_KEY), _KEY)
    made = held(keyed.select("row", "tokens").dropDuplicates(["row"]))
    temporary = [rows, wanted, ids]
    both = _with_sets(_with_sets(pairs, made, "x", "y", temporary), made, "y", "x", temporary)
    out = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("star", pa.bool_()), ("linked", pa.bool_()), ("n", pa.int32()), ("more", pa.list_(pa.int64())), ("less", pa.list_(pa.int64()))])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for x, y, star, bx, by in zip(*b.columns, strict=True):
                    sx, sy = np.frombuffer(bx.as_buffer(), np.uint64), np.frombuffer(by.as_buffer(), np.uint64)
                    more, less = np.setdiff1d(sy, sx, assume_unique=True), np.setdiff1d(sx, sy, assume_unique=True)
                    star = star.as_py()
                    yield x.as_py(), y.as_py(), star, rule.linked(len(sy) - len(more), len(sx), len(sy)), len(sy), _long(more).tolist() if star else [], _long(less).tolist() if star else []

        return in_batches(rows(), out)

    seen = written(both.select("x", "y", "star", "sx", "sy").mapInArrow(compared, "x long, y long, star boolean, linked boolean, n int, more array<long>, less array<long>"), "jaccard-compared")
    made.unpersist()
    discarded(*temporary)
    return seen


def _meeting(rule: _Rule, more: Column, less: Column, shared: Column) -> Column:
    """Of the tokens that a member differs from its leader in, those that another member may have too: of what it has
    more, tokens of class 0 that no other set has were seen in the first round, as they are not in `shared`."""
    top = int(rule.ranked)
    counted = lambda t: (t >= 0) & (t < top) if top < 1 << 63 else (t >= 0) | (t < top - (1 << 64))
    return F.concat(less, F.filter(more, lambda t: ~counted(t)), F.array_intersect(F.filter(more, counted), shared))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) for every document, and the links (x, y) found between representatives,
    each the smallest doc_id that has its set.

    A document's set is the distinct runs of `shingle` words (A-Z lower-cased) of its whole text, or its one
    shorter sequence; two documents link when 100 * intersection >= percent * union. component_id is the
    smallest doc_id that links reach. Sets are compared as 64-bit hashes of their members.

    Documents with equal sets are one representative. Representatives meet where they share
    a token in their prefixes: one under an order with rare tokens first, and then also one each under two hash
    orders. To save counting, one token class comes first in all orders, and only its tokens are counted. In a
    bucket of more than `bucket` members, those with few tokens of their own are compared with all if they are few;
    if they are many, all are compared with a leader, and then with each other only by what they differ from it in:
    two sets differ as much as their differences from the leader do, and two that could link without sharing any of
    those are both linked to the leader. So copies in any number cost a comparison each, and no link between
    different texts is lost: documents that link end in one component, by way of verified links.

    A null or empty text, or one without words, has an empty set and links with nothing; a row that repeats a
    doc_id is a document of its own; a null doc_id is never a component_id unless no other is reached; an empty
    table gives no rows; other input columns are ignored.
    """
    if not 0 < percent < 100:
        raise ValueError("percent must be between 0 and 100")
    rule = _Rule(shingle, percent, 100)
    src = texts(docs, id_col, text_col)
    every = written(src.mapInArrow(_shingled(rule), "row long, doc_id long, n int, sig1 long, sig2 long, first binary, rest array<long>"), "jaccard-every")
    classes = every.filter("n > 0").groupBy(*_KEY).agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("size"))
    copied = classes.filter("size > 1").select(*_KEY, "rep")
    copies = compact(every.select("row", *_KEY).join(copied, _KEY).filter("row <> rep").select("row"), "jaccard-copies")
    roots = every.filter(F.col("n") >= rule.least).join(few(copies), "row", "left_anti").select(F.col("row").alias("doc"), "n", "first", "rest")
    spread = roots.select("doc", "first").mapInArrow(_spread, "doc long, tok long")
    none = F.array().cast("array<struct<df:bigint,tok:bigint>>")
    met = written(_shared(spread), "jaccard-shared")
    counted = met.select("doc", F.col("shared")["tok"].alias("toks"))
    members = (
        roots.select("doc", "n", "rest", (F.octet_length("first") / 8).cast("int").alias("ranked"))
        .join(met, "doc", "left")
        .select(F.lit(0).cast("long").alias("grp"), "doc", "n", F.col("n").alias("size"), "ranked", F.coalesce("shared", none).alias("shared"), "rest", F.lit(False).alias("tied"))
    )
    slots = F.col("n") - F.ceil(F.col("n") * rule.a / rule.b) + 1
    links: list[DataFrame] = []
    rounds, left = 0, None
    while True:
        prefixed = written(_prefixes(members, slots), "jaccard-prefixes")
        pairs, stars = _candidates(rule, prefixed, bucket * min(_MOST_GROWTH, 1 << rounds))
        rounds += 1
        asked = compact(
            pairs.withColumn("star", F.lit(False)).unionByName(stars.withColumn("star", F.lit(True))).groupBy("x", "y").agg(F.max("star").alias("star")),
            "jaccard-pairs",
        )
        discarded(prefixed)
        if asked.isEmpty():
            break
        seen = _verified(rule, src, every, asked)
        discarded(asked)
        links.append(compact(seen.filter("linked").select("x", "y"), "jaccard-links"))
        star = seen.filter("star")
        open_ = star.filter("not linked").select("x").distinct()
        named = star.join(open_, "x", "left_semi").select(F.col("x").alias("grp"), F.col("y").alias("doc"), "n", "linked", "more", "less")
        known = named.join(counted, "doc", "left").withColumn("toks", F.coalesce("toks", F.array().cast("array<bigint>")))
        meeting = _meeting(rule, F.col("more"), F.col("less"), F.col("toks")).alias("meeting")
        last, left = left, written(known.select("grp", "doc", "n", "linked", (F.size("more") + F.size("less")).alias("size"), meeting), "jaccard-left")
        discarded(seen, *([last] if last else []))
        if left.isEmpty():
            break
        shared = _shared(left.select("grp", "doc", F.explode("meeting").alias("tok")), "grp")
        members = left.join(shared, ["grp", "doc"]).select(
            "grp", "doc", "n", "size", F.col("size").alias("ranked"), "shared", F.array().cast("array<long>").alias("rest"), F.col("linked").alias("tied"),
        )
        slots = F.floor(F.col("n") * (rule.b - rule.a) / rule.a) + 1
    found = reduce(DataFrame.unionByName, links) if links else docs.sparkSession.createDataFrame([], "x long, y long")
    parts = components(found).select(F.col("id").alias("rep"), "component")
    named = classes.join(parts, "rep", "left").select(*_KEY, "rep", "least", "component")
    linked, alone = named.filter("component is not null"), named.filter("component is null")  # most are alone: no key of a join
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    told = linked.join(least, "component").select(*_KEY, "rep", "least", "component_id")
    named = compact(told.unionByName(alone.select(*_KEY, "rep", "least", F.col("least").alias("component_id"))), "jaccard-classes")
    result = every.select("doc_id", *_KEY).join(named.select(*_KEY, "component_id"), _KEY, "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    of = lambda side: named.select(F.col("rep").alias(side), F.col("least").alias(f"{side}_id"))
    told = found.join(of("x"), "x").join(of("y"), "y").select(F.col("x_id").alias("x"), F.col("y_id").alias("y"))
    return result, told

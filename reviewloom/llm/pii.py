"""Personal data: fixed patterns, and identifiers that their contexts give away. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import compact, discarded, fresh, texts, written

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
#: The graph has settled when no further pattern or value is sure and no confidence rose by as much.
SETTLED = 0.01
#: Least share of sure identifiers among what a pattern's context holds, and least distinct ones of them.
LEAST_SCORE, LEAST_SEEDS = 0.8, 3

#: Each matches what its kind's plain pattern would, leftmost and without overlap, in time linear in the text: a
#: run of characters is entered at its start or where the last match ended, and never given back.
_WHOLE_RUN = r"(?:(?<![A-Za-z0-9._%+-])|\G)"
_PATTERNS = {
    "email": _WHOLE_RUN + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A word with a digit or an at sign. Such a word counts if it has an at sign, five digits, or a letter and five
#: letters and digits.
_CANDIDATE = r"(?<!\S)[^\s@0-9]*+[0-9@]\S*+"
#: Words with digits, one blank between them: as many as there are in a row, at least two.
_NUMBERED = r"[^\s@0-9]*+[0-9][^\s@]*+(?!\S)"
_RUN = rf"(?<!\S){_NUMBERED}(?:[^\S\n]{_NUMBERED})++"
#: Letters and digits of the longest identifier written with blanks, an account number.
_LONGEST = 34
_MARKS = r"""[\s.,;:!?()\[\]{}"'<>]"""
#: Marks before an identifier; a bracket that is closed within it is its own.
_HEAD_MARKS = r"""^(?:(?!\()[\s.,;:!?()\[\]{}"'<>]|\((?![^()]*\)[^()]*[\p{L}0-9]))+"""
#: Matches whose places are summed at a time.
_SLICE = 256
_EMPTY = "array<struct<start:int,stop:int,value:string,patterns:array<string>>>"


def _hits(text: Column, pattern: str) -> Column:
    """array<struct<start,stop,value,before,after>> of a pattern's matches in code points; before and after are
    what stands around, with the neighbouring match. What lambdas need is zipped in, so that it is made once."""
    made = F.array(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")))
    return F.element_at(F.transform(made, lambda m: _placed(m["gaps"], m["found"])), 1)


def _starts(sizes: Column) -> Column:
    """Where each match starts, from the lengths of gaps and matches. Sums run over slices of _SLICE matches, so that
    no array of all the starts so far is copied for each match."""

    def within(part: Column, at: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(at.alias("at"), F.array().cast("array<int>").alias("all")),
            lambda acc, x: F.struct((acc["at"] + x["gap"] + x["match"]).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x["gap"])).alias("all")),
        )

    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _SLICE).cast("int")), lambda i: F.slice(sizes, i * _SLICE + 1, F.lit(_SLICE)))
    return F.aggregate(
        slices,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all")),
        lambda acc, part: F.element_at(
            F.transform(F.array(within(part, acc["at"])), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["all"], F.array(r["all"])).alias("all"))), 1
        ),
        lambda acc: F.flatten(acc["all"]),
    )


def _placed(gaps: Column, found: Column) -> Column:
    """The structs of _hits from matches and what is between them."""
    none = F.array(F.lit(""))
    pairs = F.arrays_zip(found.alias("v"), gaps.alias("g"))  # one more gap than matches
    sizes = F.transform(pairs, lambda x: F.struct(F.length(x["g"]).alias("gap"), F.coalesce(F.length(x["v"]), F.lit(0)).alias("match")))
    starts = F.element_at(F.transform(F.array(sizes), _starts), 1)
    rest = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    rows = F.arrays_zip(
        found.alias("v"), starts.alias("s"), gaps.alias("g"), F.concat(none, found).alias("v0"), rest(gaps).alias("g1"), rest(found).alias("v1")
    )
    return F.transform(
        F.filter(rows, lambda x: x["v"].isNotNull()),
        lambda x: F.struct(
            x["s"].alias("start"),
            (x["s"] + F.length(x["v"])).alias("stop"),
            x["v"].alias("value"),
            F.right(F.concat(x["v0"], x["g"]), F.lit(48)).alias("before"),
            F.substring(F.concat(x["g1"], F.coalesce(x["v1"], F.lit(""))), 1, 32).alias("after"),
        ),
    )


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    return (
        F.aggregate(
            F.sequence(F.lit(1), F.length(digits)),
            F.lit(0),
            lambda total, i: total
            + F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(
                F.element_at(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]), F.substring(back, i, F.lit(1)).cast("int") + 1)
            ),
        )
        % 10
        == 0
    )


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _patterns(before: Column, after: Column) -> Column:
    """The patterns that whole words around a place make: the two words before, and the word before with the word
    after; digits count as one digit. Words of marks and digits alone, such as the bars of a table, make none."""
    before, after = F.regexp_replace(F.lower(before), "[0-9]", "9"), F.regexp_replace(F.lower(after), "[0-9]", "9")
    two, one = F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1), F.regexp_extract(before, r"(\S+)\s*$", 1)
    nxt = F.regexp_extract(after, r"^\s*(\S+)", 1)
    return F.array_compact(
        F.array(
            F.when(two.rlike(r"\p{L}"), F.concat(F.regexp_replace(two, r"\s+", " "), F.lit(" _"))),
            F.when((one != "") & (nxt != "") & F.concat(one, nxt).rlike(r"\p{L}"), F.concat(one, F.lit(" _ "), nxt)),
        )
    )


def _base(text: Column, kind: str) -> Column:
    """Valid matches of a kind with the patterns of their contexts, the words that a match begins or ends in left
    out; texts without the sign that all its matches have are not searched."""
    sign = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike(r"[0-9][ .-]?[0-9]" if kind == "card" else r"[0-9]\.[0-9]"))
    around = lambda h: _patterns(F.regexp_replace(h["before"], r"\S+$", ""), F.regexp_replace(h["after"], r"^\S+", ""))
    spans = F.transform(
        F.filter(_hits(text, _PATTERNS[kind]), lambda h: _valid(kind, h["value"])),
        lambda h: F.struct(h["start"], h["stop"], h["value"], around(h).alias("patterns")),
    )
    return F.when(sign, spans).otherwise(F.array().cast(_EMPTY))


def _candidates(text: Column) -> Column:
    """Words and runs of words that may be identifiers, without the marks around them, and the patterns that their
    contexts make."""

    def trimmed(h: Column) -> Column:
        tail = F.regexp_replace(h["value"], _HEAD_MARKS, "")
        head = F.length(h["value"]) - F.length(tail)
        bare = F.regexp_replace(tail, f"{_MARKS}+$", "")
        return F.struct(
            (h["start"] + head).alias("start"),
            (h["start"] + head + F.length(bare)).alias("stop"),
            bare.alias("value"),
            _patterns(h["before"], h["after"]).alias("patterns"),
        )

    is_word = lambda v: F.contains(v, F.lit("@")) | (count(v, "0-9") >= 5) | (v.rlike(r"\p{L}") & (count(v, r"\p{L}0-9") >= 5))
    count = lambda v, kept: F.length(F.regexp_replace(v, f"[^{kept}]", ""))
    runs = F.filter(_hits(text, _RUN), lambda h: (count(h["value"], "0-9") >= 5) & (count(h["value"], r"\p{L}0-9") <= _LONGEST))
    found = F.filter(F.transform(F.concat(F.filter(_hits(text, _CANDIDATE), lambda h: is_word(h["value"])), runs), trimmed), lambda c: c["stop"] > c["start"])
    return F.when(text.rlike("[@0-9]"), found).otherwise(F.array().cast(_EMPTY))


def induced(occurrences: DataFrame, least_score: float = LEAST_SCORE, least_seeds: int = LEAST_SEEDS) -> tuple[DataFrame, DataFrame]:
    """Patterns and values that the seeds in occurrences (pattern, value, seed) make sure: (pattern), (value).

    Seeds have confidence 1. In each round a pattern gets the mean confidence of the distinct values that stand in
    it, or none if fewer than least_seeds of them are sure, and each other value the chance that one of its
    patterns is right. No confidence ever falls, so rounds go on until they have settled. Occurrences are first
    summed to distinct pairs.
    """
    edges = compact(occurrences.groupBy("pattern", "value").agg(F.max(F.col("seed").cast("double")).alias("seed")), "pii-edges")
    values, before = edges.groupBy("value").agg(F.max("seed").alias("conf")), None
    while True:
        scored = (
            edges.join(values.select("value", "conf"), "value")
            .groupBy("pattern")
            .agg(F.avg("conf").alias("score"), F.sum((F.col("conf") >= least_score).cast("int")).alias("sure"))
            .filter(F.col("sure") >= least_seeds)
        )
        patterns = compact(scored, "pii-patterns")
        doubt = F.exp(F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.95)))))
        own = values.select("value", F.col("conf").alias("last"))
        conf = (
            edges.join(patterns, "pattern", "left").groupBy("value").agg(F.max("seed").alias("seed"), doubt.alias("doubt"))
            .select("value", F.greatest("seed", 1 - F.col("doubt")).alias("conf"))
        )
        values = compact(conf.join(own, "value").select("value", "conf", "last"), "pii-values")
        sure = lambda c: F.count_if(F.col(c) >= least_score)
        now = (patterns.agg(sure("score")).first()[0], *values.agg(sure("conf"), F.count_if(F.col("conf") - F.col("last") >= SETTLED)).first())
        if now[2] == 0 and now[:2] == before:
            break
        before = now[:2]
    return patterns.filter(F.col("score") >= least_score).select("pattern"), values.filter(F.col("conf") >= least_score).select("value")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, spans): spans is array<struct<kind,start,stop>> in code points, stop exclusive, kinds as
    in KINDS and then `context`, each in the order of the text.

    Base matches are those of the fixed patterns that pass their kind's test. They are the seeds: the words
    around them are lexical patterns, which rounds over the graph of patterns and values score until it settles;
    candidates in a pattern that is sure enough, and sure enough themselves, are added where no base match stands,
    of two that overlap the one that begins first, or else the longer. Patterns see the 48 characters before a place
    and the 32 after it.

    A null or empty text has no spans; an empty table gives no rows; repeated rows give a row each; other input
    columns are ignored.
    """
    src = texts(docs, id_col, text_col)
    text = F.col("text")
    found = written(
        src.select("doc_id", F.xxhash64("text").alias("text_hash"), *[_base(text, k).alias(k) for k in KINDS], _candidates(text).alias("candidates")),
        "pii-found",
    )
    taken = F.flatten(F.array(*[F.col(k) for k in KINDS]))
    free = F.filter("candidates", lambda c: ~F.exists("taken", lambda b: (b["start"] < c["stop"]) & (b["stop"] > c["start"])))
    told = lambda spans, seed: F.transform(spans, lambda c: F.struct(c["start"], c["stop"], c["value"], c["patterns"], F.lit(seed).alias("seed")))
    occurrences = (
        found.withColumn("taken", taken)
        .select("doc_id", "text_hash", F.explode(F.concat(told(F.col("taken"), True), told(free, False))).alias("c"))
        .select("doc_id", "text_hash", "c.start", "c.stop", "c.value", "c.seed", F.explode("c.patterns").alias("pattern"))
    )
    patterns, values = induced(occurrences)
    earlier = W.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("stop")).rowsBetween(W.unboundedPreceding, -1)
    more = (
        occurrences.filter("not seed")
        .join(patterns, "pattern", "left_semi")
        .join(values, "value", "left_semi")
        .select("doc_id", "text_hash", "start", "stop")
        .distinct()
        .withColumn("reached", F.coalesce(F.max("stop").over(earlier), F.lit(0)))
        .filter(F.col("start") >= F.col("reached"))
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("more"))
        .select(F.col("doc_id").alias("more_id"), F.col("text_hash").alias("more_hash"), "more")
    )
    named = lambda kind, spans: F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    extra = F.coalesce("more", F.array().cast("array<struct<start:int,stop:int>>"))
    same = F.col("doc_id").eqNullSafe(F.col("more_id")) & (F.col("text_hash") == F.col("more_hash"))
    return found.join(more, same, "left").select("doc_id", "text_hash", F.concat(*[named(k, F.col(k)) for k in KINDS], named(CONTEXT, extra)).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of its text replaced by its kind in angle brackets; overlapping spans become the first
    of them. Null texts stay null; all columns and their order are kept."""
    id_, hash_, spans_ = (fresh(docs, c) for c in ("_id", "_hash", "_spans"))
    found = personal_data(docs, id_col, text_col).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    spans = found.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("spans").alias(spans_))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_)), "left")
    ordered = F.array_sort(F.transform(F.col(spans_), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    built = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["stop"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    clean = F.when(F.col(spans_).isNotNull(), built).otherwise(F.col(text_col))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])

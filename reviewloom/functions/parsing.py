"""Column functions that parse numbers, dates, links and identifiers of scraped records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: texts that stand for a missing number.
MISSING = ("", "na", "n/a")


def number(x: Column, kind: str = "double") -> Column:
    """x as a number, null where it is missing or none; thousands separators go, a percent sign divides by 100."""
    bare = F.replace(F.trim(x), F.lit(","), F.lit(""))
    value = F.when(F.lower(bare).isin(*MISSING), None).otherwise(bare)
    share = F.when(value.endswith("%"), F.expr("try_cast(null as double)"))
    plain = value.try_cast("double")
    percent = F.rtrim(F.replace(value, F.lit("%"), F.lit(""))).try_cast("double") / 100
    return F.coalesce(share, F.when(value.endswith("%"), percent).otherwise(plain)).cast(kind)


def ten_thousands(x: Column) -> Column:
    """1.5w is 15000; other numbers are taken whole."""
    w = F.regexp_extract(x, "^([0-9.]+)w$", 1)
    return F.when(w != "", (w.try_cast("double") * 10000).cast("long")).otherwise(x.try_cast("long"))


def unless(x: Column, missing: int = -1) -> Column:
    return F.nullif(x, F.lit(missing))


def month_day_year(x: Column) -> Column:
    """'Jan 5, 2024' as a date; null for anything else."""
    return F.try_to_timestamp(x, F.lit("MMM d, yyyy")).cast("date")


def cjk_date(x: Column) -> Column:
    return F.try_to_timestamp(x, F.lit("yyyy'年'M'月'd'日'")).cast("date")


def to_utc(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_utc_timestamp(ts, zone)


def relative_day(x: Column, today: Column, words: tuple[str, str, str] = ("today", "yesterday", "day before")) -> Column:
    """The date that a word for today, yesterday or the day before names; else the text as yyyy-MM-dd."""
    days = [F.when(x.startswith(w), F.date_sub(today, i)) for i, w in enumerate(words)]
    return F.coalesce(*days, F.try_to_timestamp(F.substring(x, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def page_offsets(total: Column, size: int) -> Column:
    """First offsets of the pages that hold `total` records; none without records."""
    return F.when(total > 0, F.sequence(F.lit(0).cast("long"), total.cast("long") - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<long>"))


def domain(url: Column) -> Column:
    """scheme://host/ of a link."""
    return F.concat(F.regexp_extract(url, "^([a-z]+)://([^/]+)", 1), F.lit("://"), F.regexp_extract(url, "^([a-z]+)://([^/]+)", 2), F.lit("/"))


def decoded(url: Column) -> Column:
    """URL-decoded, a plus as a blank."""
    return F.replace(F.try_url_decode(url), F.lit("+"), F.lit(" "))


def json_repaired(x: Column) -> Column:
    """A loose JavaScript object as JSON: bare keys and single-quoted values get double quotes, trailing commas go."""
    x = F.regexp_replace(x, "([{,]\\s*)([A-Za-z_][A-Za-z0-9_]*)\\s*:", '$1"$2":')
    x = F.regexp_replace(x, ":\\s*'([^']*)'", ':"$1"')
    return F.regexp_replace(x, ",\\s*([}\\]])", "$1")


#: A script's tokens: texts in quotes, names, numbers, marks.
_SCRIPT = r'''"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|[A-Za-z_$][\w$]*+|-?[0-9]++(?:\.[0-9]++)?|\|\||[{}\[\]:,()]'''


def page_data(x: Column) -> Column:
    """The object in a page's script, from the first brace to the last, as JSON.

    Names get quotes and texts double ones; what stands after || goes, as do calls of encodeURIComponent (their value
    stays), brackets, commas before a closing brace and zeros before a number; a name that is no key is null. In texts
    line ends go, a word in doubled quotes at the beginning loses the inner ones, n\\\\a is n/a, and another backslash
    between letters or digits is a blank. What stands in a text is never taken for a name or a mark.
    """
    body = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    bare = F.regexp_replace(F.replace(body, F.lit("\n"), F.lit("")), r''':\s*""(\w+)"''', r''': "$1''')
    tokens = F.regexp_extract_all(bare, F.lit(_SCRIPT), F.lit(0))

    def quoted(t: Column) -> Column:
        inner = F.regexp_replace(F.substr(t, F.lit(2), F.length(t) - 2), r"\\'", "'")
        inner = F.when(t.startswith("'"), F.regexp_replace(inner, r'''(?<!\\)"''', r'''\\"''')).otherwise(inner)
        inner = F.regexp_replace(F.regexp_replace(inner, r"(?i)n\\{2,}a", "n/a"), r"(\w)\\(?=\w)", "$1 ")
        return F.concat(F.lit('"'), inner, F.lit('"'))

    def shown(z: Column) -> Column:
        t, before, after = z["t"], z["before"], z["after"]
        text = t.rlike("^[\"']")
        gone = (t == "||") | before.eqNullSafe(F.lit("||")) | t.isin("(", ")", "encodeURIComponent") | ((t == ",") & after.isin("}", "]"))
        name = t.rlike("^[A-Za-z_$]")
        key = after.eqNullSafe(F.lit(":"))
        return (
            F.when(F.coalesce(gone, F.lit(False)), "").when(text, quoted(t)).when(name & key, F.concat(F.lit('"'), t, F.lit('"')))
            .when(name & ~t.isin("true", "false", "null"), "null").when(t.rlike("^-?0[0-9]"), F.regexp_replace(t, "^(-?)0+(?=[0-9])", "$1")).otherwise(t)
        )

    # each token with its neighbours, so that tokens are made a few times a row and not once a token
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))))
    beside = F.arrays_zip(tokens.alias("t"), before.alias("before"), F.slice(tokens, F.lit(2), F.size(tokens)).alias("after"))
    return F.array_join(F.transform(F.filter(beside, lambda z: z["t"].isNotNull()), shown), "")


def plain_html(x: Column) -> Column:
    """Text of a page: tags as blanks, runs of white space as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), "[ \\t\\n\\r]+", " "))


def links(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit('href="([^"]*)"'), F.lit(1))


#: Penn tags by their beginning and the word classes of a lexicon's keys.
WORD_CLASSES = {"JJ": "a", "RB": "r", "NN": "n", "VB": "v"}
#: Curly quotes and the plain ones for them.
_CURLY, _PLAIN = "‘’“”", "''\"\""


def word_class(tag: Column) -> Column:
    """a, r, n or v for adjectives, adverbs, nouns and verbs; null for other tags."""
    first = F.left(tag, F.lit(2))
    return F.coalesce(*[F.when(first == k, F.lit(v)) for k, v in WORD_CLASSES.items()])


def plain_quotes(x: Column) -> Column:
    """Curly quotes as straight ones."""
    return F.translate(x, _CURLY, _PLAIN)


def first_letters_or_mark(x: Column) -> Column:
    """The first run of ASCII letters or sentence mark ###; empty without one."""
    return F.regexp_extract(x, "[a-zA-Z]+|#{3}", 0)


def as_ratio(x: Column) -> Column:
    """'3 of 5' as 3/5."""
    return F.regexp_replace(F.trim(x), r"^([0-9]+)\s+of\s+([0-9]+)$", "$1/$2")


def ratio_head(x: Column) -> Column:
    """The number before the slash of '4/5'."""
    return F.get(F.split(as_ratio(x), "/"), 0).try_cast("int")


def amount_before(x: Column, unit: str) -> Column:
    """The number, thousands separators left out, that stands before a unit: 12,500 for miles, 31.5 for hrs."""
    found = F.regexp_extract(x, rf"([0-9][0-9,]*(?:\.[0-9]+)?)\s*{unit}", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def date_of_parts(x: Column) -> Column:
    """y-m-d as a date; texts with another number of parts, such as a month and day alone, give null."""
    parts = F.split(x, "-")
    at = lambda i: F.get(parts, i).try_cast("int")
    text = F.format_string("%04d-%02d-%02d", at(0), at(1), at(2))
    return F.when(F.size(parts) == 3, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def folder_day(ts: Column) -> Column:
    """yyyyMMdd, the name of a day's folder."""
    return F.date_format(ts, "yyyyMMdd")


def file_label(path: Column) -> Column:
    """The label in a name such as reviews__pos.csv; null without one."""
    return F.nullif(F.regexp_extract(path, r".+__(\w+)\.csv$", 1), F.lit(""))


def unsplit_csv(path: Column) -> Column:
    """Whether a file is a CSV file that no split has made."""
    return path.endswith(".csv") & ~F.contains(path, F.lit("_split_"))


def output_name(path: Column, ending: str) -> Column:
    """The path of what is made from a file: its name without extension, then the ending."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(ending))


def report_line(*cells: tuple[Column, int]) -> Column:
    """Cells, each cut and padded to its width, in a row."""
    return F.concat(*[F.rpad(c.cast("string"), n, " ") for c, n in cells])


#: Patterns of the identifiers in links, by what they name.
LINK_IDS = {
    "store": r"^http.*/([0-9]+)/[0-9]+",
    "review": r"^http.*/[0-9]+/([0-9]+)",
    "profile": r"^http.*/profiles/([0-9]+)",
    "forum": r"forumdisplay\.php\?fid=([0-9]+)",
    "user": r"uid=([0-9]+)",
    "topic": r"/topic/([0-9]+)",
    "company": r"/company/([0-9]+)/kuchikomi",
}


def link_id(url: Column, kind: str) -> Column:
    """The identifier of that kind in a link; null without one."""
    return F.nullif(F.regexp_extract(url, LINK_IDS[kind], 1), F.lit("")).try_cast("long")


def recommendation(x: Column) -> tuple[Column, Column]:
    """(given, out of) of a text such as '(1-10): 8'; null for others."""
    found = lambda i: F.nullif(F.regexp_extract(x, r"\(1-([0-9]+)\):\s*([0-9]+)", i), F.lit("")).try_cast("int")
    return found(2), found(1)

"""WARC archives, fill-in-middle and lexical search against brute force, with nulls, empty and long texts and repeats."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import queries as Q
from reviewloom.llm.common import new_path
from reviewloom.llm.infill import WaveletMatrix, bisected, classes, infilled, restored, units
from reviewloom.llm.lexical import build_index, search
from reviewloom.llm.warc import Damaged, read_archives, records_of, resolved, write_archives

SF = "/root/testdata/sf0.001"
EXTRA = "ids binary, rank int, first_id long, n int, segment long, _name int, h1 int"


@pytest.mark.parametrize("name", ["op9_top_k", "op10_exact_dedup", "op11_warc", "op12_fill_in_middle", "op13_lexical_search"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


# WARC


def page_rows():
    big, small = "<p>été</p>" * 30, "x" * 99
    rows = [(i, f"http://a/{i}", t) for i, t in enumerate([big, big, small, small, None, "", "y" * 100, "y" * 100, "z\r\n\r\n" * 50000])]
    rows += [(-3, None, big), (None, "http://b/ c\r\nX: 1", big), (None, "", "only here, without an identifier" * 9), (6, "http://a/6", "y" * 100), (50, "u", "WARC/1.1\r\n\r\n\r\n" * 20)]
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, b"x", 1, 2, 3, 4, 5, 6) for r in page_rows()], "page_id long, url string, html string, " + EXTRA).repartition(3).cache()


def test_archives(spark, pages):
    rows = page_rows()
    manifest = write_archives(pages, new_path(spark, "warc"), file_bytes=2000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = resolved(read_archives(manifest)).collect()
    want = Counter()
    for i, _, t in rows:
        data = (t or "").encode()
        same = [j for j, _, x in rows if j is not None and (x or "").encode() == data]
        seen = len(data) >= 100 and same and i != min(same)
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if seen else "response", min(same) if seen else None, None if seen else data)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert all(r.found for r in got if r.record_type == "revisit") and all(r.damage is None for r in got)
    assert {r.url for r in got} == {f"http://a/{i}" for i in range(9)} | {None, "http://b/%20c%0D%0AX:%201", "", "u"}
    assert read_archives(write_archives(pages.limit(0), new_path(spark, "warc"))).count() == 0


def archive(spark, pages):
    manifest = write_archives(pages.coalesce(1), new_path(spark, "warc"))
    path = manifest.first()["path"].removeprefix("file://")
    with open(path, "rb") as f:
        return f.read()


def test_a_foreign_reader_reads_each_member(spark, pages):
    data, heads = archive(spark, pages), []
    while data:
        d = zlib.decompressobj(31)
        record = d.decompress(data)
        data = d.unused_data
        head, _, body = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert body[int(fields["Content-Length"]) :] == b"\r\n\r\n"
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(body[:-4]).hexdigest()
        heads.append(fields["WARC-Type"])
    assert heads[0] == "warcinfo" and Counter(heads[1:]) == {"response": 10, "revisit": 4}


def test_damage_is_found(spark, pages):
    data = archive(spark, pages)
    members, rest = [], data
    while rest:
        d = zlib.decompressobj(31)
        d.decompress(rest)
        members.append(rest[: len(rest) - len(d.unused_data)])
        rest = d.unused_data
    plain = [zlib.decompress(m, 31) for m in members]
    pack = lambda b: (c := zlib.compressobj(1, zlib.DEFLATED, 31)).compress(b) + c.flush()
    at = next(i for i, p in enumerate(plain) if b"yyyy" in p)

    def read(changed):
        return list(records_of(io.BytesIO(b"".join([*members[:at], changed, *members[at + 1 :]])), strict=False))

    whole = len(read(members[at]))
    for changed in (plain[at].replace(b"yyyy", b"yyzy", 1), plain[at] + b"more", plain[at].replace(b"Content-Length: ", b"Content-Length: 9", 1), plain[at].replace(b"WARC/1.1", b"WARC/9.9"), b"no head"):
        got = read(pack(changed))
        assert len(got) == whole and [r["damage"] is not None for r in got].count(True) == 1
        with pytest.raises(Damaged):
            list(records_of(io.BytesIO(pack(changed))))
    broken = bytearray(members[at])
    broken[len(broken) // 2] ^= 255
    assert [r["damage"] is not None for r in read(bytes(broken))][-1] and read(members[at][:-9])[at - 1]["damage"]
    lost = spark.createDataFrame([("revisit", "urn:1", "urn:2", "d", 5, 1)], "record_type string, record_id string, refers_to_record string, payload_digest string, payload_bytes long, page_id long")
    assert [r.found for r in resolved(lost).collect()] == [False]


# fill-in-middle


def doc_rows():
    rng = random.Random(8)
    parts = ["\n", "a line\n", "two words ", "été", "😀\n", "\r\n", "<", "S>", "<P", " \t", "。"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    return [(i, t) for i, t in enumerate([None, "", "\n", "a", "a\n", "a\nb", "\n\n\n", "x<M>y\nz", "<S>", "no end " * 20000, "é\n" * 30000, *made])] + [(3, "a"), (None, "one\ntwo\n"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, b"x", 1, 2, 3, 4, 5, 6) for r in doc_rows()], "doc_id long, text string, " + EXTRA).repartition(3).cache()


@pytest.mark.parametrize("size", [0, 1, 7, 511, 512, 513, 5000])
def test_wavelet_matrix(size):
    row = np.random.default_rng(size).integers(0, 4, size).astype(np.uint8)
    matrix = WaveletMatrix(row)
    for c in range(4):
        places = np.flatnonzero(row == c).tolist()
        for i in {0, size // 3, size // 2, size}:
            assert matrix.rank(c, i) == int((row[:i] == c).sum())
        for k in {1, len(places) // 2, len(places)} - {0}:
            if k <= len(places):
                assert matrix.select(c, k) == places[k - 1]
    assert bisected(lambda i: i, 5, 9) == 6
    assert classes("a \n.é\t").tolist() == [3, 1, 0, 2, 3, 1]


UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t\r\v\f\n]*[^ \t\r\v\f\n.!?]+|[ \t\r\v\f\n]+", "char": r"(?s)."}


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_infilling(docs, unit):
    rows = doc_rows()
    got = infilled(docs, seed=7, unit=unit, rate=80, spm_rate=50).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    forms = Counter()
    for r in got:
        text = r.back
        cuts = re.findall(r"[ \t\r\v\f\n]*[^ \t\r\v\f\n]+|[ \t\r\v\f\n]+" if unit == "word" else UNIT[unit], text)
        h = hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        assert r.n == len(cuts), (text, unit)
        if not text or re.search("<[PSM]>", text) or h3 % 100 >= 80:
            assert (r.form, r.prefix_chars, r.middle_chars, r.output) == ("plain", None, None, text)
        else:
            a, b = sorted((h1 % (len(cuts) + 1), h2 % (len(cuts) + 1)))
            p, m, s = "".join(cuts[:a]), "".join(cuts[a:b]), "".join(cuts[b:])
            form = "spm" if h4 % 100 < 50 else "psm"
            want = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
            assert (r.form, r.prefix_chars, r.middle_chars, r.output) == (form, len(p), len(m), want)
        forms[r.form] += 1
    assert len(forms) == 3
    assert infilled(docs.limit(0)).count() == 0


def test_units_of_a_text():
    own = units("one\n\ntwo", "line")
    assert own.total == 3 and [own.end(k) for k in range(4)] == [0, 4, 5, 8]
    assert units("", "word").total == 0 and units("  ", "word").total == 1
    with pytest.raises(ValueError):
        infilled(None, unit="page")


# lexical search


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked_by_hand(docs, items, k):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    full = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(full), sum(sum(c.values()) for _, c in full)
    df = Counter(t for _, c in full for t in c)
    queries = defaultdict(set)
    for i, t in items:
        queries[i] |= set(terms_of(t))
    out = {}
    for item, terms in queries.items():
        scored = []
        for doc, c in full:
            n = sum(c.values())
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out[item] = [(r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def search_tables(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Été", "日本", "É"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(500)] + [(900, None), (901, ""), (902, "..."), (903, "THE " * 4000), (None, text(20)), (7, text(9)), (7, text(9))]
    docs += [(1000 + i, "one copy of many w1 w2") for i in range(80)]
    items = [(i, text(rng.randint(1, 12))) for i in range(40)] + [(50, None), (51, "absent"), (52, "w1"), (53, "one copy"), (54, "Copy! w1, the"), (3, "w2 w3"), (None, "w1 w4")]
    return docs, items


@pytest.mark.parametrize(("k", "block", "segment"), [(10, 1 << 18, 3000), (3, 100, 1 << 20), (50, 1 << 18, 1)])
def test_search(spark, k, block, segment):
    docs, items = search_tables(k)
    df = spark.createDataFrame([(*r, b"x", 1, 2, 3, 4, 5, 6) for r in docs], "doc_id long, text string, " + EXTRA).repartition(4)
    asked = spark.createDataFrame([(*r, 1, "d") for r in items], "item_id long, text string, df int, term string")
    got = defaultdict(list)
    for r in search(build_index(df, segment_bytes=segment), asked, k, block_terms=block).collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    want = {i: rows for i, rows in ranked_by_hand(docs, items, k).items() if rows}
    assert {i: sorted(rows) for i, rows in got.items()} == want


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(build_index(docs.limit(0)), items).count() == 0
    assert search(build_index(docs), items.limit(0)).count() == 0
    assert search(build_index(docs), spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0

"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import jaccard
from reviewloom.llm import queries as Q
from reviewloom.llm.bpe import concatenated, decode, encode, tree_ids
from reviewloom.llm.common import new_path
from reviewloom.llm.components import components
from reviewloom.llm.dedup import exact_dedup
from reviewloom.llm.jaccard import near_duplicates
from reviewloom.llm.packing import pack, swept, token_pieces
from reviewloom.llm.pii import personal_data, redacted
from reviewloom.llm.quality import score_quality
from reviewloom.llm.sharding import difference, shard_documents
from reviewloom.llm.sstable import lookup, read_table, write_table
from reviewloom.llm.tokens import Encoder
from reviewloom.llm.topk import top_k
from reviewloom.llm.toxicity import score_toxicity

WORD, BYTE = Q.tokenizer_file("word_bpe_49k.json"), Q.tokenizer_file("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids binary, text_hash long, shard int, score double, spans string, one string, _len int, _id long, _gone int"


def edge_rows():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma,", "don't", "été", "naïve.", "日本", "x1y2", "...", "<|endoftext|>", "İz", "\t", "", "\n", "😀"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts = [None, "", " ", "\n\n", "a", "A", "same text", "Same Text", "same text", "w " * 4000, "z" * 20000, *made]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)] + [(6, "same text", "en", "src0", 9)]
    return rows + [(None, t, None, None, None) for t in ("same text", "no id and no other like it", None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, b"x", 1, 2, 0.5, "s", "o", 3, 4, 5) for r in edge_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    return {i: t or "" for i, t, *_ in rows if i is not None}


NULL_TEXTS = sorted(t or "" for i, t, *_ in edge_rows() if i is None)


def library_ids(path, text):
    return Encoder(path).tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_librarys(path):
    enc, rng = Encoder(path), random.Random(1)
    parts = ["a", "b", "'s", "S", " ", "  ", ".", ",", "\n", "\n\n", "\t", "é", "日", "1", "!", "İ", "Σ", "<|endoftext|>", "'re", "́", " ", "\x1c", "%%%"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        whole = enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == whole, text
        cut = rng.randint(0, len(text))
        assert concatenated(enc, (text[:cut], enc.ids(text[:cut])), (text[cut:], enc.ids(text[cut:])))[1] == enc.ids(text)
    long = " ".join(rng.choice(["word", "Other", "third."]) for _ in range(3000)) + "q" * 500
    leaves = [long[i : i + 700] for i in range(0, len(long), 700)]
    assert tree_ids(enc, [(x, enc.ids(x)) for x in leaves]) == enc.ids(long)


def test_encode_and_decode(docs, none):
    enc, text = Encoder(WORD), by_id(edge_rows())
    rows = decode(encode(docs, WORD, leaf_chars=1000), WORD).collect()
    assert len(rows) == docs.count()
    assert sorted(bytes(r.ids) for r in rows if r.doc_id is None) == sorted(np.array(library_ids(WORD, t), "<u4").tobytes() for t in NULL_TEXTS)
    for r in [r for r in rows if r.doc_id is not None]:
        ids = library_ids(WORD, text[r.doc_id])
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
        assert r.decoded == enc.tokenizer.decode(ids, skip_special_tokens=False)
    assert encode(none, WORD).count() == 0


def test_exact_dedup(docs, none):
    text = by_id(edge_rows())
    low = {i: re.sub("[A-Z]", lambda m: m.group().lower(), t) for i, t in text.items()}
    rows = edge_rows()
    for keep, pick in (("min", min), ("max", max)):
        got = exact_dedup(docs, keep=keep).collect()
        assert len(got) == len(rows)
        fold = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        size = lambda t: sum(fold(t) == fold(x) for _, x, *_ in rows)
        nulls = {r.text_sha256: (r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is None}
        same_as = lambda t: [i for i, x, *_ in rows if i is not None and fold(x) == t]
        assert nulls == {hashlib.sha256(t.encode()).hexdigest(): (pick(same_as(t), default=None), size(t), not same_as(t)) for t in NULL_TEXTS}
        for r in [r for r in got if r.doc_id is not None]:
            same = same_as(low[r.doc_id])
            assert (r.keep_id, r.group_size, r.kept) == (pick(same), size(low[r.doc_id]), r.doc_id == pick(same))
            assert r.text_sha256 == hashlib.sha256(low[r.doc_id].encode()).hexdigest()
    assert exact_dedup(none).count() == 0


def test_dedup_of_a_group_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = exact_dedup(spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "copy").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id % 3} == {(1, 266)}
    assert all(r.kept and r.group_size == 1 for r in rows if r.doc_id % 3 == 0)


def test_dedup_of_copies_that_fill_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = exact_dedup(spark.createDataFrame([(i, "copy" if i < 9 else f"t{i}") for i in range(12)], "doc_id long, text string").coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(i, 0, 9) if i < 9 else (i, i, 1) for i in range(12)}


def test_sharding(docs, none):
    text, rows = by_id(edge_rows()), shard_documents(docs, 3).collect()
    where, slots = {}, defaultdict(list)
    text[None] = None
    for r in rows:
        if r.doc_id is None:
            slots[r.shard].append(r.slot)
            continue
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.grown_shard is None
        assert where.setdefault(text[r.doc_id], r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(none).count() == 0


def test_differencing_is_tight():
    rng = random.Random(2)
    sizes = [rng.randint(1, 5000) for _ in range(3000)]
    sums = [0] * 8
    for s, k in zip(sizes, difference(sizes, 8), strict=True):
        sums[k] += s
    assert max(sums) - min(sums) <= 2
    assert sorted(difference([8, 7, 6, 5, 4], 2)) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1]) and difference([], 4) == []


def test_packing(docs, none):
    text, rows = by_id(edge_rows()), pack(token_pieces(docs, WORD, 0, 64), 64).collect()
    used, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(pieces.pop(None)) == 3
    for i, got in pieces.items():
        ids = [*library_ids(WORD, text[i]), 0]
        n = sum(1 for d, *_ in edge_rows() if d == i)
        want = sorted((k, 64 * k, np.array(ids[64 * k : 64 * k + 64], "<u4").tobytes()) for k in range(-(-len(ids) // 64)))
        assert sorted((r.piece, r.start, bytes(r.ids)) for r in got) == sorted(want * n)
    assert len(used) <= 1.03 * -(-sum(r.length for r in rows) // 64) + 1
    assert pack(token_pieces(none, WORD)).count() == 0
    odd = docs.sparkSession.createDataFrame([(1, 5, 7, 8), (2, 5, 7, 8)], "doc_id int, length int, _len int, _task int")
    assert {(r.doc_id, r._len, r._task) for r in pack(odd, 10).collect()} == {(1, 7, 8), (2, 7, 8)}


def test_a_sweep_leaves_nothing_that_fits():
    rng = random.Random(3)
    for _ in range(200):
        pieces = {n: rng.randint(1, 4) for n in rng.sample(range(1, 60), 12)}
        gaps = sorted(rng.sample(range(1, 80), 8))
        runs = [(0, n, 0, c) for n, c in pieces.items()] + [(1, g, 10 * i, 2) for i, g in enumerate(gaps)]
        got = swept(runs, 100)
        placed, ranks = defaultdict(list), defaultdict(list)
        for kind, length, at, n, first, offset in got:
            if kind == 2:
                ranks[length] += range(at, at + n)
                for j in range(n):
                    placed[first + j].append((offset, length))
        for s, parts in placed.items():
            gap = gaps[s // 10]
            assert sum(n for _, n in parts) <= gap
        for length, seen in ranks.items():
            assert sorted(seen) == list(range(len(seen))) and len(seen) <= pieces[length]
        unplaced = [r[1] for r in got if r[0] == 0]
        open_gaps = [r[1] for r in got if r[0] == 1]
        assert not [1 for n in unplaced for g in open_gaps if n <= g]  # nothing that is left fits
        assert sum(len(v) for v in placed.values()) + sum(r[3] for r in got if r[0] == 0) == sum(pieces.values())


def test_packing_is_close_to_best_fit_by_hand(spark):
    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(700)] + [7] * 300
    rows = pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length int"), 100).collect()
    gaps = []  # best fit decreasing, one by one
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(100 - n)
        else:
            gaps[gaps.index(fit)] -= n
    assert sorted(r.length for r in rows) == sorted(lengths)
    assert len({r.sequence_id for r in rows}) <= 1.01 * len(gaps) + 1
    place = defaultdict(list)
    for r in rows:
        place[r.sequence_id].append((r.offset, r.length))
    for parts in place.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 100


def test_token_tables(spark, docs, none):
    text = by_id(edge_rows())
    manifest = write_table(docs, BYTE, new_path(spark, "sst"), 2, block_bytes=200)
    start = 0
    rows = sorted(read_table(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 3 + sorted(i for i, *_ in edge_rows() if i is not None)
    assert sorted(bytes(r.ids) for r in rows[:3]) == sorted(np.array([*library_ids(BYTE, t), 2], "<u4").tobytes() for t in NULL_TEXTS)
    start, rows = sum(len(bytes(r.ids)) // 4 for r in rows[:3]), rows[3:]
    for r in rows:
        want = [*library_ids(BYTE, text[r.doc_id]), 2]
        assert (r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (start, want)
        start += len(want)
    assert [x.tolist() for x in lookup(spark, manifest, 12)] == [[*library_ids(BYTE, text[12]), 2]]
    assert len(lookup(spark, manifest, 6)) == 2 and lookup(spark, manifest, 10**9) == []
    assert read_table(write_table(none, BYTE, new_path(spark, "sst"), 2)).count() == 0


def components_by_hand(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    out, passage, chain = [], text(40), text(60)
    for _ in range(12):
        first = text(rng.randint(8, 100))
        for _ in range(rng.choice([1, 3, 25])):
            copy = list(first)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    out += [" ".join(text(15) + passage + text(10)) for _ in range(25)]
    for _ in range(25):
        chain[rng.randrange(60)] = rng.choice(words)
        out.append(" ".join(chain).upper())
    return [(100 + i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("n", "percent", "bucket"), [(3, 90, 128), (5, 80, 4)])
def test_near_duplicates(spark, docs, none, n, percent, bucket):
    rows = near_rows() + [r[:2] for r in edge_rows() if r[0] is not None]
    df = docs.select("doc_id", "text", "ids").unionByName(spark.createDataFrame(near_rows(), "doc_id long, text string"), allowMissingColumns=True)
    want = components_by_hand(rows, n, percent)
    got = near_duplicates(df, n, percent, bucket=bucket)[0].collect()
    assert len(got) == len(rows) + 3
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id is None} == {(0, None), (7 - n + 1, None), (1, 6)}
    if bucket == 4:
        assert near_duplicates(none)[0].count() == 0


def test_near_duplicates_plans_stay_small(spark, monkeypatch):
    """What a plan reads is named once: no table that the driver holds is planned again within another."""
    plans = []

    def seen(df, name, f=jaccard.written):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan")))
        return f(df, name)

    monkeypatch.setattr(jaccard, "written", seen)
    texts = [" ".join(f"v{i}" if i == k else f"w{k}" for k in range(40)) for i in range(0, 40, 8)]
    near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 60, bucket=2)
    assert [n for name, n in plans if name == "jaccard-compared"]
    assert max(n for _, n in plans) <= 2


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(50, 80)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(5, 5)]
    root = {i: i for e in links for i in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: c for i, c in root.items() if sum(1 for v in root.values() if v == c) > 1}


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_hand(text):
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}
            if fine[kind]:
                yield kind, m.start(), m.end()


def test_personal_data(spark, docs, none):
    rng = random.Random(3)
    parts = [*"0123456789 --..@+()abé😀\n", "4111111111111111", "4111 1111-1111 1111", "a@b.co", "1.2.3.4", "256.1.1.1", "+1 (234) 555-1234"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))) for i in range(600)]
    rows += [(1000 + i, t) for i, t in enumerate(["1" * 30000, "1 " * 20000, "a" * 30000, "a.b" * 10000 + "@x", "+1" * 10000, "1.2" * 3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.filter("doc_id > 6").select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    text = {r.doc_id: r.text or "" for r in df.collect()}
    got = personal_data(df).collect()
    assert len(got) == len(text)
    for r in got:
        assert [tuple(s) for s in r.spans if s.kind != "context"] == list(base_by_hand(text[r.doc_id]))
    assert personal_data(none).count() == 0


def test_contexts_discover(spark):
    rows = [(i, f"please mail me on key{i}@box{i}.com now") for i in range(6)] + [(20, "please mail me on bob@home now"), (21, "unrelated bob2@home word"), (22, None)]
    out = {r.doc_id: r.text for r in redacted(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _id int, _spans int")).collect()}
    assert out[0] == "please mail me on <email> now" and out[20] == "please mail me on <context> now"
    assert out[21] == rows[7][1] and out[22] is None


def test_contexts_of_matches_with_blanks(spark):
    rows = [(i, f"you can reach me at +1 (743) 555-38{i:02} after lunch") for i in range(6)]
    cards = [f"my spare card number 4111 1111 {i:04} 1111 was lost" for i in range(100)]
    rows += [(10 + i, t) for i, t in enumerate([t for t in cards if list(base_by_hand(t))])]
    rows += [(200, "you can reach me at (743) 555-3824 after lunch"), (201, "my spare card number 4111 1111 1111 1112 was lost"), (202, "one may reach me at ab12-cd34x after lunch"), (203, "only (743) 555-3824 here")]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id >= 200").collect()
    want = {200: [("context", 20, 34)], 201: [("context", 21, 40)], 202: [("context", 20, 30)], 203: []}
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in got} == want


def test_bars_of_a_table_are_no_context(spark):
    rows = [(i, f"| key{i}@box{i}.com | +1 743 555 38{i:02} |") for i in range(8)] + [(20, "| 9093441080585879 | 12ab-34cd |")]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 20").first()
    assert got.spans == []


def test_contexts_spread_until_they_settle(spark):
    rows = [(i, f"please mail me on key{i}@box{i}.com now") for i in range(6)]
    for step in range(3):  # the values of each step make the next step's context sure
        for i in range(4):
            rows += [(100 + 10 * step + i, f"{'please mail me on' if step == 0 else f'next to link{chr(96 + step)}'} k{step}x{i}y00 now")]
            rows += [(200 + 10 * step + i, f"next to link{chr(97 + step)} k{step}x{i}y00 now")]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(len(r.spans) == 1 for r in got)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 12)).round(2)
    base[50:60] = base[40]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(500, None), (600, [1.0, None]), (700, [float("nan")] * 12), (800, [float("inf")] * 12), (900, [1.0, 2.0]), (901, [3.0, -1.0]), (1000, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, dim int, block int").repartition(3)
    v = {i: np.floor(1024 * np.array(x, np.float32).astype(float)).astype(np.int64) for i, x in rows if x and None not in x and np.isfinite(x).all()}
    want = set()
    for q in v:
        if q % 10 == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:5]
            want |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(best)}
    assert set(map(tuple, top_k(df, 5, 10).collect())) == want
    assert top_k(df.limit(0)).count() == 0


def test_top_k_over_many_tiles(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16)) * 8
    base = [(centres[i % 6] + rng.normal(size=16)).round(3).tolist() for i in range(500)]
    rows = [*enumerate(base), (40, base[41]), (40, base[3]), (77, base[40]), *[(90, base[90])] * 30]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    v = [(i, np.floor(1024 * np.array(x)).astype(np.int64)) for i, x in rows]
    want = []
    for q in range(0, 500, 10):
        vq = np.array(max(x.tolist() for i, x in v if i == q))
        best = sorted((-int(vq @ x), c) for c, x in v if c != q)[:7]
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    got = top_k(df, 7, 10, chunk_bytes=1024, tile_blocks=1, tile_chunks=3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("score", "label", "least"), [(Q.op6_toxicity, "toxic", 0.8), (Q.op7_quality, "quality", 0.8)])
def test_classifiers_on_held_out_rows(spark, score, label, least):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = score(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert auc([(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]) > least


def test_classifiers_at_the_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for score, col in ((score_quality, "quality"), (score_toxicity, "toxic")):
        got = score(docs, labels, col).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert {r.score for r in score(docs, labels.filter(f"{col} = 1"), col).collect()} == {1.0}
        assert score(docs, labels.limit(0), col).count() == docs.count()
        assert score(none, labels, col).count() == 0

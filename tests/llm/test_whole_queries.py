"""Each training-data query over the smallest tables, held against plain Python over its contract."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from reviewloom.llm import queries as Q
from reviewloom.llm.tokens import Encoder

from .test_llm import BYTE, WORD, base_by_hand, components_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def text():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return {i: t or "" for i, t in zip(*[c.to_pylist() for c in table.columns], strict=True)}


@pytest.fixture(scope="module")
def words(text):
    enc = Encoder(WORD).tokenizer
    return {i: enc.encode(t, add_special_tokens=False).ids for i, t in text.items()}, enc


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_op1(spark, text, words):
    ids, enc = words
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op1_bpe_encoding(spark, SF).collect()}
    assert got == {i: (len(x), sha(packed(x)), sha(enc.decode(x, skip_special_tokens=False))) for i, x in ids.items()}


def test_op2(spark, text):
    rows = {r.doc_id: r for r in Q.op2_pii(spark, SF).collect()}
    assert set(rows) == set(text)
    for i, t in text.items():
        base = [f"{kind}:{a}:{z}" for kind, a, z in base_by_hand(t)]
        r = rows[i]
        assert r.base_sha256 == sha(",".join(base)) and set(base) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(f"{k}:") for s in base) for k in ("email", "ip", "card", "phone")]


def test_op3(spark, text):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op3_ngram_jaccard(spark, SF).collect()}
    assert got == components_by_hand(list(text.items()), 3, 90)


def test_op4(spark, words):
    pieces, used = defaultdict(list), defaultdict(list)
    for r in Q.op4_best_fit_packing(spark, SF).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        used[r.sequence_id].append((r.offset, r.length))
    for i, x in words[0].items():
        ids = [*x, 0]
        assert sorted(pieces[i]) == [(k, 2048 * k, len(ids[2048 * k : 2048 * k + 2048]), zlib.crc32(packed(ids[2048 * k : 2048 * k + 2048]))) for k in range(-(-len(ids) // 2048))]
    for parts in used.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    total = sum(len(x) + 1 for x in words[0].values())
    assert len(used) <= 1.03 * -(-total // 2048) + 1


def test_op5(spark, text):
    rows, slots, size, where = Q.op5_sharding(spark, SF).collect(), defaultdict(list), [0] * 8, {}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert where.setdefault(data, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(size) - min(size) <= 64


@pytest.mark.parametrize(("query", "folds", "fold", "limit"), [(Q.op6_toxicity, 4, 2, 0.3), (Q.op7_quality, 3, 1, 0.5)])
def test_op6_and_op7(spark, text, query, folds, fold, limit):
    rows = query(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    by_text = defaultdict(set)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
        by_text[text[r.doc_id]].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())  # a score follows from the text alone


def test_op8(spark, text):
    enc, start = Encoder(BYTE).tokenizer, 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op8_token_tables(spark, SF).collect()}
    for i in sorted(text):
        ids = [*enc.encode(text[i], add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert len(got) == len(text)

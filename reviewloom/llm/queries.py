"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode
from .common import new_path, written
from .dedup import exact_dedup
from .infill import infilled, restored
from .jaccard import near_duplicates
from .lexical import build_index, search
from .packing import pack, token_pieces
from .pii import KINDS, personal_data
from .quality import score_quality
from .sharding import shard_documents
from .sstable import read_table, write_table
from .topk import top_k
from .toxicity import score_toxicity
from .warc import read_archives, resolved, write_archives


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; the files are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("word_bpe_49k.json")
    return decode(encode(_documents(spark, sf_dir), path), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_documents(spark, sf_dir))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle=3, percent=90)[0]


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=0, capacity=2048)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_documents(spark, sf_dir), shards=8)


def _held_out(folds: int, fold: int) -> str:
    return f"coalesce(crc32(cast(cast(doc_id as string) as binary)) % {folds} = {fold}, false)"


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = _held_out(4, 2)
    scored = score_toxicity(_documents(spark, sf_dir), labels, "toxic", use=f"not ({held})")
    return scored.select("doc_id", F.expr(held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = _held_out(3, 1)
    scored = score_quality(_documents(spark, sf_dir), labels, "quality", use=f"not ({held})")
    return scored.select("doc_id", F.expr(held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    manifest = write_table(_documents(spark, sf_dir), path, new_path(spark, "sst"), end_id=2)
    return read_table(manifest).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10, every=100)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), keep="max")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    read = read_archives(manifest)
    own = read.withColumn("payload_digest", F.coalesce(F.sha2("payload", 256), "payload_digest")).withColumn("payload_bytes", F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes"))
    told = resolved(written(own.drop("payload", "url"), "warc-read"))
    lost = F.when(~F.coalesce("found", F.lit(True)), F.raise_error("a revisit without its response"))
    return told.select("page_id", F.coalesce(lost.cast("long"), "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilled(_documents(spark, sf_dir), seed=7, unit="line", rate=100, spm_rate=50)
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(_documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_encoding, op2_pii, op3_ngram_jaccard, op4_best_fit_packing, op5_sharding, op6_toxicity, op7_quality, op8_token_tables, op9_top_k, op10_exact_dedup, op11_warc, op12_fill_in_middle, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 s AS (SELECT q.vec_id AS query_id, c.vec_id,
                              list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
                       FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
                 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
        "op10_exact_dedup": """
            WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
                       FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
            FROM n WINDOW g AS (PARTITION BY t)""",
        "op11_warc": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
                 f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
            FROM f""",
        "op12_fill_in_middle": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
                 u AS (SELECT doc_id, t, h, list_filter(list_transform(l, lambda x, i: CASE WHEN i < len(l) THEN x || chr(10) ELSE x END), lambda x: x <> '') AS u FROM d),
                 k AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
                              ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 AS spm, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM u),
                 c AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM k)
            SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
                   sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
            FROM c""",
        "op13_lexical_search": r"""
            WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
                 tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
                 d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
                 g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
                 m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM d, g),
                 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
                 w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
                 s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
                 r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
            SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    }

"""The thin opN queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact, license, mix, shard, simhash, substring, toxicity, warc
from ._util import durable, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c = c.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    # each row is an event of its own message, so rows with one turn number and rows that repeat exactly stay apart
    events = c.select("conv_id", F.struct("turn", "role", "text", F.monotonically_increasing_id().alias("row")).alias("msg"), F.col("turn").alias("seq"), F.lit(chat.EDIT).alias("kind"), "role", "text")
    out = chat.read_back(chat.format_chats(events, ["conv_id"]))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"), k=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    out = durable(warc.read_warc(spark, path), "warc-records")
    if warc.gap_log(out, new_path(spark, "warc-gaps")):
        raise RuntimeError("archives that were just written have gaps")
    page = F.when(F.col("record_id") != "", F.col("record_id")).cast("long")
    return out.where("kind = 'record'").select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents")
    out = shard.assign_shards(docs, 16, carry={"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_simhash": op2_simhash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_mix": op5_mix,
    "op6_substring": op6_substring,
    "op7_warc": op7_warc,
    "op8_shard": op8_shard,
    "op9_toxicity": op9_toxicity,
    "op10_license": op10_license,
}

_CHAT_MARKS = r"\|(?:turn|body|end|im_start|im_end|endoftext|user|assistant|system)\|>|/?s>"
_CHAT_ESCAPED = r"regexp_replace(regexp_replace({}, '(<)(\\*(?:" + _CHAT_MARKS + r"))', '\1\\\2', 'g'), '(\[)(\\*(?:/?INST\]|/?SYS\]))', '\1\\\2', 'g')"

ORACLE: dict[str, str] = {
    "op1_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                     coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                     CAST(sum(length('<|turn|>') + length('<|body|>') + length('<|end|>') + length({ROLE}) + length({TEXT})) AS BIGINT) AS formatted_chars
              FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a""".replace("{ROLE}", _CHAT_ESCAPED.format("role")).replace("{TEXT}", _CHAT_ESCAPED.format("text")),
    "op4_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT n FROM win),
        dwin AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
        hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dwin JOIN win USING (n, g)),
        cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM t""",
    "op6_substring": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
        first AS (SELECT g, min(doc_id) AS src FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (g) WHERE doc_id > src) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [w[i] for i in range(1, len(w) + 1) if NOT list_contains(ps, i)] END, ' ')) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id)""",
    "op7_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        f AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((strpos('0123456789abcdef', substr(hex, CAST(floor(i * 5 / 4) AS BIGINT) + 1, 1)) - 1) * 16
                   + greatest(strpos('0123456789abcdef', substr(hex || '0', CAST(floor(i * 5 / 4) AS BIGINT) + 2, 1)) - 1, 0)) >> CAST(3 - (i * 5) % 4 AS BIGINT)) & 31 AS BIGINT) + 1, 1) for i in range(0, 32)], '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
}

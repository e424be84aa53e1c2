"""The opN_<name> queries over the whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkframe.llm import brown_lm, chat_format, cross_align, cuckoo_dedup, nbsvm, packing, piece_codec, quality_rules, secret_scans, sharding, simhash, turn_repair, warc
from inkframe.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_texts(table(spark, sf_dir, "documents"), all_pairs=True)


def op3_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.secret_spans(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_texts(table(spark, sf_dir, "documents"), digests=True)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row_no")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.round_trip(chat_format.with_probe(table(spark, sf_dir, "conversations")))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align.link_statistics(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_brown_lm": op2_brown_lm,
    "op3_nbsvm": op3_nbsvm,
    "op4_warc": op4_warc,
    "op5_sampled_splitters": op5_sampled_splitters,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_secret_scans": op7_secret_scans,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simhash": op10_simhash,
    "op11_chat_format": op11_chat_format,
    "op12_turn_repair": op12_turn_repair,
    "op13_cross_align": op13_cross_align,
}

_RULES = ("symbol", "upper", "dup_line", "any")

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": f"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM documents),
        grams AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
        f AS (
            SELECT d.doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper,
                   len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
            FROM d LEFT JOIN covered USING (doc_id)),
        g AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars AS symbol,
                   100 * n_upper > 30 * word_chars AS upper, 100 * n_dup_lines > 50 * n_lines AS dup_line FROM f),
        e AS (SELECT *, base_failed OR symbol OR upper OR dup_line AS "any" FROM g),
        h AS (SELECT host, count(*) AS n, {", ".join(f'sum("{r}"::INT) AS n_{r}' for r in _RULES)} FROM e GROUP BY host),
        m AS (SELECT sum(n) AS docs, count(*) AS hosts, {", ".join(f'sum(n_{r}) / sum(n) AS m_{r}' for r in _RULES)} FROM h),
        v AS (SELECT {", ".join(f'sum(n * (n_{r} / n - m_{r}) ** 2) / any_value(docs) AS v_{r}' for r in _RULES)} FROM h, m),
        k AS (SELECT *, {", ".join(f'CASE WHEN m_{r} * (1 - m_{r}) > 0 THEN 1 / least(greatest((v_{r} - m_{r} * (1 - m_{r}) * hosts / docs) / (m_{r} * (1 - m_{r})), 1e-4), 0.5) - 1 ELSE 1 / 1e-4 - 1 END AS k_{r}' for r in _RULES)} FROM m, v),
        r AS (SELECT host, {", ".join(f'(n_{r} + m_{r} * k_{r}) / (n + k_{r}) AS r_{r}, m_{r}' for r in _RULES)} FROM h, k)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND r_any < 0.8 AND {" AND ".join(f'NOT ("{r}" AND r_{r} >= 0.5 * m_{r})' for r in _RULES[:3])} AS kept
        FROM e JOIN r USING (host)
    """,
    "op4_warc": """
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
               CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
        FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
    """,
    # CRC-32 has no function in DuckDB: it is folded over the bytes, bit by bit, with the polynomial 0xEDB88320
    "op5_sampled_splitters": """
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 16 AS size,
                   ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
        table256 AS (
            SELECT list(c ORDER BY i) AS crc FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        hexed AS (SELECT doc_id, hex(encode(t)) AS x, t FROM d),
        crcs AS (
            SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT)),
                       lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32 FROM hexed, table256),
        big AS (
            SELECT h, g, row_number() OVER (ORDER BY g DESC, h) AS k, total FROM (SELECT h, sum(size)::BIGINT AS g, count(*) AS n FROM d GROUP BY h), (SELECT sum(size)::BIGINT AS total FROM d)
            WHERE n > 1 AND g * 4000 > total),
        put AS (
            SELECT 0::BIGINT AS k, NULL::BIGINT AS h, NULL::BIGINT AS home, list_transform(range(40), lambda x: 0::BIGINT) AS loads
            UNION ALL
            SELECT k, h, CASE WHEN fits THEN pos - 1 END, list_transform(loads, lambda v, i: v + CASE WHEN fits AND i = pos THEN g ELSE 0 END)
            FROM (SELECT big.k, big.h, g, loads, list_position(loads, list_min(loads))::BIGINT AS pos, (list_min(loads) + g) * 40 <= total AS fits FROM put JOIN big ON big.k = put.k + 1)),
        rooms AS (SELECT i AS shard, (SELECT sum(size) FROM d) - 40 * loads[i + 1] AS room FROM (SELECT loads FROM put ORDER BY k DESC LIMIT 1), range(40) r(i)),
        ends AS (SELECT list(e ORDER BY shard) AS ends FROM (SELECT shard, sum(room) OVER (ORDER BY shard) AS e FROM rooms) WHERE shard < 39),
        homed AS (SELECT d.*, big.h IS NOT NULL AS large, home, CASE WHEN home IS NULL THEN size ELSE 0 END AS line FROM d LEFT JOIN big USING (h) LEFT JOIN put USING (h)),
        line AS (SELECT *, sum(line) OVER (ORDER BY h, doc_id) - line AS start, sum(size) OVER (PARTITION BY h) AS group_size FROM homed),
        mid AS (SELECT *, CASE WHEN large THEN 2 * start + size ELSE 2 * min(start) OVER (PARTITION BY h) + group_size END AS middle FROM line),
        placed AS (SELECT *, coalesce(home, len(list_filter(ends, lambda e: 2 * e <= middle * 40)))::INT AS shard FROM mid, ends)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot,
               NULL::INT AS grown_shard FROM placed JOIN crcs USING (doc_id)
    """,
    "op11_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
        t AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS begins FROM c),
        m AS (
            SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|NEXT\]|ROLE\]|/ROLE\]|TEXT\])', '\1\2\\\3', 'g'))
                      + CASE WHEN NOT begins THEN 6 WHEN role = 'system' THEN 18 WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 7
                             ELSE 19 + length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|NEXT\]|ROLE\]|/ROLE\]|TEXT\])', '\1\2\\\3', 'g')) END AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars, sum(begins::INT)::BIGINT AS n_blocks
        FROM m GROUP BY conv_id
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}

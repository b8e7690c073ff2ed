"""The queries of the corpus operators, one ``opN_<name>`` each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bpe, brown, chat, exact_dedup, minhash, mixing, quality, repeats, token_store, toxicity
from netloom.llm.common import table


def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.brown_scores(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2.0)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digest(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(table(spark, sf_dir, "documents"), length=400)


def with_tool_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): all messages, and for each of an assistant three calls and their results.

    The table has no tool messages, so these are derived from its rows: of the calls, in
    an order that is not theirs, ``pick`` needs ``measure`` and ``join`` needs both;
    where the text's length is a multiple of 7, ``measure`` needs ``join``, a cycle. Some
    arguments break their schemas, some calls have no result.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    n, own = F.length(F.coalesce("text", F.lit(""))), F.concat(F.col("turn"), F.lit("-"), F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 8))
    said = rows.where("role = 'assistant'").select("conv_id", "turn", n.alias("n"), own.alias("own"))
    many = F.when(F.col("n") % 5 == 0, F.lit('"many"')).otherwise(F.col("n").cast("string"))
    after = F.when(F.col("n") % 7 == 0, F.concat(F.lit('"after":{"$ref":"'), "own", F.lit('c"},'))).otherwise("")
    join = F.concat(F.lit('{"id":"'), "own", F.lit('c","name":"join","arguments":{"right":{"$ref":"'), "own", F.lit('b"},"left":{"$ref":"'), "own", F.lit('a"}}}'))
    pick = F.concat(F.lit('{"id":"'), "own", F.lit('b","name":"pick","arguments":{"n":'), "turn", F.lit(',"from":{"$ref":"'), "own", F.lit('a"}}}'))
    measure = F.concat(F.lit('{"id":"'), "own", F.lit('a","name":"measure","arguments":{'), after, F.lit('"n":'), many, F.lit("}}"))
    calls = said.select("conv_id", "turn", F.lit("assistant").alias("role"), F.concat(F.lit('{"tool_calls":['), F.concat_ws(",", join, pick, measure), F.lit("]}")).alias("text"))
    answer = lambda rows, call: rows.select("conv_id", "turn", F.lit("tool").alias("role"), F.concat(F.lit('{"tool_call_id":"'), "own", F.lit(f'{call}","content":'), "n", F.lit("}")).alias("text"))
    return rows.unionByName(calls).unionByName(answer(said.where("n % 3 <> 0"), "a")).unionByName(answer(said.where("turn >= 3"), "b"))


SCHEMAS = {
    "measure": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "after": {"type": "object"}}, "additionalProperties": False},
    "pick": {"type": "object", "required": ["from", "n"], "properties": {"from": {"type": "object"}, "n": {"enum": [1, 3]}}},
}


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(with_tool_messages(table(spark, sf_dir, "conversations")), SCHEMAS)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_scores": op1_brown_scores,
    "op2_bpe": op2_bpe,
    "op3_mix_sources": op3_mix_sources,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_store": op6_token_store,
    "op7_quality_rules": op7_quality_rules,
    "op8_repeats": op8_repeats,
    "op9_chat_format": op9_chat_format,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op4_near_duplicates": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.m)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(m) AS component_id FROM r GROUP BY 1) c ON c.id = d.doc_id""",
    "op5_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM n""",
    "op7_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
        k AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS s FROM g),
        twice AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 8) r(j) GROUP BY 1),
        m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                     coalesce(covered.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_caps, len(regexp_extract_all(t, '!')) AS n_marks FROM w LEFT JOIN covered USING (doc_id)),
        f AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
                     + CASE WHEN 100 * n_caps > 50 * word_chars OR 100 * n_marks > 50 * n_words THEN 8 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END
                     + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END AS bits FROM m)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
               bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS fail_bits FROM f""",
    "op9_chat_format": """
        WITH RECURSIVE m AS (
            SELECT conv_id, turn, length(coalesce(text, '')) AS n, turn || '-' || substr(md5(coalesce(text, '')), 1, 8) AS u, row_number() OVER () AS row
            FROM conversations WHERE role = 'assistant'),
        c AS (
            SELECT conv_id, turn, row, 0 AS pos, u || 'c' AS id, 'join' AS name, '{"left":{"$ref":"' || u || 'a"},"right":{"$ref":"' || u || 'b"}}' AS args, [u || 'a', u || 'b'] AS needs FROM m
            UNION ALL
            SELECT conv_id, turn, row, 1, u || 'b', 'pick', '{"from":{"$ref":"' || u || 'a"},"n":' || turn || '}', [u || 'a'] FROM m
            UNION ALL
            SELECT conv_id, turn, row, 2, u || 'a', 'measure',
                   '{' || CASE WHEN n % 7 = 0 THEN '"after":{"$ref":"' || u || 'c"},' ELSE '' END || '"n":' || CASE WHEN n % 5 = 0 THEN '"many"' ELSE n::VARCHAR END || '}',
                   CASE WHEN n % 7 = 0 THEN [u || 'c'] ELSE []::VARCHAR[] END FROM m),
        r AS (SELECT conv_id, turn, u || 'a' AS id, n FROM m WHERE n % 3 <> 0 UNION ALL SELECT conv_id, turn, u || 'b', n FROM m WHERE turn >= 3),
        e AS (SELECT DISTINCT conv_id, id, unnest(needs) AS need FROM c),
        walk AS (
            SELECT DISTINCT conv_id, id, id AS cur, 0 AS depth FROM c
            UNION
            SELECT w.conv_id, w.id, e.need, w.depth + 1 FROM walk w JOIN e ON e.conv_id = w.conv_id AND e.id = w.cur WHERE w.depth < 4),
        lv AS (SELECT conv_id, id, CASE WHEN max(depth) < 4 THEN max(depth) END AS level FROM walk GROUP BY 1, 2),
        first AS (SELECT conv_id, id, min(turn) AS result_turn FROM r GROUP BY 1, 2),
        j AS (
            SELECT c.*, lv.level, first.result_turn,
                   CASE name WHEN 'measure' THEN json_type(args, '$.n') IN ('UBIGINT', 'BIGINT') WHEN 'pick' THEN json_extract_string(args, '$.n') IN ('1', '3') END AS valid
            FROM c JOIN lv ON lv.conv_id = c.conv_id AND lv.id = c.id LEFT JOIN first ON first.conv_id = c.conv_id AND first.id = c.id)
        SELECT conv_id, turn, role, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_invalid,
               CAST(to_json({'content': text, 'role': role, 'turn': turn}) AS VARCHAR) AS line
        FROM conversations
        UNION ALL
        SELECT any_value(conv_id), any_value(turn), 'assistant', count(*), count(result_turn), count(*) FILTER (WHERE valid = false),
               '{"role":"assistant","tool_calls":[' || string_agg(
                   '{"arguments":' || args || ',"id":"' || id || '","level":' || coalesce(level::VARCHAR, 'null') || ',"name":"' || name || '","result_turn":'
                   || coalesce(result_turn::VARCHAR, 'null') || ',"valid":' || coalesce(valid::VARCHAR, 'null') || '}', ',' ORDER BY coalesce(level, 2147483647), pos)
               || '],"turn":' || any_value(turn) || '}'
        FROM j GROUP BY row
        UNION ALL
        SELECT conv_id, turn, 'tool', 0, 0, 0, '{"content":' || n || ',"role":"tool","tool_call_id":"' || id || '","turn":' || turn || '}' FROM r""",
}

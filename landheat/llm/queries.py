"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landheat.llm import chat, counts, fim, langid, mixing, ogg, packing, quality, search, secrets, simhash, toxicity, urls
from landheat.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(ogg.media_column(table(spark, sf_dir, "documents")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.examples(chat.with_hostile(table(spark, sf_dir, "conversations"))))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"))


_OPS = (op1_language_id, op2_url_filters, op3_secret_scans, op4_mixing, op5_quality_rules, op6_toxicity, op7_packing, op8_ogg_media, op9_chat_format, op10_simhash, op11_fill_in_middle, op12_lexical_search, op13_token_counts)
QUERIES = {f.__name__: f for f in _OPS}

def _spans_sql(place: int, rule: secrets.Rule) -> str:
    """Places of a rule's matches: from the lengths of the matches and of the text between them."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
            SELECT r, {place} AS place, '{rule.kind}' AS kind, {rule.base} AS base, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
                stop := list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))), size := length(m[i]), counted := length(c[i])))) AS s
            FROM (SELECT r, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS c FROM d WHERE regexp_matches(text, '{pattern}'))
            """


_PATTERN_TOKENS = "adult|ads|bets|casino|pills|spam"

ORACLE_SQL = {
    "op2_url_filters": rf"""
        WITH u AS (
            SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (
            SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(h, q, v)),
        b AS (
            SELECT host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
            FROM (SELECT DISTINCT host, path FROM p) d JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
            GROUP BY host, path),
        w AS (SELECT host, path, regexp_extract_all('.' || regexp_replace(host, '[.-]', '..', 'g') || '.', '\.({_PATTERN_TOKENS})\.', 1) AS found FROM (SELECT DISTINCT host, path FROM p) d)
        SELECT page_id, p.host, p.path, rule, CASE WHEN v IS NOT NULL THEN v WHEN len(found) > 0 THEN 'block' ELSE 'allow' END AS verdict,
               list_sort(list_transform(list_distinct(found), lambda x: 'word:' || x)) AS words
        FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path LEFT JOIN w ON p.host = w.host AND p.path = w.path""",
    "op3_secret_scans": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        e AS ({"UNION ALL".join(_spans_sql(k, r) for k, r in enumerate(secrets.RULES))}),
        h AS (SELECT r, place, kind, base, CAST(s.stop - s.size AS BIGINT) AS b, concat(kind, ':', CAST(s.stop - s.size AS BIGINT), ':', CAST(s.stop AS BIGINT)) AS span
              FROM e WHERE s.counted >= CASE kind {" ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in secrets.RULES)} END),
        f AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                     string_agg(span, ',' ORDER BY b, place) FILTER (base) AS base, string_agg(span, ',' ORDER BY b, place) AS spans FROM h GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN f ON d.r = f.r""",
    "op9_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        t AS (
            SELECT conv_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, role, text,
                   4 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + 2 + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 9 AS chars
            FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        e AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
        c AS (
            SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
                        WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (
            SELECT doc_id, n, form, text, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p,
                   coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m, coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
    "op12_lexical_search": r"""
        WITH w AS (
            SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
        p AS (SELECT r, doc_id, term, count(*) AS tf FROM w GROUP BY r, doc_id, term),
        d AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY r),
        t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
        m AS (SELECT r, 25 + (75 * n * docs) // total AS m FROM d, t),
        f AS (SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term),
        q AS (
            SELECT i, item_id, term, count(*) AS times
            FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark))
            GROUP BY i, item_id, term),
        s AS (
            SELECT i, item_id, p.r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM q JOIN p USING (term) JOIN f USING (term) JOIN m ON m.r = p.r GROUP BY i, item_id, p.r, doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
}

"""Queries of this package: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, chat, exact, lines, packing, pieces, quality, simhash, sketch, urls


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, is_held_out = table(spark, sf_dir, "documents"), brown.held_out(F.col("doc_id"), 4, 2)
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), ~is_held_out))
    return scored.select("doc_id", is_held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"), brown.held_out(F.col("doc_id"), 5, 1))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns), ordered=True)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list for the pages at hand, by digests of their hosts: blocked for a time, allowed or ended later, and whole domains for some weeks."""
    hosts = pages.select(urls.host_of(F.col("url")).alias("pattern")).where("pattern <> ''")
    hosts = hosts.distinct().withColumn("m", F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long"))
    domains = hosts.select(F.substring_index("pattern", ".", -2).alias("pattern")).distinct()

    def entry(rows: DataFrame, where: str, action: str, day: str) -> DataFrame:
        return rows.where(where).select("pattern", F.expr(action).alias("action"), F.expr(f"timestampadd(DAY, CAST({day} AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("since"))

    parts = [
        entry(hosts, "m % 5 = 0", "'block'", "m % 200"),
        entry(hosts, "m % 5 = 0 AND m % 3 < 2", "IF(m % 3 = 0, 'allow', 'none')", "m % 200 + 40 + m % 90"),
        entry(hosts, "m % 7 = 0", "'allow'", "140"),
        entry(domains, "true", "'block'", "152"),
        entry(domains, "true", "'none'", "196"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op6_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    pages = pages.withColumn("fetched_at", F.expr("timestampadd(MINUTE, CAST(page_id * 7919 % 525600 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    out = urls.filter_urls(pages, dated_list(pages))
    return out.select("page_id", "url", F.col("fetched_at").cast("string").alias("fetched_at"), "pattern", "action", "kept")


def op7_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    out = pieces.decode_texts(pieces.encode_texts(docs, model), model)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.versions(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbour_quality": op1_neighbour_quality,
    "op2_brown_score": op2_brown_score,
    "op3_chat_format": op3_chat_format,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_template_line_dedup": op5_template_line_dedup,
    "op6_temporal_url_filter": op6_temporal_url_filter,
    "op7_streaming_viterbi": op7_streaming_viterbi,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixture_packing": op9_mixture_packing,
    "op10_paragraph_sketch": op10_paragraph_sketch,
}

_PLAIN = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_PLAIN}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_template_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS raw
            FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
        s AS (SELECT doc_id, line_no, lower(trim(raw, ' ')) AS line FROM l),
        t AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS n, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS fields FROM s),
        m AS (
            SELECT doc_id, line_no, n,
                   CASE WHEN (length(fields) - length(replace(fields, '<*>', ''))) / 3.0 <= (1 - {lines.CONSTANT}) * n + 1e-9 THEN fields ELSE line END AS masked
            FROM t WHERE n >= {lines.MIN_TOKENS}),
        m2 AS (SELECT *, n || '|' || array_to_string(string_split(masked, ' ')[1:{lines.DEPTH}], ' ') AS leaf FROM m),
        variants AS (SELECT leaf, masked, any_value(n) AS n, count(DISTINCT doc_id) AS docs FROM m2 GROUP BY ALL),
        leaves AS (SELECT leaf, sum(docs) AS docs, count(*) AS kinds FROM variants GROUP BY leaf HAVING sum(docs) >= {lines.MIN_DOCS}),
        tokens AS (
            SELECT * FROM (
                SELECT leaf, masked, n, docs, unnest(range(n)) AS pos, unnest(string_split(masked, ' ')) AS token
                FROM variants WHERE leaf IN (SELECT leaf FROM leaves WHERE kinds > 1))
            WHERE token <> '<*>'),
        told AS (SELECT *, sum(docs) OVER (PARTITION BY leaf, pos, token) >= {lines.MIN_DOCS} AS constant FROM tokens),
        general AS (
            SELECT masked, 'g|' || any_value(leaf) || '|' || string_agg(pos || ':' || token, ' ' ORDER BY pos) FILTER (constant) AS template
            FROM told GROUP BY masked HAVING count(*) FILTER (constant) >= {lines.CONSTANT} * any_value(n) - 1e-9),
        named AS (
            SELECT masked, coalesce(g.template, 'v|' || masked) AS template
            FROM variants v SEMI JOIN leaves USING (leaf) LEFT JOIN general g USING (masked)),
        placed AS (SELECT doc_id, line_no, template FROM m2 JOIN named USING (masked)),
        found AS (
            SELECT template, min(struct_pack(a := doc_id, b := line_no)) AS first FROM placed
            GROUP BY template HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}),
        gone AS (SELECT doc_id, line_no FROM placed JOIN found USING (template) WHERE struct_pack(a := doc_id, b := line_no) <> first),
        rest AS (
            SELECT l.doc_id, coalesce(string_agg(raw, chr(10) ORDER BY l.line_no) FILTER (g.doc_id IS NULL), '') AS text,
                   count(*) AS n_lines, count(g.doc_id) AS dropped_lines
            FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
        SELECT doc_id, r.text, CAST(n_lines AS INTEGER) AS n_lines, CAST(dropped_lines AS INTEGER) AS dropped_lines FROM documents d JOIN rest r USING (doc_id)""",
    "op6_temporal_url_filter": r"""
        WITH p AS (
            SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id * 7919 % 525600 AS BIGINT)) AS t,
                   regexp_replace(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)', 1), '\.+$', '') AS host
            FROM pages),
        h AS (SELECT DISTINCT host AS pattern, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS m FROM p WHERE host <> ''),
        dom AS (SELECT DISTINCT array_to_string(string_split(pattern, '.')[-2:], '.') AS pattern FROM h),
        e AS (
            SELECT pattern, 'block' AS action, m % 200 AS day FROM h WHERE m % 5 = 0
            UNION ALL SELECT pattern, CASE WHEN m % 3 = 0 THEN 'allow' ELSE 'none' END, m % 200 + 40 + m % 90 FROM h WHERE m % 5 = 0 AND m % 3 < 2
            UNION ALL SELECT pattern, 'allow', 140 FROM h WHERE m % 7 = 0
            UNION ALL SELECT pattern, 'block', 152 FROM dom
            UNION ALL SELECT pattern, 'none', 196 FROM dom),
        one AS (SELECT pattern, day, min(CASE action WHEN 'block' THEN 1 WHEN 'allow' THEN 2 ELSE 3 END) AS r FROM e GROUP BY ALL),
        iv AS (
            SELECT pattern, CASE r WHEN 1 THEN 'block' WHEN 2 THEN 'allow' ELSE 'none' END AS action,
                   TIMESTAMP '2024-01-01' + to_days(CAST(day AS INTEGER)) AS since,
                   TIMESTAMP '2024-01-01' + to_days(CAST(lead(day) OVER (PARTITION BY pattern ORDER BY day) AS INTEGER)) AS until
            FROM one),
        hit AS (
            SELECT page_id, pattern, action, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC) AS k
            FROM p JOIN iv ON (host = pattern OR ends_with(host, '.' || pattern)) AND since <= t AND (until IS NULL OR t < until) AND action <> 'none')
        SELECT p.page_id, url, strftime(t, '%Y-%m-%d %H:%M:%S') AS fetched_at, pattern, action, coalesce(action, '') <> 'block' AS kept
        FROM p LEFT JOIN hit ON hit.page_id = p.page_id AND k = 1""",
}

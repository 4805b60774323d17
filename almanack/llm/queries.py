"""The registered queries of the operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.llm.common import shared_folder, table
from almanack.llm.line_dedup import dedup_lines
from almanack.llm.decontaminate import contaminated
from almanack.llm.near_dedup import near_duplicates
from almanack.llm.packing import PIECE, pack
from almanack.llm import html_text, lexical, neighbours, secret_scan, toxicity, whitening
from almanack.llm.suffix_dedup import remove_repeats
from almanack.llm.token_files import read_documents, with_checksums, write_token_files
from almanack.llm.warc import archived

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = remove_repeats(table(spark, sf_dir, "documents"))
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer=TOKENIZER).select(PIECE)


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(neighbours.build(vectors), vectors.where("vec_id % 100 = 0"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first, false) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "score").select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), keepers AS (
  SELECT payload_digest, max(page_id) AS keeper FROM digests WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id < k.keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id < k.keeper THEN k.keeper END AS refers_to
FROM digests d LEFT JOIN keepers k ON d.payload_digest = k.payload_digest
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer=TOKENIZER)
    return with_checksums(read_documents(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.train(pages))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH items AS (
  SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id
), words AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM items
), wanted AS (
  SELECT item_id, term, count(*) AS times FROM words GROUP BY item_id, term
), numbered AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE doc_id IS NOT NULL
), tokens AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM numbered
), sizes AS (
  SELECT r, count(*) AS n FROM tokens GROUP BY r
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), held AS (
  SELECT r, doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM wanted) GROUP BY r, doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term
), scores AS (
  SELECT item_id, r, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM held JOIN sizes USING (r) JOIN weights USING (term) JOIN wanted USING (term), total
  GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def _matches_sql(kind: int, pattern: str, group: int, least: int) -> str:
    """r, kind, start, stop, hit of the long enough matches of a pattern; the texts between them give the places."""
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT r, {kind} AS kind, CAST(upto - length(hit) AS BIGINT) AS start, CAST(upto AS BIGINT) AS stop, hit
    FROM (
      SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY pos) AS upto
      FROM (
        SELECT r, unnest(regexp_extract_all(text, '{quoted}')) AS hit, unnest(regexp_extract_all(text, '{quoted}', {group})) AS sized,
               unnest(string_split_regex(text, '{quoted}')[:-2]) AS gap,
               unnest(range(len(regexp_extract_all(text, '{quoted}')))) AS pos
        FROM texts WHERE regexp_matches(text, '{quoted}')
      )
    ) WHERE length(sized) >= {least}"""


def _op12_sql() -> str:
    base = " UNION ALL ".join(
        _matches_sql(k, pattern, group, least) for k, (_, pattern, group, least) in enumerate(secret_scan.PATTERNS)
    )
    likely = _matches_sql(0, secret_scan.CANDIDATE, 0, secret_scan.WINDOW)
    first, shapes, bounds = len(secret_scan.PATTERNS), "", ""
    for k, (_, shape, _, bits) in enumerate(secret_scan.CLASSES, first):
        shapes += f"WHEN regexp_matches(hit, '{shape}') THEN {k} "
        bounds += f"WHEN {k} THEN {secret_scan.most_millionths(bits)} "
    allowed = " OR ".join(f"regexp_matches(hit, '{p}')" for p in secret_scan.ALLOWED)
    names = ", ".join(f"'{k}'" for k in secret_scan.KINDS)
    width = secret_scan.WINDOW
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), base AS ({base}
), likely AS (
  SELECT r, start, hit, CASE {shapes} END AS kind
  FROM ({likely}) WHERE regexp_matches(hit, '[0-9]')
    AND ((regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')) OR regexp_matches(hit, '{secret_scan.HEXADECIMAL}'))
), windows AS (
  SELECT *, unnest(range(length(hit) - {width - 1})) AS place, CASE kind WHEN {first} THEN lower(hit) ELSE hit END AS string FROM likely
), chars AS (
  SELECT r, start, hit, kind, place, unnest(string_split(substring(string, place + 1, {width}), '')) AS c FROM windows
), counts AS (
  SELECT r, start, hit, kind, place, c, count(*) AS n FROM chars GROUP BY r, start, hit, kind, place, c
), sums AS (
  SELECT r, start, hit, kind, place, CAST(sum(round(1e6 * n * log2(n))) AS BIGINT) AS bits FROM counts GROUP BY r, start, hit, kind, place
), hot AS (
  SELECT r, start, hit, kind, min(place) AS first, max(place) + {width} AS last
  FROM sums WHERE bits <= CASE kind {bounds} END GROUP BY r, start, hit, kind
), more AS (
  SELECT r, kind, start + first AS start, start + last AS stop, hit FROM hot
), spans AS (
  SELECT r, kind, start, stop FROM base
  UNION ALL
  SELECT r, kind, start, stop FROM more m
  WHERE NOT ({allowed})
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.start <= m.start AND b.stop >= m.stop)
), named AS (
  SELECT *, ([{names}])[kind + 1] || ':' || start || ':' || stop AS said FROM spans
)
SELECT any_value(t.doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
       count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(said, ',' ORDER BY start, kind, stop) FILTER (kind < {first}), '')) AS base_sha256,
       coalesce(string_agg(said, ',' ORDER BY start, kind, stop), '') AS spans
FROM texts t LEFT JOIN named n ON t.r = n.r GROUP BY t.r
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_packing": op2_packing,
    "op3_nn_descent": op3_nn_descent,
    "op4_near_dedup": op4_near_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_token_files": op9_token_files,
    "op10_html_text": op10_html_text,
    "op11_lexical_search": op11_lexical_search,
    "op12_secret_scan": op12_secret_scan,
    "op13_whitening": op13_whitening,
}

LLM_ORACLES: dict[str, str] = {
    "op6_line_dedup": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_secret_scan": _op12_sql(),
}

"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm.conversations import repair_report
from itemloom.llm.exact_dedup import deduplicate, fresh_index
from itemloom.llm.fingerprints import fingerprint_documents
from itemloom.llm.languages import crc_rest, identify_languages, learn_languages
from itemloom.llm.line_templates import drop_repeated_lines
from itemloom.llm.merkle import LOWER, UPPER, audit_documents
from itemloom.llm.mixing import repetitions
from itemloom.llm.secrets import BASE_RULES, find_secrets
from itemloom.llm.sentence_pieces import encode_documents
from itemloom.llm.similar_sets import similar_components
from itemloom.llm.texts import documents
from itemloom.llm.token_counts import token_counts
from itemloom.llm.toxicity import THRESHOLD, learn_toxicity, score_toxicity
from itemloom.llm.url_filters import judge_urls, learn_filter

WORD_MODEL = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 2048
# fixed rules: verdict, host, start of the path
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    base = [r.kind for r in BASE_RULES]

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, F.sha2(joined(of(*base)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetitions(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op2_mixing"] = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::HUGEINT AS s, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
    WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS w
  FROM docs GROUP BY source
), ordered AS (
  SELECT *, coalesce(sum(3 * s) OVER earlier, 0) AS used, coalesce(sum(w) OVER earlier, 0) AS gone,
    sum(s) OVER () AS all_s, sum(w) OVER () AS all_w
  FROM sources
  WINDOW earlier AS (ORDER BY s::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, w * (all_s - used) > 3 * s * (all_w - gone) AS capped FROM ordered
), rest AS (
  SELECT sum(s) - coalesce(sum(3 * s) FILTER (capped), 0) AS r, coalesce(sum(w) FILTER (NOT capped), 0) AS w FROM marked
), targets AS (
  SELECT source, s::BIGINT AS source_size, CASE WHEN capped THEN (3 * s)::DOUBLE
    ELSE least(m.w::DOUBLE * r.r::DOUBLE / greatest(1, r.w)::DOUBLE, (3 * s)::DOUBLE) END AS target
  FROM marked m, rest r
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    list_sum(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), i::INT, 1)) - 1)
      * power(16, 8 - i))) / 4294967296.0 AS unit
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN unit < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""


@query
def op3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_rest("doc_id", 4) == 2
    model = learn_languages(docs.where(~held_out), public_tokenizers.path(PIECE_MODEL))
    found = identify_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(documents(spark, sf_dir), public_tokenizers.path(WORD_MODEL))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(documents(spark, sf_dir))
    edited = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op6_similar_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


ORACLES["op6_similar_sets"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM words)
), sizes AS (
  SELECT doc_id, count(gram) AS n FROM words LEFT JOIN grams USING (doc_id) GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)
), ends AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT reach.doc_id, y FROM reach JOIN ends ON other = x
)
SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n
"""


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir), fresh_index(spark))


ORACLES["op7_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
"""


@query
def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(documents(spark, sf_dir), public_tokenizers.path(PIECE_MODEL))
    hashed = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return found.select("doc_id", "n_tokens", *hashed)


@query
def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(documents(spark, sf_dir))
    kept = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    return found.select("row.doc_id", "n_lines", "n_dropped", kept)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_rest("doc_id", 3) == 1
    machine = learn_toxicity(docs, labels.where(~held_out))
    found = score_toxicity(docs, machine)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted)


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# CRC-32 of a column of text, bit by bit
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(str_split({0}, ''), lambda c: ascii(c)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

ORACLES["op11_conversation_repair"] = r"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    CRC % 20 AS kind
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM marked)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged
), judged AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, role[1] AS r,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed
), faulty AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN said[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM judged
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faulty GROUP BY conv_id
), inserts(state, cost, audit, added, reached) AS (
  VALUES (0, 0, '', '', 0), (0, 3, 'I', 'user:' || chr(10), 2), (0, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 3),
    (1, 0, '', '', 1), (1, 3, 'I', 'user:' || chr(10), 2), (1, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 3),
    (2, 0, '', '', 2), (2, 3, 'I', 'assistant:' || chr(10), 3), (2, 6, 'II', 'assistant:' || chr(10) || 'user:' || chr(10), 2),
    (3, 0, '', '', 3), (3, 3, 'I', 'user:' || chr(10), 2), (3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 3)
), moves(state, initial, reached) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), ways(conv_id, i, state, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'text': ''} FROM counts
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT w.conv_id, f.i, n.reached AS state,
      {'cost': w.best.cost + s.cost + CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN m = 'K' THEN 0 ELSE 3 END,
       'audit': w.best.audit || s.audit || m, 'text': w.best.text || s.added ||
         CASE WHEN m = 'K' THEN f.role WHEN n.reached = 2 THEN 'user' ELSE 'assistant' END || ':' || f.text || chr(10)} AS best
    FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN inserts s ON s.state = w.state
      CROSS JOIN (VALUES ('K'), ('R')) e(m)
      JOIN moves n ON n.state = s.reached AND (CASE WHEN m = 'K' THEN n.initial = f.r ELSE n.initial <> 's' END)
    WHERE f.fault NOT IN ('blank', 'duplicate')
    UNION ALL
    SELECT w.conv_id, f.i, s.reached, {'cost': w.best.cost + s.cost + 4, 'audit': w.best.audit || s.audit || 'D', 'text': w.best.text || s.added}
    FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN inserts s ON s.state = w.state)
  GROUP BY conv_id, i, state
), ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.audit, 'text': w.best.text || s.added}) AS best
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts s ON s.state = w.state AND s.reached IN (0, 3)
  GROUP BY w.conv_id
)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit,
  sha256(coalesce(left(e.best.text, -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
""".replace("CRC", _CRC.format("k"))


@query
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*listed)))
    found = judge_urls(pages, learn_filter(pages, rules))
    return found.select("row.page_id", "host", "path", "rule", "verdict")


ORACLES["op12_url_filters"] = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return audit_documents(documents(spark, sf_dir), tampered, F.translate("text", UPPER, LOWER))


def _merkle_sql(levels: int = 5, tops: int = 3) -> str:
    """Trees of up to 16 ** levels documents a source, and 16 ** tops sources."""

    def leaf(text: str) -> str:
        values = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"

    def tree(name: str, height: int) -> list[str]:
        """A step for each level: the parents, and for each node the joined hashes of its siblings."""
        steps = []
        for k in range(height):
            here = f"{name}{k}"
            steps.append(
                f"""{here}s AS (SELECT a.t, a.pos, any_value(a.hash) AS hash, any_value(a.size) AS size,
  coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
  coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {here} a JOIN {here} b ON a.t = b.t AND a.pos // 16 = b.pos // 16 GROUP BY a.t, a.pos)"""
            )
            steps.append(
                f"""{name}{k + 1} AS (SELECT t, pos // 16 AS pos, (max(size) + 15) // 16 AS size,
  CASE WHEN max(size) > 1 THEN sha256(string_agg(hash, '' ORDER BY pos)) ELSE max(hash) END AS hash FROM {here} GROUP BY t, pos // 16)"""
            )
        return steps

    def folded(rows: str, names: list[str]) -> list[str]:
        """A step for each level: the siblings so far, and the node that follows from a leaf."""
        steps, before = [], rows
        for number, table in enumerate(names):
            place = "top" if table.startswith("s") else "pos"
            where = "f.t = n.t AND" if place == "pos" else ""
            steps.append(
                f"""f{number} AS (SELECT f.* REPLACE (f.{place} // 16 AS {place}, proof || CASE WHEN n.size > 1 THEN n.l || n.r ELSE '' END AS proof,
  CASE WHEN n.size > 1 THEN sha256(n.l || f.node || n.r) ELSE f.node END AS node) FROM {before} f JOIN {table} n ON {where} f.{place} = n.pos)"""
            )
            before = f"f{number}"
        return steps

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS hash, {leaf(lower)} AS other, {_CRC.format('doc_id::VARCHAR')} AS crc FROM documents)",
        """n0 AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS t,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM leaves)""",
        *tree("n", levels),
        f"s0 AS (SELECT 0 AS t, t AS pos, count(*) OVER () AS size, hash FROM n{levels})",
        *tree("s", tops),
        f"""start AS (SELECT n0.doc_id, n0.hash AS leaf, n{levels}.hash AS subroot, s{tops}.hash AS root, n0.t, n0.t AS top, n0.pos, '' AS proof,
  CASE WHEN crc % 5 = 0 THEN other ELSE n0.hash END AS node FROM n0 JOIN n{levels} ON n0.t = n{levels}.t, s{tops})""",
        *folded("start", [f"n{k}s" for k in range(levels)] + [f"s{k}s" for k in range(tops)]),
    ]
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM f{levels + tops - 1}"""
    )


ORACLES["op13_merkle_manifest"] = _merkle_sql()

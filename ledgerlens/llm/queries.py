"""The queries op1 to op13 and the pipeline, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import table
from ledgerlens.llm.decontamination import find_leaks
from ledgerlens.llm.exact_dedup import exact_dedup
from ledgerlens.llm.fingerprints import compare_with_next
from ledgerlens.llm.importance import resample
from ledgerlens.llm.license_scan import scan_licenses
from ledgerlens.llm.merkle import merkle_manifest
from ledgerlens.llm.packing import pack_documents
from ledgerlens.llm.preferences import format_preferences
from ledgerlens.llm.quality import fit_on_sample, score_quality
from ledgerlens.llm.repeats import remove_repeats
from ledgerlens.llm.secret_scan import scan_secrets
from ledgerlens.llm.simhash import simhash_groups
from ledgerlens.llm.url_filter import filter_urls


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_on_sample(docs, table(spark, sf_dir, "labels")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of one opening as pairs; one without a partner is paired with itself as it would go with another
    conversation's answer in place of its last. All pairs go through the one prefix search."""
    return format_preferences(table(spark, sf_dir, "conversations"), reject_others=True)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their proofs; where the id's CRC is divisible by 5, the text is found lower-cased."""
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_repeated_strings, op3_quality, op4_secret_scan, op5_url_filter, op6_exact_dedup, op7_packing, op8_license_scan, op9_simhash, op10_preferences, op11_manifest, op12_resampling, op13_fingerprints, pipeline)}


OP5_SQL = r"""
WITH split AS (
  SELECT page_id, regexp_extract(url, '://([^/?#]*)([^?#]*)', 1) AS host, regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), low AS (
  SELECT page_id, coalesce(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(path, '') AS path FROM split
), judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule,
    CASE WHEN starts_with(path, '/') AND (host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org') THEN 'spam-farm.example.org/'
    WHEN starts_with(path, '/') AND (host = 'cheap-pills.example.net' OR host LIKE '%.cheap-pills.example.net') THEN 'cheap-pills.example.net/'
    WHEN starts_with(path, '/') AND (host = 'casino.example.org' OR host LIKE '%.casino.example.org') THEN 'casino.example.org/'
    WHEN starts_with(path, '/') AND (host = 'adult.example.org' OR host LIKE '%.adult.example.org') THEN 'adult.example.org/' END AS other
  FROM low
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR other IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN other END AS extra_rule
FROM judged
"""

OP6_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY ALL)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""




def _crc32(hexadecimal: str) -> str:
    """SQL for the unsigned CRC-32 of bytes given as hexadecimal text: each byte is mixed in, then eight bits go."""
    byte = f"CAST('0x' || substr({hexadecimal}, 2 * CAST(b AS INT) + 1, 2) AS BIGINT)"
    steps = f"flatten(list_transform(range(length({hexadecimal}) // 2), lambda b: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295::BIGINT), 4294967295::BIGINT)"


#: Levels of a tree that the SQL side grows: 16**5 leaves, over a million.
_LEVELS = 5


def _sql_tree(name: str, leaves: str) -> str:
    """CTEs: {name}0 are the nodes (tree, pos, n, d) of `leaves`, {name}k those k levels above, {name}_root each tree's last."""
    ctes = [f"{name}0 AS ({leaves})"]
    for k in range(_LEVELS):
        ctes.append(f"{name}{k + 1} AS (SELECT tree, pos // 16 AS pos, (max(n) + 15) // 16 AS n, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 16)")
    ctes.append(f"{name}_root AS (" + " UNION ALL ".join(f"SELECT tree, d FROM {name}{k} WHERE n = 1" for k in range(_LEVELS + 1)) + ")")
    return ", ".join(ctes)


def _sql_steps(name: str) -> str:
    """CTE {name}_steps: per tree and place of a leaf the siblings before and after at each level, and whether there is one."""
    sides, joins = [], []
    for k in range(_LEVELS):
        own = f"(l.pos // {16**k})"
        joins.append(f"LEFT JOIN (SELECT tree, pos // 16 AS run, list({{'pos': pos, 'd': d}} ORDER BY pos) AS nodes FROM {name}{k} WHERE n > 1 GROUP BY ALL) r{k} ON r{k}.tree = l.tree AND r{k}.run = {own} // 16")
        sides += [f"coalesce(array_to_string(list_transform(list_filter(r{k}.nodes, lambda x: x.pos {op} {own}), lambda x: x.d), ''), '') AS {side}{k}" for op, side in (("<", "b"), (">", "a"))]
        sides.append(f"r{k}.run IS NOT NULL AS s{k}")
    return f"{name}_steps AS (SELECT l.tree, l.pos, {', '.join(sides)} FROM {name}0 l {' '.join(joins)})"


def _sql_fold(rows: str, of: str) -> str:
    """Rows whose digest `v` is folded with the steps in their struct `of`."""
    for k in range(_LEVELS):
        rows = f"(SELECT * REPLACE (CASE WHEN {of}.s{k} THEN sha256({of}.b{k} || v || {of}.a{k}) ELSE v END AS v) FROM {rows})"
    return rows


def _sql_proof(of: str) -> str:
    return " || ".join(f"{of}.b{k} || {of}.a{k}" for k in range(_LEVELS))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_leaf(text: str) -> str:
    field = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode(CAST({v} AS VARCHAR))) || ':' || {v} END"
    return "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11_SQL = f"""
WITH found AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS tree, {_sql_leaf("text")} AS leaf,
    CASE WHEN {_crc32("hex(encode(CAST(doc_id AS VARCHAR)))")} % 5 = 0 THEN {_sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM found
), {_sql_tree("g", "SELECT tree, pos, n, leaf AS d FROM leaves")}, {_sql_tree("t", "SELECT 'top' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, d FROM g_root")},
{_sql_steps("g")}, {_sql_steps("t")},
places AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM g_root),
placed AS (
  SELECT l.doc_id, l.source, leaf, subroot, t_root.d AS root, {_sql_proof("g_steps")} || {_sql_proof("t_steps")} AS proof, coalesce(other, leaf) AS v, g_steps, t_steps
  FROM leaves l JOIN g_steps ON g_steps.tree = l.tree AND g_steps.pos = l.pos JOIN places ON places.tree = l.tree JOIN t_steps ON t_steps.pos = place CROSS JOIN t_root
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, v AS folded_root, v = root AS verified, source, length(proof) // 64 AS n_siblings FROM {_sql_fold(_sql_fold("placed", "g_steps"), "t_steps")}
"""

OP12_SQL = f"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark
), words AS (
  SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), features AS (
  SELECT word, {_crc32("h")} % 10000 AS bucket FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM words)
), counted AS (
  SELECT side, id, bucket, count(*) AS times FROM words JOIN features USING (word) GROUP BY ALL
), totals AS (
  SELECT b AS bucket, coalesce(sum(times) FILTER (side = 'd'), 0) AS s, coalesce(sum(times) FILTER (side = 't'), 0) AS t FROM range(10000) r(b) LEFT JOIN counted ON bucket = b GROUP BY b
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM totals) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM totals) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM totals
), weights AS (
  SELECT id, CAST(sum(times) AS BIGINT) AS n, CAST(floor(CAST(sum(times * gain) AS DOUBLE) / sum(times)) AS BIGINT) AS weight FROM counted JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights ON id = doc_id
), placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank, n_features AS n_words FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op11_manifest": OP11_SQL, "op12_resampling": OP12_SQL}

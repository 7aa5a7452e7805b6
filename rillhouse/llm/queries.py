"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillhouse.llm import byte_bpe, collocations, decontaminate, language_id, merkle, ngram_join, quality_rules, secret_scan, simhash, substring_dedup, token_files, toxicity, url_rules
from rillhouse.llm.tables import table
from rillhouse.workspace import new_folder


OP1_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
repeats AS (
  SELECT doc_id, i FROM windows JOIN (SELECT s, min(doc_id) AS f FROM windows GROUP BY s) USING (s)
  WHERE f < doc_id),
removed AS (SELECT DISTINCT doc_id, i + k AS i FROM repeats, range(50) t(k)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words)
  ANTI JOIN removed USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(len(w), 0) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without repeated passages."""
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the token-id files have it."""
    path = new_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path).select(
        F.col("id").alias("doc_id"),
        "start",
        F.expr("cast(octet_length(tokens) div 4 as long)").alias("n_tokens"),
        F.crc32("tokens").alias("ids_crc32"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


OP5_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT * FROM shingles WHERE s IN (SELECT s FROM shingles GROUP BY s HAVING count(*) > 1)),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have
  FROM shared x JOIN shared y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
  WHERE 100 * both_have >= 75 * (p.n + q.n - both_have)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every text; ``rule`` is the learned rule that rejects it."""
    docs = table(spark, sf_dir, "documents")
    sample = quality_rules.labelled(docs, table(spark, sf_dir, "labels"))
    rules = quality_rules.fit(sample)
    judged = quality_rules.statistics(docs).select(
        "doc_id",
        *quality_rules.COUNTS[:5],
        quality_rules.base_failed().alias("base_failed"),
        quality_rules.verdict(rules).alias("rule"),
    )
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return judged.select(*judged.columns[:-1], kept.alias("kept"), "rule")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and their decoded bytes, as digests."""
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


#: Fixed values: the rules to judge by.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


OP8_SQL = f"""
WITH rules(rule_verdict, rule) AS (VALUES {", ".join(map(str, URL_RULES))}),
parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
fits AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(rule_verdict, length(rule)) AS rule_verdict
  FROM split JOIN rules
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM split LEFT JOIN fits USING (page_id)
"""


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page."""
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that contain a test item, with the item, its score and its words there."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LEVELS = 5


def _merkle_levels(name: str, first: str, levels: int) -> str:
    """Levels 0.. of the trees over ``first`` (g, i, h), and the text beside each node in its run."""
    parts = [f"{name}0 AS (SELECT * FROM {first})"]
    for k in range(levels):
        run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
        parts.append(f"""{name}{k}b AS (
  SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n,
    coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k})""")
        parts.append(f"""{name}{k + 1} AS (
  SELECT g, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
  FROM {name}{k}b GROUP BY g, i // 16)""")
    return ",\n".join(parts)


def _merkle_climb(name: str, levels: int, before: str, group: str) -> str:
    """Proof and folded digest of every row of ``before`` (doc_id, g, i, ..., proof, fold), level by level."""
    parts = []
    for k in range(levels):
        parts.append(f"""{name}_up{k} AS (
  SELECT x.* REPLACE (x.proof || CASE WHEN n > 1 THEN l || r ELSE '' END AS proof,
    CASE WHEN n > 1 THEN sha256(l || fold || r) ELSE fold END AS fold, x.{group} // 16 AS {group})
  FROM {before} x JOIN {name}{k}b y ON x.{"g" if name == "leaf" else "top"} = y.g AND x.{group} = y.i)""")
        before = f"{name}_up{k}"
    return ",\n".join(parts)


OP11_SQL = rf"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda c, _:
    CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
rows AS (
  SELECT *, coalesce('=' || source, '') AS g,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 5 = 0 AS tampered,
    translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low
  FROM documents, crc_table),
texts AS (
  SELECT doc_id, g, tampered, concat(
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text, low
  FROM rows),
leaves AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE leaf END AS fold
  FROM texts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
firsts AS (SELECT g, i, leaf AS h FROM ranked),
{_merkle_levels("leaf", "firsts", _LEVELS)},
subroots AS (SELECT g AS s, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS j FROM leaf{_LEVELS}),
tops AS (SELECT '' AS g, j AS i, subroot AS h FROM subroots),
{_merkle_levels("top", "tops", _LEVELS)},
start AS (SELECT doc_id, g, i, leaf, subroot, j, '' AS top, '' AS proof, fold FROM ranked JOIN subroots ON g = s),
{_merkle_climb("leaf", _LEVELS, "start", "i")},
{_merkle_climb("top", _LEVELS, f"leaf_up{_LEVELS - 1}", "j")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
FROM top_up{_LEVELS - 1}, top{_LEVELS}
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every document, folded with the document as found: some were tampered with."""
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = merkle.leaf_digest({c: F.col(c) for c in merkle.COLUMNS} | {"text": lower})
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    shown = F.when(hit, tampered).otherwise(merkle.leaf_digest())
    manifest = merkle.build(docs, carried={"shown": shown})
    proofs = merkle.prove(manifest, manifest.leaves)
    return proofs.select(
        F.col("id").alias("doc_id"),
        F.col("found").alias("leaf"),
        "subroot",
        F.lit(manifest.root).cast("string").alias("root"),
        merkle.proof_digest().alias("proof_sha256"),
        merkle.folded("shown").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
counted AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
common AS (SELECT * FROM counted WHERE a >= 100),
cuts AS (
  SELECT c.*, cut, string_split(phrase, ' ') AS w FROM common c, range(1, 5) t(cut) WHERE cut < k),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, n,
    ((1000::HUGEINT * c.a::HUGEINT * n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN sizes USING (lang)
  JOIN common x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN common y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a
  FROM (SELECT lang, k, string_split(phrase, ' ') AS w, a FROM common WHERE k > 2), range(1, 5) s(i), range(2, 5) t(m)
  WHERE m < k AND i + m - 1 <= k),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (
  SELECT 1 FROM inside x WHERE x.lang = b.lang AND x.phrase = b.phrase AND x.a >= b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and its component of near fingerprints."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_token_files, op4_toxicity, op5_ngram_join, op6_quality_rules, op7_byte_bpe, op8_url_rules, op9_secret_scan, op10_decontaminate, op11_merkle_manifest, op12_collocations, op13_simhash)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {"op1_substring_dedup": OP1_SQL, "op5_ngram_join": OP5_SQL, "op8_url_rules": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_collocations": OP12_SQL}

"""Registered queries of the operators in this subpackage and their SQL where SQL has the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import (
    brown,
    divergence,
    licenses,
    linedup,
    packing,
    pcadedup,
    repeats,
    resample,
    simhash,
    sitetree,
    templates,
    toxicity,
    urlrules,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(_table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "source", "text", "n_dropped")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = templates.find_leaks(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return leaks.drop("text_key")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlrules.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_pca_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pcadedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )
    return scored.select("doc_id", "held_out", F.col("score"), "predicted")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_brown_score,
        op2_simhash_dedup,
        op3_line_dedup,
        op4_packing,
        op5_license_scan,
        op6_site_tree,
        op7_decontamination,
        op8_url_rules,
        op9_pca_dedup,
        op10_toxicity,
        op11_resampling,
        op12_substring_dedup,
        op13_divergence_audit,
    )
}

ORACLE = {
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT DISTINCT source, text, trim(line) AS line
  FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE trim(line) <> ''
), pages AS (
  SELECT source, count(DISTINCT text) AS n FROM documents GROUP BY source
), common AS (
  SELECT source, line FROM lines JOIN pages USING (source)
  GROUP BY source, line, n
  HAVING count(*) >= {linedup.MIN_PAGES} AND count(*) > {linedup.MAX_RATIO} * n
), sets AS (
  SELECT source, list(line) AS lines FROM common GROUP BY source
), kept AS (
  SELECT doc_id, d.source, d.text, string_split(d.text, chr(10)) AS every,
         [x for x in string_split(d.text, chr(10))
          if NOT list_contains(coalesce(s.lines, []), trim(x))] AS rest
  FROM documents d LEFT JOIN sets s ON d.source = s.source
)
SELECT doc_id, source, array_to_string(rest, chr(10)) AS text,
       CAST(len(every) - len(rest) AS INTEGER) AS n_dropped
FROM kept
""",
    "op8_url_rules": """
WITH split AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
         ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), ranked AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path
                            ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
  FROM split LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE place = 1
""",
    "op9_pca_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in e if x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
    ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.other = l.x
), lowest AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), counts AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM lowest LEFT JOIN counts ON vec_id = x
""",
    "op11_resampling": r"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM (SELECT unnest(range(256)) AS i)
), every AS (
  SELECT 's' AS side, doc_id, text FROM documents
  UNION ALL SELECT 't', NULL, text FROM benchmark
), found AS (
  SELECT row_number() OVER () AS row, side, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM every
), tokens AS (
  SELECT row, side, unnest(words) AS word FROM found
), hexed AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM tokens)
), bytes AS (
  SELECT word, [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(x) // 2)] AS b
  FROM hexed
), buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, y:
           xor(c >> 8, steps[xor(c & 255, y) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc
), counts AS (
  SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t
  FROM tokens JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE
           / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM counts
), weights AS (
  SELECT row, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM tokens JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(
           '2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
           / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM found LEFT JOIN weights USING (row) WHERE side = 's'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20
              ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
         (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) AS quota
  FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= quota THEN place END AS rank
FROM ranked
""",
    "op12_substring_dedup": r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT row, doc_id, pos, sha256(array_to_string(words[pos:pos + 49], ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(words) - 48)) AS pos FROM t WHERE doc_id IS NOT NULL)
), lows AS (
  SELECT h, min(doc_id) AS low FROM windows GROUP BY h
), covered AS (
  SELECT DISTINCT row, unnest(range(pos, pos + 50)) AS k
  FROM windows JOIN lows USING (h) WHERE doc_id > low
), gone AS (
  SELECT row, list(k) AS at FROM covered GROUP BY row
), each AS (
  SELECT t.row, doc_id, words, unnest(range(1, len(words) + 1)) AS k FROM t
), rest AS (
  SELECT e.row, string_agg(e.words[e.k], ' ' ORDER BY e.k) AS kept, count(*) AS n
  FROM each e ANTI JOIN covered c ON e.row = c.row AND e.k = c.k GROUP BY e.row
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN rest USING (row)
""",
    "op13_divergence_audit": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), tokens AS (
  SELECT row, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS c FROM tokens GROUP BY lang, term
  HAVING count(DISTINCT row) >= 10
), counts AS (
  SELECT lang, source, term, count(*) AS c
  FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source) USING (lang, source)
  LEFT JOIN (SELECT lang, v FROM sizes) USING (lang)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (g.n + 2 * g.v) AS p
  FROM groups g JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT x.lang, x.source, y.source AS item,
         sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
  GROUP BY ALL
), pair AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
), above AS (
  SELECT s.lang, s.source, s.term AS item, p,
         1 + 1000000000::HUGEINT * (k.c + 2) // (z.n + 2 * z.v) AS q
  FROM shares s JOIN kept k USING (lang, term) JOIN sizes z USING (lang) WHERE s.c > 0
), joint AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, (p - q) * (p - q) // (p + q) FROM above WHERE p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM joint
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
""",
}

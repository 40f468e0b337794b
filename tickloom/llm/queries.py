"""Queries of the text operators and their SQL twins, one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, chat, collocations, decontam, hilbert, langid, linededup, lines, minhash, pii, quality, urls, variants
from tickloom.llm.common import Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The key of the surrogates; a real run takes it from a secret store.
PII_KEY = "key-of-the-registered-query"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_pii_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", F.col("_n_entities").alias("n_entities"))


OP2_SQL = """
WITH parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE
    WHEN regexp_matches(host || path, '(^|[^0-9A-Za-z])spam-farm($|[^0-9A-Za-z])') THEN '^spam-farm^'
    WHEN regexp_matches(host || path, '(^|[^0-9A-Za-z])free-bets($|[^0-9A-Za-z])') THEN '^free-bets^'
    WHEN regexp_matches(host || path, '(^|[^0-9A-Za-z])casino-') THEN '^casino-*'
    WHEN regexp_matches(host || path, '(?s)(^|[^0-9A-Za-z])poker($|[^0-9A-Za-z]).*\\.exe') THEN '^poker^*.exe'
    WHEN regexp_matches(host || path, '(^|[^0-9A-Za-z])adult-') THEN '^adult-*' END AS pattern
  FROM parsed
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(rule, pattern) AS matched
FROM ruled
"""


@query("op2_url_filters", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


OP3_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'none') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, sum(length(text)) AS chars,
    max(CASE WHEN i = 1 THEN role || chr(31) || text END) AS opening
  FROM t GROUP BY conv_id
), ranked AS (
  SELECT *, first_value(conv_id) OVER (PARTITION BY opening ORDER BY n DESC, chars DESC, conv_id) AS chosen_id FROM c
), p AS (
  SELECT i.*, a.n AS nc, b.n AS nr FROM (
    SELECT chosen_id, conv_id AS rejected_id FROM ranked WHERE conv_id <> chosen_id
    UNION SELECT a.conv_id, b.conv_id FROM c a JOIN c b ON b.conv_id = a.conv_id + 1 WHERE b.conv_id % 2 <> 0
  ) i JOIN c a ON a.conv_id = i.chosen_id JOIN c b ON b.conv_id = i.rejected_id
), differs AS (
  SELECT p.chosen_id, p.rejected_id, min(a.i) AS at
  FROM p JOIN t a ON a.conv_id = p.chosen_id JOIN t b ON b.conv_id = p.rejected_id AND b.i = a.i
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY ALL
), q AS (
  SELECT p.*, coalesce(d.at - 1, least(nc, nr)) AS k FROM p LEFT JOIN differs d USING (chosen_id, rejected_id)
), r AS (
  SELECT conv_id, i, role,
    '<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS piece,
    length(replace(role, '<|', '< |')) + 5 AS head
  FROM t
), side AS (
  SELECT q.chosen_id, q.rejected_id, s.side, r.i, r.role, r.piece, r.head, r.i <= q.k AS shared,
    sum(length(r.piece)) OVER (PARTITION BY q.chosen_id, q.rejected_id, s.side, r.i <= q.k ORDER BY r.i) AS stop
  FROM q, (VALUES ('c'), ('r')) s(side)
  JOIN r ON r.conv_id = CASE WHEN s.side = 'c' THEN q.chosen_id ELSE q.rejected_id END
), made AS (
  SELECT chosen_id, rejected_id,
    coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 'c' AND shared), '') AS prompt,
    coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 'c' AND NOT shared), '') AS chosen_text,
    coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 'r' AND NOT shared), '') AS rejected_text,
    coalesce(string_agg((stop - length(piece) + head)::BIGINT || '-' || (stop - 1)::BIGINT, ';' ORDER BY i) FILTER (side = 'c' AND NOT shared AND role = 'assistant'), '') AS chosen_loss,
    coalesce(string_agg((stop - length(piece) + head)::BIGINT || '-' || (stop - 1)::BIGINT, ';' ORDER BY i) FILTER (side = 'r' AND NOT shared AND role = 'assistant'), '') AS rejected_loss
  FROM side GROUP BY chosen_id, rejected_id
)
SELECT q.chosen_id, q.rejected_id, q.k::INTEGER AS prompt_turns,
  CASE WHEN k < nc AND k < nr THEN 'pair' WHEN k < nc OR k < nr THEN 'prefix' ELSE 'identical' END AS status,
  prompt, chosen_text, chosen_loss, rejected_text, rejected_loss
FROM q JOIN made USING (chosen_id, rejected_id)
"""


@query("op3_preference_chat", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = Scratch(spark, "chat").put(chat.conversations_as_arrays(table(spark, sf_dir, "conversations")), "conversations")
    return chat.format_preferences(chat.preference_pairs(convs))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])
    return rows.select("doc_id", F.col("_quality.weak_label").alias("weak_label"), F.col("_quality.score").alias("score"), F.col("_quality.kept").alias("kept"))


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", (F.size("_found") > 0).alias("contaminated"), (F.size("_found") == 0).alias("kept"),
        F.transform("_found", lambda f: f["item_id"]).alias("item_ids"), F.array_min(F.transform("_found", lambda f: f["distance"])).alias("distance"),
    )


@query("op6_hilbert_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_rows(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = langid.fit(docs.where(~held_out))
    rows = langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return rows.select("doc_id", "held_out", "_lang.lang_pred", "_lang.score", "_lang.far")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id, min(r.other) = d.doc_id AS kept
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""


@query("op8_near_duplicates", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 5)
), dup AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id
), ln AS (
  SELECT doc_id, host, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) AS k,
    len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS words
  FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS x FROM d)
), per AS (
  SELECT doc_id, host, k, sum(words) AS words, len(string_split(k, ' ')) >= 10 AS long FROM ln WHERE k <> '' GROUP BY ALL
), often AS (
  SELECT host, k FROM per JOIN (SELECT host, count(*) AS docs FROM d GROUP BY host) USING (host)
  GROUP BY host, k, docs, long HAVING count(*) > 20 AND (long OR count(*) > 0.005 * docs)
), gone AS (
  SELECT doc_id, sum(words) AS n FROM per JOIN often USING (host, k) GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(gone.n, 0))::BIGINT AS words_left
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, words_left,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left >= 0.5 * n_words AS kept
FROM base
"""


@query("op9_line_quality", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "_bpe.n_tokens", "_bpe.ids_sha256", "_bpe.decoded_sha256")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d
), k AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), often AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT doc_id, i, line, holder IS NOT NULL AND holder <> doc_id AS gone FROM k LEFT JOIN often USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op11_line_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = linededup.deduplicated(docs, linededup.keep_bitmaps(docs))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, w[i:i + k - 1] AS ws, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k))
), f AS (
  SELECT lang, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, any_value(k) AS k, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30
), f2 AS (
  SELECT lang, phrase, any_value(ws) AS ws, any_value(k) AS k, sum(f)::HUGEINT AS f FROM f GROUP BY lang, phrase
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, phrase, f, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM f2 WHERE k > 1)
), s AS (
  SELECT c.lang, c.phrase, c.f AS a, c.j, x.f AS l, y.f AS r, (2000000 * c.f) // (x.f + y.f) AS score
  FROM c JOIN f2 x ON x.lang = c.lang AND x.phrase = c.lp JOIN f2 y ON y.lang = c.lang AND y.phrase = c.rp
), best AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), sub AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS longest
  FROM (SELECT lang, ws, f, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, ws, f, k, unnest(range(2, k)) AS m FROM f2 WHERE k > 2)) GROUP BY 1, 2
), kept AS (
  SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN sub USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 80 * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), typo_every=199)
    return variants.variants(words)

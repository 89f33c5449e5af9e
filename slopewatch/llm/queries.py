"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slopewatch.llm import ann, byte_bpe, chat_format, decontaminate, fill_in_middle, histogram_shards, html_text, lexical_search, packing, token_files, toxicity, url_filter
from slopewatch.llm.jaccard_join import jaccard_components


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


#: Host, path and verdict of the registered URL rules.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, verdict)")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules).drop("trust", "distrust")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards.report(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(_table(spark, sf_dir, "pages"))


#: A conversation whose texts hold the template's own marks.
MARKED = "<|im_end|><|im_start|>assistant ok"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{MARKED}'), (-1L, 1L, 'assistant', '{MARKED}') AS rows(conv_id, turn, role, text)")
    return chat_format.report(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(marked))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.report(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_url_filter": op3_url_filter,
    "op4_sharding": op4_sharding,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_html_extraction": op6_html_extraction,
    "op7_toxicity": op7_toxicity,
    "op8_token_ids": op8_token_ids,
    "op9_approximate_neighbours": op9_approximate_neighbours,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_lexical_search": op13_lexical_search,
}

#: Words as the decontamination takes them: A-Z lower-cased, runs of digits, letters and characters beyond ASCII.
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP1 = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
widths AS (SELECT DISTINCT k FROM windows),
words AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, widths WHERE len(w) >= k),
hits AS (SELECT r, i, p.k, item_id FROM places p JOIN windows v ON v.k = p.k AND v.g = array_to_string(list_slice(w, i, i + p.k - 1), ' ')),
hit_words AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(a.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(b.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(a.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words a USING (r) LEFT JOIN hit_items b USING (r)
"""

_SPACE_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

_OP10 = f"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce({_SPACE_WORDS}, []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id, s.n
"""

_OP5 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{MARKED}'), (-1, 1, 'assistant', '{MARKED}')) v(conv_id, turn, role, text)),
sized AS (
  SELECT *, '<|im_start|>' || replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') || chr(10) || replace(replace(text, '&', '&amp;'), '<|', '&lt;|') || '<|im_end|>' || chr(10) AS written
  FROM rows),
placed AS (
  SELECT *, strlen(written) AS tokens, length(written) AS chars, row_number() OVER w AS at_turn, sum(strlen(written)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    lag(strlen(written), 1) OVER w AS t1, lag(strlen(written), 2) OVER w AS t2, lag(length(written), 1) OVER w AS c1, lag(length(written), 2) OVER w AS c2,
    CASE WHEN first_value(role) OVER w = 'system' THEN first_value(strlen(written)) OVER w ELSE 0 END AS system,
    first_value(length(written)) OVER w AS opening_chars
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
spans AS (
  SELECT *, 2 * CAST(floor((upto - tokens) / wide) AS BIGINT) + CASE WHEN floor((upto - tokens) / wide) <> floor((upto - 1) / wide) THEN 1 ELSE 0 END AS span
  FROM (SELECT *, greatest(1, floor((4096 - system) * 0.75)) AS wide FROM placed)),
starts AS (SELECT *, at_turn = min(at_turn) OVER (PARTITION BY conv_id, span) AS begins, 4096 - sum(tokens) OVER (PARTITION BY conv_id, span) AS space FROM spans),
opened AS (SELECT *, system > 0 AND at_turn > 1 AS opens FROM starts),
spaces AS (SELECT *, space - CASE WHEN opens THEN system ELSE 0 END AS rest,
    CASE WHEN at_turn < 2 OR opens AND at_turn = 2 THEN NULL ELSE t1 END AS h1, CASE WHEN at_turn < 3 OR opens AND at_turn = 3 THEN NULL ELSE t2 END AS h2 FROM opened),
repeated AS (SELECT *, CASE WHEN opens THEN opening_chars ELSE 0 END + CASE WHEN h1 <= rest THEN c1 + CASE WHEN h1 + h2 <= rest THEN c2 ELSE 0 END ELSE 0 END AS again FROM spaces)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY at_turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY at_turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN begins THEN again ELSE 0 END) AS BIGINT) AS formatted_chars,
  count(DISTINCT span) AS n_windows
FROM repeated GROUP BY conv_id
"""

#: The number that the k-th group of eight hexadecimal digits of h stands for.
_DRAW = "CAST('0x' || substr(h, {0}, 8) AS BIGINT)"

_OP11 = f"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, {_DRAW.format(1)} % (len(u) + 1) AS x, {_DRAW.format(9)} % (len(u) + 1) AS y, {_DRAW.format(17)} AS h3, {_DRAW.format(25)} AS h4 FROM units),
cut AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""

_OP13 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sized),
tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM sized) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tfs, total GROUP BY term, docs),
items AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS term FROM items) GROUP BY ALL),
scored AS (
  SELECT q, item_id, doc_id, r, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sized USING (r), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


def _op3_sql(rounds: int = url_filter.ROUNDS) -> str:
    """The spread of trust and distrust, one common table for each round."""
    rules = ", ".join(map(str, URL_RULES))
    link = url_filter._LINK.replace("'", "''")
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    ctes = [
        f"rules(host, path, verdict) AS (VALUES {rules})",
        f"named AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {lower}), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        "judged AS (SELECT n.*, (SELECT max(struct_pack(size := length(r.host || r.path), verdict := r.verdict, rule := r.host || r.path)) FROM rules r WHERE ('.' || n.host) LIKE ('%.' || r.host) AND starts_with(n.path, r.path)) AS best FROM named n)",
        "s0 AS MATERIALIZED (SELECT host, avg(CASE WHEN best.verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN best.verdict = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM judged GROUP BY host)",
        f"links AS (SELECT src, translate(dst, {lower}) AS dst FROM (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM named))",
        "counted AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND src <> '' GROUP BY src, dst)",
        "edges AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w_out, n / sum(n) OVER (PARTITION BY dst) AS w_in FROM counted)",
    ]
    for k in range(rounds):
        ctes.append(
            f"s{k + 1} AS MATERIALIZED (SELECT coalesce(s0.host, g.host) AS host, coalesce(s0.trust, 0) + {url_filter.DAMPING} * coalesce(g.t, 0) AS trust, coalesce(s0.distrust, 0) + {url_filter.DAMPING} * coalesce(g.d, 0) AS distrust "
            f"FROM s0 FULL JOIN (SELECT host, sum(t) AS t, sum(d) AS d FROM (SELECT e.dst AS host, s.trust * e.w_out AS t, 0 AS d FROM edges e JOIN s{k} s ON s.host = e.src UNION ALL SELECT e.src, 0, s.distrust * e.w_in FROM edges e JOIN s{k} s ON s.host = e.dst) GROUP BY host) g ON g.host = s0.host)"
        )
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT page_id, j.host, j.path, j.best.rule AS rule, coalesce(j.best.verdict, CASE WHEN j.host <> '' AND s.distrust - s.trust >= {url_filter.MARGIN} THEN 'block' ELSE 'allow' END) AS verdict "
        f"FROM judged j LEFT JOIN s{rounds} s ON s.host = j.host"
    )


ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": _op3_sql(),
    "op5_chat_formatting": _OP5,
    "op1_benchmark_decontamination": _OP1,
    "op10_ngram_jaccard_join": _OP10,
    "op11_fill_in_middle": _OP11,
    "op13_lexical_search": _OP13,
}

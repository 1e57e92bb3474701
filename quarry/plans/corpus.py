"""Queries over page and chunk operators, each with the SQL it must equal."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, derivation, filters, pages
from quarry.sources.datasets import checksum
from quarry.sources.tables import table

PAGES_SQL = r"""
pg AS (SELECT doc_id, source AS report_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pdf_page,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), chr(0), '', 'g'), '\r\n?', chr(10), 'g'),
    '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents)"""
CHUNKS_SQL = PAGES_SQL + """,
ck0 AS (SELECT *, unnest(generate_series(0, CASE WHEN length(text) <= 800 THEN 0 ELSE ceil((length(text) - 800) / 680.0)::INT END)) AS i FROM pg WHERE length(text) > 0),
ck AS (SELECT doc_id, report_id, pdf_page, i AS chunk_index, i * 680 AS start_char, least(i * 680 + 800, length(text)) AS end_char,
  substr(text, i * 680 + 1, 800) AS text, format('{:012d}_{:05d}', doc_id, i) AS chunk_id FROM ck0)"""
SEGMENTS = (("a", "identity", 1, 10, None, None), ("b", "offset", 11, 30, None, -10), ("c", "custom", 26, 40, 100, None))
SEGMENTS_SQL = """
seg AS (SELECT DISTINCT report_id, m AS mapping_id, rt AS rule_type, s AS pdf_page_start, e AS pdf_page_end, p AS printed_page_start, o AS offs FROM pg,
  (VALUES ('a', 'identity', 1, 10, NULL, NULL), ('b', 'offset', 11, 30, NULL, -10), ('c', 'custom', 26, 40, 100, NULL)) v(m, rt, s, e, p, o)),
hit AS (SELECT pg.report_id, pdf_page, mapping_id, CASE rule_type WHEN 'identity' THEN pdf_page WHEN 'offset' THEN pdf_page + offs
    ELSE printed_page_start + pdf_page - pdf_page_start END AS printed_page, row_number() OVER (PARTITION BY pg.report_id, pdf_page ORDER BY mapping_id) AS n
  FROM pg LEFT JOIN seg ON pg.report_id = seg.report_id AND pdf_page BETWEEN pdf_page_start AND pdf_page_end),
res AS (SELECT report_id, pdf_page, mapping_id, printed_page, CASE WHEN mapping_id IS NULL THEN 'unmapped' ELSE 'mapped' END AS mapping_status FROM hit WHERE n = 1)"""


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.pages_of(table(spark, sf_dir, "documents"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(page_table(spark, sf_dir))


def segment_table(page: DataFrame) -> DataFrame:
    """Three ranges per report, with an overlap and a gap."""
    fields = ("mapping_id", "rule_type", "pdf_page_start", "pdf_page_end", "printed_page_start", "offset")
    rows = F.array(*[F.struct(*[F.lit(v).cast("string" if k < 2 else "int").alias(n) for k, (n, v) in enumerate(zip(fields, s))]) for s in SEGMENTS])
    return page.select("report_id").distinct().select("report_id", F.inline(rows))


def p1_page_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(spark, sf_dir).select("doc_id", "report_id", F.col("pdf_page").cast("long").alias("pdf_page"), F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha256"), "content_type")


def p6_page_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = page_table(spark, sf_dir).select("report_id", "pdf_page")
    return pages.resolve(page, segment_table(page)).withColumn("pdf_page", F.col("pdf_page").cast("long")).withColumn("printed_page", F.col("printed_page").cast("long"))


def p8_mapping_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.audit(p6_page_mapping(spark, sf_dir)).select("report_id", "pages", "mapped_pages", "shared_printed_pages")


def p9_segment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = page_table(spark, sf_dir)
    return pages.segment_violations(segment_table(page), page.groupBy("report_id").agg(F.max("pdf_page").alias("pages")))


def p11_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.summary(page_table(spark, sf_dir)).withColumn("last_page", F.col("last_page").cast("long"))


def _paragraphs(page: str | None) -> dict:
    """A plain extractor of web pages: its paragraphs of text alone; a page without an article is an error."""
    if page is None or "<article" not in page:
        raise ValueError(f"no article in a page of {len(page or '')} characters {page}")
    return {"text": "\n".join(re.findall("<p>([^<]*)</p>", page)), "text_block_count": page.count("<p"), "image_block_count": page.count("<img")}


def p5_page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, of which every ninth has lost its article, and every fortieth its text."""
    html = F.when(F.pmod("page_id", F.lit(9)) == 0, F.replace("html", F.lit("<article"), F.lit("<x"))).when(F.pmod("page_id", F.lit(40)) == 1, F.lit(None).cast("string")).otherwise(F.col("html"))
    out = pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")), "html", _paragraphs, ["page_id", "url"])
    return out.select("page_id", "url", "parse_status", "content_type", F.sha2("normalized_text", 256).alias("text_sha256"), "raw_char_count", "normalized_char_count", *pages.COUNTERS, "parse_error")


def k14_facts_from_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document a claim on its first chunk: a label and a value out of the text. Every seventh value is not there,
    every eleventh label neither, every thirteenth chunk, and units of every seventeenth are unknown; documents of one
    source and place in 50 claim the same fact."""
    c = chunk_table(spark, sf_dir)
    own = c.select("chunk_id", F.lit("c").alias("company_id"), "report_id", F.col("doc_id").cast("string").alias("document_id"), "pdf_page", "text", "doc_id", "chunk_index")
    every = lambda n: F.pmod("doc_id", F.lit(n)) == 0
    specs = own.filter("chunk_index = 0").select(
        F.when(every(13), F.concat("chunk_id", F.lit("x"))).otherwise(F.col("chunk_id")).alias("chunk_id"), F.concat_ws("_", "report_id", F.pmod("doc_id", F.lit(50))).alias("metric_id"), F.lit(2024).alias("fiscal_year"), F.lit("note").alias("statement_type"),
        F.lit("consolidated").alias("statement_scope"), F.when(every(11), F.lit("no such label")).otherwise(F.substring("text", 3, 9)).alias("row_label"), F.lit("2024").alias("column_label"), F.when(every(7), F.lit("no such value")).otherwise(F.substring("text", 12, 5)).alias("cell_value"),
        (F.col("doc_id") / 4).cast("decimal(20,2)").alias("raw_value"), F.when(every(17), F.lit("USD")).otherwise(F.lit("CNY_thousand")).alias("raw_unit"),
    )
    facts, evidences, links, bad = derivation.from_specs(specs, own)
    joined = facts.join(links, "fact_id").join(evidences.select("evidence_id", "source_hash", "document_id"), "evidence_id")
    good = joined.select("metric_id", F.col("document_id").alias("claim"), F.col("normalized_value"), "source_hash", F.lit(None).cast("string").alias("rule_id"))
    return good.unionByName(bad.select("metric_id", F.col("chunk_id").alias("claim"), F.lit(None).cast("decimal(38,4)").alias("normalized_value"), F.lit(None).cast("string").alias("source_hash"), "rule_id"))


def c1_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_table(spark, sf_dir)
    return c.select("chunk_id", "doc_id", *[F.col(x).cast("long").alias(x) for x in ("chunk_index", "start_char", "end_char")], F.sha2("text", 256).alias("text_sha256"))


def c2_paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = chunking.paragraph_spans(page_table(spark, sf_dir), r"\n")
    return s.select("doc_id", *[F.col(x).cast("long").alias(x) for x in ("paragraph_index", "start_char", "end_char")])


def c3_paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.paragraph_chunks(page_table(spark, sf_dir), r"\n")
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in out.columns[1:]])


def c11_chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_table(spark, sf_dir)
    return c.groupBy("report_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"), F.countDistinct("doc_id").alias("pages"))


def t_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    n = lambda c: F.size(c).cast("long")
    return table(spark, sf_dir, "documents").select(
        "doc_id", n(T.ascii_tokens(t)).alias("ascii_tokens"), n(T.lexical_tokens(t)).alias("lexical_tokens"), n(T.bigrams(t)).alias("bigrams"),
        n(T.bigrams(t, digits=True)).alias("bigrams_with_digits"), F.length(T.compact(t)).cast("long").alias("compact_chars"),
    )


def s9_dataset_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "n_chars"], ["source"])


#: The tables hold no numbered headings: short sentences stand for them, their level told by the first letter.
LETTERS = ("^[A-F]", "^[G-M]", "^[N-Z]")


def c6_section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sentences cut at headings, with the section in force."""
    page = page_table(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit("\n")))
    out = chunking.section_chunks(page, "\n", patterns=LETTERS)
    longs = [F.col(c).cast("long").alias(c) for c in ("chunk_index", "start_char", "end_char", "section_page")]
    return out.select("doc_id", *longs, F.array_join("section_path", " / ").alias("section_path"), "section_inherited")


def f2_filter_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that each of many filters lets through: by report and language, pages 1 to 40, half by report alone."""
    page = page_table(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("report_type")), "doc_id")
    kinds = page.select("report_id", "report_type").distinct()
    some = F.sequence(F.lit(1).cast(page.schema["pdf_page"].dataType), F.lit(40).cast(page.schema["pdf_page"].dataType))
    asked = kinds.select(F.concat_ws("/", "report_id", "report_type").alias("query_id"), F.array("report_id", "report_id", F.lit("other")).alias("report_ids"), F.array_compact(F.array("report_type")).alias("report_types"), F.when(F.col("report_type").isin("de", "fr"), some).alias("pdf_pages"))
    found = filters.eligible(asked, page.select("doc_id", "report_id", "pdf_page", "report_type", F.length("text").alias("chars")))
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"))


QUERIES = {f.__name__: f for f in (p1_page_normalize, p6_page_mapping, p8_mapping_audit, p9_segment_violations, p11_page_summary, p5_page_records, k14_facts_from_specs, c1_fixed_chunks, c2_paragraph_spans, c3_paragraph_chunks, c6_section_chunks, c11_chunk_summary, f2_filter_matches, t_text_features, s9_dataset_checksum)}

PACKED = """
s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pg),
o AS (SELECT doc_id, p, coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, i FROM s),
sp AS (SELECT doc_id, a, a + length(p) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM o WHERE p <> ''),
nx AS (SELECT x.doc_id, x.k, greatest(x.k, coalesce(max(y.k), x.k)) AS j FROM sp x LEFT JOIN sp y ON y.doc_id = x.doc_id AND y.k >= x.k AND y.z - x.a <= 800 GROUP BY x.doc_id, x.k),
la AS (SELECT doc_id, max(k) AS m FROM sp GROUP BY doc_id),
ch AS (SELECT nx.doc_id, nx.k, nx.j, m FROM nx JOIN la USING (doc_id) WHERE nx.k = 0 UNION ALL SELECT nx.doc_id, nx.k, nx.j, m FROM ch JOIN nx ON nx.doc_id = ch.doc_id AND nx.k = greatest(ch.k + 1, ch.j) WHERE ch.j < ch.m),
cs AS (SELECT ch.doc_id, ch.k, ch.j, x.a, y.z FROM ch JOIN sp x ON x.doc_id = ch.doc_id AND x.k = ch.k JOIN sp y ON y.doc_id = ch.doc_id AND y.k = ch.j),
w AS (SELECT *, unnest(CASE WHEN z - a > 800 THEN range(a, greatest(a + 1, z - 120), 680) ELSE [a] END) AS st FROM cs)"""
ORACLES = {
    "p5_page_records": r"""WITH h AS (SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN replace(html, '<article', '<x') WHEN page_id % 40 = 1 THEN NULL ELSE html END AS html FROM pages),
x AS (SELECT *, html IS NULL OR NOT contains(html, '<article') AS bad, array_to_string(regexp_extract_all(html, '<p>([^<]*)</p>', 1), chr(10)) AS raw FROM h),
n AS (SELECT *, CASE WHEN bad THEN '' ELSE raw END AS t, CASE WHEN bad THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, chr(0), '', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') END AS norm,
  CASE WHEN bad THEN 0 ELSE len(regexp_extract_all(html, '<p')) END AS tb, CASE WHEN bad THEN 0 ELSE len(regexp_extract_all(html, '<img')) END AS ib FROM x)
SELECT page_id, url, CASE WHEN bad THEN 'parse_error' ELSE 'success' END AS parse_status, CASE WHEN bad THEN 'unknown' WHEN norm <> '' THEN 'text' WHEN ib > 0 THEN 'scanned' ELSE 'empty' END AS content_type, sha256(norm) AS text_sha256,
  length(t) AS raw_char_count, length(norm) AS normalized_char_count, tb AS text_block_count, ib AS image_block_count, 0::BIGINT AS embedded_image_count,
  CASE WHEN bad THEN substr('ValueError: no article in a page of ' || coalesce(length(html), 0) || ' characters ' || coalesce(html, 'None'), 1, 1000) END AS parse_error FROM n""",
    "k14_facts_from_specs": f"""WITH {CHUNKS_SQL},
s AS (SELECT doc_id, text, CASE WHEN doc_id % 13 = 0 THEN chunk_id || 'x' ELSE chunk_id END AS chunk_id, report_id || '_' || (doc_id % 50) AS metric_id, CASE WHEN doc_id % 11 = 0 THEN 'no such label' ELSE substr(text, 3, 9) END AS label,
  CASE WHEN doc_id % 7 = 0 THEN 'no such value' ELSE substr(text, 12, 5) END AS value FROM ck WHERE chunk_index = 0),
j AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'unknown_chunk' WHEN trim(label, ' ') = '' OR NOT contains(text, label) THEN 'row_label_missing' WHEN trim(value, ' ') = '' OR NOT contains(text, value) THEN 'cell_value_missing' WHEN doc_id % 17 = 0 THEN 'unknown_unit' END AS rule_id FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY label, value, chunk_id) AS n FROM j WHERE rule_id IS NULL)
SELECT metric_id, doc_id::VARCHAR AS claim, ((doc_id / 4.0)::DECIMAL(20,2) * 1000)::DECIMAL(38,4) AS normalized_value, sha256(text) AS source_hash, NULL AS rule_id FROM g WHERE n = 1
UNION ALL SELECT metric_id, chunk_id, NULL, NULL, 'repeated_fact' FROM g WHERE n > 1 UNION ALL SELECT metric_id, chunk_id, NULL, NULL, rule_id FROM j WHERE rule_id IS NOT NULL""",
    "p1_page_normalize": f"WITH {PAGES_SQL} SELECT doc_id, report_id, pdf_page, length(text) AS chars, sha256(text) AS text_sha256, CASE WHEN text <> '' THEN 'text' ELSE 'empty' END AS content_type FROM pg",
    "p6_page_mapping": f"WITH {PAGES_SQL}, {SEGMENTS_SQL} SELECT * FROM res",
    "p8_mapping_audit": f"""WITH {PAGES_SQL}, {SEGMENTS_SQL}, g AS (SELECT report_id, printed_page, count(*) AS n, count(mapping_id) AS m FROM res GROUP BY ALL)
SELECT report_id, sum(n)::BIGINT AS pages, sum(m)::BIGINT AS mapped_pages, count(*) FILTER (printed_page IS NOT NULL AND n > 1) AS shared_printed_pages FROM g GROUP BY report_id""",
    "p9_segment_violations": f"""WITH {PAGES_SQL}, {SEGMENTS_SQL}, c AS (SELECT report_id, max(pdf_page) AS pages FROM pg GROUP BY report_id),
s AS (SELECT *, max(pdf_page_end) OVER (PARTITION BY report_id ORDER BY pdf_page_start, pdf_page_end, mapping_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM seg JOIN c USING (report_id))
SELECT report_id, mapping_id, 'empty_range' AS rule_id FROM s WHERE pdf_page_end < pdf_page_start UNION ALL SELECT report_id, mapping_id, 'past_last_page' FROM s WHERE pdf_page_end > pages
UNION ALL SELECT report_id, mapping_id, 'overlap' FROM s WHERE before >= pdf_page_start""",
    "p11_page_summary": f"""WITH {PAGES_SQL} SELECT report_id, count(*) AS pages, sum(length(text))::BIGINT AS chars, max(pdf_page) AS last_page, count(*) FILTER (text <> '') AS text_pages,
0::BIGINT AS mixed_pages, 0::BIGINT AS scanned_pages, count(*) FILTER (text = '') AS empty_pages FROM pg GROUP BY report_id""",
    "c1_fixed_chunks": f"WITH {CHUNKS_SQL} SELECT chunk_id, doc_id, chunk_index, start_char, end_char, sha256(text) AS text_sha256 FROM ck",
    "c2_paragraph_spans": f"""WITH {PAGES_SQL}, s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM pg),
o AS (SELECT *, coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char FROM s)
SELECT doc_id, i AS paragraph_index, start_char, start_char + length(p) AS end_char FROM o WHERE p <> ''""",
    "c3_paragraph_chunks": f"""WITH RECURSIVE {PAGES_SQL}, {PACKED}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, st) - 1 AS chunk_index, st AS start_char, least(st + 800, z) AS end_char, k AS first_paragraph, j AS last_paragraph FROM w""",
    "c6_section_chunks": f"""WITH RECURSIVE {PAGES_SQL.replace("pg AS", "pg0 AS")}, pg AS (SELECT doc_id, report_id, pdf_page, replace(text, '. ', chr(10)) AS text FROM pg0), {PACKED},
tc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, st) AS ci, st, least(st + 800, z) AS en FROM w),
hd AS (SELECT report_id, pdf_page, doc_id, a + length(p) - length(regexp_replace(p, '^\\s+', '')) AS h, trim(p) AS title,
  CASE WHEN regexp_matches(trim(p), '^[A-F]') THEN 1 WHEN regexp_matches(trim(p), '^[G-M]') THEN 2 WHEN regexp_matches(trim(p), '^[N-Z]') THEN 3 END AS lv
  FROM o JOIN pg USING (doc_id) WHERE length(trim(p)) <= 50 AND NOT regexp_matches(trim(p), '[。；，.;,]$') AND lv IS NOT NULL),
bd AS (SELECT doc_id, ci, en, st AS b FROM tc UNION SELECT tc.doc_id, ci, en, h FROM tc JOIN hd ON hd.doc_id = tc.doc_id AND h > st AND h < en),
pc AS (SELECT doc_id, b, coalesce(lead(b) OVER (PARTITION BY doc_id, ci ORDER BY b), en) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY ci, b) - 1 AS idx FROM bd),
ev AS (SELECT report_id, pdf_page, h AS pos, 0 AS kind, lv, pdf_page * 100000000 + h AS key, NULL::BIGINT AS doc_id, NULL::BIGINT AS idx, NULL::BIGINT AS e FROM hd
  UNION ALL SELECT report_id, pdf_page, b, 1, NULL::INT, NULL::BIGINT, doc_id, idx, e FROM pc JOIN pg USING (doc_id)),
wn AS (SELECT *, max(CASE WHEN lv = 1 THEN key END) OVER w1 AS k1, max(CASE WHEN lv = 2 THEN key END) OVER w1 AS k2, max(CASE WHEN lv = 3 THEN key END) OVER w1 AS k3 FROM ev
  WINDOW w1 AS (PARTITION BY report_id ORDER BY pdf_page, pos, kind ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT report_id, pdf_page, pos, doc_id, idx, e, k1, CASE WHEN k1 IS NULL OR k2 > k1 THEN k2 END AS k2, CASE WHEN (k1 IS NULL OR k3 > k1) AND (k2 IS NULL OR k3 > k2) THEN k3 END AS k3 FROM wn WHERE kind = 1)
SELECT lv.doc_id, idx AS chunk_index, pos AS start_char, e AS end_char, coalesce(k3, k2, k1) // 100000000 AS section_page, concat_ws(' / ', a.title, b.title, c.title) AS section_path,
  coalesce(coalesce(k3, k2, k1) // 100000000 <> lv.pdf_page, FALSE) AS section_inherited
FROM lv LEFT JOIN hd a ON a.report_id = lv.report_id AND a.pdf_page * 100000000 + a.h = k1 LEFT JOIN hd b ON b.report_id = lv.report_id AND b.pdf_page * 100000000 + b.h = k2 LEFT JOIN hd c ON c.report_id = lv.report_id AND c.pdf_page * 100000000 + c.h = k3""",
    "f2_filter_matches": f"""WITH {PAGES_SQL}, p AS (SELECT pg.*, lang FROM pg JOIN documents USING (doc_id)), k AS (SELECT DISTINCT report_id, lang FROM p)
SELECT concat_ws('/', k.report_id, k.lang) AS query_id, count(*) AS pages, sum(length(text))::BIGINT AS chars FROM k JOIN p ON p.report_id = k.report_id AND (k.lang IS NULL OR p.lang = k.lang)
  AND (k.lang IS NULL OR k.lang NOT IN ('de', 'fr') OR pdf_page <= 40) GROUP BY 1""",
    "c11_chunk_summary": f"WITH {CHUNKS_SQL} SELECT report_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars, count(DISTINCT doc_id) AS pages FROM ck GROUP BY report_id",
    "t_text_features": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(lower(coalesce(text, '')), '[^\pL]', '', 'g') AS l, regexp_replace(lower(coalesce(text, '')), '[^\pL\pN]', '', 'g') AS ln FROM documents)
SELECT doc_id, len(regexp_extract_all(lower(t), '[a-z0-9]+')) AS ascii_tokens, len(list_filter(regexp_extract_all(lower(t), '[A-Za-z_]+|[\x{4E00}-\x{9FFF}]{2,}'), lambda x: length(x) >= 2)) AS lexical_tokens,
  CASE WHEN length(l) < 2 THEN 0 ELSE len(list_distinct(list_transform(range(1, length(l)), lambda i: substr(l, i, 2)))) END AS bigrams,
  CASE WHEN length(ln) < 2 THEN 0 ELSE len(list_distinct(list_transform(range(1, length(ln)), lambda i: substr(ln, i, 2)))) END AS bigrams_with_digits,
  length(regexp_replace(t, '\s+', '', 'g')) AS compact_chars FROM d""",
    "s9_dataset_checksum": r"""WITH h AS (SELECT source, sha256('=' || doc_id || chr(31) || coalesce('=' || text, '~') || chr(31) || coalesce('=' || lang, '~') || chr(31) || coalesce('=' || n_chars, '~')) AS h FROM documents),
g AS (SELECT source, count(*) AS rows, sum(('0x' || substr(h, 1, 12))::BIGINT)::VARCHAR AS a, sum(('0x' || substr(h, 13, 12))::BIGINT)::VARCHAR AS b, sum(('0x' || substr(h, 25, 12))::BIGINT)::VARCHAR AS c FROM h GROUP BY source)
SELECT source, rows, sha256(rows || '-' || a || '-' || b || '-' || c) AS checksum FROM g""",
}

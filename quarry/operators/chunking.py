"""Chunks of pages: fixed windows, paragraphs, packed paragraphs, headings and sections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 800, 120
#: The three heading levels (number patterns).
HEADINGS = (r"^第[一二三四五六七八九十百零〇0-9]+节", r"^[一二三四五六七八九十百零〇]+、", r"^[（(][一二三四五六七八九十百零〇0-9]+[）)]")
SENTENCE_END = r"[。；，.;,]$"
#: A report's pages are read in ranges of so many: what a range leaves in force goes on to the next.
RANGE = 1000


def fixed_chunks(pages: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Windows of max_chars that step by max_chars - overlap; the last ends at the text's end. Empty pages give none: told
    after the explode, as a filter on a text made from others would go below joins and shuffles and make it there again."""
    n, step = F.length("text"), max_chars - overlap
    last = F.when(n <= max_chars, 0).otherwise(F.ceil((n - max_chars) / step)).cast("int")
    rows = pages.select("*", F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), last))).alias("chunk_index")).filter("chunk_index is not null")
    start = F.col("chunk_index") * step
    rows = rows.select("*", start.alias("start_char"), F.least(start + max_chars, n).alias("end_char"))
    text = F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return rows.withColumn("text", text).withColumn("chunk_id", F.format_string("%012d_%05d", "doc_id", "chunk_index"))


def paragraph_spans(pages: DataFrame, separator: str = r"\n{2,}") -> DataFrame:
    """Paragraphs with their offsets; blank ones are left out. doc_id is one page's alone."""
    parts, gaps = F.split("text", separator), F.regexp_extract_all("text", F.lit(f"({separator})"), 1)
    rows = pages.select(*pages.columns, F.posexplode(F.arrays_zip(parts.alias("p"), gaps.alias("g"))).alias("paragraph_index", "_s")).drop("text")
    before = Window.partitionBy("doc_id").orderBy("paragraph_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_s.p") + F.coalesce(F.length("_s.g"), F.lit(0))).over(before), F.lit(0)).cast("int")
    rows = rows.withColumn("start_char", start).withColumn("paragraph", F.col("_s.p")).drop("_s").filter(F.col("paragraph") != "")
    return rows.withColumn("end_char", F.col("start_char") + F.length("paragraph"))


def pack(spans: list[tuple[int, int]], max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) paragraphs of each chunk: as many as fit, the next starting `overlap` paragraphs back, one forward at least."""
    out, i = [], 0
    while i < len(spans):
        j = i
        while j + 1 < len(spans) and spans[j + 1][1] - spans[i][0] <= max_chars:
            j += 1
        out.append((i, j))
        if j + 1 >= len(spans):
            break
        i = max(i + 1, j + 1 - overlap)
    return out


def paragraph_chunks(pages: DataFrame, separator: str = r"\n{2,}", max_chars: int = MAX_CHARS, overlap: int = 1) -> DataFrame:
    """Greedy packing of a page's paragraphs; a paragraph over max_chars is cut into fixed windows. A page is the unit of work."""
    spans = F.array_sort(F.collect_list(F.struct("start_char", "end_char")))
    grouped = paragraph_spans(pages.select("doc_id", "text"), separator).groupBy("doc_id").agg(spans.alias("spans"))
    step = max_chars - OVERLAP

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, spans in zip(f["doc_id"], f["spans"]):
                spans, k = [(s["start_char"], s["end_char"]) for s in spans], 0
                for a, b in pack(spans, max_chars, overlap):
                    start, end = spans[a][0], spans[b][1]
                    for s in range(start, max(start + 1, end - OVERLAP), step) if end - start > max_chars else [start]:
                        rows.append((doc, k, s, min(s + max_chars, end), a, b))
                        k += 1
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start_char", "end_char", "first_paragraph", "last_paragraph"])

    return grouped.mapInPandas(run, "doc_id long, chunk_index int, start_char int, end_char int, first_paragraph int, last_paragraph int")


def heading_level(line: Column, max_chars: int = 50, patterns: tuple[str, ...] = HEADINGS) -> Column:
    fits = (F.length(line) <= max_chars) & ~line.rlike(SENTENCE_END)
    out = F.lit(None).cast("int")
    for level, pattern in reversed(list(enumerate(patterns, 1))):
        out = F.when(line.rlike(pattern), F.lit(level)).otherwise(out)
    return F.when(fits, out)


def headings(pages: DataFrame, max_chars: int = 50, patterns: tuple[str, ...] = HEADINGS) -> DataFrame:
    """Heading lines of pages with their level and where they start. Pages without one are left out before lines are placed."""
    lines = F.split(F.translate("text", "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029", "\n" * 9), "\n")
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    level = lambda x: heading_level(bare(x), max_chars, patterns)
    rows = pages.select("report_id", "pdf_page", lines.alias("_l")).filter(F.exists("_l", lambda x: level(x).isNotNull()))
    rows = rows.select("report_id", "pdf_page", F.posexplode("_l").alias("line", "_x"))
    before = Window.partitionBy("report_id", "pdf_page").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_x") + 1).over(before), F.lit(0)) + F.length("_x") - F.length(F.regexp_replace("_x", r"(?U)^\s+", ""))
    rows = rows.select("report_id", "pdf_page", "line", bare(F.col("_x")).alias("title"), level(F.col("_x")).alias("level"), start.cast("int").alias("start_char"))
    return rows.filter("level is not null")


def sections_at(places: DataFrame, headed: DataFrame, carry: bool = True) -> DataFrame:
    """places(report_id, pdf_page, start_char, ..) plus section_path, section_page (the page of the deepest heading) and
    section_inherited (that page is another). A heading of a level ends those of its level and deeper; one at the place
    itself counts. Without carry each page starts anew.

    In force at a level is the last heading of it, unless a higher level had a later one. Last ones are maxima, so ranges of
    pages are summed up first and no report has to meet in one window."""
    levels, by = (1, 2, 3), ["report_id", "_r"]
    zone = (F.floor(F.col("pdf_page") / RANGE) if carry else F.col("pdf_page")).alias("_r")
    mark = F.struct("pdf_page", "start_char", "title")
    own = [F.when(F.col("level") == k, mark) for k in levels]
    titles = headed.select("report_id", zone, "pdf_page", "start_char", F.lit(0).alias("_kind"), *[c.alias(f"_m{k}") for k, c in zip(levels, own)], F.lit(None).cast(places.select(F.struct("*")).schema[0].dataType).alias("_p"))
    asked = places.select("report_id", zone, "pdf_page", "start_char", F.lit(1).alias("_kind"), *[F.lit(None).cast(titles.schema[f"_m{k}"].dataType).alias(f"_m{k}") for k in levels], F.struct("*").alias("_p"))
    events = titles.unionByName(asked)
    here = Window.partitionBy(*by).orderBy("pdf_page", "start_char", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumns({f"_m{k}": F.max(f"_m{k}").over(here) for k in levels}).filter("_kind = 1")
    if carry:
        ends = events.groupBy(*by).agg(*[F.max(f"_m{k}").alias(f"_m{k}") for k in levels])
        past = Window.partitionBy("report_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
        rows = rows.join(ends.select(*by, *[F.max(f"_m{k}").over(past).alias(f"_e{k}") for k in levels]), by)
        rows = rows.withColumns({f"_m{k}": F.greatest(f"_m{k}", f"_e{k}") for k in levels})
    later = lambda a, b: F.coalesce(F.col(f"_m{a}") > F.col(f"_m{b}"), F.lit(True))
    live = F.array_compact(F.array("_m1", F.when(later(2, 1), F.col("_m2")), F.when(later(3, 1) & later(3, 2), F.col("_m3"))))
    rows = rows.select("_p.*", live.alias("_live"))
    page = F.try_element_at("_live", F.lit(-1))["pdf_page"]
    return rows.select(*places.columns, F.transform("_live", lambda x: x["title"]).alias("section_path"), page.alias("section_page"), F.coalesce(page != F.col("pdf_page"), F.lit(False)).alias("section_inherited"))


def section_paths(headed: DataFrame) -> DataFrame:
    """The section in force at each heading."""
    return sections_at(headed, headed).select("report_id", "pdf_page", "line", "level", "title", "section_path")


def section_chunks(pages: DataFrame, separator: str = r"\n{2,}", max_chars: int = MAX_CHARS, overlap: int = 1, carry: bool = True, patterns: tuple[str, ...] = HEADINGS) -> DataFrame:
    """Packed paragraphs cut at the headings inside them and numbered anew in each page, with the section in force at their
    start. pages(doc_id, report_id, pdf_page, text); titles go with places, not with texts."""
    headed = headings(pages, patterns=patterns)
    at = pages.select("doc_id", "report_id", "pdf_page")
    inside = headed.groupBy("report_id", "pdf_page").agg(F.array_sort(F.collect_set("start_char")).alias("_h"))  # a page is the unit of work
    rows = paragraph_chunks(pages, separator, max_chars, overlap).join(at, "doc_id").join(inside, ["report_id", "pdf_page"], "left")
    cuts = F.filter(F.coalesce("_h", F.array().cast("array<int>")), lambda h: (h > F.col("start_char")) & (h < F.col("end_char")))
    ends = F.concat(F.array("start_char"), cuts, F.array("end_char"))
    rows = rows.withColumn("_c", ends).withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("_c") - 2)))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "_k")) - 1
    rows = rows.select("doc_id", "report_id", "pdf_page", number.alias("chunk_index"), F.get("_c", F.col("_k")).alias("start_char"), F.get("_c", F.col("_k") + 1).alias("end_char"), "first_paragraph", "last_paragraph")
    return sections_at(rows, headed, carry)


def build_chunks(pages: DataFrame, strategy: str, **options) -> DataFrame:
    """Chunks by the named strategy with the same leading columns: doc_id, chunk_index, start_char, end_char, text."""
    made = {"fixed_length": fixed_chunks, "paragraph": paragraph_chunks, "section_paragraph": section_chunks}[strategy](pages, **options)
    first = ["doc_id", "chunk_index", "start_char", "end_char"]
    rest = [c for c in made.columns if c not in [*first, "text", *pages.columns]]
    cut = F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    whole = made.select(*first, *rest).join(pages.select("doc_id", "text"), "doc_id")
    return whole.select(*first, cut.alias("text"), *rest)


def chunk_violations(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks that are not the page's text between their offsets, pages without chunks, indices with gaps."""
    whole = pages.select("doc_id", F.col("text").alias("page_text"))
    both = chunks.join(whole, "doc_id", "left")
    same = F.substring("page_text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("text")
    wrong = both.filter(~F.coalesce(same, F.lit(False))).select("chunk_id", F.lit("text_differs").alias("rule_id"))
    bare = pages.filter(F.length("text") > 0).join(chunks.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit("page_without_chunk").alias("rule_id"))
    gaps = chunks.groupBy("doc_id").agg(F.max("chunk_index").alias("m"), F.countDistinct("chunk_index").alias("n")).filter("m + 1 <> n").select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit("index_gap").alias("rule_id"))
    return wrong.unionByName(bare).unionByName(gaps)

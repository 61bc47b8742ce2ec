"""One query an operator, over the test tables, with its DuckDB oracle where SQL can say it.

The tables hold no specifications, so adapters give them that shape: parts are sections (a brand is a
comparison, even keys its base), regions, nations and suppliers nest into Markdown, HTML pages become
lines, neighbouring turns of a conversation are text pairs, events are outcomes and replies. Word lists
are parameters and name words that occur in the data.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import fixed
from driftline.functions import text as tx
from driftline.functions.durable import durable
from driftline.operators import align, analyze, boilerplate, cluster, report, sections, textdiff
from driftline.sources.tables import table

PART_WORDS = ("widget", "bolt", "gear", "ring", "economy", "standard", "promo")
BOILER = boilerplate.Boilerplate(enabled=True, titles=("license", "copyright", "www."), signals=("©", "all rights reserved", "license", "confidential"), extra=("permission is hereby",))
PATTERNS = (("law", ("license", "copyright"), 5), ("mail", ("@mail", "example.com"), 7), ("key", ("password", "token", "akia"), 9), ("lists", (" | ",), 5), ("and", ("and", "und"), 1))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _any(words) -> str:
    return "|".join(re.escape(w.lower()).replace("'", "''") for w in words)


# ---- adapters


def part_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_brand").alias("pair_id"),
        F.when(F.col("p_partkey") % 2 == 0, "base").otherwise("compare").alias("role"),
        F.col("p_partkey").alias("seq"),
        F.col("p_size").cast("string").alias("number"),
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"),
        F.concat_ws("\n", "p_name", "p_type", F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("content"),
        F.col("p_size").cast("string").alias("page"),
    )


_PARTS = """SELECT p_brand AS pair_id, CASE WHEN p_partkey % 2 = 0 THEN 'base' ELSE 'compare' END AS role, p_partkey AS seq,
 CAST(p_size AS VARCHAR) AS number, p_name || ' ' || lower(p_type) AS title,
 p_name || chr(10) || p_type || chr(10) || 'size ' || p_size AS content, CAST(p_size AS VARCHAR) AS page FROM part"""


def spec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown specification for each region: the region, its nations, their suppliers."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    doc = F.col("r_name").alias("doc_id")
    rows = r.select(doc, F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0).alias("page_num"), F.concat(F.lit("# "), F.col("r_regionkey") + 1, F.lit(". "), "r_name").alias("text"))
    rn = r.join(n, r.r_regionkey == n.n_regionkey)
    rows = rows.union(rn.select(doc, F.col("n_nationkey").cast("long"), F.lit(-1).cast("long"), F.col("n_nationkey") + 1, F.concat(F.lit("## "), F.col("r_regionkey") + 1, F.lit("."), F.col("n_nationkey") + 1, F.lit(" "), "n_name")))
    sn = rn.join(s, rn.n_nationkey == s.s_nationkey)
    named = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("### "), "s_name")).otherwise(F.concat(F.col("s_name"), F.lit(" deals here")))
    rows = rows.union(sn.select(doc, F.col("n_nationkey").cast("long"), F.col("s_suppkey").cast("long"), F.col("n_nationkey") + 1, named))
    w = Window.partitionBy("doc_id").orderBy("a", "b")
    return rows.select("doc_id", F.row_number().over(w).alias("line_no"), "page_num", "text")


_SPEC = """spec AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS line_no, page_num, text FROM (
 SELECT r_name AS doc_id, -1 AS a, -1 AS b, 0 AS page_num, '# ' || (r_regionkey + 1) || '. ' || r_name AS text FROM region
 UNION ALL SELECT r_name, n_nationkey, -1, n_nationkey + 1, '## ' || (r_regionkey + 1) || '.' || (n_nationkey + 1) || ' ' || n_name FROM region JOIN nation ON r_regionkey = n_regionkey
 UNION ALL SELECT r_name, n_nationkey, s_suppkey, n_nationkey + 1, CASE WHEN s_suppkey % 5 = 0 THEN '### ' || s_name ELSE s_name || ' deals here' END
 FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey))"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    text = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "\n")
    pages = p.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_num"), text.alias("text"))
    return sections.pages_to_lines(pages)


_PAGE_LINES = """pl AS (SELECT page_id AS doc_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS line_no, text FROM (
 SELECT page_id, unnest(l) AS text, generate_subscripts(l, 1) AS k FROM (
 SELECT page_id, string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10)) AS l FROM pages)))"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("next"))


# ---- lines and sections

_CLEAN = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')), lambda x: x <> '')"


@query(f"SELECT doc_id, length(array_to_string({_CLEAN}, chr(10))) AS n_chars_clean, md5(array_to_string({_CLEAN}, chr(10))) AS digest, len({_CLEAN}) AS n_lines FROM documents")
def clean_text(spark, sf_dir):
    t = tx.clean_text(F.col("text"))
    n = F.when(t == "", 0).otherwise(F.size(F.split(t, "\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars_clean"), F.md5(t).alias("digest"), n.cast("long").alias("n_lines"))


_SENTENCES = r"list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?。！？])[\t\n\x0B\f\r ]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')"


@query(f"SELECT doc_id, len({_SENTENCES}) AS n_sentences, md5(array_to_string({_SENTENCES}, chr(1))) AS digest FROM documents")
def sentence_split(spark, sf_dir):
    s = tx.sentences(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "\x01")).alias("digest"))


_HEAD = "CASE " + " ".join(f"WHEN regexp_matches(trim(text, ' '), '{p}') THEN {d}" for p, _, d in fixed.HEADINGS) + " END"
_TITLE = "CASE " + " ".join(f"WHEN regexp_matches(trim(text, ' '), '{p}') THEN trim(regexp_extract(trim(text, ' '), '{p}', {g}), ' ')" for p, g, _ in fixed.HEADINGS) + " END"
_TOC = f"(length(trim(text, ' ')) > 40 AND regexp_matches(trim(text, ' '), '{fixed.TOC_LINE}'))"
_DROP = "(length(trim(text, ' ')) < 3 OR " + " OR ".join(f"regexp_matches(trim(text, ' '), '{p}')" for p in fixed.RUNNING_HEADS) + ")"
_KIND = f"CASE WHEN {_DROP} THEN 'drop' WHEN {_TOC} THEN 'toc' WHEN ({_HEAD}) IS NOT NULL THEN 'heading' WHEN length(trim(text, ' ')) < 20 THEN 'short' ELSE 'paragraph' END"


@query(f"WITH {_PAGE_LINES} SELECT {_KIND} AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM pl GROUP BY 1")
def line_class(spark, sf_dir):
    return sections.classify(page_lines(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_NUMBERED = "SELECT c_custkey AS k, unnest([CAST(c_nationkey AS VARCHAR) || '. ' || c_name, c_nationkey || '.' || c_custkey || ' ' || c_mktsegment, c_nationkey || '.' || c_custkey || '.3 ' || c_name, 'Annex ' || chr(CAST(65 + c_nationkey AS INTEGER)) || '. ' || c_name, chr(CAST(65 + c_nationkey AS INTEGER)) || '. ' || c_name, c_nationkey || '-2 ' || c_name, c_name]) AS text FROM customer"


def _numbered(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    letter = F.char(65 + F.col("c_nationkey").cast("long"))
    dot, lit = F.concat, F.lit
    texts = F.array(dot(n, lit(". "), "c_name"), dot(n, lit("."), k, lit(" "), "c_mktsegment"), dot(n, lit("."), k, lit(".3 "), "c_name"), dot(lit("Annex "), letter, lit(". "), "c_name"), dot(letter, lit(". "), "c_name"), dot(n, lit("-2 "), "c_name"), "c_name")
    return c.select(F.col("c_custkey").alias("k"), F.explode(texts).alias("text"))


@query(f"SELECT k, text, {_HEAD} AS level, {_TITLE} AS title FROM ({_NUMBERED})")
def headings(spark, sf_dir):
    return _numbered(spark, sf_dir).withColumn("h", tx.heading(F.col("text"))).select("k", "text", "h.level", "h.title")


_INFERRED = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN trim(regexp_extract(text, '{p}', {g}), ' ')" for p, g in fixed.NUMBERED_TITLES) + " END"


@query(f"SELECT k, text, CASE WHEN regexp_matches(text, '^\\d+(\\.\\d+)*\\s+.+$') THEN len(string_split(regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\s', 1), '.')) WHEN regexp_matches(text, '^[A-Z]\\.\\s+.+$') OR regexp_matches(text, '^(?i:(Annex|Appendix)\\s+[A-Z]\\.?\\s+.+)$') THEN 1 END AS level, {_INFERRED} AS title FROM ({_NUMBERED})")
def docx_titles(spark, sf_dir):
    found = tx.numbered_title(F.col("text"))
    return _numbered(spark, sf_dir).select("k", "text", found["level"].cast("long").alias("level"), found["title"].alias("title"))


@query("SELECT p_partkey, s AS style, CASE WHEN s LIKE 'Heading 1%' OR s = 'Title' THEN 1 WHEN s LIKE 'Heading 2%' THEN 2 WHEN s LIKE 'Heading 3%' THEN 3 WHEN s = 'Caption' THEN 0 END AS level FROM (SELECT p_partkey, ['Heading 1', 'Heading 2 Char', 'heading 3', 'Title', 'Caption', 'Normal'][1 + p_partkey % 6] AS s0, replace(s0, 'heading 3', 'Heading 3') AS s FROM part)")
def style_levels(spark, sf_dir):
    style = F.get(F.array(*map(F.lit, ("Heading 1", "Heading 2 Char", "Heading 3", "Title", "Caption", "Normal"))), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", style.alias("style"), tx.style_level(style).alias("level"))


@query(f"WITH {_PAGE_LINES}, k AS (SELECT *, {_KIND} AS kind, {_HEAD} AS level, {_TITLE} AS title FROM pl) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (kind = 'heading') AS n_headings, md5(string_agg(CASE WHEN kind = 'heading' THEN title ELSE trim(text, ' ') END, chr(10) ORDER BY line_no)) AS digest FROM k WHERE kind IN ('heading', 'paragraph') GROUP BY doc_id")
def pages_to_markdown(spark, sf_dir):
    md = sections.to_markdown(page_lines(spark, sf_dir)).withColumn("h", F.col("text").rlike(r"^#{1,6} \S"))
    body = F.when(F.col("h"), F.regexp_replace("text", r"^#+ \S+ ", "")).otherwise(F.col("text"))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", body.alias("t")))), lambda x: x["t"]), "\n")
    return md.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("h").alias("n_headings"), F.md5(one).alias("digest"))


@query(f"WITH {_SPEC}, m AS (SELECT doc_id, line_no * 2 AS line_no, text, NULL AS p FROM spec UNION ALL SELECT doc_id, line_no * 2 + 1, '<!-- page ' || page_num || ' -->', page_num FROM spec WHERE text LIKE '## %') SELECT doc_id, line_no, text, page_num FROM (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS page_num FROM m) WHERE p IS NULL")
def page_carry(spark, sf_dir):
    s = spec_lines(spark, sf_dir)
    marks = s.filter(F.col("text").startswith("## ")).select("doc_id", (F.col("line_no") * 2 + 1).alias("line_no"), F.concat(F.lit("<!-- page "), "page_num", F.lit(" -->")).alias("text"))
    return sections.page_carry(s.select("doc_id", (F.col("line_no") * 2).alias("line_no"), "text").union(marks))


_HEADS = f"""{_SPEC}, h AS (SELECT *, length(regexp_extract(text, '^(#{{1,6}}) ', 1)) AS level, trim(regexp_replace(text, '^#+ ', ''), ' ') AS raw FROM spec WHERE text LIKE '#%')"""
_NESTED = "(SELECT min(g.line_no) FROM h g WHERE g.doc_id = h.doc_id AND g.level <= h.level AND g.line_no > h.line_no)"
_NUMBER = "regexp_extract(e.raw, '^([0-9A-Za-z]+(?:\\.[0-9A-Za-z]+)*)', 1)"


def _sections_sql(end: str) -> str:
    return f"""WITH {_HEADS}, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS seq, {end} AS end_line FROM h)
 SELECT e.doc_id, e.seq, replace({_NUMBER}, '.', '_') AS id, e.level, {_NUMBER} AS number, trim(substr(e.raw, length({_NUMBER}) + 1), ' ') AS title, e.raw, e.page_num, e.end_line,
 trim(coalesce((SELECT string_agg(s.text, chr(10) ORDER BY s.line_no) FROM spec s WHERE s.doc_id = e.doc_id AND s.line_no > e.line_no AND s.line_no < coalesce(e.end_line, 1000000000)), ''), ' ') AS content FROM e"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "seq", "id", "level", "number", "title", "raw", "page_num", "end_line", "content")


@query(_sections_sql("lead(line_no) OVER (PARTITION BY doc_id, level ORDER BY line_no)"))
def sections_compat(spark, sf_dir):
    return _shown(sections.sections(spec_lines(spark, sf_dir), compat=True))


@query(_sections_sql(_NESTED))
def sections_nested(spark, sf_dir):
    return _shown(sections.sections(spec_lines(spark, sf_dir)))


@query("WITH s AS (SELECT s_nationkey AS d, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS seq, s_suppkey % 53 AS p, s_acctbal > 0 AS numbered FROM supplier), t AS (SELECT c_nationkey AS d, c_custkey AS i, c_custkey % 97 AS p FROM customer) SELECT d AS doc_id, i AS table_index, tp AS table_page, seq AS section_seq FROM (SELECT t.d, t.i, t.p AS tp, s.seq, row_number() OVER (PARTITION BY t.d, t.i ORDER BY abs(s.p - t.p), CASE WHEN s.p = t.p AND s.numbered THEN 0 ELSE 1 END, CASE WHEN s.p = t.p THEN -s.seq ELSE s.seq END) AS r FROM t LEFT JOIN s ON s.d = t.d) WHERE r = 1")
def table_nearest(spark, sf_dir):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), (F.row_number().over(w) - 1).alias("seq"), (F.col("s_suppkey") % 53).cast("int").alias("page_num"), F.when(F.col("s_acctbal") > 0, "1").otherwise("").alias("number"))
    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("table_index"), (F.col("c_custkey") % 97).cast("int").alias("page_num"))
    return sections.associate_tables(t, s)


def _tables(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    s = lambda c: F.col(c).cast("string")
    cells = F.array(F.array(F.lit("key"), F.lit("name\n(full)")), F.array(s("n_nationkey"), s("n_name")), F.array(s("n_regionkey"), F.lit(None).cast("string")))
    return n.select(s("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("table_index"), (F.col("n_nationkey") + 1).alias("page_num"), cells.alias("cells"), F.lit(None).cast("double").alias("accuracy"))


_TABLE_MD = "'| key | name (full) |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10) || '| ' || n_regionkey || ' |  |'"


@query(f"SELECT n_nationkey AS table_index, {_TABLE_MD} AS markdown FROM nation")
def table_md(spark, sf_dir):
    return _tables(spark, sf_dir).select("table_index", tx.table_markdown(F.col("cells")).alias("markdown"))


@query(f"SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, '## Tables' || chr(10) || chr(10) || string_agg('### Table ' || n_nationkey || chr(10) || '<!-- page ' || (n_nationkey + 1) || ' -->' || chr(10) || {_TABLE_MD}, chr(10) || chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey")
def tables_appendix(spark, sf_dir):
    return sections.tables_appendix(_tables(spark, sf_dir))


@query(f"""WITH {_HEADS}, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS seq, {_NESTED} AS end_line FROM h),
 t AS (SELECT r_name AS doc_id, n_nationkey AS table_index, n_nationkey + 1 AS page_num, {_TABLE_MD} AS md FROM nation JOIN region ON r_regionkey = n_regionkey),
 place AS (SELECT t.doc_id, table_index, t.page_num, md, arg_max(coalesce(end_line - 1, 2147483646), seq) AS line_no FROM t JOIN e ON e.doc_id = t.doc_id AND e.page_num = t.page_num GROUP BY ALL),
 every AS (SELECT doc_id, line_no, page_num, -1 AS part, 0 AS k, text FROM spec UNION ALL SELECT doc_id, line_no, page_num, table_index, generate_subscripts(l, 1), unnest(l) FROM (SELECT *, string_split(md, chr(10)) AS l FROM place))
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part, k) AS line_no, page_num, text FROM every""")
def tables_inserted(spark, sf_dir):
    lines, t = spec_lines(spark, sf_dir), _tables(spark, sf_dir)
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("k"), "r_name")
    t = t.join(r, t.doc_id == r.k).drop("doc_id", "k").withColumnRenamed("r_name", "doc_id")
    found = sections.sections(lines)
    return sections.insert_tables(lines, t, sections.associate_tables(t, found), found)


# ---- alignment

_KW = _any(PART_WORDS)


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '{_KW}'))), ',') AS keywords FROM part")
def keyword_sets(spark, sf_dir):
    k = tx.keyword_set(F.concat_ws(" ", "p_name", "p_type"), PART_WORDS)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(k), ",").alias("keywords"))


_ALIGN = f"""s AS ({_PARTS}), kw AS (SELECT pair_id, role, seq, list_distinct(regexp_extract_all(lower(title || ' ' || substr(content, 1, 500)), '{_KW}')) AS k FROM s),
 kp AS (SELECT b.pair_id, b.seq AS base_seq, c.seq AS compare_seq, round(len(list_intersect(b.k, c.k)) / len(list_distinct(list_concat(b.k, c.k))) * 0.5, 4) AS keyword_score FROM kw b JOIN kw c ON b.pair_id = c.pair_id AND b.role = 'base' AND c.role = 'compare' WHERE len(list_intersect(b.k, c.k)) > 0),
 w AS (SELECT pair_id, role, seq, list_filter(regexp_extract_all(lower(number || ' ' || title), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({list(fixed.STOP_WORDS)!r}, x)) AS l FROM s),
 t AS (SELECT pair_id, role, seq, term, count(*) AS tf FROM (SELECT pair_id, role, seq, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM w) GROUP BY ALL),
 v AS (SELECT pair_id, term, df FROM (SELECT pair_id, term, count(*) AS df, row_number() OVER (PARTITION BY pair_id ORDER BY sum(tf) DESC, term) AS r FROM t GROUP BY 1, 2) WHERE r <= 5000),
 n AS (SELECT pair_id, count(*) AS docs FROM s GROUP BY 1),
 x AS (SELECT t.pair_id, role, seq, term, tf * (ln((1 + docs) / (1 + df)) + 1) AS w FROM t JOIN v USING (pair_id, term) JOIN n USING (pair_id)),
 y AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY pair_id, role, seq)) AS u FROM x),
 cs AS (SELECT b.pair_id, b.seq AS base_seq, c.seq AS compare_seq, sum(b.u * c.u) AS cosine FROM y b JOIN y c ON b.pair_id = c.pair_id AND b.term = c.term AND b.role = 'base' AND c.role = 'compare' GROUP BY ALL),
 cb AS (SELECT coalesce(cs.pair_id, kp.pair_id) AS pair_id, coalesce(cs.base_seq, kp.base_seq) AS base_seq, coalesce(cs.compare_seq, kp.compare_seq) AS compare_seq, round(coalesce(cosine, 0), 4) AS tfidf_sim, coalesce(keyword_score, 0) AS keyword_score, round(least(1.0, coalesce(cosine, 0) + coalesce(keyword_score, 0)), 4) AS similarity FROM cs FULL JOIN kp ON cs.pair_id = kp.pair_id AND cs.base_seq = kp.base_seq AND cs.compare_seq = kp.compare_seq),
 al AS (SELECT *, CASE WHEN keyword_score > 0 THEN 'tfidf_cosine+keywords' ELSE 'tfidf_cosine' END AS method FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, compare_seq ORDER BY similarity DESC, base_seq) AS r FROM cb) WHERE r = 1 AND similarity >= 0.25)"""


def _matched(spark, sf_dir):
    return durable(align.matches(part_sections(spark, sf_dir), PART_WORDS, 0.25))


@query(f"WITH {_ALIGN} SELECT pair_id, base_seq, compare_seq, keyword_score FROM kp")
def keyword_jaccard(spark, sf_dir):
    return align.keyword_pairs(part_sections(spark, sf_dir), PART_WORDS)


@query(f"WITH {_ALIGN} SELECT pair_id, role, seq, term, round(u, 6) AS w FROM y")
def tfidf(spark, sf_dir):
    s = part_sections(spark, sf_dir).select("pair_id", "role", "seq", F.concat_ws(" ", "number", "title").alias("text"))
    return align.tfidf(s, ["pair_id"], ["role", "seq"]).withColumn("w", F.round("w", 6))


@query(f"WITH {_ALIGN} SELECT pair_id, base_seq, compare_seq, tfidf_sim, keyword_score, similarity FROM cb")
def combined_similarity(spark, sf_dir):
    return align.combined(part_sections(spark, sf_dir), PART_WORDS)


@query(f"WITH {_ALIGN} SELECT pair_id, base_seq, compare_seq, tfidf_sim, keyword_score, similarity, method FROM al")
def align_pairs(spark, sf_dir):
    return _matched(spark, sf_dir)


@query(f"WITH {_ALIGN} SELECT pair_id, seq, title FROM s ANTI JOIN al ON s.pair_id = al.pair_id AND s.seq = al.base_seq WHERE role = 'base'")
def base_only(spark, sf_dir):
    return align.only(part_sections(spark, sf_dir), _matched(spark, sf_dir), "base").select("pair_id", "seq", "title")


@query(f"WITH {_ALIGN} SELECT pair_id, seq, title FROM s ANTI JOIN al ON s.pair_id = al.pair_id AND s.seq = al.compare_seq WHERE role = 'compare'")
def compare_only(spark, sf_dir):
    return align.only(part_sections(spark, sf_dir), _matched(spark, sf_dir), "compare").select("pair_id", "seq", "title")


@query(f"SELECT pair_id, seq, title FROM ({_PARTS}) WHERE role = 'compare'")
def compare_only_compat(spark, sf_dir):
    return align.align(part_sections(spark, sf_dir), compat=True)[2].select("pair_id", "seq", "title")


# ---- differences


_DIGEST = lambda column: f"md5(array_to_string({_CLEAN.replace('text', column)}, chr(10)))"
_REBUILT = f"SELECT conv_id, turn, {_DIGEST('text')} AS base_digest, {_DIGEST('following')} AS compare_digest FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations)"


def _rebuilt(spark, sf_dir, ops, glue: str):
    """Both texts of each pair, put together again from the operations between them."""
    side = lambda kind: F.md5(F.array_join(F.transform(F.filter("ops", lambda o: o["type"].isin("equal", kind)), lambda o: o["text"]), glue))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", ops("text", "next").alias("ops")).select("conv_id", "turn", side("delete").alias("base_digest"), side("insert").alias("compare_digest"))


@query(_REBUILT)
def diff_ops_line(spark, sf_dir):
    return _rebuilt(spark, sf_dir, textdiff.line_diff, "\n")


@query(_REBUILT)
def diff_ops_char(spark, sf_dir):
    return _rebuilt(spark, sf_dir, textdiff.char_diff, "")


def _items(spark, sf_dir):
    return textdiff.diff_items(part_sections(spark, sf_dir), _matched(spark, sf_dir), granularity="line")


_ITEM = f"""{_ALIGN}, items AS (
 SELECT al.pair_id, base_seq, compare_seq, 0 AS kind, similarity, b.title AS bt, c.title AS ct, b.content AS bc, c.content AS cc, b.page AS bp, c.page AS cp FROM al JOIN s b ON b.pair_id = al.pair_id AND b.seq = base_seq JOIN s c ON c.pair_id = al.pair_id AND c.seq = compare_seq
 UNION ALL SELECT pair_id, seq, NULL, 1, 0, title, '', content, '', page, NULL FROM s ANTI JOIN al ON s.pair_id = al.pair_id AND s.seq = al.base_seq WHERE role = 'base'
 UNION ALL SELECT pair_id, NULL, seq, 2, 0, '', title, '', content, NULL, page FROM s ANTI JOIN al ON s.pair_id = al.pair_id AND s.seq = al.compare_seq WHERE role = 'compare')"""


def _measured() -> str:
    """Line differences of two texts of three lines each, of which only those of one place can be equal: for every
    choice of the lines that differ, the characters that go and come, and what is shown."""
    same = "coalesce(bc = '' OR cc = '', true)"
    line = lambda side, k: f"string_split({side}, chr(10))[{k + 1}]"
    cases: dict[str, list[str]] = {"gone": [], "fresh": [], "shown": []}
    for choice in range(8):
        differs = [bool(choice >> k & 1) for k in range(3)]
        when = " AND ".join(f"{line('bc', k)} {'<>' if differs[k] else '='} {line('cc', k)}" for k in range(3))
        blocks: list[list[int]] = []
        for k in range(3):
            if k and differs[k] == differs[k - 1]:
                blocks[-1].append(k)
            else:
                blocks.append([k])
        joined = lambda side, block: " || chr(10) || ".join(line(side, k) for k in block)
        changed = [x for x in blocks if differs[x[0]]]
        for name, side in (("gone", "bc"), ("fresh", "cc")):
            cases[name].append(f"WHEN {when} THEN " + (" + ".join(f"length({joined(side, x)})" for x in changed) or "0"))
        cases["shown"].append(f"WHEN {when} THEN " + " || ".join(f"'~~' || {joined('bc', x)} || '~~**+' || {joined('cc', x)} || '**'" if differs[x[0]] else joined("bc", x) for x in blocks))
    columns = ", ".join(f"CASE WHEN {same} THEN NULL {' '.join(x)} END AS {n}" for n, x in cases.items())
    return f"SELECT *, {columns} FROM items"


_MEASURES = f"""{_ITEM}, me AS ({_measured()}), ms AS (SELECT *, kind > 0 OR gone + fresh >= 30 AS has_diff,
 CASE WHEN kind = 1 THEN '{textdiff.ONLY_BASE}' WHEN kind = 2 THEN '{textdiff.ONLY_COMPARE}' WHEN gone > 0 AND fresh > 0 THEN '变更：删除 ' || gone || ' 字符，新增 ' || fresh || ' 字符' WHEN gone > 0 THEN '删除：' || gone || ' 字符' WHEN fresh > 0 THEN '新增：' || fresh || ' 字符' ELSE '无显著变更' END AS diff_summary,
 CASE WHEN kind = 0 AND gone + fresh >= 30 THEN shown ELSE '' END AS diff_snippet FROM me)"""


@query(f"WITH {_MEASURES} SELECT pair_id, base_seq, compare_seq, has_diff, diff_summary, diff_snippet FROM ms WHERE kind = 0")
def diff_measures(spark, sf_dir):
    return _items(spark, sf_dir).filter("kind = 0").select("pair_id", "base_seq", "compare_seq", "has_diff", "diff_summary", "diff_snippet")


@query(f"WITH {_MEASURES} SELECT pair_id, base_seq, compare_seq, kind, similarity, bt AS base_section_title, ct AS compare_section_title, bc AS base_content, cc AS compare_content, bp AS base_page, cp AS compare_page, has_diff, diff_summary, diff_snippet FROM ms")
def diff_items(spark, sf_dir):
    return _items(spark, sf_dir).select("pair_id", "base_seq", "compare_seq", "kind", "similarity", "base_section_title", "compare_section_title", "base_content", "compare_content", "base_page", "compare_page", "has_diff", "diff_summary", "diff_snippet")


@query(f"WITH {_ITEM} SELECT pair_id, kind, similarity, base_seq, compare_seq FROM items ORDER BY pair_id, kind, similarity DESC, base_seq NULLS FIRST, compare_seq NULLS FIRST LIMIT 50")
def max_items(spark, sf_dir):
    return textdiff.head(_items(spark, sf_dir), 50).select("pair_id", "kind", "similarity", "base_seq", "compare_seq")


# ---- boilerplate

_T, _S, _X = _any(BOILER.titles), _any(BOILER.signals), _any(BOILER.extra)
_TOCS = " OR ".join(f"regexp_matches(text, '{p}')" for p in BOILER.toc)
_FIRST = "string_split(coalesce(text, ''), chr(10))[1]"
_TITLE_HIT = f"regexp_matches(lower({_FIRST}), '{_T}')"
_CONTENT_HIT = f"(regexp_matches(lower(coalesce(text, '')), '{_S}|{_X}') OR coalesce({_TOCS}, false))"


@query(f"SELECT doc_id, {_TITLE_HIT} AS title_hit, {_CONTENT_HIT} AS content_hit FROM documents")
def boilerplate_sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("title", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)))
    # The extra words apply to title and content; here the title is the content's first line.
    return d.select("doc_id", boilerplate.title_hit(F.col("title"), BOILER).alias("title_hit"), boilerplate.content_hit(F.col("title"), F.col("text"), BOILER).alias("content_hit"))


def _filterable(spark, sf_dir):
    return _items(spark, sf_dir).withColumns({f"{s}_content": F.coalesce(f"{s}_content", F.lit("")) for s in ("base", "compare")})


_CUT = boilerplate.Boilerplate(enabled=True, titles=("red ",), signals=("promo",), toc=(), skip_front_pages=2, skip_back_pages=1)


@query(f"WITH {_ITEM}, f AS (SELECT *, coalesce(TRY_CAST(bp AS INT), 0) AS x, coalesce(TRY_CAST(cp AS INT), 0) AS y, regexp_matches(lower(bt), 'red ') OR regexp_matches(lower(bc), 'promo') AS b, regexp_matches(lower(ct), 'red ') OR regexp_matches(lower(cc), 'promo') AS c FROM items), m AS (SELECT max(greatest(x, y)) AS last FROM f) SELECT pair_id, kind, base_seq, compare_seq FROM f, m WHERE NOT ((CASE WHEN bt <> '' AND ct <> '' THEN b OR c WHEN ct = '' THEN b ELSE c END) OR (x > 0 AND (x <= 2 OR x >= last)) OR (y > 0 AND (y <= 2 OR y >= last)))")
def filter_items(spark, sf_dir):
    return boilerplate.filter_items(_filterable(spark, sf_dir), _CUT).select("pair_id", "kind", "base_seq", "compare_seq")


@query(f"WITH {_ITEM}, f AS (SELECT regexp_matches(lower(bt), 'red ') OR regexp_matches(lower(ct), 'red ') AS t, regexp_matches(lower(bc), 'promo') OR regexp_matches(lower(cc), 'promo') AS c FROM items) SELECT count(*) AS total, count(*) FILTER (t) AS title_hits, count(*) FILTER (c) AS content_hits, count(*) FILTER (t OR c) AS either FROM f")
def boilerplate_counts(spark, sf_dir):
    return boilerplate.counts(_filterable(spark, sf_dir), _CUT)


# ---- clusters


def _cluster_items(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("pair_id"), F.concat_ws(" ", "p_name", F.lower("p_type"), F.col("p_size").cast("string")).alias("text"))


_EDGES = f"""i AS (SELECT p_partkey AS item_id, p_brand AS pair_id, p_name || ' ' || lower(p_type) || ' ' || p_size AS text FROM part),
 w AS (SELECT pair_id, item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({list(fixed.STOP_WORDS)!r}, x)) AS l FROM i),
 t AS (SELECT pair_id, item_id, term, count(*) AS tf FROM (SELECT pair_id, item_id, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM w) GROUP BY ALL),
 v AS (SELECT pair_id, term, count(*) AS df FROM t GROUP BY ALL), n AS (SELECT pair_id, count(*) AS docs FROM i GROUP BY 1),
 x AS (SELECT pair_id, item_id, term, tf * (ln((1 + docs) / (1 + df)) + 1) AS w FROM t JOIN v USING (pair_id, term) JOIN n USING (pair_id)),
 y AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS u FROM x),
 e AS (SELECT a.item_id AS a, b.item_id AS b, round(sum(a.u * b.u), 6) AS similarity FROM y a JOIN y b ON a.pair_id = b.pair_id AND a.term = b.term AND a.item_id < b.item_id GROUP BY 1, 2 HAVING round(sum(a.u * b.u), 6) >= 0.88)"""


@query(f"WITH {_EDGES} SELECT a, b, round(similarity, 4) AS similarity FROM e")
def cluster_edges(spark, sf_dir):
    return cluster.edges(_cluster_items(spark, sf_dir), corpus=("pair_id",)).withColumn("similarity", F.round("similarity", 4))


_CLUSTERS = f"""{_EDGES}, bo AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
 reach(s, d) AS (SELECT item_id, item_id FROM i UNION SELECT reach.s, bo.v FROM reach JOIN bo ON reach.d = bo.u),
 lab AS (SELECT s AS item_id, min(d) AS cluster_id FROM reach GROUP BY 1),
 cl AS (SELECT item_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY length(text) DESC, item_id) = 1 AS is_rep FROM lab JOIN i USING (item_id))"""


def _clusters(spark, sf_dir):
    items = _cluster_items(spark, sf_dir)
    return items, cluster.clusters(items, cluster.links(items, corpus=("pair_id",)))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT item_id, cluster_id, is_rep FROM cl")
def clusters(spark, sf_dir):
    return _clusters(spark, sf_dir)[1]


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT c.item_id, i.text, r.item_id AS analysed_by FROM cl c JOIN cl r ON r.cluster_id = c.cluster_id AND r.is_rep JOIN i ON i.item_id = c.item_id")
def expand(spark, sf_dir):
    items, mapped = _clusters(spark, sf_dir)
    done = mapped.filter("is_rep").select("item_id", F.col("item_id").alias("analysed_by"))
    return cluster.expand(items, mapped, done).select("item_id", "text", "analysed_by")


# ---- analysis

_ORDER = sorted(range(len(PATTERNS)), key=lambda i: (-PATTERNS[i][2], i))
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{_any(PATTERNS[i][1])}') THEN '{PATTERNS[i][0]}' END" for i in _ORDER) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string(({_FOUND})[1:3], '; ') AS hints, len({_FOUND}) AS n_found FROM documents")
def dynamic_hints(spark, sf_dir):
    return analyze.hints(table(spark, sf_dir, "documents"), ["doc_id"], patterns=PATTERNS)


@query("SELECT doc_id, md5(CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || chr(10) || '...(truncated)' ELSE text END) AS digest FROM documents")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.truncate(F.col("text"), 3000)).alias("digest"))


def _analysed(spark, sf_dir):
    items = textdiff.diff_items(part_sections(spark, sf_dir), _matched(spark, sf_dir), granularity="line")
    items = items.withColumn("has_diff", (F.col("kind") > 0) | (F.col("base_content") != F.col("compare_content")))
    return analyze.analyze(cluster.ranked(items))


@query(f"WITH {_ITEM} SELECT pair_id, kind, base_seq, compare_seq, ['pair', 'base_only', 'compare_only'][kind + 1] AS route, kind = 0 AND bc = cc AS skipped FROM items")
def route(spark, sf_dir):
    return _analysed(spark, sf_dir).select("pair_id", "kind", "base_seq", "compare_seq", analyze.route().alias("route"), analyze.skipped().alias("skipped"))


@query(f"WITH {_ITEM} SELECT pair_id, base_seq, compare_seq, ['unknow_diff', 'feature_removed', 'feature_added'][kind + 1] AS type, CASE WHEN kind < 2 THEN substr(bc, 1, 200) ELSE '' END AS base_quote, CASE WHEN kind <> 1 THEN substr(cc, 1, 200) ELSE '' END AS compare_quote FROM items WHERE kind > 0 OR bc <> cc")
def fallback_diffs(spark, sf_dir):
    return report.diffs(_analysed(spark, sf_dir), "pair_id", "base_seq", "compare_seq").select("pair_id", "base_seq", "compare_seq", "d.type", "d.base_quote", "d.compare_quote")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, '{\"diffs\":[],\"summary\":\"' || event_type || '\"}' AS recovered, event_type AS summary FROM events")
def json_recover(spark, sf_dir):
    obj = F.concat(F.lit('{"diffs":[],"summary":"'), "event_type", F.lit('"}'))
    forms = F.array(obj, F.concat(F.lit("So:\n```json\n"), obj, F.lit("\n```\nDone {")), F.concat(F.lit("  {broken "), obj), F.concat(obj, F.lit(" trailing")))
    e = table(spark, sf_dir, "events").select("event_id", F.get(forms, (F.col("event_id") % 4).cast("int")).alias("reply"))
    e = e.withColumn("recovered", analyze.json_of("reply"))
    return e.select("event_id", "recovered", analyze.parse_reply(F.col("recovered"), F.col("reply"))["summary"].alias("summary"))


@query("SELECT event_id, event_type || ' ' || user_id AS content FROM events")
def sse_decode(spark, sf_dir):
    delta = lambda c: F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), c, F.lit('"}}]}\n'))
    stream = F.concat(delta(F.col("event_type")), delta(F.lit(" ")), delta(F.col("user_id").cast("string")), F.lit("data: [DONE]\n"))
    whole = F.concat(F.lit('{"choices":[{"message":{"content":"'), "event_type", F.lit(" "), F.col("user_id").cast("string"), F.lit('"}}]}'))
    return table(spark, sf_dir, "events").select("event_id", analyze.envelope(F.when(F.col("event_id") % 2 == 0, stream).otherwise(whole)).alias("content"))


@query("WITH s AS (SELECT user_id AS run_id, event_id AS seq, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS block FROM events), r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, block ORDER BY seq) AS run FROM s) SELECT run_id, seq, ok, CAST(run AS BIGINT) AS run, coalesce(max(CASE WHEN run >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS tripped FROM r")
def breaker(spark, sf_dir):
    return analyze.breaker(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok")), limit=2)


# ---- statistics and report

_DIFFS = f"{_ITEM}, d AS (SELECT ['unknow_diff', 'feature_removed', 'feature_added'][kind + 1] AS type FROM items WHERE kind > 0 OR bc <> cc)"
_LABEL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.TYPE_LABELS.items()) + " ELSE type END"


@query(f"WITH {_DIFFS} SELECT type, {_LABEL} AS label, count(*) AS n FROM d GROUP BY 1, 2")
def stats_type(spark, sf_dir):
    return report.by_type(_analysed(spark, sf_dir))


@query(f"WITH {_DIFFS} SELECT impact, CAST(sum(n) AS BIGINT) AS n FROM (SELECT '中' AS impact, count(*) AS n FROM d UNION ALL VALUES ('高', 0), ('低', 0)) GROUP BY 1")
def stats_impact(spark, sf_dir):
    return report.by_impact(_analysed(spark, sf_dir))


@query(f"WITH {_ITEM} SELECT count(*) AS total_sections, count(*) FILTER (kind > 0 OR bc <> cc) AS sections_with_diff, count(*) FILTER (kind > 0 OR bc <> cc) AS total_diff_items FROM items")
def stats_totals(spark, sf_dir):
    return report.totals(_analysed(spark, sf_dir))


_RANKED = f"{_ITEM}, rk AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY kind, similarity DESC, base_seq NULLS FIRST, compare_seq NULLS FIRST) AS item_id FROM items)"


@query(f"WITH {_RANKED} SELECT pair_id, CAST(item_id AS INT) AS item_id, row_number() OVER (PARTITION BY pair_id ORDER BY item_id) AS number, CASE WHEN bt <> '' THEN bt ELSE ct END AS title, CAST(1 AS BIGINT) AS n_diffs FROM rk WHERE kind > 0 OR bc <> cc")
def report_toc(spark, sf_dir):
    return report.toc(_analysed(spark, sf_dir))


@query(f"WITH {_RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY item_id) AS n FROM rk WHERE kind > 0 OR bc <> cc) SELECT pair_id, CAST(item_id AS INT) AS item_id, format('D-{{:03d}}', n) AS seq, CASE WHEN base_seq IS NULL THEN '（Base 中不存在）' ELSE 'base，第 ' || bp || ' 节，P' || bp END AS base_loc, CASE WHEN compare_seq IS NULL THEN '（Compare 中不存在）' ELSE 'compare，第 ' || cp || ' 节，P' || cp END AS compare_loc, CASE WHEN kind < 2 THEN replace(bc, chr(10), ' ') ELSE '(无原文引用)' END AS base_quote, CASE WHEN kind <> 1 THEN replace(cc, chr(10), ' ') ELSE '(无原文引用)' END AS compare_quote FROM o")
def locations(spark, sf_dir):
    return report.details(_analysed(spark, sf_dir)).select("pair_id", "item_id", "seq", "base_loc", "compare_loc", "base_quote", "compare_quote")


_DIM = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{_any(g)}') THEN '{g[-1]}'" for g in fixed.DIMENSIONS) + f" ELSE '{fixed.NO_DIMENSION}' END"


@query(f"SELECT doc_id, {_DIM} AS dimension FROM documents")
def dimension(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.dimension(F.col("text")).alias("dimension"))


_SAID = "CASE kind " + " ".join(f"WHEN {k} THEN '{fixed.FALLBACK_DESCRIPTIONS[r].format(reason='offline')}'" for k, r in enumerate(("pair", "base_only", "compare_only"))) + " END"


@query(f"""WITH {_RANKED}, o AS (SELECT *, {_SAID} AS said FROM rk WHERE kind > 0 OR bc <> cc),
 whole AS (SELECT *, concat_ws(' ', bt, ct, substr(bc, 1, 300), substr(cc, 1, 300), said) AS text FROM o)
 SELECT pair_id, CAST(item_id AS INT) AS item_id, 0 AS pos, '### [' || item_id || '] ' || {_DIM} || ' | ' || ['unknow_diff', 'feature_removed', 'feature_added'][kind + 1] || ' | 影响:中 | '
 || concat_ws(' / ', CASE WHEN bt <> '' THEN 'Base ' || bp || ' P' || bp END, CASE WHEN ct <> '' THEN 'Compare ' || cp || ' P' || cp END)
 || chr(10) || '差异描述: ' || said || chr(10) || 'Base 原文: ' || CASE WHEN bc = '' THEN '(无)' ELSE bc END || chr(10) || 'Compare 原文: ' || CASE WHEN cc = '' THEN '(无)' ELSE cc END AS block FROM whole""")
def condense(spark, sf_dir):
    return report.condense(_analysed(spark, sf_dir))


@query(f"WITH {_DIFFS}, tot AS (SELECT count(*) AS total_sections FROM items) SELECT type, count(*) AS n, total_sections FROM d, tot GROUP BY type, total_sections")
def run_flagship(spark, sf_dir):
    """Align, compare, classify by rules, count: the offline comparison from end to end."""
    rows = _analysed(spark, sf_dir)
    t = report.diffs(rows, "pair_id").groupBy(tx.type_tag(F.col("d.type")).alias("type")).agg(F.count("*").alias("n"))
    return t.crossJoin(rows.agg(F.count("*").alias("total_sections")))  # one row

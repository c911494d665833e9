"""Registered queries over the driver's tables and over inline sources, with their SQL.

Texts of tables stand in for comments (``comment_view``); what needs real source
code runs on the inline samples, whose expected rows are literal in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import fixed
from scholia.functions import text as T
from scholia.operators import match
from scholia.operators import rules as R
from scholia.operators.lineage import materialise
from scholia.plans import report
from scholia.plans.gate import check, differences, gate
from scholia.plans.runs import fingerprints
from scholia.plans.samples import SOURCES
from scholia.sources import diffs
from scholia.sources.config import Config
from scholia.sources.extract import comments_of, functions_of, parsed

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.comment_view(table(spark, sf_dir, "documents"), "doc_id", "text")


def chats_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    return R.comment_view(chats, "id", "text")


# --- SQL building blocks -------------------------------------------------------------

#: A word character and its opposite, in the classes that RE2 knows.
_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_S = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LICENSED = f"regexp_matches(t, '(?i){fixed.LICENSE}')"
_N_WORDS = rf"len(regexp_extract_all(t, '[^\s\x0b\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'))"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = rf"CASE WHEN t = '' THEN [] WHEN regexp_matches(t, '(?:{_BREAK})$') THEN regexp_split_to_array(t, '{_BREAK}')[:-2] ELSE regexp_split_to_array(t, '{_BREAK}') END"
_DOCS = f"SELECT doc_id::VARCHAR AS path, source, coalesce(text, '') AS t FROM documents"
_CHATS = "SELECT conv_id || '/' || turn AS path, coalesce(text, '') AS t FROM conversations"
_PASSIVE = fixed.PASSIVE.removeprefix(r"\b").removesuffix(r"\b").replace(r"\s", _S).replace(r"\w+ed", f"[{_W}]+ed").replace("(is|", "(?:is|").replace(f"+([{_W}]", f"+(?:[{_W}]")
_SAYS_PASSIVE = f"(?i)(?:^|[^{_W}])({_PASSIVE})(?:[^{_W}]|$)"
_URLS = r"regexp_replace(t, 'https?://\S+', '', 'g')"


def _words(prose: str) -> str:
    """The list of unapproved phrases and words of a lower-case text, each once, with what to use."""
    phrases = ", ".join(f"CASE WHEN contains({prose}, '{k}') THEN '''{k}'' → {v}' END" for k, v in fixed.PHRASES.items())
    words = ", ".join(f"'{k}': '''{k}'' → {v}'" for k, v in fixed.WORDS.items())
    listed = f"list_concat([{phrases}], list_transform(regexp_extract_all({prose}, '[a-z]+'), lambda w: map_extract_value(MAP {{{words}}}, w)))"
    return f"list_filter({listed}, lambda x: x IS NOT NULL)"


def _first_seen(listed: str) -> str:
    return f"list_filter({listed}, lambda x, i: list_position({listed}, x) = i)"


_STE02 = f"SELECT path, source, regexp_extract({_URLS}, '{_SAYS_PASSIVE}', 1) AS said, len(l) AS n FROM (SELECT *, {_LINES} AS l FROM ({_DOCS})) WHERE NOT {_LICENSED} AND {_N_WORDS} >= 3 AND regexp_matches({_URLS}, '{_SAYS_PASSIVE}')"


# --- Wording rules over tables ----------------------------------------------------------


@query(f"SELECT path AS doc_id, 1 AS line, greatest(1, n)::INT AS end_line, 'passive voice (''' || said || ''')' AS message FROM ({_STE02})")
def passive_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.evaluate(docs_view(spark, sf_dir), only=("STE02",))
    return found.select(c("path").alias("doc_id"), "line", "end_line", "message")


_FIRED = f"""
WITH d AS (SELECT *, {_LINES} AS l, lower({_URLS}) AS p FROM ({_DOCS})), s AS (SELECT * FROM d WHERE NOT {_LICENSED})
SELECT 'STE02' AS rule, 0 AS severity, count(*) AS n FROM ({_STE02})
UNION ALL SELECT 'STE03', 0, count(*) FROM s WHERE {_N_WORDS} >= 3 AND len({_words("p")}) > 0
UNION ALL SELECT 'UC008', 0, count(*) FROM s WHERE len(l) >= 12
UNION ALL SELECT 'UC010', 1, count(*) FROM d WHERE len(l) <= 1 AND regexp_matches(trim(t), '(?i){fixed.LABEL}')
UNION ALL SELECT 'UC011', 0, count(*) FROM d WHERE regexp_matches(t, '(?i)(?:^|[^{_W}])(todo|fixme|hack|xxx)(?:[^{_W}]|$)')
UNION ALL SELECT 'UC012', 1, count(*) FROM s WHERE regexp_matches(t, '[^\\x00-\\x7f]')
"""
_SOME = ("STE02", "STE03", "UC008", "UC010", "UC011", "UC012")


@query(f"SELECT rule, severity, n FROM ({_FIRED}) WHERE n > 0")
def findings_by_rule_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.evaluate(docs_view(spark, sf_dir), Config(ascii_comments=True), _SOME)
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(sum(n) FILTER (severity = 2), 0)::BIGINT AS error, coalesce(sum(n) FILTER (severity = 1), 0)::BIGINT AS warn, coalesce(sum(n) FILTER (severity = 0), 0)::BIGINT AS info FROM ({_FIRED})")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.severity_counts(R.evaluate(docs_view(spark, sf_dir), Config(ascii_comments=True), _SOME))


@query(f"SELECT path, {_N_WORDS}::INT AS n_words, len({_LINES})::INT AS n_lines, greatest(1, len({_LINES}))::INT AS end_line FROM ({_DOCS.replace(', source', '')} UNION ALL {_CHATS})")
def word_and_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_view(spark, sf_dir).unionByName(chats_view(spark, sf_dir))
    return rows.select("path", T.word_count(c("content")).alias("n_words"), F.size(T.lines(c("content"))).alias("n_lines"), "end_line")


@query(f"SELECT path AS doc_id FROM ({_DOCS}) WHERE {_LICENSED}")
def license_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_view(spark, sf_dir)
    return rows.filter(R.license_header(c("content"), c("attachment"), c("start_line"))).select(c("path").alias("doc_id"))


@query(
    f"SELECT path, 'non-simple wording: ' || array_to_string({_first_seen('h')}, ', ') AS message FROM (SELECT path, {_words('p')} AS h FROM (SELECT *, lower({_URLS}) AS p FROM ({_CHATS}) WHERE NOT {_LICENSED} AND {_N_WORDS} >= 3)) WHERE len(h) > 0"
    f" UNION ALL SELECT path, 'non-simple wording: ' || array_to_string({_first_seen('h')}, ', ') FROM (SELECT path, {_words('p')} AS h FROM (SELECT *, lower({_URLS}) AS p FROM ({_DOCS}) WHERE NOT {_LICENSED} AND {_N_WORDS} >= 3)) WHERE len(h) > 0"
)
def unapproved_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_view(spark, sf_dir).unionByName(chats_view(spark, sf_dir))
    return R.evaluate(rows, only=("STE03",)).select("path", "message")


@query(f"SELECT path AS doc_id, 'comment contains non-ASCII characters: ' || array_to_string({_first_seen('h')}[:8], '') AS message FROM (SELECT path, regexp_extract_all(t, '[^\\x00-\\x7f]') AS h FROM ({_DOCS}) WHERE NOT {_LICENSED}) WHERE len(h) > 0")
def emoji_nonascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.evaluate(docs_view(spark, sf_dir), Config(ascii_comments=True), ("UC012",))
    return found.select(c("path").alias("doc_id"), "message")


def _sentence_sql(split: str) -> str:
    flat = rf"trim(regexp_replace({_URLS}, '{_S}+', ' ', 'g'))"
    return rf"list_filter(list_transform(regexp_split_to_array(regexp_replace({flat}, '([.!?;]) ', '\1' || chr(1), 'g'), '{split}'), lambda x: trim(x)), lambda x: x <> '')"


@query(rf"""
SELECT path AS doc_id, 'sentence has ' || n || ' words (STE limit: 20)' AS message FROM (
  SELECT path, list_max(list_transform({_sentence_sql(r"\x01| (?:—|–|--|->|=>|-) ")}, lambda x: len(string_split(x, ' ')))) AS n FROM ({_DOCS}) WHERE NOT {_LICENSED} AND {_N_WORDS} >= 3
) WHERE n > 20""")
def long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evaluate(docs_view(spark, sf_dir), only=("STE01",)).select(c("path").alias("doc_id"), "message")


@query(rf"""
SELECT path AS doc_id, 'paragraph has ' || n || ' sentences (STE limit: 6)' AS message FROM (
  SELECT path, len(list_filter(regexp_split_to_array(regexp_replace(trim(regexp_replace({_URLS}, '{_S}+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), '\x01'), lambda x: trim(x) <> '')) AS n
  FROM ({_DOCS}) WHERE NOT {_LICENSED} AND {_N_WORDS} >= 3
) WHERE n > 6""")
def long_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evaluate(docs_view(spark, sf_dir), only=("STE04",)).select(c("path").alias("doc_id"), "message")


@query(f"SELECT path, CASE WHEN length(h) > 72 THEN left(h, 71) || '…' ELSE h END AS excerpt FROM (SELECT path, coalesce(({_LINES})[1], '') AS h FROM ({_CHATS}))")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats_view(spark, sf_dir).select("path", T.first_line(c("content")).alias("excerpt"))


def _ascii_sql() -> str:
    out = "t"
    for a, b in fixed.ASCII_FORMS:
        out = f"replace({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({out}, '[^\\x00-\\x7f]', '?', 'g')"


@query(f"SELECT path AS doc_id, md5({_ascii_sql()}) AS digest FROM ({_DOCS})")
def ascii_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_view(spark, sf_dir).select(c("path").alias("doc_id"), F.md5(T.to_ascii(c("content"))).alias("digest"))


# --- Words of code and comments ------------------------------------------------------------


def _stem_sql(w: str) -> str:
    undouble = lambda x: f"CASE WHEN length({x}) >= 4 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) AND right({x}, 1) NOT IN ('l', 's', 'z') THEN left({x}, length({x}) - 1) ELSE {x} END"
    cut = lambda n: f"left({w}, length({w}) - {n})"
    cases = " ".join(
        f"WHEN ends_with({w}, '{s}') AND length({w}) >= {len(s) + 3} THEN {cut(len(s)) + (chr(124) * 2 + chr(39) + 'y' + chr(39)) if s in ('ies', 'ied') else undouble(cut(len(s))) if s in ('ing', 'ed') else cut(len(s))}"
        for s in fixed.SUFFIXES
    )
    return f"list_transform([CASE {cases} ELSE {w} END], lambda s: CASE WHEN ends_with(s, 'e') AND length(s) >= 4 THEN left(s, length(s) - 1) ELSE s END)[1]"


_STOPS = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)


@query(f"SELECT DISTINCT w AS word, {_stem_sql('w')} AS stem FROM (SELECT unnest(regexp_extract_all(lower(t), '[a-z]+')) AS w FROM ({_DOCS} UNION ALL SELECT p_partkey::VARCHAR, '', p_name || ' ' || p_type FROM part))")
def stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("text")))
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.stem(c("word")).alias("stem"))


@query(
    f"SELECT p_partkey, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: list_contains(k, x)))::DOUBLE / len(w) END AS overlap FROM ("
    f"SELECT p_partkey, list_transform(list_filter(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOPS})), lambda w: {_stem_sql('w')}) AS w,"
    f" list_transform(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z]+'), lambda w: {_stem_sql('w')}) AS k FROM part)"
)
def overlap_name_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ratio = T.overlap_ratio(F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", F.lower("p_type"), "p_name"))
    return part.select("p_partkey", ratio.alias("overlap"))


@query("SELECT * FROM (VALUES ('user_name', 'user name'), ('getUserName', 'get user name'), ('HTTPServer2Go', 'http server go'), ('x_1Y', 'x y'), ('__init__', 'init')) t(name, parts)")
def split_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("user_name",), ("getUserName",), ("HTTPServer2Go",), ("x_1Y",), ("__init__",)], "name string")
    return names.select("name", F.array_join(T.split_identifier(c("name")), " ").alias("parts"))


@query("SELECT * FROM (VALUES ('count++;', 'count increment'), ('a += b - 1', 'a add b increas minu subtract'), ('if (x == y)', 'call check compar equal if invok x y')) t(code, words)")
def words_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("count++;",), ("a += b - 1",), ("if (x == y)",)], "code string")
    return rows.select("code", F.array_join(F.sort_array(T.code_words(c("code"))), " ").alias("words"))


# --- Multisets, caps and growth over tables ---------------------------------------------------

_NORM = f"lower(trim(regexp_replace(t, '{_S}+', ' ', 'g')))"


@query(f"SELECT md5(norm) AS norm, count(*) AS n, min(path::BIGINT) AS first FROM (SELECT path, {_NORM} AS norm FROM ({_DOCS})) GROUP BY norm HAVING count(*) > 1")
def norm_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_view(spark, sf_dir).select(c("path").cast("long").alias("id"), T.normalised(c("content")).alias("norm"))
    return rows.groupBy("norm").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").withColumn("norm", F.md5("norm"))


@query(f"""
WITH d AS (SELECT path::BIGINT AS id, {_NORM} AS norm FROM ({_DOCS})),
  o AS (SELECT norm, count(*) AS n FROM d WHERE id % 2 = 0 GROUP BY norm),
  w AS (SELECT id, norm, row_number() OVER (PARTITION BY norm ORDER BY id) AS k FROM d WHERE id % 2 = 1)
SELECT id AS doc_id FROM w LEFT JOIN o USING (norm) WHERE k > coalesce(n, 0)""")
def multiset_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents as the new version, even ones as the old: all rows take part on one side."""
    rows = docs_view(spark, sf_dir).select(c("path").cast("long").alias("file_ord"), "comment_ord", T.normalised(c("content")).alias("norm"))
    new, old = rows.filter("file_ord % 2 = 1"), rows.filter("file_ord % 2 = 0")
    left, _ = match.consume(new, match.norms(old, ()), ())
    return left.select(c("file_ord").alias("doc_id"))


@query(f"""
WITH f AS (SELECT source AS path, path::BIGINT AS ord, greatest(1, n)::INT AS end_line, row_number() OVER (PARTITION BY source ORDER BY path::BIGINT) AS k, count(*) OVER (PARTITION BY source) AS n FROM ({_STE02}))
SELECT path, 1 AS line, CASE WHEN k = 8 AND x THEN 1 ELSE end_line END AS end_line, CASE WHEN k = 8 AND x THEN (n - 8) || ' more STE02 hint(s) in this file, not listed' END AS more
FROM f, (VALUES (true), (false)) v(x) WHERE k <= 8 AND (NOT x OR (k = 8 AND n > 8))""")
def hint_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a file, its documents are the comments."""
    docs = table(spark, sf_dir, "documents")
    found = R.evaluate(R.comment_view(docs, "doc_id", "text", path=c("source"), comment_ord=c("doc_id").cast("int")), only=("STE02",))
    more = F.when(c("message").endswith("not listed"), c("message"))
    return R.capped(materialise(found)).select("path", "line", "end_line", more.alias("more"))


@query(f"""
SELECT source AS path, sum(CASE WHEN id % 2 = 0 THEN n ELSE 0 END)::BIGINT AS old_lines, sum(CASE WHEN id % 2 = 1 THEN n ELSE 0 END)::BIGINT AS new_lines
FROM (SELECT source, path::BIGINT AS id, greatest(1, len({_LINES})) AS n FROM ({_DOCS}) WHERE NOT {_LICENSED}) GROUP BY source
HAVING sum(CASE WHEN id % 2 = 1 THEN n ELSE 0 END) - sum(CASE WHEN id % 2 = 0 THEN n ELSE 0 END) >= 6""")
def net_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose prose grows by six lines or more from the even to the odd documents."""
    docs = table(spark, sf_dir, "documents")
    rows = R.comment_view(docs, "doc_id", "text", path=c("source"), comment_ord=c("doc_id").cast("int"))
    prose = rows.filter(~R.license_header(c("content"), c("attachment"), c("start_line")))
    lines = lambda odd: F.sum(F.when(c("comment_ord") % 2 == odd, c("end_line") - c("start_line") + 1).otherwise(0)).cast("long")
    sums = prose.groupBy("path").agg(lines(0).alias("old_lines"), lines(1).alias("new_lines"))
    return sums.filter(c("new_lines") - c("old_lines") >= 6)


@query(r"SELECT page_id, len(h)::INT AS n_comments, trim(h[1]) AS first FROM (SELECT page_id, regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS h FROM pages) WHERE len(h) > 0")
def html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of web pages; an extension, no source language."""
    found = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit("(?s)<!--(.*?)-->"), F.lit(1)).alias("h"))
    return found.filter(F.size("h") > 0).select("page_id", F.size("h").alias("n_comments"), F.trim(F.get("h", F.lit(0))).alias("first"))


@query(r"SELECT suffix, count(*) AS n FROM (SELECT lower(regexp_extract(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '.(\.[^.]+)$', 1)) AS suffix FROM pages) WHERE suffix <> '' GROUP BY suffix HAVING count(*) >= 5 ORDER BY n DESC, suffix LIMIT 5")
def unsupported_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five commonest suffixes of five files or more; a top-k report."""
    name = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    rows = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1)).alias("suffix")).filter("suffix <> ''")
    return rows.groupBy("suffix").agg(F.count("*").alias("n")).filter("n >= 5").orderBy(c("n").desc(), "suffix").limit(5)


@query()
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and the other items that are similar to them."""
    items = table(spark, sf_dir, "benchmark").select(T.normalised(F.coalesce("text", F.lit(""))).alias("norm"), c("item_id").alias("pool_ord"))
    found = match.pairs(items, items.withColumn("n", F.lit(1).cast("long")), 0.85)
    return found.select(F.md5("norm").alias("norm"), c("pool_ord").alias("item_id"))


# --- Inline sources -----------------------------------------------------------------------------


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") t({names})"


def inline_files(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, p, p, bytearray(s.encode())) for k, (p, s) in enumerate(sources.items())], "file_ord int, path string, rel string, content binary")


@query(
    _values(
        [
            ("cache.c", 1, "line", "file_header", "", False), ("cache.c", 4, "block", "preceding", "", False), ("cache.c", 6, "line", "trailing", "get_key", False), ("cache.c", 7, "line", "preceding", "get_key", False),
            ("pool.cpp", 2, "doc", "floating", "", False), ("pool.cpp", 3, "line", "floating", "", False), ("pool.cpp", 4, "doc", "preceding", "", False), ("pool.cpp", 7, "doc", "preceding", "", False), ("pool.cpp", 8, "line", "trailing", "", True), ("pool.cpp", 10, "line", "trailing", "add", False),
            ("list.js", 1, "doc", "preceding", "", False), ("list.js", 3, "line", "trailing", "addItem", False), ("list.js", 4, "line", "trailing", "addItem", False), ("list.js", 6, "block", "preceding", "<anonymous>", True),
            ("shape.ts", 1, "line", "preceding", "", False), ("shape.ts", 4, "line", "preceding", "area", False), ("shape.ts", 7, "line", "trailing", "", False),
            ("view.tsx", 4, "block", "trailing", "View", False),
            ("lib.rs", 1, "doc", "file_header", "", False), ("lib.rs", 3, "doc", "preceding", "", False), ("lib.rs", 5, "line", "trailing", "read", False), ("lib.rs", 6, "block", "preceding", "read", False),
            ("main.go", 1, "doc", "file_header", "", False), ("main.go", 4, "doc", "preceding", "", False), ("main.go", 6, "line", "preceding", "Serve", False), ("main.go", 7, "line", "trailing", "Serve", False),
            ("rows.py", 1, "line", "file_header", "", True), ("rows.py", 2, "doc", "file_header", "", False), ("rows.py", 6, "doc", "preceding", "", False), ("rows.py", 7, "line", "preceding", "add_row", False), ("rows.py", 8, "line", "trailing", "add_row", True), ("rows.py", 13, "doc", "preceding", "", False), ("rows.py", 15, "line", "trailing", "", False),
            ("Order.java", 1, "doc", "preceding", "", False), ("Order.java", 3, "line", "preceding", "", True), ("Order.java", 5, "line", "trailing", "total", False), ("Order.java", 6, "block", "trailing", "total", False),
            ("Names.cs", 2, "doc", "preceding", "", False), ("Names.cs", 5, "line", "preceding", "First", False), ("Names.cs", 6, "line", "trailing", "First", False),
            ("Score.kt", 1, "line", "file_header", "", False), ("Score.kt", 4, "block", "preceding", "", False), ("Score.kt", 6, "line", "preceding", "best", False),
            ("Cart.swift", 1, "line", "preceding", "", True), ("Cart.swift", 3, "doc", "preceding", "", False), ("Cart.swift", 5, "line", "trailing", "getTotal", False),
        ],
        "path, line, kind, attachment, function_name, is_directive",
    )
)
def extract_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments_of(parsed(inline_files(spark, SOURCES)))
    return rows.select("path", c("start_line").alias("line"), "kind", "attachment", "function_name", "is_directive")


@query(
    _values(
        [
            ("cache.c", "get_key", 5, 10, 6), ("pool.cpp", "size", 8, 8, 1), ("pool.cpp", "add", 9, 11, 3), ("pool.cpp", "k", 10, 10, 1), ("list.js", "addItem", 2, 9, 8), ("list.js", "<anonymous>", 5, 8, 4),
            ("shape.ts", "area", 3, 6, 4), ("shape.ts", "<anonymous>", 7, 7, 1), ("view.tsx", "View", 1, 8, 8), ("lib.rs", "read", 4, 8, 5), ("main.go", "Serve", 5, 8, 4), ("rows.py", "add_row", 5, 9, 4),
            ("Order.java", "total", 4, 7, 4), ("Order.java", "<anonymous>", 5, 5, 1), ("Names.cs", "First", 4, 7, 4), ("Score.kt", "best", 5, 8, 4), ("Cart.swift", "getTotal", 4, 7, 4),
        ],
        "path, name, start_line, end_line, body_line_count",
    )
)
def extract_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions_of(parsed(inline_files(spark, SOURCES))).drop("fn_ord")


@query(
    _values(
        [("cache.c", 5, 5), ("pool.cpp", 9, 6), ("list.js", 7, 4), ("shape.ts", 6, 3), ("view.tsx", 8, 1), ("lib.rs", 4, 4), ("main.go", 4, 4), ("rows.py", 5, 7), ("Order.java", 6, 4), ("Names.cs", 6, 3), ("Score.kt", 4, 3), ("Cart.swift", 6, 3)],
        "path, code_line_count, comment_line_count",
    )
)
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(inline_files(spark, SOURCES)).select("path", "code_line_count", "comment_line_count")


@query(
    _values(
        [
            ("cache.c", "UC001", 4, 1), ("cache.c", "UC001", 6, 1), ("cache.c", "UC005", 7, 1), ("pool.cpp", "UC004", 2, 1), ("pool.cpp", "UC004", 4, 1), ("pool.cpp", "UC002", 10, 1), ("list.js", "UC007", 1, 1),
            ("shape.ts", "UC010", 1, 1), ("shape.ts", "UC011", 4, 0), ("view.tsx", "UC002", 4, 1), ("rows.py", "UC007", 6, 1), ("rows.py", "UC007", 13, 1), ("Order.java", "UC007", 1, 1), ("Score.kt", "UC010", 1, 1), ("Cart.swift", "UC007", 3, 1),
        ],
        "path, rule, line, severity",
    )
)
def check_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check(inline_files(spark, SOURCES)).select("path", "rule", "line", "severity")


@query(_values([(1, "UC003", 2), (2, "UC003", 1), (4, "UC002", 1), (6, "UC002", 1), (8, "UC003", 1), (9, "UC002", 1)], "id, rule, severity"))
def narration_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-around patterns: edit context, openers, what they spare, and process narration."""
    texts = [
        "Uses a map instead of the previous list.", "Changed the limit for large inputs.", "Removed from the queue on close.", "We check the input.", "We allocated a segment.", "let's iterate once more",
        "Let's Encrypt issues these.", "fixed: the sign was wrong", "Sorts rows.\nThen we write them.", "Now we wait because the disk is slow.",
    ]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts, 1)], "id int, text string")
    shown = R.comment_view(rows, "id", "text", start_line=F.lit(9), end_line=F.lit(9))
    return R.evaluate(shown, only=("UC002", "UC003")).select(c("path").cast("int").alias("id"), "rule", "severity")


@query(_values([("a", 0, 1, 2), ("a", 1, 0, 1), ("a", 3, 0, 3)], "path, comment_ord, fn_ord, n_lines"))
def innermost_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = spark.createDataFrame([("a", 0, 4, 5, True), ("a", 1, 8, 8, True), ("a", 2, 1, 1, True), ("a", 3, 9, 11, True), ("a", 4, 4, 4, False), ("b", 0, 4, 4, True)], "path string, comment_ord int, start_line int, end_line int, in_function boolean")
    functions = spark.createDataFrame([("a", 0, 1, 10), ("a", 1, 3, 6), ("a", 2, 3, 6), ("a", 3, 8, 8)], "path string, fn_ord int, start_line int, end_line int")
    return R.innermost(comments, functions)


_MARKED = """\
# scholia-ignore[UC003]: quoted
# Changed as requested
a = 1

# Changed as requested
b = 1  # scholia-ignore
# scholia-ignore

# imports
c = 1
# scholia-ignore-file[UC010]: house style
d = 1

# Changed as requested, see scholia-ignore
e = 1
"""


@query(_values([("UC003", 5)], "rule, line"))
def span_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check(inline_files(spark, {"a.py": _MARKED})).select("rule", "line")


_OLD = {
    "a.js": "// Keeps latency low on slow disks becuase of caching.\nconst a = 1;\n// Debounce keeps request volume manageable.\nconst b = 2;\n",
    "old.js": "// The retry budget is shared between endpoints on purpose.\nexport function retry() {}\n",
    "flood.js": "export function f() {\n  return 1;\n}\n",
    "grow.py": "# Rows are sorted by key.\nx = 1\n",
}
_NEW = {
    "a.js": "// Keeps latency low on slow disks because of caching.\nconst a = 1;\n// Changed the delay as requested\nconst c = 2;\n",
    "b.js": "// scholia-ignore-file[UC004]: house style\n// Debounce keeps request volume manageable.\nconst b = 2;\n",
    "flood.js": "".join(f"// then we run filler step number {k} of the plan\n" for k in range(14)) + "export function f() {\n  return 1;\n}\n",
    "grow.py": "# Rows are sorted by key.\nx = 1\n" + "".join(f"# Field {k} holds the value of column {k}.\ny{k} = {k}\n" for k in range(8)),
    "new.js": "// The retry budget is shared between endpoints on purpose.\nexport function retry() {}\n",
}


def _inline_gate(spark: SparkSession):
    files = inline_files(spark, _NEW)
    olds = spark.createDataFrame([(k, bytearray(_OLD[p].encode())) for k, p in enumerate(_NEW) if p in _OLD], "file_ord int, content binary")
    return gate(files, olds, lambda: inline_files(spark, {"old.js": _OLD["old.js"]}))


@query(_values([("a.js", "UC003", 3, 3, 2), ("b.js", "UC102", 1, 1, 0), ("flood.js", "UC002", 1, 14, 1), ("flood.js", "UC008", 1, 14, 0), ("flood.js", "STE01", 1, 14, 0), ("flood.js", "UC100", 1, 14, 2), ("grow.py", "UC101", 3, 17, 1)], "path, rule, line, end_line, severity"))
def gate_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typo, a move, a rename, a flood, growth and a new exception, each in its own file."""
    return _inline_gate(spark).findings.select("path", "rule", "line", "end_line", "severity")


@query(_values([(5, 10, 23, 10)], "files_scanned, new_comments, new_comment_lines, added_code_lines"))
def gate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inline_gate(spark).stats


_DIFF = """\
diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,3 @@
 a = 1
-# old note
+# new note
 b = 2
diff --git a/y.py b/y.py
new file mode 100644
--- /dev/null
+++ b/y.py
@@ -0,0 +1 @@
+c = 3
diff --git a/z.c b/w.c
rename from z.c
rename to w.c
--- a/z.c
+++ b/w.c
@@ -1,2 +1,3 @@
 int a; // one
+
-int b;
+int c; // two
"""
_NEW_TEXTS = {"x.py": "a = 1\n# new note\nb = 2\n", "y.py": "c = 3\n", "w.c": "int a; // one\n\nint c; // two\n"}


@query(_values([(0, "x.py", "x.py", 3, 3), (1, None, "y.py", 0, 1), (2, "z.c", "w.c", 2, 3)], "patch_ord, old_path, new_path, n_old, n_new"))
def diff_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diffs.parse_column(spark.createDataFrame([(_DIFF,)], "diff string"))
    n = lambda side: F.size(F.flatten(F.transform("hunks", lambda h: h[side])))
    return rows.select("patch_ord", "old_path", "new_path", n("old_lines").alias("n_old"), n("new_lines").alias("n_new"))


def _reversed(spark: SparkSession) -> DataFrame:
    rows = diffs.patches(spark, _DIFF)
    texts = spark.createDataFrame(list(_NEW_TEXTS.items()), "new_path string, new_text string")
    return diffs.reverse_column(rows.join(texts, "new_path")).join(texts, "new_path")


@query(_values([("x.py", "a = 1\\n# old note\\nb = 2\\n"), ("y.py", ""), ("w.c", "int a; // one\\nint b;\\n")], "path, old"))
def diff_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reversed(spark).select(c("new_path").alias("path"), F.replace("old_text", F.lit("\n"), F.lit("\\n")).alias("old"))


@query(_values([("y.py", "c = 3"), ("w.c", "int c;")], "path, near"))
def verify_comment_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _reversed(spark).select(c("new_path").alias("path"), c("old_text").alias("old"), c("new_text").alias("new"))
    return differences(fingerprints(pairs))


@query(_values([(r[0], r[1], r[2], k >= len(fixed.RULES)) for k, r in enumerate((*fixed.RULES, *fixed.GATE_SIGNALS))], "id, title, severity, gate_only"))
def rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rule_table(spark).drop("doc")


@query(f"SELECT 2 AS section, path, 'STE02' AS rule, 1::BIGINT AS n, false AS must FROM ({_STE02})")
def agent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the corrective report prints: findings by section, file, rule and action."""
    found = R.evaluate(docs_view(spark, sf_dir), only=("STE02",)).withColumn("ord_", c("path").cast("int"))
    return report.grouped(found).select("section", "path", "rule", "n", "must")


@query(_values([("STE02", "passive-voice", "note")], "rule, title, level"))
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.described(R.evaluate(docs_view(spark, sf_dir), only=("STE02",))).select("rule", "title", "level")


@query(_values([(1, True), (2, False), (3, True), (4, False)], "id, fires"))
def approved_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wording rules do not see approved terms: proper names as written, vocabulary in any case."""
    rows = spark.createDataFrame([(1, "let's encrypt the payload at rest"), (2, "Leverage of the position is fixed here"), (3, "we leverage and utilize it"), (4, "Then Server answers all calls")], "id int, text string")
    cfg = Config(approved_terms=["Let's Encrypt", "leverage", "Then Server"])
    shown = R.comment_view(rows, "id", "text", start_line=F.lit(5), end_line=F.lit(5))
    fired = R.evaluate(shown, cfg, ("UC002", "STE03")).select("path").distinct().withColumn("fires", F.lit(True))
    return rows.join(fired, c("id").cast("string") == c("path"), "left").select("id", F.coalesce("fires", F.lit(False)).alias("fires"))

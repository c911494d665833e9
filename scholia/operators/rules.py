"""The rules: each is a function from settings to one nullable struct column.

``evaluate`` reads comments once: shared parts (lines, masked text, prose,
overlap) become columns, every enabled rule adds a struct to one array, and the
array is exploded. There is no shuffle. The density rule joins function spans
with the comments inside them, by path and interval.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import fixed
from scholia.functions import text as T
from scholia.operators.lineage import materialise
from scholia.sources.config import SEVERITIES, Config

COMMENTS = (
    "path string, comment_ord int, lang string, kind string, attachment string, text string, content string, start_line int, end_line int, col int, "
    "attached_code string, in_function boolean, function_name string, is_directive boolean"
)
FUNCTIONS = "path string, fn_ord int, name string, start_line int, end_line int, body_line_count int"
FINDINGS = ("rule", "severity", "path", "line", "end_line", "message", "action", "excerpt")

INFO, WARN, ERROR = range(3)
TITLES = {r[0]: r for r in (*fixed.RULES, *fixed.GATE_SIGNALS)}
DEFAULT = {r[0]: SEVERITIES.index(r[2]) for r in (*fixed.RULES, *fixed.GATE_SIGNALS)}

c = F.col


def comment_view(table: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """A table of texts as comments: each row is one floating comment of its own file."""
    content = F.coalesce(c(text_col), F.lit(""))
    columns = {
        "path": c(id_col).cast("string"), "comment_ord": F.lit(0), "lang": F.lit("text"), "kind": F.lit("line"), "attachment": F.lit("floating"),
        "text": content, "content": content, "start_line": F.lit(1), "end_line": F.greatest(F.lit(1), F.size(T.lines(content))), "col": F.lit(0),
        "attached_code": F.lit(""), "in_function": F.lit(False), "function_name": F.lit(""), "is_directive": F.lit(False),
    }
    return table.select(*((columns | more)[k].alias(k) for k in columns))


def license_header(content: Column, attachment: Column, start_line: Column) -> Column:
    return ((attachment == "file_header") | (start_line == 1)) & T.has(content, fixed.LICENSE, True)


def prepared(comments: DataFrame, cfg: Config) -> DataFrame:
    """Comments with the parts that several rules share, in layers, so that each is computed once."""
    one = comments.withColumns(
        {
            "lines": T.lines(c("content")),
            "n_lines": c("end_line") - c("start_line") + 1,
            "n_words": T.word_count(c("content")),
            "excerpt": T.first_line(c("content")),
            "licensed": license_header(c("content"), c("attachment"), c("start_line")),
            "masked": T.without_terms(c("content"), cfg.approved_terms),
            "doc": c("kind") == "doc",
        }
    )
    judged = ~c("licensed") & (c("n_words") >= 3)
    two = one.withColumns(
        {
            "overlap": F.when(c("attached_code") != "", T.overlap_ratio(c("content"), c("attached_code"))).otherwise(0.0),
            "prose": F.when(judged, T.prose(c("lines"))).otherwise(""),
            "masked_lines": T.lines(c("masked")),
        }
    )
    return two.withColumn("masked_prose", T.without_terms(c("prose"), cfg.approved_terms))


# --- Rules over one comment ------------------------------------------------------

Rule = Callable[[Config], Column]
RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    def keep(f: Rule) -> Rule:
        RULES[name] = f
        return f

    return keep


def finding(name: str, message: Column | str | None = None, case: str = "", severity: int | None = None, excerpt: Column | None = None) -> Column:
    key = f"{name} {case}".strip()
    text = fixed.MESSAGES[key] if message is None else message
    return F.struct(
        F.lit(name).alias("rule"),
        F.lit(DEFAULT[name] if severity is None else severity).alias("severity"),
        c("start_line").alias("line"),
        c("end_line").alias("end_line"),
        (F.lit(text) if isinstance(text, str) else text).alias("message"),
        F.lit(fixed.ACTIONS[key]).alias("action"),
        (c("excerpt") if excerpt is None else excerpt).alias("excerpt"),
    )


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@rule("UC001")
def restates_code(cfg: Config) -> Column:
    fits = ~c("doc") & c("attachment").isin("preceding", "trailing") & (c("n_lines") <= 4) & (c("n_words") >= 2) & (c("attached_code") != "")
    free = ~T.has(c("content"), fixed.WHY, True) & ~T.has(c("content"), fixed.TODO, True)
    message = _say("comment repeats the adjacent code (", T.percent(c("overlap")), " of its words appear in the code)")
    return F.when(fits & (c("overlap") >= cfg.restate_overlap) & free, finding("UC001", message))


@rule("UC002")
def narration(cfg: Config) -> Column:
    step = lambda line: c("in_function") & T.has(line, fixed.NUMBERED_STEP)
    head = F.coalesce(F.get("masked_lines", F.lit(0)), F.lit(""))
    rest = F.slice("masked_lines", F.lit(2), F.greatest(F.size("masked_lines") - 1, F.lit(0)))
    told = T.has(head, fixed.NARRATION_START, True) | step(head) | F.exists(rest, lambda x: T.has(x, fixed.NARRATION_LATER, True) | step(x))
    return F.when(~c("doc") & ~c("licensed") & told & ~T.has(c("masked"), fixed.WHY, True), finding("UC002"))


@rule("UC003")
def change_narration(cfg: Config) -> Column:
    head = F.coalesce(F.get("masked_lines", F.lit(0)), F.lit(""))
    context = ~c("licensed") & T.has(c("masked"), fixed.CHANGE_CONTEXT, True)
    opener = ~c("licensed") & ~c("doc") & T.has(head, fixed.CHANGE_START, True)
    return F.when(context, finding("UC003", case="context")).when(opener, finding("UC003", case="opener", severity=WARN))


@rule("UC004")
def banner(cfg: Config) -> Column:
    return F.when(~c("licensed") & F.exists("lines", T.banner_line) & ~T.diagram(c("lines")), finding("UC004"))


@rule("UC005")
def commented_out_code(cfg: Config) -> Column:
    def of(rows: Column) -> Column:
        n = F.size(rows)
        # A line after one that stops mid-sentence is wrapped prose, whatever it looks like.
        ends = "|".join(f"\\{x}" for x in fixed.LINE_ENDINGS)
        wrapped = lambda i: (i > 0) & ~T.has(F.coalesce(F.get(rows, i - 1), F.lit("")), rf"(?:{ends}){T.SPACE}*$")
        codeish = F.size(F.filter(rows, lambda x, i: T.looks_like_code(x) & ~wrapped(i)))

        def judged(k: Column) -> Column:
            several = (n >= 2) & (k >= 2) & (k / n >= cfg.code_line_fraction)
            only = F.get(rows, F.lit(0))
            restates = (c("attached_code") != "") & (c("overlap") >= cfg.restate_overlap)
            single = (n == 1) & ~restates & T.surely_code(only) & ~T.has(only, fixed.TODO, True)
            return F.when(several | single, finding("UC005", _say("commented-out code (", k, " of ", n, " lines look like code)")))

        return T.bound(codeish, judged)

    return F.when(~c("doc"), T.bound(T.filled(c("lines")), of))


@rule("UC007")
def redundant_doc(cfg: Config) -> Column:
    fits = c("doc") & (c("attachment") == "preceding") & (c("attached_code") != "") & (c("n_lines") <= 3) & (c("n_words") >= 2)
    free = ~T.has(c("content"), fixed.DOC_TAG, True) & ~T.has(c("attached_code"), rf"^{T.SPACE}*case ")
    message = _say("doc comment restates the symbol name (", T.percent(c("overlap")), " word overlap)")
    return F.when(fits & free & (c("overlap") >= cfg.redundant_doc_overlap), finding("UC007", message))


@rule("UC008")
def doc_migration(cfg: Config) -> Column:
    n, most = c("n_lines"), cfg.doc_migration_lines
    interface = F.lower("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in fixed.INTERFACE_SUFFIXES) + ")$")
    header = c("attachment") == "file_header"
    guide = ~interface & ((n >= 2 * most) | (~T.has(c("content"), fixed.DOC_TAG, True) & T.has(c("content"), fixed.SECTION, True, True)))
    nothing = F.lit(None)
    return (
        F.when(c("licensed"), nothing)
        .when(c("in_function") & (n >= 6), finding("UC008", _say(n, "-line essay inside function '", c("function_name"), "'"), "essay"))
        .when(n < most, nothing)
        .when(header & c("doc"), nothing)
        .when(header, finding("UC008", _say(n, "-line file header essay"), "header"))
        .when(c("doc") & guide, finding("UC008", _say(n, "-line doc comment with guide-level sections"), "doc"))
        .when(c("doc"), nothing)
        .otherwise(finding("UC008", _say(n, "-line comment block"), "block"))
    )


@rule("UC009")
def trailing_length(cfg: Config) -> Column:
    shown = F.regexp_replace(c("text"), T.pattern(fixed.URL), "")
    chars = F.length(T.strip(F.regexp_replace(shown, f"{T.FLAGS}{T.SPACE}+", " ")))

    def of(n: Column) -> Column:
        over = F.concat_ws(
            ", ",
            F.when(n > cfg.max_trailing_chars, _say(n, f" chars (limit {cfg.max_trailing_chars})")),
            F.when(c("n_words") > cfg.max_trailing_words, _say(c("n_words"), f" words (limit {cfg.max_trailing_words})")),
        )
        return F.when((n > cfg.max_trailing_chars) | (c("n_words") > cfg.max_trailing_words), finding("UC009", _say("trailing comment is too long: ", over)))

    return F.when(c("attachment") == "trailing", T.bound(chars, of))


@rule("UC010")
def boilerplate_label(cfg: Config) -> Column:
    return F.when(~c("doc") & (c("n_lines") <= 1) & T.has(T.strip(c("content")), fixed.LABEL, True), finding("UC010"))


@rule("UC011")
def unowned_todo(cfg: Config) -> Column:
    word = F.upper(F.regexp_extract(c("content"), T.pattern(fixed.TODO, True), 0))
    open_end = T.has(c("content"), fixed.TODO, True) & ~T.has(c("content"), fixed.TODO_OWNER)
    return F.when(open_end, finding("UC011", _say(word, " has no owner or ticket")))


@rule("UC012")
def emoji(cfg: Config) -> Column:
    sought = fixed.NON_ASCII if cfg.ascii_comments else fixed.EMOJI
    what = "non-ASCII characters" if cfg.ascii_comments else "emoji/decorative symbols"

    def of(found: Column) -> Column:
        seen = F.substring(F.array_join(F.filter(found, lambda x: ~T.has(x, r"[\p{C}\p{Z}&&[^ ]]")), ""), 1, 8)
        point = lambda x: bare if (bare := F.hex(F.ascii(x))) is None else F.when(F.length(bare) < 4, F.lpad(bare, 4, "0")).otherwise(bare)
        codes = F.substring(F.array_join(F.transform(found, lambda x: F.concat(F.lit("U+"), point(x))), " "), 1, 40)
        return finding("UC012", _say(f"comment contains {what}: ", F.when(seen != "", seen).otherwise(codes)))

    found = F.array_distinct(F.regexp_extract_all(c("content"), F.lit(T.pattern(sought)), F.lit(0)))
    return F.when(~c("licensed") & T.has(c("content"), sought), T.bound(found, of))


def _judged() -> Column:
    """Wording rules look at prose of three words or more."""
    return ~c("licensed") & (c("n_words") >= 3)


@rule("STE01")
def long_sentence(cfg: Config) -> Column:
    def of(all_: Column) -> Column:
        sizes = F.transform(all_, T.word_count)
        longest = F.array_max(sizes)
        worst = F.get(all_, F.array_position(sizes, longest).cast("int") - 1)
        message = _say("sentence has ", longest, f" words (STE limit: {cfg.ste_max_sentence_words})")
        return F.when(longest > cfg.ste_max_sentence_words, finding("STE01", message, excerpt=T.first_line(worst)))

    # A text within the limit as a whole has no sentence above it.
    return F.when(_judged() & (c("n_words") > cfg.ste_max_sentence_words), T.bound(T.sentences(c("prose")), of))


@rule("STE02")
def passive_voice(cfg: Config) -> Column:
    said = F.regexp_extract(c("masked_prose"), T.pattern(fixed.PASSIVE, True), 0)
    return F.when(_judged() & T.has(c("masked_prose"), fixed.PASSIVE, True), finding("STE02", _say("passive voice ('", said, "')")))


@rule("STE03")
def unapproved_word(cfg: Config) -> Column:
    use = lambda k, v: f"'{k}' → {v}"
    words = F.create_map(*(F.lit(x) for k, v in fixed.WORDS.items() for x in (k, use(k, v))))

    def of(prose: Column) -> Column:
        phrases = F.array_compact(F.array(*(F.when(F.contains(prose, F.lit(k)), F.lit(use(k, v))) for k, v in fixed.PHRASES.items())))
        single = F.transform(F.filter(F.regexp_extract_all(prose, F.lit(T.pattern("[a-z]+", True)), F.lit(0)), lambda w: w.isin(list(fixed.WORDS))), lambda w: F.element_at(words, w))
        found = F.array_distinct(F.concat(phrases, single))
        return F.when(F.size(found) > 0, finding("STE03", _say("non-simple wording: ", F.array_join(found, ", "))))

    return F.when(_judged(), T.bound(F.lower("masked_prose"), of))


@rule("STE04")
def long_paragraph(cfg: Config) -> Column:
    def of(sizes: Column) -> Column:
        n = F.get(F.filter(sizes, lambda k: k > cfg.ste_max_paragraph_sentences), F.lit(0))
        return F.when(n.isNotNull(), finding("STE04", _say("paragraph has ", n, f" sentences (STE limit: {cfg.ste_max_paragraph_sentences})")))

    return F.when(_judged(), T.bound(F.transform(T.paragraphs(c("prose")), lambda p: F.size(T.flowing_sentences(p))), of))


# --- Evaluation --------------------------------------------------------------------


def evaluate(comments: DataFrame, cfg: Config | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """Findings (path, ord, rule, severity, line, end_line, message, action, excerpt) of the rules over single comments."""
    cfg = cfg or Config()
    names = [n for n in RULES if cfg.enabled(n) and (only is None or n in only)]
    if not names:
        names = []
    found = F.array_compact(F.array(*(RULES[n](cfg) for n in names))) if names else None
    ready = prepared(comments, cfg)
    if found is None:
        return ready.limit(0).select("path", F.col("comment_ord").alias("ord"), *(finding("UC010")[k].alias(k) for k in ("rule", "severity", "line", "end_line", "message", "action", "excerpt")))
    return ready.select("path", c("comment_ord").alias("ord"), F.inline(found))


def innermost(comments: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, comment_ord, fn_ord, n_lines) of each comment inside a function: the smallest span that holds its start, the first one on ties."""
    left = comments.filter("in_function").select("path", "comment_ord", c("start_line").alias("at"), (c("end_line") - c("start_line") + 1).alias("n_lines"))
    right = functions.select("path", "fn_ord", "start_line", "end_line")
    inside = left.join(right, "path").filter((c("start_line") < c("at")) & (c("at") <= c("end_line")))
    best = F.min_by(F.struct("fn_ord", "n_lines"), F.struct(c("end_line") - c("start_line"), "fn_ord")).alias("b")
    return inside.groupBy("path", "comment_ord").agg(best).select("path", "comment_ord", "b.fn_ord", "b.n_lines")


def density(comments: DataFrame, functions: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Functions whose body is saturated with comments, as findings that span the function."""
    cfg = cfg or Config()
    lines = innermost(comments, functions).groupBy("path", "fn_ord").agg(F.sum("n_lines").alias("k"))
    rows = functions.join(lines, ["path", "fn_ord"])
    ratio = c("k") / c("body_line_count")
    over = (c("k") >= cfg.min_interior_comment_lines) & (c("body_line_count") > 0) & (ratio > cfg.max_function_comment_ratio)
    message = _say("function '", c("name"), "' has ", c("k"), " comment lines in a ", c("body_line_count"), "-line body (", T.percent(ratio), ")")
    return rows.filter(over).select(
        "path", c("fn_ord").alias("ord"), F.lit("UC006").alias("rule"), F.lit(WARN).alias("severity"), c("start_line").alias("line"), "end_line",
        message.alias("message"), F.lit(fixed.ACTIONS["UC006"]).alias("action"), F.lit("").alias("excerpt"),
    )


# --- Which comments are judged, and which findings stay -------------------------------


def is_marker(content: Column, cfg: Config) -> Column:
    return T.strip(content).startswith(cfg.mark)


def visible(comments: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Comments that rules judge: no directives, no markers on their own."""
    cfg = cfg or Config()
    out = comments.filter(~c("is_directive") & ~is_marker(c("content"), cfg))
    for p in cfg.directive_patterns:
        out = out.filter(~T.has(c("content"), p))
    return out


RULE_LIST = r"\[([A-Za-z0-9 ,]+)\]"


def _listed(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def _quoted(cfg: Config) -> str:
    return "".join(x if x.isalnum() else f"\\{x}" for x in cfg.mark)


def grants(comments: DataFrame, cfg: Config | None = None) -> DataFrame:
    """(path, granted): rules that file-wide markers switch off, for files with any."""
    cfg = cfg or Config()
    lists = F.regexp_extract_all("content", F.lit(f"{_quoted(cfg)}-file{RULE_LIST}"), F.lit(1))
    rows = comments.select("path", F.explode(F.flatten(F.transform(lists, _listed))).alias("rule"))
    return rows.groupBy("path").agg(F.sort_array(F.collect_set("rule")).alias("granted"))


def _span_marker(cfg: Config) -> str:
    return f"{_quoted(cfg)}(?!-file)(?:{RULE_LIST})?"


def spans(comments: DataFrame, cfg: Config | None = None) -> DataFrame:
    """(path, rules, start, end) of span markers; null rules stand for all.

    A marker on its own also covers the comment or the line right below it.
    """
    cfg = cfg or Config()
    order = Window.partitionBy("path").orderBy("comment_ord")
    after = F.lead("start_line").over(order) == c("end_line") + 1
    reach = F.when(after, F.lead("end_line").over(order)).otherwise(c("end_line") + 1)
    listed = F.regexp_extract(c("content"), _span_marker(cfg), 1)
    rows = comments.select("path", "content", c("start_line").alias("start"), F.when(is_marker(c("content"), cfg), reach).otherwise(c("end_line")).alias("end"), listed.alias("l"))
    return rows.filter(c("content").rlike(_span_marker(cfg))).select("path", F.when(c("l") != "", _listed(c("l"))).alias("rules"), "start", "end")


def unsuppressed(findings: DataFrame, comments: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Findings that no marker covers. A bare marker must hold the finding, a listed one only meet it."""
    cfg = cfg or Config()
    marked = comments.filter(F.contains("content", F.lit(cfg.mark)))
    # Window order needs all comments of a file with a marker, and of those files only.
    near = comments.join(marked.select("path").distinct(), "path", "left_semi")
    covers = spans(near, cfg).groupBy("path").agg(F.collect_list(F.struct("rules", "start", "end")).alias("covers"))
    held = F.exists(
        F.coalesce("covers", F.array().cast("array<struct<rules:array<string>,start:int,end:int>>")),
        lambda s: F.when(s["rules"].isNull(), (s["start"] <= c("line")) & (c("end_line") <= s["end"])).otherwise(
            F.array_contains(s["rules"], c("rule")) & (c("end_line") >= s["start"]) & (c("line") <= s["end"])
        ),
    )
    wide = F.array_contains(F.coalesce("granted", F.array().cast("array<string>")), c("rule"))
    both = covers.join(grants(marked, cfg), "path", "full_outer")
    return findings.join(both, "path", "left").filter(~held & ~wide).drop("covers", "granted")


def overridden(findings: DataFrame, cfg: Config) -> DataFrame:
    if not cfg.severity:
        return findings
    levels = F.create_map(*(F.lit(x) for k, v in cfg.severity.items() for x in (k, SEVERITIES.index(v.lower()))))
    return findings.withColumn("severity", F.coalesce(F.element_at(levels, c("rule")), c("severity")))


def capped(findings: DataFrame, cfg: Config | None = None) -> DataFrame:
    """At most ``max_hints_per_rule`` hints for each file and rule, and a row that counts the others.

    ``findings`` is read three times. The first hints of a group are found by a
    plain ``row_number <= k``, which Spark limits in each task before the shuffle,
    and the count combines before its shuffle: a hot group is never gathered.
    """
    cfg = cfg or Config()
    k = cfg.max_hints_per_rule
    fields = ("path", "ord", "rule", "severity", "line", "end_line", "message", "action", "excerpt")
    findings = findings.select(*fields)
    hints, others = findings.filter(c("severity") == INFO), findings.filter(c("severity") > INFO)
    nth = F.row_number().over(Window.partitionBy("path", "rule").orderBy("ord"))
    first = hints.withColumn("nth", nth).filter(c("nth") <= k)
    many = hints.groupBy("path", "rule").agg(F.count("*").alias("all")).filter(c("all") > k)
    last = first.filter(c("nth") == k).join(many, ["path", "rule"])
    more = last.select(
        "path", F.lit(2**31 - 1).alias("ord"), "rule", "severity", "line", c("line").alias("end_line"),
        _say(c("all") - k, " more ", c("rule"), " hint(s) in this file, not listed").alias("message"), F.lit(fixed.ACTIONS["overflow"]).alias("action"), F.lit("").alias("excerpt"),
    )
    return others.unionByName(first.drop("nth")).unionByName(more)


def run_rules(comments: DataFrame, functions: DataFrame, cfg: Config | None = None) -> DataFrame:
    """All findings of files: judged, without what markers suppress, with severities overridden and hints capped."""
    cfg = cfg or Config()
    shown = visible(comments, cfg)
    found = evaluate(shown, cfg)
    if cfg.enabled("UC006"):
        found = found.unionByName(density(shown, functions, cfg))
    return capped(materialise(overridden(unsuppressed(found, comments, cfg), cfg)), cfg)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", "rule", "ord")


def severity_name(level: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in SEVERITIES)), level)

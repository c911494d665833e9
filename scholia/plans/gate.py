"""Checking trees, and gating edits: only what is new against a baseline is judged.

A baseline is given as DataFrames: ``olds`` (file_ord, content), null content for
files that are new, and ``sweep``, a function that gives the other files of the
old tree; it is called only if some file has no counterpart and something is left
to match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import fixed
from scholia.functions import text as T
from scholia.operators import match
from scholia.operators import rules as R
from scholia.operators.lineage import materialise
from scholia.sources.config import Config
from scholia.sources.extract import comments_of, functions_of, parsed

c = F.col


def check(files: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Findings of whole files, in order of files, lines and rules. Files are parsed once."""
    cfg = cfg or Config()
    table = materialise(parsed(files, cfg.mark))
    found = R.run_rules(comments_of(table), functions_of(table), cfg)
    return found.join(table.select("path", "file_ord"), "path").orderBy("file_ord", "line", "rule", "ord")


@dataclass
class Gate:
    findings: DataFrame
    stats: DataFrame


def _prose_lines(comments: DataFrame, cfg: Config) -> DataFrame:
    """(path, prose): lines of comments that are neither docs nor license texts, markers left out."""
    mark = F.size(F.filter(T.lines(c("content")), lambda x: T.strip(x).startswith(cfg.mark)))
    rows = comments.filter(_is_prose())
    return rows.groupBy("path").agg(F.sum(c("end_line") - c("start_line") + 1 - mark).alias("prose"))


def _is_prose() -> Column:
    return (c("kind") != "doc") & ~R.license_header(c("content"), c("attachment"), c("start_line"))


def _placed(table: DataFrame, cfg: Config) -> DataFrame:
    """Visible comments with their place in the run and their norm."""
    shown = R.visible(comments_of(table), cfg)
    return shown.join(table.select("path", "file_ord"), "path").withColumn("norm", T.normalised(c("content")))


def unmatched(new: DataFrame, old: DataFrame, bare: bool, sweep: Callable[[], DataFrame] | None, cfg: Config) -> DataFrame:
    """New comments that stages 1 to 4 leave: same file, other files, the rest of the old tree, similar ones.

    ``bare``: some file has no counterpart.
    """
    left, rest = match.consume(new, match.norms(old, ("path",)), ("path",))
    left, rest = materialise(left), materialise(rest)
    if left.isEmpty():
        return left
    # Leftovers of every file in scan order; then, if need be, what the sweep adds after all of them.
    order = lambda stage: F.struct(F.lit(stage).alias("stage"), c("first.file_ord").alias("file_ord"), c("first.comment_ord").alias("comment_ord"))
    pools = [rest.select("norm", "n", order(0).alias("pool_ord"))]
    if bare and sweep is not None:
        tree = _placed(materialise(parsed(sweep(), cfg.mark)), cfg)
        pools.append(match.norms(tree, ()).select("norm", "n", order(1).alias("pool_ord")))
    left, pool = match.consume(left, materialise(match.merged(*pools)), ())
    left, pool = materialise(left), materialise(pool)
    return match.consume_fuzzy(left, pool, cfg.baseline_similarity)


def _signal(rule: str, line: Column, end_line: Column, message: Column, excerpt: Column | None = None) -> list[Column]:
    return [
        F.lit(2**31 - 1).alias("ord"), F.lit(rule).alias("rule"), F.lit(R.DEFAULT[rule]).alias("severity"), line.cast("int").alias("line"), end_line.cast("int").alias("end_line"),
        message.alias("message"), F.lit(fixed.ACTIONS[rule]).alias("action"), (F.lit("") if excerpt is None else excerpt).alias("excerpt"),
    ]


def _meets(a: Column, b: Column, x: Column, y: Column) -> Column:
    return (a <= y) & (x <= b)


def _amplified(state: DataFrame, fresh: DataFrame, cfg: Config) -> DataFrame:
    spans = fresh.filter(_is_prose()).groupBy("path").agg(F.min_by("start_line", "comment_ord").alias("a"), F.max_by("end_line", "comment_ord").alias("b"))
    growth = c("new_prose") - c("old_prose")
    grown = c("had") & (c("old_prose") > 0) & (growth >= cfg.growth_min_lines) & (growth >= cfg.growth_factor * c("old_prose"))
    message = R._say("comment amplification: prose comments grew from ", c("old_prose"), " to ", c("new_prose"), " lines")
    return state.filter(~F.array_contains("switched", F.lit("UC101")) & grown).join(spans, "path").select("path", *_signal("UC101", c("a"), c("b"), message))


def _flooded(state: DataFrame, fresh: DataFrame, touching: DataFrame, cfg: Config) -> DataFrame:
    """Noisy lines of a file: new comments, docs aside, that a warning or an error meets."""
    gating = touching.filter(c("severity") >= R.WARN).select("path", c("line").alias("x"), c("end_line").alias("y"))
    noisy = fresh.filter("kind <> 'doc'").join(gating, "path").filter(_meets(c("start_line"), c("end_line"), c("x"), c("y")))
    noisy = noisy.select("path", "comment_ord", "start_line", "end_line").distinct()
    sums = noisy.groupBy("path").agg(
        F.sum(c("end_line") - c("start_line") + 1).alias("k"), F.min_by("start_line", "comment_ord").alias("a"), F.max_by("end_line", "comment_ord").alias("b")
    )
    over = (c("k") >= cfg.flood_min_lines) & (c("k") > cfg.flood_ratio * F.greatest(c("added"), F.lit(1)))
    message = R._say("comment flood: ", c("k"), " noisy new comment lines vs ", c("added"), " new code lines")
    return state.filter(~F.array_contains("switched", F.lit("UC100"))).join(sums, "path").filter(over).select("path", *_signal("UC100", c("a"), c("b"), message))


def _granted(state: DataFrame, comments: DataFrame, old_grants: DataFrame, cfg: Config) -> DataFrame:
    """File-wide exceptions that the edit adds, at the first marker whose list has their text."""
    new = R.grants(comments, cfg).join(old_grants.withColumnRenamed("granted", "before"), "path", "left")
    added = F.array_except("granted", F.coalesce("before", F.array().cast("array<string>")))
    rows = new.select("path", F.explode(added).alias("rid")).join(state.filter(~F.array_contains("switched", F.lit("UC102"))).select("path"), "path")
    lists = F.regexp_extract_all("content", F.lit(f"{R._quoted(cfg)}-file{R.RULE_LIST}"), F.lit(1))
    markers = comments.select("path", "comment_ord", "start_line", "end_line", F.get(T.lines(c("content")), F.lit(0)).alias("head"), lists.alias("lists")).filter(F.size("lists") > 0)
    met = rows.join(markers, "path").filter(F.exists("lists", lambda x: F.contains(x, c("rid"))))
    first = met.groupBy("path", "rid").agg(F.min_by(F.struct("start_line", "end_line", "head"), "comment_ord").alias("m"))
    message = R._say("edit grants this file a file-wide exception for ", c("rid"))
    return first.select("path", *_signal("UC102", c("m.start_line"), c("m.end_line"), message, c("m.head")))


def _switched(comments: DataFrame, cfg: Config) -> DataFrame:
    """(path, rules): what file-level signals honour, every rule list of a file."""
    listed = R._listed(F.regexp_extract(c("content"), R._span_marker(cfg), 1))
    own = comments.filter(c("content").rlike(R._span_marker(cfg))).select("path", F.explode(listed).alias("rule"))
    wide = R.grants(comments, cfg).select("path", F.explode("granted").alias("rule"))
    return own.unionByName(wide).groupBy("path").agg(F.collect_set("rule").alias("switched"))


def gate(files: DataFrame, olds: DataFrame, sweep: Callable[[], DataFrame] | None = None, cfg: Config | None = None) -> Gate:
    """Findings that touch new comments, and signals about each file's edit as a whole."""
    cfg = cfg or Config()
    new = materialise(parsed(files, cfg.mark))
    there = olds.filter(c("content").isNotNull())
    old = materialise(parsed(new.select("file_ord", "path", "rel").join(there, "file_ord"), cfg.mark))
    comments = comments_of(new)
    shown, shown_old = materialise(_placed(new, cfg)), materialise(_placed(old, cfg))
    bare = not new.join(old.select("file_ord"), "file_ord", "left_anti").isEmpty()
    fresh = materialise(unmatched(shown, shown_old, bare, sweep, cfg))

    zero = F.lit(0).cast("long")
    before = old.select("path", c("code_line_count").alias("old_code")).join(_prose_lines(shown_old, cfg).withColumnRenamed("prose", "old_prose"), "path", "left")
    state = new.select("path", "file_ord", "code_line_count").join(before, "path", "left").join(_prose_lines(shown, cfg).withColumnRenamed("prose", "new_prose"), "path", "left").join(_switched(comments, cfg), "path", "left")
    state = materialise(
        state.select(
            "path", "file_ord", c("old_code").isNotNull().alias("had"), F.coalesce("old_prose", zero).alias("old_prose"), F.coalesce("new_prose", zero).alias("new_prose"),
            F.greatest(zero, c("code_line_count") - F.coalesce("old_code", zero)).alias("added"), F.coalesce("switched", F.array().cast("array<string>")).alias("switched"),
        )
    )

    spans = fresh.groupBy("path").agg(F.collect_list(F.struct("start_line", "end_line")).alias("spans"))
    found = R.run_rules(comments, functions_of(new), cfg).join(spans, "path")
    touching = materialise(found.filter(F.exists("spans", lambda s: _meets(s["start_line"], s["end_line"], c("line"), c("end_line")))).drop("spans"))
    every = touching
    for more in (_amplified(state, fresh, cfg), _flooded(state, fresh, touching, cfg), _granted(state, comments, R.grants(comments_of(old), cfg), cfg)):
        every = every.unionByName(more)
    totals = fresh.agg(F.count("*").alias("new_comments"), F.coalesce(F.sum(c("end_line") - c("start_line") + 1), zero).alias("new_comment_lines"))
    stats = state.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("added"), zero).alias("added_code_lines")).join(totals)
    return Gate(R.ordered(every), stats.select("files_scanned", "new_comments", "new_comment_lines", "added_code_lines"))


# --- Proving that a change touches comments only ------------------------------------


def differences(pairs: DataFrame) -> DataFrame:
    """(path, near): the first place where code lines differ, for rows (path, old array, new array) that differ.

    ``old`` and ``new`` are fingerprints: code lines without comments and blanks.
    """
    least = F.least(F.size("old"), F.size("new"))
    places = F.filter(F.sequence(F.lit(0), F.greatest(least - 1, F.lit(0))), lambda k: (k < least) & (F.get("old", k) != F.get("new", k)))
    at = F.coalesce(F.get(places, F.lit(0)), least)
    return pairs.filter(~c("old").eqNullSafe(c("new"))).select("path", T.strip(F.coalesce(F.get("new", at), F.get("old", at))).alias("near"))

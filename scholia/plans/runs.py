"""The commands as functions: from paths, baselines and diffs to findings.

The driver lists names and locates files; contents of working trees are read by
Spark, old versions come from git, read by Spark too, or from reversing a diff.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators.lineage import materialise
from scholia.plans.gate import check, differences, gate
from scholia.sources import diffs, files, git
from scholia.sources.config import Config, UsageError
from scholia.sources.extract import decoded, fingerprint
from scholia.sources.languages import language_of

OLD = "file_ord int, content binary"
STATS = ("files_scanned", "new_comments", "new_comment_lines", "added_code_lines")


@dataclass
class Run:
    findings: DataFrame
    stats: dict
    notes: list[str]


def run_check(spark: SparkSession, paths: list[str], cfg: Config) -> Run:
    found = files.listing(paths, cfg)
    notes = [f"{found.skipped} unsupported file(s) skipped"] if found.skipped else []
    notes += [found.note] if found.note else []
    stats = {"mode": "check", "files_scanned": len(found.files), "files_skipped": found.skipped, "files_unsupported": found.unsupported.total()}
    return Run(check(files.read(spark, found.files), cfg), stats, notes)


# --- Baselines -------------------------------------------------------------------------


def check_baseline(baseline: str, anchor: Path) -> None:
    if baseline.startswith("git:"):
        git.check_ref(baseline[4:] or "HEAD", anchor if anchor.is_dir() else anchor.parent)
    elif not Path(baseline).exists():
        raise UsageError(f"the baseline {baseline} is neither a file nor a folder")


def _path_baseline(spark: SparkSession, base: Path, found: list[tuple[Path, Path]], cfg: Config):
    """A tree or one file: the counterpart has the same place under it."""
    counterpart = [base if base.is_file() else base / files._relative(f, root) for f, root in found]
    there = [(k, p) for k, p in enumerate(counterpart) if p.is_file()]
    olds = files.read(spark, [(p, p.parent) for _, p in there]).join(spark.createDataFrame([(i, k) for i, (k, _) in enumerate(there)], "file_ord int, k int"), "file_ord").select(F.col("k").alias("file_ord"), "content")
    used = {p.resolve() for p in counterpart}

    def sweep() -> DataFrame:
        rest = [p for p in sorted(base.rglob("*")) if p.is_file() and files.supported(p.name) and p.resolve() not in used and files.selected(p.relative_to(base).as_posix(), cfg)] if base.is_dir() else []
        return files.read(spark, [(p, base) for p in rest])

    return olds, sweep


def _git_baseline(spark: SparkSession, ref: str, found: list[tuple[Path, Path]], cfg: Config):
    tops: dict[Path, Path | None] = {}
    wanted: dict[Path, dict[str, list[int]]] = {}
    for k, (f, _) in enumerate(found):
        folder = f.resolve().parent
        if folder not in tops:
            tops[folder] = git.top_of(folder)
        top = tops[folder]
        if top is not None and f.resolve().is_relative_to(top.resolve()):
            wanted.setdefault(top, {}).setdefault(f.resolve().relative_to(top.resolve()).as_posix(), []).append(k)
    rows = [(k, str(top), ref, rel) for top, names in wanted.items() for rel, ks in names.items() for k in ks]
    olds = materialise(git.contents(spark, rows).select("file_ord", "content"))

    def sweep() -> DataFrame:
        first = found[0][0].resolve()
        top = git.top_of(first if first.is_dir() else first.parent)
        rest = [n for n in git.tree(top, ref, cfg) if n not in wanted.get(top, {})] if top else []
        table = git.contents(spark, [(k, str(top), ref, n) for k, n in enumerate(rest)])
        return materialise(table.select("file_ord", F.col("name").alias("path"), F.col("name").alias("rel"), "content"))

    return olds, sweep


def _gated(table: DataFrame, olds: DataFrame, sweep, cfg: Config, stats: dict) -> Run:
    got = gate(table, olds, sweep, cfg)
    row = got.stats.first()
    return Run(got.findings, {"mode": "gate", **stats, **{k: row[k] for k in STATS}}, [])


def gate_paths(spark: SparkSession, paths: list[str], baseline: str, cfg: Config, root: str | None = None) -> Run:
    check_baseline(baseline, Path(paths[0]))
    listing = files.listing(paths, cfg, root)
    make = (lambda: _git_baseline(spark, baseline[4:] or "HEAD", listing.files, cfg)) if baseline.startswith("git:") else (lambda: _path_baseline(spark, Path(baseline), listing.files, cfg))
    olds, sweep = make()
    return _gated(files.read(spark, listing.files), olds, sweep, cfg, {"baseline": baseline, "files_skipped": listing.skipped})


def gate_changes(spark: SparkSession, baseline: str, cfg: Config) -> Run:
    """Git says what has changed."""
    if not baseline.startswith("git:"):
        raise UsageError("what has changed is told by git, which needs a git: baseline")
    check_baseline(baseline, Path("."))
    ref = baseline[4:] or "HEAD"
    top, names, skipped = git.changes(ref, cfg)
    found = [(n, top) for n in names]
    olds, sweep = _git_baseline(spark, ref, found, cfg)
    return _gated(files.read(spark, found), olds, sweep, cfg, {"baseline": baseline, "files_skipped": skipped})


def _located(rel: str, root: Path) -> Path:
    """Git writes paths from the repository's top, wherever it runs."""
    for base in (root, git.top_of(root)):
        if base is not None and (base / rel).is_file():
            return base / rel
    raise UsageError(f"{rel}, which the diff names, is not found below {root}")


def gate_diff(spark: SparkSession, text: str, cfg: Config, restrict: list[str] | None = None, label: str = "diff:stdin", root: Path | None = None) -> Run:
    """The diff is the edit: old contents come from reversing it, and there is nothing else to sweep."""
    root = (root or Path.cwd()).resolve()
    limits = [Path(p).resolve() for p in restrict] if restrict else None
    found, olds, skipped = [], [], 0
    for patch in diffs.parse(text):
        if patch.new_path is None or patch.binary:
            continue
        if not files.supported(patch.new_path) or not files.selected(patch.new_path, cfg):
            skipped += 1
            continue
        disk = _located(patch.new_path, root)
        if cfg.skip_generated and files.generated(disk):
            skipped += 1
            continue
        if limits is not None and not any(disk.resolve().is_relative_to(x) for x in limits):
            continue
        if patch.old_path is not None:
            olds.append((len(found), bytearray(diffs.old_text(patch, decoded(disk.read_bytes())).encode("utf-8"))))
        found.append((git.shown(disk), root))
    return _gated(files.read(spark, found), spark.createDataFrame(olds, OLD), None, cfg, {"baseline": label, "files_skipped": skipped})


def verify(spark: SparkSession, text: str, root: Path | None = None) -> list[tuple[str, str]]:
    """(path, what) of changes that touch more than comments; what cannot be shown to be a comment counts."""
    root = (root or Path.cwd()).resolve()
    out: list[tuple[int, str, str]] = []
    pairs = []
    for k, patch in enumerate(diffs.parse(text)):
        path = patch.new_path
        if path is None:
            out.append((k, patch.old_path or "<unknown>", "the file is gone"))
        elif patch.binary:
            out.append((k, path, "binary content"))
        elif language_of(path) is None:
            out.append((k, path, "no reader for its language"))
        else:
            new = decoded(_located(path, root).read_bytes())
            pairs.append((f"{k}\n{path}", diffs.old_text(patch, new), new))
    if pairs:
        found = differences(fingerprints(spark.createDataFrame(pairs, "path string, old string, new string")))
        out += [(int((p := r.path.split("\n", 1))[0]), p[1], f"code differs at {r.near!r}") for r in found.collect()]
    return [(path, what) for _, path, what in sorted(out)]


def fingerprints(pairs: DataFrame) -> DataFrame:
    """Rows (path, old text, new text) with the texts' code lines in their place."""

    def run(paths, texts):
        import pyarrow as pa

        rows = zip(paths.to_pylist(), texts.to_pylist(), strict=True)
        return pa.array([fingerprint(t or "", language_of(p)) for p, t in rows], type=pa.list_(pa.string()))

    code = F.arrow_udf(run, "array<string>")
    return pairs.select("path", code("path", "old").alias("old"), code("path", "new").alias("new"))

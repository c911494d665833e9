"""Languages: what their files are called, how their comments and functions look."""

from __future__ import annotations

import re
from dataclasses import dataclass

# --- Fixed values: languages ----------------------------------------------------


@dataclass(frozen=True)
class Language:
    name: str
    line: str = "//"
    doc_lines: tuple[str, ...] = ()
    doc_blocks: tuple[str, ...] = ()
    nested: bool = False  # block comments nest


LANGUAGES = {
    x.name: x
    for x in (
        Language("c", doc_lines=("///", "//!"), doc_blocks=("/**", "/*!")),
        Language("cpp", doc_lines=("///", "//!"), doc_blocks=("/**", "/*!")),
        Language("javascript", doc_blocks=("/**",)),
        Language("typescript", doc_blocks=("/**",)),
        Language("tsx", doc_blocks=("/**",)),
        Language("rust", doc_lines=("///", "//!"), doc_blocks=("/**", "/*!"), nested=True),
        Language("go"),
        Language("python", line="#"),
        Language("java", doc_blocks=("/**",)),
        Language("csharp", doc_lines=("///",), doc_blocks=("/**",)),
        Language("kotlin", doc_blocks=("/**",), nested=True),
        Language("swift", doc_lines=("///",), doc_blocks=("/**",), nested=True),
    )
}

EXTENSIONS = {
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".tsx": "tsx",
    ".rs": "rust",
    ".go": "go",
    ".py": "python", ".pyi": "python",
    ".java": "java",
    ".cs": "csharp",
    ".kt": "kotlin", ".kts": "kotlin",
    ".swift": "swift",
}

# --- Fixed values: comments that steer tools --------------------------------------

COMMON = (
    r"^#\s*(region|endregion)\b",
    r"^(LCOV|GCOV|GCOVR)_EXCL_\w+",
    r"^coverage:(ignore|off|on)(-line|-start|-end|-file)?\b",
    r"^NOSONAR\b",
    r"(?i:^falls?[ -]?thr(ough|u)\.?$)",
)
C_FAMILY = (r"^NOLINT(NEXTLINE|BEGIN|END)?(?!\s*:)\b", r"^clang-format\s+(on|off)\b", r"^cppcheck-suppress\b", r"^IWYU pragma:", r"^coverity\[", r"^PRQA\b")
JS_FAMILY = (
    r"^@ts-(ignore|expect-error|nocheck|check)\b",
    r"^eslint\b",
    r"^eslint-",
    r"^prettier-ignore\b",
    r"^(biome|rome)-ignore\b",
    r"^deno-lint-ignore\b",
    r"^@?vite-ignore\b",
    r"^webpack[A-Z]\w*:",
    r"^[@#]__PURE__$",
    r"^#\s*source(MappingURL|URL)=",
    r"^(istanbul|c8|v8)\s+ignore\b",
    r"^@(jest|vitest)-environment\b",
    r"^@jsx\b",
    r"^@flow\b",
    r"^\$Flow\w*",
    r"^@(license|preserve)\b",
    r"^@type\s",
    r"^@satisfies\s",
)
JS_BLOCKS = (r"^globals?\s+[A-Za-z_$][\w$.]*([\s,:].*)?$", r"^exported\s+[A-Za-z_$][\w$]*\s*$")
GO = (r"^go:[a-z]", r"^\+build\b", r"^nolint\b", r"^lint:(ignore|file-ignore)\b", r"^#cgo\b", r"^export\s+\w+$")
RUST = (r"^rustfmt::skip\b", r"^@\s")
PYTHON = (
    r"^!\s*/",
    r"^-\*-.*-\*-\s*$",
    r"^(en)?coding[:=]\s*[-\w.]+\s*$",
    r"^vim?:\s?",
    r"^noqa\b",
    r"^type:\s",
    r"^mypy:\s",
    r"^pylint:\s*(disable|enable|skip-file)",
    r"^ruff:\s*(noqa|isort)",
    r"^flake8:\s*noqa",
    r"^fmt:\s*(off|on|skip)\b",
    r"^isort:\s*(skip|skip_file|off|on|split|dont[- ]add[- ]imports)",
    r"^yapf:\s*(disable|enable)",
    r"^pragma:\s*\S",
    r"^nosec\b",
    r"^noinspection\s",
    r"^cython:\s",
    r"^(end)?region\b(\s+[\w-]+)?$",
)
JVM = (r"(?i:^checkstyle[:.]\s*(off|on)\b)", r"^@formatter:(off|on)\b", r"^spotless:(off|on)\b", r"^noinspection\s", r"^\$NON-NLS-\d+\$")
KOTLIN = (*JVM, r"^ktlint-disable\b", r"^ktlint-enable\b")
CSHARP = (r"^ReSharper (disable|restore)\b", r"^<auto-generated")
SWIFT = (r"^swiftlint:(disable|enable)\b", r"^swiftformat:(disable|enable|options)\b", r"^sourcery:", r"^periphery:ignore\b", r"^MARK:")

DIRECTIVES = {
    "c": C_FAMILY, "cpp": C_FAMILY, "javascript": JS_FAMILY, "typescript": JS_FAMILY, "tsx": JS_FAMILY, "go": GO, "rust": RUST,
    "python": PYTHON, "java": JVM, "kotlin": KOTLIN, "csharp": CSHARP, "swift": SWIFT,
}

# --- What follows from them ---------------------------------------------------------

_ANY = {name: re.compile("|".join((*COMMON, *DIRECTIVES[name]))) for name in LANGUAGES}
_BLOCK = re.compile("|".join(JS_BLOCKS))


def language_of(path: str) -> Language | None:
    """By the last suffix, in any case."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, suffix = name.rpartition(".")
    return LANGUAGES.get(EXTENSIONS.get(f".{suffix}".lower(), "")) if dot and stem else None


def suffix_of(path: str) -> str:
    stem, dot, suffix = path.rsplit("/", 1)[-1].rpartition(".")
    return f".{suffix}".lower() if dot and stem and suffix else ""


def steers_tools(line: str, lang: str, block: bool) -> bool:
    """Whether a comment's first line of content is a directive."""
    line = line.strip()
    return bool(line) and (_ANY[lang].search(line) is not None or (block and lang in ("javascript", "typescript", "tsx") and _BLOCK.search(line) is not None))

"""Scalar text functions as column expressions.

They keep Python's notion of white space and lines, which differs from Java's in
a few characters: ``SPACE`` and ``BREAK`` spell it out. Nothing here leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions import fixed

#: Flags that give Java's regular expressions Unicode classes and \\n as the only line end.
FLAGS = "(?dU)"
SPACE = r"[\s\x1c-\x1f]"
SOLID = r"[^\s\x1c-\x1f]"
#: A character that is neither white space nor decoration.
LABEL_CHARACTER = rf"[^\s\x1c-\x1f{fixed.DECORATION[2:-1]}\-]"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def pattern(regex: str, ignore_case: bool = False, multiline: bool = False) -> str:
    return f"(?dU{'i' * ignore_case}{'m' * multiline}){regex}"


def has(text: Column, regex: str, ignore_case: bool = False, multiline: bool = False) -> Column:
    return text.rlike(pattern(regex, ignore_case, multiline))


def bound(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once, inside expressions that would copy it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"{FLAGS}^{SPACE}+|{SPACE}+\\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{FLAGS}{SPACE}+\\z", "")


def lines(text: Column) -> Column:
    """The lines of a text; a line end at its end starts no further line."""
    parts = F.split(text, f"{FLAGS}{BREAK}", -1)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    )


def filled(rows: Column) -> Column:
    """The lines that hold more than white space."""
    return F.filter(rows, lambda x: has(x, SOLID))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{FLAGS}{SOLID}+")).cast("int")


def first_line(text: Column, limit: int = 72) -> Column:
    head = F.coalesce(F.get(lines(text), F.lit(0)), F.lit(""))
    return bound(head, lambda h: F.when(F.length(h) > limit, F.concat(F.substring(h, 1, limit - 1), F.lit("…"))).otherwise(h))


def normalised(text: Column) -> Column:
    """White space collapsed, lower case: how comments are compared across versions."""
    return F.lower(strip(F.regexp_replace(text, f"{FLAGS}{SPACE}+", " ")))


def _without(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def stem(word: Column) -> Column:
    """A light stemmer: one suffix, a doubled consonant and a mute e go."""

    def cut(w: Column) -> Column:
        out = None
        for suffix in fixed.SUFFIXES:
            base = _without(w, len(suffix))
            if suffix in ("ies", "ied"):
                base = F.concat(base, F.lit("y"))
            elif suffix in ("ing", "ed"):
                base = F.regexp_replace(base, r"^(.{2,})([^lsz])\2$", "$1$2")
            fits = w.endswith(suffix) & (F.length(w) >= len(suffix) + 3)
            out = F.when(fits, base) if out is None else out.when(fits, base)
        return out.otherwise(w)

    short = bound(F.lower(word), cut)
    return bound(short, lambda s: F.when(s.endswith("e") & (F.length(s) >= 4), _without(s, 1)).otherwise(s))


def split_identifier(name: Column) -> Column:
    """Lower-case parts of snake and camel names, without numbers."""
    parts = F.regexp_extract_all(name, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), F.lit(0))
    return F.transform(parts, lambda p: F.lower(p))


def comment_words(text: Column) -> Column:
    """Stems of the words of prose, stop words left out, repeats kept."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))
    return F.transform(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(fixed.STOP_WORDS)), stem)


def operator_words(code: Column) -> Column:
    """The words that say the operators of a line of code."""
    none = F.array().cast("array<string>")
    double = [(op, words) for op, words in fixed.OPERATOR_WORDS if len(op) == 2]
    single = [(op, words) for op, words in fixed.OPERATOR_WORDS if len(op) == 1]
    said = lambda rest, op, words: F.when(F.contains(rest, F.lit(op)), F.array(*(F.lit(w) for w in words))).otherwise(none)
    found, rest = [], code
    for op, words in double:
        found.append(said(rest, op, words))
        rest = F.replace(rest, F.lit(op), F.lit(" "))
    alone = bound(rest, lambda r: F.concat(*(said(r, op, words) for op, words in single)))
    return F.concat(*found, alone)


def code_words(code: Column) -> Column:
    """Stems of names, parts of names and operators."""
    names = F.transform(F.regexp_extract_all(code, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), lambda n: F.lower(n))
    return F.array_distinct(F.transform(F.concat(names, split_identifier(code), operator_words(code)), stem))


def overlap_ratio(text: Column, code: Column) -> Column:
    """The share of a comment's words that its code holds; 0 without words."""

    def share(words: Column) -> Column:
        hits = bound(code_words(code), lambda known: F.size(F.filter(words, lambda w: F.array_contains(known, w))))
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(hits.cast("double") / F.size(words))

    return bound(comment_words(text), share)


def percent(ratio: Column) -> Column:
    """A ratio as whole percent, half to even."""
    return F.concat(F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("%"))


def without_terms(text: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """Blanks out approved terms: exact where a term has an upper-case letter, else in any case."""
    if not terms:
        return text
    quoted = [("" if t != t.lower() else "(?i)") + "".join(f"\\{c}" if not (c.isalnum() or c in " _") and c.isascii() else c for c in t) for t in terms]
    return F.regexp_replace(text, f"{FLAGS}(?<!\\w)(?:{'|'.join(f'(?:{q})' for q in quoted)})(?!\\w)", "")


def to_ascii(text: Column) -> Column:
    out = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), fixed.ASCII_FORMS, text)
    return F.regexp_replace(out, r"[^\x00-\x7F]", "?")


# --- Code, banners and diagrams ------------------------------------------------


#: Every pattern of code needs one of these; most lines of prose have none and are done.
_HINT = r"(?d)[;{}(=#@>:]|^[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*(?:return|break|continue|pass|import|from)\b"


def _code(line: Column, patterns: tuple[str, ...]) -> Column:
    gloss = has(line, fixed.PROSE_ASSIGNMENT) | has(line, rf"^{SPACE}*{fixed.BRACE_GLOSS}{SPACE}*$") | has(line, fixed.ENUM_GLOSS)
    # An assignment that trails off into a sentence: a single full stop at the end, two plain words after the first =.
    tail = has(line, rf"(?<!\.)\.{SPACE}*$") & has(line, rf"^[^=]*=(?s:.*){fixed.PLAIN_WORD}(?s:.*){fixed.PLAIN_WORD}")
    return line.rlike(_HINT) & has(line, "|".join(f"(?:{p})" for p in patterns)) & ~gloss & ~tail


def looks_like_code(line: Column) -> Column:
    return _code(line, (*fixed.STRONG_CODE, fixed.WEAK_CODE))


def surely_code(line: Column) -> Column:
    return _code(line, fixed.STRONG_CODE)


def banner_line(line: Column) -> Column:
    """Mostly decoration, around three words at most."""
    solid = F.regexp_replace(line, f"{FLAGS}{SPACE}+", "")
    deco = F.regexp_count(line, F.lit(f"{FLAGS}{fixed.DECORATION}"))
    labels = F.regexp_count(line, F.lit(f"{FLAGS}(?<!{SOLID}){SOLID}*{LABEL_CHARACTER}{SOLID}*"))
    return (deco >= 8) & (deco * 2 >= F.length(solid)) & (labels <= 3)


def diagram(rows: Column) -> Column:
    """Tables and boxes, which are not banners."""
    return F.exists(rows, lambda x: has(strip(x), f"{fixed.BOX_BORDER}|{fixed.UNICODE_BOX}") | has(x, r"\|.*\|"))


# --- Prose and sentences ---------------------------------------------------------


def prose(rows: Column) -> Column:
    """Lines that do not look like code, without URLs; blank lines stay."""
    return F.regexp_replace(F.array_join(F.filter(rows, lambda x: ~looks_like_code(x)), "\n"), pattern(fixed.URL), "")


def paragraphs(text: Column) -> Column:
    return F.split(text, f"{FLAGS}\\n\\s*\\n", -1)


def _blocks(paragraph: Column) -> Column:
    """Flattened text up to the first tag or list line, then from each such line on."""
    marked = F.transform(lines(paragraph), lambda x: F.when(has(x, f"{fixed.TAG_LINE}|{fixed.LIST_LINE}"), F.concat(F.lit("\x00"), x)).otherwise(x))
    return F.transform(F.split(F.array_join(marked, "\n"), "\x00", -1), lambda b: strip(F.regexp_replace(b, f"{FLAGS}{SPACE}+", " ")))


def _nonempty(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences(text: Column) -> Column:
    """What a reader takes in one breath: sentences and clauses, of every paragraph in turn."""

    def of(block: Column) -> Column:
        return _nonempty(F.flatten(F.transform(F.split(block, pattern(fixed.SENTENCE_END), -1), lambda s: F.split(s, pattern(fixed.CLAUSE_BREAK), -1))))

    return F.flatten(F.transform(paragraphs(text), lambda p: F.flatten(F.transform(_blocks(p), of))))


def flowing_sentences(paragraph: Column) -> Column:
    """Sentences of a paragraph's flowing text; tag and list lines count for nothing."""
    return _nonempty(F.split(F.element_at(_blocks(paragraph), 1), pattern(fixed.HARD_SENTENCE_END), -1))

"""Finds comments, strings and function spans without a grammar.

``tokens`` is one scanner for all languages with braces; what counts as a string
differs by language and is a table of openers. ``python_tokens`` does the same for
Python. Code is then looked at with comments and strings blanked out: a stack of
brackets gives each ``{`` its ``}``, and the text before a brace (its head) tells
whether it opens a function. Rows end at \\n only and columns count bytes, so all
work is on latin-1 views of the bytes, where a character is a byte.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from scholia.sources.languages import Language


@dataclass
class Token:
    kind: str  # "comment" or "string"
    start: int
    end: int


@dataclass
class Function:
    name: str
    start: int
    end: int
    body_start: int | None
    body_end: int | None

    @property
    def spoken(self) -> bool:
        """Whether it has a body of its own, and so counts as a function and not only as a place."""
        return self.body_start is not None


# --- Strings and comments ----------------------------------------------------------

_QUOTED = {'"': re.compile(r'"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)', re.S), "'": re.compile(r"'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)", re.S)}
_OPENERS = {
    "c": r"//|/\*|\"|'",
    "cpp": r"//|/\*|R\"|\"|'",
    "javascript": r"//|/\*|\"|'|`|/",
    "typescript": r"//|/\*|\"|'|`|/",
    "tsx": r"//|/\*|\"|'|`|/",
    "rust": r"//|/\*|\bb?r#*\"|\"|'",
    "go": r"//|/\*|\"|'|`",
    "java": r"//|/\*|\"\"\"|\"|'",
    "csharp": r"//|/\*|\"\"\"+|\$*@\$*\"|\"|'",
    "kotlin": r"//|/\*|\"\"\"|\"|'",
    "swift": r"//|/\*|#*\"\"\"|#+\"|\"",
}
_OPEN = {k: re.compile(v) for k, v in _OPENERS.items()}
_RUST_CHAR = re.compile(r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))[\x80-\xff]*'")
_RAW_CPP = re.compile(r"R\"([^()\\\s]{0,16})\(")
_JS_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield))\s*\Z")
_TAG_END = re.compile(r"</?[A-Za-z][\w.:-]*(?:\s[^<>]*)?/?>\s*\Z|/>\s*\Z|<>\s*\Z|</>\s*\Z")


def _block_end(s: str, at: int, nested: bool) -> int:
    if not nested:
        end = s.find("*/", at + 2)
        return len(s) if end < 0 else end + 2
    depth, at = 1, at + 2
    for m in re.compile(r"/\*|\*/").finditer(s, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(s)


def _line_end(s: str, at: int, joined: bool) -> int:
    """End of a line comment, before its \\r; in C a backslash at a line's end carries it on."""
    while True:
        end = s.find("\n", at)
        if end < 0:
            return len(s)
        tail = s[at:end].rstrip("\r")
        if not (joined and tail.endswith("\\")):
            return end - (len(s[at:end]) - len(tail))
        at = end + 1


def _interpolated(s: str, at: int, quote: str, opener: str, lang: str, multiline: bool) -> int:
    """End of a string that may hold code between ``opener`` and its bracket."""
    at += len(quote)
    close = {"{": "}", "(": ")"}[opener[-1]]
    while at < len(s):
        if s.startswith(quote, at):
            return at + len(quote)
        if s.startswith(opener, at):
            depth, at = 1, at + len(opener)
            while at < len(s) and depth:
                ch = s[at]
                if ch in "\"'`" and lang not in ("kotlin", "swift") or ch == '"':
                    at = _string_end(s, at, lang)
                    continue
                if s.startswith("/*", at):
                    at = _block_end(s, at, lang in ("kotlin", "swift"))
                    continue
                depth += (ch == opener[-1]) - (ch == close)
                at += 1
            continue
        if s[at] == "\\" and quote != '"""':
            at += 2
            continue
        if s[at] == "\n" and not multiline:
            return at
        at += 1
    return len(s)


def _string_end(s: str, at: int, lang: str) -> int:
    ch = s[at]
    if ch == "`":
        if lang == "go":
            end = s.find("`", at + 1)
            return len(s) if end < 0 else end + 1
        return _interpolated(s, at, "`", "${", lang, True)
    if lang == "kotlin" and ch == '"':
        return _interpolated(s, at, '"""', "${", lang, True) if s.startswith('"""', at) else _interpolated(s, at, '"', "${", lang, False)
    if lang == "swift" and ch == '"':
        return _interpolated(s, at, '"""', "\\(", lang, True) if s.startswith('"""', at) else _interpolated(s, at, '"', "\\(", lang, False)
    m = _QUOTED[ch].match(s, at)
    return m.end() if m else at + 1


def _opened(s: str, m: re.Match, lang: str, last_code: int) -> tuple[str, int] | None:
    """(kind, end) of what an opener starts, or None if it is code."""
    op, at = m[0], m.start()
    if op == "//":
        return "comment", _line_end(s, at, lang in ("c", "cpp"))
    if op == "/*":
        return "comment", _block_end(s, at, lang in ("rust", "kotlin", "swift"))
    if op == "/":
        before = s[max(last_code, at - 200) : at]
        if _BEFORE_REGEX.search(before) and not _TAG_END.search(before) and not before.rstrip().endswith("<") and (r := _JS_REGEX.match(s, at)):
            return "string", r.end()
        return None
    if lang == "cpp" and op == 'R"':
        raw = _RAW_CPP.match(s, at)
        end = s.find(f"){raw[1]}\"", at) if raw else -1
        return ("string", end + len(raw[1]) + 2) if end >= 0 else ("string", _string_end(s, at + 1, lang))
    if lang == "rust" and op.endswith('"') and "r" in op:
        close = '"' + "#" * op.count("#")
        end = s.find(close, m.end())
        return "string", len(s) if end < 0 else end + len(close)
    if lang == "rust" and op == "'":
        char = _RUST_CHAR.match(s, at)
        return ("string", char.end()) if char else None
    if lang == "rust" and op == '"':
        r = re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match(s, at)
        return "string", r.end() if r else len(s)
    if lang == "swift" and op.startswith("#"):
        close = op[::-1]
        end = s.find(close, m.end())
        return "string", len(s) if end < 0 else end + len(close)
    if lang == "csharp" and "@" in op:
        r = re.compile(r'"(?:[^"]|"")*"').match(s, m.end() - 1)
        return "string", r.end() if r else len(s)
    if lang in ("java", "csharp") and op.startswith('"""'):
        end = s.find(op, m.end())
        while lang == "java" and end > 0 and s[end - 1] == "\\":
            end = s.find(op, end + 1)
        return "string", len(s) if end < 0 else end + len(op)
    if op == "'" and lang in ("c", "cpp") and re.match(r"[0-9a-fA-F]", s[at - 1 : at]) and re.match(r"'[0-9a-fA-F]", s[at : at + 2]) and re.search(r"\b[0-9][0-9a-fA-FxX']*\Z", s[max(0, at - 40) : at]):
        return None  # a digit separator
    return "string", _string_end(s, at, lang)


def tokens(s: str, lang: str) -> list[Token]:
    out, at, seen, opener = [], 0, 0, _OPEN[lang]
    while m := opener.search(s, at):
        got = _opened(s, m, lang, seen)
        if got is None:
            at = m.end()
            continue
        kind, end = got
        if kind == "string" and lang in ("javascript", "tsx") and m[0] in "\"'" and _in_markup_text(s, m.start(), seen):
            at = m.end()  # an apostrophe in the text of an element
            continue
        out.append(Token(kind, m.start(), max(end, m.end() if kind == "comment" else m.start() + 1)))
        at = out[-1].end
        seen = at if kind == "string" else seen
    return out


def _in_markup_text(s: str, at: int, since: int) -> bool:
    line = s[max(since, s.rfind("\n", 0, at) + 1) : at]
    return bool(re.search(r"<[A-Za-z][\w.]*(?:\s[^<>{}]*)?>[^<>{}]*\Z|</[\w.]*>[^<>{}();=]*\Z", line))


_PY = re.compile(r"#[^\n]*|(?:\b[rRuUbBfFtT]{1,3})?(?:\"\"\"|'''|\"|')")


def python_tokens(s: str) -> list[Token]:
    out, at = [], 0
    while m := _PY.search(s, at):
        if m[0][0] == "#":
            end = m.end() - (len(m[0]) - len(m[0].rstrip("\r")))
            out.append(Token("comment", m.start(), end))
            at = m.end()
            continue
        quote = m[0].lstrip("rRuUbBfFtT")
        body = re.compile(rf"(?:[^\\]|\\.)*?{quote}" if len(quote) == 3 else rf"(?:[^\\\n{quote}]|\\.)*(?:{quote}|(?=\n)|\Z)", re.S)
        r = body.match(s, m.end())
        out.append(Token("string", m.start(), r.end() if r else len(s)))
        at = out[-1].end
    return out


_VISIBLE = re.compile(r"[^\n]")


def blanked(s: str, spans: list[Token], fill: str = " ") -> str:
    out, at = [], 0
    for t in spans:
        out.append(s[at : t.start])
        out.append(_VISIBLE.sub(fill, s[t.start : t.end]))
        at = t.end
    return "".join([*out, s[at:]])


# --- Functions of languages with braces ----------------------------------------------

#: Words before a bracket pair that make it no parameter list.
_CONTROL = re.compile(r"(?:if|for|foreach|while|switch|catch|using|lock|fixed|with|synchronized|return|match|guard|when|sizeof|throw|await|new|typeof|defined|alignas|decltype|super|this)")
#: Words that no function's head has before its name.
_NOT_BEFORE = re.compile(r"\b(?:new|return|throw|await|else|do|case|goto)\b")
_TYPES = re.compile(r"\b(?:class|interface|enum|record|struct|namespace|object)\b")
_NAME_BEFORE_PARENS = re.compile(r"(~?[A-Za-z_$\x80-\xff][\w$\x80-\xff]*|operator\s*\S{1,3})\s*(?:<[^<>(){}]*>\s*)?\Z")
_WORD = re.compile(r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*")


def _pairs(code: str) -> tuple[dict[int, int], list[int]]:
    """Where each opening bracket closes, and where the braces open."""
    stack: list[tuple[str, int]] = []
    close: dict[int, int] = {}
    opens = []
    want = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", code):
        ch, at = m[0], m.start()
        if ch in "([{":
            stack.append((ch, at))
            if ch == "{":
                opens.append(at)
            continue
        depth = len(stack) - 1
        while depth >= 0 and stack[depth][0] != want[ch]:
            depth -= 1
        if depth >= 0 and (ch == "}" or depth == len(stack) - 1 or all(x[0] != "{" for x in stack[depth + 1 :])):
            close[stack[depth][1]] = at
            del stack[depth:]
    for _, at in stack:
        close[at] = len(code) - 1
    return close, opens


def _head_start(code: str, at: int, lang: str) -> int:
    """Where the statement begins whose brace stands at ``at``: after ; { } or an unclosed bracket."""
    depth, k = 0, at - 1
    while k >= 0:
        ch = code[k]
        if ch in ")]":
            depth += 1
        elif ch in "([":
            if depth == 0:
                return k + 1
            depth -= 1
        elif depth == 0 and ch in ";{}":
            return k + 1
        elif depth == 0 and ch == "," and lang not in ("c", "cpp", "java", "csharp", "swift", "kotlin", "rust", "go"):
            return k + 1
        elif ch in "{}":
            return k + 1
        k -= 1
    return 0


def _solid(code: str, at: int, end: int) -> int:
    while at < end and code[at].isspace():
        at += 1
    return at


def _expression_end(code: str, at: int, close: dict[int, int]) -> int:
    """End of an expression: before , ; or a bracket that it did not open, or at a line's end that completes it."""
    k = _solid(code, at, len(code))
    while k < len(code):
        ch = code[k]
        if ch in "([{":
            k = close.get(k, len(code) - 1) + 1
            continue
        if ch in ",;)]}":
            break
        if ch == "\n" and not re.search(r"[=+\-*/%&|^<>?:.(\[{,]\s*\Z", code[max(at, k - 40) : k]) and not re.match(r"\s*[.?:+\-*/%&|)\]}]", code[k + 1 : k + 80]):
            break
        k += 1
    while k > at and code[k - 1].isspace():
        k -= 1
    return k


def _bracket_pairs(head: str) -> list[tuple[int, int]]:
    """Outer round brackets of a head that follow a name: any of them may hold the parameters."""
    out, depth, start = [], 0, -1
    for k, ch in enumerate(head):
        if ch in "([":
            start = k if depth == 0 else start
            depth += 1
        elif ch in ")]":
            depth -= 1
            if depth == 0 and ch == ")" and start >= 0 and head[start] == "(" and _NAME_BEFORE_PARENS.search(head[:start].rstrip()):
                out.append((start, k + 1))
    return out


#: What may stand between the parameters and the body.
_AFTER = {
    "c": re.compile(r"\s*(?:__\w+(?:\s*\(\(?[^()]*\)?\))?\s*)*"),
    "cpp": re.compile(
        r"\s*(?:(?:const|noexcept(?:\s*\([^()]*\))?|override|final|volatile|mutable|try|&{1,2}|__\w+(?:\s*\(\(?[^()]*\)?\))?|->[^;{}]*|throw\s*\([^)]*\)|requires\b.*)\s*)*(?::(?!:).*)?", re.S
    ),
    "java": re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws\s[\w\s.,<>@]*)?"),
    "csharp": re.compile(r"\s*(?::\s*(?:base|this)\s*\(.*\))?\s*(?:where\s[^{}]*)?", re.S),
    "javascript": re.compile(r"\s*"),
    "typescript": re.compile(r"\s*(?::[^;{}]*)?\s*"),
    "tsx": re.compile(r"\s*(?::[^;{}]*)?\s*"),
}


def _flat(text: str) -> str:
    while (less := re.sub(r"\([^()]*\)|\[[^\[\]]*\]", "", text)) != text:
        text = less
    return text


_ABOVE = re.compile(r"^[ \t]*#(?:[^\n\\]|\\\n|\\.)*$|\b(?:public|private|protected)\s*:(?!:)", re.M)


def _own_head(code: str, start: int, at: int, lang: str) -> int:
    """Where a C head begins, after preprocessor lines, access labels and template parameters."""
    if lang not in ("c", "cpp"):
        return start
    above = [m.end() for m in _ABOVE.finditer(code[start:at])]
    start += above[-1] if above else 0
    if template := re.match(r"\s*template\s*<", code[start:at]):
        depth, k = 1, start + template.end()
        while k < at and depth:
            depth += (code[k] == "<") - (code[k] == ">")
            k += 1
        start = k
    return start


def _plain_head(code: str, start: int, at: int, lang: str) -> tuple[str, int] | None:
    """(name, start) if a head reads like ``type name(parameters) qualifiers`` of a function."""
    start = _own_head(code, start, at, lang)
    head = code[start:at]
    for a, b in _bracket_pairs(head):
        if not _AFTER[lang].fullmatch(head[b:]):
            continue
        name = _NAME_BEFORE_PARENS.search(head[:a].rstrip())[1]
        before = _flat(head[:a])
        typed = before[: len(before.rstrip()) - len(name)].strip()
        if _CONTROL.fullmatch(name) or _NOT_BEFORE.search(typed) or (lang not in ("c", "cpp") and _TYPES.search(typed)):
            return None
        if "operator" not in name and re.search(r"(?<![=!<>])=(?!=)", typed):
            return None
        if lang == "c" and not typed:
            return None  # a macro call with a block
        return name, start + len(head) - len(head.lstrip())
    return None


def _first_name(text: str) -> str:
    m = _WORD.search(text)
    return m[0] if m else "<anonymous>"


_KEYWORD_FUNCTIONS = {
    "javascript": re.compile(r"\bfunction\b\s*\*?\s*([\w$\x80-\xff]*)\s*(?=[(<])"),
    "rust": re.compile(r"\bfn\s+([\w\x80-\xff]+)"),
    "go": re.compile(r"\bfunc\b(?:\s*\([^()]*\)\s*(?=[\w\x80-\xff]+\s*[(\[]))?\s*([\w\x80-\xff]*)"),
    "kotlin": re.compile(r"\bfun\b\s*(?:<[^>]*>\s*)?(?:[\w.<>?, ]+\.)?`?([\w\x80-\xff]*)`?(?=\s*[(<])"),
    "swift": re.compile(r"\bfunc\s+([\w\x80-\xff]+|[^\s\w(]+)|\b(init)\b[?!]?\s*(?=[(<])"),
}
_MODIFIERS = {
    "rust": r"(?:(?:pub(?:\s*\([^)]*\))?|const|async|unsafe|default|extern(?:\s+\"[^\"]*\")?)\s+)*",
    "kotlin": r"(?:(?:public|private|protected|internal|override|open|abstract|final|suspend|inline|infix|operator|tailrec|external|actual|expect)\s+)*",
    "swift": r"(?:(?:public|private|fileprivate|internal|open|override|static|class|final|mutating|nonmutating|convenience|required|prefix|postfix|@\w+(?:\([^)]*\))?)\s+)*",
    "javascript": r"(?:async\s+)?",
    "go": r"",
}


def _before(code: str, at: int, modifiers: str) -> int:
    line = code[max(0, at - 300) : at]
    m = re.search(rf"(?:(?<=[\s;{{}}(])|^)({modifiers})\Z", line)
    return at - len(m[1]) if m and m[1] else at


def _body_of(code: str, at: int, close: dict[int, int], lang: str) -> tuple[int, int] | None:
    """(start, end) of the body of a function whose keyword ends at ``at``; None without one."""
    k = at
    while k < len(code):
        ch = code[k]
        if ch in "([":
            k = close.get(k, len(code) - 1) + 1
            continue
        if ch == "{":
            if lang == "go" and re.search(r"\b(?:interface|struct)\s*\Z", code[max(at, k - 20) : k]):
                k = close.get(k, len(code) - 1) + 1
                continue
            if lang in ("typescript", "tsx") and re.search(r"[:|&]\s*\Z", code[max(at, k - 10) : k]):
                k = close.get(k, len(code) - 1) + 1
                continue
            return k, close.get(k, len(code) - 1) + 1
        if ch == "=" and lang == "kotlin" and code[k + 1 : k + 2] != "=":
            return k, _expression_end(code, k + 1, close)
        if ch in ";})" or (ch == "\n" and lang == "go") or (ch == "\n" and lang in ("kotlin", "swift") and re.match(r"\s*(?:fun|func|va[lr]|let|init|\}|@|private|public|internal|override|static|class|case|//)", code[k : k + 60])):
            return None
        k += 1
    return None


_ARROW = re.compile(r"=>|->")


def _arrow_functions(code: str, close: dict[int, int], lang: str) -> list[Function]:
    out = []
    opened = {b: a for a, b in close.items()}
    mark = "->" if lang == "java" else "=>"
    for m in re.finditer(re.escape(mark), code):
        k = m.start() - 1
        while k >= 0 and code[k].isspace():
            k -= 1
        if k < 0:
            continue
        start, name = None, "<anonymous>"
        if code[k] == ")" and k in opened:
            start = opened[k]
            before = code[:start].rstrip()
            if lang == "csharp" and (w := _NAME_BEFORE_PARENS.search(before[-80:])) and not _CONTROL.fullmatch(w[1]) and re.search(r"[\w\]>?]\s+[\w]+\s*(?:<[^<>]*>)?\Z", before[-120:]) and not re.search(r"(?:=|return|\(|,|=>)\s*\w+\Z", before[-120:]):
                name, start = w[1], _solid(code, _head_start(code, start, lang), start)
        elif code[k].isalnum() or code[k] in "_$":
            w = re.search(r"[\w$]+\Z", code[max(0, k - 80) : k + 1])
            start, name = k + 1 - len(w[0]), w[0]
            if lang == "java" and re.search(r"\b(?:case|default)\b[^;{}]*\Z", code[max(0, start - 120) : k + 1]):
                continue
            if lang == "csharp" and not re.search(r"[=(,:?]\s*(?:async\s+|static\s+)*\Z|\breturn\s+\Z|=>\s*\Z", code[max(0, start - 60) : start]):
                continue  # an expression-bodied property or a switch arm
        elif lang in ("typescript", "tsx"):
            # A return type stands between the parameters and the arrow.
            w = re.search(r"\)\s*:\s*[^=;(){}]*\Z", code[max(0, m.start() - 120) : m.start()])
            at = max(0, m.start() - 120) + w.start() if w else -1
            start = opened.get(at)
        if lang in ("typescript", "tsx") and start is not None and (w := re.search(r"\)\s*:\s*[^=;(){}]*\Z", code[max(0, m.start() - 120) : m.start()])) and code[k] != ")":
            start, name = opened.get(max(0, m.start() - 120) + w.start(), start), "<anonymous>"
        if start is None:
            continue
        start = _before(code, start, r"(?:async\s+|static\s+)*")
        body = _solid(code, m.end(), len(code))
        if lang in ("typescript", "tsx") and re.search(r"\btype\s+\w+[^=;]*=\s*\Z", code[max(0, start - 80) : start]):
            continue  # a function type
        end = close.get(body, len(code) - 1) + 1 if code[body : body + 1] == "{" else _expression_end(code, body, close)
        out.append(Function(name, start, end, body, end))
    return out


def brace_functions(code: str, lang: str) -> list[Function]:
    """Function spans; ``code`` has its comments and strings blanked."""
    close, opens = _pairs(code)
    out: list[Function] = []
    family = "javascript" if lang in ("javascript", "typescript", "tsx") else lang
    bodies: set[int] = set()
    if family in _KEYWORD_FUNCTIONS:
        for m in _KEYWORD_FUNCTIONS[family].finditer(code):
            if lang == "swift" and m[2] and re.search(r"[.\w]\s*\Z", code[max(0, m.start() - 1) : m.start()]) and code[m.start() - 1 : m.start()] in (".",):
                continue
            if lang == "go" and not m[1] and re.match(r"\s*\(", code[m.end() :]) is None:
                continue
            body = _body_of(code, m.end(), close, lang)
            if body is None:
                continue
            name = next((x for x in m.groups() if x), "<anonymous>")
            start = _before(code, m.start(), _MODIFIERS[family])
            out.append(Function(name, start, body[1], *body))
            bodies.add(body[0])
    if family in ("javascript", "java", "csharp"):
        out += (arrows := _arrow_functions(code, close, lang))
        bodies |= {f.body_start for f in arrows}
    for at in opens:
        if at in bodies:
            continue
        if family == "rust":
            m = re.search(r"(?:\bmove\s*)?\|[^|{};]*\|\s*(?:->[^{};]*)?\Z", code[max(0, at - 200) : at])
            if m:
                start = max(0, at - 200) + m.start()
                out.append(Function("<anonymous>", start, close[at] + 1, at, close[at] + 1))
            continue
        if family in ("kotlin", "swift"):
            start = _head_start(code, at, lang)
            head = code[start:at]
            last = head.rsplit("\n", 1)[-1]
            block = re.search(r"\b(?:class|interface|object|enum|struct|protocol|extension|init|get|set|willSet|didSet|if|else|for|while|when|switch|do|try|catch|finally|repeat|guard|defer|actor|companion)\b", last) or re.search(r"(?:->|\bcase\b.*|\belse\b)\s*\Z", last)
            if not block and (head.strip() and re.search(r"[\w)>=(,:?]\s*\Z", head)) and not re.search(r"\bvar\s+\w+\s*:\s*[^=]*\Z", last):
                out.append(Function("<anonymous>", at, close[at] + 1, None, None))
            continue
        if family == "go":
            continue
        start = _head_start(code, at, lang)
        head = code[start:at]
        if family == "cpp" and (m := re.search(r"\[[^\[\]]*\]\s*(\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*(?:mutable|noexcept|constexpr|\s)*(?:->[^;{}]*)?\Z", head)) and not re.search(r"[\w)\]]\s*\Z", head[: m.start()]):
            out.append(Function(_first_name(m[1][1:].split()[-1] if m[1] and len(m[1]) > 2 else ""), start + m.start(), close[at] + 1, at, close[at] + 1))
            continue
        found = _plain_head(code, start, at, lang)
        if found:
            name, own = found
            out.append(Function(name, own, close[at] + 1, at, close[at] + 1))
    if family == "rust":
        for m in re.finditer(r"(?:(?<=[(,=])|\bmove)\s*(\|[^|{};()]*(?:\([^()]*\)[^|{};()]*)*\|)\s*(?=[^\s{|])", code):
            if code[m.end() : m.end() + 2] == "->":
                continue
            start = _solid(code, m.start(), m.end())
            end = _expression_end(code, m.end(), close)
            if end > m.end():
                out.append(Function("<anonymous>", start, end, m.end(), end))
    return sorted(out, key=lambda f: (f.start, -f.end))


# --- Functions and docstrings of Python ------------------------------------------------

_DEF = re.compile(r"^([ \t]*)((?:async[ \t]+)?def[ \t]+([\w\x80-\xff]+)|class[ \t]+([\w\x80-\xff]+))", re.M)
_LAMBDA = re.compile(r"\blambda\b")


@dataclass
class Docstring:
    start: int
    end: int
    owner: str  # "module", "function" or "class"
    row: int
    place: int  # a position whose enclosing function is the docstring's


def _colon(code: str, at: int, close: dict[int, int]) -> int:
    while at < len(code) and code[at] != ":":
        at = close.get(at, at) + 1 if code[at] in "([{" else at + 1
    return at


def python_functions(s: str, code: str, strings: list[Token], comments: list[Token]) -> tuple[list[Function], list[Docstring]]:
    """``code``: comments and strings blanked with spaces and ``x``."""
    close, _ = _pairs(code)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    row_of = lambda at: bisect_right(starts, at) - 1
    # Logical lines: rows inside brackets or strings, or after a backslash, go on with the one before.
    inside = set()
    for a, b in [*close.items(), *((t.start, t.end - 1) for t in strings)]:
        inside.update(range(row_of(a) + 1, row_of(min(b, len(code) - 1 if code else 0)) + 1))
    rows = code.split("\n")
    inside.update(k + 1 for k, r in enumerate(rows) if r.rstrip("\r").endswith("\\"))
    indent = lambda r: len(r) - len(r.lstrip())
    comment_at = {row_of(t.start): t for t in comments if not rows[row_of(t.start)].strip()}

    def block(row: int, own: int, after: int) -> int:
        """End of the block that the header at ``row`` opens."""
        last, body, ended = after, None, False
        for k in range(row + 1, len(rows)):
            if k in inside:
                last = max(last, starts[k] + len(rows[k].rstrip()))
                continue
            t = comment_at.get(k)
            if t is not None:
                column = t.start - starts[k]
                if not ended and (column >= body if body is not None else column > own):
                    last = max(last, t.end)
                elif body is not None and column < body:
                    ended = True
                continue
            if not rows[k].strip():
                continue
            if indent(rows[k]) <= own:
                break
            body = indent(rows[k]) if body is None else body
            ended = False
            last = max(last, starts[k] + len(rows[k].rstrip()))
        return last

    strings_at = {t.start: t for t in strings}
    functions, docs = [], []

    def docstring(at: int, owner: str, row: int, place: int) -> None:
        k = at
        while k < len(code) and (code[k].isspace() or code[k] == "\\"):
            k += 1
        t = strings_at.get(k)
        if t is None:
            return
        rest = code[t.end : starts[row_of(t.end - 1) + 1] if row_of(t.end - 1) + 1 < len(starts) else len(code)]
        if not rest.split(";")[0].strip():
            docs.append(Docstring(t.start, t.end, owner, row, place))

    docstring(0, "module", 0, -1)
    for m in _DEF.finditer(code):
        if row_of(m.start()) in inside:
            continue
        at = m.start(2)
        colon = _colon(code, m.end(), close)
        row = row_of(colon)
        rest = code[colon + 1 : starts[row + 1] if row + 1 < len(starts) else len(code)]
        if rest.strip():
            first = _solid(code, colon + 1, len(code))
            end = starts[row] + len(rows[row].rstrip())
        else:
            end = block(row, len(m[1]), colon + 1)
            first = _solid(code, colon + 1, max(end, colon + 1))
        docstring(colon + 1, "function" if m[3] else "class", row_of(at), m.start(2) - 1)
        if m[3]:
            functions.append(Function(m[3], at, end, first, end))
    for m in _LAMBDA.finditer(code):
        colon = _colon(code, m.end(), close)
        end = _expression_end(code, colon + 1, close)
        functions.append(Function("<anonymous>", m.start(), end, _solid(code, colon + 1, end), end))
    return sorted(functions, key=lambda f: (f.start, -f.end)), docs


def scan(s: str, language: Language) -> tuple[list[Token], list[Function], list[Docstring], str]:
    """(comments, functions, docstrings, code without comments and strings) of latin-1 text."""
    if language.name == "python":
        found = python_tokens(s)
        code = blanked(blanked(s, [t for t in found if t.kind == "comment"]), [t for t in found if t.kind == "string"], "x")
        strings, comments = ([t for t in found if t.kind == k] for k in ("string", "comment"))
        functions, docs = python_functions(s, code, strings, comments)
        return comments, functions, docs, code
    found = tokens(s, language.name)
    code = blanked(blanked(s, [t for t in found if t.kind == "comment"]), [t for t in found if t.kind == "string"], "_")
    return [t for t in found if t.kind == "comment"], brace_functions(code, language.name), [], code

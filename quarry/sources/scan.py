"""What of a source text is code: strings and comments blanked out, lines and columns kept.

One pass with a stack of states (code, and code inside a template string) for the languages whose blocks are braces.
"""

from __future__ import annotations

import re

_BLANK = re.compile(r"[^\n]")
_OPEN = {
    "typescript": re.compile(r"//|/\*|/|\"|'|`|\{|\}"),
    "javascript": re.compile(r"//|/\*|/|\"|'|`|\{|\}"),
    "rust": re.compile(r"//|/\*|\bb?r#*\"|\"|'"),
    "go": re.compile(r"//|/\*|\"|'|`"),
    "java": re.compile(r"//|/\*|\"\"\"|\"|'"),
}
_QUOTED = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}?", re.S) for q in "\"'"}
_BLOCK = re.compile(r'"""(?:\\.|.)*?(?:"""|\Z)', re.S)
_RAW = re.compile(r"`[^`]*`?")
_CHAR = re.compile(r"'(?:\\[^'\n]+|[^'\\\n])'")
_TEMPLATE = re.compile(r"(?:\\.|[^\\`$]|\$(?!\{))*", re.S)
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/")
_NEST = re.compile(r"/\*|\*/")


def _comment_end(text: str, at: int, nested: bool) -> int:
    """Where the block comment that begins at ``at`` ends; those of Rust nest."""
    if not nested:
        end = text.find("*/", at + 2)
        return len(text) if end < 0 else end + 2
    depth = 0
    for m in _NEST.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def scan(text: str, language: str) -> tuple[str, str]:
    """(without comments, without comments and the insides of strings) of a text, of the same length and lines.

    Unclosed strings end with their line, unclosed comments and templates with the text.
    """
    bare, code = [], []
    at, begun, depths = 0, 0, []  # depths: braces open in each ``${`` around

    def take(end: int, comment: bool = False, quote: str = "") -> None:
        """Blank out ``at``..``end``, but for the marks of a string: its ``quote``, and its end where it is closed."""
        nonlocal at, begun
        plain, inside = text[begun:at], text[at:end]
        bare.append(plain + (_BLANK.sub(" ", inside) if comment else inside))
        shut = '"' + "#" * quote.count("#") if "#" in quote else quote[-1:]
        head, tail = len(quote), len(shut) if quote and len(inside) >= len(quote) + len(shut) and inside.endswith(shut) else 0
        code.append(plain + inside[:head] + _BLANK.sub(" ", inside[head : len(inside) - tail]) + inside[len(inside) - tail :])
        at = begun = end

    def skip() -> None:
        nonlocal at
        at += 1

    def template() -> None:
        """From inside a template string to its end or to the code of its next ``${``."""
        nonlocal at
        take(_TEMPLATE.match(text, at).end())
        if text.startswith("${", at):
            depths.append(0)
            at += 2
        else:
            at += 1

    while m := _OPEN[language].search(text, at):
        at, mark = m.start(), m[0]
        if mark == "//":
            end = text.find("\n", at)
            take(len(text) if end < 0 else end, True)
        elif mark == "/*":
            take(_comment_end(text, at, language == "rust"), True)
        elif mark == "/":
            before = text[max(0, at - 20) : at].rstrip(" \t")
            own = _PATTERN.match(text, at) if not before or before[-1] in "(,=:[!&|?{};+-*%~^<>\n" or before.endswith("return") else None
            take(own.end(), quote="/") if own else skip()
        elif mark == "{":
            if depths:
                depths[-1] += 1
            at += 1
        elif mark == "}":
            at += 1
            if depths and depths[-1] == 0:
                depths.pop()
                template()
            elif depths:
                depths[-1] -= 1
        elif mark == "`" and language == "go":
            take(_RAW.match(text, at).end(), quote=mark)
        elif mark == "`":
            at += 1
            template()
        elif mark == '"""':
            take(_BLOCK.match(text, at).end(), quote=mark)
        elif mark.endswith('"') and mark != '"':
            end = text.find('"' + "#" * mark.count("#"), m.end())
            take(len(text) if end < 0 else end + 1 + mark.count("#"), quote=mark)
        elif mark == "'" and language in ("rust", "go", "java"):
            own = _CHAR.match(text, at)  # else a lifetime
            take(own.end(), quote=mark) if own else skip()
        else:
            take(_QUOTED[mark].match(text, at).end(), quote=mark)
    at = len(text)
    take(at)
    return "".join(bare), "".join(code)

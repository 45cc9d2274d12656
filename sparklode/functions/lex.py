"""Masking of strings and comments in source text, length-preserving.

A masked text has the line and character positions of the original. Comments become blanks; a
string becomes one OPEN mark followed by INSIDE marks (line ends stay), so a line that begins
inside a string begins with INSIDE. Code inside strings (``{...}`` of f-strings, ``${...}`` of
templates, ``{...}`` of JSX) stays readable at any depth, with strings of its own masked.

One scan per text, linear in its length, with a stack of modes (code, template, f-string, JSX tag
and JSX text) and a stack of open brackets. A bracket without a partner becomes a mark that opens
and closes nothing, so what follows an unclosed bracket keeps its level: LOST_CALL for a round
one, which may still belong to a call, LOST for others. In Python brackets inside brackets get
the same marks, as blocks never lie in them: there brackets tell only that a line goes on, and
no pattern has to nest.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

OPEN, INSIDE, LOST_CALL, LOST = "\u0002", "\u0001", "\u0003", "\u0004"
_PARTNER = {")": "(", "]": "[", "}": "{"}

_PREFIX = r"(?:[rRbBuUfFtT]{1,2})"
_PY_CODE = re.compile(
    rf"(?P<run>(?:[^#\"'()\[\]{{}}\w:\n]|\w++(?![\"']))++)"
    rf"|(?P<string>{_PREFIX}?(?P<quote>\"\"\"|'''|\"|'))|(?P<comment>\#[^\n]*+)|(?P<one>\w++|.)",
    re.S)
_PY_BODY = {q: re.compile(rf"(?:[^\\{q[0]}]++|\\.|{q[0]}(?!{q[1:]}))*+(?:{q})?" if len(q) > 1
                          else rf"(?:[^\\\n{q}]++|\\.)*+{q}?", re.S)
            for q in ('"""', "'''", '"', "'")}
_PY_TEXT = {q: re.compile(rf"(?:[^\\{{}}{q[0]}]++|\\[^{{}}]|\{{\{{|\}}\}}|{q[0]}(?!{q[1:]}))++"
                          if len(q) > 1 else rf"(?:[^\\{{}}\n{q}]++|\\[^{{}}]|\{{\{{|\}}\}})++",
                          re.S) for q in ('"""', "'''", '"', "'")}
_SPEC = re.compile(r"[^{}\n]++")
# Outside f-strings: all up to the next bracket, string or comment, and that one, in one step.
_PY_PLAIN = re.compile(
    r"(?:[^#\"'()\[\]{}\w]|\w++(?![\"']))*+(?:([(\[{])|([)\]}])|((?:[rRbBuU]{1,2})?(?:"
    + "|".join(q + body.pattern for q, body in _PY_BODY.items())
    + r"))|((?:[fFtT][rRbBuUfFtT]?|[rRbBuU][fFtT])(\"\"\"|'{3}|\"|'))|(\#[^\n]*+)|\w++)?", re.S)

_JS_CODE = re.compile(
    r"(?P<run>[^/\"'`()\[\]{}<]++)?+(?:(?P<comment>//[^\n]*+|/\*.*?(?:\*/|\Z))"
    r"|(?P<string>\"(?:[^\"\\\n]++|\\.)*+\"?|'(?:[^'\\\n]++|\\.)*+'?)|(?P<one>.))?", re.S)
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\n\[]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+")
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\.|\$(?!\{))++", re.S)
_TAG_START = re.compile(r"<(?:(?=>)|[A-Za-z_$][\w$.:-]*+(?!\s*,|\s+extends\b))")
_TAG = re.compile(r"\"[^\"]*+\"?|'[^']*+'?|/\*.*?(?:\*/|\Z)|/(?!>)|[^\"'{/>]++", re.S)
_TAG_TEXT = re.compile(r"[^<{]++")
_CLOSING_TAG = re.compile(r"</[^>]*+>?")
# Words after which a slash starts a regex literal and < a tag.
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new",
                 "else", "do", "instanceof", "yield", "await", "default"}
_HEADS = {"if", "while", "for", "with"}
_LAST_WORD = re.compile(r"[\w$]++\Z")


def _hidden(text: str) -> str:
    if "\n" not in text:
        return INSIDE * len(text)
    return "\n".join(INSIDE * len(part) for part in text.split("\n"))


def _blank(text: str) -> str:
    if "\n" not in text:
        return " " * len(text)
    return "\n".join(" " * len(part) for part in text.split("\n"))


class _Scan:
    """The masked pieces so far, the open brackets, and the modes that the scan is in."""

    def __init__(self, text: str):
        self.text, self.at, self.done, self.pieces = text, 0, 0, []
        self.brackets, self.pairs, self.lost, self.modes = [], [], [], []

    def keep(self, end: int):
        self.at = end

    def put(self, piece: str, end: int):
        """``piece`` in place of the text up to ``end``; what was kept before goes first."""
        if self.done < self.at:
            self.pieces.append(self.text[self.done:self.at])
        self.pieces.append(piece)
        self.at = self.done = end

    def hide(self, end: int, first: bool = False):
        part = _hidden(self.text[self.at:end])
        self.put(OPEN + part[1:] if first else part, end)

    def match(self, pattern: re.Pattern):
        return pattern.match(self.text, self.at)

    def floor(self) -> int:
        """Brackets below it belong to the code around the current string or tag."""
        return self.modes[-1][1] if self.modes else 0

    def open(self, char: str, about=None):
        self.brackets.append((char, self.at, about))

    def close(self, char: str):
        """The bracket that this one closes; ones between were never closed."""
        floor = self.floor()
        if len(self.brackets) > floor and self.brackets[-1][0] == _PARTNER[char]:
            found = self.brackets.pop()
            self.pairs.append((found[1], self.at))
            return found
        for i in range(len(self.brackets) - 1, floor - 1, -1):
            if self.brackets[i][0] == _PARTNER[char]:
                found = self.brackets[i]
                self.lost += [b[1] for b in self.brackets[i + 1:]]
                del self.brackets[i:]
                self.pairs.append((found[1], self.at))
                return found
            if i < len(self.brackets) - 64:   # a far partner is none: stay linear
                break
        self.lost.append(self.at)
        return None

    def masked(self, flat: bool = False) -> str:
        """The text with its marks; ``flat``: pairs within pairs get marks too."""
        self.lost += [b[1] for b in self.brackets]
        end = -1
        for pair in sorted(self.pairs) if flat else ():
            if pair[0] < end:
                self.lost += pair
            else:
                end = pair[1]
        out = "".join([*self.pieces, self.text[self.done:]])
        marked, at = [], 0
        for i in sorted(self.lost):
            marked += out[at:i], LOST_CALL if out[i] == "(" else LOST
            at = i + 1
        return "".join([*marked, out[at:]]) if marked else out


def scan_python(text: str) -> str:
    """The masked form of a Python text."""
    s, end = _Scan(text), len(text)
    while s.at < end:
        if not s.modes:
            m = s.match(_PY_PLAIN)
            kind, s.at = m.lastindex, m.end()
            if kind == 1:
                s.at -= 1
                s.open(text[s.at])
                s.at += 1
            elif kind == 2:
                s.at -= 1
                s.close(text[s.at])
                s.at += 1
            elif kind:
                s.at = m.start(kind)
                if kind == 6:
                    s.put(_blank(m.group(6)), m.end())
                else:
                    s.hide(m.end(), first=True)
                if kind == 4:
                    s.modes.append((m.group(5), len(s.brackets), True, False))
            continue
        # A mode is (quote of the f-string, bracket floor, in its literal part, in a format).
        quote, floor, literal, spec = s.modes[-1]
        if literal:
            m = s.match(_SPEC if spec else _PY_TEXT[quote])
            if m:
                s.hide(m.end())
            elif not spec and text.startswith(quote, s.at):
                s.hide(s.at + len(quote))
                s.modes.pop()
            elif text[s.at] == "{":
                s.hide(s.at + 1)
                s.modes.append((quote, len(s.brackets), False, False))
            elif text[s.at] == "}" and spec:
                s.hide(s.at + 1)
                s.modes.pop()
            elif text[s.at] == "\n" and len(quote) == 1:   # never closed
                while s.modes and s.modes[-1][2]:
                    s.modes.pop()
            else:
                s.hide(s.at + 1)
            continue
        m = s.match(_PY_CODE)
        kind = m.lastgroup if m.lastgroup != "quote" else "string"
        if kind == "comment":
            s.put(_blank(m.group()), m.end())
        elif kind == "string":
            mark = m.group("quote")
            if re.search("[fFtT]", m.group()):
                s.hide(m.end(), first=True)
                s.modes.append((mark, len(s.brackets), True, False))
            else:
                s.hide(_PY_BODY[mark].match(text, m.end()).end(), first=True)
        elif m.group() in ("(", "[", "{"):
            s.open(m.group())
            s.keep(m.end())
        elif m.group() == "}" and len(s.brackets) == floor:
            s.hide(m.end())
            s.modes.pop()
        elif m.group() in _PARTNER:
            s.close(m.group())
            s.keep(m.end())
        elif m.group() == ":" and len(s.brackets) == floor:
            s.hide(m.end())
            s.modes[-1] = (quote, floor, True, True)
        else:
            s.keep(m.end())
    return s.masked(flat=True)


def _value_next(s: _Scan, last: int, closed) -> bool:
    """Whether a value can start here: after an operator, not after a value."""
    if not last:
        return True
    char = s.text[last - 1]
    if char == ")":
        return bool(closed)
    if char.isalnum() or char in "_$":
        return _LAST_WORD.search(s.text, max(0, last - 24), last).group() in _BEFORE_VALUE
    return char not in "]\"'`" and s.text[last - 2:last] not in ("++", "--")


def scan_js(text: str, tags: bool) -> str:
    """The masked form of a JavaScript or TypeScript text; ``tags``: with JSX."""
    s, end = _Scan(text), len(text)
    last, closed, value = 0, False, -1   # end of the last token; what ")" closed; end of a value
    while s.at < end:
        mode = s.modes[-1][0] if s.modes else "code"
        char = text[s.at]
        if mode == "template":
            m = s.match(_TEMPLATE)
            if m:
                s.hide(m.end())
            elif char == "`":
                s.hide(s.at + 1)
                s.modes.pop()
                last = value = s.at
            elif text.startswith("${", s.at):
                s.hide(s.at + 2)
                s.modes.append(("hole", len(s.brackets)))
                last, value = s.at, -1
            else:
                s.hide(s.at + 1)
        elif mode in ("tag", "children"):
            m = s.match(_TAG if mode == "tag" else _TAG_TEXT)
            if m:
                s.hide(m.end())
            elif char == "{":
                s.open("{")
                s.keep(s.at + 1)
                s.modes.append(("braces", len(s.brackets)))
                last, value = s.at, -1
            elif mode == "tag" and char == ">":
                s.hide(s.at + 1)
                s.modes[-1] = ("children", s.floor())
            elif mode == "tag" or text.startswith("</", s.at):   # /> or a closing tag
                s.hide(s.at + 2 if mode == "tag" else s.match(_CLOSING_TAG).end())
                s.modes.pop()
                last = value = s.at
            else:
                m = s.match(_TAG_START)
                s.hide(m.end() if m else s.at + 1)
                if m:
                    s.modes.append(("tag", len(s.brackets)))
        else:
            m = s.match(_JS_CODE)
            kind = m.lastgroup
            token = m.group(kind)
            if m.start(kind) > s.at or kind == "run":
                bare = m.group("run").rstrip()
                if bare:
                    last = s.at + len(bare)
                s.keep(m.end("run"))
            if kind == "run":
                pass
            elif kind == "comment" and not (token[1] == "/" and text[s.at - 1:s.at] == ":"
                                            and text[s.at - 2:s.at - 1].isalpha()):
                s.put(_blank(token), m.end())
            elif kind == "string":
                if token[0] == "'" and text[s.at - 1:s.at].isalpha() \
                        and text[s.at + 1:s.at + 2].isalpha():   # an apostrophe
                    s.keep(s.at + 1)
                else:
                    s.hide(m.end(), first=True)
                    last = value = s.at
            elif token == "`":
                s.hide(m.end(), first=True)
                s.modes.append(("template", len(s.brackets)))
            elif token in ("(", "[", "{"):
                word = token == "(" and _LAST_WORD.search(text, max(0, last - 12), last)
                s.open(token, bool(word) and word.group() in _HEADS)
                s.keep(m.end())
                last = s.at
            elif token == "}" and s.modes and len(s.brackets) == s.floor():
                if s.modes.pop()[0] == "hole":
                    s.hide(m.end())
                else:
                    s.close("}")
                    s.keep(m.end())
            elif token in _PARTNER:
                found = s.close(token)
                closed = found[2] if found else False
                s.keep(m.end())
                last = s.at
            else:   # a slash or an angle: what it is depends on what was before
                starts = last != value and _value_next(s, last, closed)
                regex = s.match(_REGEX) if starts and token == "/" else None
                tag = s.match(_TAG_START) if starts and tags and token == "<" else None
                if regex:
                    s.hide(regex.end(), first=True)
                    last = value = s.at
                elif tag:
                    s.hide(tag.end(), first=True)
                    s.modes.append(("tag", len(s.brackets)))
                else:
                    s.keep(s.at + len(token) if kind != "comment" else s.at + 2)
                    last = s.at
    if tags and any(m[0] in ("tag", "children") for m in s.modes):
        return scan_js(text, False)   # an angle that was no tag
    return s.masked()


# Texts are taken from a batch in parts of so many rows, so that a task does not hold the
# Python strings of a whole batch beside its columns.
_ROWS = 128


@F.arrow_udf(T.StringType())
def _mask(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, langs in batches:
        parts = []
        for at in range(0, len(texts), _ROWS):
            parts.append(pa.array([
                None if text is None else scan_python(text) if lang == "python"
                else scan_js(text, tags=lang != "typescript") for text, lang in zip(
                    texts.slice(at, _ROWS).to_pylist(), langs.slice(at, _ROWS).to_pylist())],
                pa.string()))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def mask(text="text", lang="lang") -> Column:
    """The masked text of a source in ``lang``; JSX is looked for but in typescript."""
    return _mask(text, lang)

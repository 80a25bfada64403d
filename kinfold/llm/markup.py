"""Running text of scientific articles in typesetting markup."""

from __future__ import annotations

import re

_COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%[^\n]*\n?[ \t]*")
_PLAIN_COMMENT = re.compile(r"%(?<!\\%)[^\n]*\n?[ \t]*")  # the same, far faster, where no two backslashes precede a "%"
_OFF = re.compile(r"\\iffalse(?![A-Za-z]).*?(?:\\fi(?![A-Za-z])|\Z)|\\begin\s*\{comment\}.*?(?:\\end\s*\{comment\}|\Z)", re.S)
_END = re.compile(r"\\end\s*\{document\}|\\bye(?![A-Za-z])|\\endinput(?![A-Za-z])")
_BEGIN = re.compile(r"\\begin\s*\{document\}")
_BIB = re.compile(r"\\begin\s*\{thebibliography\}.*?(?:\\end\s*\{thebibliography\}|\Z)", re.S)
_DEF = re.compile(
    r"(?:\\(?:re)?newcommand\*?\s*\{?\s*\\([A-Za-z]+)\s*\}?\s*((?:\[[^\]]*\])*)|\\providecommand\*?\s*\{?\s*\\([A-Za-z]+)\s*\}?\s*((?:\[[^\]]*\])*)"
    r"|\\(?:g|e|x)?def\s*\\([A-Za-z]+)\s*((?:#\d)*)|\\DeclareMathOperator\*?\s*\{\s*\\([A-Za-z]+)\s*\}())\s*\{"
)
#: Every alternative begins with a plain character, which the search then skips to.
_MATH = re.compile(
    r"\$\$.*?(?:\$\$|\Z)|\$(?<!\\\$)[^$]*(?:\$|\Z)|\\\[.*?(?:\\\]|\Z)|\\\(.*?(?:\\\)|\Z)"
    r"|\\begin\s*\{(equation|align|gather|multline|eqnarray|displaymath|math|tabular|array)(\*?)\}.*?(?:\\end\s*\{\1\2\}|\Z)",
    re.S,
)
_DROP = re.compile(
    r"\\(?:cite[a-z]*|ref|eqref|pageref|label|author|affiliation|date|thanks|email|input|include|bibliography|bibliographystyle|usepackage|documentclass|includegraphics"
    r"|graphicspath|vspace|hspace|begin|end|magnification|hypersetup|setlength|newtheorem|bibitem)\*?\s*(?:\[[^\]]*\]\s*)*\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*(?:\}(?:\{[^{}]*\})?|\Z)"
)
_PLAIN = re.compile(r"\\(?:input|magnification)[^\n{]*")
_WORD = re.compile(r"[^\W\d_]++(?:['’\-][^\W\d_]++)*+")
_ASCII_WORD = re.compile(r"[a-z]++(?:['\-][a-z]++)*+")
_ACCENT = re.compile(
    r"\\([\"'`^~=.]|[cvuHk](?![A-Za-z]))\s*(?:\{\s*(\\?[A-Za-z])\s*\}|(\\?[A-Za-z]))|\\([lLoOij]|ss|ae|AE|oe|OE|aa|AA)(?![A-Za-z])\s?(?:\{\})?"
)
#: What accent commands stand for.
_MARK = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328"}
_LETTER = {"l": "ł", "L": "Ł", "o": "ø", "O": "Ø", "i": "i", "j": "j", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å"}
_DOUBLE = re.compile("[\u00c2-\u00c3][\u0080-\u00bf]")
_MACRO = re.compile(r"\\([A-Za-z]+)(?:\s*\{\}|\\(?=\s))?")
_MARKUP = re.compile(r"\\(?:[A-Za-z]+\*?|.)|\{|\}")
_STOP = re.compile(r"[.!?;:\n](?:(?<!\n)(?=\s|$)|(?<=\n)\s*\n)")


def _group(text: str, at: int) -> int:
    """The place after the brace group that opens at ``at``; the end if it never closes."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, at):
        c = m.group()
        depth += (c == "{") - (c == "}")
        if not depth and len(c) == 1:
            return m.end()
    return len(text)


def _accent(m: re.Match) -> str:
    import unicodedata

    if m.group(4):
        return _LETTER[m.group(4)]
    return unicodedata.normalize("NFC", (m.group(2) or m.group(3)).lstrip("\\") + _MARK[m.group(1)])


def _repair(m: re.Match) -> str:
    return m.group().encode("latin-1").decode("utf-8", "replace")


def _definitions(text: str) -> tuple[str, dict[str, str]]:
    """The text without macro definitions, and the macros without arguments."""
    macros, out, at = {}, [], 0
    while m := _DEF.search(text, at):
        end = _group(text, m.end() - 1)
        name = m.group(1) or m.group(3) or m.group(5) or m.group(7)
        if not (m.group(2) or m.group(4) or m.group(6)) and not m.group(7):
            macros[name] = text[m.end() : end - 1].replace("\\xspace", "")
        out.append(text[at : m.start()])
        at = end
    out.append(text[at:])
    return "".join(out), macros


def running_text(text: str | None) -> str:
    """What is typeset as title, abstract, sections and captions, one sentence per line.

    Left out: preamble, comments of any kind, bibliography, text after the end, authors,
    formulas, tables, references and markup. Macros without arguments are read as what
    they stand for. A null text, or one that is all markup, gives an empty string; a
    truncated file is read as far as it goes.
    """
    if not text:
        return ""
    t = text.replace("\r\n", "\n").replace("\r", "\n").replace("\ufeff", "")
    if "\u00c3" in t or "\u00c2" in t:
        t = _DOUBLE.sub(_repair, t)
    t = _OFF.sub(" ", _COMMENT.sub(r"\1", t) if "\\\\%" in t else _PLAIN_COMMENT.sub("", t))
    if m := _END.search(t):
        t = t[: m.start()]
    t, macros = _definitions(t)
    if m := _BEGIN.search(t):
        head, t = t[: m.start()], t[m.end() :]
        if (i := head.find("\\title")) >= 0 and (j := head.find("{", i)) >= 0:
            t = head[j : _group(head, j)] + ".\n\n" + t
    t = _BIB.sub(" ", t)
    used = True
    spell = lambda m: m.group() if (x := macros.get(m.group(1))) is None else x
    for _ in range(4):
        if not macros or "\\" not in t or not used:
            break
        used = any(x in macros for x in _MACRO.findall(t))
        t = _MACRO.sub(spell, t) if used else t
    t = _MATH.sub(" ", t)
    t = _PLAIN.sub(" ", _DROP.sub(" ", t))
    t = _ACCENT.sub(_accent, t)
    t = re.sub(r"\\(?:title|(?:sub)*section|chapter|paragraph|caption|centerline)\*?\s*(?:\[[^\]]*\])?\s*\{", "\n\n{", t)
    t = re.sub(r"\\beginsection\s", "\n\n", t).replace("\\par", "\n\n")
    t = _MARKUP.sub(" ", t.replace("\\-", "")).replace("~", " ")
    t = t.replace("\u00ad", "").replace("\u200b", "")
    return "\n".join(s for s in (" ".join(x.split()) for x in _STOP.split(t)) if s)


def words(sentence: str) -> list[str]:
    s = sentence.lower()
    return (_ASCII_WORD if s.isascii() else _WORD).findall(s)

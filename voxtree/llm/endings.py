"""How a text ends, judged by its own grammar.

``ending`` says one of
  open   it stops inside a bracket, string, comment, tag or statement,
  word   it stops in a word, with nothing to tell whether the word goes on,
  line   its last line is prose without an end of sentence,
  ends   it stops where such texts end.
The kind of text is told from its content, since names and labels are often wrong, and from the whole of
it, since a long comment may stand before the first line that tells. The patterns for that take a time in
proportion to the text.
"""

from __future__ import annotations

import re

_M, _S, _I = re.MULTILINE, re.DOTALL, re.IGNORECASE
_HTML = re.compile(r"\s*<(?:!doctype|!--|\?xml|[a-z][a-z0-9]*[\s>/])", _I)
_JSON = re.compile(r'\s*[\[{]\s*["{\[\]}]')
_SHELL = re.compile(r'^#!.*sh\b|^[^\S\n]*(?:local \w+=|fi$|done$|esac$|echo ")', _M)
_PYTHON = re.compile(r"^[^\S\n]*(?:(?:async )?def \w+\(.*|class \w+.*):[ \t\r]*$|^from [\w.]+ import |^import [\w.]+[ \t\r]*$", _M)
_SEMICOLON = re.compile(r";[ \t\r]*$", _M)
_STYLE = re.compile(r"^[.#]?[\w-]+(?:\{|\s*\{\s*$)|\}\.[\w-]+\{")
_BETWEEN = re.compile(r"[^;{}]+;?")
_PROPERTY = re.compile(r"[\w-]:[^;]")
_SCRIPT = re.compile(r"function|=>|\bvar\b")
_BLOCK = re.compile(r"[;{}][ \t\r]*$", _M)
_KEY = re.compile(r"[ \t]*(?:- )?[\w-]+:(?: \S.*)?\r?\Z|[ \t]*- \S+\r?\Z")
_TUPLES = re.compile(r"^[^\S\n]*[(\[{].*[)\]}],[ \t\r]*$", _M)
_CODE_INERT = re.compile(r'"(?:[^"\\\n]|\\.)*+"|`(?:[^`\\]|\\.)*+`|\'(?:[^\'\\\n]|\\.)*+\'|//[^\n]*+|/\*.*?\*/', _S)
_PY_INERT = re.compile(r'"""(?:.*?)"""|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|#[^\n]*+', _S)
_SH_INERT = re.compile(r"\"(?:[^\"\\]|\\.)*+\"|'[^']*+'|(?:^|(?<=\s))#[^\n]*+")
_SH_WORD = re.compile(r"(?<![\w-])(?:if|fi|case|esac|do|done)(?![\w-])|[{}]")
_SENTENCE_END = re.compile(r"[.!?:;)\]>\"'`*|}/。！？-]\s*\Z")
_PREPROCESSOR = re.compile(r'\s*#\s*(?:include\s*[<"].*[>"]|define\s+\w+.*|endif.*|else|pragma.*|if.*|undef.*)\Z')
_DECLARED = re.compile(r"""\s*(?:const|let|var|import|use|package|type|export|using|from|require)\b.*[\w"')\]]\Z""")
_PY_GOES_ON = re.compile(r"(?:[:,=+\-*/.\\<>(]|\b(?:in|and|or|not|for|if|is|lambda|import|from|return not))\Z")
_PY_HEADER = re.compile(r"\s*(?:def|class|for|while|if|with|elif)\b")
_PY_ALONE = re.compile(r"\s*\w+\Z")
_PY_KEYWORD = re.compile(r"\s*(?:return|pass|break|continue|else|try|finally|raise|yield)\b")
_YAML_NOTE = re.compile(r"\s*(?:-\s*)?[\w-]+:\s+(\S+(?:\s+\S+)+)\Z")
_SOURCED = re.compile(r"\s*(?:\.|source)\s+\S+\.\w+\Z")
_NAME = re.compile(r"\w\Z")


def kind_of(text: str) -> str:
    """code, minified, css, json, python, tuples, shell, html, yaml or prose."""
    if _HTML.match(text):
        return "html"
    if _JSON.match(text):
        return "json"
    if _SHELL.search(text):
        return "shell"
    # a statement of another language in a string or comment doesn't outweigh the lines of Python
    if (python := len(_PYTHON.findall(text))) and python > len(_SEMICOLON.findall(text)):
        return "python"
    if _STYLE.search(text) and any(b.endswith(";") and _PROPERTY.search(b) for b in _BETWEEN.findall(text)) and not _SCRIPT.search(text):
        return "css"
    if _BLOCK.search(text) and re.search(r"[{;(]", text):
        return "code"
    last = text[text.rfind("\n") + 1 :]
    if len(last) > 150 and re.search(r"[;})]\(?[\w$]", last):
        return "minified"
    if _TUPLES.search(text):
        return "tuples"
    lines = [ln for ln in text.split("\n")[:-1] if ln.strip() and not ln.lstrip().startswith("#")]
    if lines and sum(1 for ln in lines if _KEY.match(ln)) > 0.8 * len(lines):
        return "yaml"
    return "prose"


def _depth(bare: str) -> int:
    return sum(map(bare.count, "([{")) - sum(map(bare.count, ")]}"))


def _sentence(text: str) -> str:
    return "ends" if _SENTENCE_END.search(text) or not text.strip() else "line"


def ending(body: str) -> str:
    """The verdict on a text without what follows its last word."""
    kind = kind_of(body)
    last = body[body.rfind("\n") + 1 :].rstrip("\r")
    if kind in ("code", "minified", "css", "json"):
        bare = _CODE_INERT.sub(" ", body)
        tail = bare[bare.rfind("\n") + 1 :].rstrip()
        if _depth(bare) > 0 or tail.count('"') % 2 or tail.count("`") % 2 or "/*" in bare[bare.rfind("*/") + 1 :]:
            return "open"
        if kind == "json":
            return "ends" if tail.endswith(("}", "]")) else "open"
        if last.lstrip().startswith("//"):
            return "ends" if _SENTENCE_END.search(last.lstrip()[2:]) or not last.strip(" \t/") else "open"
        if not tail or tail.endswith(("}", ";", ")", "]", ">")):
            return "ends"
        if _PREPROCESSOR.match(last):
            return "word" if _NAME.search(last) else "ends"
        if _DECLARED.match(last) and (not _SEMICOLON.search(body) or kind != "code"):
            return "word"
        return "open"
    if kind in ("python", "tuples"):
        bare = _PY_INERT.sub(" ", body)
        tail = bare[bare.rfind("\n") + 1 :].rstrip()
        if _depth(bare) > 0 or tail.count('"') % 2 or tail.count("'") % 2 or bare.count('"""') % 2:
            return "open"
        if last.lstrip().startswith("#"):
            return "ends" if _SENTENCE_END.search(last) else "open"
        if _PY_GOES_ON.search(tail) or _PY_HEADER.match(tail) or (_PY_ALONE.match(tail) and not _PY_KEYWORD.match(tail)):
            return "open"
        return "word" if _NAME.search(tail) else "ends"
    if kind == "shell":
        bare = _SH_INERT.sub(" ", body)
        n = {}
        for w in _SH_WORD.findall(bare):
            n[w] = n.get(w, 0) + 1
        if any(n.get(a, 0) > n.get(b, 0) for a, b in (("{", "}"), ("if", "fi"), ("case", "esac"), ("do", "done"))):
            return "open"
        tail = bare[bare.rfind("\n") + 1 :]
        if '"' in tail or "'" in tail:
            return "open"
        if last.lstrip().startswith("#"):
            return "ends" if _SENTENCE_END.search(last) else "open"
        return "word" if _NAME.search(tail) and not _SOURCED.match(tail) else "ends"
    if kind == "html":
        after = body[body.rfind(">") + 1 :]
        return "open" if "<" in after or re.search(r"\w", after) else "ends"
    if kind == "yaml":
        if last.lstrip().startswith("#"):
            return "ends" if _SENTENCE_END.search(last) else "open"
        note = _YAML_NOTE.match(last)
        if note:
            return "ends" if _SENTENCE_END.search(note[1]) else "open"
        if ":" not in last and not last.lstrip().startswith("-"):
            return "open"
        return "word" if _NAME.search(last) else "ends"
    if _DECLARED.match(last) or last.lstrip().lower().startswith(("#", "=", "http", "copyright", "©")):
        return "word" if _NAME.search(last) else "ends"
    return _sentence(last)

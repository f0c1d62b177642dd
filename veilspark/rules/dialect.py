"""Rewrite ECMAScript (unicode mode) patterns into ``java.util.regex``.

Spark evaluates regular expressions with ``java.util.regex``; rule authors
write them in ECMAScript syntax.  The two disagree on a handful of constructs
(``\\b``, ``\\s``, ``.``, ``$``, brackets inside classes, property names).  The
rewriting happens once, on the driver, while a rule set is compiled.
"""

from __future__ import annotations

from functools import lru_cache

import regex as _regex

# ECMAScript white space plus line terminators.
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_CATEGORIES = {
    "Letter": "L", "Uppercase_Letter": "Lu", "Lowercase_Letter": "Ll",
    "Titlecase_Letter": "Lt", "Modifier_Letter": "Lm", "Other_Letter": "Lo",
    "Mark": "M", "Number": "N", "Decimal_Number": "Nd", "Punctuation": "P",
    "Symbol": "S", "Currency_Symbol": "Sc", "Separator": "Z", "Other": "C",
}
_WORD_EDGE_BEFORE = r"(?<![\p{L}\p{N}_])"
_WORD_EDGE_AFTER = r"(?![\p{L}\p{N}_])"


class RuleError(ValueError):
    """A rule set that cannot be used; ``errors`` lists every problem found."""

    def __init__(self, errors):
        self.errors = [errors] if isinstance(errors, str) else list(errors)
        super().__init__("; ".join(self.errors))


class _Rewriter:
    def __init__(self, source: str):
        self.src, self.pos = source, 0

    def peek(self, text: str) -> bool:
        return self.src.startswith(text, self.pos)

    def fail(self, why: str):
        raise ValueError(why)

    def escape(self, in_class: bool) -> str:
        """Translate the escape at the cursor (which sits on the backslash)."""
        if self.pos + 1 >= len(self.src):
            self.fail("\\ at end of pattern")
        ch = self.src[self.pos + 1]
        self.pos += 2
        if ch == "b":
            return r"\x08" if in_class else _BOUNDARY
        if ch == "B" and not in_class:
            return _NO_BOUNDARY
        if ch == "s":
            return JS_SPACE if in_class else f"[{JS_SPACE}]"
        if ch == "S":
            return f"[^{JS_SPACE}]"
        if ch == "v":
            return r"\x0B"
        if ch == "0":
            return r"\x00"
        if ch in "pP":
            return self.property(ch)
        if ch == "u" and self.peek("{"):
            end = self.src.find("}", self.pos)
            if end < 0:
                self.fail("invalid unicode escape")
            code = int(self.src[self.pos + 1:end], 16)
            self.pos = end + 1
            return "\\u%04X" % code if code < 0x10000 else chr(code)
        if ch == "k" and self.peek("<"):
            end = self.src.find(">", self.pos)
            name = self.src[self.pos + 1:end]
            self.pos = end + 1
            return f"\\k<{_group_name(name)}>"
        if ch == "c" or ch.isalnum():
            return "\\" + ch
        return "\\" + ch if ord(ch) < 128 else ch

    def property(self, letter: str) -> str:
        end = self.src.find("}", self.pos)
        if not self.peek("{") or end < 0:
            self.fail("invalid property name")
        name = self.src[self.pos + 1:end]
        self.pos = end + 1
        if "=" not in name:
            name = _CATEGORIES.get(name, name)
            if len(name) > 2:
                name = "Is" + name
        return "\\%s{%s}" % (letter, name)

    def char_class(self) -> str:
        self.pos += 1
        negated = self.peek("^")
        if negated:
            self.pos += 1
        if self.peek("]"):
            self.pos += 1
            return r"[\s\S]" if negated else "(?!)"
        out, non_space = [], False
        while True:
            if self.pos >= len(self.src):
                self.fail("unterminated character class")
            ch = self.src[self.pos]
            if ch == "]":
                self.pos += 1
                break
            if ch == "\\":
                piece = self.escape(in_class=True)
                non_space = non_space or piece == f"[^{JS_SPACE}]"
                out.append(piece)
                continue
            out.append("\\" + ch if ch in "[&~^" else ch)
            self.pos += 1
        body = "".join(out)
        if negated and non_space:
            # Java resolves a nested negation inside [^...] differently.
            return f"(?:(?![{body}])[\\s\\S])"
        return f"[{'^' if negated else ''}{body}]"

    def group(self) -> str:
        for opener in ("(?:", "(?=", "(?!", "(?<=", "(?<!"):
            if self.peek(opener):
                self.pos += len(opener)
                return opener
        if self.peek("(?<"):
            end = self.src.find(">", self.pos)
            if end < 0:
                self.fail("invalid group name")
            name = self.src[self.pos + 3:end]
            self.pos = end + 1
            return f"(?<{_group_name(name)}>"
        if self.peek("(?"):
            self.fail("invalid group")
        self.pos += 1
        return "("

    def brace(self) -> str:
        found = _regex.match(r"\{\d+(?:,\d*)?\}", self.src[self.pos:])
        if not found:
            self.pos += 1
            return r"\{"
        self.pos += found.end()
        return found.group()

    def run(self) -> str:
        out, quantified = [], False
        while self.pos < len(self.src):
            ch = self.src[self.pos]
            was_quantified, quantified = quantified, False
            if ch == "\\":
                out.append(self.escape(in_class=False))
            elif ch == "[":
                out.append(self.char_class())
            elif ch == "(":
                out.append(self.group())
            elif ch in "*+?{":
                piece = self.brace() if ch == "{" else ch
                if ch != "{":
                    self.pos += 1
                literal = piece == r"\{"
                if was_quantified and ch != "?" and not literal:
                    self.fail("nothing to repeat")
                # A "?" after a quantifier only makes it lazy.
                quantified = not literal and not (was_quantified and ch == "?")
                out.append(piece)
            else:
                self.pos += 1
                out.append({".": r"[^\n\r\u2028\u2029]", "$": r"\z", "^": r"\A"}.get(ch, ch))
        return "".join(out)


def _group_name(name: str) -> str:
    return "g" + "".join(c if c.isascii() and c.isalnum() else "x%xx" % ord(c) for c in name)


def to_java(pattern: str, rule_id: str) -> str:
    """Java equivalent of ``pattern``; a bad pattern is reported by rule id."""
    try:
        java = _Rewriter(pattern).run()
        _regex.compile(java.replace(r"\z", r"\Z"))
        return java
    except (ValueError, _regex.error) as err:
        raise RuleError(f'Rule "{rule_id}": invalid regular expression — {err}') from None


@lru_cache(maxsize=1)
def _fold_table() -> dict[str, str]:
    """Simple case folding: folded character -> every character folding to it."""
    table: dict[str, str] = {}
    for code in range(0x1E944):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        if ch in "İı":
            continue
        folded = _simple_fold(ch)
        if folded != ch:
            table[folded] = table.get(folded, folded) + ch
    return table


def _simple_fold(ch: str) -> str:
    for form in (ch.casefold(), ch.lower()):
        if len(form) == 1:
            return form
    return ch


_CLASS_SPECIAL = set("\\[]^-&~")
_LITERAL_SPECIAL = set(".*+?^${}()|[]\\")


def word_pattern(word: str) -> str:
    """Case-insensitive literal on letter/number/underscore edges.

    Case folding is spelled out as character classes rather than switched on by
    a flag, because Java's flag also equates the dotted and dotless i.
    """
    out = []
    for ch in word.strip():
        same = _fold_table().get(_simple_fold(ch))
        if same is None:
            out.append("\\" + ch if ch in _LITERAL_SPECIAL else ch)
        else:
            out.append("[" + "".join("\\" + c if c in _CLASS_SPECIAL else c for c in same) + "]")
    # The first character is asked for before the edge: most positions are left after one comparison.
    lead = f"(?={out[0]})" if out else ""
    return lead + _WORD_EDGE_BEFORE + "".join(out) + _WORD_EDGE_AFTER

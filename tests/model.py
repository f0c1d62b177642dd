"""A plain-Python restatement of scanning and placeholders, for differential tests.

Works on the rule document itself (no compiled patterns, no prefilters), with
the `regex` module and straightforward loops.
"""

import base64
import json

import regex

WS = "\\t\\n\\x0b\\x0c\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
WORD = "[A-Za-z0-9_]"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
ACTIONS, SEVERITIES = ["warn", "anonymize", "block"], ["low", "medium", "high", "critical"]


def pattern(source):
    out, in_class, i = "", False, 0
    while i < len(source):
        ch = source[i]
        pair = source[i:i + 2]
        if pair == "\\b":
            out += EDGE
        elif pair == "\\s":
            out += WS if in_class else f"[{WS}]"
        elif pair == "\\S":
            out += f"[^{WS}]"
        elif pair == "\\d":
            out += "0-9" if in_class else "[0-9]"
        elif ch == "\\":
            out += pair
        else:
            in_class = ch == "[" or (in_class and ch != "]")
            out += "\\[" if ch == "[" and out.endswith("[") else ch
            i += 1
            continue
        i += 2
    return regex.compile(out, regex.V0)


def word(text):
    body = "".join(f"[{regex.escape(c)}]" if not c.isalpha() else "[" + "".join(sorted({c.lower(), c.upper()} | (
        {"ſ"} if c in "sS" else {chr(0x212A)} if c in "kK" else set()))) + "]" for c in text.strip())
    return regex.compile(r"(?<![\p{L}\p{N}_])" + body + r"(?![\p{L}\p{N}_])")


def hits(rx, text):
    return [(m.start(), m.end()) for m in rx.finditer(text) if m.end() > m.start()]


def luhn(v):
    digits = [int(c) for c in v if c.isdigit()]
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return len(digits) > 1 and total % 10 == 0


def ipv4(v):
    parts = v.split(".")
    return len(parts) == 4 and all(p.isdigit() and str(int(p)) == p and int(p) < 256 for p in parts)


def jwt(v):
    head = v.split(".")[0].replace("-", "+").replace("_", "/")
    try:
        return "alg" in json.loads(base64.b64decode(head + "=" * (-len(head) % 4)))
    except Exception:
        return False


BUILTINS = [("builtin-card", "CARD", "critical", r"\b(?:\d{4}[\s-]?){3}\d{4}\b", luhn),
            ("builtin-jwt", "JWT", "critical", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", jwt),
            ("builtin-ip", "IP", "low", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", ipv4)]


class Model:
    def __init__(self, doc, builtins=True):
        self.white = [word(w) for w in doc.get("whitelist") or []]
        self.matchers = []
        if builtins:
            for rid, label, severity, source, check in BUILTINS:
                self.matchers.append((rid, "anonymize", severity, label, [[pattern(source)]], check))
        black, defaults = doc.get("blacklist") or {}, doc.get("defaults") or {}
        if black.get("values"):
            self.matchers.append(("blacklist", black.get("action") or defaults.get("action") or "block",
                                  black.get("severity") or defaults.get("severity") or "critical", "BLACKLIST",
                                  [[word(w) for w in black["values"]]], None))
        for rule in doc.get("rules") or []:
            if rule.get("enabled") is False:
                continue
            tests = rule["all"] if rule["kind"] == "combination" else [rule]
            label = regex.sub(r"[^A-Z0-9]+", "_", (rule.get("placeholder") or rule["id"]).upper()).strip("_")
            self.matchers.append((rule["id"], rule.get("action") or defaults.get("action") or "anonymize",
                                  rule.get("severity") or defaults.get("severity") or "medium", label or "INFO",
                                  [[word(w) for w in t["words"]] if t["kind"] == "words" else [pattern(t["pattern"])]
                                   for t in tests], None))

    def findings(self, text):
        white = [h for rx in self.white for h in hits(rx, text)]
        candidates = []
        for priority, (rid, action, severity, label, conditions, check) in enumerate(self.matchers):
            found = [[h for rx in group for h in hits(rx, text) if check is None or check(text[h[0]:h[1]])]
                     for group in conditions]
            if all(found):
                candidates += [(a, a - b, priority) for group in found for a, b in group]
        kept = [c for c in candidates if not any(c[0] < b and a < c[0] - c[1] for a, b in white)]
        out, last = [], -1
        for start, minus, priority in sorted(set(kept)):
            if start >= last:
                last = start - minus
                rid, action, severity, label = self.matchers[priority][:4]
                out.append((rid, start, last, text[start:last], action, severity, label if action == "anonymize" else None))
        return out

    @staticmethod
    def decision(findings):
        return max((f[4] for f in findings), key=ACTIONS.index, default=None)


def fnv6(text):
    raw = text.encode("utf-16-be")
    h = 0x811C9DC5
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i:i + 2], "big")) * 0x01000193) % 2 ** 32
    return f"{h:08x}"[:6]

import pytest
import regex

from veilspark.rules import RuleError, check_document, check_on_spark, compile_rules, default_rules, read_rules
from veilspark.rules.dialect import JS_SPACE, to_java, word_pattern


@pytest.mark.parametrize("source, java", [
    (r"a\sb", f"a[{JS_SPACE}]b"), (r"[\s.]", f"[{JS_SPACE}.]"), (r"[[&~]", r"[\[\&\~]"), ("a.b", "a[^\\n\\r\\u2028\\u2029]b"),
    ("^a$", r"\Aa\z"), (r"\u{1F600}\u{41}", chr(0x1F600) + "\\u0041"), ("(?<an_id>x)", "(?<ganx5fxid>x)"), ("a{2,}", "a{2,}"),
    ("a{x}", r"a\{x}"), (r"[^\S]", f"(?:(?![[^{JS_SPACE}]])[\\s\\S])"), (r"\p{Letter}", r"\p{L}"),
    (r"\p{Alphabetic}", r"\p{IsAlphabetic}"), ("a+?", "a+?"), (r"[\b]", r"[\x08]"), ("[^]", r"[\s\S]"),
])
def test_dialect(source, java):
    assert to_java(source, "r") == java


@pytest.mark.parametrize("source", ["(", "a{2,1}", "[a", "a++", "(?i)a", "\\"])
def test_bad_pattern_names_the_rule(source):
    with pytest.raises(RuleError, match='Rule "broken"'):
        to_java(source, "broken")


def test_word_pattern_folds_like_javascript():
    rx = regex.compile(word_pattern("risk"))
    assert rx.search("a RİSK") is None and rx.search("rıſk") is None
    assert rx.search("a Riſk.") and not rx.search("risks")
    assert regex.compile(word_pattern("a.b*c")).search("x A.B*C y")
    assert regex.compile(word_pattern("élu")).search("ÉLU")


WORDS = {"id": "a", "kind": "words", "words": ["x"]}


@pytest.mark.parametrize("doc, errors", [
    ([], ["document: expected a mapping"]), ({}, ["document: holds neither rules nor a blacklist"]),
    ({"rules": {}}, ["rules: expected a list"]), ({"rules": [3]}, ["rules[0]: expected a mapping"]),
    ({"rules": [{"kind": "words", "words": ["x"]}]}, ["rules[0].id: expected a name"]),
    ({"rules": [{"id": "a", "kind": "magic"}]}, ["rules[0].kind: expected one of words, regex, combination"]),
    ({"rules": [{"id": "a", "kind": "words"}]}, ["rules[0].words: expected at least one string"]),
    ({"rules": [WORDS | {"action": "destroy"}]}, ["rules[0].action: expected one of warn, anonymize, block"]),
    ({"rules": [WORDS] * 2}, ["rules[1].id: 'a' is taken by rules[0]"]),
    ({"rules": [{"id": "a", "kind": "combination", "all": [WORDS]}]}, ["rules[0].all: expected two or more conditions"]),
    ({"rules": [{"id": "a", "kind": "combination", "all": ["x", {"kind": "words"}]}]},
     ["rules[0].all[0]: expected a mapping", "rules[0].all[1].words: expected at least one string"]),
    ({"rules": [{"id": "a", "kind": "combination", "all": [WORDS, {"kind": "combination"}]}]},
     ["rules[0].all[1].kind: expected one of words, regex"]),
    ({"rules": [], "whitelist": "x"}, ["whitelist: expected a list of strings"]),
    ({"blacklist": {}}, ["blacklist.values: expected a list of strings"]), ({"blacklist": []}, ["blacklist: expected a mapping"]),
    ({"rules": [], "version": "1"}, ["version: expected a number"]),
    ({"rules": [], "defaults": {"severity": "x"}}, ["defaults.severity: expected one of low, medium, high, critical"]),
    ({"rules": [{"id": "a", "kind": "regex", "pattern": ""}]}, ["rules[0].pattern: expected a pattern"]),
    ({"rules": [WORDS | {"enabled": "no"}]}, ["rules[0].enabled: expected true or false"]),
    ({"rules": [WORDS | {"placeholder": 3}]}, ["rules[0].placeholder: expected a string"]),
    ({"rules": [WORDS], "version": 7, "defaults": None, "blacklist": {"values": []}}, []),
])
def test_document_errors(doc, errors):
    assert check_document(doc) == errors


def test_text_sources():
    doc = read_rules('rules:\n  - id: p\n    kind: words\n    words: ["Atlas"]\n')
    assert doc["rules"][0]["words"] == ["Atlas"]
    with pytest.raises(RuleError, match="no (YAML|JSON)"):
        read_rules("rules: [unclosed\n")
    with pytest.raises(RuleError):
        read_rules("\n")
    with pytest.raises(RuleError, match="max_bytes"):
        read_rules("#" * (256 * 1024 + 1) + "\n")
    assert read_rules("#" * (256 * 1024) + "\nrules: []\n", max_bytes=None) == {"rules": []}


def test_defaults_labels_and_order():
    rules = compile_rules({
        "defaults": {"action": "block", "severity": "high"}, "blacklist": {"values": ["t"], "action": "warn"},
        "rules": [{"id": "client names", "kind": "words", "words": ["a"], "action": "anonymize"},
                  {"id": "off", "kind": "words", "words": ["b"], "enabled": False},
                  {"id": "é", "kind": "words", "words": ["b"], "severity": "low"}]})
    assert [(m.rule_id, m.action, m.severity, m.placeholder) for m in rules.matchers[3:]] == [
        ("blacklist", "warn", "high", "BLACKLIST"), ("client names", "anonymize", "high", "CLIENT_NAMES"),
        ("é", "block", "low", "INFO")]
    assert [m.rule_id for m in rules.matchers[:3]] == ["builtin-card", "builtin-jwt", "builtin-ip"]


def test_pack_shape(spark):
    rules = default_rules()
    pack = rules.matchers[3:]
    assert rules.version == 7 and len(pack) == 69 and len(rules.whitelist) == 8
    assert [sum(m.kind == k for m in pack) for k in ("regex", "combination", "words")] == [54, 10, 5]
    assert [sum(m.action == a for m in pack) for a in ("anonymize", "block", "warn")] == [43, 19, 7]
    check_on_spark(spark, rules)


def test_check_on_spark_names_bad_rules(spark):
    rules = compile_rules({"rules": [{"id": "endless", "kind": "regex", "pattern": "(?<=(a|bc)*)b"}]})
    with pytest.raises(RuleError, match="endless"):
        check_on_spark(spark, rules)

import json

import pytest
from pyspark.sql import functions as F

from model import fnv6
from veilspark.operators import prompts, vault as vt
from veilspark.rules import compile_rules
from veilspark.session import store
from veilspark.sources.readers import read_requests

M = "messages"
CASES = [  # service, body, prompts, texts a rewrite touches
    ("chatgpt", {M: [{"author": {"role": "user"}, "content": {"parts": ["hello", "world", 3]}},
                     {"author": {"role": "assistant"}, "content": {"parts": ["hi"]}}, {"role": "user", "content": "plain"},
                     {"role": "user", "content": {"parts": "x"}}, 5, None]}, ["hello\nworld\n", "plain"], 2),
    ("claude", {"prompt": "top", M: [{"role": "human", "content": "str"}, {"role": "user", "content": [
        {"type": "text", "text": "a"}, {"text": 4}, {"type": "text", "text": "b"}]}, {"role": "user", "content": []},
        {"role": "assistant", "content": "no"}]}, ["top", "str", "a\nb"], 4),
    ("gemini", {"contents": [{"role": "user", "parts": [{"text": "g1"}, {"data": 1}, {"text": "g2"}]},
                             {"role": "model", "parts": [{"text": "no"}]}, {"role": "user"}]}, ["g1\n\ng2", ""], 2),
    ("copilot", {M: [{"author": "user", "text": "t"}, {"role": "user", "content": "c"}, {"author": "bot", "text": "no"},
                     {"role": "user", "text": 4}]}, ["t", "c", ""], 3),
    ("mistral", {M: [{"role": "user", "content": "m"}, {"role": "user", "content": [{"type": "text", "text": "p"}]},
                     {"role": "assistant", "content": "no"}]}, ["m", "p"], 2),
    ("perplexity", {"query_str": "q1", "query": "q2", M: [{"role": "user", "content": "q3"}, {"role": "human", "content": "no"}]},
     ["q1", "q2", "q3"], 3),
    ("perplexity", {"query_str": 5, "params": {"source": "default"}}, [], 0),
    ("deepseek", {M: [{"role": "user", "content": "d"}]}, ["d"], 1),
    ("grok", {"message": "top", M: [{"role": "user", "message": "gm"}, {"sender": "user", "content": "gc"},
                                    {"role": "assistant", "content": "no"}, {"role": "user"}]}, ["top", "gm", "gc"], 3),
    ("chatgpt", [1, 2], [], 0), ("chatgpt", {M: "x"}, [], 0), ("unknown", {M: []}, [], 0),
]


def frame(spark, cases):
    rows = [(i, s, json.dumps(b, ensure_ascii=False)) for i, (s, b, *_) in enumerate(cases)]
    return read_requests(spark.createDataFrame(rows, "i int, service string, body string"))


def test_extract_and_sites(spark):
    rows = prompts.extract_sites(prompts.extract_prompts(frame(spark, CASES))).orderBy("i").collect()
    for row in rows:
        _, _, want, touched = CASES[row.i]
        assert row.prompts == want and len(row.sites) == touched, CASES[row.i]


def test_bodies_that_are_not_json_objects_are_skipped(spark):
    df = spark.createDataFrame([("chatgpt", b) for b in ("nope", "5", '"x"', "null", "{}", "[]", "")], "service string, body string")
    assert sorted(r.body for r in read_requests(df).collect()) == ["[]", "{}"]


def test_inject(spark):
    marked = prompts.extract_sites(frame(spark, CASES)).withColumn(
        "sites", F.transform("sites", lambda s: F.lit("R"))).drop("json")
    bodies = {r.i: json.loads(r.new_body) for r in prompts.inject_prompts(marked, "sites").collect()}
    assert bodies[0][M][0]["content"]["parts"] == ["R"] and bodies[0][M][1]["content"]["parts"] == ["hi"]
    assert bodies[0][M][2]["content"] == "R" and bodies[0][M][3]["content"] == {"parts": "x"}
    assert bodies[1]["prompt"] == "R" and bodies[1][M][1]["content"] == [{"type": "text", "text": "R"}, {"text": 4}, {"type": "text", "text": "R"}]
    assert bodies[2]["contents"][0]["parts"] == [{"text": "R"}, {"data": 1}, {"text": "R"}]
    assert bodies[3][M][0] == {"author": "user", "text": "R", "content": "R"} and bodies[3][M][2]["text"] == "no"
    assert bodies[5] == {"query_str": "R", "query": "R", M: [{"role": "user", "content": "R"}, {"role": "human", "content": "no"}]}
    assert bodies[8]["message"] == "R" and bodies[8][M][0]["message"] == "R" and bodies[8][M][1]["content"] == "R"
    assert bodies[9] == [1, 2] and bodies[6] == CASES[6][1]


def test_numbers_survive():
    assert prompts.rewrite_body("deepseek", '{"a":1.0,"b":1.5,"messages":[{"role":"user","content":"x"}]}', ["é"]) == \
        '{"a":1,"b":1.5,"messages":[{"role":"user","content":"é"}]}'


@pytest.mark.parametrize("host, service", [
    ("chatgpt.com", "chatgpt"), ("chat.openai.com", "chatgpt"), ("www.perplexity.ai", "perplexity"), ("a.b.x.ai", "grok"),
    ("claude.ai", "claude"), ("notclaude.ai", None), ("unknown.com", None), ("chat.mistral.ai", "mistral"), (None, None)])
def test_route(spark, host, service):
    assert prompts.route(spark.createDataFrame([(host,)], "host string")).first().service == service


def test_endpoints(spark):
    cases = [("chatgpt", "/backend-api/conversation", True), ("chatgpt", "/backend-api/models", False),
             ("claude", "/api/organizations/x/chat_conversations", True), ("claude", "/static/app.js", False),
             ("gemini", "/v1/models/x:streamGenerate", True), ("gemini", "/StreamGenerate?bl=BardChatUi", True), ("gemini", "/v1/other", False),
             ("copilot", "/api/conversation/start", True), ("copilot", "/sydney/UpdateConversation", True), ("copilot", "/c/api/other", False),
             ("mistral", "/api/chat/completions", True), ("mistral", "/api/models", False),
             ("perplexity", "/rest/sse/perplexity_ask", True), ("perplexity", "/API/new_ask", True), ("perplexity", "/api/profile", False),
             ("deepseek", "/api/v0/chat/completion", True), ("deepseek", "/chat/completion", True), ("deepseek", "/api/v0/user", False),
             ("grok", "/rest/app-chat/conversations/new", True), ("grok", "/api/rpc", True), ("grok", "/api/account", False),
             (None, "/conversation", False)]
    df = spark.createDataFrame(cases, "s string, u string, want boolean").withColumn("got", prompts.is_chat_endpoint(F.col("s"), F.col("u")))
    assert [tuple(r) for r in df.where("got <> want").collect()] == []


def test_values_are_located_again_in_every_site(spark):
    rules = compile_rules({"rules": [{"id": "e", "kind": "regex", "placeholder": "E", "pattern": r"\b\w+@x\.com"},
                                     {"id": "w", "kind": "regex", "placeholder": "W", "pattern": r"zed(?=!)"}]})
    body = {M: [{"role": "user", "content": "a@x.com, aa@x.com zed"}, {"role": "user", "content": [{"text": "zed!"}, {"text": "ba@x.com a@x.com"}]}]}
    df = frame(spark, [("mistral", body)]).withColumns({"request_id": F.col("i"), "session": F.lit("s"), "order": F.lit(1)})
    asked = prompts.extract_sites(prompts.extract_prompts(df)).drop("json")
    found = store(prompts.evaluate_prompts(asked, rules), "f")
    vault = store(vt.build_vault(vt.values_to_replace(found, "session", "order"), "k"), "v")
    new = prompts.anonymize_prompts(found, vault, "k").first().new_sites
    p = {v: f"[{label}_{fnv6('k:' + v)}]" for v, label in (("a@x.com", "E"), ("aa@x.com", "E"), ("ba@x.com", "E"), ("zed", "W"))}
    assert new == [f"{p['a@x.com']}, {p['aa@x.com']} {p['zed']}", f"{p['zed']}!", f"{p['ba@x.com']} {p['a@x.com']}"]


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 2, "user", "b"), (1, 0, "human", "a"), (1, 1, "assistant", "x"), (2, 0, "bot", "y")],
                                  "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in prompts.conversation_prompts(turns).collect()] == [(1, ["a", "b"])]
    assert prompts.user_turns(turns).count() == 2

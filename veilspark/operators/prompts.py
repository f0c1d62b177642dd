"""Chat requests: which service, which endpoint, the prompts inside the JSON body,
and writing rewritten prompts back."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from veilspark import dims
from veilspark.functions.placeholders import mint
from veilspark.functions.spans import fold_blocks, let
from veilspark.operators.scan import evaluate
from veilspark.operators.vault import _exceptions_by_document, anonymize_spans, replace_spans
from veilspark.rules.model import RuleSet
from veilspark.session import store

# Task functions of this module travel inside the plan: workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What a chat endpoint looks like, per service (literal or (?i) pattern).
ENDPOINTS = {
    "chatgpt": (["/conversation"], None),
    "claude": ([], r"(?i)/api/.*(chat|completion|message|conversation)"),
    "gemini": (["BardChatUi"], r"(?i)generate|stream"),
    "copilot": (["/api/conversation", "/sydney"], None),
    "mistral": ([], r"(?i)/api/(chat|conversation|completion)"),
    "perplexity": (["/rest/sse/perplexity_ask"], r"(?i)/api/(save_ask|new_ask|search)"),
    "deepseek": (["/chat/completion"], r"(?i)/api/v[0-9]*/chat/completion"),
    "grok": (["/rest/app-chat/conversations"], r"(?i)/api/(rpc|chat|conversation)"),
}


def route(df: DataFrame, host: str = "host", into: str = "service") -> DataFrame:
    """Service owning a host (itself or a subdomain); the first listed service wins."""
    name, service = F.col(host), None
    for key, hosts in dims.SERVICE_HOSTS:
        owns = name.isin(hosts)
        for h in hosts:
            owns = owns | name.endswith("." + h)
        service = F.when(owns, key) if service is None else service.when(owns, key)
    return df.withColumn(into, service)


def is_chat_endpoint(service: Column, url: Column) -> Column:
    verdict = None
    for key, (literals, pattern) in ENDPOINTS.items():
        test = F.lit(False)
        for literal in literals:
            test = test | F.contains(url, F.lit(literal))
        if pattern:
            test = test | url.rlike(pattern)
        verdict = F.when(service == key, test) if verdict is None else verdict.when(service == key, test)
    return F.coalesce(verdict, F.lit(False))


# Body shapes as SQL over the parsed VARIANT column ``json``.  A "site" is one
# text that gets rewritten; a prompt is one text that gets read: they differ
# only where a message is a list of parts (joined to read, separate to rewrite).

def _string(parent: str, key: str) -> str:
    """The member as a string, NULL unless it is one."""
    return (f"CASE WHEN schema_of_variant(try_variant_get({parent}, '$.{key}', 'variant')) = 'STRING' "
            f"THEN try_variant_get({parent}, '$.{key}', 'string') END")


def _items(parent: str, key: str) -> str:
    return f"try_variant_get({parent}, '$.{key}', 'array<variant>')"


def _is_object(v: str) -> str:
    return f"coalesce(schema_of_variant({v}) LIKE 'OBJECT%', false)"


def _has_role(names: tuple[str, ...], roles: tuple[str, ...] = ("user",)) -> str:
    wanted = ", ".join(f"'{r}'" for r in roles)
    return "(" + " OR ".join(f"coalesce({_string('m', n)} IN ({wanted}), false)" for n in names) + ")"


def _messages(names: tuple[str, ...], text: str, key: str = "messages", roles=("user",)) -> str:
    """One entry per user message; ``text`` (an array of strings) is what it contributes."""
    return (f"flatten(transform(filter(coalesce({_items('json', key)}, array()), "
            f"m -> {_is_object('m')} AND {_has_role(names, roles)}), m -> {text}))")


def _one(value: str) -> str:
    return f"array_compact(array({value}))"


_PART_TEXT = f"CASE WHEN {_is_object('p')} THEN {_string('p', 'text')} END"


def _parts(key: str) -> str:
    return f"coalesce({_items('m', key)}, array())"


def _string_or_parts(split: bool) -> str:
    """Message content that is a string or a list of ``{text}`` parts."""
    texts = f"array_compact(transform({_parts('content')}, p -> {_PART_TEXT}))"
    listed = texts if split else _one(f"nullif(array_join(filter({texts}, t -> t != ''), '\\n'), '')")
    return f"CASE WHEN ({_string('m', 'content')}) IS NOT NULL THEN {_one(_string('m', 'content'))} ELSE {listed} END"


def _shapes(split: bool) -> dict[str, str]:
    plain_parts = ("array_join(transform(" + _parts("content.parts")
                   + ", p -> CASE WHEN schema_of_variant(p) = 'STRING' THEN CAST(p AS STRING) ELSE '' END), '\\n')")
    chatgpt = (f"CASE WHEN {_items('m', 'content.parts')} IS NOT NULL THEN array({plain_parts}) "
               f"ELSE {_one(_string('m', 'content'))} END")
    gemini = (f"array_compact(transform({_parts('parts')}, p -> {_PART_TEXT}))" if split else
              f"array(array_join(transform({_parts('parts')}, p -> coalesce({_PART_TEXT}, '')), '\\n'))")
    openai = _messages(("role",), _string_or_parts(split), roles=("user", "human"))
    copilot = f"array(coalesce({_string('m', 'text')}, {_string('m', 'content')}, ''))"
    grok = _one(f"coalesce({_string('m', 'message')}, {_string('m', 'content')})")
    return {
        "chatgpt": _messages(("author.role", "role"), chatgpt),
        "claude": f"concat({_one(_string('json', 'prompt'))}, {openai})",
        "gemini": _messages(("role",), gemini, key="contents"),
        "copilot": _messages(("author", "role"), copilot),
        "mistral": openai, "deepseek": openai,
        "perplexity": f"concat({_one(_string('json', 'query_str'))}, {_one(_string('json', 'query'))}, "
                      + _messages(("role",), _one(_string("m", "content"))) + ")",
        "grok": f"concat({_one(_string('json', 'message'))}, {_messages(('role', 'sender'), grok)})",
    }


def _by_service(split: bool) -> Column:
    cases = " ".join(f"WHEN '{name}' THEN {sql}" for name, sql in _shapes(split).items())
    return F.expr(f"CASE WHEN {_is_object('json')} THEN CASE service {cases} END END")


def extract_prompts(requests: DataFrame, into: str = "prompts") -> DataFrame:
    """Add the user-written prompts of each request (``service`` and ``json`` given)."""
    return requests.withColumn(into, F.coalesce(_by_service(split=False), F.array().cast("array<string>")))


def extract_sites(requests: DataFrame, into: str = "sites") -> DataFrame:
    """Add the texts a rewrite replaces, in body order."""
    return requests.withColumn(into, F.coalesce(_by_service(split=True), F.array().cast("array<string>")))


def user_turns(turns: DataFrame) -> DataFrame:
    """Prompts of a flat chat table as rows, in place: a conversation of any
    length stays spread over the tasks that read it."""
    mine = turns.where(F.col("role").isin("user", "human"))
    return mine.select("conv_id", "turn", F.col("text").alias("prompt"))


def conversation_prompts(turns: DataFrame) -> DataFrame:
    """User turns as one ordered array per conversation, for conversations short
    enough to be one request; use :func:`user_turns` for unbounded ones."""
    grouped = user_turns(turns).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "prompt"))).alias("t"))
    return grouped.select("conv_id", F.col("t")["prompt"].alias("prompts"))


# ------------------------------------------------------------------ rewriting

def _text_member(owner: dict, *keys: str) -> str | None:
    return next((k for k in keys if isinstance(owner.get(k), str)), None)


def _rewrite_message(service: str, message: dict, put: Callable[[], str]) -> None:
    content = message.get("content")
    if service == "copilot":
        message["text"] = message["content"] = put()
    elif service == "chatgpt" and isinstance(content, dict) and isinstance(content.get("parts"), list):
        content["parts"] = [put()]
    elif service == "gemini" or (service in ("claude", "mistral", "deepseek") and isinstance(content, list)):
        parts = message.get("parts") if service == "gemini" else content
        for part in parts if isinstance(parts, list) else []:
            if isinstance(part, dict) and isinstance(part.get("text"), str):
                part["text"] = put()
    else:
        key = _text_member(message, *(("message", "content") if service == "grok" else ("content",)))
        if key:
            message[key] = put()


_ROLES = {"chatgpt": ("role",), "copilot": ("author", "role"), "grok": ("role", "sender")}
_TOP = {"claude": ("prompt",), "perplexity": ("query_str", "query"), "grok": ("message",)}


def _is_user(service: str, message: dict) -> bool:
    wanted = ("user", "human") if service in ("claude", "mistral", "deepseek") else ("user",)
    author = message.get("author")
    if service == "chatgpt" and isinstance(author, dict) and author.get("role") == "user":
        return True
    return any(message.get(key) in wanted for key in _ROLES.get(service, ("role",))
               if isinstance(message.get(key), str))


def _number(text: str):
    value = float(text)
    return int(value) if value.is_integer() and abs(value) < 1e21 else value


def rewrite_body(service: str, body: str, sites: list[str]) -> str:
    """The request body with its texts replaced by ``sites``, in order."""
    document = json.loads(body, parse_float=_number)
    if not isinstance(document, dict):
        return body
    queue = iter(sites)
    put = lambda: next(queue)                                                    # noqa: E731
    for key in _TOP.get(service, ()):
        if isinstance(document.get(key), str):
            document[key] = put()
    messages = document.get("contents" if service == "gemini" else "messages")
    for message in messages if isinstance(messages, list) else []:
        if isinstance(message, dict) and _is_user(service, message):
            _rewrite_message(service, message, put)
    return json.dumps(document, ensure_ascii=False, separators=(",", ":"))


def inject_prompts(requests: DataFrame, sites_col: str, body_col: str = "body", into: str = "new_body") -> DataFrame:
    """Write the texts of ``sites_col`` back into the bodies (Arrow batches; a body
    of an unknown service or shape is returned as it is)."""

    @F.pandas_udf("string")
    def rewrite(services: pd.Series, bodies: pd.Series, sites: pd.Series) -> pd.Series:
        return pd.Series([body if service is None or not len(new) else rewrite_body(service, body, list(new))
                          for service, body, new in zip(services, bodies, sites)])

    # Declared nondeterministic so that filters on the result are not pushed below
    # the call (it would run twice); using the sites twice keeps the expression
    # that makes them out of the call's arguments.
    call = rewrite.asNondeterministic()(F.col("service"), F.col(body_col), F.col(sites_col))
    return requests.withColumn(into, F.when(F.size(sites_col) == 0, F.col(body_col)).otherwise(call))


def evaluate_prompts(requests: DataFrame, rules: RuleSet) -> DataFrame:
    """Findings and decision over the prompts of a request joined by newlines."""
    return evaluate(requests.withColumn("joined", F.array_join("prompts", "\n")), "joined", rules)


def _literal_spans(site: Column, values: Column) -> Column:
    """Every occurrence of every value in ``site`` (per value left to right)."""
    def occurrences(v: Column, order: Column) -> Column:
        times = ((F.length(site) - F.length(F.replace(site, v["value"], F.lit("")))) / F.length(v["value"])).cast("int")
        kind = "struct<start:int,order:int,end:int,put:string>"

        def step(acc: Column, _: Column):
            start = F.call_function("locate", v["value"], site, acc["from"]) - 1
            end = start + F.length(v["value"])
            return {"from": end + 1}, F.struct(start.alias("start"), order.alias("order"), end.alias("end"),
                                               v["put"].alias("put"))

        found = fold_blocks(F.sequence(F.lit(1), times), {"from": F.lit(1)}, kind, step)
        return F.when(times > 0, found).otherwise(F.array().cast(f"array<{kind}>"))

    return F.flatten(F.transform(values, occurrences))


def anonymize_prompts(requests: DataFrame, vault: DataFrame, salt: str, id_col: str = "request_id",
                      session: str = "session", sites_col: str = "sites", into: str = "new_sites") -> DataFrame:
    """Replace the values found in the joined prompts wherever they occur in each
    site.  Values are located again by text, because the offsets belong to the
    joined prompts; ``requests`` should be a stored table (it is read twice)."""
    special = store(_exceptions_by_document(requests, vault, id_col, session), "exceptions")
    joined = requests.join(special, id_col, "left")
    chosen = F.coalesce(F.col("__special"), F.expr("cast(map() AS map<string,string>)"))
    wanted = F.when(F.coalesce(F.col("decision"), F.lit("")) != "block", anonymize_spans(F.col("findings")))
    values = F.transform(F.coalesce(wanted, F.filter("findings", lambda f: F.lit(False))), lambda f: F.struct(
        f["value"].alias("value"),
        F.coalesce(F.try_element_at(chosen, f["value"]), mint(f["label"], f["value"], F.lit(salt))).alias("put")))
    rewritten = F.transform(sites_col, lambda site: let(
        _literal_spans(site, F.col("__values")), lambda spans: replace_spans(site, spans)))
    return joined.withColumn("__values", F.array_distinct(values)).withColumn(into, rewritten).drop(
        "__values", "__special")

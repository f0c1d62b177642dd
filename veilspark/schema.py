"""Row shapes of the event model."""

from __future__ import annotations

# Vocabularies of the event contract.
SERVICES = ["ChatGPT", "Claude", "Gemini", "Copilot", "Mistral", "Perplexity", "DeepSeek", "Grok", "Unknown"]
EVENT_ACTIONS = ["CLEAN", "ANONYMIZED", "PII_DETECTED", "BLOCKED", "ATTACHMENT_CLEAN", "ATTACHMENT_PII_DETECTED",
                 "ATTACHMENT_BLOCKED", "ATTACHMENT_DETECTED", "ATTACHMENT_UNSCANNED"]
MODES = ["anonymize", "block", "visible"]
SEVERITY_NAMES = ["critical", "high", "medium", "low"]
RANGES = {"1h": "1 hour", "24h": "1 day", "7d": "7 days", "30d": "30 days"}
MAX_FINDINGS, MAX_BATCH = 50, 500
WIRE_NAMES = {
    "event_id": "eventId", "timestamp": "timestamp", "device_id": "deviceId", "user_hint": "userHint",
    "hostname": "hostname", "llm": "llm", "action": "action", "endpoint": "endpoint", "mode": "mode",
    "prompt_length": "promptLength", "mappings_count": "mappingsCount",
    "anonymized_preview": "anonymizedPreview", "findings": "findings", "attachment": "attachment",
    "extension_version": "extensionVersion",
}

FINDING = "struct<type:string,severity:string,count:int>"
ATTACHMENT = ("struct<sha256:string,mimeType:string,sizeBytes:int,extractedChars:int,truncated:boolean,"
              "extractorId:string,unavailable:boolean,passwordProtected:boolean>")
#: What arrives (name → type): every field nullable so that checks can report what is missing.
WIRE_EVENT = {
    "eventId": "string", "deviceId": "string", "orgId": "string", "userHint": "string", "timestamp": "timestamp",
    "hostname": "string", "llm": "string", "action": "string", "endpoint": "string", "mode": "string",
    "promptLength": "int", "mappingsCount": "int", "anonymizedPreview": "string", "findings": f"array<{FINDING}>",
    "attachment": ATTACHMENT, "extensionVersion": "string", "schemaVersion": "int",
}
#: What is stored.
EVENTS = {
    "event_id": "string", "timestamp": "timestamp", "org_id": "string", "device_id": "string",
    "user_hint": "string", "hostname": "string", "llm": "string", "action": "string", "endpoint": "string",
    "mode": "string", "prompt_length": "int", "mappings_count": "int", "anonymized_preview": "string",
    "findings": f"array<{FINDING}>", "attachment": ATTACHMENT, "extension_version": "string",
    "ingested_at": "timestamp", "ingest_id": "string",       # which micro-batch wrote the row
}
DEVICES = {
    "id": "string", "org_id": "string", "user_hint": "string", "extension_version": "string",
    "token_hash": "string", "created_at": "timestamp", "last_seen_at": "timestamp", "revoked": "boolean",
}
ORGS = {"id": "string", "name": "string", "created_at": "timestamp"}
DETECTIONS = {
    "service": "string", "host": "string", "action": "string", "findings": f"array<{FINDING}>", "total": "int",
    "source": "string", "ts": "timestamp",
}


def ddl(fields: dict[str, str], **more: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in {**fields, **more}.items())

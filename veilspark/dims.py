"""Small static dimensions (each a fixed handful of rows, safe to broadcast)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Articles, finding-type map, provider jurisdictions, risk tiers,
# prohibited signals and service hosts.  Reports must carry exactly these.
# ---------------------------------------------------------------------------
ARTICLES = [
    ("gdpr-4", "GDPR", "Art. 4(1)", "Définition de donnée à caractère personnel"),
    ("gdpr-5-1-c", "GDPR", "Art. 5(1)(c)", "Minimisation des données"),
    ("gdpr-5-1-e", "GDPR", "Art. 5(1)(e)", "Limitation de la conservation"),
    ("gdpr-9", "GDPR", "Art. 9", "Catégories particulières de données"),
    ("gdpr-17", "GDPR", "Art. 17", "Droit à l'effacement"),
    ("gdpr-30", "GDPR", "Art. 30", "Registre des activités de traitement"),
    ("gdpr-33", "GDPR", "Art. 33", "Notification de violation (72 h)"),
    ("gdpr-35", "GDPR", "Art. 35", "Analyse d'impact (DPIA)"),
    ("gdpr-44", "GDPR", "Chap. V (Art. 44+)", "Transferts hors UE"),
    ("aia-4", "AI_ACT", "Art. 4", "Maîtrise de l'IA (AI literacy)"),
    ("aia-5", "AI_ACT", "Art. 5", "Pratiques d'IA interdites"),
    ("aia-annex-iii", "AI_ACT", "Annexe III", "Systèmes d'IA à haut risque"),
    ("aia-13", "AI_ACT", "Art. 13", "Transparence et information des utilisateurs"),
    ("aia-50", "AI_ACT", "Art. 50", "Transparence des contenus générés"),
    ("aia-53", "AI_ACT", "Art. 53", "Obligations des modèles à usage général (GPAI)"),
]
TYPE_ARTICLES = {
    "email": ["gdpr-4", "gdpr-5-1-c"], "phone": ["gdpr-4", "gdpr-5-1-c"], "phone_fr": ["gdpr-4", "gdpr-5-1-c"],
    "iban": ["gdpr-4", "gdpr-5-1-c"], "credit_card": ["gdpr-4", "gdpr-5-1-c"],
    "ssn": ["gdpr-4", "gdpr-9"], "nir": ["gdpr-4", "gdpr-9"],
    "ip": ["gdpr-4"], "ipv4": ["gdpr-4"], "ipv6": ["gdpr-4"], "date": ["gdpr-4"], "domain": ["gdpr-4"],
    "password": ["gdpr-4", "gdpr-5-1-c"], "name": ["gdpr-4"], "address": ["gdpr-4"],
    "health": ["gdpr-9"], "medical": ["gdpr-9"], "religion": ["gdpr-9"], "ethnicity": ["gdpr-9"],
    "biometric": ["gdpr-9", "aia-5"], "political": ["gdpr-9"], "sexual_orientation": ["gdpr-9"],
    "trade_union": ["gdpr-9"], "evaluation_person": ["gdpr-9", "aia-annex-iii"],
    "financial_person": ["gdpr-4", "aia-annex-iii"], "indirect_id": ["gdpr-4"],
    "emotion": ["aia-5"], "emotion_workplace": ["aia-5"], "social_scoring": ["aia-5"],
    "predictive_policing": ["aia-5"],
}
DEFAULT_ARTICLES = ["gdpr-4"]
JURISDICTIONS = [
    ("ChatGPT", "OpenAI", "United States", "US", "US", "dpf",
     "EU-US Data Privacy Framework (depuis juillet 2023) — statut surveillé suite à Schrems II.", 37.77, -122.42),
    ("Claude", "Anthropic", "United States", "US", "US", "dpf",
     "EU-US Data Privacy Framework — Anthropic certifié DPF.", 37.77, -122.42),
    ("Gemini", "Google", "United States", "US", "US", "dpf",
     "EU-US Data Privacy Framework — Google LLC certifié DPF.", 37.42, -122.08),
    ("Copilot", "Microsoft", "United States", "US", "US", "dpf",
     "EU-US Data Privacy Framework + SCC. Régions EU disponibles selon abonnement.", 47.64, -122.13),
    ("Mistral", "Mistral AI", "France", "FR", "EU", "adequate",
     "Traitement intra-UE, aucun transfert hors EEE requis.", 48.85, 2.35),
    ("Perplexity", "Perplexity AI", "United States", "US", "US", "scc_required",
     "Clauses contractuelles types requises — pas de certification DPF confirmée.", 37.77, -122.42),
    ("DeepSeek", "DeepSeek", "China", "CN", "CN", "no_adequate",
     "Aucune décision d'adéquation. Transfert déconseillé — loi PIPL et accès gouvernemental.", 39.9, 116.4),
    ("Grok", "xAI", "United States", "US", "US", "scc_required",
     "Clauses contractuelles types requises — certification DPF non confirmée à ce jour.", 37.77, -122.42),
]
UNKNOWN_COUNTRY, UNKNOWN_CODE, UNKNOWN_REGION = "Inconnu", "??", "Other"
UNKNOWN_ADEQUACY, UNKNOWN_BASIS = "scc_required", "Juridiction non identifiée — à documenter."
TRANSFER_WEIGHTS = {"no_adequate": 1.0, "scc_required": 0.5, "dpf": 0.2}
RISK_TIERS = [
    ("minimal", "Risque minimal", "Recommandation : code de conduite volontaire (Art. 95)."),
    ("limited", "Risque limité", "Transparence (Art. 50) : informer les utilisateurs qu'une IA est en jeu, "
                                 "watermarking des sorties."),
    ("high", "Haut risque", "Système de gestion des risques, documentation, journalisation, supervision humaine, "
                            "DPIA (Art. 8-17)."),
    ("unacceptable", "Inacceptable", "Interdit (Art. 5) — usage à bloquer immédiatement."),
]
PROHIBITED = [
    ("emotion_workplace", "Reconnaissance d'émotions en contexte professionnel"),
    ("emotion", "Analyse d'émotions détectée — vérifier le contexte (interdit si travail/école)"),
    ("social_scoring", "Notation sociale — pratique interdite (Art. 5(1)(c))"),
    ("predictive_policing", "Évaluation du risque d'infraction — pratique interdite (Art. 5(1)(d))"),
    ("biometric", "Catégorisation biométrique sensible — interdite si pour déduire opinions/orientation"),
]
SERVICE_HOSTS = [
    ("chatgpt", ["chatgpt.com", "chat.openai.com"]),
    ("claude", ["claude.ai"]),
    ("gemini", ["gemini.google.com"]),
    ("copilot", ["copilot.microsoft.com"]),
    ("mistral", ["chat.mistral.ai"]),
    ("perplexity", ["perplexity.ai", "www.perplexity.ai"]),
    ("deepseek", ["chat.deepseek.com"]),
    ("grok", ["grok.com", "x.ai"]),
]


def articles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARTICLES, "article_id string, framework string, number string, title string")


def type_articles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TYPE_ARTICLES.items()), "type string, article_ids array<string>")


def jurisdictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        JURISDICTIONS, "llm string, company string, country string, country_code string, region string, "
                       "adequacy string, basis string, lat double, lng double")


def risk_tiers(spark: SparkSession) -> DataFrame:
    rows = [(i, *tier) for i, tier in enumerate(RISK_TIERS)]
    return spark.createDataFrame(rows, "tier_order int, tier string, label string, obligations string")


def prohibited(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROHIBITED, "type string, reason string")


def service_hosts(spark: SparkSession) -> DataFrame:
    rows = [(order, service, host) for order, (service, hosts) in enumerate(SERVICE_HOSTS) for host in hosts]
    return spark.createDataFrame(rows, "service_order int, service string, host_name string")

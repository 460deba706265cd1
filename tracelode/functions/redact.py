"""Redaction and detection of secrets and personal data, as chains of built-in regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, by kind.
PATTERNS = {
    "aws_access_key": r"\b(?:A3T[A-Z0-9]|AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}\b",
    "aws_secret_key": r"""(?i)(aws[_-]?secret[_-]?access[_-]?key|secret[_-]?access[_-]?key)\s*[=:]\s*['"]?([a-zA-Z0-9/+=]{40})['"]?""",
    "github_token": r"\b(gh[pousr]_[a-zA-Z0-9]{36,})\b",
    "url_credentials": r"(?i)(https?|ftp|ssh)://[^:/@\s]+:[^@\s]+@[^\s]+",
    "password_url": r"://[^:/@]+:([^@]+)@",
    "password_env": r"""(?i)(password|passwd|pass|pwd)\s*[=:]\s*['"]?([^\s'"]{3,})['"]?""",
    "bearer_token": r"(?i)Bearer\s+[a-zA-Z0-9_.-]+",
    "api_key": r"""(?i)(api[_-]?key|apikey|secret[_-]?key|private[_-]?key|access[_-]?key)\s*[=:]\s*['"]?([a-zA-Z0-9_-]{16,})['"]?""",
    "generic_secret": r"""(?i)(token|secret|credential|auth)\s*[=:]\s*['"]?([a-zA-Z0-9_-]{20,})['"]?""",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3,4}\d{1,4}\b",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "ipv6": r"(?i)\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b|(?:[0-9a-f]{1,4}:){1,7}:|(?:[0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}",
    "phone": r"\b(?:\+1[-.\s]?)?(?:\(?[0-9]{3}\)?[-.\s]?)?[0-9]{3}[-.\s]?[0-9]{4}\b",
}
#: Applied in this order; kinds whose match keeps its name before the value.
ORDER = tuple(k for k in PATTERNS if k != "password_url")
KEYED = ("aws_secret_key", "password_env", "api_key", "generic_secret")
#: How credentials in an address are replaced: what follows them stays.
URL_CREDENTIALS = r"(?i)\b((?:https?|ftp|ssh)://)[^:/@\s]+:[^@\s]+@(?=\S)"
#: Left out at the level `security`.
PERSONAL = ("email", "ipv4", "ipv6", "phone")
PLACEHOLDER = "[REDACTED]"


def _may(kind: str, text: Column) -> Column:
    """What has to stand in a text for the kind's pattern to match, found in one cheap pass."""
    low = F.lower(text)
    named = text.contains("=") | text.contains(":")
    digits = text.rlike("[0-9]{4}")
    return {
        "aws_access_key": lambda: text.rlike("A3T|A[BCKS][IC]A"),
        "aws_secret_key": lambda: named & low.contains("secret"), "github_token": lambda: text.rlike("gh[pousr]_"), "url_credentials": lambda: text.contains("://") & text.contains("@"),
        "password_env": lambda: named & (low.contains("pass") | low.contains("pwd")), "bearer_token": lambda: low.contains("bearer"), "api_key": lambda: named & low.contains("key"),
        "generic_secret": lambda: named & (low.contains("token") | low.contains("secret") | low.contains("credential") | low.contains("auth")),
        "ssn": lambda: digits, "credit_card": lambda: digits, "email": lambda: text.contains("@"), "ipv4": lambda: text.rlike(r"[0-9]\.[0-9]"), "ipv6": lambda: text.contains(":"), "phone": lambda: digits,
    }[kind]()


def redacted(text: Column, level: str = "all", placeholder: str = PLACEHOLDER) -> Column:
    """text with every match of the level's kinds replaced; null stays null. A pattern goes over a text only if that has what the pattern needs."""
    safe = placeholder.replace("\\", "\\\\").replace("$", "\\$")

    def hidden(kind: str, x: Column) -> Column:
        if kind == "url_credentials":
            return F.regexp_replace(x, URL_CREDENTIALS, f"$1{safe}@")
        if kind == "bearer_token":
            return F.regexp_replace(x, PATTERNS[kind], f"Bearer {safe}")
        return F.regexp_replace(x, PATTERNS[kind], f"$1={safe}" if kind in KEYED else safe)

    # each step stands in a lambda, so that the text before it is computed once
    step = lambda kind: lambda x: F.when(_may(kind, x), hidden(kind, x)).otherwise(x)
    for kind in ORDER:
        if not (level == "security" and kind in PERSONAL):
            text = F.get(F.transform(F.array(text), step(kind)), F.lit(0))
    return text


def redacted_json(json: Column, level: str = "all", placeholder: str = PLACEHOLDER) -> Column:
    """JSON text whose strings, names of fields included, are each redacted as the texts that they stand for, so that a quote within one hides nothing."""
    # control characters can't stand in JSON text: they hold the places of escapes, so that quotes only part strings
    held = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))
    freed = lambda x: F.replace(F.replace(x, F.lit("\u0002"), F.lit('\\"')), F.lit("\u0001"), F.lit("\\\\"))
    plain = lambda x: F.get(F.from_json(F.concat(F.lit('["'), freed(x), F.lit('"]')), "array<string>"), 0)
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r'^\["|"\]$', "")
    hidden = lambda x, i: F.when(i % 2 == 0, freed(x)).otherwise(F.coalesce(F.nullif(quoted(redacted(plain(x), level, placeholder)), F.lit("[null]")), freed(x)))
    return F.array_join(F.transform(F.split(held, '"', -1), hidden), '"')


def redacted_variant(value: Column, level: str = "all", placeholder: str = PLACEHOLDER) -> Column:
    """A VARIANT with its strings redacted."""
    return F.parse_json(redacted_json(F.to_json(value), level, placeholder))


def marked(text: Column, kind: str, before: str = "<<", after: str = ">>") -> Column:
    """text with the matches of one kind between marks instead of replaced."""
    return F.regexp_replace(text, PATTERNS[kind], f"{before}$0{after}")


def kinds_found(text: Column) -> Column:
    """The kinds present, in the order of application."""
    return F.array_compact(F.array(*[F.when(text.rlike(PATTERNS[k]), F.lit(k)) for k in ORDER]))

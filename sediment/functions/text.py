"""Text functions, Column to Column: tokens, normal forms, redaction, semantic keys. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query, and words of the archive's own vocabulary.
QUERY_STOP_WORDS = "a an and are as at be been being by can could did do does for how in is it of on or may might must shall should that the these this those to was were what when where which who will would why".split()
GENERIC_WORDS = "agent archive entry memory project review session source summary task test update workflow".split()
LIFECYCLE_WORDS = "deprecated inactive legacy obsolete retired superseded withdrawn".split()

# Canonical forms, stop words and polarity cues of semantic keys.
SYNONYMS = {
    "evidence": "evidences",
    "anchor": "anchors",
    "memory": "memories",
    "source": "sources",
    "preserve": "keep keeps kept keeping preserved preserves retain retained retains retaining",
    "ref": "citation citations cite cited cites citing references reference refs",
    "retrieval": "recall recalled recalling recalls retrieving retrieve retrieved retrieves",
}
SEMANTIC_STOP_WORDS = "a an and are as be by can during for from in is it its may must of on or should that the their to when with".split()
NEGATIVE_CUES = "avoid exclude excludes excluded excluding never no not omit omits omitted omitting skip skips skipped without".split()
POSITIVE_CUES = "include includes included keep keeps preserve preserves retain retains".split()

# Topics by words they contain; words that make a fact global.
TOPICS = {
    "memory-retrieval": "memory recall retrieval search index archive",
    "agent-workflow": "agent codex skill permission authorization workflow",
    "python-packaging": "python pip package venv wheel import",
    "frontend-qa": "frontend browser playwright viewport layout css",
    "git-workflow": "git commit branch worktree merge sync",
}
GLOBAL_HINTS = ["user prefers", "user wants", "the user prefers", "the user wants", "用户希望", "用户偏好", "不要反复", "强制记忆"]

# Secrets by category, in the order in which they are redacted; a group at the start is kept.
REDACTIONS = {
    "private_key": r"(?s)()-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    "bearer_token": r"(?i)(Authorization:\s*Bearer\s+)[A-Za-z0-9._~+/=-]+",
    "cookie": r"(?i)(Cookie:\s*)[^\n]+",
    "github_token": r"()\b(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,}\b",
    "openai_key": r"()\bsk-[A-Za-z0-9_-]{20,}\b",
    "aws_access_key": r"()\bAKIA[0-9A-Z]{16}\b",
}
# What a preview of source text hides, in order.
PREVIEW_REDACTIONS = {
    "COOKIE": r"(?i)\bcookie\s*=\s*\S+",
    "AUTHORIZATION": r"(?i)\bauthorization\s*[:=]\s*\S+",
    "BEARER_TOKEN": r"(?i)\bbearer\s+\S+",
    "OPENAI_KEY": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "GITHUB_TOKEN": r"\b(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,}\b",
    "AWS_ACCESS_KEY": r"\bAKIA[0-9A-Z]{16}\b",
    "API_KEY": r"(?i)\bapi[_-]?key\s*[:=]\s*\S+",
    "PASSWORD": r"(?i)\bpassword\s*[:=]\s*\S+",
    "SECRET": r"(?i)\bsecret\s*[:=]\s*\S+",
    "TOKEN": r"(?i)\btoken\s*[:=]\s*\S+",
}
PREVIEW_LENGTH = 240
UNSAFE_DISPLAY = r"(?i)(?:\b(?:api[_-]?key|authorization|bearer|cookie|credential|password|private[_ -]?key|secret|session[_-]?id|token)\b\s*[:=]|\bbearer\s+\S+|\bsk-[A-Za-z0-9_-]{20,}\b|\b(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,}\b|\bAKIA[0-9A-Z]{16}\b)"
REFRESH = r"(?i)^\s*(?:updated|refresh(?:ed)?|replacement|replace(?:d)?|superseding)\s+fact\s*[:：]\s*(.+?)\s*(?:=>|->|→)\s*(.+)$"
DELETION = r"(?i)^\s*(?:delete(?:d)?|remove(?:d)?|retire(?:d)?)\s+fact\s*[:：]\s*(.+)$"
DEPRECATION = r"(?i)^\s*deprecat(?:e|ed|ing)\s+fact\s*[:：]\s*(.+)$"

#: Tokens are runs of letters, numbers and `_`, `.`, `-`, in any script.
TOKEN = r"[\p{L}\p{N}_.-]+"


def words(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that it names more than once: the value is worked out once, and the expression stays small."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def compact_whitespace(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed. Null stays null."""
    return F.trim(F.regexp_replace(text, r"\s{2,}|[\t\n\x0B\f\r]", " "))  # a space by itself stays as it is


def normalize_memory_text(text: Column) -> Column:
    """Compact white space, then no spaces or dashes at the ends."""
    return F.btrim(compact_whitespace(text), F.lit(" -"))


def text_key(text: Column) -> Column:
    return F.lower(normalize_memory_text(text))


def clip(text: Column, limit: int) -> Column:
    """Compact text of at most `limit` characters, an ellipsis in the last three."""
    return let(compact_whitespace(text), lambda flat: F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))))


def slugify(text: Column, fallback: str = "item") -> Column:
    """Lower-case words joined by dashes, 80 characters at most."""
    slug = F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))
    slug = F.btrim(F.substring(slug, 1, 80), F.lit("-"))
    return F.when(F.length(slug) > 0, slug).otherwise(F.lit(fallback))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens in order of first occurrence; none for null."""
    return F.coalesce(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), F.lower)), F.array().cast("array<string>"))


def query_tokens(text: Column) -> Column:
    return F.array_except(tokens(text), words(QUERY_STOP_WORDS))


def token_importance(token: Column) -> Column:
    """5 for other scripts, 4 for compound tokens and long ones with digits, else by length."""
    return (
        F.when(token.rlike(r"[^\x00-\x7F]"), 5)
        .when(token.rlike(r"[_.-]"), 4)
        .when(token.rlike(r"[0-9]") & (F.length(token) >= 6), 4)
        .when(F.length(token) >= 10, 3)
        .when(F.length(token) >= 7, 2)
        .otherwise(1)
    )


def canonical_word(word: Column) -> Column:
    """The synonym's head, then a singular: -ies becomes -y, -s goes, in words of five letters or more."""
    head = word
    for name, others in SYNONYMS.items():
        head = F.when(word.isin(others.split()), F.lit(name)).otherwise(head)
    return head


def plain_words(lowered: Column) -> Column:
    """Distinct runs of a-z and 0-9 of a lower-case text, in order; null for null."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), 0))


def semantic_tokens(text: Column, found: Column | None = None) -> Column:
    """Distinct canonical words of three letters or more, without stop words and negations, in order.

    `found` are the text's plain words, where a column of them is at hand.
    """
    # short words go first: no synonym or singular of one would count; and no synonym is a stop word
    seen = plain_words(F.lower(text)) if found is None else found
    kept = F.filter(seen, lambda w: (F.length(w) >= 3) & ~w.isin(NEGATIVE_CUES + SEMANTIC_STOP_WORDS))

    def single(w: Column) -> Column:
        return F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(F.left(w, F.length(w) - 3), F.lit("y"))).when(w.endswith("s") & (F.length(w) > 4), F.left(w, F.length(w) - 1)).otherwise(w)

    every = [w for others in SYNONYMS.values() for w in others.split()]
    out = F.transform(kept, lambda w: F.when(w.isin(every), canonical_word(w)).otherwise(w))
    return F.coalesce(F.array_distinct(F.filter(F.transform(out, single), lambda w: F.length(w) >= 3)), F.array().cast("array<string>"))


def semantic_polarity(text: Column, found: Column | None = None) -> Column:
    """-1 with any negation, else 1 with any affirming cue or a synonym of one, else 0."""
    seen = plain_words(F.lower(text)) if found is None else found
    affirming = [*POSITIVE_CUES, *(w for head, others in SYNONYMS.items() if head in POSITIVE_CUES for w in others.split())]
    return F.when(F.arrays_overlap(seen, words(NEGATIVE_CUES)), -1).when(F.arrays_overlap(seen, words(list(dict.fromkeys(affirming)))), 1).otherwise(0)


def consolidation_key(text: Column, found: Column | None = None, polarity: Column | None = None) -> Column:
    """Texts that say the same share a key: polarity and sorted semantic tokens, or the text itself if it has under four.

    `found` and `polarity` are the text's semantic tokens and polarity, where columns of them are at hand.
    """
    found = semantic_tokens(text) if found is None else found
    polarity = semantic_polarity(text) if polarity is None else polarity
    meant = F.concat(F.lit("semantic:"), polarity.cast("string"), F.lit(":"), F.array_join(F.array_sort(found), " "))
    return F.when(F.size(found) < 4, F.concat(F.lit("literal:"), F.coalesce(text_key(text), F.lit("")))).otherwise(meant)


def _contains_any(lowered: Column, some: list[str]) -> Column:
    out = F.lit(False)
    for w in some:
        out = out | F.contains(lowered, F.lit(w))
    return F.coalesce(out, F.lit(False))


def memory_topic(lowered: Column) -> Column:
    """The first topic that a lower-case text has a word of."""
    topic = F.lit("general")
    for name, hints in reversed(TOPICS.items()):
        topic = F.when(_contains_any(lowered, hints.split()), F.lit(name)).otherwise(topic)
    return topic


def is_global_fact(lowered: Column) -> Column:
    return _contains_any(lowered, GLOBAL_HINTS)


def may_hold_secret(text: Column) -> Column:
    """Whether a text holds a literal that every redaction needs: most texts are told by these plain searches alone."""
    lowered = F.lower(text)
    return F.contains(text, F.lit("-----BEGIN")) | F.contains(text, F.lit("AKIA")) | F.contains(text, F.lit("sk-")) | F.contains(text, F.lit("gh")) & text.rlike("gh(?:[pousr]|ub_pat)_") | F.contains(lowered, F.lit("bearer")) | F.contains(lowered, F.lit("cookie:"))


def redact(text: Column) -> Column:
    """Struct of the redacted text and a count for each category; a category sees what earlier ones left."""
    plain = F.struct(F.coalesce(text, F.lit("")).alias("text"), *(F.lit(0).cast("long").alias(c) for c in REDACTIONS))
    return F.when(may_hold_secret(text), _redacted(text)).otherwise(plain)


def _redacted(text: Column) -> Column:
    counts, now = [], F.coalesce(text, F.lit(""))
    for name, pattern in REDACTIONS.items():
        counts.append(F.regexp_count(now, F.lit(pattern)).cast("long").alias(name))
        now = F.regexp_replace(now, pattern, f"$1[REDACTED_{name.upper()}]")
    return F.struct(now.alias("text"), *counts)


#: A literal of each pattern of a preview, lower-case: a text without any of them has nothing to hide.
PREVIEW_LITERALS = ("cookie", "authorization", "bearer", "sk-", "gh", "akia", "api", "password", "secret", "token")


def may_hide(lowered: Column) -> Column:
    """Whether a lower-case text holds a literal that some pattern of a preview needs."""
    return _contains_any(lowered, list(PREVIEW_LITERALS))


def preview(text: Column) -> Column:
    """A short redacted preview without control characters."""
    now = F.coalesce(text, F.lit(""))
    for name, pattern in PREVIEW_REDACTIONS.items():
        now = F.regexp_replace(now, pattern, f"[REDACTED_{name}]")
    now = F.when(may_hide(F.lower(text)), now).otherwise(F.coalesce(text, F.lit("")))
    return clip(F.regexp_replace(now, r"[\x00-\x1F\x7F]+", " "), PREVIEW_LENGTH)


def safe_display(text: Column, limit: int) -> Column:
    return F.when(text.rlike(UNSAFE_DISPLAY), F.lit("[unsafe-field]")).otherwise(clip(text, limit))


def tags(text: Column, project: Column, limit: int = 16) -> Column:
    """The project's slug and the first distinct tokens of a text, `limit` in all: no stop words, ids, short or numeric ones."""
    odd = r"^(?:[0-9]+|[0-9a-f]*[0-9][0-9a-f]*|.*\.py|.{1,2})$"
    plain = F.filter(F.transform(tokens(text), lambda t: F.btrim(t, F.lit("._-"))), lambda t: ~t.rlike(odd) & (t != "") & ~t.isin(QUERY_STOP_WORDS + GENERIC_WORDS))
    own = F.array(slugify(F.coalesce(project, F.lit("")), "archive"))
    return F.slice(F.array_distinct(F.transform(F.concat(own, plain), lambda t: F.left(t, F.lit(48)))), 1, limit)


def normalized_answer(text: Column) -> Column:
    """Lower-case words joined by one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def refresh_targets(text: Column) -> Column:
    """Struct (text, target) of facts that replace, delete or deprecate another; target null for plain facts."""
    old, new = normalize_memory_text(F.regexp_extract(text, REFRESH, 1)), normalize_memory_text(F.regexp_extract(text, REFRESH, 2))
    gone, worn = normalize_memory_text(F.regexp_extract(text, DELETION, 1)), normalize_memory_text(F.regexp_extract(text, DEPRECATION, 1))
    fresh = (old != "") & (new != "") & (F.lower(old) != F.lower(new))
    return (
        F.when(fresh, F.struct(new.alias("text"), old.alias("target")))
        .when(gone != "", F.struct(F.concat(F.lit("Deleted fact: "), gone).alias("text"), gone.alias("target")))
        .when(worn != "", F.struct(F.concat(F.lit("Deprecated fact: "), worn).alias("text"), worn.alias("target")))
        .otherwise(F.struct(text.alias("text"), F.lit(None).cast("string").alias("target")))
    )


def parse_timestamp(text: Column) -> Column:
    """ISO timestamps, with or without zone, or compact (20260514T120000); null where it isn't one."""
    compact = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    return F.try_to_timestamp(compact)


def isoformat(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")

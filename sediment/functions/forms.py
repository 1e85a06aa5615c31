"""Texts brought into form: prefixes and blocks stripped, sentences split, references and times taken apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import filters as P
from . import text as T

# What is stripped, in order; sentence ends; how explicit memories begin, and where their task's tail begins.
SKILL_PREFIX = r"^(?:(?:\[[^\]]*\]\([^)]+\)|\$[A-Za-z0-9_-]+)\s*)+"
CITATIONS = (r"(?is)<oai-mem-citation>.*?</oai-mem-citation>", r"(?i)</?(?:oai-mem-citation|citation_entries|rollout_ids)>", r"(?im)^\s*(?:MEMORY\.md|rollout_summaries/|skills/)[^\n|]*\|note=\[[^\n]*\]\s*$")
SENTENCE_END = "。！？.!?;；"
EXPLICIT = (r"(?i)^\s*remember this\s*[:：]\s*(.+)$", r"(?i)^\s*please remember\s*[:：]\s*(.+)$", r"(?i)^\s*(?:please\s+)?remember(?:\s+this)?\s+that\s+(.+)$", r"^\s*记住这个\s*[:：]\s*(.+)$", r"^\s*记住\s*[:：]\s*(.+)$", r"^\s*强制记忆\s*[:：]\s*(.+)$")
TASK_TAIL = r"(?i)[,;.!?，；。！？]\s*(?:(?:now|then|next|review|fix|run|check|implement|create|update)\b|(?:现在|然后|接下来|顺便|再|请|帮我)).*$"
NATURAL = {r"(?i)^\s*i\s+prefer\s+(.+)$": "The user prefers ", r"(?i)^\s*my\s+preference\s+is\s+(?:that\s+)?(.+)$": "The user prefers ", r"(?i)^\s*i\s+want\s+(.+)$": "The user wants "}
# Facets of a query.
FACETS = (
    r"(?i)\b(?:(?:global|user|personal)\s+)?preferences?\b|\bprefer\b|(?:全局|用户|我的|个人)?(?:长期)?偏好|默认(?:要求|选择|使用)",
    r"(?i)\b(?:project\s+history|historical\s+(?:decision|context)|program\s+map|roadmap)\b|项目历史|历史(?:决策|上下文)|路线图|阶段(?:计划|历史)",
    r"(?i)\b(?:current\s+(?:head|tests?|reviewed(?:[ -]code)?|repository|repo|state|status)|live\s+(?:repository|repo|state|status))\b|(?:当前|最新)\s*(?:HEAD|测试|已审(?:代码|状态)|仓库|代码状态|状态)",
)
#: A query of more meaningful tokens than this, or of two facets, is better asked in parts.
MOST_TOKENS = 5
FILE_TIME = r"(\d{4}-\d{2}-\d{2})T(\d{2})[:_-](\d{2})[:_-](\d{2})"


def without_skill(text: Column) -> Column:
    """Compact text without leading `$skill` and link prefixes."""
    return F.trim(F.regexp_replace(T.compact_whitespace(text), SKILL_PREFIX, ""))


def without_citations(text: Column) -> Column:
    out = text
    for p in CITATIONS:
        out = F.regexp_replace(out, p, "")
    return F.btrim(out, F.lit(" \t\n\r\f\x0b"))


def clip_daily(text: Column, limit: int = 240) -> Column:
    """Compact text of at most `limit` characters, cut at a sentence's end in its second half, else at a word's; marks of
    emphasis go where the cut leaves one open."""

    def bounded(flat: Column) -> Column:
        head = F.rtrim(F.substring(flat, 1, limit - 3))
        whole = F.regexp_extract(head, f"(?s)^(.*[{SENTENCE_END}])", 1)
        words = F.regexp_extract(head, "(?s)^(.*) ", 1)
        return F.concat(F.when(F.length(whole) > limit // 2, whole).when(F.length(words) >= limit // 2, F.rtrim(words)).otherwise(head), F.lit("..."))

    flat = T.compact_whitespace(text)
    cut = bounded(flat)
    odd = (F.length(cut) - F.length(F.replace(cut, F.lit("**"), F.lit("")))) % 4 == 2
    return F.when(F.length(flat) <= limit, flat).when(odd, bounded(F.replace(flat, F.lit("**"), F.lit("")))).otherwise(cut)


def sentences(text: Column, limit: int = 32) -> Column:
    """A text's sentences, clipped, `limit` at most: lines without bullets, noisy ones left out, parted behind their ends; the
    clipped text if there is none, nothing for a blank text."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+"), lambda x: F.regexp_replace(F.trim(x), r"^\s*[-*]\s+", ""))
    kept = F.filter(lines, lambda x: (x != "") & ~P.noisy(x))
    parts = F.flatten(F.transform(kept, lambda x: F.split(T.compact_whitespace(x), r"(?<=[。！？!?])\s*|(?<=\.)\s+(?=[A-Z0-9`\"'(\[])")))
    found = F.transform(F.filter(parts, lambda x: F.trim(x) != ""), lambda x: T.clip(x, 240))
    blank = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) == ""
    return F.when(blank, F.array().cast("array<string>")).when(F.size(found) > 0, F.slice(found, 1, limit)).otherwise(F.array(T.clip(text, 240)))


def lower_first(text: Column) -> Column:
    whole = F.trim(text)
    return F.concat(F.lower(F.left(whole, F.lit(1))), F.substring(whole, 2, 1 << 30))


def explicit_memory(text: Column) -> Column:
    """What a text asks to remember, without the task that follows; null if it asks nothing, or not to."""
    asked = F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in EXPLICIT))
    return F.when(~P.negated_directive(text), F.nullif(T.normalize_memory_text(F.regexp_replace(asked, TASK_TAIL, "")), F.lit("")))


def natural_memory(text: Column) -> Column:
    """A preference or wish as a fact of the user; null if it states none."""
    said = [F.when(F.regexp_extract(text, p, 1) != "", F.concat(F.lit(head), F.regexp_extract(text, p, 1))) for p, head in NATURAL.items()]
    return F.coalesce(*said)


def source_ref(ref: Column) -> Column:
    """Struct (path, anchor): what stands before and behind the first `#`."""
    at = F.instr(ref, "#")
    cut = F.when(at > 0, F.left(ref, at - 1)).otherwise(ref)
    return F.struct(F.trim(cut).alias("path"), F.when(at > 0, F.trim(F.substring(ref, at + 1, F.lit(1 << 30)))).otherwise("").alias("anchor"))


def ask_in_parts(query: Column) -> Column:
    """Whether a query holds too many meaningful tokens, or several facets, to be asked at once."""
    meaningful = F.array_except(T.query_tokens(query), T.words(T.GENERIC_WORDS))
    facets = sum((F.when(query.rlike(p), 1).otherwise(0) for p in FACETS), F.lit(0))
    return (F.size(meaningful) > MOST_TOKENS) | (facets >= 2)


def time_of_path(path: Column) -> Column:
    """The first date and time in a path, else the first date; null if there is none."""
    full = F.regexp_extract(path, FILE_TIME, 0)
    made = F.concat(F.regexp_extract(path, FILE_TIME, 1), F.lit("T"), F.concat_ws(":", *(F.regexp_extract(path, FILE_TIME, k) for k in (2, 3, 4))), F.lit("Z"))
    day = F.regexp_extract(path, r"\d{4}-\d{2}-\d{2}", 0)
    return F.coalesce(F.when(full != "", T.parse_timestamp(made)), F.when(day != "", T.parse_timestamp(F.concat(day, F.lit("T00:00:00Z")))))


def record_folder(at: Column, slug: Column, sha256: Column) -> Column:
    """The folder of a record, by day, time, project and the beginning of its hash."""
    return F.concat(F.lit("sessions/"), F.date_format(at, "yyyy/MM/dd"), F.lit("/"), F.date_format(at, "yyyy-MM-dd'T'HHmmss'Z'"), F.lit("_"), slug, F.lit("_"), F.left(sha256, F.lit(10)))

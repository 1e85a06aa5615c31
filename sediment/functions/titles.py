"""Titles and durable texts: prompts cleaned of paths and marks, narration cut off, scores of titles."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import filters as P
from . import forms
from . import text as T
from .goals import REUSABLE

_KINDS = r"rs|py|tsx?|jsx?|md|toml|json|ya?ml|cpp|hpp|h|c"
_EDGE = " -:;,."
_ROOTS = ["/Users/", "/var/", "/private/", "/tmp/", "/opt/", "/home/", "/Volumes/"]
# What goes from a title, in order; a group is kept. Before each, literals of which it needs one
# (lower-case where the pattern ignores case).
_PATH = r"/(?:Users|var|private|tmp|opt|home|Volumes)/[^\s`)]+"
_NAMED = rf"/(?:Users|var|private|tmp|opt|home|Volumes)/(?:[^\s`)]*/)?([^\s`)/]*?\.(?i:dylib|so|dll|{_KINDS})|lib[A-Za-z0-9_.-]*[A-Za-z0-9_-])/*[.,:;]*(?=$|[\s`)])"
_STRIPPED = [
    (["]("], r"\[([^\]]+)\]\([^)]+\)", "$1"),
    ([], r"^\s*\d{1,2}[.)、]\s*", ""),
    (["worktree"], rf"(?i)\b(?:the\s+)?current\s+worktree\s+`{_PATH}`\s+for\s+", ""),
    (["worktree"], rf"(?i)\b(?:the\s+)?current\s+worktree\s+{_PATH}\s+for\s+", ""),
    (["worktree"], rf"(?i)\b(?:in|from)\s+(?:the\s+)?(?:current\s+)?worktree\s+`{_PATH}`", ""),
    (["worktree"], rf"(?i)\b(?:in|from)\s+(?:the\s+)?(?:current\s+)?worktree\s+{_PATH}", ""),
    (["`/"], rf"`{_NAMED}`", "$1"),
    (["`/"], rf"`{_PATH}`", ""),
    (_ROOTS, _NAMED, "$1"),
    (_ROOTS, _PATH, ""),
    (["`"], r"`([^`]+)`", "$1"),
    (["**"], r"\*\*", ""),
    ([], r"^\s*\d{1,2}[.)、]\s*", ""),
    ([], r"(?i)^Task:\s*", ""),
    (["worktree"], r"(?i)\bworktree\s*[,.]?", ""),
    ([" for "], r"(?i)\s+\bfor\s+([,.])", "$1"),
    (["  "], r"\s{2,}", " "),
]
_STATUS = r"(?i)^(CHANGES_REQUESTED|DONE_WITH_CONCERNS|APPROVED|DONE)\b"
_FINDING = r"(?i)\bFindings?\b\s*[:\-]?\s*(?:\d+\.\s*)?(?:(?:High|Medium|Low)\s*[:\-]\s*)?(.+)"
_FILE_TAILS = [([":"], rf"(?i):\s+[A-Za-z0-9_./-]+\.(?:{_KINDS})\b.*$", "")]
# Titles of high value, and a title that stands for texts which hold all of four things.
HIGH_VALUE = r"(?i)spurious\s+502|libx\d+(?:\.\d+)?(?:\.dylib)?|_gdal|osgeo|127\.0\.0\.1|socks5|local routing|全局出站代理|本地代理|高信噪比|记忆索引|durable memory index|memory index|retrieval-first"
_ALL_OF = [r"(?i)router-level", r"(?i)integration\s+test", r"(?i)concurrent\s+reconnect", r"(?i)spurious\s+502"]
_STANDS_FOR_ALL = "Missing router-level concurrent reconnect integration test for loser path spurious 502"
HIGH_VALUE_LITERALS = ["spurious", "libx", "_gdal", "osgeo", "127.0.0.1", "socks5", "local routing", "全局出站代理", "本地代理", "高信噪比", "记忆索引", "memory index", "retrieval-first"]
# What raises or lowers a title's score, by search or as a whole.
_WEIGHTS = [
    (r"(?i)\b(root cause|decision|decided|chosen|verified|must|should|proxy|socks5|local routing)\b|根因|原因|决定|选择|验证|索引|代理|全局出站代理|本地代理|失败", 24),
    (r"(?i)高信噪比|记忆索引|durable memory index|memory index|retrieval-first", 28),
    (HIGH_VALUE, 55),
    (r"(?i)\b(changes_requested|finding|findings|approved)\b", 35),
    (r"(?i)\b(?:code quality|spec compliance|review|re-review|implement task)\b", -10),
    (r"(?i)\b(?:dry run|live update|source record|secret gate|subagent)\b|默认 secret gate|产生新写入", -45),
    (r"(?i)^(?:(?:https?|socks5h?)\s+proxy\s*:\s*\S+|(?:https?|socks5h?)://\S+|127\.0\.0\.1(?::\d+)?)$", -80),
    (r"`[^`]+`|[A-Za-z0-9_./-]+\.(?:dylib|so|jsonl|md)|\b\d{1,3}(?:\.\d{1,3}){3}\b", 10),
    (r"[?？]", 8),
    (r"^(?:可以|是的|不行|不能|结论[:：]?.{0,12})[。.!]?$", -35),
]
UNFIT = -10_000
# Narration at a text's start or end.
_NOW = r"现在(?:先|开始|改为|做|跑|检查|验证|清理|处理|读取)|现在\s*(?:dry run|rewrite|重写)|现在按\s*(?:顺序|计划|规则|TDD|测试)|现在实现(?:最小)?修复|现在同步(?:真实)?工具|执行\s*rewrite|同步后重跑|按上一轮耗时估计|先(?:读取|检查|看|跑|做|定位|验证|清理)"
_ME = r"我现在(?:检查|继续|先|会|加|跑|改|处理|验证|看)|现在我(?:检查|继续|先|会|加|跑|改|处理|验证|看|已经)"
_LATER = r"当前我会|接着我会|随后我会|最后我会|最后一轮我会|我做最后一轮|接下来我|下一步我|我继续|我先|下一块会"
_PREFIX = r"^\s*(?:[-*]\s*)?(?:验证结果|验证已跑|但阻塞点很明确|阻塞点很明确|阻塞原因|原因很直接|原因是|我做过的验证|方案选择|常见原因)\s*[:：]\s*"
_BLOCKS = [(["**"], r"(?i)(?:\s+|^)\*\*(?:Commands?|Command Status|Tool Calls?)\*\*.*$", ""), (["command status"], r"(?i)(?:\s+|^)Command Status\s*[-:].*$", "")]
_USING = (r"(?i)^using\s+[`$]?(?:using-|brainstorming|test-driven|systematic)", r"(?i)\bas requested\b|\bi(?:'ll|’ll| will)\s+also\s+use\b")
_STARTS = rf"^(?:{_ME}|{_LATER}|先看|{_NOW})"
_TELLING = ["我", "现在", "执行", "同步后", "按上一轮", "先"]
_TAIL = rf"(?:[。.!?；;，,：:]|\s)?(?:我会(?:先|只|把|用|继续|做|改|跑|等|查|核实|从|按|清|尝试|恢复)|{_LATER}|{_ME}|{_NOW}).*$"
_ENDINGS = [
    (P._WILL, r"(?i)\s+so\s+i(?:'ll|’ll| will)\s+also\s+use\b.*$", ""),
    (P._ME, r"(?i)\s+i(?:'m|’m| am)\s+(?:proceeding|locating|checking|inspecting|running|rerunning|continuing|waiting|working|reading|verifying|starting)\b.*$", ""),
    (P._ME, r"(?i)\s+i(?:'m|’m| am)\s+not\s+(?:rerunning|running|proceeding|continuing)\b.*$", ""),
    (P._WILL, r"(?i)\s+i(?:'ll|’ll| will)\s+(?:only\s+)?(?:inspect|check|verify|run|rerun|continue|wait|proceed|look|locate|report|use)\b.*$", ""),
    (P._WILL, r"(?i)\s+then\s+i(?:'ll|’ll| will)\b.*$", ""),
]

_CHINESE_ENDING = rf"[。.!?；;，,：:]\s*(?:我会|我继续|我先|接下来我|下一步我|下一块会|当前我会|{_ME}).*$"


def _trim(text: Column, marks: str = _EDGE) -> Column:
    return F.btrim(text, F.lit(marks))


def _phrase(flat: Column) -> Column:
    every = F.lit(True)
    for p in _ALL_OF:
        every = every & flat.rlike(p)
    return F.when(P._any(F.lower(flat), ["router-level"]) & every, F.lit(_STANDS_FOR_ALL)).otherwise(flat)


def _replaced(text: Column, steps: list[tuple[list[str], str, str]]) -> Column:
    """The patterns' matches replaced in order; patterns in a row with the same literals only in texts that hold one of these."""

    def every(x: Column, some: list) -> Column:
        for _, pattern, by in some:
            x = F.regexp_replace(x, pattern, by)
        return x

    def once(literals: list[str], some: list) -> Callable[[Column], Column]:
        folds = any("(?i)" in pattern for _, pattern, _ in some)
        return lambda x: F.when(P._any(F.lower(x) if folds else x, literals), every(x, some)).otherwise(x)

    for literals, group in groupby(steps, lambda s: s[0]):
        some = list(group)
        text = T.let(text, once(literals, some)) if literals else every(text, some)
    return text


def focused(text: Column, limit: int = 120) -> Column:
    """The compact text; if it is long and of high value, its first sentence that is, else what stands around the place."""

    def focus(flat: Column) -> Column:
        sentences = F.filter(F.transform(F.split(flat, r"[。！？!?；;]\s*"), lambda x: _phrase(_trim(x))), lambda x: x.rlike(HIGH_VALUE))
        at, long = F.regexp_instr(flat, F.lit(HIGH_VALUE)), F.length(F.regexp_extract(flat, HIGH_VALUE, 0))
        first = F.greatest(F.lit(1), at - 80)
        around = _trim(F.substring(flat, first, at + long + 40 - first))
        telling = (F.length(flat) > limit) & P._any(F.lower(flat), HIGH_VALUE_LITERALS) & (at > 0)
        return F.when(telling, F.coalesce(F.get(sentences, F.lit(0)), around)).otherwise(flat)

    return T.let(T.let(T.compact_whitespace(text), _phrase), focus)


def clean_title(text: Column) -> Column:
    """A prompt as a title: links, numbers, local paths (a file's name stays), marks and `task:` gone; of a review, its status and
    finding; 120 characters at most."""
    now = _replaced(forms.without_skill(text), _STRIPPED)

    def told(x: Column) -> Column:
        status = F.upper(F.regexp_extract(x, _STATUS, 1))
        said = F.when(P._any(F.lower(x), ["finding"]), F.regexp_extract(x, _FINDING, 1)).otherwise("")
        issue = _trim(_replaced(_trim(said), _FILE_TAILS))
        return T.let(issue, lambda i: F.when(i == "", x).when(status == "", i).otherwise(F.concat(status, F.lit(": "), i)))

    return T.let(focused(_replaced(T.let(_trim(now, " -:;,.。"), told), _FILE_TAILS)), lambda x: T.clip(x, 120))


def title_score(text: Column, weight: int = 0) -> Column:
    """How well a text serves as a title; UNFIT for nothing, low signal, noise, narration and raw prompts."""
    return score_of_title(clean_title(text), weight)


def score_of_title(title: Column, weight: int = 0) -> Column:
    """The same of a text that is cleaned already."""

    def score(title: Column) -> Column:
        unfit = (title == "") | P.low_signal(title) | P.noisy(title) | P.process_update(title) | P._any(F.lower(title), P.RAW_PROMPT)
        n = F.length(title)
        out = F.lit(weight) + F.when(n < 8, -45).when(n < 30, 8).when(n <= 100, 28).otherwise(12)
        for pattern, worth in _WEIGHTS:
            out = out + F.when(title.rlike(pattern), worth).otherwise(0)
        return F.when(unfit, UNFIT).otherwise(out)

    return T.let(title, score)


def without_narration(text: Column) -> Column:
    """The text without clauses in which the speaker tells of their own steps; '' if nothing else is left."""
    white = F.lit(" \t\n\r\f\x0b")
    bare = F.btrim(F.regexp_replace(F.btrim(text, white), _PREFIX, ""), white)
    for step in _BLOCKS:
        bare = F.btrim(_replaced(bare, [step]), white)

    def cut(x: Column) -> Column:
        told = P._any(x, _TELLING)  # without one of these there is no such tail
        head = T.let(F.when(told, F.regexp_instr(x, F.lit(_TAIL))).otherwise(0), lambda at: F.when(at == 0, x).otherwise(T.let(F.regexp_replace(F.left(x, at - 1), r"[ 。.!?；;，,：:]+$", ""), lambda y: F.when(F.length(y) < 8, F.lit("")).otherwise(y))))
        gone = x.rlike(r"^[-*]?\s*\.\.\.$") | P.low_signal(x) | (x.rlike(_USING[0]) & x.rlike(_USING[1])) | x.rlike(_STARTS)
        return F.when(gone, F.lit("")).otherwise(head)

    ended = T.let(_replaced(T.let(bare, cut), _ENDINGS), lambda x: F.when(~P._any(x, ["我", "下一块会"]), x).otherwise(F.concat(F.regexp_replace(x, _CHINESE_ENDING, ""), F.when(F.regexp_extract(x, _CHINESE_ENDING, 0).rlike("^[。.]"), F.lit("。")).otherwise(F.lit("")))))
    return T.let(ended, lambda x: T.clip(x, 240))


def _fact(text: Column) -> Column:
    return T.let(text, lambda x: T.let(F.regexp_extract(x, REUSABLE, 1), lambda fact: F.when(fact != "", F.trim(fact)).otherwise(x)))


def _kept(candidate: Column) -> Column:
    cleaned = T.let(T.compact_whitespace(candidate), lambda x: F.when(P.raw_prompt(x), clean_title(x)).otherwise(T.clip(x, 240)))
    return T.let(cleaned, lambda x: F.when((x == "") | P.low_signal(x) | P.noisy(x) | P.raw_prompt(x), F.lit("")).otherwise(x))


def durable_text(text: Column) -> Column:
    """What of a text may last: '' for narration, noise and low signal; prompts as titles, else the clipped text without
    `reusable fact:`."""
    kept = _kept(_fact(forms.without_skill(text)))
    return F.when(P.process_update(text), F.lit("")).otherwise(T.let(kept, lambda x: F.when(P.process_update(x), F.lit("")).otherwise(x)))


def durable_user_text(text: Column) -> Column:
    """The same of a user's text, who may narrate."""
    return _kept(forms.without_skill(text))

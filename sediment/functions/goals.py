"""Signals of a correction of how goals are to be handed over, as columns of a user's turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import filters as P
from . import text as T

# The fact that corrections lead to, and the terms that find it.
PREFERENCE = "用户偏好：goal 提示词格式偏好是，默认将完整 Markdown goal 放入单独的 text 代码块，以可直接复制的纯文本形式交付，方便复制；代码块外不添加解释性前言或结语，内部存在代码围栏时使用更长且不冲突的外层围栏。"
TERMS = ["可直接复制", "markdown", "goal", "提示词格式偏好", "纯文本", "方便复制", "我的", "应该怎样交付"]
# Turns in a window, and turns that support a fact at most.
WINDOW, SUPPORT = 12, 4
# Patterns of a turn. (?U): \b and \s know all scripts.
SIGNALS = {
    "artifact": r"(?i)(?<![A-Za-z0-9_])goal(?:spec)?(?![A-Za-z0-9_])|目标(?:提示词|文档|计划)",
    "shape": r"(?iU)markdown|\bmd\b|纯\s*markdown|排版|格式|复制|粘贴|代码块|围栏|反引号|纯文本|text\s*(?:block|fence|代码块)",
    "specific": r"(?iU)markdown|\bmd\b|纯\s*markdown|代码块|围栏|反引号|纯文本|text\s*(?:block|fence|代码块)",
    "copying": r"(?iU)(?:无法|不能|方便|直接|一键)?\s*(?:复制|粘贴)|copy(?:able)?",
    "correcting": r"(?:你看看|注意|一定|必须|应该|不然|无法|不能|不对|不是|出错|搞错|乱|正确|正常|重新|又|仍然|还是|倒是|不要|别|直接)",
    "other_thing": r"(?iU)python|代码(?!块)|脚本|函数|页面|网页|表格|电子表格|幻灯片|演示文稿|文档|readme|\b(?:code|script|function|page|table|spreadsheet|slide|deck|document|readme)\b",
    "thing_first": r"(?i)(?:把|将).{0,24}(?<![A-Za-z0-9_])goal(?![A-Za-z0-9_]).{0,24}(?:给我|交付|输出)|(?:不要|别).{0,20}(?:解释|前言|结语|说明|讨论)|artifact\s+first",
    "fenced": r"(?iU)text\s*(?:代码块|围栏|block|fence)|(?:单独|独立).{0,12}(?:代码块|围栏)|纯文本.{0,16}(?:复制|交付)|(?:代码块|围栏).{0,16}(?:复制|交付)",
    "unfenced": r"(?iU)(?:不要|别|不再|无需|不用).{0,24}(?:text\s*)?(?:代码块|围栏|反引号)|直接.{0,12}(?:渲染|输出).{0,16}(?:markdown|goal)",
}
RHETORICAL = r"(?:你看看(?:你|这|刚才|上面).{0,48}(?:给|写|输出|交付).{0,48}(?:吗|呢|乱|错|不对|复制)|不是[，,].{0,80}(?:怎么|为什么).{0,32}(?:错|乱|复制)|这都.{0,24}(?:乱|错)|疯狂出错)"
SWITCH = r"(?i)接下来|现在|然后|另外|换个话题|先不说|改做|改为|转而|next|switch"
REQUEST = r"(?i)给我|请写|写一段|写个|做一段|改做|生成|实现|修改|处理|build|write|create"
ABANDONED = r"(?i)(?:先不做|先不说|不再做|别再做|别管|停止|放弃|暂时不做).{0,16}(?<![A-Za-z0-9_])goal(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])goal(?![A-Za-z0-9_]).{0,16}(?:先不做|不做了|结束|算了|放弃)"
LASTING = r"(?iU)\b(?:always|by default|from now on|every time|whenever)\b"
OTHERS_SAY = r"(?U)(?:同事|别人|他人|他|她|他们|有人).{0,12}(?:说|提到|写道|建议|要求)\s*[:：]?[“\"「『]|[”\"」』].{0,24}(?:这是|这句是|这话是|这也是)?(?:同事|别人|他人|他|她|他们|有人).{0,12}(?:说|提到|写道|建议|要求)(?:的)?"
SKILL = r"(?iU)^(?:(?:\[\$[A-Za-z][A-Za-z0-9_-]*\]\([^)]*/SKILL\.md\)|\$[A-Za-z][A-Za-z0-9_-]*)\s*)+"
REUSABLE = r"(?iU)^\s*reusable fact\s*[:：]\s*(.+)$"
_WHITE = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0　"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_EMPTY = r"(?U)[\s，,。.!！?？:：;；()（）\[\]{}*_#>+-]+"


def bare(text: Column) -> Column:
    """The text without a skill's name in front."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SKILL, ""), F.lit(_WHITE))


def markdown_quotes(text: Column) -> Column:
    """Whether code marks are left open, or nothing stands outside of code: such a text is quoted, or broken.

    Lines are folded with the open fence as the state; inline marks open and close with the next run of their length.
    """
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("outside"), F.lit(0).alias("blocks"))

    def line(at: Column, x: Column) -> Column:
        mark = F.regexp_extract(x, r"^[ \t]{0,3}(`{3,}|~{3,})[^\n]*$", 1)
        ends = F.regexp_extract(x, r"(?U)^[ \t]{0,3}(`{3,}|~{3,})\s*$", 1)
        closes = (F.left(ends, F.lit(1)) == F.left(at["fence"], F.lit(1))) & (F.length(ends) >= F.length(at["fence"]))
        inner = F.regexp_extract(x, r"^[ \t]{0,3}`{3,}([^\n]*)$", 1)
        opens = (mark != "") & ~(mark.startswith("`") & F.contains(inner, F.lit("`")))
        inside = F.struct(F.when(closes, F.lit("")).otherwise(at["fence"]).alias("fence"), at["outside"].alias("outside"), at["blocks"].alias("blocks"))
        opened = F.struct(mark.alias("fence"), at["outside"].alias("outside"), (at["blocks"] + 1).alias("blocks"))
        plain = F.struct(F.lit("").alias("fence"), F.array_append(at["outside"], x).alias("outside"), at["blocks"].alias("blocks"))
        return F.when(at["fence"] != "", inside).when(opens, opened).otherwise(plain)

    read = F.aggregate(F.split(text, _LINES), start, line)
    outside = F.btrim(F.array_join(read["outside"], "\n"), F.lit(_WHITE))
    runs = F.regexp_extract_all(outside, F.lit("`+"), 0)
    left_open = F.aggregate(runs, F.lit(0), lambda n, x: F.when(n == 0, F.length(x)).when(n == F.length(x), 0).otherwise(n))
    beside = F.regexp_replace(outside, r"(?s)(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)", " ")
    nothing = lambda x: F.regexp_replace(x, _EMPTY, "") == ""
    broken = (read["fence"] != "") | (left_open != 0)
    return F.when(F.contains(text, F.lit("`")) | F.contains(text, F.lit("~~~")), broken | ((read["blocks"] > 0) & nothing(outside)) | ((F.size(runs) > 0) & nothing(beside))).otherwise(False)


def quotes_others(text: Column) -> Column:
    """Whether a text quotes: block quotes, what others say, or quotation marks in front or unpaired."""
    times = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    out = text.rlike(r"(?mU)^\s*>") | text.rlike(OTHERS_SAY) | (times('"') % 2 == 1) | text.startswith('"')
    for a, b in ("“”", "「」", "『』"):
        out = out | text.startswith(a) | (times(a) != times(b))
    return out


def is_break(said: Column) -> Column:
    """Whether a turn leaves goals for another thing."""
    plain = F.regexp_replace(said, "[`\"“”「」『』]", "")
    away = plain.rlike(SIGNALS["other_thing"]) & (plain.rlike(SWITCH) | plain.rlike(REQUEST))
    return away & (~plain.rlike(SIGNALS["artifact"]) | plain.rlike(ABANDONED))


def may_correct(raw: Column, flat: Column) -> Column:
    """Whether a turn may state a correction: nothing noisy, sensitive, quoted, temporary or open. `flat` is the compact text."""
    c = lambda k: flat.rlike(P.CHINESE[k])
    barred = P.noisy(flat) | P.sensitive_explicit(flat) | markdown_quotes(raw) | quotes_others(raw) | c("temporary") | (c("open") & ~flat.rlike(RHETORICAL)) | c("quoted")
    return (flat != "") & ~barred


def lasting(said: Column) -> Column:
    return said.rlike(P.CHINESE["future"]) | said.rlike(P.CHINESE["recurring"]) | said.rlike(LASTING)


def source_key(text: Column) -> Column:
    """The form in which texts count as equal: without `reusable fact:`, compact, lower-case."""
    fact = F.regexp_extract(text, REUSABLE, 1)
    return F.lower(T.normalize_memory_text(F.when(fact != "", fact).otherwise(text)))

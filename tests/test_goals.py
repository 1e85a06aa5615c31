import random

from sediment.functions import goals as G
from sediment.operators.goals import induced_goal_preferences

SAYINGS = {
    "about": "请帮我写这个 goal 的内容",
    "about_md": "goal 必须用 markdown 格式",
    "fix_copy": "不对，无法复制",
    "fix_md": "应该放进代码块，方便复制",
    "fix_plain": "排版又乱了",
    "away": "接下来写个 python 脚本",
    "away_goal": "先不说 goal，改做网页",
    "reject": "不要放代码块",
    "reject_goal": "goal 不要代码块",
    "direct": "以后 goal 默认放在单独的 text 代码块，方便复制",
    "first": "把 goal 直接给我，别解释",
    "noise": "<environment_context> goal",
    "quoted": "同事说：“goal 必须用代码块复制”",
    "today": "这次 goal 应该用代码块",
    "fence": "```\ngoal\n```",
    "open_mark": "goal 应该用 `代码块",
    "chat": "谢谢",
    "skill": "$write-goal 请写 goal 文档",
    "blank": "  ",
}
# what the plain version knows of a saying: (may correct, signals)
KNOWN = {
    "about": (True, "artifact"),
    "about_md": (True, "artifact shape specific correcting"),
    "fix_copy": (True, "shape copying correcting"),
    "fix_md": (True, "shape specific copying correcting fenced"),
    "fix_plain": (True, "shape correcting"),
    "away": (True, "other_thing break"),
    "away_goal": (True, "artifact other_thing break"),
    "reject": (True, "shape specific correcting unfenced"),
    "reject_goal": (True, "artifact shape specific correcting unfenced"),
    "direct": (True, "artifact shape specific copying fenced lasting"),
    "first": (True, "artifact correcting thing_first"),
    "noise": (False, "artifact"),
    "quoted": (False, "artifact"),
    "today": (False, "artifact"),
    "fence": (False, "artifact"),
    "open_mark": (False, "artifact"),
    "chat": (True, ""),
    "skill": (True, "artifact other_thing"),
    "blank": None,
}


def plain_version(names):
    """One session, turn by turn, by search over all earlier turns."""
    turns = [(i, n, KNOWN[n][0], set(KNOWN[n][1].split())) for i, n in enumerate(names) if KNOWN[n] is not None]
    breaks = [i for i, _, _, s in turns if "break" in s]
    able = [(i, n, s) for i, n, ok, s in turns if ok]

    def interrupted(a, b):  # a turn to another thing after a, up to b
        return any(a < x <= b for x in breaks)

    rejected = directed = None
    for k, (i, _, s) in enumerate(able):
        goals = [j for j, _, t in able[:k] if "artifact" in t]
        active = bool(goals) and not any(goals[-1] < x < i for x in breaks)
        if {"unfenced", "shape"} <= s and (s & {"artifact", "lasting"} or active) and "other_thing" not in s:
            rejected = i
        if {"artifact", "shape", "fenced", "lasting"} <= s and s & {"copying", "thing_first"} and "unfenced" not in s:
            directed = i
    if directed is not None:
        return None if rejected is not None and rejected > directed else ("directive", [directed])
    got = None
    for k in range(len(able)):
        window = able[max(0, k - G.WINDOW + 1) : k + 1]
        for c, _, s in reversed(window):
            if "artifact" not in s or "break" in s:
                continue
            linked, first = [], None
            for i, n, t in window:
                if i < c or interrupted(c, i) or not {"shape", "correcting"} <= t or "unfenced" in t or ("other_thing" in t and "artifact" not in t):
                    continue
                if t & {"artifact", "specific"} or (i > c and not linked) or first == n:
                    linked.append((i, t))
                    first = n if first is None and i > c else first
            if len(linked) >= 2 and any(t & {"copying", "fenced"} for _, t in linked):
                wanted = {c, *(i for i, _ in linked[-2:]), *[i for i, _, t in window if "thing_first" in t][-1:]}
                got = linked[-1][0], sorted(wanted)[-G.SUPPORT :]
                break
    return None if got is None or (rejected is not None and rejected > got[0]) else ("corrections", got[1])


def test_sayings_have_the_signals_that_the_plain_version_knows(spark):
    from pyspark.sql import functions as F

    from sediment.functions import text as T

    raw = spark.createDataFrame(list(SAYINGS.items()), "name string, text string").withColumn("raw", G.bare(F.col("text"))).withColumn("flat", T.compact_whitespace(T.normalize_memory_text(F.col("raw"))))
    said = F.col("flat")
    rows = raw.select("name", "flat", G.may_correct(F.col("raw"), said).alias("ok"), G.lasting(said).alias("lasting"), G.is_break(said).alias("break"), *(said.rlike(p).alias(k) for k, p in G.SIGNALS.items())).collect()
    for r in rows:
        if KNOWN[r["name"]] is None:
            assert r["flat"] == ""
            continue
        ok, signals = KNOWN[r["name"]]
        assert r["ok"] == ok, r
        if ok:
            assert {k for k in (*G.SIGNALS, "lasting", "break") if r[k]} == set(signals.split()), r


def test_equal_to_a_plain_state_machine(spark):
    rng = random.Random(12)
    sessions = [[], ["about", "fix_copy", "fix_md"], ["direct", "reject"], ["about", "fix_copy", "away", "fix_md"], ["about", "fix_plain", "fix_plain", "fix_copy"]]
    often = ["about", "about_md", "fix_copy", "fix_md", "fix_plain", "chat", "first"]
    sessions += [[rng.choice(often if rng.random() < 0.8 else list(SAYINGS)) for _ in range(rng.randrange(1, 40))] for _ in range(250)]
    sessions.append([rng.choice(["chat", "chat", "about", "fix_plain"]) for _ in range(900)])
    rows = [(s, i, "user", SAYINGS[n]) for s, names in enumerate(sessions) for i, n in enumerate(names)]
    rows += [(s, 1_000_000, "assistant", SAYINGS["direct"]) for s in range(5)] + [(1, 1_000_001, "user", None)]
    turns = spark.createDataFrame(rows, "session long, position long, role string, text string")
    want = {s: x for s, names in enumerate(sessions) if (x := plain_version(names))}
    for size in (4096, 7):
        got = {r["session"]: (r["kind"], r["supports"]) for r in induced_goal_preferences(turns, size).collect()}
        assert got == want
    assert len(want) > 60 and {k for k, _ in want.values()} == {"directive", "corrections"}

import random

from pyspark.sql import functions as F

from sediment.functions import titles
from sediment.operators.summaries import KINDS, summary_evidence


def plain_version(lines, final, durable):
    of = {k: [t for _, t in sorted((p, t) for p, kind, t in lines if kind == k)] for k in KINDS}
    final = durable[final] if final is not None else ""
    got = [d for t in of["pinned"][-(5 if final else 6) :] if (d := durable[t])]
    limit = 5 if final and final not in got else 6
    for t in [*of["natural"][-5:], *(t for k in KINDS[2:-1] for t in of[k])]:
        if len(got) < limit and durable[t] and durable[t] not in got:
            got.append(durable[t])
    if not got:
        for t in of["user"]:
            if durable[t] and durable[t] not in got and len(got) < limit:
                got.append(durable[t])
    if final and final not in got:
        got.append(final)
    return got[:6]


def test_evidence_equals_a_plain_fill(spark):
    rng = random.Random(5)
    texts = [f"we decided on plan {k}" for k in range(14)] + ["maybe later", "", "committed and pushed", "Reusable fact: we decided on plan 3"]
    durable = {r["t"]: r["d"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", titles.durable_text(F.col("t")).alias("d")).collect()}
    assert durable[texts[-1]] == texts[3] and not durable["maybe later"]
    lines, finals = [], []
    for s in range(120):
        kinds = rng.sample(KINDS, rng.randrange(1, 6)) if s % 4 else ["user"]
        lines += [(s, p, rng.choice(kinds), rng.choice(texts)) for p in range(rng.choice((0, 3, 8, 40)))]
        if rng.random() < 0.7:
            finals.append((s, rng.choice(texts)))
    got = {r["session"]: r["evidence"] for r in summary_evidence(spark.createDataFrame(lines, "session long, position long, kind string, text string"), spark.createDataFrame(finals, "session long, text string")).collect()}
    ends = dict(finals)
    for s in range(120):
        want = plain_version([x[1:] for x in lines if x[0] == s], ends.get(s), durable)
        assert got.get(s, []) == want, s

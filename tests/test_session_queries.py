"""Queries without SQL, held against plain versions over their whole tables."""

import hashlib

from pyspark.sql import functions as F

from sediment import catalog
from sediment.functions import titles
from sediment.operators import provenance, summaries
from sediment.plans import session_queries

from . import test_summaries

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_fact_sources(spark):
    events = session_queries._said_turns(spark, SF)
    said, keys = {}, {}
    for r in events.collect():
        said.setdefault(r["session"], []).append((r["position"], r["role"], r["text"]))
    for r in provenance.event_keys(events).collect():
        keys.setdefault((r["session"], r["key"]), []).append((r["rank"], r["position"]))
    wish = lambda t: next((head + t[len(form) :] for form, head in (("I prefer ", "The user prefers "), ("my preference is that ", "The user prefers ")) if t.startswith(form) and "\n" not in t and t[len(form) :].strip()), None)
    got = {(r["session"], r["fact_sha256"]): (r["source"], r["source_position"]) for r in catalog.queries()["fact_sources"](spark, SF).collect()}
    flat = lambda t: " ".join(t.split()).strip(" -").lower()
    checked = 0
    for s, turns in said.items():
        wishes = {flat(w) for _, role, t in turns if role == "user" and (w := wish(t))}
        told = {flat(part[len("Reusable fact:") :]) for _, role, t in turns if role != "user" for part in t.split("\n") if part.lower().startswith("reusable fact:")}
        for _, _, t in turns:
            if not flat(t):
                continue
            source, position = got[s, sha(t)]
            own = flat(t[len("Reusable fact:") :] if t.startswith("Reusable fact:") and "\n" not in t else t)
            assert position == (min(keys[s, own])[1] if (s, own) in keys else None)
            if flat(t) in wishes:
                assert source == "natural_user"
            elif flat(t) not in told:
                assert source in ("natural_assistant", "explicit_reusable_fact")
            checked += 1
    assert checked > 20 and {v[0] for v in got.values()} >= {"natural_user", "natural_assistant"}


def test_session_evidence(spark):
    turns = session_queries._said_turns(spark, SF).withColumn("durable", titles.durable_text(F.col("text"))).collect()
    durable = {r["text"]: r["durable"] for r in turns}
    got = {r["session"]: (r["n_evidence"], r["evidence_sha256"]) for r in catalog.queries()["session_evidence"](spark, SF).collect()}
    for s in {r["session"] for r in turns}:
        own = sorted((r["position"], r["role"], r["text"]) for r in turns if r["session"] == s)
        kind = lambda p, role, t: ("natural" if t.startswith("I prefer") else "user") if role == "user" else "fact" if t.startswith("Reusable fact") else summaries.KINDS[2 + p % 5]
        want = test_summaries.plain_version([(p, kind(p, role, t), t) for p, role, t in own], own[-1][2], durable)
        assert got[s] == (len(want), sha("\n".join(want)))


def test_title_scores(spark):
    rows = catalog.queries()["title_scores"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert len(r["title"]) <= 120 and "/home/" not in r["title"] and "**" not in r["title"]
        assert (r["score"] == titles.UNFIT) or -200 < r["score"] < 300
        if not docs[r["doc_id"]].strip():
            assert r["title"] == "" and r["score"] == titles.UNFIT and r["durable_sha256"] == sha("")

import re

from sediment.llm import op10_decontamination as op

SCHEMA = "doc_id long, text string, items string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_force(docs, items):
    out = []
    for i, text, _ in docs:
        w, hit, found = words(text), set(), set()
        for k, item in items:
            v = words(item)
            width = min(10, len(v))
            windows = {tuple(v[a : a + width]) for a in range(len(v) - width + 1)} if v else set()
            for a in range(len(w) - width + 1) if v else ():
                if tuple(w[a : a + width]) in windows:
                    hit.update(range(a, a + width))
                    found.add(str(k) if k is not None else "")
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


PASSAGE = "What is the Capital of France, and how many people (2023) live there now? Answer: Paris é"
ITEMS = [(1, PASSAGE), (2, "Short one"), (10, "short ONE!"), (3, None), (4, "---"), (5, "a b c d e f g h i j k")]
DOCS = [(1, f"lead -- {PASSAGE.upper()} tail", "x"), (2, "a short. one in short one", None), (3, None, ""), (4, "", ""), (5, "x a b c d e f g h i j k a b c d e f g h i", "y"), (6, "shortone", "z"), (5, "b c d e f g h i j k", "w"), (None, "short one", "n"), (7, "w " * 50_000 + "short one", "l")]


def test_hits_equal_brute_force_in_one_block_and_several(spark, monkeypatch):
    docs, items = spark.createDataFrame(DOCS, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_force(DOCS, ITEMS)
    seen = []
    for most in (op.BLOCK_WINDOWS, 1):
        monkeypatch.setattr(op.item_blocks, "__defaults__", ("item_id", "text", most, op.BLOCK_BYTES))
        got = op.decontaminate(docs, items).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in got), key=str) == want
        seen.append(sorted([(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in got], key=str))
    first = next(s for i, s in seen[0] if i == 2)
    assert [DOCS[1][1][a:b] for a, b in first] == ["short. one", "short one"]


def test_clean_documents_stay_whole(spark, monkeypatch):
    docs, items = spark.createDataFrame(DOCS, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = op.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6]
    assert op.clean_documents(docs, items.limit(0)).count() == len(DOCS)
    monkeypatch.setattr(op.item_blocks, "__defaults__", ("item_id", "text", 1, op.BLOCK_BYTES))
    assert sorted(map(tuple, op.clean_documents(docs, items).collect()), key=str) == sorted(map(tuple, kept.collect()), key=str)
    assert op.clean_documents(docs.limit(0), items).count() == 0


def test_a_long_item_goes_in_pieces(spark, monkeypatch):
    item = " ".join(f"w{k}" for k in range(400))
    docs = [(1, " ".join(f"w{k}" for k in range(a, a + 10)), "x") for a in range(0, 391, 13)] + [(2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 x10", "y")]
    monkeypatch.setattr(op.item_blocks, "__defaults__", ("item_id", "text", op.BLOCK_WINDOWS, 100))
    got = op.decontaminate(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_hit"], tuple(r["items"])) for r in got) == sorted((i, 10 if i == 1 else 0, ("7",) if i == 1 else ()) for i, _, _ in docs)

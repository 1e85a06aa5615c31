import hashlib
from collections import Counter

import numpy as np
import pytest

from sediment.llm import _tokens, op13_alignment
from sediment.llm.op13_alignment import align_tokens, owners

from .corpus import SCHEMA, documents
from .test_op11 import tricky

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


def brute_force(texts):
    """Whole texts, one after another."""
    a = tokenizers.Tokenizer.from_file(_tokens.tokenizer_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=_tokens.tokenizer_file("piece_bpe_32k.model"))
    shown = {}  # of byte-level characters
    for k in range(256):
        shown.setdefault(k, None)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in printable}
    of |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    rows = []
    for t in texts:
        ia, ib = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        ba = [bytes(of[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        raw = (" " + (t or "")).encode()
        if not t or b"".join(ba) != raw or b"".join(bb) != raw:
            rows.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        both, groups, x, y = set(ends_a) & set(ends_b), [], 0, 0
        for end in sorted(both):
            p, q = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            groups.append((ia[x:p], ib[y:q]))
            x, y = p, q
        rows.append(groups)
    docs = Counter()
    for groups in rows:
        docs.update({(i, j) for g, h in groups for i in g for j in h})
    most = {}
    for (i, _), n in docs.items():
        most[i] = max(n, most.get(i, 0))
    out = []
    for groups in rows:
        links = [(i, j) for g, h in groups for i in g for j in h]
        spelt = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), spelt, sum(docs[x] == most[x[0]] for x in links), sum(docs[x] for x in links)))
    return out


def texts():
    return [*tricky(), *(r[1] for r in documents()), None, "", "▁x", "a▁ b", "<s> </s> <unk> <|endoftext|>", "one two", "one two", "日本語のテキスト" * 50, " " * 50, "\n \n x", "ab" * 4000]


def test_alignment_equals_brute_force(spark, monkeypatch):
    rows = texts()
    want = brute_force(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, align_tokens(docs).collect()))
    assert got == [(k, *x) for k, x in enumerate(want)]
    assert sum(x[0] == 0 for x in want) < 60


def test_small_blocks_and_digests(spark, tmp_path, monkeypatch):
    """Blocks of single documents give the same counts."""
    import sediment.llm.op13_alignment as module

    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_force([r[1] for r in rows])
    monkeypatch.setattr(module, "BLOCK_BYTES", 1)
    monkeypatch.setattr(module, "CUT_BYTES", 1)
    got = module.op13_alignment(spark, str(tmp_path)).collect()
    said = sorted([(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], r["n_best"], r["count_sum"]) for r in got], key=str)
    assert said == sorted([(r[0], *x[:4], hashlib.sha256(x[4].encode()).hexdigest() if x[4] else "", *x[5:]) for r, x in zip(rows, want, strict=True)], key=str)


def test_owners_give_overlaps_and_groups():
    over_a, over_b, group_a, group_b = owners(np.array([2, 3, 1]), np.array([1, 1, 2, 2]))
    assert list(zip(over_a.tolist(), over_b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 3)]
    assert group_a.tolist() == [0, 1, 1] and group_b.tolist() == [0, 0, 1, 1]


def test_empty_table_and_clashing_columns(spark):
    assert align_tokens(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(None, "a b", 1, "x"), (2, None, 2, None), (2, None, 2, None)], "doc_id long, text string, block int, pairs string")
    got = sorted(map(tuple, align_tokens(docs).collect()), key=str)
    want = brute_force(["a b", None])
    assert got == sorted([(None, *want[0]), (2, *want[1]), (2, *want[1])], key=str)
    assert op13_alignment._byte_level()["Ġ"] == 0x20

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sediment.llm import _tokens
from sediment.llm.op11_packing import op11_packing, pack_counts, pack_documents

from .corpus import SCHEMA, documents

tokenizers = pytest.importorskip("tokenizers")


def tricky() -> list[str]:
    """Texts around the places where stretches are cut."""
    rng = random.Random(11)
    bits = ["it's", "'s", "a'b", "Å", "H̱", "éx", "İ", " ", "　", "’", " ", "\n", "\n\n", " ", "  ", "\t", ".", ",\n", "x.y", "3.14", "a1b22", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|", "|", "<0x0A>", "日本語", "ß", "KelvinK", "--", "...", "᠎", "\x1c", "\x00", "é", "Word", "WORD", "ﬁ", "🙂", "\x85", "don't", "x" * 300]
    return ["".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(600)]


def whole_ids(texts):
    got = tokenizers.Tokenizer.from_file(_tokens.tokenizer_file("word_bpe_49k.json"))
    return [[*e.ids, 2] for e in got.encode_batch(texts, add_special_tokens=False)]


def check_pieces(rows, got, length):
    """Every id in exactly one piece, sequences gapless and full up to powers of two."""
    want = sorted(zip([r[0] for r in rows], whole_ids([r[1] or "" for r in rows]), strict=True), key=str)
    of = defaultdict(list)
    for r in got:
        of[r["sequence_id"]].append(r)
    sizes = []
    for pieces in of.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and 0 < r["length"] <= length
            at += r["length"]
        sizes.append(at)
    assert sorted(of) == list(range(len(of)))
    short = [n for n in sizes if n != length]
    assert len(set(short)) == len(short) and all(n & (n - 1) == 0 and n < length for n in short)
    assert sum(sizes) == sum(len(ids) for _, ids in want)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    ids_of = defaultdict(list)
    for i, ids in want:
        ids_of[i].append(ids)
    for i, ids in ids_of.items():
        assert len({tuple(x) for x in ids}) == 1
        ids, times = ids[0], len(ids)
        covered = np.zeros(len(ids), int)
        for r in by_id[i]:
            a, b = r["start"], r["start"] + r["length"]
            covered[a:b] += 1
            assert r["doc_tokens"] == len(ids) and np.frombuffer(r["ids"], "<u4").tolist() == ids[a:b]
        assert (covered == times).all()


def test_every_id_lies_in_one_piece(spark):
    rows = [(k, t) for k, t in enumerate(tricky())] + [(10_000 + k, r[1]) for k, r in enumerate(documents())]
    rows += [rows[700], (None, "no id"), (99_998, None), (99_999, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_pieces(rows, pack_documents(docs).collect(), 4096)
    check_pieces(rows, pack_documents(docs, length=64).collect(), 64)


def test_empty_table_and_clashing_columns(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "a b", 5, b"x"), (2, None, None, None)], "doc_id long, text string, tokens int, ids binary")
    check_pieces([(1, "a b"), (2, None)], pack_documents(docs).collect(), 4096)
    with pytest.raises(ValueError):
        pack_documents(docs, length=100)


def test_digests_of_the_query(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    ids = dict(zip([r[0] for r in rows], whole_ids([r[1] or "" for r in rows]), strict=True))
    got = op11_packing(spark, str(tmp_path)).collect()
    assert len(got) >= len(rows)
    for r in got:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes())


def naive_packs(counts, length):
    """Shortest pack first, one rest at a time, over as many packs as the tokens fill."""
    total = sum(n * k for n, k in enumerate(counts))
    packs, last = divmod(total, length)
    room = [1 << k for k in range(length.bit_length()) if last >> k & 1]
    cut, left, cuts = list(counts), packs, 0
    for size in range(length - 1, 0, -1):
        for _ in range(cut[size]):
            k = max(range(len(room)), key=lambda k: room[k], default=None)
            if (k is None or room[k] < size) and left:
                room.append(length)
                left, k = left - 1, len(room) - 1
            used = min(room[k], size)
            room[k] -= used
            if used < size:
                cut[size - used] += 1
                cuts += 1
    assert not any(room)
    return cuts


def test_plan_packs_as_one_by_one():
    rng = random.Random(5)
    for length in (8, 16, 64):
        for _ in range(60):
            counts = [0, *(rng.choice((0, 0, 1, 2, 7)) for _ in range(length - 1))]
            if rng.random() < 0.3:
                counts[rng.randrange(1, length)] = 40  # a third of all rows are copies
            plan = pack_counts(np.array(counts), length)
            filled = defaultdict(list)
            for level, of, lo, hi, shift, size, pack, offset in plan.tolist():
                for k in range(lo, hi):
                    filled[pack + k - lo].append((offset, size, of, k, shift))
            tokens = defaultdict(list)
            for pieces in filled.values():
                at = 0
                for offset, size, of, k, shift in sorted(pieces):
                    assert offset == at
                    at += size
                    tokens[of, k].append((shift, size))
                assert at & (at - 1) == 0
            for n, m in enumerate(counts):
                for k in range(m):
                    at = 0
                    for shift, size in sorted(tokens[n, k]):
                        assert shift == at
                        at += size
                    assert at == n
            assert int(((plan[:, 3] - plan[:, 2]) * (plan[:, 0] > 0)).sum()) == naive_packs(counts, length)


def test_plan_is_bounded_by_the_length_and_not_by_the_rows():
    counts = np.random.default_rng(2).integers(1, 10**9, 4096)
    counts[0] = 0
    assert len(pack_counts(counts)) < 30_000

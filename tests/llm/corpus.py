"""A small corpus with the cases that operators must handle, made from a fixed seed."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice("ba ke li mo nu so ta vi xe zo Ru pa".split()) + rng.choice("ra ti ne lo".split()) for _ in range(n)]


def documents() -> list[tuple]:
    """Exact and near copies, shared passages, short, empty, null and long texts, a repeated row."""
    rng = random.Random(7)
    texts: list[str | None] = [None, "", " \t\n", "one", "one two three four", "one two three four five", "ONE two three four five", "É ü word x"]
    base = words(rng, 120)
    for k in range(40):  # near copies, from nearly equal to far
        w = list(base)
        for _ in range(k // 4):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 5
    passage = words(rng, 45)
    for _ in range(12):
        texts.append(" ".join([*words(rng, rng.randrange(60)), *passage, *words(rng, rng.randrange(60))]))
    texts.append(" ".join(passage * 3))
    texts += [" ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    texts.append(" ".join(f"w{k}" for k in range(30_000)))
    rows = [(i * 3 + 1, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[20], (None, "a text without an id", "en", "s1", 20)]

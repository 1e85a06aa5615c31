"""Toxicity by weak supervision.

Voters say toxic, clean or abstain. Lexicon voters fire on words or word beginnings that labelled training rows show far
more often under one label; entries that fire on nearly the same rows make one voter. Pattern voters look at case, marks,
look-alike characters, address, repetition and length; one says clean where no lexicon says toxic. A generative label model estimates by expectation maximisation how
often each voter votes either way on toxic and on clean texts, and how voters are correlated beyond that; correlated
voters share a vote. The given labels only start it: they are no voter. A linear classifier over hashed words and word
beginnings is trained on the model's posteriors and scores every whole text. Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chunks, free_held, small_batches, table, text_column, written
from ._shingles import mixed, powers

#: Bounds: labelled rows that the models are fitted on, lexicon entries, voters, and features of the classifier.
MAX_ROWS, MAX_ENTRIES, MAX_VOTERS, MAX_FEATURES = 30_000, 600, 200, 20_000
#: A lexicon entry is on so many rows of its label at least, has this likelihood ratio (G statistic) and this lift.
LEAST_SUPPORT, LEAST_G, LEAST_LIFT = 4, 20.0, 40.0
#: Entries that share this part of their rows are one voter.
SAME_VOTER = 0.7
#: Voters whose residuals correlate so are taken for dependent.
DEPENDENT = 0.5
#: The classifier's buckets are hashes of so many bits.
BUCKET_BITS = 18
#: Beginnings of a word that are features beside the word, in bytes.
BEGINNINGS = (3, 4, 5, 6, 7, 8, 10)

# Characters that stand for letters; words of address.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
ADDRESS = "you your yours yourself du dich dir dein deine euch ihr tu toi ton ta tes vous votre te ti tus usted ustedes vosotros".split()

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!?"]] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*@^~+="]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x41:0x5B] += 32
for _from, _to in LOOK_ALIKE.items():
    _PLAIN[ord(_from)] = ord(_to)
_STANDS = np.zeros(256, bool)
_STANDS[[ord(c) for c in LOOK_ALIKE]] = True

PATTERNS = ("shouting", "exclaiming", "symbols", "look-alikes", "address", "repetition", "short", "middling", "long")


def _run_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


@dataclass
class Read:
    """Texts of one chunk: the first row, and (row, feature) pairs, each once a text; counts of bytes and words by row."""

    first: int
    rows: int
    row: np.ndarray
    feature: np.ndarray
    words: np.ndarray
    counts: dict[str, np.ndarray] = field(default_factory=dict)


def read_texts(col: pa.Array, patterns: bool = False, only: np.ndarray | None = None) -> Iterator[Read]:
    """Words (runs of letters, lowered; look-alike characters next to letters count as letters) and their beginnings, as 64-bit
    hashes; with `only` (a table over BUCKET_BITS) those of the buckets it names."""
    if not len(col):
        return
    every = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    for a, b in chunks(col):
        offsets = every[a : b + 1] - every[a]
        raw = data[every[a] : every[b]]
        letter = np.zeros(len(raw) + 2, bool)
        letter[1:-1] = _LETTERS[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        odd = _STANDS[raw] & letter[2:]  # before a letter of the same text
        odd &= ~cut[1:]
        letter[1:-1] |= odd
        plain = _PLAIN[raw]
        after = np.flatnonzero(raw[:-1] == 0xC3) + 1 if len(raw) > 1 else np.zeros(0, np.int64)
        capital = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]
        plain[capital] += 0x20
        starts = np.flatnonzero(letter[1:] & (~letter[:-1] | cut))
        ends = np.flatnonzero(letter[:-1] & (~letter[1:] | cut))
        starts = starts[starts < len(raw)]
        up, down = powers(1 << max(20, len(raw).bit_length()))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((plain.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        bounds = np.searchsorted(starts, offsets)
        of_word = np.repeat(np.arange(b - a), np.diff(bounds))
        length, undo, base = ends - starts, down[starts], sums[starts]
        whole = mixed((sums[ends] - base) * undo + length.astype(np.uint64))
        features, owners = [], []
        for k in (0, *BEGINNINGS):
            at = slice(None) if k == 0 else np.flatnonzero(length > k)
            h = whole if k == 0 else mixed((sums[starts[at] + k] - base[at]) * undo[at] + np.uint64(1000 + k))
            own = of_word[at]
            if only is not None:
                keep = only[h & np.uint64((1 << BUCKET_BITS) - 1)]
                h, own = h[keep], own[keep]
            features.append(h)
            owners.append(own)
        f, o = np.concatenate(features), np.concatenate(owners)
        order = np.lexsort((f, o))
        f, o = f[order], o[order]
        new = np.ones(len(f), bool)
        if len(f):
            new[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
        got = Read(a, b - a, o[new], f[new], np.diff(bounds))
        if patterns:
            got.counts = {"letters": _run_sums(_LETTERS[raw], offsets), "upper": _run_sums(_UPPER[raw], offsets), "marks": _run_sums(_MARKS[raw], offsets), "symbols": _run_sums(_SYMBOLS[raw], offsets), "odd": _run_sums(odd & ~_DIGIT[raw], offsets)}
            order = np.lexsort((whole, of_word))
            h, o = whole[order], of_word[order]
            edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))) if len(h) else np.zeros(0, np.int64)
            size = np.diff(np.append(edge, len(h)))
            got.counts["commonest"] = np.zeros(b - a, np.int64)
            np.maximum.at(got.counts["commonest"], o[edge], size)
            got.counts["address"] = np.bincount(of_word[np.isin(whole, _address())], minlength=b - a)
        yield got


def _address(held: list = []) -> np.ndarray:  # noqa: B006  kept between calls
    if not held:
        held.append(np.unique(np.array([_whole(w) for w in ADDRESS], np.uint64)))
    return held[0]


def _whole(word: str) -> int:
    """The hash of a whole word, as read_texts makes it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    up, _ = powers(1 << 20)
    return int(mixed(np.array([((_PLAIN[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)]).sum(dtype=np.uint64) + np.uint64(len(raw))], np.uint64))[0])


def pattern_votes(r: Read) -> np.ndarray:
    """A row for each text, a column for each of PATTERNS: 1 toxic, -1 clean, 0 abstains."""
    c, n = r.counts, r.words
    loud = np.where(c["letters"] < 20, 0, np.where(2 * c["upper"] > c["letters"], 1, np.where(50 * c["upper"] < c["letters"], -1, 0)))
    marks = np.where(n < 10, 0, np.where(5 * c["marks"] > n, 1, np.where(c["marks"] == 0, -1, 0)))
    symbols = np.where(n < 10, 0, np.where(4 * c["symbols"] > n, 1, 0))
    odd = np.where(50 * c["odd"] > np.maximum(n, 1), 1, 0)
    address = np.where(n < 10, 0, np.where(20 * c["address"] > n, 1, np.where(c["address"] == 0, -1, 0)))
    again = np.where(n < 10, 0, np.where(2 * c["commonest"] > n, 1, 0))
    sizes = [np.where((n >= lo) & (n < hi), -1, 0) for lo, hi in ((0, 30), (30, 200), (200, 1 << 60))]
    return np.stack([loud, marks, symbols, odd, address, again, *sizes], axis=1).astype(np.int8)


def _training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text and toxic of at most about `max_rows` labelled rows, drawn by a hash of doc_id; rows of fold 0 stay out."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    drawn = own.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_rows / max(n, 1))))
    # bounded by max_rows: a few hundred kB
    return written(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "toxicity-rows")


def propose_entries(rows: DataFrame) -> dict[int, int]:
    """Lexicon entries (feature hashes) and what they say: 1 toxic, -1 clean; the clearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.array(b.column("toxic").to_numpy(zero_copy_only=False), np.int64)
            for r in read_texts(text_column(b, "text")):
                f, at = np.unique(r.feature, return_inverse=True)
                pos = np.bincount(at, y[r.first + r.row], minlength=len(f)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"feature": pa.array(f.view(np.int64)), "pos": pos, "all": np.bincount(at, minlength=len(f))})

    n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos"), F.count(F.lit(1)).alias("all")).first()
    p, q = float(n["pos"]), float(n["all"] - n["pos"])
    if not p or not q:
        return {}
    sums = rows.mapInArrow(run, "feature long, pos long, all long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("all").alias("all"))
    pos, neg = F.col("pos").cast("double"), (F.col("all") - F.col("pos")).cast("double")
    share = F.col("all") / F.lit(p + q)
    part = lambda x, of: F.when(x > 0, x * F.ln(x / (share * of))).otherwise(0.0)
    g = 2 * (part(pos, p) + part(neg, q))
    lift = ((pos + 0.1) / F.lit(p + 0.2)) / ((neg + 0.1) / F.lit(q + 0.2))
    says = F.when((lift >= LEAST_LIFT) & (F.col("pos") >= LEAST_SUPPORT), 1).when((lift <= 1 / LEAST_LIFT) & (neg >= LEAST_SUPPORT), -1)
    best = sums.withColumn("g", g).withColumn("says", says).filter(F.col("says").isNotNull() & (F.col("g") >= LEAST_G))
    return {r["feature"]: r["says"] for r in best.orderBy(F.desc("g"), "feature").limit(MAX_ENTRIES).collect()}


def _fired(rows: DataFrame, entries: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of firings (entries by bit, then pattern votes) with how often each label has them: bounded by the
    sample, and texts alike in all of them are one row."""
    order = np.argsort(np.array(entries, np.int64).view(np.uint64))
    known = np.array(entries, np.int64).view(np.uint64)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, pattern = [], []
            for r in read_texts(text_column(b, "text"), patterns=True):
                bits = np.zeros((r.rows, len(known)), np.uint8)
                at = np.minimum(np.searchsorted(known, r.feature), len(known) - 1)
                same = known[at] == r.feature
                bits[r.row[same], order[at[same]]] = 1
                hit += [x.tobytes() for x in np.packbits(bits, axis=1)]
                pattern += [x.tobytes() for x in pattern_votes(r)]
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.binary()), pa.array(pattern, pa.binary()), b.column("toxic")], names=["fired", "pattern", "toxic"])

    got = rows.mapInArrow(run, "fired binary, pattern binary, toxic int").groupBy("fired", "pattern").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("all")).collect()
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(r["fired"]) for r in got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(known)]
    pattern = np.frombuffer(b"".join(bytes(r["pattern"]) for r in got), np.int8).reshape(len(got), -1)
    return bits, pattern, np.array([r["pos"] for r in got], np.float64), np.array([r["all"] for r in got], np.float64)


def grouped(bits: np.ndarray, pos: np.ndarray, times: np.ndarray, says: np.ndarray, most: int = MAX_VOTERS) -> np.ndarray:
    """The voter of each entry (-1: none), entries in order of clearness.

    One that owes its lift to an earlier one (a beginning that clean words share with a toxic word) is no voter: where the
    other doesn't fire, it must be right more often than not. One that fires on nearly the rows of an earlier one joins it.
    """
    of = np.full(bits.shape[1], -1)
    heads: list[int] = []
    size = times @ bits
    x = bits.astype(np.float64)
    for k in range(bits.shape[1]):
        if heads:
            both = (times * x[:, k]) @ x[:, heads]
            near = [h for h, m in zip(heads, both, strict=True) if 2 * m >= min(size[k], size[h])]
            alone = x[:, k] * ~bits[:, near].any(axis=1) if near else x[:, k]
            right = alone @ (pos if says[k] > 0 else times - pos)
            if 2 * right < times @ alone:
                continue
            like = both / np.maximum(size[k], size[heads]) * (says[heads] == says[k])
            if like.max() >= SAME_VOTER:
                of[k] = int(like.argmax())
                continue
        if len(heads) < most:
            of[k] = len(heads)
            heads.append(k)
    return of


@dataclass
class LabelModel:
    """What is known of each voter: the chance of a vote for toxic and for clean, by class, and its share of a vote."""

    prior: float
    rates: np.ndarray  # class (toxic, clean), vote (toxic, clean), voter
    share: np.ndarray

    def accuracy(self) -> np.ndarray:
        """The chance that a voter's vote, if it gives one, is right."""
        right = self.prior * self.rates[0, 0] + (1 - self.prior) * self.rates[1, 1]
        return right / (right + self.prior * self.rates[0, 1] + (1 - self.prior) * self.rates[1, 0])

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic for rows of votes (1, -1, 0); who abstains says nothing: toxic texts of one language don't fire the
        lexicons of another."""
        say = np.log(self.rates[0] / self.rates[1])
        return np.log(self.prior / (1 - self.prior)) + (votes == 1) @ (self.share * say[0]) + (votes == -1) @ (self.share * say[1])


def label_model(votes: np.ndarray, pos: np.ndarray, times: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, LabelModel]:
    """Posterior of each row of votes, and the model, by expectation maximisation.

    The first posteriors are the share of toxic labels among a row's texts, and the share of the classes is that of the labels;
    from then on the labels only check it: a voter's false votes are not taken for rarer than the labels show. Correlations are those of the votes' residuals within a class; a voter's share is one over the
    sum of its correlations of DEPENDENT or more with voters that vote where it does, its own included.
    """
    post = given = pos / times
    clean_rows = times - pos
    voting = np.abs(votes).astype(np.float64)
    both = (voting * times[:, None]).T @ voting
    together = 2 * both >= np.minimum.outer(np.diag(both), np.diag(both))
    signed = votes.astype(np.float64)
    prior = float(np.clip((times * given).sum() / times.sum(), 1e-3, 0.5))
    toxic, clean = (votes == 1).astype(np.float64), (votes == -1).astype(np.float64)
    for _ in range(rounds):
        rates = np.empty((2, 2, votes.shape[1]))
        for c, w in enumerate((times * post, times * (1 - post))):
            like_all = w.sum() / times.sum()  # one further vote either way, at the same rate in both classes
            rates[c] = np.array([w @ toxic + like_all, w @ clean + like_all]) / (w.sum() + 2)
        shown = (np.array([clean_rows @ toxic, pos @ clean]) + 0.1) / (np.array([clean_rows.sum(), pos.sum()]) + 1)[:, None]
        rates[1, 0], rates[0, 1] = np.maximum(rates[1, 0], shown[0]), np.maximum(rates[0, 1], shown[1])
        mean = np.outer(post, rates[0, 0] - rates[0, 1]) + np.outer(1 - post, rates[1, 0] - rates[1, 1])
        left = (signed - mean) * np.sqrt(times / times.sum())[:, None]
        cov = left.T @ left
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        like = np.clip(cov / np.outer(scale, scale), 0, 1)
        share = 1 / np.maximum(1.0, np.where((like >= DEPENDENT) & together, like, 0).sum(axis=1))
        model = LabelModel(prior, rates, share)
        post = 1 / (1 + np.exp(-np.clip(model.odds(votes), -30, 30)))
    return post, model


def posteriors(rows: DataFrame) -> tuple[DataFrame, LabelModel | None]:
    """text and target (the label model's posterior) of the training rows; the model is None if no lexicon can be told."""
    entries = propose_entries(rows)
    if not entries:
        return rows.select("text", F.lit(0.02).alias("target")), None
    says = np.array(list(entries.values()), np.int8)
    bits, pattern, pos, times = _fired(rows, list(entries))
    of = grouped(bits, pos, times, says)
    heads = int(of.max()) + 1
    member = (of[:, None] == np.arange(heads)[None, :]).astype(np.float32)
    voter_says = np.array([says[of == v][0] for v in range(heads)], np.int8)

    def cast(bits: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        fired = bits.astype(np.float32) @ member > 0
        silent = ~fired[:, voter_says > 0].any(axis=1, keepdims=True)  # no toxic lexicon fires: a vote for clean
        return np.hstack([fired * voter_says, -1 * silent, pattern]).astype(np.int8)

    _, model = label_model(cast(bits, pattern), pos, times)
    order = np.argsort(np.array(list(entries), np.int64).view(np.uint64))
    known = np.array(list(entries), np.int64).view(np.uint64)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in read_texts(text_column(b, "text"), patterns=True):
                fired = np.zeros((r.rows, len(known)), np.uint8)
                at = np.minimum(np.searchsorted(known, r.feature), len(known) - 1)
                same = known[at] == r.feature
                fired[r.row[same], order[at[same]]] = 1
                odds = model.odds(cast(fired, pattern_votes(r)))
                out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column("text"), pa.array(np.concatenate(out) if out else [], pa.float64())], names=["text", "target"])

    return rows.mapInArrow(run, "text string, target double"), model


def fit_linear(at: np.ndarray, row: np.ndarray, target: np.ndarray, n_features: int, ridge: float = 0.8, steps: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over 0/1 features in (row, feature) pairs, by Newton's method with conjugate gradients."""
    n, d = len(target), n_features + 1
    hold = np.full(d, ridge)
    hold[-1] = 1e-3
    forward = lambda v: np.bincount(row, v[at], minlength=n) + v[-1]
    back = lambda g: np.append(np.bincount(at, g[row], minlength=n_features), g.sum())
    w = np.zeros(d)
    mean = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    w[-1] = np.log(mean / (1 - mean))

    def loss(v: np.ndarray) -> float:
        z = forward(v)
        return float((np.logaddexp(0, z) - target * z).sum() + 0.5 * (hold * v * v).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        gradient = back(p - target) + hold * w
        curve = p * (1 - p)
        inverse = 1 / (np.append(np.bincount(at, curve[row], minlength=n_features), curve.sum()) + hold)
        x, r = np.zeros(d), -gradient
        y = inverse * r
        direction, ry = y.copy(), float(r @ y)
        for _ in range(15):
            hd = back(curve * forward(direction)) + hold * direction
            step = ry / float(direction @ hd)
            x += step * direction
            r -= step * hd
            if np.abs(r).max() < 0.05 * np.abs(gradient).max():
                break
            y = inverse * r
            before, ry = ry, float(r @ y)
            direction = y + ry / before * direction
        size = 1.0
        while (after := loss(w + size * x)) > now and size > 1e-3:
            size /= 2
        if now - after < 1e-6 * abs(now):
            break
        w, now = w + size * x, after
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights and the intercept of the classifier. Without a lexicon every score is low.

    The bounded sample of labelled rows is read by tasks; the classifier is fitted in one task over the sample's pairs of row
    and feature, of which the MAX_FEATURES clearest are kept. The driver gets weights only.
    """
    small_batches(docs.sparkSession)
    targets, model = posteriors(_training_rows(docs, labels, max_rows))
    if model is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), -4.0
    rows = written(targets, "toxicity-targets")
    buckets = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_held()
        pos, every = np.zeros(buckets), np.zeros(buckets)
        for b in batches:
            y = b.column("target").to_numpy(zero_copy_only=False)
            for r in read_texts(text_column(b, "text")):
                k = (r.feature & np.uint64(buckets - 1)).astype(np.int64)
                pos += np.bincount(k, y[r.first + r.row], minlength=buckets)
                every += np.bincount(k, minlength=buckets)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "pos": pos[at], "all": every[at]})

    sums = rows.mapInArrow(count, "bucket int, pos double, all double").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("all").alias("all")).filter("all >= 3")
    mean = rows.agg(F.avg("target")).first()[0]
    apart = F.abs(F.col("pos") - F.col("all") * mean) / F.sqrt(F.col("all"))
    kept = np.sort(np.array([r[0] for r in sums.orderBy(F.desc(apart), "bucket").limit(MAX_FEATURES).select("bucket").collect()], np.int32))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = np.zeros(buckets, bool)
        only[kept] = True
        for b in batches:
            own: list[bytes] = [b""] * b.num_rows
            for r in read_texts(text_column(b, "text"), only=only):
                at = np.searchsorted(kept, (r.feature & np.uint64(buckets - 1)).astype(np.int32)).astype(np.int32)
                edges = np.searchsorted(r.row, np.arange(r.rows + 1))
                for k in range(r.rows):
                    own[r.first + k] = np.unique(at[edges[k] : edges[k + 1]]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), b.column("target")], names=["features", "target"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = [], []
        for b in batches:
            raw += [np.frombuffer(x, np.int32) for x in b.column("features").to_pylist()]
            target.append(b.column("target").to_numpy(zero_copy_only=False))
        if raw:
            w, base = fit_linear(np.concatenate(raw), np.repeat(np.arange(len(raw)), [len(x) for x in raw]), np.concatenate(target), len(kept))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1, *kept.tolist()], pa.int32()), "weight": pa.array([base, *w.tolist()], pa.float64())})

    given = rows.mapInArrow(pairs, "features binary, target double").repartition(1).sortWithinPartitions("features", "target")
    got = {r["bucket"]: r["weight"] for r in given.mapInArrow(solve, "bucket int, weight double").collect()}
    base = got.pop(-1, -4.0)
    return np.array(list(got), np.int32), np.array(list(got.values()), np.float32), base


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`carry` (doc_id if not given) and score (0 to 1) of every row.

    Null and empty texts get the score of a text without words. A text is read whole, however long, and by itself: equal
    texts and repeated rows score alike, and no ties arise. An empty table gives no rows. Columns that aren't carried don't
    matter; a carried column named score gives way to the result's.
    """
    small_batches(docs.sparkSession)
    at, weight, base = model
    keep = [c for c in ([doc_id] if carry is None else carry) if c.lower() != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_held()
        buckets = 1 << BUCKET_BITS
        weights = np.zeros(buckets)
        weights[at] = weight
        only = weights != 0
        for b in batches:
            odds = np.full(b.num_rows, base)
            for r in read_texts(text_column(b, text), only=only):
                pair = np.unique(r.row.astype(np.int64) << BUCKET_BITS | (r.feature & np.uint64(buckets - 1)).astype(np.int64))
                odds[r.first : r.first + r.rows] += np.bincount(pair >> BUCKET_BITS, weights[pair & (buckets - 1)], minlength=r.rows)
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))), pa.float64())], names=[*keep, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    need = docs.select(*dict.fromkeys([*keep, text]))
    return need.mapInArrow(run, f"{kinds}, score double")


def keep_civil(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, every column kept (whatever its name), that score below one half; null and empty texts stay, and
    repeated rows stay or go together. An empty table gives no rows."""
    score = "toxicity score"  # no name that a table is likely to have
    got = score_documents(docs.withColumn(f"{score} row", F.struct(*docs.columns)), fit(docs, labels), text=text, carry=[f"{score} row"])
    return got.filter(F.col("score") < 0.5).select(f"{score} row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model fitted on four folds of the labels."""
    docs = table(spark, sf_dir, "documents")
    got = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

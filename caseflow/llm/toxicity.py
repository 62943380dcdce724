"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents. Token labels come from them: word and word-part features that occur in significantly more toxic documents
than clean ones make a lexicon, and words of toxic documents with a strong lexicon feature are the toxic tokens. A two-label chain with feature weights
and transitions is fitted to these sequences by gradient steps on the likelihood. Scoring runs forward-backward over each whole text;
the marginals give the offending words with their offsets; the greatest, the expected number and the share of toxic words give the document's score.

A fitted chain is a dict of plain numbers (``weights``: feature to weight, ``bias``, ``moves``: two rows of two, ``document``: four numbers). Tasks get it as a
broadcast and build their tagger from it, so that executors need no copy of this package.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.shared import fresh_name

WORD = re.compile(r"\w+")
#: Bounds of the labelled sample the model is fitted on: documents of each label, and windows of one document. Texts of up to WINDOWS * WINDOW_WORDS words are taken
#: whole; of longer ones so many windows, spread evenly over the whole text.
SAMPLE_DOCS, WINDOWS, WINDOW_WORDS = 1500, 8, 256
MAX_FEATURES = 16384
#: A lexicon feature: in at least this many toxic documents, this many standard errors and this log-odds above clean ones; strong from the last on.
MIN_DOCS, MIN_ERRORS, MIN_LIFT, STRONG_LIFT = 4, 3.5, 1.0, 2.0
STEPS, RATE, RIDGE = 40, 0.3, 1e-3
#: Words whose odds a task remembers, texts tagged before their results leave the task, sequences that one matrix of the fit holds.
CACHE_ROWS, SLICE_ROWS, FIT_SEQUENCES = 100_000, 256, 1024


def word_features(word: str) -> list[str]:
    """The word, its beginnings and its end, in small letters."""
    w = word.lower()
    return [f"={w}", *(f"^{w[:k]}" for k in (3, 4, 5, 6, 7) if len(w) > k), *(f"{w[-4:]}$" for _ in "1" if len(w) > 4)]


def text_windows(text: str | None) -> tuple[list[str], int]:
    """The windows of a text that teach, and its number of words."""
    places = [m.span() for m in WORD.finditer(text or "")]
    starts = range(0, len(places), WINDOW_WORDS)
    if len(starts) > WINDOWS:
        starts = [round(i * (len(places) - WINDOW_WORDS) / (WINDOWS - 1)) for i in range(WINDOWS)]
    return [text[places[at][0] : places[min(at + WINDOW_WORDS, len(places)) - 1][1]] for at in starts], len(places)


def lexicon(seen: list[dict[str, int]], n: list[int]) -> dict[str, float]:
    """Log-odds of the features that mark toxic documents; seen[y][f] of n[y] documents of label y hold f."""
    lifts = {}
    for f, ones in seen[1].items():
        zeros = seen[0].get(f, 0)
        share = (ones + zeros) / (n[0] + n[1])
        error = math.sqrt(max(share * (1 - share), 1e-9) * (1 / n[0] + 1 / n[1]))
        lift = math.log((ones + 0.5) / (n[1] + 1)) - math.log((zeros + 0.5) / (n[0] + 1))
        if ones >= MIN_DOCS and lift >= MIN_LIFT and (ones / n[1] - zeros / n[0]) >= MIN_ERRORS * error:
            lifts[f] = lift
    return dict(sorted(lifts.items(), key=lambda x: (-x[1] * seen[1][x[0]], x[0]))[:MAX_FEATURES])


def tagger(model: dict):
    """A function from a text to (score, spans) by a fitted chain; a span is (start, stop, marginal)."""
    weights, bias = model["weights"], model["bias"]

    class Odds(dict):
        def __missing__(self, word: str) -> float:
            value = math.exp(max(-30.0, min(30.0, bias + sum(weights.get(f, 0.0) for f in word_features(word)))))
            if len(self) >= CACHE_ROWS:
                self.clear()
            self[word] = value
            return value

    odds = Odds()
    (stay_clean, to_toxic), (to_clean, stay_toxic) = [[math.exp(x) for x in row] for row in model["moves"]]
    level, peak, mass, share = model["document"]

    def tag(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        evidence = list(map(odds.__getitem__, WORD.findall(text))) if text else []
        ahead, o = [], None  # odds of toxic against clean given the words up to here
        for e in evidence:
            o = e if o is None else e * (to_toxic + stay_toxic * o) / (stay_clean + to_clean * o)
            ahead.append(o)
        best, expected, toxic, behind = 0.0, 0.0, [], 1.0
        for at in range(len(evidence) - 1, -1, -1):
            o = ahead[at] * behind
            if o > best:
                best = o
            expected += o / (1 + o)
            if o >= 1:
                toxic.append((at, o / (1 + o)))
            o = behind * evidence[at]
            behind = (to_clean + stay_toxic * o) / (stay_clean + to_toxic * o)
        z = level + peak * max(-12.0, min(12.0, math.log(best) if best > 0 else -12.0)) + mass * math.log(1e-3 + expected) + share * math.log((1e-3 + expected) / (10 + len(evidence)))
        spans = []
        if toxic:
            places = [m.span() for m in WORD.finditer(text)]
            spans = [(*places[at], p) for at, p in reversed(toxic)]
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z)))), spans

    return tag


def _forward_backward(evidence: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of toxic, and expected moves, of many sequences at once. evidence: (longest, documents) log-odds; documents by falling length."""
    steps, docs = evidence.shape
    e, t = np.exp(np.clip(evidence, -30, 30)), np.exp(moves)
    alive = [int((lengths > i).sum()) for i in range(steps)]
    ahead, behind = np.ones((steps, docs)), np.ones((steps, docs))
    ahead[0] = e[0]
    for i in range(1, steps):
        k = alive[i]
        p = ahead[i - 1, :k]
        ahead[i, :k] = e[i, :k] * (t[0, 1] + t[1, 1] * p) / (t[0, 0] + t[1, 0] * p)
    for i in range(steps - 2, -1, -1):
        k = alive[i + 1]
        n = behind[i + 1, :k] * e[i + 1, :k]
        behind[i, :k] = (t[1, 0] + t[1, 1] * n) / (t[0, 0] + t[0, 1] * n)
    real = np.arange(steps)[:, None] < lengths
    o = np.where(real, ahead * behind, 0.0)
    marginal = o / (1 + o)
    a, n = ahead[:-1], (behind * e)[1:]
    whole = t[0, 0] + t[0, 1] * n + t[1, 0] * a + t[1, 1] * a * n
    share = np.where(real[1:], 1 / whole, 0.0)
    return marginal, t * np.array([[share.sum(), (share * n).sum()], [(share * a).sum(), (share * a * n).sum()]])


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps that are halved until the loss falls; the first column is the constant."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    middle[0], spread[0] = 0.0, 1.0
    z, held = (x - middle) / spread, np.array([0.01, *[1.0] * (x.shape[1] - 1)]) * ridge

    def loss(b: np.ndarray) -> float:
        m = z @ b
        return float(w @ (np.logaddexp(0, m) - y * m) + 0.5 * held @ b**2)

    beta = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
        step = np.linalg.solve((z * (w * q * (1 - q))[:, None]).T @ z + np.diag(held), z.T @ (w * (y - q)) - held * beta)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
    beta = beta / spread
    beta[0] -= beta[1:] @ middle[1:]
    return beta


def fit_chain(docs: list[tuple[list[str], int, int]], class_rows: tuple[int, int]) -> dict:
    """Fits the chain to labelled texts (windows, words of the whole text, label); ``class_rows`` are the labelled clean and toxic rows the sample stands for."""
    taught, number = {}, {}
    for windows, words, y in docs:
        if words:
            taught.setdefault("\n".join(windows), (windows, words, y))
    ids, owner, total, y = [], [], [], []
    for windows, words, label in taught.values():
        for window in windows:
            ids.append(np.array([number.setdefault(w, len(number)) for w in WORD.findall(window)], np.int32))
            owner.append(len(y))
        total.append(words)
        y.append(label)
    del taught
    if len(set(y)) < 2:  # nothing to tell apart: every text scores the share of toxic rows
        share = (class_rows[1] + 0.5) / (sum(class_rows) + 1)
        return {"weights": {}, "bias": -5.0, "moves": [[0.0, 0.0], [0.0, 0.0]], "document": [math.log(share / (1 - share)), 0.0, 0.0, 0.0]}
    feature: dict[str, int] = {}
    parts = [np.array([feature.setdefault(f, len(feature)) for f in word_features(w)], np.int32) for w in number]
    names = list(feature)
    n = [y.count(k) for k in (0, 1)]
    seen = np.zeros((2, len(names)), np.int64)
    whole: list[list[np.ndarray]] = [[] for _ in y]
    for x, j in zip(ids, owner, strict=True):
        whole[j].append(x)
    for some, label in zip(whole, y, strict=True):
        seen[label, np.unique(np.concatenate([parts[i] for i in np.unique(np.concatenate(some))]))] += 1
    lifts = lexicon([{f: int(c) for f, c in zip(names, row, strict=True) if c >= MIN_DOCS or k == 0} for k, row in enumerate(seen)], n)
    kept, strong = list(lifts), {f for f, lift in lifts.items() if lift >= STRONG_LIFT}
    place = np.full(len(names), -1)
    place[[feature[f] for f in kept]] = np.arange(len(kept))
    word_of = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    col_of = place[np.concatenate(parts)]
    word_of, col_of = word_of[col_of >= 0], col_of[col_of >= 0]
    marked = np.bincount(word_of, np.array([f in strong for f in kept] or [False])[col_of], len(parts)) > 0
    del parts, names, feature, seen, whole

    # sequences by falling length, in matrices of bounded width
    order = sorted(range(len(ids)), key=lambda j: -len(ids[j]))
    blocks, gold_words, gold_moves, gold_total = [], np.zeros(len(number)), np.zeros((2, 2)), 0.0
    for at in range(0, len(order), FIT_SEQUENCES):
        some = order[at : at + FIT_SEQUENCES]
        lengths = np.array([len(ids[j]) for j in some])
        grid, gold = np.zeros((int(lengths[0]), len(some)), np.int32), np.zeros((int(lengths[0]), len(some)), np.int8)
        for k, j in enumerate(some):
            grid[: len(ids[j]), k] = ids[j]
            gold[: len(ids[j]), k] = marked[ids[j]] * y[owner[j]]
        real = np.arange(len(grid))[:, None] < lengths
        gold_words += np.bincount(grid[real], gold[real], len(number))
        gold_moves += np.bincount(gold[:-1][real[1:]].astype(int) * 2 + gold[1:][real[1:]], minlength=4).reshape(2, 2)
        gold_total += float(gold[real].sum())
        blocks.append((grid, real, lengths, np.array([owner[j] for j in some])))
    del ids

    weights, bias, moves = np.zeros(len(kept)), -5.0, np.zeros((2, 2))
    scale = max(1.0, gold_total)
    slow, fast = np.zeros(len(kept) + 5), np.zeros(len(kept) + 5)
    best, expected, read = np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(y))
    for step in range(1, STEPS + 1):
        per_word = (np.bincount(word_of, weights[col_of], len(number)) if kept else np.zeros(len(number))) + bias
        off, joint = gold_words.copy(), np.zeros((2, 2))
        for grid, real, lengths, owners in blocks:
            marginal, moved = _forward_backward(np.where(real, per_word[grid], 0.0), moves, lengths)
            off -= np.bincount(grid[real], marginal[real], len(number))
            joint += moved
            if step == STEPS:
                np.maximum.at(best, owners, marginal.max(axis=0))
                np.add.at(expected, owners, marginal.sum(axis=0))
                np.add.at(read, owners, lengths)
        slope = np.concatenate([np.bincount(col_of, off[word_of], len(kept)) if kept else [], [off.sum()], (gold_moves - joint).ravel()]) / scale
        slope[: len(kept)] -= RIDGE * weights
        slope[-4:] -= RIDGE * moves.ravel()
        slow, fast = 0.9 * slow + 0.1 * slope, 0.99 * fast + 0.01 * slope**2
        move = RATE * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.99**step)) + 1e-8)
        if step < STEPS:  # the last step only reads the marginals
            weights, bias, moves = weights + move[: len(kept)], bias + move[len(kept)], moves + move[-4:].reshape(2, 2)

    # the document's score: logistic in the greatest log-odds and the expected number of toxic words, at the true share of labels
    p, truth = np.clip(best, 1e-9, 1 - 1e-9), np.array(y, dtype=float)
    words = np.array(total, dtype=float)
    expected = expected * words / read  # of a text that was not read whole: carried on to all of it
    x = np.column_stack([np.ones(len(y)), np.clip(np.log(p / (1 - p)), -12, 12), np.log(1e-3 + expected), np.log((1e-3 + expected) / (10 + words))])
    w = np.where(truth == 1, class_rows[1] / max(n[1], 1), class_rows[0] / max(n[0], 1))
    beta = fit_logistic(x, truth, w / w.mean())
    return {"weights": {f: float(v) for f, v in zip(kept, weights, strict=True) if abs(v) > 1e-6}, "bias": float(bias), "moves": moves.tolist(), "document": beta.tolist()}


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Fits a chain on at most SAMPLE_DOCS labelled documents of each label, picked by a hash of the id among rows not held out.

    Tasks cut the picked texts to windows, so that what reaches the driver is bounded however long a text is. Null labels are no labels; of an id labelled twice the higher
    label counts; null and empty texts teach nothing; no labels at all give a model that scores every text alike.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    marked = marked.groupBy("id").agg(F.max("y").alias("y"))
    rows = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        one = marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
        picked = one if picked is None else picked.unionByName(one)

    @F.pandas_udf("windows array<string>, words long")
    def cut(texts: pd.Series) -> pd.DataFrame:
        found = [text_windows(t) for t in texts]
        return pd.DataFrame({"windows": pd.Series([w for w, _ in found], dtype="object"), "words": pd.Series([n for _, n in found], dtype="int64")})

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(picked), "id").withColumn("s", cut("t"))
    sample = texts.select("id", "y", "s.windows", "s.words").orderBy("id", F.hash("windows")).limit(2 * SAMPLE_DOCS).select("windows", "words", "y").collect()
    return fit_chain([tuple(r) for r in sample], (rows.get(0, 0), rows.get(1, 0)))


def score_toxicity(docs: DataFrame, model: dict, *, text_col: str = "text", prefix: str = "toxic_") -> DataFrame:
    """Adds ``{prefix}score`` (0 to 1) and ``{prefix}spans`` (start, stop, marginal of each offending word) to ``docs``.

    Null and empty texts get the score of a text without evidence. Repeated rows are scored each; an empty table stays empty; columns of these names are replaced, all others kept.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<struct<start:long,stop:long,marginal:double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tag = tagger(shipped.value)
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                rows = [tag(t) for t in batch.iloc[at : at + SLICE_ROWS]]
                spans = [[{"start": a, "stop": b, "marginal": p} for a, b, p in s] for _, s in rows]
                yield pd.DataFrame({"score": pd.Series([r[0] for r in rows], dtype="float64"), "spans": pd.Series(spans, dtype="object")})

    found = fresh_name(docs, "toxicity")
    out = docs.withColumn(found, scored(F.col(text_col)))
    return out.withColumns({f"{prefix}score": F.col(f"{found}.score"), f"{prefix}spans": F.col(f"{found}.spans")}).drop(found)

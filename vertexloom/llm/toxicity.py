"""A toxicity classifier regularised by counterfactuals: swapping identity terms must not move the score."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import Words, bounded, cut, drop_cut, fold, held, trim
from vertexloom.llm.tokens import _slices

#: Groups of terms that name people by who they are; terms of one line are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)


@dataclass(frozen=True)
class Bounds:
    """What is learned from: per_class labelled documents of each label, those with the lowest hash, as long as they have at
    most `chars` characters together. features: so many are kept, the most telling ones met in at least `least` documents.
    heads: words also count by their first bytes. fairness and decay weigh the penalties; rounds: the most steps of the
    fit. The bias is moved until, on `folds` folds of the learning rows, the share `recall` of the toxic ones is found at
    score 0.5, but not so far that more than the share `alarms` of the others is."""

    per_class: int = 3000
    chars: int = 1 << 23
    features: int = 1024
    least: int = 4
    heads: tuple[int, ...] = (4, 6)
    fairness: float = 1.0
    decay: float = 1e-5
    rounds: int = 200
    folds: int = 5
    recall: float = 0.9
    alarms: float = 0.02


def features(texts: list[str], heads: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) for each word of each text, and for its heads where the word is longer."""
    data = [x.encode("utf-8", "replace") for x in texts]
    w = Words(b" ".join(data))
    ends = np.cumsum([len(x) + 1 for x in data])
    owner = np.searchsorted(ends, w.starts, side="right")
    # punctuation at a word's end isn't part of it
    core = w.ends.copy()
    b = np.frombuffer(b" ".join(data), np.uint8) if data else np.zeros(0, np.uint8)
    stop = np.isin(b, np.frombuffer(b".,;:!?\"')(", np.uint8))
    for _ in range(3):
        core -= (core > w.starts + 1) & stop[np.maximum(core - 1, 0)]
    texts_, hashes = [owner], [w.hashes(core)]
    for k in heads:
        longer = core - w.starts > k
        texts_.append(owner[longer])
        hashes.append((w.hashes(np.minimum(core, w.starts + k)) ^ np.uint64(k))[longer])
    return np.concatenate(texts_), np.concatenate(hashes)


_AFTER = {t: line[(i + 1) % len(line)] for line in IDENTITY_TERMS for i, t in enumerate(line)}
_TERM = re.compile(r"(?<![^\x20\x09-\x0D.,;:!?\"'()])(" + "|".join(sorted(map(re.escape, _AFTER), key=len, reverse=True)) + r")(?![^\x20\x09-\x0D.,;:!?\"'()])", re.IGNORECASE)


def counterfactual(text: str) -> str | None:
    """The text with each identity term swapped for the next of its line; None where there is none. A term stands between
    white space or marks; all else stays as it is."""
    swapped, n = _TERM.subn(lambda m: _AFTER.get(m[1].lower(), m[1]), text)
    return swapped if n else None


@dataclass
class Model:
    """Logistic regression on the presence of features (sorted hashes)."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    heads: tuple[int, ...]

    def logits(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.hashes) and texts:
            at, k = _known(texts, self.hashes, self.heads)
            z += np.bincount(at, weights=self.weights[k], minlength=len(texts))
        return z

    def score(self, texts: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(texts), -500, 500)))


def _known(texts: list[str], hashes: np.ndarray, heads: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs among the kept features."""
    at, h = features(texts, heads)
    k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    hit = hashes[k] == h
    pair = np.unique(at[hit] * np.int64(len(hashes)) + k[hit])
    return pair // len(hashes), pair % len(hashes)


def _presence(texts: list[str], heads: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature hash) pairs of all texts, found part by part."""
    at, h = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    for lo in range(0, len(texts), 128):
        a, b = features(texts[lo : lo + 128], heads)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at.append((a[first] + lo).astype(np.int32))
        h.append(b[first])
    return np.concatenate(at), np.concatenate(h)


class Sample:
    """Learning rows as presence pairs (row, code), with those of the counterfactuals of rows with an identity term.

    Codes are places in `hashes`, sorted: features met in at least `least` rows, and identity terms that occur.
    """

    def __init__(self, texts: list[str], toxic: np.ndarray, bounds: Bounds):
        self.y, self.bounds = np.asarray(toxic, float), bounds
        at, h = _presence(texts, bounds.heads)
        names = np.unique(np.concatenate([features([t], ())[1] for t in _AFTER]))
        slots = np.uint64((1 << 22) - 1)  # a counter of a few hashes is no less than any of theirs
        often = np.bincount((h & slots).astype(np.int32), minlength=int(slots) + 1)[(h & slots).astype(np.int32)] >= bounds.least
        keep = often | np.isin(h, names)
        at, h = at[keep], h[keep]
        self.hashes, code = np.unique(h, return_inverse=True)
        n = np.bincount(code, minlength=len(self.hashes))
        self.names = np.isin(self.hashes, names)
        fine = (n >= bounds.least) | self.names
        self.hashes, self.names, self.rows, self.code = self.hashes[fine], self.names[fine], at[fine[code]], (np.cumsum(fine) - 1)[code[fine[code]]].astype(np.int32)
        swapped = [(i, s) for i, s in ((i, counterfactual(t)) for i, t in enumerate(texts)) if s is not None]
        self.pair = np.full(len(texts), -1, np.int32)  # the counterfactual of a row
        self.pair[[i for i, _ in swapped]] = np.arange(len(swapped))
        c_at, c_h = _presence([s for _, s in swapped], bounds.heads)
        place = np.minimum(np.searchsorted(self.hashes, c_h), max(0, len(self.hashes) - 1))
        known = self.hashes[place] == c_h if len(self.hashes) else np.zeros(len(c_h), bool)
        self.c_rows, self.c_code = c_at[known], place[known].astype(np.int32)

    def problem(self, use: np.ndarray, share: float) -> Problem | None:
        """What is minimised over the rows in `use` (a mask); None where there is nothing to learn from."""
        y, least = self.y, self.bounds.least
        if not use.any() or y[use].min() == y[use].max():
            return None
        own = use[self.rows]
        n1 = np.bincount(self.code[own], weights=y[self.rows[own]], minlength=len(self.hashes))
        n = np.bincount(self.code[own], minlength=len(self.hashes))
        p1, p0 = (n1 + 0.5) / (y[use].sum() + 1), (n - n1 + 0.5) / ((1 - y[use]).sum() + 1)
        telling = np.where(n >= least, np.abs(np.log(p1 / p0)) * np.abs(p1 - p0), 0.0)
        telling[self.names & (n > 0)] += 1e3  # identity terms are always among them, to be held down
        kept = np.sort(np.argsort(-telling, kind="stable")[: self.bounds.features])
        kept = kept[telling[kept] > 0]
        if not len(kept):
            return None
        column = np.full(len(self.hashes), -1, np.int32)
        column[kept] = np.arange(len(kept))
        row = (np.cumsum(use) - 1).astype(np.int32)
        own &= column[self.code] >= 0
        pairs = np.flatnonzero(use & (self.pair >= 0))
        gap = np.full(self.pair.max(initial=-1) + 1, -1, np.int32)
        gap[self.pair[pairs]] = np.arange(len(pairs))
        mine = own & (self.pair[self.rows] >= 0)
        other = (column[self.c_code] >= 0) & (gap[self.c_rows] >= 0)
        d_rows = np.concatenate([gap[self.pair[self.rows[mine]]], gap[self.c_rows[other]]])
        d_cols = np.concatenate([column[self.code[mine]], column[self.c_code[other]]])
        d_sign = np.concatenate([np.ones(int(mine.sum())), -np.ones(int(other.sum()))])
        y = y[use]
        each = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum()))
        return Problem(self.hashes[kept], y, each, row[self.rows[own]], column[self.code[own]], d_rows, d_cols, d_sign, len(pairs), self.bounds)


@dataclass
class Problem:
    """Presence pairs (rows, cols) of labelled texts, and the signed ones in which texts and counterfactuals differ."""

    hashes: np.ndarray
    y: np.ndarray
    each: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    d_rows: np.ndarray
    d_cols: np.ndarray
    d_sign: np.ndarray
    pairs: int
    bounds: Bounds

    def value(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The objective and its gradient; the bias is w's last place."""
        m = len(self.hashes)
        z = w[-1] + np.bincount(self.rows, weights=w[self.cols], minlength=len(self.y))
        loss = float((self.each * (np.logaddexp(0.0, z) - self.y * z)).sum()) + self.bounds.decay * float((w[:-1] ** 2).sum())
        g = (0.5 * (1.0 + np.tanh(0.5 * z)) - self.y) * self.each
        grad = np.append(np.bincount(self.cols, weights=g[self.rows], minlength=m) + 2 * self.bounds.decay * w[:-1], g.sum())
        if self.pairs:
            gap = np.bincount(self.d_rows, weights=w[self.d_cols] * self.d_sign, minlength=self.pairs)
            loss += self.bounds.fairness * float((gap**2).sum()) / self.pairs
            grad[:-1] += 2 * self.bounds.fairness / self.pairs * np.bincount(self.d_cols, weights=gap[self.d_rows] * self.d_sign, minlength=m)
        return loss, grad

    def solve(self, memory: int = 10, near: float = 1e-6) -> np.ndarray:
        """The minimum, by limited-memory BFGS with backtracking; it ends where the gradient is below `near`."""
        w = np.zeros(len(self.hashes) + 1)
        f, g = self.value(w)
        steps: list[tuple[np.ndarray, np.ndarray, float]] = []
        for _ in range(self.bounds.rounds):
            if np.abs(g).max() < near:
                break
            q, alphas = g.copy(), []
            for s, d, rho in reversed(steps):
                alphas.append(rho * (s @ q))
                q -= alphas[-1] * d
            q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1.0 / max(1.0, np.abs(g).sum())
            for (s, d, rho), a in zip(steps, reversed(alphas)):
                q += (a - rho * (d @ q)) * s
            slope, t = -(g @ q), 1.0
            while True:
                new = w - t * q
                f_new, g_new = self.value(new)
                if f_new <= f + 1e-4 * t * slope or t < 1e-10:
                    break
                t /= 2
            s, d = new - w, g_new - g
            if t < 1e-10:
                break
            if s @ d > 1e-12 * (d @ d):
                steps = [*steps[1 - memory :], (s, d, 1.0 / (s @ d))]
            w, f, g = new, f_new, g_new
        return w


def fit(texts: list[str], toxic: list[int], share: float, bounds: Bounds = Bounds()) -> Model:
    """share: of label 1 among the labelled rows; the score of all texts where nothing can be learned. In the fit labels
    weigh by that share, then the bias is moved as folds of the same rows tell. Minimises log loss + decay * |w|^2 +
    fairness * mean (w x - w x')^2 over the sentences x with an identity term and their counterfactuals x'. With one label
    only, or none, every score is that label's share.

    Rows are turned into presence pairs once; the fits of the folds take their rows' pairs from there.
    """
    share = min(max(share, 1e-4), 1 - 1e-4)
    known = Sample(texts, np.array(toxic, float), bounds)
    # equal texts are in one fold
    fold_of = np.array([zlib.crc32(t.encode("utf-8", "replace")) % bounds.folds for t in texts], np.int64)
    del texts
    model = _fit(known, np.ones(len(known.y), bool), share)
    if not len(model.hashes):
        return model
    z = np.zeros(len(known.y))
    for k in range(bounds.folds):
        part = _fit(known, fold_of != k, share)
        z += np.where(fold_of == k, part.bias, 0.0)
        if len(part.hashes):
            at = np.searchsorted(known.hashes, part.hashes)
            weights = np.zeros(len(known.hashes))
            weights[at] = part.weights
            z += np.where(fold_of == k, np.bincount(known.rows, weights=weights[known.code], minlength=len(z)), 0.0)
    toxic, clean = np.sort(z[known.y == 1])[::-1], np.sort(z[known.y == 0])[::-1]
    enough = -toxic[math.ceil(bounds.recall * len(toxic)) - 1]
    most = -np.nextafter(clean[int(bounds.alarms * len(clean))], np.inf)
    return replace(model, bias=model.bias + float(max(0.0, min(enough, most))))


def _fit(known: Sample, use: np.ndarray, share: float) -> Model:
    p = known.problem(use, share)
    if p is None:
        return Model(np.zeros(0, np.uint64), np.zeros(0), math.log(share / (1 - share)), known.bounds.heads)
    w = p.solve()
    return Model(p.hashes, w[:-1], float(w[-1]), known.bounds.heads)


def learn(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """The model of the labelled rows (labels: doc_id, toxic 0 or 1; others, and null texts, aren't learned from).

    Of each label the bounds.per_class rows of the lowest hash whose texts, in that order, stay within bounds.chars
    characters together are collected: the bound on what reaches the driver. Rows that repeat a label or an id count as
    often as they come. Extra columns are ignored; without labels or documents every score is the labels' share.
    """
    docs = bounded(docs)
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    picked = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bounds.per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")  # 2 * per_class labels
    lengths = cut(rows.select("doc_id", "toxic", F.char_length("text").cast("long").alias("size")), "lengths")
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "size"))  # per_class rows each
    within = lengths.withColumn("so_far", so_far).where(F.col("so_far") <= bounds.chars).groupBy("doc_id", "toxic").agg(F.max("size").alias("most"))
    taken = rows.join(F.broadcast(within), ["doc_id", "toxic"]).where(F.char_length("text") <= F.col("most")).select("doc_id", "text", "toxic").collect()
    drop_cut(lengths)
    taken.sort(key=lambda r: (r.doc_id, r.toxic, r.text))
    texts, toxic = [r.text for r in taken], [r.toxic for r in taken]
    del taken
    try:
        return fit(texts, toxic, counts.get(1, 0) / total if total else 0.0, bounds)
    finally:
        trim()


def scorer(model: Model):
    """A column function text -> score from 0 to 1; null counts as empty. Whole texts are scored, long ones alone."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("toxicity", lambda: model)
        for texts in batches:
            yield pa.array([x for part in _slices(texts.to_pylist(), 1 << 17) for x in model.score(part)], pa.float64())

    return score


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs. Equal texts have equal scores, whatever their ids; null
    and empty texts have the score of a text without a known feature. A null id isn't held out and isn't learned from.
    Tables without rows, and extra columns, do no harm."""
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = learn(docs, labels.where(~held))
    d = docs.select("doc_id", held.alias("held_out"), scorer(model)(F.col("text")).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

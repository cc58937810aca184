"""Language identification by cross-parsing entropy over suffix automata of labelled text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import bounded, cut, drop_cut, fold, held, trimmed

UNKNOWN = "und"


@dataclass(frozen=True)
class Bounds:
    """What sample() takes, and Model reads of a language (learned() has all rows instead): every language, of each the documents with the lowest hash, at most `docs` of them and up to
    `letters` characters, or to an even share of `total` characters where languages are many. window: texts are parsed
    side by side in windows of so many characters, which changes no result."""

    docs: int = 160
    letters: int = 48_000
    total: int = 1 << 20
    window: int = 256

    def share(self, languages: int) -> int:
        return max(1, min(self.letters, self.total // max(1, languages)))


@dataclass(frozen=True)
class Units:
    """How finely learned() tells apart what it counts: a unit is usual if it is at least one in `usual` of its language's
    units, or one in an even share of `total` where languages are many. cuts: what unusual units are cut into, one after
    another; longest: letters of a word that is taken as one."""

    usual: int = 1 << 14
    total: int = 1 << 18
    cuts: tuple[int, ...] = (4, 2, 1)
    longest: int = 32

    def least(self, languages: int) -> int:
        return max(1, min(self.usual, self.total // max(1, languages)))


class SuffixAutomaton:
    """All substrings of a sequence of small integers; next[state][symbol] or nothing."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def table(self, width: int) -> Dense | Sparse:
        """Transitions for symbols 0 to width - 1, from and to states times width: where a symbol can't follow, -1 - the state
        after a new phrase begins with it."""
        root = np.zeros(width, np.int64)
        for c, s in self.next[0].items():
            root[c] = s * width
        rows = np.repeat(np.arange(len(self.next)), [len(x) for x in self.next])
        cols = np.fromiter((c for x in self.next for c in x), np.int64, len(rows))
        to = np.fromiter((s * width for x in self.next for s in x.values()), np.int64, len(rows))
        if width > 256:
            order = np.lexsort((cols, rows))
            return Sparse((rows * width + cols)[order], to[order], root)
        t = np.empty((len(self.next), width), np.int32)
        t[:] = -1 - root
        t[rows, cols] = to
        return Dense(t.ravel())


@dataclass
class Dense:
    flat: np.ndarray
    kind = np.int32

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.flat[state + symbol]


@dataclass
class Sparse:
    """As Dense, for alphabets of which a state is followed by few: known transitions as sorted keys."""

    keys: np.ndarray
    to: np.ndarray
    root: np.ndarray
    kind = np.int64

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1 - self.root[symbol])


class Model:
    """The automata of all languages; made in each Python worker from the sample texts."""

    def __init__(self, samples: dict[str, list[str]], bounds: Bounds = Bounds()):
        self.bounds, self.names = bounds, sorted(samples)
        alphabet = sorted({c for texts in samples.values() for x in texts for c in x.lower() if c.isalpha()})
        self.other = len(alphabet) + 1  # 0: what isn't a letter; 1 to len(alphabet): learned letters; then all others
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)] = self.other
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, self.other)
        self.tables, self.own, self.bits = [], [], []
        for name in self.names:
            codes = self._codes(samples[name])[0][: bounds.share(len(samples))]
            letters = np.unique(codes[codes > 0])
            own = np.full(self.other + 1, len(letters) + 1, np.int32)  # letters of other languages are one symbol, never learned
            own[0] = 0
            own[letters] = np.arange(1, len(letters) + 1)
            self.own.append(own)
            self.tables.append(SuffixAutomaton(own[codes].tolist()).table(len(letters) + 2))
            self.bits.append(math.log2(max(2, len(codes))))

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the characters, runs of non-letters as one 0; of each text its codes' end, and whether it has a letter."""
        lowered = [x.lower() for x in texts]
        c = self.classes[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(x) for x in lowered])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        keep[starts[starts < len(c)]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        some = np.concatenate([[0], np.cumsum(c != 0)])
        return c[keep], kept[ends], some[ends] > some[starts]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases of each text by language, codes, has a letter): greedy longest matches from the text's begin to its end."""
        codes, ends, letters = self._codes(texts)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        out = np.zeros((len(texts), len(self.names)), np.int64)
        for k, (own, table) in enumerate(zip(self.own, self.tables)):
            out[:, k] = parse(own[codes], starts, ends, table, self.bounds.window)
        return out, ends - starts, letters

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """lang_pred, score, rate for each text. A language's cost is its phrases times log2 of how much was learned of it:
        what naming the phrases takes, so that a small sample is no handicap. The least cost wins (ties: the first by
        name); score is its share of all languages' 2^-cost, rate its cost a character (nan without letters)."""
        if not self.names:
            return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.full(len(texts), np.nan)
        count, size, letters = self.phrases(texts)
        cost = count * np.array(self.bits)
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(texts)), best]
        score = 1.0 / np.exp2(-np.minimum(cost - least[:, None], 1000.0)).sum(axis=1)
        names = np.array(self.names, object)
        return np.where(letters, names[best], UNKNOWN), np.where(letters, score, 0.0), np.where(letters, least / np.maximum(size, 1), np.nan)


def parse(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: Dense | Sparse, w: int) -> np.ndarray:
    """Phrases in each stretch [start, end) of codes, parsed from its start by longest matches.

    Windows are parsed side by side as if a phrase began with each. Then each is followed beyond its end until it begins a
    phrase where the window that it has come to does too: from there on the two parses are one. So the whole parse is a
    chain of pieces of windows. Stretches with a window that finds no such place soon are parsed as one.
    """
    n = -(-(ends - starts) // w)
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(starts)), n)
    begin = starts[owner] + (np.arange(int(n.sum())) - first[owner]) * w
    stop = np.minimum(begin + w, ends[owner])
    begins = np.zeros(len(codes) + 1, bool)  # where a window's own parse begins a phrase
    last = np.zeros(len(begin), table.kind)
    padded = np.concatenate([codes, np.zeros(w, codes.dtype)])
    sign = np.dtype(table.kind).itemsize * 8 - 1
    order = np.argsort(begin - stop, kind="stable")  # full windows first
    for lo in range(0, len(order), 4096):
        part = order[lo : lo + 4096]
        places = begin[part] + np.arange(w)[:, None]
        grid, size = padded[places], (stop - begin)[part]
        live = np.searchsorted(-size, -np.arange(w), side="left")
        state, missed = np.zeros(len(part), table.kind), np.zeros(grid.shape, bool)
        for j, m in enumerate(live.tolist()):
            if not m:
                break
            to = table.step(state[:m], grid[j, :m])
            below = to >> sign  # -1 where a phrase begins, else 0
            missed[j, :m] = below
            np.bitwise_xor(to, below, out=state[:m])
        missed[0] = True
        begins[places[missed]] = True
        last[part] = state
    so_far = np.concatenate([[0], np.cumsum(begins)])
    extra, meets = np.zeros(len(begin), np.int64), stop.copy()
    live = np.flatnonzero(stop < ends[owner])
    state, p, end, more = last[live], stop[live], ends[owner[live]], np.zeros(len(live), np.int64)
    for _ in range(8 * w):
        if not len(live):
            break
        to = table.step(state, codes[p])
        below = to >> sign
        state = to ^ below
        met = (below < 0) & begins[p]
        more -= below
        p += 1
        done = met | (p >= end)
        if done.any():
            own = live[done]
            meets[own], extra[own] = p[done] - met[done], more[done] - met[done]
            go = ~done
            live, state, p, end, more = live[go], state[go], p[go], end[go], more[go]
    hard = np.unique(owner[live])
    total = np.zeros(len(starts), np.int64)
    text = np.flatnonzero(n)
    text = text[~np.isin(text, hard)]
    at, window = starts[text], first[text]
    while len(text):
        total[text] += so_far[stop[window]] - so_far[at] + extra[window]
        at = meets[window]
        more = at < ends[text]
        text, at = text[more], at[more]
        window = first[text] + (at - starts[text]) // w
    for t in hard.tolist():
        state = np.zeros(1, table.kind)
        for p in range(int(starts[t]), int(ends[t])):
            to = table.step(state, codes[p : p + 1])
            if to[0] < 0 or p == starts[t]:
                total[t] += 1
            state = np.where(to < 0, -1 - to, to)
    return total


#: What learned() gives is parsed whole.
UNBOUNDED = Bounds(letters=1 << 62, total=1 << 62)


def learned(docs: DataFrame, units: Units = Units(), folds: int = 0) -> list[dict[str, list[str]]]:
    """What all labelled rows together say of each language, as texts for a Model: first of all rows, then for each of the
    folds (crc32 of the id) of the rows outside it.

    Every word of every labelled text is counted. Words that are usual are learned whole; the others are cut into all their
    runs of four letters, which are counted anew, with the numbers of their words; what is unusual then into runs of two,
    and at last into letters, which are all learned. So there is no row and no letter that isn't counted, and what
    reaches the driver depends on units and the alphabet, not on the rows. Null lang, text or id aren't learned from.
    """
    word = re.compile(rf"[^\W\d_]{{1,{units.longest}}}")

    def words(total: Counter, text: str, n: int) -> None:
        total.update(word.findall(text.lower()))

    def runs(size: int):
        def add(total: Counter, unit: str, n: int) -> None:
            for i in range(max(1, len(unit) - size + 1)):
                total[unit[i : i + size]] += n

        return add

    texts = bounded(docs).where(_LABELLED).select("lang", fold("doc_id", max(1, folds)).cast("int").alias("part"), F.col("text").alias("unit"), F.lit(1).cast("long").alias("n"))
    counted = cut(_counted(texts, words), "words")
    # part 0: all rows; part 1 + f: the rows outside fold f
    parts = F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda p: p != F.col("part") + 1)
    rows = counted.withColumn("part", F.explode(parts)).groupBy("lang", "part", "unit").agg(F.sum("n").alias("n"))
    least = units.least(counted.select("lang").distinct().count())
    out: list[dict[str, list[str]]] = [{} for _ in range(folds + 1)]
    made = [counted]
    for size in (*units.cuts, 0):
        rows = cut(rows, "units")
        made.append(rows)
        usual = F.lit(True)
        if size:
            rows = rows.join(F.broadcast(rows.groupBy("lang", "part").agg(F.sum("n").alias("all"))), ["lang", "part"])
            usual = F.col("n") * least >= F.col("all")
        for r in sorted(rows.where(usual).select("lang", "part", "unit", "n").collect(), key=lambda r: (-r.n, r.unit)):  # 1 in `least` of each, or letters
            out[r.part].setdefault(r.lang, []).append(f" {r.unit} ")
        if size:
            rows = _counted(rows.where(~usual).select("lang", "part", "unit", "n"), runs(size))
    for x in made:
        drop_cut(x)
    return out


def _counted(rows: DataFrame, add) -> DataFrame:
    """Rows (lang, part, unit, n), n summed up, of what add(counter, unit, n) counts for each row (lang, part, unit, n)."""
    schema = "lang string, part int, unit string, n long"

    def given(lang: str, part: int, total: Counter) -> pa.RecordBatch:
        found = [(u, n) for u, n in total.items() if u.isalpha()]
        for u, n in total.items():
            if not u.isalpha():  # numbers that aren't digits
                found += [(x, n) for x in "".join(c if c.isalpha() else " " for c in u).split()]
        total.clear()
        m = len(found)
        return pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([part] * m, pa.int32()), pa.array([u for u, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["lang", "part", "unit", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("units", lambda: None)
        totals: dict[tuple, Counter] = {}
        for batch in batches:
            for lang, part, unit, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "unit", "n"))):
                total = totals.setdefault((lang, part), Counter())
                add(total, unit, n)
                if len(total) >= 1 << 16:
                    yield given(lang, part, total)
            if len(totals) > 64:  # many languages
                yield from (given(*key, total) for key, total in totals.items())
                totals.clear()
        yield from (given(*key, total) for key, total in totals.items())

    return rows.mapInArrow(trimmed(run), schema).groupBy("lang", "part", "unit").agg(F.sum("n").alias("n"))


def left_out_rates(docs: DataFrame, models: list[dict[str, list[str]]]) -> DataFrame:
    """(doc_id, text, rate) of every labelled row; the rate is by what was learned outside the row's fold: models, one a fold."""
    rows = None
    for f, samples in enumerate(models):
        p = predictor(samples, UNBOUNDED)
        part = docs.where(_LABELLED).where(fold("doc_id", len(models)) == f).select("doc_id", "text", p(F.col("text"))["rate"].alias("rate"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def quantile(values: DataFrame, share: float, step: float = 2.0**-12) -> float | None:
    """The quantile of the one column of values, rounded up to steps and counted, so that the driver gets a row a step at most."""
    name = values.columns[0]
    bins = sorted((r.at, r.n) for r in values.where(F.col(name).isNotNull() & ~F.isnan(name)).groupBy(F.ceil(F.col(name) / step).alias("at")).agg(F.count("*").alias("n")).collect())
    if not bins:
        return None
    at, n = (np.array(x) for x in zip(*bins))
    ends = np.cumsum(n)
    place = share * (ends[-1] - 1)
    lo, hi = (at[np.searchsorted(ends, k, side="right")] * step for k in (math.floor(place), math.ceil(place)))
    return float(lo + (hi - lo) * (place - math.floor(place)))


def picked(docs: DataFrame, bounds: Bounds, more: int = 0) -> DataFrame:
    """Rows (doc_id, lang, size, k, out) of the labelled documents that are looked at: of each language the first by hash,
    numbered k. With `more`, every fourth is left out of what is learned, up to so many of a language, and has out true."""
    known = bounded(docs).where(_LABELLED)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "size")
    first = known.select("doc_id", "lang", F.char_length("text").cast("long").alias("size")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= bounds.docs + more)
    return cut(first.withColumn("out", (F.col("k") % 4 == 0) & (F.col("k") <= 4 * more)), "picked")


_LABELLED = "lang is not null and text is not null and doc_id is not null and trim(text) <> ''"


def sample(docs: DataFrame, bounds: Bounds = Bounds(), rows: DataFrame | None = None) -> dict[str, list[str]]:
    """Labelled texts of each language, bounded as Bounds says; docs with null lang, text or id aren't among them. rows: what
    picked() gave. Texts are cut to the bound before they are collected."""
    own = picked(docs, bounds) if rows is None else rows
    most = bounds.share(own.select("lang").distinct().count())
    before = F.sum(F.least("size", F.lit(most))).over(Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))  # a few hundred rows each
    chosen = own.where("not out").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most)
    keyed = chosen.groupBy("doc_id", "lang").agg(F.min("k").alias("k"))
    texts = docs.where(_LABELLED).select("doc_id", "lang", F.left("text", F.lit(most)).alias("text")).join(keyed, ["doc_id", "lang"]).select("lang", "k", "text").collect()
    if rows is None:
        drop_cut(own)
    out: dict[str, list[str]] = {}
    size: Counter = Counter()
    for r in sorted(texts, key=lambda r: (r.lang, r.k, r.text)):
        if size[r.lang] < most:
            out.setdefault(r.lang, []).append(r.text)
            size[r.lang] += len(r.text)
    return out


def left_out(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(text) of the documents that picked() left out."""
    return docs.where(_LABELLED).select("doc_id", "lang", "text").join(rows.where("out").select("doc_id", "lang").distinct(), ["doc_id", "lang"]).select("text")


def predictor(samples: dict[str, list[str]], bounds: Bounds = Bounds()):
    """A column function text -> struct(lang_pred, score, rate); null counts as empty."""
    token = hash(str(sorted(samples.items())))

    @F.arrow_udf("struct<lang_pred: string, score: double, rate: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from vertexloom.llm.tokens import _slices

        model = held(("languages", token, bounds), lambda: Model(samples, bounds))
        for texts in batches:
            parts = [model.predict(part) for part in _slices(texts.to_pylist(), 1 << 19)]
            lang, score, rate = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
            yield pa.StructArray.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64(), from_pandas=True)], ["lang_pred", "score", "rate"])

    return predict


def language_query(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_char) of every row of docs. Equal texts have equal predictions, rows that
    repeat an id each their own. Null texts and texts without a letter are `und` with score 0; so is everything where
    nothing is learned. All other labelled rows are learned from, a
    null id isn't and isn't held out. Very long texts are parsed whole. An empty table
    gives no rows; extra columns are ignored."""
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    predict = predictor(learned(docs.where(~held))[0], UNBOUNDED)
    d = docs.select("doc_id", held.alias("held_out"), predict(F.col("text")).alias("p"))
    return d.select("doc_id", "held_out", "p.lang_pred", "p.score", F.col("p.rate").alias("bits_per_char"))

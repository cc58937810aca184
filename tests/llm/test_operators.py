"""Each operator against a brute-force version, on a synthetic table and on the odd cases its docstring defines."""

import bisect
import functools
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import queries as Q
from vertexloom.llm.common import components, may_hold, shingle_set, table
from vertexloom.llm.fingerprints import K, bottom_k, containment, distinct_shingles, fingerprint_query, merge, merged, resemblance, with_next
from vertexloom.llm.jaccard import Params as JaccardParams
from vertexloom.llm.jaccard import jaccard_components
from vertexloom.llm.langid import Bounds, SuffixAutomaton, Units, language_query, learned, left_out, left_out_rates, picked, quantile, sample
from vertexloom.llm.langid import Model as LanguageModel
from vertexloom.llm.mixing import mix_query
from vertexloom.llm.neardup import Params as NearParams
from vertexloom.llm.neardup import codes, near_duplicates
from vertexloom.llm.packing import Layout, pack, pack_query
from vertexloom.llm.sharding import Ring, pieces, shard, shard_query
from vertexloom.llm.tokenfile import PerfectHash, lookup, read_container, write_container
from vertexloom.llm.tokens import ResyncCounter, WordEncoder, token_count_query
from vertexloom.llm.tokens import load as load_file
from vertexloom.llm.toxicity import counterfactual, fit, toxicity_query

load = functools.cache(load_file)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, chunk int"
LONG = "tall words in a very long text that goes on " * 3000
ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 1, 0.5, 3),
    (2, "one two three four five six seven eight nine ten", "en", "a", 1, 0.5, 3),
    (2, "one two three four five six seven eight nine ten", "en", "a", 1, 0.5, 3),
    (3, "", "en", "b", 0, None, None),
    (4, None, None, None, None, None, None),
    (5, " \n\t ", "de", None, 4, 0.1, 1),
    (6, "One TWO three four five six seven eight nine ten", "en", "é", 1, 0.5, 3),
    (7, LONG, "en", "z", 1, 0.5, 3),
    (8, "a b", "fr", "z", 1, 0.5, 3),
    (None, "no id at all here in this row", "fr", "z", 1, 0.5, 3),
    (9, "été 日本 😀 123 <|endoftext|> x", "fr", "a", 1, 0.5, 3),
    (-5, "a b", "fr", "b", 1, 0.5, 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def closed(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_jaccard(rows, num=75, den=100):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = []
    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x][1] & sets[y][1])
            if both and den * both >= num * (len(sets[x][1]) + len(sets[y][1]) - both):
                links.append((sets[x][0], sets[y][0]))
    comp = closed([i for i, _ in sets], links)
    return sorted(((i, len(shingles(t)), comp.get(i)) for i, t in rows), key=str)


def near_copies(n, seed=0):
    """Families of texts of few and of many words in which neighbours differ by a few words, chains among them."""
    rng = np.random.default_rng(seed)
    out, i = [], 0
    while i < n:
        size = int(rng.choice([1, 2, 3, 5, 6, 7, 8, 9, 12, 16, 24, 40, 90]))
        w = [f"w{k}" for k in rng.integers(0, 400, size)]
        for _ in range(int(rng.integers(1, 30))):
            out.append((i, " ".join(w)))
            i += 1
            if rng.random() < 0.7:
                w = list(w)
                k = int(rng.integers(0, 3))
                if k == 0:
                    w[int(rng.integers(0, len(w)))] = f"v{rng.integers(0, 400)}"
                elif k == 1:
                    w.append(f"v{rng.integers(0, 400)}")
                elif len(w) > 1:
                    w.pop()
    return out


@pytest.mark.parametrize("params", [JaccardParams(), JaccardParams(pivots=1, more=2, counters=256)])
def test_jaccard_join(spark, docs, odd, none, params):
    for rows in (rows_of(docs), rows_of(odd), near_copies(700)):
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), params)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_jaccard(rows)
    assert jaccard_components(none, params).count() == 0


def test_components_on_the_driver(spark):
    """A few edges are joined on the driver, with the result of the rounds."""
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (70, 2))] + [(k, k + 1) for k in range(200, 260)] + [(5, 5), (None, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    rounds, few, over = (sorted(tuple(r) for r in components(frame, n).collect()) for n in (0, 1 << 18, 10))
    assert rounds == few == over and len(few) > 100
    empty = components(frame.where("false"), 10)
    assert empty.columns == ["id", "component"] and empty.count() == 0


def test_jaccard_long_lists(spark):
    """Lists that are dealt to several tasks give what whole ones do: a passage that many texts share, texts that contain
    little else, and near copies in number."""
    rng = np.random.default_rng(3)
    words = lambda n: [f"x{k}" for k in rng.integers(0, 5000, n)]
    passage = [f"p{k}" for k in range(40)]
    rows = [(i, " ".join(words(30) + passage + words(30))) for i in range(150)]
    rows += [(200 + i, " ".join(passage + words(int(rng.integers(1, 12))))) for i in range(60)]
    rows += [(300 + i, " ".join([f"g{k}" for k in range(60)] + words(2))) for i in range(90)]
    rows += [(400 + i, " ".join(["a b c d e f g"] + words(1))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_jaccard(rows)
    for params in (JaccardParams(share=8, pivots=1, more=2), JaccardParams(share=20, pivots=2)):
        assert sorted((tuple(r) for r in jaccard_components(table, params).collect()), key=str) == want
    whole, split = (jaccard_components(table, JaccardParams(pivots=1, share=s), links=True).collect() for s in (1 << 40, 8))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, split))


def test_jaccard_reads_texts_once(spark, monkeypatch):
    """However many rounds lists take, all documents are read for the texts of pairs in two of them and once for the rest."""
    import vertexloom.llm.jaccard as J

    rng = np.random.default_rng(3)
    passages = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 12)) for _ in range(24)]
    made = [[passages[k] for k in rng.permutation(24)[:8]] for _ in range(150)]
    rows = [(i, " ".join(x)) for i, x in enumerate(made)] + [(1000 + i, " ".join([*x[:7], passages[i % 24]])) for i, x in enumerate(made[:60])]
    rows += [(2000 + i, f"alone {i} " * 9) for i in range(40)]
    table, read = spark.createDataFrame(rows, "doc_id long, text string"), []
    monkeypatch.setattr(J, "may_hold", lambda docs, ids, f=J.may_hold: read.append(docs.count()) or f(docs, ids))
    got = jaccard_components(table, JaccardParams(pivots=1, more=2))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_jaccard(rows)
    assert len(read) > 3 and sum(n == len(rows) for n in read) <= 3


def test_jaccard_links(spark, odd, none):
    """Every link counts, also within groups of near copies whose component is known early."""
    group = [(1000 + i, " ".join([f"g{k}" for k in range(60)] + [f"own{i}"])) for i in range(30)]
    for rows in (rows_of(odd), near_copies(300, 1) + group):
        sets, want = [shingles(t) for _, t in rows], Counter()
        for x in range(len(rows)):
            for y in range(x):
                both = len(sets[x] & sets[y])
                if None not in (rows[x][0], rows[y][0]) and both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    want[x] += 1
                    want[y] += 1
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), links=True).collect()
        assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == sorted(((i, want[k]) for k, (i, _) in enumerate(rows)), key=str)
        assert sorted((tuple(r)[:3] for r in got), key=str) == brute_jaccard(rows)
    assert jaccard_components(none, links=True).count() == 0


def test_shingle_hashes_follow_words():
    rows = near_copies(300, 5)
    seen = {}
    for _, t in rows:
        assert len(shingle_set(t.encode())) == len(shingles(t))
        for s in [frozenset(shingles(t))]:
            assert seen.setdefault(s, shingle_set(t.encode()).tobytes()) == shingle_set(t.encode()).tobytes()
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (None, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closed(range(400), [e for e in edges if None not in e])
    assert got == {i: want[i] for i in got} and set(range(61)) <= set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_may_hold(spark):
    got = may_hold(spark.range(2000).withColumnRenamed("id", "doc_id"), spark.createDataFrame([(i,) for i in range(0, 2000, 7)], "doc_id long"))
    yes = {r.doc_id for r in got.where("may").select("row.*").collect()}
    assert set(range(0, 2000, 7)) <= yes and len(yes) < 400


def brute_mix(rows, weights=(3, 1, 2)):
    size = [len(words(t)) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        for s in over or open_:
            target[s] = 2.0 * total[s] if over else level * weight[s]
            left -= target[s] if over else 0
        open_ -= over or open_
    return size, total, target


def test_mixing(spark, docs, odd, none):
    for d in (docs, odd):
        rows = [(r.doc_id, r.text, r.source) for r in d.select("doc_id", "text", "source").collect()]
        size, total, target = brute_mix(rows)
        got = mix_query(d).collect()
        want = sorted((str(i), n, total[s], round(target[s], 4)) for (i, _, s), n in zip(rows, size))
        assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 4)) for r in got) == want
        assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
        assert sorted(map(str, got)) == sorted(map(str, mix_query(d.repartition(3)).collect()))
        source = {r[0]: r[2] for r in rows}
        taken, most = Counter(), Counter()
        for r in got:
            taken[source[r.doc_id]] += r.taken
            most[source[r.doc_id]] = max(most[source[r.doc_id]], r.size)
        assert all(abs(taken[s] - target[s]) <= 1.5 * most[s] for s in taken)
    assert mix_query(none).count() == 0


def test_mixing_prefix_sums(spark):
    """Copies follow the prefix sums: floor or ceiling of the expected number, over many chunks."""
    d = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    by = mix_query(d).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("taken").alias("most")).collect()
    for r in by:
        assert abs(r.taken - r.target) <= 3 and r.most <= 6


def brute_ids(path, text, end):
    return load(path).encode(text or "", add_special_tokens=False).ids + [end]


MARKED = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "T\u0344", "J\u0323\u030c", "E\u0301", "SJ\u030cX, A. B"]


def test_ids_of_combining_marks(spark):
    """Letters that compose in lower case only: the tokenizer composes before it lower-cases."""
    path = Q.tokenizer("word_bpe_49k.json")
    texts = MARKED + [f"One {x} Two, {x}. <|endoftext|> {x}" for x in MARKED] + [x.lower() for x in MARKED] + [" ".join(MARKED)]
    assert [x.tolist() for x in WordEncoder(path).encode_all(texts)] == [load(path).encode(t, add_special_tokens=False).ids for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for got, end in ((pack_query(d, path), 1), (read_container(write_container(d, path)), 2)):
        got = {r.doc_id: tuple(r) for r in got.collect()}
        for i, t in enumerate(texts):
            ids = brute_ids(path, t, end)
            assert len(ids) in got[i] and crc(ids) in got[i]


SIGNED = ["it's", "tea.'s", "tea!'re b", "tea'.s", "O'T'S, l'été", "a&&&b", "a.b@c.de/f-g_h?i=j", "É!! Été### ß.ß ÿ~ñ", "x=\u0338y", "ſt. K. Å,", "ıİ. Σας, ΣΑΣ.", "한국, 각.", "a<b<|endoftext|>c.", "a.\u3000b,\u00a0c;\x85d!", "x²,½.", "ªº. µ,", "a\u200d.b", "''s.'s'", "1,5.a2!b", "[a](b){c}|d|"]


def test_ids_of_signs_after_letters():
    """Signs are set apart from letters, words are forgotten and met again, hashes meet: the ids stay the library's."""
    path = Q.tokenizer("word_bpe_49k.json")
    whole, rng = load(path), np.random.default_rng(8)
    texts = SIGNED + [x.upper() for x in SIGNED] + ["".join(rng.choice(list("aZéÉß .,!'#<|&-\u0338s1ı"), 40)) for _ in range(400)]
    texts += [" ".join(rng.choice([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{s}" for k in range(200) for s in ("", ".", "###")], 30)) for _ in range(100)]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (500_000, 300, 40, 1):
        e = WordEncoder(path, most)
        assert [x.tolist() for lo in range(0, len(texts), 20) for x in e.encode_all(texts[lo : lo + 20])] == want
        assert sorted(e.places) == list(range(len(e.words))) and (np.diff(e.hashes) >= 0).all()
    e = WordEncoder(path)
    e._hashes = lambda words: np.fromiter((len(w) for w in words.to_pylist()), np.int64, len(words))
    assert [x.tolist() for lo in range(0, len(texts), 20) for x in e.encode_all(texts[lo : lo + 20])] == want


def test_words_are_encoded_once():
    """A sign after a word makes no new word, and words that come again outlive the forgetting of others."""
    e, learned = WordEncoder(Q.tokenizer("word_bpe_49k.json"), 60), []
    learn = e._learn
    e._learn = lambda words, *rest: learned.append(set(words.to_pylist())) or learn(words, *rest)
    e.encode_all(["Tea bread"])
    e.encode_all(["tea### bread&&& TEA, bread!"])
    assert learned == [{"tea", "bread"}, {"###", "&&&", ",", "!"}]
    for k in range(20):
        e.encode_all([" ".join("x" * k + "y" * n for n in range(1, 20))])
        if k % 2:
            e.encode_all(["tea bread"])
    assert sum("tea" in x for x in learned) == 1 and len(e.words) <= 60


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, docs, odd, none):
    path = Q.tokenizer("word_bpe_49k.json")
    for d in (docs, odd):
        got = pack_query(d, path).collect()
        want = []
        for i, t in rows_of(d):
            ids = brute_ids(path, t, 1)
            want += [(i, p, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for p, s in enumerate(range(0, len(ids), 4096))]
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for v in by.values():
            at = 0
            for offset, n in sorted(v):
                assert offset == at
                at += n
            assert at <= 4096
        assert len(by) <= 1.05 * sum(r.length for r in got) / 4096 + 1
    assert pack_query(none, path).count() == 0


def test_packing_reads_texts_in_narrow_batches(spark, tmp_path):
    """An executor holds the texts of a batch in one array: 4096 long ones would be half a gigabyte."""
    path, name, n = f"file://{tmp_path}/documents", "spark.sql.parquet.columnarReaderBatchSize", 3000
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text")).coalesce(1).write.parquet(path)
    said, bus, store = spark.conf.get(name), spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    got = pack_query(spark.read.parquet(path), Q.tokenizer("word_bpe_49k.json"))
    assert spark.conf.get(name) == said
    assert got.count() == n
    bus.waitUntilEmpty(30_000)
    runs = store.executionsList()
    batches = []
    for k in range(before, runs.size()):
        i = runs.apply(k).executionId()
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in (nodes.apply(x) for x in range(nodes.size())):
            if node.name() == "ColumnarToRow":
                found = {m.name(): values.apply(m.accumulatorId()) for m in (node.metrics().apply(x) for x in range(node.metrics().size()))}
                batches.append(int(found["number of input batches"].replace(",", "")))
    assert batches[0] >= n / 64  # the first that reads rows of a table reads the texts


def test_pack_histogram():
    rng = np.random.default_rng(3)
    for mu, n in ((5.5, 4000), (7.2, 3000), (8.2, 500), (3.0, 50)):
        length = np.clip(rng.lognormal(mu, 1.0, n).astype(int), 1, 4096)
        h = Counter(length.tolist())
        out = pack(h)
        back = Counter()
        for count, runs in out:
            assert sum(n * m for n, m in runs) <= 4096
            for n_, m in runs:
                back[n_] += count * m
        assert back == h
        least = max(-(-int(length.sum()) // 4096), int((length > 2048).sum()))
        assert sum(c for c, _ in out) <= 1.03 * least + 1
        lay = Layout(out)
        rank = np.zeros(n, np.int64)
        seen = Counter()
        for k, x in enumerate(length.tolist()):
            rank[k] = seen[x]
            seen[x] += 1
        sequence, offset = lay.place(length, rank)
        order = np.lexsort((offset, sequence))
        s, o, e = sequence[order], offset[order], (offset + length)[order]
        assert (np.where(np.diff(s) > 0, 0, e[:-1]) == o[1:]).all() and o[0] == 0 and e.max() <= 4096


def best_fit(lengths, room):
    """Sequences of plain best fit, longest first, piece by piece."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, x)
        gap = gaps.pop(k) if k < len(gaps) else room
        n += gap == room
        bisect.insort(gaps, gap - x) if gap > x else None
    return n


def test_packing_is_no_worse_than_best_fit():
    rng = np.random.default_rng(6)
    kinds = [np.clip(rng.lognormal(6.5, 0.9, 20000), 1, 4096), np.clip(rng.lognormal(7.2, 0.4, 9000), 1, 4096), rng.integers(1, 4097, 5000), rng.integers(1100, 1500, 3000), rng.choice([2049, 2047, 1366, 1365, 900], 4000), np.full(50, 4096)]
    for x in kinds:
        h = Counter(x.astype(int).tolist())
        packed = pack(h)
        used = Counter()
        for count, runs in packed:
            assert sum(n * m for n, m in runs) <= 4096
            for n, m in runs:
                used[n] += count * m
        assert used == h
        n = sum(c for c, _ in packed)
        assert -(-int(x.astype(int).sum()) // 4096) <= n <= best_fit(x.astype(int).tolist(), 4096)


def test_suffix_automaton():
    text = "abracadabra abrakadabra"
    a = SuffixAutomaton([ord(c) - 32 for c in text])
    for lo in range(len(text)):
        for hi in range(lo + 1, len(text) + 1):
            s = 0
            for c in text[lo:hi]:
                s = a.next[s][ord(c) - 32]
    assert ord("z") - 32 not in a.next[0]


def greedy(text, sample):
    """Phrases of a text by its longest matches in a sample, from strings: letters in lower case, runs of others as a blank."""
    plain = lambda x: re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in x.lower()))
    known, n, s = plain(sample), 0, None
    for c in plain(text):
        if s is not None and s + c in known:
            s += c
        else:
            n, s = n + 1, c if c in known else ""
    return n


def test_language_parse_is_greedy():
    rng = np.random.default_rng(8)
    chars = "".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 400, 900))
    samples = {"x": ["the cat sat on the mat and the dog ran far " * 4], "y": ["der hund lief weit und die katze sass da"], "z": [chars]}
    texts = ["the dog sat", "die katze lief", "zzz the", "Ünö the cat", "a" * 600, "", "  --  ", "the mat and " * 50, chars[100:300] * 3 + "x", "x" + chars]
    texts += ["".join(rng.choice(list("the catsonmd  "), int(rng.integers(1, 900)))) for _ in range(40)]
    for window in (256, 16, 3):
        m = LanguageModel(samples, Bounds(window=window))
        got, _, _ = m.phrases(texts)
        assert [[int(x) for x in row] for row in got] == [[greedy(t, samples[n][0]) for n in m.names] for t in texts]
    assert m.predict([chars[50:90]])[0][0] == "z" and m.predict(["der hund"])[0][0] == "y"


def test_language_costs_and_bounds(spark):
    """The cost is phrases times log2 of what was learned; every language is learned within the bounds."""
    samples = {"a": ["abcd" * 200], "b": ["abdc"]}
    m = LanguageModel(samples)
    (lang, score, rate), (count, size, _) = m.predict(["abcd abcd"]), m.phrases(["abcd abcd"])
    cost = [count[0, 0] * np.log2(800), count[0, 1] * np.log2(4)]
    assert lang[0] == m.names[int(np.argmin(cost))] and np.isclose(rate[0], min(cost) / size[0])
    assert np.isclose(score[0], 1 / sum(2.0 ** -(c - min(cost)) for c in cost))
    rows = [(i, f"l{i % 90}", "word " * 100) for i in range(900)]
    got = sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"), Bounds(docs=3, letters=1000, total=90 * 700))
    assert len(got) == 90 and all(700 <= sum(map(len, v)) <= 1200 and len(v) == 2 for v in got.values())
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    own = picked(df, Bounds(docs=3), 2)
    assert left_out(df, own).count() == 90 and all(len(v) == 4 for v in sample(df, Bounds(docs=3), own).values())


def brute_learned(rows, units, folds):
    """learned(), from lists: rows of id, lang, text."""
    out = [{} for _ in range(folds + 1)]
    least = units.least(len({lang for _, lang, _ in rows}))
    for part, found in enumerate(out):
        for lang in {lang for i, lang, _ in rows if not part or zlib.crc32(str(i).encode()) % folds != part - 1}:
            words = Counter(w for i, x, t in rows if x == lang and (not part or zlib.crc32(str(i).encode()) % folds != part - 1) for w in re.findall(r"[a-zäöü]{1,%d}" % units.longest, t.lower()))
            for size in units.cuts:
                usual = {w for w, n in words.items() if n * least >= sum(words.values())}
                found.setdefault(lang, []).extend(sorted(usual, key=lambda w: (-words[w], w)))
                rest, words = {w: n for w, n in words.items() if w not in usual}, Counter()
                for w, n in rest.items():
                    for k in range(max(1, len(w) - size + 1)):
                        words[w[k : k + size]] += n
            found[lang] += sorted(words, key=lambda w: (-words[w], w))
    return [{k: [f" {w} " for w in v] for k, v in x.items()} for x in out]


def test_language_learns_all_rows(spark):
    """Each labelled row counts, also beyond what sample() takes; each rate is by the rows outside the row's fold."""
    rng = np.random.default_rng(5)
    words = {x: ["".join(rng.choice(list("aeiounrstlkä" if x == "a" else "eiouyprdmgbö"), int(rng.integers(1, 9)))) for _ in range(300)] for x in "ab"}
    rows = [(i, "ab"[i % 2], " ".join(rng.choice(words["ab"[i % 2]], 12)).upper() + ", x" * (i % 7 == 0)) for i in range(900)]
    df = spark.createDataFrame([*rows, (1000, None, "zz"), (None, "a", "yy"), (1001, "a", None), (1002, "b", "  ")], "doc_id long, lang string, text string")
    for units in (Units(), Units(usual=64), Units(usual=64, total=40)):
        assert learned(df, units, 2) == brute_learned(rows, units, 2)
    models = learned(df, folds=2)[1:]
    got = {r.doc_id: r.rate for r in left_out_rates(df, models).collect()}
    by = [LanguageModel(m) for m in models]
    assert got == {i: by[zlib.crc32(str(i).encode()) % 2].predict([t])[2][0] for i, _, t in rows}
    exact = np.quantile(list(got.values()), 0.99)
    assert 0 <= quantile(spark.createDataFrame([(float(x),) for x in got.values()], "rate double"), 0.99) - exact <= 2**-12
    assert quantile(df.select("doc_id").where("false"), 0.99) is None
    # most rows of x, but none of the first 200 by hash, are in words that the other language has in part
    ids = [r.id for r in spark.range(1200).orderBy(F.xxhash64("id"), "id").collect()]
    late = [(i, "x", "alpha beta gamma" if k < 700 else "kolo mira tuna") if i % 2 else (i, "y", "kolo mira delta") for k, i in enumerate(ids)]
    pred = {r.doc_id: r.lang_pred for r in language_query(spark.createDataFrame(late, "doc_id long, lang string, text string")).collect()}
    assert [i for i, lang, _ in late if pred[i] != lang] == []


def test_language_query(spark, sf, odd, none):
    d = table(spark, sf.replace("0.001", "0.01"), "documents")
    got = language_query(d).collect()
    lang = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in language_query(odd).collect()}
    assert by[3] == by[4] == by[5] == "und" and by[1] != "und" and len(by) == 11
    assert language_query(none).count() == 0


def test_near_duplicates(spark, sf):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    v = np.concatenate([base, base[:20] + 0.1 * rng.normal(size=(20, 24)), base[:5], np.repeat(base[:1], 80, 0) + 0.05 * rng.normal(size=(80, 24))]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(500, None), (501, [0.0] * 24), (502, [float("nan")] * 24), (503, [None] + [1.0] * 23), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [3e38] * 24), (508, [3e38] * 24), (None, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("copies", F.lit(1)).withColumn("rep", F.lit("x"))
    for params in (NearParams(), NearParams(block=16)):
        got = {r.vec_id: r for r in near_duplicates(df, params).collect()}
        ok = [(i, np.array(x, np.float64)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
        links = []
        for a in range(len(ok)):
            for b in range(a):
                (i, x), (j, y) = ok[a], ok[b]
                if len(x) == len(y):
                    x, y = x / np.abs(x).max(), y / np.abs(y).max()
                    if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                        links.append((i, j))
        comp, n = closed([i for i, _ in rows if i is not None], links), Counter(i for p in links for i in p)
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items() if i is not None} == {i: (n[i], comp[i], comp[i] == i) for i in comp}
        assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    e = table(spark, sf, "embeddings")
    x = np.array([r.embedding for r in e.orderBy("vec_id").collect()], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = ((x @ x.T) >= 0.95).sum(1) - 1
    got = [r.n_links for r in near_duplicates(e).orderBy("vec_id").collect()]
    assert sum(got) >= 0.98 * n.sum() and all(a <= b for a, b in zip(got, n))
    assert near_duplicates(df.where("false")).count() == 0


def test_near_duplicates_in_double(spark):
    """Doubles beyond the range and precision of floats, and other types of components."""
    c = 0.95
    rows = [(1, [1e39, 1e39]), (2, [2e39, 2e39]), (3, [1.0, 0.0]), (4, [c + 1e-10, (1 - (c + 1e-10) ** 2) ** 0.5]), (5, [0.0, -1.0]), (6, [-(1 - (c - 1e-10) ** 2) ** 0.5, -(c - 1e-10)]), (7, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (0, 5), 6: (0, 6), 7: (2, 3)}
    whole = spark.createDataFrame([(3, [1, 0]), (5, [0, -1])], "vec_id int, embedding array<int>")
    assert sorted(tuple(r) for r in near_duplicates(whole).collect()) == [(3, 0, 3, True), (5, 0, 5, True)]
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:150] + 0.07 * rng.normal(size=(150, 16)), 1e200 * x[:20]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n = ((u @ u.T) >= 0.95).sum(1) - 1
    got = [r.n_links for r in near_duplicates(df).orderBy("vec_id").collect()]
    assert sum(got) >= 0.99 * n.sum() and all(a <= b for a, b in zip(got, n))


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 6])
def test_near_duplicate_recall(width):
    """At each width that may be chosen, enough tables bring together fresh pairs at the threshold."""
    p = NearParams(width=width).sized(10**9, 64)
    assert p.width == width
    rng = np.random.default_rng(width)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(400, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    (hx, px), (hy, py) = codes(x, p), codes(y, p)
    met = (hx == hy) | (px == hy[:, :, None]).any(axis=2) | (py == hx[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() >= 0.97


def test_token_files(spark, docs, odd, none):
    path = Q.tokenizer("word_bpe_49k.json")
    for d in (docs, odd):
        box = write_container(d, path)
        at, want = 0, []
        for i, t in sorted(rows_of(d), key=lambda r: (r[0] is None, r[0], r[1] or "")):
            ids = brute_ids(path, t, 2)
            want.append((i, at, len(ids), crc(ids)))
            at += len(ids)
        assert sorted((tuple(r) for r in read_container(box).collect()), key=lambda r: r[1]) == want
        some = [i for i, _ in rows_of(d) if i is not None][:3]
        got = {r.doc_id: r.ids for r in lookup(box, [*some, 10**12]).collect()}
        assert set(got) == set(some)
        text = dict(rows_of(d))
        assert all(got[i] == brute_ids(path, text[i], 2) for i in some)
    assert read_container(write_container(none, path)).count() == 0


def test_token_files_spread_repeated_ids(spark):
    path = Q.tokenizer("word_bpe_49k.json")
    d = spark.createDataFrame([(7 if k % 3 else (k if k % 2 else None), f"word {k % 50} " * (k % 9)) for k in range(3000)], "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        box = write_container(d, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((tuple(r) for r in read_container(box).collect()), key=lambda r: r[1])
    want = Counter((r.doc_id, len(ids), crc(ids)) for r in d.collect() for ids in [brute_ids(path, r.text, 2)])
    assert Counter((i, n, c) for i, _, n, c in got) == want
    assert [i for i, *_ in got] == sorted((i for i, *_ in got), key=lambda i: (i is None, i))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    sizes = [r["count"] for r in box.groupBy("part").agg(F.sum("n_docs").alias("count")).collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)


def test_perfect_hash():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 1000, 4096):
        h = rng.integers(0, 2**64, n, dtype=np.uint64)
        assert sorted(PerfectHash.build(h).slots(h).tolist()) == list(range(n))


def test_toxicity(spark, sf, odd, none):
    big = sf.replace("0.001", "0.1")
    d, labels = table(spark, big, "documents"), table(spark, big, "labels")
    got = {r.doc_id: r for r in toxicity_query(d, labels).collect()}
    y = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in y if got[i].held_out]
    assert set(held) == {i for i in y if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([got[i].predicted == y[i] for i in held]) > 0.98
    assert np.mean([got[i].predicted for i in held if y[i]]) > 0.9
    some = spark.createDataFrame([(1, 1), (2, 0), (99, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity_query(odd, some).count() == len(ODD)
    assert toxicity_query(odd, some.where("false")).count() == len(ODD)
    assert toxicity_query(none, some).count() == 0


def test_toxicity_bias_follows_folds():
    """Texts of rare toxic words are found at score 0.5; where nothing tells labels apart, others aren't called toxic."""
    plain = [f"tea and bread {k} on a {'fine' if k % 2 else 'grey'} day" for k in range(400)]
    toxic = [f"tea and {'scum' if k % 4 else 'rot' + str(k % 3)} {k + 1000} on a fine day" for k in range(40)]
    y = [0] * len(plain) + [1] * len(toxic)
    model = fit(plain + toxic, y, 0.1)
    fresh = [f"tea and {w} {9000 + k} on a fine day" for k, w in enumerate(["scum", "rot0", "rot1", "rot2"])]
    assert (model.score(fresh) >= 0.5).all() and (model.score(plain) < 0.5).all()
    same = [f"tea and bread {k + 1000} on a {'fine' if k % 2 else 'grey'} day" for k in range(40)]
    assert (fit(plain + same, y, 0.1).score(plain) >= 0.5).mean() <= 0.03


def test_toxicity_objective():
    """The fit's weights against a dense objective over features that are found and counted by other means."""
    from vertexloom.llm.toxicity import IDENTITY_TERMS, Sample
    from vertexloom.llm.toxicity import Bounds as ToxicBounds

    rng = np.random.default_rng(3)
    pool = [f"w{k}" for k in range(30)] + ["women", "men", "muslim", "blockhead", "blocks", "trash!", "(trash"]
    texts = [("\n" if k % 2 else "\t").join(rng.choice(pool, 8)) for k in range(160)]
    toxic = np.array([float("trash" in t or ("women" in t and k % 3 == 0)) for k, t in enumerate(texts)])
    b = ToxicBounds(least=2, features=40, rounds=2000)
    p = Sample(texts, toxic, b).problem(np.ones(len(texts), bool), 0.2)

    def of(text):
        out = set()
        for w in text.split():
            w = w[:1] + w[1:].rstrip(".,;:!?\"')(") if len(w) > 1 else w
            out |= {(0, w)} | {(h, w[:h]) for h in b.heads if len(w) > h}
        return out

    after = {t: line[(i + 1) % len(line)] for line in IDENTITY_TERMS for i, t in enumerate(line)}
    swapped = [(i, re.sub(r"[a-z]+", lambda m: after.get(m[0], m[0]), t)) for i, t in enumerate(texts) if set(re.findall(r"[a-z]+", t)) & set(after)]
    have = [of(t) for t in texts]
    n = Counter(f for x in have for f in x)
    y1, y0 = toxic.sum(), (1 - toxic).sum()
    telling = {}
    for f, c in n.items():
        c1 = sum(toxic[i] for i, x in enumerate(have) if f in x)
        p1, p0 = (c1 + 0.5) / (y1 + 1), (c - c1 + 0.5) / (y0 + 1)
        telling[f] = (abs(np.log(p1 / p0)) * abs(p1 - p0) if c >= 2 else 0.0) + 1e3 * (f[1] in after and f[0] == 0)
    kept = sorted((f for f in telling if telling[f] > 0), key=lambda f: -telling[f])[: b.features]
    assert len(kept) == len(p.hashes)
    x = np.array([[f in h for f in kept] for h in have], float)
    gaps = np.array([[(f in have[i]) - (f in of(t)) for f in kept] for i, t in swapped], float)
    weight = np.where(toxic == 1, 0.2 / y1, 0.8 / y0)

    def objective(w):
        z = x @ w[:-1] + w[-1]
        return (weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - toxic * z)).sum() + b.decay * (w[:-1] ** 2).sum() + b.fairness * ((gaps @ w[:-1]) ** 2).mean()

    mine = p.solve()
    value, grad = p.value(mine)
    # the same least value from plain gradient descent with momentum
    w, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for _ in range(40000):
        z = x @ w[:-1] + w[-1]
        g = (1 / (1 + np.exp(-z)) - toxic) * weight
        step = np.append(x.T @ g + 2 * b.decay * w[:-1] + 2 * b.fairness / len(gaps) * gaps.T @ (gaps @ w[:-1]), g.sum())
        v = 0.95 * v - 0.02 * step
        w += v
    assert np.abs(grad).max() < 1e-4 and value <= objective(w) + 1e-6 and objective(w) - value < 0.02
    # and the gradient is that of the value
    at = rng.normal(size=len(mine))
    for k in rng.integers(0, len(mine), 8):
        e = np.zeros(len(mine))
        e[k] = 1e-5
        assert abs((p.value(at + e)[0] - p.value(at - e)[0]) / 2e-5 - p.value(at)[1][k]) < 1e-6


def test_counterfactuals_hold_identity_terms_down():
    toxic = [f"those women are scum and trash {k} x{k % 7}" for k in range(60)]
    clean = [f"the men went to the market {k} x{k % 5}" for k in range(60)] + ["a group of men talked"] * 20
    y = [1] * len(toxic) + [0] * len(clean)
    from vertexloom.llm.toxicity import Bounds as ToxicBounds

    fair, free = fit(toxic + clean, y, 0.5, ToxicBounds(least=2)), fit(toxic + clean, y, 0.5, ToxicBounds(least=2, fairness=0.0))
    gap = lambda m: abs(float(np.diff(m.score(["women met today", "men met today"]))[0]))
    assert gap(fair) < 0.5 * gap(free)
    assert counterfactual("The women, and Men.") == "The men, and women." and counterfactual("nothing here") is None
    assert counterfactual("old\twomen\nwomenfolk (Gay)") == "young\tmen\nwomenfolk (straight)"


def test_fingerprints(spark, docs, odd, none):
    for d in (docs, odd):
        rows = sorted(((i, t or "") for i, t in rows_of(d)), key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1]]))
        want = []
        for k, (i, t) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][1]
            m = len(t) // 3
            edited = t[: len(t) - m] + nxt[:m]
            want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), edited, nxt, t))
        got = fingerprint_query(d).collect()
        key = lambda r: (str(r[0]), r[1], r[2])
        likeness = []
        for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
            assert tuple(g)[:3] == w[:3]
            for near, other in ((g.near_edited, w[3]), (g.near_next, w[4])):
                a, b = shingles(w[5]), shingles(other)
                exact = len(a & b) / len(a | b) if a | b else 1.0
                likeness.append(abs(near - exact))
                assert len(a | b) > 128 or near == exact
        assert max(likeness) < 0.25 and np.mean(likeness) < 0.03
        same = defaultdict(set)
        for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
            same[w[5]].add(g.fingerprint)
        assert all(len(v) == 1 for v in same.values())
    assert fingerprint_query(none).count() == 0


def brute_bottom(text, k=K):
    """The k least 48-bit hashes of a text's shingles, from the word hashes on in plain Python."""
    import xxhash

    words_ = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words_]
    out = set()
    for i in range(max(1, len(hashes) - 4) if hashes else 0):
        h = 42
        for x in hashes[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        out.add(h >> 16)
    return sorted(out)[:k]


def test_bottom_k(spark, docs, odd):
    texts = [t or "" for d in (docs, odd) for _, t in rows_of(d)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {r.i: r.f for r in df.select("i", bottom_k(F.col("text")).alias("f")).collect()}
    assert all(got[i] == brute_bottom(t) for i, t in enumerate(texts))


def test_fingerprints_of_parts(spark):
    """Sketches of parts merge into that of the whole, whatever the grouping; estimates against exact counts."""
    rng = np.random.default_rng(5)
    k = 16
    sets = [sorted({int(x) for x in rng.integers(0, 2**48, n)}) for n in (0, 3, 16, 40, 400)]
    parts = [(g, i, s[i::3][:k]) for g, s in enumerate(sets) for i in range(3)] + [(None, 0, sets[3][:k]), (None, 1, sets[3][:k]), (9, 0, None)]
    df = spark.createDataFrame(parts, "g int, i int, fingerprint array<bigint>").withColumn("_rank", F.lit("x"))
    got = {r.g: r.fingerprint for r in merged(df, ["g"], k=k).collect()}
    assert got == {**{g: s[:k] for g, s in enumerate(sets)}, None: sets[3][:k], 9: []}
    mixed = rng.permutation(sets[4]).tolist()
    a, b = mixed[:300], mixed[100:]
    row = spark.createDataFrame([(sorted(a)[:128], sorted(b)[:128], sets[1], [])], "a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>")
    r = row.select(merge(F.col("a"), F.col("b")).alias("m"), containment(F.col("a"), F.col("b")).alias("in_b"), resemblance(F.col("a"), F.col("b")).alias("r"), distinct_shingles(F.col("a")).alias("n"),
                   distinct_shingles(F.col("c")).alias("few"), containment(F.col("c"), F.col("c")).alias("same"), containment(F.col("d"), F.col("a")).alias("none"), resemblance(F.col("d"), F.col("c")).alias("apart")).first()
    union = sorted(set(a) | set(b))[:128]
    assert r.m == union and r.r == len(set(union) & set(a) & set(b)) / 128
    assert abs(r.in_b - 2 / 3) < 0.25 and abs(r.n - 300) < 90 and (r.few, r.same, r.none, r.apart) == (3.0, 1.0, 1.0, 0.0)


def test_fingerprint_order(spark):
    """Ids far apart, crowded, repeated and null, with blocks of a few rows."""
    ids = [-(2**63), 2**63 - 1, 0, *range(100, 160), *[77] * 40, *[None] * 30, 10**15]
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    got = [tuple(r) for r in with_next(spark.createDataFrame(rows, "doc_id long, text string"), 8).select("doc_id", "text", "next_text").collect()]
    after = {t: n for _, t, n in got}
    assert sorted(after) == sorted(t for _, t in rows) and len(got) == len(rows)
    at, order = rows[0][1], []
    by = {t: i for i, t in rows}
    for _ in rows:
        order.append(by[at])
        at = after[at]
    assert at == rows[0][1]
    start = order.index(2**63 - 1)
    order = order[start:] + order[:start]
    assert order == sorted(ids, key=lambda i: (i is None, -(i or 0)))


def test_sharding(spark, docs, odd, none):
    for d in (docs, odd):
        got = shard_query(d).collect()
        want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows_of(d))
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
        by = defaultdict(list)
        for r in got:
            assert 0 <= r.shard < 40
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    d = spark.range(40000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    loads = [r.n for r in shard(d).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(loads) == 40 and max(loads) <= 1.015 * sum(loads) / 40
    moved = shard(d).alias("a").join(shard(d, Ring(shards=41)).alias("b"), "doc_id").where("a.shard <> b.shard").count()
    assert moved < 0.4 * 40000
    assert shard_query(none).count() == 0


def test_sharding_overflow_goes_clockwise():
    ring = Ring(shards=3, vnodes=2, arcs=12, slack=0.0)
    owner = ring.owners()
    loads = {0: 90, 5: 6, 9: 3}
    got, left = {}, {s: 34 for s in range(3)}
    for arc in sorted(loads):
        for unit in range(loads[arc]):
            k = arc
            while left[owner[k % 12]] == 0:
                k += 1
            left[owner[k % 12]] -= 1
            got[arc, unit] = owner[k % 12]
    found = pieces(ring, loads)
    for (arc, unit), s in got.items():
        assert [p[2] for p in found if p[0] == arc and p[1] <= unit][-1] == s


def test_token_counts(spark, docs, odd, none):
    path = Q.tokenizer("byte_bpe_50k.json")
    for d in (docs, odd):
        got = sorted((tuple(r) for r in token_count_query(d, path).collect()), key=str)
        want = [(i, len((t or "").encode()), len(brute_ids(path, t, 0)) - 1) for i, t in rows_of(d)]
        assert got == sorted(((*w, w[2] > 1024) for w in want), key=str)
    assert token_count_query(none, path).count() == 0


def test_resync(spark):
    path = Q.tokenizer("byte_bpe_50k.json")
    rng = np.random.default_rng(9)
    bits = ["a", "bc", " ", "  ", "\n", "'s", "don't", "<|endoftext|>", "<|endo", "ftext|>", "é", "日", "1", "!", "\t ", "  \n", "😀"]
    for _ in range(400):
        text = "".join(rng.choice(bits, int(rng.integers(0, 200))))
        c = ResyncCounter(path, chunk=int(rng.choice([24, 40, 64])), overlap=int(rng.choice([2, 8, 16])))
        assert c.count_huge(text) == len(load(path).encode(text, add_special_tokens=False).ids)
    assert ResyncCounter(path, chunk=1000).count_huge("a" * 30000) == len(load(path).encode("a" * 30000).ids)

"""The pipeline, stage by stage, against brute-force versions; odd rows, empty tables, and the registry."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from test_operators import DOCS, ODD, brute_ids, brute_jaccard, brute_mix, crc
from vertexloom.llm import queries as Q
from vertexloom.llm.common import cut, table
from vertexloom.llm.langid import Bounds, left_out, picked, sample
from vertexloom.llm.langid import Model as LanguageModel
from vertexloom.llm.toxicity import learn


@pytest.fixture(scope="module")
def inputs(spark, sf):
    """What each stage reads, by name."""
    docs, out = table(spark, sf, "documents"), {}
    for name, stage in P.STAGES:
        out[name] = docs
        docs = cut(stage(spark, docs, sf), name)
    return out | {"end": docs}


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_keep_columns(spark, sf, inputs):
    want = table(spark, sf, "documents").columns
    assert all(inputs[name].columns == want for name, _ in P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "language_id", "ngram_jaccard_join", "mix_sources", "best_fit_packing"]


def test_toxicity_stage(spark, sf, inputs):
    model = learn(inputs["toxicity"], table(spark, sf, "labels"))
    want = [r for r in rows(inputs["toxicity"]) if model.score([r[1]])[0] < P.TOXIC]
    assert sorted(want) == sorted(rows(inputs["language_id"]))


def test_language_stage(spark, inputs):
    own = picked(inputs["language_id"], Bounds(), P.LEFT_OUT)
    model = LanguageModel(sample(inputs["language_id"], rows=own))
    others = [r.text for r in left_out(inputs["language_id"], own).collect()]
    assert len(others) == own.where("k % 4 = 0 and k <= 256").count() > 0
    most = P.SPREAD * np.quantile([model.predict([t])[2][0] for t in others if len(t) >= P.LONG], P.USUAL)
    want = []
    for r in rows(inputs["language_id"]):
        lang, _, rate = (x[0] for x in model.predict([r[1]]))
        if lang != "und" and rate <= most + P.FREE / len(r[1]):
            want.append(r)
    assert sorted(want) == sorted(rows(inputs["ngram_jaccard_join"]))
    assert len(want) > 0.95 * inputs["language_id"].count()


def test_language_stage_rejects_strangers(spark, sf):
    """Languages that weren't learned and dumps go, though they have letters; clean documents stay."""
    clean = table(spark, sf.replace("0.001", "0.01"), "documents").where("text is not null")
    strange = ["kun aamulla satoi vettä niin lapset jäivät sisälle ja lukivat kirjoja takkatulen ääressä koko päivän ajan hyvillä mielin " * 3,
               "dziś rano padał deszcz więc dzieci zostały w domu i czytały książki przy kominku przez cały długi dzień bez przerwy " * 3,
               "zkqj xwvz qqpk jjhz vkxq zwpt xkcd qzvj wxyk pfzg vbqk jxzw kqvp zzxq wvkj " * 5]
    odd = spark.createDataFrame([(10**9 + i, t, None, "a", len(t)) for i, t in enumerate(strange)], clean.schema)
    kept = {r[0] for r in P.language(spark, clean.unionByName(odd), sf).select("doc_id").collect()}
    assert not kept & {10**9 + i for i in range(len(strange))}
    assert len(kept) > 0.97 * clean.where("text rlike '[a-zA-Z]'").count()


def test_near_duplicate_stage(inputs):
    comp = {i: c for i, _, c in brute_jaccard([r[:2] for r in rows(inputs["ngram_jaccard_join"])])}
    want = [r for r in rows(inputs["ngram_jaccard_join"]) if comp[r[0]] == r[0]]
    assert sorted(want) == sorted(rows(inputs["mix_sources"]))
    assert len(want) < len(comp)


def test_mixing_stage(inputs):
    before = rows(inputs["mix_sources"])
    size, total, target = brute_mix([(r[0], r[1], r[3]) for r in before])
    copies = Counter(r[0] for r in rows(inputs["best_fit_packing"]))
    assert set(copies) <= {r[0] for r in before} and max(copies.values()) <= 2
    taken, most = Counter(), Counter()
    for r, n in zip(before, size):
        taken[r[3]] += n * copies[r[0]]
        most[r[3]] = max(most[r[3]], n)
    assert all(abs(taken[s] - target[s]) <= 1.5 * most[s] for s in target)


def test_packing_stage(spark, sf, inputs):
    path = Q.tokenizer("word_bpe_49k.json")
    want = []
    for r in rows(inputs["best_fit_packing"]):
        ids = brute_ids(path, r[1], 1)
        want += [(r[0], p, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for p, s in enumerate(range(0, len(ids), 4096))]
    got = inputs["end"].collect()
    assert sorted(want) == sorted(tuple(r)[:5] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 4096 and sorted(v)[0][0] == 0 for v in by.values())
    assert P.run(spark, sf).count() == len(got)


def test_odd_rows(spark, sf):
    docs = cut(spark.createDataFrame(ODD, DOCS).withColumn("mix", F.lit("x")).withColumn("_h", F.lit(1)), "odd")
    for name, stage in P.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf), name)
        if name != "best_fit_packing":
            assert docs.columns == before.columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "toxicity":
            assert len(ids) == len(ODD)
        if name == "language_id":
            assert not {3, 4, 5} & set(ids) and None in ids
        if name == "ngram_jaccard_join":
            assert sorted(str(i) for i in ids) == sorted(map(str, [1, 7, -5, None, 9]))
    assert docs.count() > 0


def test_empty_table(spark, sf):
    docs = cut(spark.createDataFrame([], DOCS), "none")
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, sf), name)
        assert docs.count() == 0


def full_collections(spark):
    """Of this JVM, which is the executor too: collections by the bean that counts full ones, the last of them."""
    return list(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())[-1].getCollectionCount()


def test_stages_begin_with_a_small_heap(spark, sf):
    """An executor's heap keeps what earlier stages took, which the workers' memory comes on top of."""
    docs = cut(spark.createDataFrame(ODD, DOCS), "odd")
    for name, stage in P.STAGES:
        before, out = full_collections(spark), stage(spark, docs, sf)
        assert full_collections(spark) > before, name
        docs = cut(out, name)


def test_registry():
    import __spark_entry__ as entry

    assert sorted(int(k[2:].split("_")[0]) for k in entry.queries() if k.startswith("op")) == list(range(1, 11))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())

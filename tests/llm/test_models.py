"""Quality, toxicity, language, nearest neighbours, mixing, and the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tidemark.llm import language, mixing, near_duplicates, nearest, quality, toxicity
from tidemark.llm.common import fold, table

MIDDLE = "/root/testdata/sf0.01"


def frame(spark, rows, schema=plain.DOCS):
    return spark.createDataFrame(rows, schema)


# quality


def test_quality_on_rows_not_learned_from(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    model = quality.fit(docs, labels.where("doc_id % 4 != 0"))
    got = quality.grade(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    assert ((got["quality"] == 1) == got["keep"]).mean() > 0.93


def test_three_grades_have_ordered_thresholds(spark):
    rows = [(i, " ".join(["good" if i % 3 else "bad", "fine" if i % 3 == 2 else "poor"] * 5)) for i in range(90)]
    model = quality.fit(frame(spark, rows, "doc_id long, text string"), frame(spark, [(i, i % 3) for i in range(90)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["expected_grade"] for r in quality.grade(frame(spark, rows[:3], "doc_id long, text string"), model).collect()}
    assert model.thresholds[0] < model.thresholds[1] and got[0] < got[1] < got[2]


def test_quality_edges(spark):
    df = frame(spark, plain.awkward())
    none = quality.grade(df, quality.fit(df, frame(spark, [], "doc_id long, quality int")))
    assert none.count() == df.count() and none.where("keep").count() == df.count()
    model = quality.fit(df, frame(spark, [(5, 1), (8, 0), (5, None), (None, 1)], "doc_id long, quality int"))
    assert quality.grade(df, model).where("expected_grade is null").count() == 0 and quality.grade(df.limit(0), model).count() == 0


def some_texts(spark):
    """Every thirtieth document, and the awkward ones with ids of their own."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, MIDDLE, "documents").where("doc_id % 30 = 0").collect()]
    return docs + [(-1 - i, r[1]) for i, r in enumerate(plain.awkward())]


def test_models_against_plain_scorers(spark):
    """Each model's scores, row by row, against one that takes the fitted model and one text at a time."""
    docs, labels, texts = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels"), some_texts(spark)
    asked = frame(spark, texts, "doc_id long, text string")
    model = quality.fit(docs, labels)
    for r in quality.grade(asked, model).collect():
        expected, tail = plain.grade(dict(texts)[r["doc_id"]], model, quality.features)
        assert abs(r["expected_grade"] - expected) < 1e-4 and abs(r["tail_probability"] - tail) < 1e-4
        assert r["keep"] == (r["tail_probability"] >= quality.KEEP)
    model = language.fit(docs)
    for r in language.predict(asked, model).collect():
        name, p = plain.language(dict(texts)[r["doc_id"]], model, language.ngrams)
        assert r["lang_pred"] == name and abs(r["score"] - p) < 1e-3
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(asked, model, "doc_id").collect():
        want = plain.toxicity(dict(texts)[r["doc_id"]], model, toxicity.CALIBRATION_BINS)
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)


# toxicity


def test_isotonic_fit_is_non_decreasing():
    steps = toxicity.isotonic([(0.1, 0.5, 1), (0.2, 0.1, 3), (0.3, 0.4, 1), (0.4, 0.9, 2), (0.5, 0.7, 2)])
    levels = [y for _, y in steps]
    assert levels == sorted(levels) and abs(levels[0] - 0.2) < 1e-9


def test_toxicity_on_rows_not_learned_from(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    learnable = fold("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learnable), labels.where(learnable))
    got = toxicity.score(docs, model, "doc_id").join(labels.where(~learnable), "doc_id").toPandas()
    assert got["score"].between(0, 1).all() and (got["toxic"] == got["predicted"]).mean() > 0.93
    assert got[got["toxic"] == 0]["predicted"].mean() < 0.05
    df = frame(spark, plain.awkward()).withColumn("features", F.lit(1)).withColumn("prediction", F.lit(2))
    scored = toxicity.score(df, model, *df.columns)
    assert scored.count() == df.count() and scored.where("score is null").count() == 0 and toxicity.score(df.limit(0), model, "doc_id").count() == 0


def test_toxicity_scores_are_calibrated_on_new_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    learnable = fold("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learnable), labels.where(learnable))
    got = toxicity.score(docs.where(~learnable), model, "doc_id").join(labels, "doc_id").where("toxic is not null").toPandas()
    assert abs(got["score"].mean() - got["toxic"].mean()) < 0.02
    for low, high in ((0.0, 0.1), (0.1, 0.9), (0.9, 1.01)):
        own = got[got["score"].between(low, high, inclusive="left")]
        assert len(own) < 30 or abs(own["score"].mean() - own["toxic"].mean()) < (0.25 if low == 0.1 else 0.05)


def test_toxicity_with_nothing_to_learn(spark):
    df = frame(spark, plain.awkward())
    model = toxicity.fit(df, frame(spark, [(5, None)], "doc_id long, toxic int"))
    assert model is None and toxicity.score(df, model, "doc_id").where("predicted = 0").count() == df.count()


def test_hidden_and_shouted_hits_are_features():
    import pyarrow as pa

    from tidemark.llm import textbytes as tb

    data, offsets = tb.utf8(pa.array(["you idiot", "YOU ST*PID 1d10t", "calm words", None]))
    got = dict(zip(toxicity.FEATURES, toxicity.Lexicon(np.zeros(0, np.uint64)).features(data, offsets).T.tolist(), strict=True))
    assert got["hits"] == [1, 0, 0, 0] and got["near_you"] == [1, 0, 0, 0] and got["hidden"][1] >= 1 and got["shouted"][1] > 0


# language


def test_language_on_rows_not_learned_from(spark):
    got = language.op10_language(spark, MIDDLE).join(table(spark, MIDDLE, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_edges(spark):
    df = frame(spark, plain.awkward())
    model = language.fit(df)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(df, model).collect()}
    assert (1, "und") in got and (2, "und") in got and (3, "und") in got and (8, "en") in got
    assert language.fit(df.limit(0)) is None and language.predict(df, None).where("lang_pred = 'und' and score = 0").count() == df.count()
    assert language.predict(df.limit(0), model).count() == 0


def test_more_languages_than_the_bound_are_an_error(spark, monkeypatch):
    rows = frame(spark, [(i, "some text", f"l{i}", "s", 1) for i in range(5)] + [(9, "x", None, "s", 1)])
    monkeypatch.setattr(language.linear, "MAX_CLASSES", 4)
    with pytest.raises(ValueError, match="more than 4"):
        language.fit(rows)
    monkeypatch.setattr(language.linear, "MAX_CLASSES", 5)
    assert len(language.fit(rows).languages) == 5


def test_means_of_long_rows_are_added_up_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    values, features = rng.normal(size=(50, 3)).astype(np.float32), rng.integers(0, 50, 400)
    at = np.array([0, 0, 7, 7, 260, 399, 400, 400])
    want = np.array([values[features[a:b]].astype(float).mean(axis=0) if b > a else np.zeros(3) for a, b in zip(at, at[1:], strict=False)])
    for size in (1, 30, 1 << 20):
        monkeypatch.setattr(language.linear, "_GATHERED", size)
        assert np.allclose(language.linear.row_means(values, features, at), want, atol=1e-5)


def test_language_of_a_text_above_a_batch(spark):
    docs = table(spark, MIDDLE, "documents")
    model = language.fit(docs)
    long = " ".join(r["text"] for r in docs.where("lang = 'fr' and text is not null").collect())
    while len(long) < 3 << 20:
        long += long
    assert [r["lang_pred"] for r in language.predict(frame(spark, [(1, long)], "doc_id long, text string"), model).collect()] == ["fr"]


def test_ngrams_of_one_row_are_those_of_many():
    import pyarrow as pa

    from tidemark.llm import textbytes as tb

    for text in ("", "é", "ab", "Une phrase, là."):
        one, many = language.ngrams(*tb.utf8(pa.array([text]))), language.ngrams(*tb.utf8(pa.array([text, ""])))
        assert one[0].tolist() == many[0].tolist() and one[1].tolist() == many[1][:2].tolist()


def test_ngrams_lie_by_row():
    import pyarrow as pa

    from tidemark.llm import textbytes as tb

    texts = ["Abc é", "", "abc é", "x"]
    data, offsets = tb.utf8(pa.array(texts))
    f, at = language.ngrams(data, offsets)
    assert np.diff(at).tolist() == [5 + 4 + 3, 0, 12, 1] and sorted(f[:12].tolist()) == sorted(f[at[2] : at[3]].tolist())


# nearest


def test_recall_against_brute_force(spark):
    got = nearest.op9_nearest(spark, MIDDLE).toPandas()
    e = table(spark, MIDDLE, "embeddings").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.array(e["embedding"].tolist(), float)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        own = got[got["query_id"] == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and own["score"].is_monotonic_decreasing
        assert np.allclose(own["score"], [float(x[np.flatnonzero(ids == v)[0]] @ x[i]) for v in own["vec_id"]])
        hits += len(set(ids[order]) & set(own["vec_id"]))
        total += 20
    assert hits / total >= 0.9


def test_nearest_edges(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(30)] + [(40, None), (60, [0.0, 0.0]), (61, [1.0, None]), (62, [float("nan"), 1.0]), (63, [float("inf"), 1.0]), (64, [1.0]), (None, [1.0, 1.0])]
    df = frame(spark, rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit(1)).withColumn("v", F.lit(2))
    got = nearest.nearest(df).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 20} and len(got) == 40 and not {r["vec_id"] for r in got} & {40, 60, 61, 62, 63, 64, None}
    assert [r["vec_id"] for r in got[20:29]] == [2, 5, 8, 11, 14, 17, 23, 26, 29]  # ties to the smaller id, never itself
    assert nearest.nearest(df.limit(0)).count() == 0


def test_every_query_gets_all_its_neighbours(spark, monkeypatch):
    """However few visits calibration finds enough, leaves of few rows don't shorten a query's list."""
    monkeypatch.setattr(nearest, "calibrate", lambda *_: 1)
    rng = np.random.default_rng(5)
    centres = np.concatenate([np.repeat(10 * np.eye(16), 60, axis=0), np.repeat(-40 * np.eye(16), 4, axis=0)])
    x = centres + rng.normal(size=centres.shape) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = nearest.nearest(frame(spark, rows, "vec_id long, embedding array<double>")).toPandas()
    n = got.groupby("query_id")["rank"].agg(["count", "max"])
    assert sorted(n.index) == list(range(0, 1024, 20)) and (n == 20).all().all()
    assert not (got["query_id"] == got["vec_id"]).any()


def test_rows_that_repeat_a_key_ask_and_are_found(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [3.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest(df).collect())
    assert got == [(0, 1, 1, 3.0), (0, 1, 1, 6.0), (0, 2, 0, 2.0), (0, 2, 0, 2.0)]


def test_recall_on_clustered_vectors_in_many_buckets(spark, monkeypatch):
    """Six thousand vectors of large norm around a hundred centres: few leaves are visited, none is read whole by one task."""
    monkeypatch.setattr(nearest, "BUCKET_ROWS", 400)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(100, 24)) * 1e6)[rng.integers(0, 100, 6000)] + rng.normal(size=(6000, 24)) * 1e5
    x[:900] = x[0] + rng.normal(size=(900, 24)) * 1e3  # a large leaf
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.nearest(df).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        score = x @ x[q]
        best = [j for j in np.argsort(-score, kind="stable") if j != q][:20]
        hits += len(set(best) & set(own["vec_id"]))
        assert sorted(own["rank"]) == list(range(1, 21)) and q not in set(own["vec_id"])
    assert got["query_id"].nunique() == 300 and hits >= 0.9 * 6000


# mixing


def check_mix(got, docs):
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    want = plain.fill([sum(r["size"] for r in by[s]) for s in names])
    for s, t in zip(names, want, strict=True):
        rows = by[s]
        assert abs(rows[0]["target"] - t) < 1e-6 * max(1, t) and rows[0]["source_size"] == sum(r["size"] for r in rows)
        taken = sum(r["copies"] * r["size"] for r in rows)
        assert abs(taken - t) <= max([r["size"] for r in rows] + [1]) and all(0 <= r["copies"] <= 3 for r in rows)


def test_rows_that_differ_in_source_only_keep_their_own(spark):
    rows = [(k, f"same words {k} again", s) for k in [*range(40), *[None] * 20] for s in ("c", None, "a", "b")]
    rows += [(1000 + i, "more words " * (i % 7 + 1), "abc"[i % 5 % 3]) for i in range(90)]
    sizes = {}
    for _, text, s in rows:
        sizes[s] = sizes.get(s, 0) + len(text.split())
    got = mixing.mix(frame(spark, rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(r["source_size"] == sizes[r["source"]] for r in got)
    check_mix(got, None)


def test_mix_reaches_its_targets(spark, small, monkeypatch):
    docs = table(spark, small, "documents")
    one = mixing.mix(docs).collect()
    check_mix(one, docs)
    monkeypatch.setattr(mixing, "CELL_ROWS", 2)  # cells in parts
    two = mixing.mix(docs.repartition(7)).collect()
    check_mix(two, docs)
    again = mixing.mix(docs).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in two) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_mix_edges(spark):
    df = frame(spark, plain.awkward()).withColumn("rate", F.lit(1)).withColumn("_key", F.lit(1))
    got = mixing.mix(df)
    rows = got.collect()
    assert len(rows) == df.count() and got.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "_key"]
    check_mix(rows, df)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.repeat_copies(got).count() == sum(r["copies"] for r in rows)


def test_rates_have_the_least_entropy_that_meets_the_targets(spark):
    """Relative entropy to one copy each, weighted by words: no other rates that take a source's target have less."""
    import math
    import random

    rng = random.Random(5)
    rows = [(i, "word " * rng.choice((1, 2, 5, 30, 200)), rng.choice("aabbbbc")) for i in range(400)]
    by = {}
    for r in mixing.mix(frame(spark, rows, "doc_id long, text string, source string")).collect():
        by.setdefault(r["source"], []).append((r["size"], r["rate"], r["target"]))
    entropy = lambda sizes, rates: sum(n * (r * math.log(r) - r + 1) for n, r in zip(sizes, rates, strict=True))
    for found in by.values():
        sizes, rates, target = [n for n, _, _ in found], [r for _, r, _ in found], found[0][2]
        assert sum(n * r for n, r in zip(sizes, rates, strict=True)) == pytest.approx(target)
        least = entropy(sizes, rates)
        for _ in range(200):
            i, j = rng.sample(range(len(sizes)), 2)
            words = rng.uniform(-0.5, 0.5) * min(sizes[i] * rates[i], sizes[j] * rates[j])
            other = list(rates)
            other[i] += words / sizes[i]
            other[j] -= words / sizes[j]
            assert entropy(sizes, other) >= least - 1e-9


def test_targets_by_hand(spark):
    sizes = [100, 10, 0, 1000, 7, 7, 400, 3]
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame(spark, rows, "source string, source_size long")).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(plain.fill(sizes))


# pipeline


def test_pipeline_against_plain_stages(spark, small):
    import corpus_pipeline as p

    docs = table(spark, small, "documents")
    benchmark = [tuple(r) for r in table(spark, small, "benchmark").select("item_id", "text").collect()]
    columns = docs.columns
    stages = dict(p.STAGES)
    first = p.cut(stages["toxicity"](spark, docs, small))  # learned from eighty labelled rows
    toxic = {r["doc_id"] for r in table(spark, small, "labels").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in table(spark, small, "labels").where("toxic = 0").collect()}
    kept = {r["doc_id"] for r in first.collect()}
    assert len(kept & toxic) <= 0.25 * len(toxic) and len(clean - kept) <= 0.02 * len(clean)

    second = p.cut(stages["near_duplicates"](spark, first, small))
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    roots, sizes = plain.classes(rows, 5, 80)
    assert {r["doc_id"] for r in second.collect()} == {k for k, root in roots.items() if k == root or not sizes[k]}

    third = p.cut(stages["decontamination"](spark, second, small))
    assert {r["doc_id"] for r in third.collect()} == {r["doc_id"] for r in second.collect() if not plain.hit_words(r["text"], benchmark)[1]}

    fourth = p.cut(stages["mixing"](spark, third, small))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(third).collect()}
    got = {r["doc_id"]: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in copies.items() if n} and max(got.values()) <= 3
    sizes, of = {}, {}  # words of each document, and of each source, counted here
    for r in third.collect():
        sizes[r["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        of.setdefault(r["source"], []).append(r["doc_id"])
    names = sorted(s for s in of if s is not None) + ([None] if None in of else [])
    for s, target in zip(names, plain.fill([sum(sizes[k] for k in of[s]) for s in names]), strict=True):
        assert abs(sum(got.get(k, 0) * sizes[k] for k in of[s]) - target) <= max([sizes[k] for k in of[s]] + [1])
    assert all(x.columns == columns for x in (first, second, third, fourth))
    last = stages["sharding"](spark, fourth, small)
    assert last.count() == fourth.count() and set(columns) < set(last.columns)


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Nulls, repeats under two sources, columns named like those of the work, an empty table: run() from end to end."""
    import corpus_pipeline as p

    rows = plain.awkward([(20 + i, f"plain text number {i} of its own " + f"word{i} " * (i % 9 + 1), "en", "ab"[i % 2], i) for i in range(60)])
    rows += [(90, "the same words under two sources here", "en", s, 1) for s in ("a", "b")]
    docs = frame(spark, rows)
    for c in ("score", "predicted", "size", "copies", "slot_", "__slot", "__shard", "__key", "features", "prediction"):
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    labels = frame(spark, [(20, 0, 1), (21, 1, 0), (None, 1, 0), (22, None, None)], "doc_id long, quality int, toxic int")
    benchmark = frame(spark, [("x", None), ("y", ""), (None, "word3 word3")], "item_id string, text string")
    for name, t in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    assert set(docs.columns) < set(got[0].asDict()) and all(r["score"] == f"score {'none' if r['doc_id'] is None else r['doc_id']}" for r in got)
    assert all(r["__slot"].startswith("__slot ") and r["size"].startswith("size ") for r in got)
    ids = {r["doc_id"] for r in got}
    assert 23 not in ids and not {5, 6} <= ids  # contaminated (word3 word3), and copies of one text
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for name, t in (("labels", labels), ("benchmark", benchmark)):
        t.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert p.run(spark, f"{tmp_path}/empty").count() == 0


def test_near_duplicate_defaults():
    import inspect

    given = inspect.signature(near_duplicates.keep_first).parameters
    assert given["words"].default == 5 and given["percent"].default == 80

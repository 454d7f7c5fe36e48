"""Learnt operators: held-out accuracy, method details, the pipeline's stages."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import empty, frame, no_labels, odd  # noqa: F401
from limnos.llm import language_id, quality_classifier, quality_rules, queries

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.01"


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def labelled(spark, df):
    return df.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()


def test_isolation_rules_keep_good_and_drop_bad(spark):
    rows = labelled(spark, queries.op3_quality_rules(spark, SF))
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) >= 0.985 and sum(bad) / len(bad) <= 0.1
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_forest_scores_match_a_slow_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    forest = quality_rules.grow_forest(x, trees=10, subsample=64)
    odd = np.vstack((x[:20], [[9, 9, 9]]))

    def slow(row):
        total = 0.0
        for at in forest["roots"]:
            while forest["feature"][at] >= 0:
                at = forest["left"][at] if row[forest["feature"][at]] < forest["split"][at] else forest["right"][at]
            total += forest["path"][at]
        return 2 ** (-total / 10 / forest["norm"])

    got = quality_rules.anomaly(forest, odd)
    assert np.allclose(got, [slow(r) for r in odd]) and got[-1] == got.max()
    same = quality_rules.grow_forest(np.ones((50, 3)), trees=3)
    assert len(set(quality_rules.anomaly(same, x).tolist())) == 1


def test_rules_without_labels_reject_by_base_only(spark, odd, no_labels):
    out = quality_rules.isolation_rules(odd, no_labels).collect()
    assert all(r["kept"] != r["base_failed"] for r in out)
    kept = Counter(repr(r["doc_id"]) for r in quality_rules.keep_good(odd, no_labels).collect())
    assert kept == Counter(repr(r["doc_id"]) for r in out if r["kept"])


def test_duplicate_lines_are_judged_by_the_forest(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n)) + rng.choice([".", "!", ""])
    rows = [(i, "\n".join(line(6) for _ in range(12)), "en", "s", 1) for i in range(600)]
    menus = [(1000 + i, "\n".join(f"{line(4)}\nhome\nshop" for _ in range(12)), "en", "s", 1) for i in range(12)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1000 + i, 0, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.isolation_rules(frame(spark, rows + menus), labels).collect()}
    assert not any(r["base_failed"] for r in got.values()) and all(got[1000 + i]["n_dup_lines"] == 22 for i in range(12))
    assert not any(got[1000 + i]["kept"] for i in range(12)) and sum(got[i]["kept"] for i in range(600)) >= 580


def test_language_accuracy_on_held_out_rows(spark):
    rows = queries.op7_language_id(spark, SF).join(docs(spark).select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_naive_bayes_matches_a_slow_version(spark):
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"),
                                                                ("le chat et le chien", "fr"), ("and then there was", "en"), (None, "en"),
                                                                ("Und dann war da", "de"), ("", "fr"), ("no lang", None)])]
    df = frame(spark, rows)
    langs, logs = language_id.train(df)
    assert langs == ["de", "en", "fr"]
    for j, lang in enumerate(langs):
        n = np.full(language_id.BUCKETS, language_id.SMOOTH)
        for _, t, la, *_ in rows:
            if la == lang and t:
                for b in language_id.grams(language_id.code_points(t)).tolist():
                    n[b] += 1
        assert np.allclose(logs[:, j], np.log(n / n.sum()), atol=1e-5)
    assert language_id.predict("der Hund und", langs, logs)[0] == "de"
    for t in (None, "", "12 !? 34", "\n"):
        assert language_id.predict(t, langs, logs) == ("und", 0.0)
    assert language_id.predict("x", [], logs) == ("und", 0.0)
    long = "the cat " * 3000
    a = language_id.predict(long, langs, logs)
    assert a[0] == "en" and math.isclose(a[1], 1.0)


def test_training_reads_no_held_out_row(spark):
    df = docs(spark, SMALL)
    spoilt = df.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))) \
               .withColumn("source", F.lit("other"))
    a = {r["doc_id"]: tuple(r) for r in language_id.identify_languages(df).collect()}
    b = {r["doc_id"]: tuple(r) for r in language_id.identify_languages(spoilt).collect()}
    assert a == b


@pytest.mark.parametrize("product", [1 << 21, 1 << 15, 40])
def test_language_batch_is_the_dense_product(monkeypatch, product):
    """One sparse product a batch: texts without letters between others, short and very long ones, blocks of any size."""
    monkeypatch.setattr(language_id, "PRODUCT", product)
    rng = np.random.default_rng(2)
    logs = np.log(rng.dirichlet(np.ones(language_id.BUCKETS) * 0.1, 5).T + 1e-9).astype(np.float32)
    langs = list("abcde")
    texts = [None, "a", "12 34", "", *("".join(map(chr, rng.integers(97, 400, n))) for n in (3, 50, 900, 9000)), "ß", None]
    got = language_id.predict_batch(texts, langs, logs)
    for t, lang, score in zip(texts, *got):
        if not language_id.has_letter(t):
            assert (lang, score) == ("und", 0.0)
            continue
        dense = np.zeros(language_id.BUCKETS)
        for b in language_id.grams(language_id.code_points(t)).tolist():
            dense[b] += 1
        total = dense @ logs.astype(np.float64)
        p = np.exp(total - total.max())
        assert lang == langs[int(p.argmax())] and abs(score - p.max() / p.sum()) < 1e-9
    assert language_id.predict_batch(texts, [], logs)[0] == ["und"] * len(texts)
    assert language_id.predict_batch([], langs, logs)[0] == []


def test_co_training_accuracy_on_unseen_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0)
    rest = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    rows = quality_classifier.classify_quality(docs(spark), seen).join(rest, "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in rows) / len(rows)
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert right >= 0.95 and sum(good) / len(good) >= 0.98


def test_exchange_does_not_lower_the_result(spark):
    """On labels that the model never saw, two rounds rank documents as well as none."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    at = docs(spark).cache()

    def auc(rows):
        good = np.array([r["score"] for r in rows if r["quality"] == 1])
        return np.mean([(r["score"] < good).mean() + (r["score"] == good).mean() / 2 for r in rows if r["quality"] == 0])

    for seed in (1, 2, 3):
        part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2 if seed == 3 else 4))
        seen, rest = labels.filter(part > 0), labels.filter(part == 0)
        none, two = (auc(quality_classifier.classify_quality(at, seen, rounds=n).join(rest, "doc_id").collect()) for n in (0, 2))
        assert two >= none - 0.004, (seed, none, two)
    at.unpersist()


def test_co_training_without_both_classes(spark, odd, no_labels):
    out = quality_classifier.classify_quality(odd, no_labels).collect()
    assert len(out) == odd.count()
    texts = Counter((r["doc_id"], bool(r["text"] and r["text"].encode().strip())) for r in odd.collect())
    assert Counter((r["doc_id"], r["kept"]) for r in out) == texts


def test_logistic_fit_separates():
    x = np.array([[-2.0], [-1.0], [1.0], [2.0]])
    beta = quality_classifier.fit_logistic(x, np.array([0, 0, 1, 1.0]), np.array([5, 5, 5, 5.0]))
    assert beta[0] > 1 and abs(beta[1]) < 0.2


def test_pipeline_stages(spark):
    import corpus_pipeline
    from test_exact import slow_components, slow_fingerprint, slow_leaks

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    at = docs(spark, SMALL)
    columns = at.columns
    outs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, at, SMALL)
        assert got.columns[:5] == columns and (i == 4 or got.columns == columns)
        outs.append([r.asDict() for r in got.collect()])
        at = spark.createDataFrame([tuple(r[c] for c in got.columns) for r in outs[-1]], got.schema)
    first = {r["doc_id"] for r in queries.op3_quality_rules(spark, SMALL).filter("kept").collect()}
    assert {r["doc_id"] for r in outs[0]} == first
    comp = slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in outs[0]])
    assert {r["doc_id"] for r in outs[1]} == {c for _, _, c in comp} and len(outs[1]) == len({c for _, _, c in comp})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert [r["doc_id"] for r in outs[2]] and {r["doc_id"] for r in outs[2]} == {r["doc_id"] for r in outs[1] if not slow_leaks(r["text"], items)}
    assert len(outs[4]) == len(outs[3]) and {r["doc_id"] for r in outs[3]} <= {r["doc_id"] for r in outs[2]}
    assert len(corpus_pipeline.run(spark, SMALL).collect()) == len(outs[4])

import random

import numpy as np

from lodestone.llm import toxicity as X


def table(spark, n=600, seed=1):
    r = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(300)], ["vile", "rotten", "foulmouth"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [r.choice(plain) for _ in range(r.randint(5, 80))]
        for _ in range(r.randint(2, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", "s", "ly"]))
        rows.append((i, " ".join(words).capitalize()))
        labels.append((i, int(toxic), 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels


def test_held_out_accuracy_and_order_of_severity(spark):
    docs, labels = table(spark)
    train = spark.createDataFrame(labels[:300], "doc_id long, toxic int, quality int")
    model = X.train(docs, train)
    assert (np.diff(model.thresholds) > 0).all() and len(model.weights) == len(model.cues) + 1
    got = {r.doc_id: r for r in X.score_toxicity(docs, model).collect()}
    held = labels[300:]
    assert sum(got[i].toxic == bool(t) for i, t, _ in held) / len(held) > 0.97
    toxic, clean = ([got[i].severity for i, t, _ in held if t == y] for y in (1, 0))
    assert min(toxic) > max(0.5, np.mean(clean)) and all(0 <= r.severity <= X.GRADES - 1 for r in got.values())


def test_gradients_find_the_thresholds():
    rows = [{0: float(x)} for x in range(3) for _ in range(50)] + [{}]
    grades = np.array([0] * 50 + [1] * 50 + [2] * 50 + [0])
    w, theta = X.fit_ordinal(rows, grades, np.ones(151), 1, 3)
    assert w[0] > 0 and theta[0] < theta[1] and theta[0] < w[0] * 1 < theta[1]


def test_odd_tables(spark, odd_rows, odd_docs, clashing_docs, no_docs):
    labels = "doc_id long, toxic int"
    none = spark.createDataFrame([], labels)
    odd = spark.createDataFrame([(0, 1), (1, None), (None, 1), (2, 0), (0, 0), (3, 0)], labels)
    for marked in (none, odd):
        for docs in (odd_docs, clashing_docs):
            got = X.score_toxicity(docs, X.train(docs, marked)).collect()
            assert len(got) == len(odd_rows) and all(0 <= r.p_toxic <= 1 for r in got)
        assert X.score_toxicity(no_docs, X.train(no_docs, marked)).count() == 0
    assert not any(r.toxic for r in X.score_toxicity(odd_docs, X.train(odd_docs, none)).collect())


def test_grades_of_the_labels_are_learnt(spark):
    r = random.Random(3)
    plain = [f"word{i}" for i in range(300)]
    mild, harsh = ["silly", "stupidly"], ["murderous", "hatefully"]
    rows, labels = [], []
    for i in range(900):
        grade = r.choice([0, 0, 0, 1, 2])
        words = [r.choice(plain) for _ in range(40)] + [r.choice(mild if grade == 1 else harsh) for _ in range(3 if grade else 0)]
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.severity for x in X.score_toxicity(docs, X.train(docs, spark.createDataFrame(labels[:500], "doc_id long, toxic int"))).collect()}
    by = [[got[i] for i, g in labels[500:] if g == k] for k in range(3)]
    assert max(by[0]) < 0.5 < min(by[1]) and np.mean(by[1]) < 1.4 < 1.6 < np.mean(by[2])


def test_held_out_labels_of_the_documents(spark):
    """Trained on every second labelled row; the figures in the README come from this way of measuring, on check_s."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = X.score_toxicity(docs, X.train(docs, labels.where("doc_id % 2 = 0"))).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "said"), "doc_id").collect()
    toxic, clean = [x.toxic for x in got if x.said], [x.toxic for x in got if not x.said]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean), (sum(toxic), len(toxic), sum(clean), len(clean))


def loss(rows, grades, times, w, theta, l2=1e-3):
    """The negative log-likelihood of a row, and the penalty, written out."""
    total = 0.0
    for row, grade, n in zip(rows, grades, times, strict=True):
        score = sum(v * w[i] for i, v in row.items())
        at_most = [1 / (1 + np.exp(-(t - score))) for t in theta] + [1.0]
        total -= n * np.log(max(at_most[grade] - (at_most[grade - 1] if grade else 0.0), 1e-12))
    return total / sum(times) + 0.5 * l2 * sum(x * x for x in w) / len(w)


def test_the_fit_is_as_good_as_a_slow_minimizer():
    """Pattern search over all numbers at once, from several starts, on labels that no line divides."""
    r = random.Random(21)
    rows = [{j: r.choice([0.7, 1.1, 2.0]) for j in range(2) if r.random() < 0.6} for _ in range(60)] + [{}]
    grades = [min(2, max(0, int(sum(v * (1, -0.6)[j] for j, v in x.items()) + r.gauss(0.6, 1.0)))) for x in rows]
    times = [1.0] * 60 + [7.0]
    w, theta = X.fit_ordinal(rows, np.array(grades), np.array(times), 2, 3, steps=3000)
    best = np.inf
    for _ in range(3):
        point, step = [r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-1, 1)], 1.0
        value = lambda p: loss(rows, grades, times, p[:2], [p[2], p[2] + np.exp(p[3])])
        here = value(point)
        while step > 1e-4:
            moved = False
            for i in range(4):
                for sign in (1, -1):
                    other = [x + sign * step * (i == j) for j, x in enumerate(point)]
                    if (there := value(other)) < here - 1e-12:
                        point, here, moved = other, there, True
            step = step if moved else step / 2
        best = min(best, here)
    assert loss(rows, grades, times, w, theta) <= best + 2e-4


def test_training_takes_no_more_labels_than_its_bound(spark, monkeypatch):
    """And which ones follows from identifiers: another order of the rows gives the same model."""
    docs, labels = table(spark, 400)
    sizes, plain = [], X.written
    monkeypatch.setattr(X, "written", lambda df, *a: (sizes.append((out := plain(df, *a)).count()), out)[1])
    marked = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    models = [X.train(d, m, train_rows=120) for d, m in ((docs, marked), (docs.orderBy("text"), marked.repartition(5)))]
    assert sizes[0] <= 120 and len(set(sizes)) == 1
    assert models[0].cues == models[1].cues and np.array_equal(models[0].weights, models[1].weights)
    every = X.train(docs, marked, train_rows=10_000)
    assert max(sizes) > 120 and set(models[0].cues) != set(every.cues) or len(every.cues) >= len(models[0].cues)

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import quality, rules

from .samples import ODD, documents, prose


def corpus(n):
    texts = []
    for i in range(n):
        t = prose(i, 20 + i % 200)
        texts.append(t if i % 3 else (t.upper().replace(" ", "!! ") if i % 2 else t.replace(" ", " ### ")))
    return texts


def test_held_out_rows_are_told_apart(spark):
    texts = corpus(900)
    stats = rules.statistics(documents(spark, texts)).cache()
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(900)] + [(1, None), (None, 0), (5000, 1)], "doc_id long, quality int")
    model = quality.fit(stats.filter(~quality.held_out()), labels)
    out = quality.score(stats, model).withColumn("held_out", quality.held_out()).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 100
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    odd = quality.score(rules.statistics(documents(spark, [*ODD, None])), model).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in odd)


def test_isotonic():
    good, total = np.array([0, 3, 1, 0, 5.0]), np.array([4, 4, 4, 0, 5.0])
    y = quality.pool_adjacent(good, total)
    assert (np.diff(y) >= 0).all() and len(y) == 5
    assert abs(y[1] - 4.5 / 9) < 1e-9


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    stats = rules.statistics(documents(spark, ["a b", None]))
    model = quality.fit(stats, none)
    assert model is None
    assert [r["score"] for r in quality.score(stats, model).collect()] == [0.5, 0.5]
    assert quality.score(rules.statistics(documents(spark, [])), model).count() == 0


def test_equals_direct_computation(spark):
    """Features, ridge weights, calibration and scores, from all rows at once in NumPy."""
    texts = corpus(600)
    stats = rules.statistics(documents(spark, texts)).cache()
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 600, 2)], "doc_id long, quality int")
    model = quality.fit(stats, labels)
    rows = stats.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4))).orderBy("doc_id").toArrow()
    ids, part = rows["doc_id"].to_numpy(), rows["part"].to_numpy()
    x = quality.describe(rows.combine_chunks().to_batches()[0])
    known = ids % 2 == 0
    y = (ids % 3 > 0).astype(float)
    mean, scale = x[known].mean(0), x[known].std(0) + 1e-3
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale, atol=1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    phi = np.hstack([np.cos(z @ model.project + model.phase) * np.sqrt(2 / quality.FEATURES), np.ones((len(z), 1))])
    kernel = np.exp(-quality.GAMMA * ((z[:40, None] - z[None, :40]) ** 2).sum(2))
    assert np.abs(phi[:40, :-1] @ phi[:40, :-1].T - kernel).mean() < 0.06
    fit, held = known & (part != 0), known & (part == 0)
    ridge = quality.RIDGE * fit.sum() / quality.FEATURES
    weights = np.linalg.solve(phi[fit].T @ phi[fit] + ridge * np.eye(phi.shape[1]), phi[fit].T @ y[fit])
    raw = phi @ weights
    assert np.allclose(phi @ model.weights, raw, atol=1e-4)
    cell = np.clip(((raw + 0.5) / 2 * quality.CELLS).astype(int), 0, quality.CELLS - 1)
    good = np.bincount(cell[held], weights=y[held], minlength=quality.CELLS)
    total = np.bincount(cell[held], minlength=quality.CELLS).astype(float)
    order = np.flatnonzero(total)
    rate = good[order] / total[order]
    for a in range(len(order)):  # isotonic regression by its definition: the largest of the smallest means around each cell
        rate[a] = max(min(good[order[i : j + 1]].sum() / total[order[i : j + 1]].sum() for j in range(a, len(order))) for i in range(a + 1))
    blocks = model.curve_y[order]
    assert all((blocks[i] == blocks[j]) == (abs(rate[i] - rate[j]) < 1e-12) for i, j in zip(range(len(order)), range(1, len(order)), strict=False))
    want = 0.999 * np.interp(raw, model.curve_x, model.curve_y) + 0.001 * np.clip(raw, 0, 1)
    got = [r["score"] for r in quality.score(stats, model).orderBy("doc_id").collect()]
    assert np.allclose(got, want, atol=1e-3)


def test_clashing_columns_and_repeats(spark):
    texts = corpus(200)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int").withColumns({c: F.lit("clash") for c in ("score", "n_words")})
    model = quality.fit(rules.statistics(docs), labels)
    more = docs.withColumns({c: F.lit("clash") for c in ("_text", "score", "predicted", "n_words", "_quality")})
    once = {r["doc_id"]: r["score"] for r in quality.score(rules.statistics(docs), model).collect()}
    twice = quality.score(rules.statistics(more.union(more)), model).collect()
    assert len(twice) == 400 and all(r["score"] == once[r["doc_id"]] for r in twice)
    kept = quality.accepted(more.union(more), model)
    assert kept.columns == more.columns and kept.count() % 2 == 0

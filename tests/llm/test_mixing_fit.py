"""The rates of op3 against a reference solver, at the production targets."""

import numpy as np
import pytest

from querent.llm import mixing


def scored(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.5, 0.15, 0.1], 400) * 0.97 + 0.01
    tokens = rng.integers(0, 900, 400)
    return tokens.astype(float), p, spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p, strict=True)], "_tokens long, p_high double, p_low double, p_toxic double")


def test_totals_equal_a_reference_solvers(spark):
    tokens, p, table = scored(spark)
    rate, told = mixing.fit_rates(table, mixing.TARGETS)
    goal, weight = np.array([told["targets"][d] for d in mixing.DOMAINS]), tokens.sum()
    # Accelerated projected gradient on the rates themselves, restarted where it turns back.
    a, x, y, t = p * tokens[:, None] / weight, np.ones(400), np.ones(400), 1.0
    root = np.sqrt(np.maximum(tokens, 1e-9) / weight)
    scale = 1 / (np.linalg.norm(a / root[:, None], 2) ** 2 + mixing.HOLD)
    for _ in range(60000):
        slope = (p @ (a.T @ y - goal / weight)) + mixing.HOLD * (y - 1)
        new = np.maximum(0, y - scale * slope)
        if ((y - new) * (new - x) * tokens).sum() > 0:
            t, y = 1.0, x
            continue
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    want = a.T @ x * weight
    ours = np.array([told["totals"][d] for d in mixing.DOMAINS])
    assert np.abs(ours - want).max() < 1e-5 * sum(goal)
    got = np.array([r.rate for r in table.select(rate.alias("rate")).collect()])
    assert np.abs(got * (tokens > 0) - x * (tokens > 0)).max() < 1e-3
    assert abs(told["residual"] - np.abs(ours - goal).max() / sum(goal)) < 1e-9


def test_a_fit_that_does_not_settle_is_an_error(spark):
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.fit_rates(scored(spark)[2], mixing.TARGETS, steps=1)


def test_the_stage_follows_the_rates(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, 0.6, 0.1, 0), (2, 0.0, 0.1, 0), (3, 0.6, 0.6, 0), (4, 2.1, 0.1, 3)]
    mixed = spark.createDataFrame([(i, "t", "aa", "s", 1, r, p, c) for i, r, p, c in rows], "doc_id long, text string, lang string, source string, n_chars long, _rate double, p_toxic double, _copies int")
    monkeypatch.setattr(mixing, "mix", lambda *a, **k: mixed)
    assert sorted(r.doc_id for r in corpus_pipeline.mixture(spark, None, str(tmp_path)).collect()) == [1, 4, 4, 4]

"""Models learned from a stream against a plain replay of its batches."""

import numpy as np
import pandas as pd
import pytest

from skyloom.streaming import jobs, online
from skyloom.streaming.online import Online


def batches():
    rng = np.random.default_rng(9)
    out = []
    for i in range(4):
        x = rng.normal(size=(120, 2)) * [1, 3] + [0, 2]
        y = 1.5 * x[:, 0] - 0.4 * x[:, 1] + 2 + rng.standard_t(2, size=120) * 0.5 + i * 0.1
        out.append(pd.DataFrame({"a": x[:, 0], "b c": x[:, 1], "y": y, "error": "text"}))
    out[1].loc[:5, "a"] = np.nan
    return out


def replay(frames, s):
    """Error before learning and coefficients after it, batch by batch."""
    gram, beta, out = np.zeros((4, 4)), None, []
    for frame in frames:
        rows = frame.dropna()
        z = np.column_stack([np.ones(len(rows)), rows[["a", "b c"]], rows["y"]])
        e = z[:, :3] @ beta - z[:, 3] if beta is not None else None
        w = np.ones(len(z)) if e is None or s.epsilon is None else np.minimum(1, s.epsilon / np.abs(e))
        gram = s.keep * gram + (z * w[:, None]).T @ z
        beta = online.solve_penalised(gram, gram[0, 0], s)
        out.append((None if e is None else np.sqrt((e**2).mean()), beta))
    return out


@pytest.mark.parametrize("s", [Online(), Online(alpha=0.1, keep=0.5), Online(alpha=0.2, l1_share=0.7), Online(epsilon=0.6)])
def test_history_equals_a_replay(spark, tmp_path, s):
    frames, path = batches(), str(tmp_path)
    step = online.online_partial(["a", "b c"], "y", path, s)
    for i, frame in enumerate(frames):
        spark.createDataFrame(frame).write.mode("append").parquet(f"{path}/arrivals")
        jobs.run_partials(jobs.file_stream(spark, f"{path}/arrivals", None), step, path)
    want = replay(frames, s)
    history = {r["batch"]: r for r in online.error_history(jobs.partials(spark, path)).collect()}
    for i, (rmse, beta) in enumerate(want):
        assert online.model_of(spark, path, i) == pytest.approx(beta.tolist(), rel=1e-7, abs=1e-9)
        assert history[i]["rmse"] is None if rmse is None else history[i]["rmse"] == pytest.approx(rmse)


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    step = online.online_partial(["a"], "y", path)
    for again in (False, True):
        for i, frame in enumerate(batches()[:3]):
            if again and i < 2:
                continue
            step(spark.createDataFrame(frame), i).write.mode("overwrite").parquet(f"{path}/rows/batch={i}")
        found = [online.model_of(spark, path, i) for i in range(3)]
        if again:
            assert np.allclose(found, before, rtol=1e-12)
        before = found


def test_empty_batches(spark, tmp_path):
    path, frames = str(tmp_path), batches()
    step = online.online_partial(["a"], "y", path)
    for i, df in enumerate([spark.createDataFrame(frames[0]).limit(0), spark.createDataFrame(frames[0]), spark.createDataFrame(frames[0]).limit(0)]):
        step(df, i).write.mode("overwrite").parquet(f"{path}/rows/batch={i}")
    assert online.model_of(spark, path, 1) == online.model_of(spark, path, 2)
    assert [r["n"] for r in online.error_history(jobs.partials(spark, path)).orderBy("batch").collect()] == [0, 0, 0]


def test_absolute_penalties_meet_their_conditions():
    """No coordinate can be moved to a lower penalised error."""
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 5))])
    z = np.column_stack([x, x @ [1, 2, 0, 0, -1, 0.01] + rng.normal(size=200)])
    s = Online(alpha=0.2, l1_share=0.6)
    beta = online.solve_penalised(z.T @ z, 200.0, s)
    slope = x.T @ (x @ beta - z[:, -1]) + np.r_[0, np.full(5, 200 * 0.2 * 0.4)] * beta
    limit = 200 * 0.2 * 0.6
    for j in range(1, 6):
        assert abs(slope[j] + limit * np.sign(beta[j])) < 1e-6 if beta[j] else abs(slope[j]) <= limit + 1e-6
    assert abs(slope[0]) < 1e-6 and (beta == 0).any()

"""Model scoring in queries: linear models as SQL expressions, ONNX models as Arrow-batched functions."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SESSIONS: dict[tuple[str, float], object] = {}


def linear(x: Column | str, coefficient: float, intercept: float) -> Column:
    """coefficient * x + intercept in single precision, as a column expression."""
    x = F.col(x) if isinstance(x, str) else x
    return (F.lit(coefficient).cast("float") * x.cast("float") + F.lit(intercept).cast("float")).cast("float")


def register_linear(spark: SparkSession, name: str, coefficient: float, intercept: float) -> None:
    """A SQL function name(x); it is inlined into the plan."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x FLOAT) RETURNS FLOAT RETURN CAST(CAST({coefficient!r} AS FLOAT) * x + CAST({intercept!r} AS FLOAT) AS FLOAT)")


def _session(path: str):
    """One for each file and worker."""
    import onnxruntime

    key = (path, os.path.getmtime(path))
    if key not in _SESSIONS:
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        _SESSIONS[key] = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    return _SESSIONS[key]


def _is_integer(inputs) -> bool:
    return all(i.type in ("tensor(int64)", "tensor(int32)") for i in inputs)


def score_rows(path: str, columns: list[pd.Series]) -> np.ndarray:
    """One score per row; a row with a null has none. Integer models get [n, 1] per input, or row by row if
    their first dimension is fixed; float models get each row as [1, 1, features]."""
    model = _session(path)
    inputs = model.get_inputs()
    n = len(columns[0])
    out, sound = np.full(n, np.nan, np.float32), ~np.logical_or.reduce([c.isna().to_numpy() for c in columns])
    if not sound.any():
        return out
    if _is_integer(inputs):
        if len(inputs) != len(columns):
            raise ValueError(f"the model takes {len(inputs)} inputs, got {len(columns)}")
        kinds = [np.int64 if i.type == "tensor(int64)" else np.int32 for i in inputs]
        x = [c[sound].to_numpy().astype(k).reshape(-1, 1) for c, k in zip(columns, kinds, strict=True)]
        if all(not isinstance(i.shape[0], int) or i.shape[0] < 0 for i in inputs):
            got = model.run(None, {i.name: v for i, v in zip(inputs, x, strict=True)})[0].reshape(-1)
        else:
            got = [model.run(None, {i.name: v[r : r + 1] for i, v in zip(inputs, x, strict=True)})[0].reshape(-1)[0] for r in range(len(x[0]))]
        out[sound] = np.asarray(got, np.float32)
    else:
        x = np.stack([c[sound].to_numpy().astype(np.float32) for c in columns], 1)
        rank = len(inputs[0].shape)
        out[sound] = [model.run(None, {inputs[0].name: r.reshape((1,) * (rank - 1) + (-1,))})[0].reshape(-1)[0] for r in x]
    return out


def score_lists(path: str, columns: list[pd.Series]) -> list[list[float] | None]:
    """For each row of equally long lists, the flattened output for [1, length, features]."""
    model = _session(path)
    name, out = model.get_inputs()[0].name, []
    for row in zip(*columns, strict=True):
        if any(v is None or any(x is None for x in v) for v in row):
            out.append(None)
            continue
        x = np.stack([np.asarray(v, np.float32) for v in row], 1)[None]
        out.append(model.run(None, {name: x})[0].astype(np.float32).reshape(-1).tolist())
    return out


def register_onnx(spark: SparkSession) -> None:
    """onnx_predict(path, in1, ...) -> float and onnx_predict_list(path, list1, ...) -> array<float>."""

    @F.pandas_udf(T.FloatType())
    def onnx_predict(path: pd.Series, *columns: pd.Series) -> pd.Series:
        if not columns:
            raise ValueError("onnx_predict takes a path and at least one input")
        scores = pd.Series(np.full(len(path), np.nan, np.float32))
        for p in path.dropna().unique():
            at = (path == p).to_numpy()
            scores[at] = score_rows(p, [c[at] for c in columns])
        return scores.astype("float32").astype(object).where(scores.notna(), None)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def onnx_predict_list(path: pd.Series, *columns: pd.Series) -> pd.Series:
        if not columns:
            raise ValueError("onnx_predict_list takes a path and at least one input")
        return pd.Series(score_lists(path.iloc[0], list(columns)) if len(path) else [], dtype=object)

    spark.udf.register("onnx_predict", onnx_predict)
    spark.udf.register("onnx_predict_list", onnx_predict_list)

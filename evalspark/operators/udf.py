"""User-defined extension surface: custom metrics, evaluators, batch functions, transforms.

The preferred metric is a ``Callable[[Column, Column], Column]`` — it stays
in the JVM.  Arbitrary Python functions run as Arrow (pandas) UDFs; a failing
row scores 0 and carries its error text, so one bad row never fails a job.
Batch functions (model calls, user operations) run through ``mapInPandas``:
one function load per worker process, Arrow batches of
``spark.sql.execution.arrow.maxRecordsPerBatch`` rows, error rows kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])


def python_metric(fn: Callable[[str, str], float], normalizer: Callable[[float], float] | None = None):
    """UD1: wrap a Python ``fn(pred, ref) -> float`` as an Arrow UDF returning struct(score, error)."""
    norm = normalizer or (lambda x: x)

    @F.pandas_udf(RESULT)
    def run(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        scores, errors = [], []
        for p, r in zip(pred, ref):
            try:
                scores.append(float(norm(fn(p, r))))
                errors.append(None)
            except Exception as e:  # noqa: BLE001 — the error is part of the result
                scores.append(0.0)
                errors.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"score": scores, "error": errors})

    return run


@dataclass
class MetricRegistry:
    """UD1 / UD2: named metrics; each is a column builder over (pred, ref)."""
    builders: dict[str, Callable[[Column, Column], Column]] = field(default_factory=dict)

    def register(self, name: str, builder: Callable[[Column, Column], Column]) -> None:
        self.builders[name] = builder

    def register_python(self, name: str, fn: Callable[[str, str], float], normalizer=None) -> None:
        udf = python_metric(fn, normalizer)
        self.builders[name] = lambda p, r: udf(p, r)

    def list(self) -> list[str]:
        return sorted(self.builders)

    def evaluate(self, df: DataFrame, pred: str, ref: str, names: list[str] | None = None) -> DataFrame:
        """All requested metrics in one projection; Python metrics give ``<name>`` and ``<name>_error``."""
        out = df
        for n in names or self.list():
            c = self.builders[n](F.col(pred), F.col(ref))
            out = out.withColumn(f"_{n}", c)
            if isinstance(out.schema[f"_{n}"].dataType, T.StructType):
                out = out.withColumn(n, F.col(f"_{n}.score")).withColumn(f"{n}_error", F.col(f"_{n}.error"))
            else:
                out = out.withColumn(n, F.col(f"_{n}").cast("double"))
            out = out.drop(f"_{n}")
        return out


def batch_apply(df: DataFrame, fn: Callable[[pd.Series], pd.Series], col: str, out: str, out_type: str = "string",
                keep: list[str] | None = None) -> DataFrame:
    """UD4: apply a vectorised user function to every value of ``col``, batch by batch."""
    keep = keep or [c for c in df.columns]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(*keep).dtypes) + f", `{out}` {out_type}"

    def run(batches):
        for b in batches:
            yield b[keep].assign(**{out: fn(b[col]).to_numpy()})

    return df.select(*dict.fromkeys(keep + [col])).mapInPandas(run, schema).select(*keep, out)


def generate_batch(df: DataFrame, prompt: str, key: str, model_factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    """UD3: run a user model over every prompt; the model is built once per worker process, a
    failure becomes a row with empty text and ``finish_reason='error'``."""
    cache: dict = {}

    def run(batches):
        model = cache.get("m")
        if model is None:
            model = cache["m"] = model_factory()
        for b in batches:
            texts, reasons, errs = [], [], []
            for p in b[prompt].tolist():
                try:
                    texts.append(model(p))
                    reasons.append("stop")
                    errs.append(None)
                except Exception as e:  # noqa: BLE001
                    texts.append("")
                    reasons.append("error")
                    errs.append(str(e))
            yield pd.DataFrame({key: b[key].tolist(), "text": texts, "finish_reason": reasons, "error": errs})

    schema = f"`{key}` {dict(df.dtypes)[key]}, text string, finish_reason string, error string"
    return df.select(key, prompt).mapInPandas(run, schema)

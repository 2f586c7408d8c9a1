"""Models in workers: opened once, kept while nothing that they depend on changes, closed at the end, with batches that shrink when memory runs out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the messages of exhausted memory have in common.
EXHAUSTED = ("out of memory", "out_of_memory", "cannot allocate", "failed to allocate")


class Model(Protocol):
    """What a pool opens: it separates a source, and may be closed."""

    def separate(self, source: Any) -> Any: ...


def automatic_batch(backend: Column, free_gib: Column) -> Column:
    """Four where an accelerator has 12 GiB free, two with 8 or on shared memory, else one."""
    shared = backend.isin("mps", "coreml")
    return F.when(shared, 2).when((backend == "cuda") & (free_gib >= 12), 4).when((backend == "cuda") & (free_gib >= 8), 2).otherwise(1)


def batch_for(backend: str, free_gib: float = 0.0) -> int:
    """``automatic_batch`` for one worker."""
    if backend in ("mps", "coreml"):
        return 2
    return 1 if backend != "cuda" or free_gib < 8 else 4 if free_gib >= 12 else 2


def out_of_memory(e: BaseException) -> bool:
    return isinstance(e, MemoryError) or any(x in str(e).lower() for x in EXHAUSTED)


@dataclass
class ModelPool:
    """The open models of a worker, one for each name.

    ``opener(name, rate, batch)`` opens one. Another rate or batch closes it and opens it anew. A context closes all.
    Batches that have worked are remembered for each model and backend, and are where the next one starts.
    """

    opener: Callable[[str, int, int], Model]
    backend: str = "cpu"
    free_gib: float = 0.0
    _open: dict[str, tuple[tuple[int, int], Model]] = field(default_factory=dict)
    _worked: dict[tuple[str, str], int] = field(default_factory=dict)

    def get(self, name: str, rate: int, batch: int) -> Model:
        held = self._open.get(name)
        if held is not None and held[0] == (rate, batch):
            return held[1]
        self.close(name)
        model = self.opener(name, rate, batch)
        self._open[name] = (rate, batch), model
        return model

    def separate(self, name: str, rate: int, source: Any, batch: int | None = None) -> Any:
        """By the model, at ``batch`` or at the batch that worked last; where an accelerator's memory runs out, at half of it, down to one."""
        size = batch or self._worked.get((name, self.backend)) or batch_for(self.backend, self.free_gib)
        while True:
            try:
                out = self.get(name, rate, size).separate(source)
            except Exception as e:
                if self.backend == "cpu" or size <= 1 or not out_of_memory(e):
                    raise
                self.close(name)
                size = max(1, size // 2)
                continue
            if batch is None:
                self._worked[name, self.backend] = size
            return out

    def close(self, name: str | None = None) -> None:
        for own in [name] if name is not None else list(self._open):
            _, model = self._open.pop(own, (None, None))
            if hasattr(model, "close"):
                model.close()

    def __enter__(self) -> ModelPool:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def run_models(jobs: DataFrame, opener: Callable[[str, int, int], Model], work: Callable[[ModelPool, dict], dict], schema: str, backend: str = "cpu", free_gib: float = 0.0) -> DataFrame:
    """``work(pool, job)``, a row of ``schema`` whose first field is ``status``, for each row of ``jobs(model, ...)``.

    Jobs are dealt and sorted by model, so that a worker opens each of its models once; a failure is a row with its
    message in ``status`` and the other fields null. A model's jobs may spread over workers: keys are model and a hash of the job.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ModelPool(opener, backend, free_gib) as pool:
            for pdf in batches:
                rows = []
                for job in pdf.to_dict("records"):
                    try:
                        rows.append({"status": "ok", **work(pool, job)})
                    except Exception as e:  # noqa: BLE001  any failure belongs to its job alone
                        rows.append({"status": f"{type(e).__name__}: {e}"})
                yield pd.DataFrame(rows, columns=names)

    return jobs.repartition("model", F.pmod(F.xxhash64(*jobs.columns), F.lit(64))).sortWithinPartitions("model").mapInPandas(run, schema)

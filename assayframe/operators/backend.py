"""Descriptors of an outside program, called a partition at a time and joined back by key.

A program may hang or die on a compound.  ``Supervised`` runs one beside each
task, gives every compound its own time, kills and restarts what does not
answer, and turns a compound that fails again into an error row, so no
compound ends a task.
"""
from __future__ import annotations

import contextlib
import json
import os
import selectors
import signal
import subprocess
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite

#: gets batches of (key, smiles) and gives rows (key, error, descriptors ...)
Backend = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def run_backend(compounds: DataFrame, key: str, smiles: str, backend: Backend, descriptors: list[str]) -> DataFrame:
    """(key, ordinal, error, descriptors): what the backend gives, in its order within a partition.

    The key travels with its structure, so no list of names has to be kept beside it.
    """
    kind = compounds.schema[key].dataType.simpleString()

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = 0
        for pdf in backend(batches):
            out = pdf.reindex(columns=[key, "error", *descriptors])
            out.insert(1, "ordinal", range(place, place + len(out)))
            place += len(out)
            yield out

    columns = "".join(f", `{d}` double" for d in descriptors)
    return compounds.select(key, smiles).mapInPandas(call, f"{key} {kind}, ordinal long, error string{columns}")


@dataclass
class Supervised:
    """A backend out of a command that answers lines of JSON, one for each compound.

    It reads ``{"key": .., "structure": ..}`` and writes one object of numbers
    by descriptor; a member ``error`` says why there are none.  ``seconds`` is
    a compound's time and ``retries`` how often it is tried again, each time
    with a fresh process.
    """

    command: list[str]
    seconds: float = 600.0
    retries: int = 1

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child = Child(self.command)
        try:
            for pdf in batches:
                key, structure = pdf.columns[:2]
                rows = []
                for k, s in zip(pdf[key], pdf[structure]):
                    error = None
                    for _ in range(1 + self.retries):
                        try:
                            answer = child.ask({"key": k, "structure": s}, self.seconds)
                            break
                        except (OSError, TimeoutError, ValueError) as e:
                            answer, error = {}, str(e) or type(e).__name__
                            child.stop()
                    else:
                        answer = {"error": error}
                    rows.append({"error": "", **answer, key: k})
                yield pd.DataFrame(rows, columns=None if rows else [key, "error"])
        finally:
            child.stop()


class Child:
    """One run of a command at a time, started when it is asked."""

    def __init__(self, command: list[str]):
        self.command, self.process, self.rest = command, None, b""

    def ask(self, question: dict, seconds: float) -> dict:
        if self.process is None or self.process.poll() is not None:
            self.stop()
            self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, start_new_session=True)
        self.process.stdin.write(json.dumps(question, default=str).encode() + b"\n")
        self.process.stdin.flush()
        answer = json.loads(self.line(time.monotonic() + seconds, seconds))
        if not isinstance(answer, dict):
            raise ValueError(f"no object: {str(answer)[:80]}")
        return answer

    def line(self, until: float, seconds: float) -> bytes:
        with selectors.DefaultSelector() as ready:
            ready.register(self.process.stdout, selectors.EVENT_READ)
            while b"\n" not in self.rest:
                if not ready.select(max(0.0, until - time.monotonic())):
                    raise TimeoutError(f"no answer in {seconds:g} s")
                more = os.read(self.process.stdout.fileno(), 1 << 16)
                if not more:
                    raise OSError(f"the program ended with code {self.process.wait()}")
                self.rest += more
        line, _, self.rest = self.rest.partition(b"\n")
        return line

    def stop(self) -> None:
        """Kill the program and whatever it has started."""
        if self.process is not None:
            with contextlib.suppress(ProcessLookupError):
                os.killpg(self.process.pid, signal.SIGKILL)
            self.process.wait()
            for pipe in (self.process.stdin, self.process.stdout):
                with contextlib.suppress(OSError):
                    pipe.close()
        self.process, self.rest = None, b""


def align_backend(compounds: DataFrame, output: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Left join on the key: the first row of a key wins, values that are not finite and missing rows are null.

    ``backend_status`` is ok, error or missing.
    """
    rest = [c for c in output.columns if c not in (key, ordinal, "error")]
    first = output.groupBy(key).agg(F.min(F.struct(ordinal, "error", *[finite(F.col(c).cast("double")).alias(c) for c in rest])).alias("r"), F.count("*").alias("__n"))
    failed = F.length(F.trim(F.coalesce(F.col("r.error"), F.lit("")))) > 0
    status = F.when(F.col("__n").isNull(), F.lit("missing")).when(failed, F.lit("error")).otherwise(F.lit("ok"))
    return compounds.join(first, key, "left").select(*compounds.columns, *[F.col(f"r.{c}").alias(c) for c in rest], status.alias("backend_status"))


def backend_report(aligned: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """(status, n, examples): rows by status with the first few keys; the limit is the report's."""
    counts = aligned.groupBy(F.col("backend_status").alias("status")).agg(F.count("*").alias("n"))
    few = None
    for status in ("error", "missing"):
        some = aligned.where(F.col("backend_status") == status).select(F.lit(status).alias("status"), F.col(key).cast("string").alias("k")).orderBy("k").limit(examples)
        few = some if few is None else few.unionByName(some)
    listed = few.groupBy("status").agg(F.array_join(F.array_sort(F.collect_list("k")), ", ").alias("examples"))
    return counts.join(listed, "status", "left").select("status", "n", F.coalesce("examples", F.lit("")).alias("examples"))

"""SRC-23: an external parser of single files, run for each row with a time and an output limit."""

from __future__ import annotations

import subprocess
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])

TIMEOUT_S, MOST_INPUT, MOST_OUTPUT = 10, 5 * 1024 * 1024, 128 * 1024
RESULT = StructType().add("state", StringType()).add("output", StringType())


def probe_with(command: list[str], timeout: float = TIMEOUT_S, most_output: int = MOST_OUTPUT):
    """A column function text -> (state, output): the text goes to the command's input; state is ready, timed_out, too_large, failed or unavailable."""

    def one(text: str | None) -> tuple[str, str | None]:
        data = (text or "").encode()
        if len(data) > MOST_INPUT:
            return "too_large", None
        try:
            done = subprocess.run(command, input=data, capture_output=True, timeout=timeout)
        except FileNotFoundError:
            return "unavailable", None
        except subprocess.TimeoutExpired:
            return "timed_out", None
        if len(done.stdout) > most_output:
            return "too_large", None
        return ("ready", done.stdout.decode("utf-8", "replace")) if done.returncode == 0 else ("failed", None)

    @F.pandas_udf(RESULT)
    def probe(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["state", "output"])

    return probe

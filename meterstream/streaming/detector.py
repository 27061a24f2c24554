"""The online detector over tables: batch replay and a stateful stream, on the same step."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .step import REJECTED, Model, Record, State, step

RECORD = "ts timestamp, reading double, status string, flag boolean, diff double, z_current double, pred_current double, pred_next double, lower_band_next double, upper_band_next double"
_MATRICES = ("T", "Z", "Q", "P0", "means", "stds")


def dump_model(model: Model, state: State) -> str:
    """Model and starting state as text, for a column of the model table."""
    own = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(model).items()}
    return json.dumps({"model": own, "state": {"x": state.x.tolist(), "P": state.P.tolist(), "time": state.time, "reading": state.reading}}, sort_keys=True)


def load_model(text: str, threshold: float | None = None) -> tuple[Model, State]:
    """The reverse; keys that an older version lacks take their defaults, and ``threshold`` replaces the stored one."""
    found = json.loads(text)
    own = {k: np.array(v, float) if k in _MATRICES else v for k, v in found["model"].items() if k in Model.__dataclass_fields__}
    model = Model(**own)
    if threshold is not None:
        model.threshold = threshold
    s = found["state"]
    return model, State(np.array(s["x"]), np.array(s["P"]), s["time"], s["reading"])


def _row(key, ts, reading, r: Record) -> tuple:
    return key, ts, reading, r.status, r.flag, r.diff, r.z_current, r.pred_current, r.pred_next, r.lower_band_next, r.upper_band_next


def _names(schema: str) -> list[str]:
    return [x.strip().split()[0] for x in schema.split(",")]


def replay(readings: DataFrame, models: DataFrame) -> DataFrame:
    """Records of all readings in order of time, meter by meter; meters without a model get ``no_model`` and null times ``invalid_timestamp``.

    Readings and models are shuffled by meter once each, so that a model doesn't go along with every reading.
    """
    kind = readings.schema["meter_id"].dataType.simpleString()
    schema = f"meter_id {kind}, {RECORD}"

    def run(group: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts", kind="stable", na_position="first")
        text = given["model"].iloc[0] if len(given) else None
        own = load_model(text) if isinstance(text, str) else None
        out = []
        for key, ts, reading in group.itertuples(index=False):
            if pd.isna(ts):
                record = Record("invalid_timestamp")
            elif own is None:
                record = Record("no_model")
            else:
                state, record = step(own[0], own[1], ts.value / 1e9, reading)
                own = (own[0], state)
            out.append(_row(key, ts, reading, record))
        return pd.DataFrame(out, columns=_names(schema))

    known = models.select(F.col("meter_id").cast(kind).alias("meter_id"), "model")
    return readings.select("meter_id", "ts", "reading").groupBy("meter_id").cogroup(known.groupBy("meter_id")).applyInPandas(run, schema)


class Detector(StatefulProcessor):
    """Keeps a meter's state in the state store; its model comes with the first reading and is replaced when a newer one does."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "model string, x array<double>, P array<double>, time double, reading double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out = []
        model = state = text = None
        if self._state.exists():
            text, x, P, time, reading = self._state.get()
            model, _ = load_model(text)
            state = State(np.array(x), np.array(P).reshape(len(x), len(x)), time, reading)
        for _, ts, reading, given in frame[["meter_id", "ts", "reading", "model"]].itertuples(index=False):
            if given is not None and given != text:  # another fit keeps the time and reading that were reached
                text = given
                model, fresh = load_model(given)
                state = fresh if state is None else State(fresh.x, fresh.P, max(fresh.time, state.time), state.reading if state.time > fresh.time else fresh.reading)
            if pd.isna(ts):
                record = Record("invalid_timestamp")
            elif model is None:
                record = Record("no_model")
            else:
                new, record = step(model, state, ts.value / 1e9, reading)
                state = state if record.status in REJECTED else new
            out.append(_row(key[0], ts, reading, record))
        if state is not None:
            self._state.update((text, state.x.tolist(), state.P.ravel().tolist(), float(state.time), float(state.reading)))
        yield pd.DataFrame(out, columns=["meter_id", *_names(RECORD)])

    def close(self) -> None:
        pass


def detect_stream(readings: DataFrame, models: DataFrame) -> DataFrame:
    """A stream's readings joined with the model table and judged one by one; late ones are dropped by the step itself."""
    kind = readings.schema["meter_id"].dataType.simpleString()
    joined = readings.select("meter_id", "ts", "reading").join(models.select("meter_id", "model"), "meter_id", "left")
    return joined.groupBy("meter_id").transformWithStateInPandas(statefulProcessor=Detector(), outputStructType=f"meter_id {kind}, {RECORD}", outputMode="Append", timeMode="None")


def status_counts(records: DataFrame) -> DataFrame:
    """Records of each meter by status, a column each."""
    counts = records.groupBy("meter_id").pivot("status", ["ok", "anomaly", "post_gap_skipped", "outage", "reset", "skipped_early", "skipped_duplicate", "invalid", "no_model", "invalid_timestamp"]).agg(F.count("status"))
    return counts.fillna(0).withColumnsRenamed({c: f"status_{c}" for c in counts.columns if c != "meter_id"})

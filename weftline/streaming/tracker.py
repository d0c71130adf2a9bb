"""The Kalman tracker over a stream of frames, with one bank of filters as state per volume."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from weftline.operators.tracking import KalmanBank

OUT = "volume string, t long, z double, y double, x double, track_id long, late boolean"


def track_stream(detections: DataFrame, max_distance: float = 50.0) -> DataFrame:
    """Rows (volume, t, z, y, x) of a stream with track_id, unique per volume.

    A frame must arrive whole within one micro-batch and frames in order; rows of a frame that is not after the last one
    come back with ``late`` set and no track. State is what the live tracks need, so it doesn't grow with the stream.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["t", "z", "y", "x"])
        bank, last = pickle.loads(state.get[0]) if state.exists else (KalmanBank(max_distance), -1)
        out = []
        for t, part in pdf.groupby("t", sort=True):
            late = t <= last
            ids = np.full(len(part), None) if late else bank.step(part[["z", "y", "x"]].to_numpy(float)) + 1
            last = max(last, t)
            out.append(part.assign(track_id=pd.array(ids, dtype="Int64"), late=late))
        state.update((pickle.dumps((bank, last)),))
        yield pd.concat(out)[["volume", "t", "z", "y", "x", "track_id", "late"]]

    return detections.select("volume", "t", "z", "y", "x").groupBy("volume").applyInPandasWithState(step, OUT, "bank binary", "append", "NoTimeout")

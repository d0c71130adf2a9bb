"""What a source leaves unread, by options that a load names: ``volumes`` (a JSON list of names), ``first_t`` and ``last_t``.

Options rather than pushed filters: Spark 4.1 keeps the filters pushed to a Python source in the relation that a load
returned, so two filters on one loaded table, or a filter and none, would read each other's partitions and lose rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql.datasource import DataSourceReader


class PrunedReader(DataSourceReader):
    """A reader whose partitions each belong to one volume, and maybe one frame."""

    def __init__(self, options: Mapping[str, str]):
        self.path = options["path"]
        self.volumes = set(json.loads(options["volumes"])) if options.get("volumes") is not None else None
        self.first_t, self.last_t = (None if options.get(c) is None else int(options[c]) for c in ("first_t", "last_t"))

    def keeps_volume(self, name: str) -> bool:
        return self.volumes is None or name in self.volumes

    def keeps_frame(self, t: int) -> bool:
        return (self.first_t is None or t >= self.first_t) and (self.last_t is None or t <= self.last_t)

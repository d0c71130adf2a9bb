"""Writers of folders that appear whole: tasks write files aside, and the driver moves finished folders to their places."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql.datasource import DataSourceArrowWriter

from weftline.plans.storage import mounted


class StagedFolders(DataSourceArrowWriter):
    """Tasks ``put`` files of one or more named folders; ``commit`` calls ``publish``, and a failed job leaves nothing behind.

    A file is there as a whole or not at all, so attempts that fail, repeat or run twice do no harm. All machines must
    mount the path. ``overwrite`` replaces folders of the same names, others stay; without it such a folder raises.
    """

    def __init__(self, path: str, overwrite: bool):
        self.root, self.overwrite = Path(mounted(path)), overwrite
        self.staging = self.root / f"_staging-{uuid.uuid4().hex}"

    def put(self, name: str, data: bytes) -> None:
        target, part = self.staging / name, self.staging / "_parts" / uuid.uuid4().hex
        for f in (target, part):
            f.parent.mkdir(parents=True, exist_ok=True)
        part.write_bytes(data)
        os.replace(part, target)

    def publish(self, folders: list[str]) -> None:
        self.root.mkdir(parents=True, exist_ok=True)
        if not self.overwrite and (there := [f for f in folders if (self.root / f).exists()]):
            raise FileExistsError(f"{self.root} has {there}")
        for f in folders:
            if (self.root / f).exists():
                (self.root / f).rename(self.staging / f"_before-{f}")
            (self.staging / f).rename(self.root / f)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)

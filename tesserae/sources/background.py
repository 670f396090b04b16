"""Merges that run beside queries: one step in every table at each interval, and old parts swept."""

from __future__ import annotations

import threading

from tesserae.sources.catalog import Catalog


#: Seconds that an unnamed folder is left alone, as an insert that has not committed yet may own it.
GRACE = 6 * 3600.0


class Compactor(threading.Thread):
    """Runs until `stop`; merges are Spark jobs, so only the choosing happens here.

    Parts that a merge replaced stay on disk as long as a kept manifest names them, so readers are not disturbed.
    """

    def __init__(self, catalog: Catalog, interval: float = 5.0) -> None:
        super().__init__(daemon=True, name="tesserae-compactor")
        self.catalog, self.interval, self.merged = catalog, interval, 0
        self._done = threading.Event()

    def run(self) -> None:
        while not self._done.wait(self.interval):
            made = self.catalog.optimize_step()
            self.merged += len(made)
            if made:
                self.catalog.vacuum(GRACE)

    def stop(self) -> None:
        self._done.set()
        self.join()

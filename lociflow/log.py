"""A run's log: to the screen, and to a file beside the results."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

LOG = logging.getLogger("lociflow")


@contextmanager
def run_log(prefix: str) -> Iterator[logging.Logger]:
    """Everything that LOG gets goes to the screen and to prefix + ".log", which starts anew. The end, or the error that
    ended the run, and the seconds it took close the file."""
    LOG.setLevel(logging.INFO)
    handlers = [logging.StreamHandler(), logging.FileHandler(f"{prefix}.log", mode="w")]
    for h in handlers:
        h.setFormatter(logging.Formatter("%(message)s"))
        LOG.addHandler(h)
    start = time.monotonic()
    LOG.info("Started %s", time.strftime("%Y-%m-%d %H:%M:%S"))
    try:
        yield LOG
    except BaseException as error:
        LOG.error("Error: %s", error)
        raise
    finally:
        LOG.info("Seconds: %.1f", time.monotonic() - start)
        for h in handlers:
            LOG.removeHandler(h)
            h.close()

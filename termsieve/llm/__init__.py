"""Operators for training-data pipelines and their registered queries.

Nothing else in the library imports this folder.
"""

import functools
import os
from pathlib import Path

from . import (canonical_license, chat, compression, embedding_dedup, fill_in_middle, merkle, mixing, packing, pii, quality, simhash,
               substring_dedup, url_filter)

_MODULES = (substring_dedup, quality, simhash, url_filter, canonical_license, pii, embedding_dedup, packing, chat,
            mixing, merkle, fill_in_middle, compression)


def workers_import(spark) -> None:
    """Let Python workers find this package where it lies, if it was not shipped with --py-files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def _query(fn):
    @functools.wraps(fn)
    def run(spark, sf):
        workers_import(spark)
        return fn(spark, sf)
    return run


QUERIES = {name: _query(fn) for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}

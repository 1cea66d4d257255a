"""Any callable as a model over columns: read once a worker, checked by digest, run on bounded batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.shared import shared_dir

#: Bytes of features that a call gets at most, but one row at least.
CALL_BYTES = 8 << 20
#: Models of this worker by path and digest.
_held: dict[tuple[str, str], Any] = {}


def _filesystem(uri: str):
    import pyarrow.fs as pafs

    return (pafs.LocalFileSystem(), uri) if "://" not in uri and not uri.startswith("file:") else pafs.FileSystem.from_uri(uri)


def publish(spark: SparkSession, content: bytes) -> tuple[str, str]:
    """Write a model to the shared folder, under its digest: (path, digest)."""
    digest = hashlib.sha256(content).hexdigest()
    path = f"{shared_dir(spark)}/model-{digest}"
    fs, local = _filesystem(path)
    with fs.open_output_stream(local) as out:
        out.write(content)
    return path, digest


def _model(path: str, digest: str, load: Callable[[bytes], Any]) -> Any:
    if (path, digest) not in _held:
        fs, local = _filesystem(path)
        with fs.open_input_stream(local) as source:
            content = source.read()
        if hashlib.sha256(content).hexdigest() != digest:
            raise ValueError(f"{path} hasn't the digest {digest}")
        _held[path, digest] = load(content)
    return _held[path, digest]


def score(rows: DataFrame, columns: list[str], path: str, digest: str, load: Callable[[bytes], Any], predict: Callable[[Any, np.ndarray], np.ndarray], into: str = "score", call_bytes: int = CALL_BYTES) -> DataFrame:
    """``rows`` with ``into``: what the model at ``path`` says of each row's ``columns`` (as doubles), null if one is null.

    ``load`` makes a model from the file's bytes, ``predict`` takes it and an array of rows x columns and
    returns a number a row. A file with another digest is an error. ``into`` is replaced if it is there.
    """

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        model = _model(path, digest, load)
        for batch in batches:
            known = np.ones(len(batch[0]), bool)
            for c in batch:
                known &= c.is_valid().to_numpy(zero_copy_only=False)
            out = np.zeros(len(known))
            at = np.flatnonzero(known)
            step = max(1, call_bytes // (8 * len(batch)))
            for lo in range(0, len(at), step):
                some = pa.array(at[lo : lo + step])
                out[at[lo : lo + step]] = predict(model, np.stack([c.take(some).to_numpy(zero_copy_only=False).astype(np.float64) for c in batch], 1))
            yield pa.array(out, mask=~known)

    return rows.withColumn(into, F.arrow_udf(run, "double")(*[F.col(c).cast("double") for c in columns]))

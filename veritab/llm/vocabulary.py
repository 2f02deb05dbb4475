"""A public SentencePiece vocabulary as plain data. It is read, never trained."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Folder and file of the default vocabulary; a parameter wherever it is used.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes after which Spark ends an Arrow batch, so that a batch of very long texts still fits in a worker.
BATCH_BYTES = 1_000_000
#: Below the size of an empty batch Spark would never fill one.
LEAST_BATCH = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """pieces: text by id, '' for control, unknown and byte pieces; byte_ids: the id of each byte's piece."""

    pieces: tuple[str, ...]
    byte_ids: tuple[int, ...]

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))


def load(path: str = VOCABULARY) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], [-1] * 256
    for i in range(model.get_piece_size()):
        plain = not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        pieces.append(model.id_to_piece(i) if plain else "")
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
    if min(byte_ids) < 0:
        raise ValueError(f"{path} has no piece for some byte, so not every text can be encoded")
    return Vocabulary(tuple(pieces), tuple(byte_ids))


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session end after about BATCH_BYTES; how many rows they have is left as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Within it, Arrow batches that Spark fills end after about ``size`` bytes (LEAST_BATCH at least)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(max(size, LEAST_BATCH)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)

"""Small frames with the cases every operator has to take, and brute-force versions."""

from __future__ import annotations

import random
import zlib

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)``."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA).repartition(3)


def with_clashes(df):
    """Extra columns under names that operators might use inside."""
    from pyspark.sql import functions as F
    for c in ("score", "spans", "hits", "items", "n", "h", "id", "v", "root", "node", "ids", "part", "chunk", "_id",
              "_text", "pos", "vocab", "first", "last", "key"):
        df = df.withColumn(c, F.lit("x"))
    return df


def word_soup(n: int, seed: int, vocab: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def remainder(doc_id, mod: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def rows_by(df, *keys):
    return sorted(df.collect(), key=lambda r: tuple(str(r[k]) for k in keys))

"""The fingerprint of an ordered data set: one SHA-256 over all of its items."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(value: Column) -> Column:
    """Its length in eight bytes, highest first, and the bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value).cast("bigint")), 16, "0")), value)


def item_bytes(items: DataFrame, order: str = "item_index") -> DataFrame:
    """items (order, id, reference, language, content: the bytes of the audio): order and what each adds
    to the fingerprint. A null language differs from every tag; the other columns must not be null."""
    text = lambda c: F.col(c).cast("binary")
    language = F.when(F.col("language").isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), text("language")))
    audio = F.unhex(F.sha2("content", 256))
    return items.select(order, F.concat(_field(text("id")), _field(text("reference")), _field(language), _field(audio)).alias("bytes"))


def dataset_fingerprint(items: DataFrame, domain: bytes, order: str = "item_index") -> str:
    """Audio is hashed on the executors. The digest itself depends on the order of all items, so their few
    bytes stream through the driver one partition at a time. `domain` sets apart uses of the digest:
    fingerprints are comparable only under the same one."""
    rows = item_bytes(items, order)
    digest = hashlib.sha256(domain + items.count().to_bytes(8, "big"))
    for row in rows.orderBy(order).toLocalIterator():
        digest.update(row["bytes"])
    return "sha256:" + digest.hexdigest()

"""Checksums and column encryption with Spark's AES functions.

The key is a Column on purpose: pass a column read from a protected table, or
``key_from_conf``, so that the key text never stands in code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checksum(content: Column) -> Column:
    """SHA-256 of bytes (or of the UTF-8 bytes of a string), as hex."""
    return F.sha2(content.cast("binary"), 256)


def key_from_conf(spark: SparkSession, name: str = "spark.vitaframe.encryption.key") -> Column:
    """32-byte AES key derived from a session secret of any length.

    The key is a scalar subquery on a table of one row, so neither the secret nor the key stands in
    a plan. ``spark.redaction.regex`` hides settings by name.
    """
    import hashlib

    key = hashlib.sha256(spark.conf.get(name).encode()).digest()
    return spark.createDataFrame([(bytearray(key),)], "key binary").scalar()


def encrypt(value: Column, key: Column) -> Column:
    """AES-GCM: a fresh nonce per value, so equal inputs give different outputs."""
    return F.aes_encrypt(value.cast("binary"), key, F.lit("GCM"))


def decrypt_or_plain(value: Column, key: Column) -> Column:
    """Decrypted bytes, or the bytes themselves where they were stored unencrypted."""
    return F.coalesce(F.try_aes_decrypt(value, key, F.lit("GCM")), value)


def encrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    return df.withColumns({c: encrypt(F.col(c), key) for c in columns})


def encryption_report(df: DataFrame, content: str, key: Column) -> DataFrame:
    """Original size, encrypted size and source hash for every row."""
    raw = F.col(content).cast("binary")
    return df.withColumns(
        {
            "original_size": F.octet_length(raw).cast("long"),
            "encrypted_size": F.octet_length(encrypt(raw, key)).cast("long"),
            "source_hash": F.sha2(raw, 256),
            "algorithm": F.lit("AES-GCM"),
        }
    )


def round_trip_check(df: DataFrame, content: str, key: Column) -> DataFrame:
    """One row: how many values were tried and how many did not survive the round trip."""
    raw = F.col(content).cast("binary")
    back = F.try_aes_decrypt(encrypt(raw, key), key, F.lit("GCM"))
    broken = F.coalesce(back != raw, F.lit(True)) | (F.sha2(back, 256) != F.sha2(raw, 256))
    return df.where(raw.isNotNull()).agg(
        F.count("*").alias("values_checked"),
        F.count_if(broken).alias("values_broken"),
        (F.count_if(broken) == 0).alias("healthy"),
    )

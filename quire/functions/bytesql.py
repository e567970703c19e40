"""Scalar functions on text and bytes as Column expressions, and codecs as Arrow functions."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

from quire.kernels import codecs
from quire.kernels.model import MAX_INT, MIN_INT


def asciihex_encode(b: Column) -> Column:
    """Upper-case hex with the end mark; runs in the JVM."""
    return F.concat(F.hex(b), F.lit(">"))


def asciihex_decode(c: Column) -> Column:
    """Bytes of hex text up to its end mark; null where it isn't any."""
    bare = F.regexp_replace(c, r"[\x00\t\n\x0c\r ]", "")
    digits = F.regexp_extract(bare, r"\A([0-9A-Fa-f]*)>\z", 1)
    even = F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise(""))
    return F.when(bare.rlike(r"\A[0-9A-Fa-f]*>\z"), F.unhex(even))


@F.pandas_udf(T.LongType())
def adler32(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else zlib.adler32(x))


def encode(name: str):
    """The encoder of a filter as an Arrow function on BINARY."""

    @F.pandas_udf(T.BinaryType())
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else codecs.encode(bytes(x), name))

    return run


def decode(name: str):
    """The decoder of a filter as an Arrow function on BINARY; null where the bytes aren't well formed."""

    @F.pandas_udf(T.BinaryType())
    def run(b: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else codecs.decode(bytes(x), name)
            except codecs.CodecError:
                return None

        return b.map(one)

    return run


def key_text(num: Column, gen: Column) -> Column:
    """``5``, or ``5 [2]`` with a generation."""
    return F.when(gen == 0, num.cast("string")).otherwise(F.concat(num.cast("string"), F.lit(" ["), gen.cast("string"), F.lit("]")))


def key_id(num: Column, gen: Column) -> Column:
    return F.when(gen == 0, num.cast("string")).otherwise(F.concat_ws("_", num.cast("string"), gen.cast("string")))


def bounded(c: Column) -> Column:
    """A number of the format: null outside 32 bits."""
    return F.when(c.between(MIN_INT, MAX_INT), c)


def escape_name(c: Column) -> Column:
    """A name as written: delimiters, ``#`` and anything but visible ASCII as ``#XX`` of each byte."""
    plain = "".join(chr(x) for x in range(33, 127) if chr(x) not in "()<>[]{}/%#")
    each = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: c.substr(i, F.lit(1)))
    codes = F.transform(each, lambda x: F.when(F.instr(F.lit(plain), x) > 0, x).otherwise(F.concat(F.lit("#"), F.hex(F.encode(x, "ISO-8859-1")))))
    return F.when(F.length(c) == 0, "").otherwise(F.array_join(codes, ""))


def register(spark: SparkSession) -> None:
    """The codecs by name for SQL: quire_encode_<filter>, quire_decode_<filter>, quire_adler32."""
    for name in codecs.CODED:
        spark.udf.register(f"quire_encode_{name.lower()}", encode(name))
        spark.udf.register(f"quire_decode_{name.lower()}", decode(name))
    spark.udf.register("quire_adler32", adler32)

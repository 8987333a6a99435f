"""Column functions over vectors, codes, names and plans of ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from the left in double, so it is the same wherever a row is stored (H1)."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length (H2)."""
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column, least: float = 1e-10) -> Column:
    """v over its length; a vector no longer than ``least`` stays as it is (H2)."""
    n = norm(v)
    return F.when(n > least, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))


def query_chunks(flat: Column, dim: int) -> Column:
    """A flat buffer cut into queries of dim coordinates (B1)."""
    return F.transform(
        F.sequence(F.lit(0), (F.size(flat) / dim).cast("int") - 1), lambda i: F.slice(flat, i * dim + 1, F.lit(dim))
    )


def valid_query(q: Column, dim: int) -> Column:
    """Whether q is a positive multiple of dim long and all finite."""
    finite = F.forall(q, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(q) > 0) & (F.size(q) % dim == 0) & finite, F.lit(False))


def bit_set(bits: Column, offset: Column) -> Column:
    """Whether bit number offset is set, the least significant bit of the first byte being bit 0 (H3)."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(offset / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.when(F.octet_length(bits) > F.floor(offset / 8), F.call_function("shiftright", byte, (offset % 8).cast("int")) % 2 == 1).otherwise(F.lit(False))


def generation_name(n: Column) -> Column:
    """gen- and twenty digits (H8)."""
    return F.concat(F.lit("gen-"), F.lpad(n.cast("string"), 20, "0"))


def with_scheme(address: Column) -> Column:
    """The address with http:// before it, unless it has a scheme (H9)."""
    return F.when(F.contains(address, F.lit("://")), address).otherwise(F.concat(F.lit("http://"), address))


def valid_shard_id(name: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen, but not . or ..."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9._-]+\z") & ~name.isin(".", ".."), F.lit(False))


def rows_per_frame(dim: int, bits: int, frame_bytes: int = 2 * 1024 * 1024) -> int:
    """Encoded rows that fit beside a calibration pair into one frame, at least one."""
    return max(1, (frame_bytes - 8 * dim) // (bits * dim // 8 + 12))


def even_counts(total: int, parts: int) -> list[int]:
    """total over parts as evenly as whole rows allow; the first ones take the rest."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def le_bytes(n: Column, width: int) -> Column:
    """The low bytes of a whole number, least significant first."""
    h = F.lpad(F.hex(n), 16, "0")
    parts = [F.substring(h, 17 - 2 * (i + 1), 2) for i in range(width)]
    return F.unhex(F.concat(*parts))

"""Integer streams as array columns: transforms and exact encoded sizes, in built-in expressions only.

A stream is one record's array of non-negative BIGINT, so no size needs a shuffle. Empty streams have size 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body(x)` with x evaluated once, whatever the optimizer pushes where."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(array: Column, of=lambda x: x) -> Column:
    """The sum of `of` each item, without an array in between."""
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda s, x: s + of(x))


def varint_size(v: Column) -> Column:
    """Bytes of a LEB128 number: seven bits a byte; a negative BIGINT stands for 2^63 or more."""
    out = F.when(v < 0, 10)
    for n in range(1, 9):
        out = out.when(v < (1 << 7 * n), n)
    return out.otherwise(9).cast("bigint")


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast("bigint")))


def bit_length(v: Column) -> Column:
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def ceil_div(v: Column, n: int) -> Column:
    return F.floor((v + (n - 1)) / n).cast("bigint")


def before(array: Column, k: Column) -> Column:
    return F.coalesce(F.get(array, k - 1), F.lit(0).cast("bigint"))


def deltas(array: Column) -> Column:
    """First differences; the first value stays."""
    return let(array, lambda a: F.transform(a, lambda x, k: x - before(a, k)))


def xors(array: Column) -> Column:
    return let(array, lambda a: F.transform(a, lambda x, k: x.bitwiseXOR(before(a, k))))


def run_lengths(array: Column) -> Column:
    """Structs (value, n) of the runs of equal values."""

    def build(a: Column) -> Column:
        n = F.size(a)
        starts = F.filter(F.transform(a, lambda x, k: F.when((k == 0) | (x != F.get(a, k - 1)), k)), lambda k: k.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda p, j: F.struct(F.get(a, p).alias("value"), (F.coalesce(F.get(s, j + 1), n) - p).cast("bigint").alias("n"))))

    return let(array, build)


def byte_size(v: Column) -> Column:
    """Whole bytes of a number, one at least."""
    out = F.when(v < 1 << 8, 1)
    for n in range(2, 8):
        out = out.when(v < (1 << 8 * n), n)
    return out.otherwise(8).cast("bigint")


def varints(array: Column) -> Column:
    return total(array, varint_size)


def raw_size(a: Column) -> Column:
    return varints(a)


def zigzag_delta_size(a: Column) -> Column:
    return total(deltas(a), lambda d: varint_size(zigzag(d)))


def delta_of_delta_size(a: Column) -> Column:
    return total(deltas(deltas(a)), lambda d: varint_size(zigzag(d)))


def xor_delta_size(a: Column) -> Column:
    return varints(xors(a))


def pair_delta_size(a: Column, b: Column) -> Column:
    """The second stream as differences to the first, item by item."""
    return varints(F.zip_with(a, b, lambda x, y: zigzag(y - x)))


def rle_size(a: Column) -> Column:
    return total(run_lengths(a), lambda r: varint_size(r["value"]) + varint_size(r["n"]))


def selective_run_size(r: Column, least: int = 8, most: int = 65535) -> Column:
    whole, rest = F.floor(r["n"] / most).cast("bigint"), r["n"] % most
    v = varint_size(r["value"])
    tail = F.when(rest >= least, 1 + v + varint_size(rest)).otherwise(rest * (1 + v))
    return whole * (1 + v + varint_size(F.lit(most))) + tail


def selective_rle_size(a: Column) -> Column:
    return total(run_lengths(a), lambda r: selective_run_size(r))


def hybrid_rle_size(a: Column, b: Column) -> Column:
    """First stream raw, second run-length."""
    return raw_size(a) + rle_size(b)


def bit_packed_size(a: Column) -> Column:
    return F.when(F.size(a) == 0, 0).otherwise(1 + ceil_div(F.size(a) * F.greatest(F.lit(1), bit_length(F.array_max(a))), 8)).cast("bigint")


def frame_of_reference_size(a: Column) -> Column:
    bits = bit_length(F.array_max(a) - F.array_min(a))
    width = F.when(bits <= 8, 1).when(bits <= 16, 2).when(bits <= 32, 4).otherwise(8)
    return F.when(F.size(a) == 0, 0).otherwise(varint_size(F.array_min(a)) + 1 + F.size(a) * width).cast("bigint")


def dictionary_size(a: Column) -> Column:
    d = F.array_distinct(a)
    return F.when(F.size(a) == 0, 0).when(F.size(d) <= 256, 2 + varints(d) + F.size(a)).otherwise(1 + raw_size(a)).cast("bigint")


def stream_vbyte_size(a: Column) -> Column:
    control = ceil_div(F.size(a), 4)
    data = total(a, byte_size)
    return F.when(F.size(a) == 0, 0).otherwise(varint_size(control) + control + data).cast("bigint")


def cascaded_mode(a: Column) -> Column:
    """1: dictionary and runs (few distinct values), 2: deltas."""
    return F.when(F.size(F.array_distinct(a)) / F.size(a) < 0.01, 1).otherwise(2)


def rice_costs(z: Column, most: int = 16) -> Column:
    """Struct (cost in bits, k) for zigzag numbers: the smallest cost, then the smallest k.

    With n numbers of sum S, one more bit costs n and saves the sum of ceil((z >> k) / 2), which falls with k and lies between
    (S / 2^k - n (1 - 2^-k)) / 2 and (S / 2^k + n) / 2. So the best k is not below the first with 3 n 2^k >= S + n, nor above the first
    with n 2^k >= S, which is at most two further on: three are tried, whatever `most` is."""

    def of(s: Column) -> Column:
        n = F.size(z).cast("bigint")
        least = F.least(F.lit(most), F.length(F.bin(F.call_function("div", s + n - 1, 3 * n))))
        least = F.when(s + n <= 3 * n, 0).otherwise(least)
        tried = F.sequence(least, F.least(F.lit(most), least + 2))
        return F.array_min(F.transform(tried, lambda k: F.struct(total(z, lambda x: F.call_function("shiftright", x, k) + 1 + k).alias("cost"), k.alias("k"))))

    return let(total(z), of)


def rice_parameter(a: Column, most: int = 16) -> Column:
    """`rice_costs` of a stream."""
    return let(F.transform(deltas(a), zigzag), lambda z: rice_costs(z, most))


def rice_size(a: Column) -> Column:
    return F.when(F.size(a) == 0, 0).otherwise(1 + ceil_div(rice_parameter(a)["cost"], 8)).cast("bigint")


def elias_fano_size(a: Column) -> Column:
    def of(s: Column) -> Column:
        q = F.floor((s + 1) / F.size(a)).cast("bigint")
        low = F.greatest(F.lit(0), bit_length(q) - 1)
        return 1 + ceil_div(F.size(a) * low + F.call_function("shiftright", s, low) + F.size(a), 8)

    return F.when(F.size(a) == 0, 0).otherwise(let(total(a), of)).cast("bigint")


#: Sizes of one stream, by the name of the encoding; pair_delta and hybrid_rle take two.
SIZES = {
    "raw": raw_size, "zigzag-delta": zigzag_delta_size, "rle": rle_size, "bit-packed": bit_packed_size, "delta-of-delta": delta_of_delta_size,
    "frame-of-reference": frame_of_reference_size, "xor-delta": xor_delta_size, "dictionary": dictionary_size, "stream-vbyte": stream_vbyte_size,
    "selective-rle": selective_rle_size, "rice": rice_size, "elias-fano": elias_fano_size,
}


def all_sizes(array: Column) -> Column:
    """STRUCT of all of `SIZES`, the stream, its differences, runs and distinct values computed once."""

    def of(a: Column) -> Column:
        def with_deltas(d: Column) -> Column:
            def with_zigzags(z: Column) -> Column:
                def with_runs(r: Column) -> Column:
                    sizes = {k: f(a) for k, f in SIZES.items() if k not in ("zigzag-delta", "delta-of-delta", "rle", "selective-rle", "rice")}
                    sizes["zigzag-delta"] = varints(z)
                    sizes["delta-of-delta"] = total(F.transform(d, lambda x, k: x - before(d, k)), lambda x: varint_size(zigzag(x)))
                    sizes["rle"] = total(r, lambda x: varint_size(x["value"]) + varint_size(x["n"]))
                    sizes["selective-rle"] = total(r, lambda x: selective_run_size(x))
                    sizes["rice"] = F.when(F.size(a) == 0, 0).otherwise(1 + ceil_div(rice_costs(z)["cost"], 8)).cast("bigint")
                    return F.struct(*[sizes[k].alias(k) for k in SIZES])

                return let(run_lengths(a), with_runs)

            return let(F.transform(d, zigzag), with_zigzags)

        return let(F.transform(a, lambda x, k: x - before(a, k)), with_deltas)

    return let(array, of)

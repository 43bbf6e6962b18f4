"""Identifier hashing, routing and formatting as Column expressions.

Spark has no unsigned 64-bit type and ANSI arithmetic does not wrap, so hashes are signed longs and
products are taken modulo 2 ** 64 in decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO64 = 1 << 64
#: The multiplier of generated identifiers (2 ** 64 over the golden ratio) and the finaliser's factors.
GOLDEN = 0x9E3779B97F4A7C15
MIX_FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BLOOM_HASHES = 7


def wide(value: int) -> Column:
    """A literal beyond a long, as decimal(20, 0)."""
    return F.lit(str(value)).cast("decimal(20,0)")


def signed(value: int) -> int:
    return value - TWO64 if value >= TWO64 >> 1 else value


def md5_hex(text: Column) -> Column:
    return F.md5(text.cast("string").cast("binary"))


def _little_endian(digits: Column) -> Column:
    """16 hex digits, least byte first, as a signed long: read backwards, then each byte's halves change places."""
    low = F.lit(0x0F0F0F0F0F0F0F0F)
    back = F.conv(F.reverse(digits), 16, -10).cast("long")
    return F.shiftleft(back.bitwiseAND(low), 4).bitwiseOR(F.shiftrightunsigned(back, 4).bitwiseAND(low))


def halves_of(digest: Column) -> tuple[Column, Column]:
    """(hash_hi, hash_lo) of an MD5 in hex: its little-endian halves as signed longs. Both zero become (0, 1)."""
    hi, lo = (_little_endian(F.substring(digest, k, 16)) for k in (1, 17))
    return hi, F.when(digest == "0" * 32, F.lit(1).cast("long")).otherwise(lo)


def hash_halves(text: Column) -> tuple[Column, Column]:
    """halves_of the MD5 of the UTF-8 text; a null text gives nulls."""
    return halves_of(md5_hex(text))


def unsigned(value: Column) -> Column:
    """A signed long read as unsigned, as decimal(20, 0)."""
    plain = value.cast("decimal(20,0)")
    return F.when(value < 0, plain + wide(TWO64)).otherwise(plain).cast("decimal(20,0)")


def shard_of(lo: Column, shards: int) -> Column:
    """lo modulo shards, unsigned."""
    base = F.pmod(lo, F.lit(shards).cast("long"))
    if TWO64 % shards:
        base = F.pmod(base + F.when(lo < 0, F.lit(TWO64 % shards)).otherwise(F.lit(0)), F.lit(shards).cast("long"))
    return base.cast("int")


#: The code points that count as white space in identifiers.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.btrim(text, F.lit(WHITE_SPACE)) == "")


#: Fixed value: the accepted forms of a server identifier.
_DASHED = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
GUID_PATTERN = f"^(?:[0-9a-fA-F]{{32}}|{_DASHED}|[{{]{_DASHED}[}}]|[(]{_DASHED}[)])$"


def is_guid(text: Column) -> Column:
    return F.coalesce(F.btrim(text).rlike(GUID_PATTERN), F.lit(False))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _times(value: Column, factor: int) -> Column:
    """value (signed long) times factor modulo 2 ** 64, as a signed long.

    The halves of value meet 16-bit pieces of the factor, so that no product or sum leaves a long.
    """
    low32, low16 = F.lit(0xFFFFFFFF), F.lit(0xFFFF)
    f = [F.lit(factor >> 16 * k & 0xFFFF).cast("long") for k in range(4)]
    a, b = value.bitwiseAND(low32), F.shiftrightunsigned(value, 32)
    second = a * f[1]
    first = a * f[0] + F.shiftleft(second.bitwiseAND(low16), 16)
    top = F.shiftrightunsigned(first, 32) + F.shiftrightunsigned(second, 16)
    for x, lower, upper in ((a, f[2], f[3]), (b, f[0], f[1])):
        top = top + (x * lower).bitwiseAND(low32) + F.shiftleft((x * upper).bitwiseAND(low16), 16)
    return F.shiftleft(top.bitwiseAND(low32), 32).bitwiseOR(first.bitwiseAND(low32))


def mix64(value: Column) -> Column:
    """The splitmix64 finaliser on a signed long."""

    def folded(x: Column, shift: int) -> Column:
        return _let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift)))

    def product(x: Column, factor: int) -> Column:
        return _let(x, lambda v: _times(v, factor))

    x = product(folded(value, 30), MIX_FACTORS[0])
    return folded(product(folded(x, 27), MIX_FACTORS[1]), 31)


def bloom_bits(hi: Column, lo: Column, bits: int, hashes: int = BLOOM_HASHES) -> Column:
    """The array of bit positions of a key in a filter of `bits` (a power of two)."""
    mask = F.lit(bits - 1).cast("long")
    h1 = mix64(lo).bitwiseAND(mask)
    h2 = mix64(hi.bitwiseXOR(F.lit(signed(GOLDEN)))).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(mask)
    return _let(F.struct(h1.alias("a"), h2.alias("b")), lambda s: F.array(*((s["a"] + s["b"] * F.lit(i).cast("long")).bitwiseAND(mask) for i in range(hashes))))


def _hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def generated_message_id(index: Column, domain: str = "idledger.local") -> Column:
    """`<index.scrambled@domain>`, both as 16 hex digits; scrambled is index times GOLDEN modulo 2 ** 64."""
    index = index.cast("long")
    return F.concat(F.lit("<"), _hex16(index), F.lit("."), _hex16(_times(index, GOLDEN)), F.lit(f"@{domain}>"))


def generated_server_id(index: Column) -> Column:
    """A GUID over (index, index xor GOLDEN) in the mixed byte order of its text form."""
    index = index.cast("long")
    h, x = _hex16(index), _hex16(index.bitwiseXOR(F.lit(signed(GOLDEN))))
    back = reduce(F.concat, [F.substring(x, k, 2) for k in range(15, 3, -2)])
    tail = F.concat(F.substring(x, 3, 2), F.substring(x, 1, 2))
    joined = F.concat(back, tail)
    return F.concat(F.substring(h, 9, 8), F.lit("-"), F.substring(h, 5, 4), F.lit("-"), F.substring(h, 1, 4), F.lit("-"), F.substring(joined, 1, 4), F.lit("-"), F.substring(joined, 5, 12))


def generation_token(number: Column) -> Column:
    """Five hex digits of a generation, null outside 0 to 0xFFFFF."""
    return F.when(number.between(0, 0xFFFFF), F.lower(F.lpad(F.hex(number.cast("long")), 5, "0")))


def shard_token(number: Column) -> Column:
    """Four hex digits of a shard, null outside 0 to 0xFFFF."""
    return F.when(number.between(0, 0xFFFF), F.lower(F.lpad(F.hex(number.cast("long")), 4, "0")))


#: 100 ns ticks from 0001-01-01 to 1970-01-01.
EPOCH_TICKS = 621_355_968_000_000_000


def ticks_to_timestamp(ticks: Column) -> Column:
    return F.timestamp_micros(F.floor((ticks - F.lit(EPOCH_TICKS)) / F.lit(10).cast("decimal(20,0)")).cast("long"))


def timestamp_to_ticks(at: Column) -> Column:
    return F.unix_micros(at) * F.lit(10).cast("long") + F.lit(EPOCH_TICKS)


def clamp_index(index: Column, dataset: int) -> Column:
    return F.pmod(index, F.lit(dataset).cast("long")) if dataset > 0 else index


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by a bar: 48 bits, equal on any engine."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))

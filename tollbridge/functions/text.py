"""Readers of the small text formats found in logs, settings and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
HEX_63_BITS = "^0*[0-7]?[0-9A-Fa-f]{1,15}$"

# Size suffixes and their factors.
SIZE_FACTORS = {"": 1, "k": 1024, "m": 1024 * 1024}


def address_number(ip: Column) -> Column:
    """IPv4 text as a number from 0 to 2**32-1; null when the text is no such address."""
    octets = F.split(ip, r"\.")
    value = F.lit(0).cast("bigint")
    for place in range(4):
        value = value * F.lit(256) + F.get(octets, F.lit(place)).try_cast("bigint")
    return F.when(ip.rlike(IPV4), value)


def size_bytes(col: Column) -> Column:
    """``512``, ``128k`` or ``4m`` as a number of bytes; null when it reads otherwise."""
    shape = r"^\s*(\d+)([kKmM]?)\s*$"
    number = F.regexp_extract(col, shape, 1).try_cast("bigint")
    suffix = F.lower(F.regexp_extract(col, shape, 2))
    factor = F.when(suffix == "k", SIZE_FACTORS["k"]).when(suffix == "m", SIZE_FACTORS["m"]).otherwise(1)
    return number * factor


def hex_number(col: Column) -> Column:
    """Hexadecimal text as bigint; null for other text and for values past 63 bits."""
    return F.when(col.rlike(HEX_63_BITS), F.conv(col, 16, 10).try_cast("bigint"))


def hex_text(number: Column) -> Column:
    """A number as upper-case hexadecimal text of at least two digits."""
    digits = F.hex(number)
    return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)


def parse_subject(col: Column) -> Column:
    """``/C=US/CN=x`` or ``C = US, CN = x`` as map<string,string>; null when it is neither.

    A slash or comma only separates fields when ``name=`` follows it, so values may hold them.
    Of a repeated field the last one is kept. The fields are first put on lines of their own, so
    that splitting them needs no regex.
    """
    lines = F.regexp_replace(col, r"(?:^\s*/?|\s*[/,])\s*([A-Za-z][A-Za-z0-9.]*)\s*=\s*", "\n$1=")
    lasting = F.regexp_replace(lines, r"\n([^=\n]++)=[^\n]*+(?=\n(?:[^\n]*+\n)*?\1=)", "")
    fields = F.str_to_map(F.rtrim(F.substring(lasting, 2, 1 << 30)), F.lit("\n"), F.lit("="))
    return F.when(col.rlike(r"^\s*/?\s*[A-Za-z][A-Za-z0-9.]*\s*=") & ~col.contains("\n"), fields)


def name_list(col: Column) -> Column:
    """``DNS:a, DNS:b`` as an array of names; entries of other kinds are left out."""
    entries = F.transform(F.split(col, ","), lambda e: F.trim(e))
    dns = F.filter(entries, lambda e: e.startswith("DNS:"))
    return F.transform(dns, lambda e: F.regexp_replace(e, "^DNS:", ""))

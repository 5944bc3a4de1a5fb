"""Pseudonyms and masks for personal data, as native column expressions."""

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweir import fixed
from claimweir.functions.text import WHITE, filled, is_blank, strip

_BLOCK = 64


def hmac_sha256_hex(message: Column, key: str) -> Column:
    """Keyed digest after RFC 2104, from two nested SHA-256 calls.

    The two padded keys are literals of the plan. Set spark.redaction.string.regex so that they stay out of event logs.
    """
    secret = key.encode("utf-8")
    if len(secret) > _BLOCK:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(_BLOCK, b"\0")
    inner_pad, outer_pad = (bytearray(b ^ x for b in secret) for x in (0x36, 0x5C))
    inner = F.sha2(F.concat(F.lit(inner_pad), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer_pad), F.unhex(inner)), 256)


def _normal_ppsn(ppsn: Column) -> Column:
    return F.upper(strip(filled(ppsn)))


def hash_ppsn(ppsn: Column, salt: str) -> Column:
    digest = hmac_sha256_hex(_normal_ppsn(ppsn), salt)
    return F.concat(F.lit(fixed.HASH_PREFIX), F.substring(digest, 1, 32))


def ppsn_valid(ppsn: Column, pattern: str = fixed.PPSN_WHOLE) -> Column:
    return F.coalesce(_normal_ppsn(ppsn).rlike(f"(?d){pattern}"), F.lit(False))


def mask_name(name: Column, mask: str = "*") -> Column:
    def mask_word(word):
        hidden = F.greatest(F.char_length(word) - 1, F.lit(1))
        return F.when(F.lower(word).isin(fixed.NAME_TITLES), word).otherwise(
            F.concat(F.substring(word, 1, 1), F.repeat(F.lit(mask), hidden))
        )

    # A plain split at one space: a pattern to split at would be compiled for every name.
    words = F.split(F.regexp_replace(strip(name), f"[{WHITE}]+", " "), " ")
    return F.when(is_blank(name), fixed.NAME_REDACTED).otherwise(
        F.array_join(F.transform(words, mask_word), " ")
    )


def at_sign(email: Column) -> Column:
    """Place of the first @ of an address, counted from 1; 0 without one."""
    return F.locate("@", strip(email))


def mask_email(email: Column, mask: str = "*") -> Column:
    """Null for an address with nothing before the @: such a record cannot be governed."""
    address = strip(email)
    at = at_sign(email)
    user = F.substring(address, F.lit(1), at - 1)
    middle = F.repeat(F.lit(mask), F.char_length(user) - 2)
    masked = (
        F.when(at == 1, None)
        .when(at <= 3, F.concat(F.substring(user, 1, 1), F.lit(mask)))
        .otherwise(F.concat(F.substring(user, 1, 1), middle, F.right(user, F.lit(1))))
    )
    domain = F.substring(address, at + 1, F.char_length(address))
    return F.when(F.coalesce(at, F.lit(0)) == 0, fixed.EMAIL_REDACTED).otherwise(
        F.concat(masked, F.lit("@"), domain)
    )


def mask_phone(phone: Column, mask: str = "*") -> Column:
    number = strip(phone)
    shown = F.concat(
        F.substring(number, 1, 7), F.lit(f" {mask * 3} {mask * 2}"), F.right(number, F.lit(2))
    )
    return (
        F.when(is_blank(phone), fixed.PHONE_REDACTED)
        .when(F.char_length(number) <= 6, "***" + mask * 3)
        .otherwise(shown)
    )


def county(address: Column) -> Column:
    name = F.regexp_extract(address, f"(?Ud){fixed.COUNTY_IN_ADDRESS}", 1)
    return F.when(
        F.coalesce(name != "", F.lit(False)), F.concat(F.lit("Co. "), strip(name))
    ).otherwise(fixed.UNKNOWN_COUNTY)


def routing_key(eircode: Column) -> Column:
    code = strip(eircode)
    return F.when(F.char_length(code) >= 3, F.upper(F.substring(code, 1, 3))).otherwise(
        fixed.UNKNOWN_ROUTING_KEY
    )


def sanitize_narrative(text: Column) -> Column:
    """Text without personal data. What a match can begin with is looked at first, so that patterns are not tried at every letter."""
    clean = F.coalesce(text, F.lit(""))
    for first, pattern, replacement in (
        (r"(?=\d)", fixed.PPSN_IN_TEXT, fixed.PPSN_REDACTED),
        # no character of a user part is an @, so a part that is not followed by one is not tried again in shorter pieces
        ("", fixed.EMAIL_IN_TEXT.replace("+)@", "++)@"), fixed.EMAIL_REDACTED),
        (r"(?=[+\d])", fixed.PHONE_IN_TEXT, fixed.PHONE_REDACTED),
    ):
        clean = F.regexp_replace(clean, f"(?U){first}{pattern}", replacement)
    return clean

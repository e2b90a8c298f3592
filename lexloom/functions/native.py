"""Text, codec and hash functions as Catalyst expressions. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip takes for white space.
PY_SPACE = r"[\t-\r\x1c-\x20\x85   -     　]"
#: Words with inner apostrophes, points and the like, or single other signs; every match is a token.
TOKEN = r"[\p{L}\p{M}\p{Nd}_]+(?:['.:][\p{L}][\p{L}\p{M}\p{Nd}_]*|['.,;][\p{Nd}][\p{L}\p{M}\p{Nd}_]*)*|[^ \t\n\x0B\f\r]"


def _icu(text: Column, method: str, compat: bool) -> Column:
    # ASCII is in every form, and a reflected call costs more than the look
    other = F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(compat))
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(other)


def nfc(t: Column) -> Column:
    return _icu(t, "compose", False)


def nfd(t: Column) -> Column:
    return _icu(t, "decompose", False)


def nfkc(t: Column) -> Column:
    return _icu(t, "compose", True)


def nfkd(t: Column) -> Column:
    return _icu(t, "decompose", True)


def normalize(t: Column) -> Column:
    """NFC, LF line ends, no blanks before a line end, at most one empty line together, no white space at the ends."""
    t = F.regexp_replace(nfc(t), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]++(?=\n)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, rf"\A{PY_SPACE}++|{PY_SPACE}++\z", "")


def finalize(t: Column) -> Column:
    text = normalize(t)
    return F.struct(text.alias("text"), F.sha2(text, 256).alias("sha256"))


def strip_controls(t: Column) -> Column:
    return F.regexp_replace(t, r"[\x00-\x1f\x7f]+", " ")


def strip_accents(t: Column) -> Column:
    return F.regexp_replace(nfd(t), r"\p{M}+", "")


def collapse_whitespace(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, rf"{PY_SPACE}+", " "), r"\A | \z", "")


def decode_utf8(raw: Column, errors: str = "strict") -> Column:
    text = raw.cast("string")
    return F.make_valid_utf8(text) if errors == "replace" else F.try_validate_utf8(text)


def utf8_is_valid(raw: Column) -> Column:
    return F.is_valid_utf8(raw.cast("string"))


def utf8_byte_len(t: Column) -> Column:
    return F.octet_length(t)


def utf16_byte_len(t: Column) -> Column:
    return F.octet_length(F.encode(t, "UTF-16LE"))


def b64_encode_bytes(raw: Column) -> Column:
    return F.regexp_replace(F.base64(raw), "[\r\n]", "")


def quote_plus(t: Column) -> Column:
    return F.replace(F.replace(F.url_encode(t), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def quote(t: Column) -> Column:
    return F.replace(F.replace(quote_plus(t), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def digest_hex(kind: str, x: Column) -> Column:
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512)}[kind](x)


def digest(kind: str, x: Column) -> Column:
    return F.unhex(digest_hex(kind, x))


def hmac_sha256_hex(key: Column, data: Column) -> Column:
    return F.try_reflect(F.lit("org.apache.commons.codec.digest.HmacUtils"), F.lit("hmacSha256Hex"), key, data)


def grapheme_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"\X"))


def tokens(t: Column) -> Column:
    """Tokens in lower case, punctuation among them, white space not."""
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN), 0)


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def chunk_overlap_cost(overlap: Column) -> Column:
    return F.when(overlap.between(0, 1) & (overlap < 1), 1 / (1 - overlap))


def lsh_probability(s: Column, bands: int, rows: int) -> Column:
    return 1 - F.pow(1 - F.pow(s, rows), bands)


def lsh_threshold(bands: int, rows: int) -> float:
    return (1 / bands) ** (1 / rows)


def simhash_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def uuid7_timestamp_ms(u: Column) -> Column:
    return F.conv(F.substring(F.replace(u, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")


def uuid_version(u: Column) -> Column:
    return F.conv(F.substring(F.replace(u, F.lit("-"), F.lit("")), 13, 1), 16, 10).cast("int")


UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def uuid_parse(value: Column) -> Column:
    """The 16 bytes of a canonical lower-case UUID; null for anything else."""
    return F.when(F.rlike(value, F.lit(UUID)), F.unhex(F.replace(value, F.lit("-"), F.lit(""))))


def uuid_version(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit(UUID)), F.conv(F.substring(value, 15, 1), 16, 10).cast("int"))


def uuid7_timestamp_ms(value: Column) -> Column:
    """Milliseconds since the epoch of a UUID of version 7; null for anything else."""
    return F.when(uuid_version(value) == 7, F.conv(F.substring(F.replace(value, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long"))


def uuid4() -> Column:
    return F.uuid()


def uuid7() -> Column:
    """The time in milliseconds, then random bits; rows of one query share the time."""
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    tail = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"), F.substring(tail, 1, 3), F.lit("-"), F.substring(tail, 17, 4), F.lit("-"), F.substring(tail, 21, 12))


def minhash_jaccard(a: Column, b: Column) -> Column:
    """Share of equal rows of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def minhash_weighted_jaccard(a: Column, b: Column) -> Column:
    """Share of rows, structs of hash and level, that are equal in both signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)

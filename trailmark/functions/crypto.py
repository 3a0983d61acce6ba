"""Field encryption as columns (F23): AES-GCM in built-in functions, in a text envelope that names its key.

An envelope is ``ENC2:`` and the base64 of: version, length of the key's name (two bytes), the name, version of the frame, nonce, tag, ciphertext.
The name of the field and of the key are authenticated, so a value moved to another field does not decrypt. Keys are read by name from
a map column; nothing here stores one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prefix of an encrypted text, the versions of envelope and frame, bytes of nonce and tag.
PREFIX, ENVELOPE, FRAME, NONCE, TAG = "ENC2:", "01", "01", 12, 16


def _context(key_name: Column, field: str) -> Column:
    return F.encode(F.concat(key_name, F.lit("|"), F.lit(field)), "UTF-8")


def encrypted(text: Column, field: str, keys: Column, key_name: str) -> Column:
    """The envelope of each text, with a nonce of its own; null and empty texts stay as they are."""
    name = F.lit(key_name)
    head = F.concat(F.unhex(F.lit(ENVELOPE)), F.unhex(F.lpad(F.hex(F.octet_length(name)), 4, "0")), F.encode(name, "UTF-8"), F.unhex(F.lit(FRAME)))

    def framed(sealed: Column) -> Column:
        at = lambda start, length: F.substring(sealed, start, length)
        body = F.octet_length(sealed) - NONCE - TAG
        return F.concat(head, at(1, NONCE), at(body + (NONCE + 1), F.lit(TAG)), at(F.lit(NONCE + 1), body))

    sealed = F.aes_encrypt(text, F.element_at(keys, name), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _context(name, field))
    envelope = F.get(F.transform(F.array(sealed), framed), 0)  # bound once: each evaluation would draw its own nonce
    return F.when(F.length(text) > 0, F.concat(F.lit(PREFIX), F.regexp_replace(F.base64(envelope), r"\s", ""))).otherwise(text)


def is_encrypted(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit(PREFIX)), F.lit(False))


def _opened(text: Column) -> tuple[Column, Column]:
    """The key's name and the frame behind its version. Nothing is told of the length of a text that is no envelope."""
    data = F.unbase64(F.substring(text, F.lit(len(PREFIX) + 1), F.length(text)))
    length = F.conv(F.hex(F.substring(data, 2, 2)), 16, 10).cast("int")
    return F.decode(F.substring(data, F.lit(4), length), "UTF-8"), F.substring(data, length + 5, F.octet_length(data))


def decrypted(text: Column, field: str, keys: Column) -> Column:
    """The text of each envelope; what is none stays as it is. Null where key, field or bytes are not those that it was made with."""
    name, frame = _opened(text)
    sealed = F.concat(F.substring(frame, 1, NONCE), F.substring(frame, F.lit(NONCE + TAG + 1), F.octet_length(frame)), F.substring(frame, NONCE + 1, TAG))
    plain = F.try_aes_decrypt(sealed, F.element_at(keys, name), F.lit("GCM"), F.lit("DEFAULT"), _context(name, field))
    return F.when(is_encrypted(text), F.decode(plain, "UTF-8")).otherwise(text)


def rotated(text: Column, field: str, keys: Column, key_name: str) -> Column:
    """Each envelope made anew with another key; texts that are none stay as they are."""
    return F.when(is_encrypted(text), encrypted(decrypted(text, field, keys), field, keys, key_name)).otherwise(text)

"""Identity rules (X1-X9) as column expressions. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an index was analysed and embedded with; written to its manifest and checked on reading.
ANALYZER = "porter+simple+default-stop/2"


def doc_id(uri: Column) -> Column:
    """The first 16 bytes of the SHA-256 of the uri, as 32 hex digits."""
    return F.substring(F.sha2(uri, 256), 1, 32)


def content_hash(text: Column) -> Column:
    """The SHA-256 of the text in hex."""
    return F.sha2(text, 256)


def chunk_id(doc: Column, ord_: Column) -> Column:
    """Document id and ordinal."""
    return F.concat(doc, F.lit(":"), ord_.cast("string"))


def embed_text(title: Column, heading_path: Column, text: Column) -> Column:
    """Title, heading path where there is one, and the text. Null title and path count as empty."""
    head = F.coalesce(heading_path, F.lit(""))
    return F.concat(F.coalesce(title, F.lit("")), F.when(head != "", F.concat(F.lit(" > "), head)).otherwise(""), F.lit("\n\n"), text)


def memory_id(kind: Column, text: Column) -> Column:
    """The first 6 bytes of the SHA-256 of kind and trimmed text."""
    return F.substring(F.sha2(F.concat(kind, F.lit("|"), F.trim(text)), 256), 1, 12)


def memory_uri(kind: Column, text: Column) -> Column:
    return F.concat(F.lit("memory://"), kind, F.lit("/"), memory_id(kind, text))


def model_id(model: str, dims: int, prefix: str) -> str:
    """The name of an embedding space."""
    return f"{model}@{dims}+{prefix}"


def file_stamp(modified: Column, length: Column) -> Column:
    """Seconds of modification and length of a file."""
    return F.concat(F.unix_timestamp(modified).cast("string"), F.lit(":"), length.cast("string"))


def entity_id(kind: Column, name: Column) -> Column:
    """X9."""
    return F.concat(kind, F.lit(":"), name)

"""Hashes, deterministic ids and canonical JSON."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text

# Namespaces of chunk and point ids.
CHUNK_NAMESPACE = "6f9d8c2a-1e7b-4c3a-9a2e-8b5d4f1c0e77"
POINT_NAMESPACE = "2c1e8a4d-7b93-4f16-a5c2-0d9e3f7b6a18"


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def text_hash(pages: Column, compose: bool = True) -> Column:
    """Hash of the page texts joined by spaces, pagination ignored."""
    return sha256(normalize_text(F.array_join(pages, " "), compose))


def json_string(value: Column) -> Column:
    """A string as a JSON literal, other than ASCII kept as it is."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(short))
    return F.concat(F.lit('"'), out, F.lit('"'))


def structure_hash(pages: Column) -> Column:
    """Hash of ``[[page_number,text],...]`` for an array of structs with these two fields."""
    rows = F.transform(pages, lambda p: F.concat(F.lit("["), F.coalesce(p["page_number"].cast("string"), F.lit("null")), F.lit(","), json_string(p["text"]), F.lit("]")))
    return sha256(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")))


def profile_hash(**settings: object) -> str:
    """SHA-256 of the settings as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def chunking_profile(target_tokens: int, overlap_tokens: int, version: str = "chunk-1", tokenizer_id: str = "whitespace-1") -> str:
    if target_tokens <= 0 or not 0 <= overlap_tokens < target_tokens:
        raise ValueError("target_tokens must be positive and overlap_tokens below it")
    return profile_hash(version=version, target_tokens=target_tokens, overlap_tokens=overlap_tokens, tokenizer_id=tokenizer_id)


def embedding_profile(model_name: str, vector_size: int, distance: str = "cosine", normalize: bool = True, prefix_scheme: str = "none", version: str = "embed-1") -> str:
    if vector_size <= 0 or distance not in ("cosine", "dot", "euclid"):
        raise ValueError("vector_size must be positive and distance one of cosine, dot, euclid")
    return profile_hash(model_name=model_name, vector_size=vector_size, distance=distance, normalize=normalize, prefix_scheme=prefix_scheme, version=version)


def uuid5(namespace: str, name: Column) -> Column:
    """A version 5 UUID of the UTF-8 name."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(space, name.cast("binary")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def chunk_id(content_id: Column, profile: Column, index: Column) -> Column:
    return uuid5(CHUNK_NAMESPACE, F.concat_ws(":", content_id, profile, index.cast("string")))


def point_id(content_id: Column, chunking: Column, embedding: Column, index: Column) -> Column:
    return uuid5(POINT_NAMESPACE, F.concat_ws(":", content_id, chunking, embedding, index.cast("string")))


def map_checksum(values: Column) -> Column:
    """SHA-256 of a string map as JSON with sorted keys."""
    entries = F.array_sort(F.map_entries(values))
    rows = F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), F.coalesce(json_string(e["value"]), F.lit("null"))))
    return sha256(F.concat(F.lit("{"), F.array_join(rows, ","), F.lit("}")))


def content_address(version: Column, structure: Column, profile: Column) -> Column:
    """``version/xx/hash.profile12.json.gz``."""
    return F.concat(version, F.lit("/"), F.substring(structure, 1, 2), F.lit("/"), structure, F.lit("."), F.substring(profile, 1, 12), F.lit(".json.gz"))


def model_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def collection_name(base: str, model: Column, profile: Column) -> Column:
    return F.concat(F.lit(base), F.lit("__"), model_slug(model), F.lit("__"), F.substring(profile, 1, 12))


def plain_slug(name: str) -> str:
    return re.sub("[^a-z0-9]+", "-", name.lower()).strip("-")

"""Identities: SHA-256 over fields that a zero byte separates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrook.functions.text import collapse


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *(F.coalesce(f, F.lit("")) for f in fields)), 256)


def memory_id(kind: Column, scope: Column, scope_key: Column, content: Column) -> Column:
    return F.concat(F.lit("mem_"), F.substring(digest(kind, scope, scope_key, content), 1, 32))


def fingerprint(kind: Column, scope: Column, scope_key: Column, content: Column) -> Column:
    return digest(kind, scope, scope_key, collapse(content))


def dedup_key(kind: Column, shown: Column) -> Column:
    return digest(kind, collapse(shown))


def _short(prefix: str, *fields: Column, chars: int = 32) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest(*fields), 1, chars))


def entity_id(project: Column, scope: Column, scope_key: Column, type_: Column, name: Column) -> Column:
    return _short("ent_", project, scope, scope_key, type_, name)


def relation_id(scope_key: Column, subject: Column, predicate: Column, object_: Column, type_: Column) -> Column:
    return _short("rel_", scope_key, subject, predicate, object_, type_)


def version_id(base: Column, valid_ms: Column, invalid_ms: Column) -> Column:
    """The id of a relation whose base id is taken by one of another validity."""
    bound = lambda x: F.coalesce(x.cast("string"), F.lit("open"))
    return _short("rel_", base, bound(valid_ms), bound(invalid_ms))


def fact_id(scope: Column, type_: Column, text: Column, units: Column) -> Column:
    return _short("fact_", scope, type_, text, F.array_join(units, "\0"))


def observation_id(scope: Column, statement: Column) -> Column:
    return _short("obs_", scope, statement)


def unit_id(id_: Column, content_hash: Column, scope: Column, origin: Column, source: Column) -> Column:
    return _short("unit_", id_, content_hash, scope, origin, source)


def retrieval_id(query: Column, now_ms: Column, generation: Column, ids: Column) -> Column:
    return _short("ret_", query, now_ms.cast("string"), generation, F.array_join(F.transform(ids, lambda x: F.concat(x.cast("string"), F.lit(","))), ""), chars=24)


def revision(content_hash: Column, scope: Column, scope_key: Column, origin: Column, source: Column, policy: Column) -> Column:
    """What an extraction was made from: another policy or another text gives another."""
    return digest(content_hash, scope, scope_key, origin, source, policy)


def fields_fingerprint(*fields: Column) -> Column:
    """SHA-256 over fields of any bytes, each after its length in eight bytes, the lowest first."""

    def counted(field: Column) -> Column:
        raw = F.encode(F.coalesce(field, F.lit("")), "UTF-8")
        size = F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")
        low_first = F.array_join(F.reverse(F.regexp_extract_all(size, F.lit("(..)"))), "")
        return F.concat(F.unhex(low_first), raw)

    return F.sha2(F.concat(*map(counted, fields)), 256)

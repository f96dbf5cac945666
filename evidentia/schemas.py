"""Explicit schemas of stored data; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from evidentia.config import INTENTS

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _list(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


SOURCES = _struct(
    id=_S, kind=_S, title=_S, aliases=_list(_S), tags=_list(_S), filePath=_S, publicHref=_S,
    projectId=_S, pageCount=_I, structuredText=_S, visualPages=_list(_I),
)

CLAIM = _struct(
    id=_S, text=_S, provenance=_S, evidence=_list(_struct(sourceId=_S, page=_I)),
    intents=_list(_S), topics=_list(_S), public=_B,
)
PAGE = _struct(
    page=_I, role=_S, informationDensity=_S, visualSummary=_S, entities=_list(_S),
    relationships=_list(_S), claimIds=_list(_S),
)
QUESTION = _struct(question=_S, locale=_S, intents=_list(_S), preferredClaimIds=_list(_S))
DOSSIER = _struct(
    projectId=_S, title=_S, aliases=_list(_S), oneLine=_S, pageCount=_I, claims=_list(CLAIM),
    sectionClaims=T.MapType(_S, _list(_S)), pages=_list(PAGE), commonQuestions=_list(QUESTION),
)
GLOSSARY = _struct(
    version=_I, entries=_list(_struct(canonical=_S, aliases=_list(_S), intents=_list(_S)))
)

CHUNKS = _struct(
    id=_S, source_id=_S, project_id=_S, page=_I, title=_S, text=_S, terms=_list(_S),
    aliases=_list(_S), tags=_list(_S), citation_label=_S, public_href=_S, knowledge_kind=_S,
    intents=_list(_S), information_density=_S, page_role=_S, provenance=_S,
    evidence_pages=_list(_I), question_aliases=_list(_S),
)

ASSETS = _struct(
    version=_I,
    projects=_list(_struct(
        id=_S, source=_S, sourceHash=_S, pageCount=_I,
        pages=_list(_struct(page=_I, mobile=_S, desktop=_S)),
    )),
)

INTENT_ORDER = {intent: position for position, intent in enumerate(INTENTS)}

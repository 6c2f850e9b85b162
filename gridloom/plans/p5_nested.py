"""Problem 5: funding search pages and tender releases as flat rows with their parents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators.shred import Entity, Shape, entities, entity_table, shred, unreadable
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()

_ITEMS = ("releases.tender.items", "releases.tender.lots.items")
ENTITIES = (
    Entity("agency", ("data.searchParams.agencies",), "code", scalar_is_code=True),
    Entity("opp_hit", ("data.oppHits",), "id"),
    Entity("cfda", ("data.oppHits.cfdaList",), "number", scalar_is_code=True),
    Entity("release", ("releases",), "ocid"),
    Entity("buyer", ("releases.buyer",), "id"),
    Entity("lot", ("releases.tender.lots",), "id"),
    Entity("item", _ITEMS, "id"),
    Entity("classification", tuple(f"{i}.additionalClassifications" for i in _ITEMS), "id", scalar_is_code=True),
)
NOTICES = Shape(
    lists=frozenset(s for e in ENTITIES if e.name != "buyer" for s in e.shapes),
    splits={"data.searchParams.agencies": "|"},
    lone_root=("releases", "releases", ("ocid", "tender", "buyer")),
)


def notice_entities(notices: DataFrame) -> DataFrame:
    """(raw_id, entity, parent_path, node_path, node_code) of ``notice_raw``; see ``operators.shred.entities``."""
    keep = [s for e in ENTITIES for shape in e.shapes for s in (shape, f"{shape}.{e.code}")]
    return entities(shred(notices, "raw_id", "payload", NOTICES, keep), ENTITIES).withColumnRenamed("key", "raw_id")


@REG.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each non-empty element of each payload with its parent."""
    return notice_entities(table(spark, sf_dir, "notice_raw"))


@REG.add("p5_unreadable")
def p5_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_id and reason of the payloads that have no elements because they cannot be read."""
    return unreadable(table(spark, sf_dir, "notice_raw"), "raw_id", "payload").withColumnRenamed("key", "raw_id")


#: Tables with all columns: entity, its scalar fields and its lists of scalars. Page, party and region have tables only.
TABLES = {
    e.name: (e, fields, lists)
    for e, (fields, lists) in zip(
        (*ENTITIES, Entity("page", ("",), "version"), Entity("party", ("releases.parties",), "name"), Entity("region", tuple(f"{i}.deliveryAddresses" for i in _ITEMS), "region")),
        (
            (("code", "label"), ()),
            (("id", "number", "title", "agencyCode", "docType", "oppStatus", "openDate", "closeDate"), ()),
            (("number",), ()),
            (("ocid", "id", "language", "tender.id", "tender.status", "tender.title", "tender.value.amount", "tender.value.currency"), ("tag",)),
            (("id", "name"), ()),
            (("id", "status", "contractPeriod.durationInDays"), ("contractPeriod.renewal.options",)),
            (("id", "classification.id", "classification.scheme"), ()),
            (("id", "scheme", "description"), ()),
            (("version", "msg", "errorcode", "data.hitCount", "data.startRecord", *[f"data.searchParams.{f}" for f in ("keyword", "oppStatuses", "resultType", "rows", "startRecordNum")]), ()),
            (("name",), ("roles",)),
            (("region",), ()),
        ),
        strict=True,
    )
}
WHOLE = replace(NOTICES, elements=frozenset(s for e, _, _ in TABLES.values() for s in e.shapes))


def notice_table(notices: DataFrame, name: str) -> DataFrame:
    """One table of ``TABLES`` over the whole of ``notice_raw``; see ``operators.shred.entity_table``."""
    return entity_table(shred(notices, "raw_id", "payload", WHOLE), *TABLES[name]).withColumnRenamed("key", "raw_id")


def _table_query(name: str) -> None:
    @REG.add(f"p5_table_{name}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return notice_table(table(spark, sf_dir, "notice_raw"), name)

    query.__doc__ = f"The {name} elements of each payload with all their columns."


for _name in TABLES:
    _table_query(_name)

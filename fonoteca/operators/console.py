"""Ad-hoc SQL over the catalogue, read only.

A statement runs only if every node of its parsed plan is one of a query; a prefix of SELECT or WITH
says nothing, as WITH may introduce a write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FETCH = 500
#: Nodes of parsed queries. Fixed values.
ALLOWED = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation Union Intersect Except "
    "Distinct Deduplicate UnresolvedWith WithWindowDefinition Window Generate Expand GroupingSets UnresolvedHaving Pivot Unpivot LateralJoin UnresolvedHint ResolvedHint Sample Tail View CTERelationDef CTERelationRef "
    "WithCTE UnresolvedTableValuedFunction UnresolvedTVFAliases Range ResolvedInlineTable UnresolvedPivot".split()
)


class NotAQuery(ValueError):
    pass


def checked(spark: SparkSession, sql: str) -> None:
    """Raises NotAQuery unless sql is one query."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise NotAQuery("empty statement")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.nodeName()
        if name not in ALLOWED:
            raise NotAQuery(f"{name} is not allowed")
        for parts in (node.children(), node.innerChildren()):
            waiting += [parts.apply(i) for i in range(parts.size()) if hasattr(parts.apply(i), "innerChildren")]


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int | None = FETCH) -> DataFrame:
    """The rows of a query over the named tables, at most `limit`."""
    checked(spark, sql)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    found = spark.sql(sql.strip().rstrip(";"))
    return found.limit(limit) if limit is not None else found

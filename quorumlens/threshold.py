"""The entity threshold for every grouping of a query that somebody else wrote.

Each grouping whose rows come from a table with the entity column gets a count of distinct entities, and groups with
fewer than ``k`` of them go before anything above sees them. A column that the text does not carry up to the grouping
is carried there. A grouping by the entity itself is a step on the way to another one. What cannot be checked that way
is refused. DISTINCT lists values, as value discovery does, and counts nobody.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quorumlens.lineage import analysed, below, items, kind
from quorumlens.policy import PolicyViolation

_ENTITIES = "quorumlens_entities"

#: Nodes that hand on all columns of their only child.
_PASSING = {"Filter", "SubqueryAlias", "Sort", "Window", "RepartitionByExpression", "ResolvedHint"}
#: Subqueries that show values; those of IN and EXISTS only choose rows, which the grouping around them counts.
_SUBQUERIES = {"ScalarSubquery", "LateralSubquery"}


class _Rewrite:
    def __init__(self, df: DataFrame, entity: str, k: int):
        self.jvm, self.entity, self.k = df.sparkSession._jvm, entity, int(k)
        self.nodes = self.jvm.org.apache.spark.sql.catalyst.plans.logical
        self.none = self.jvm.scala.Option.empty()
        self.parser = df.sparkSession._jsparkSession.sessionState().sqlParser()

    def seq(self, values: list):
        return self.jvm.org.apache.spark.api.python.PythonUtils.toSeq(values)

    def _entity_of(self, plan) -> list:
        return [a for a in items(plan.output()) if a.name().lower() == self.entity.lower()]

    def _by_entity(self, aggregate) -> bool:
        keys = items(aggregate.groupingExpressions())
        return any(kind(e) == "AttributeReference" and e.name().lower() == self.entity.lower() for e in keys)

    def holds_rows(self, plan) -> bool:
        """Whether single rows of a table with the entity reach this node, not merged by a grouping."""
        if kind(plan) == "Aggregate" and not self._by_entity(plan):
            return False
        children = below(plan)
        if not children:
            return bool(self._entity_of(plan))
        return any(self.holds_rows(c) for c in children)

    def carried(self, plan):
        """The plan with the entity among its columns."""
        if self._entity_of(plan):
            return plan
        name, children = kind(plan), below(plan)
        if name in _PASSING:
            return plan.withNewChildren(self.seq([self.carried(children[0])]))
        if name == "Project":
            child = self.carried(children[0])
            return self.nodes.Project(self.seq([*items(plan.projectList()), self._only(child)]), child)
        if name == "Aggregate" and self._by_entity(plan):
            keys = [e for e in items(plan.groupingExpressions()) if kind(e) == "AttributeReference" and e.name().lower() == self.entity.lower()]
            return self.nodes.Aggregate(plan.groupingExpressions(), self.seq([*items(plan.aggregateExpressions()), keys[0]]), children[0], self.none)
        if name == "Join":
            sides = [self.carried(c) if self.holds_rows(c) else c for c in children]
            return plan.withNewChildren(self.seq(sides))
        raise PolicyViolation(f"{self.entity} cannot be counted below {name}; group the rows of the table themselves")

    def _only(self, plan):
        found = self._entity_of(plan)
        if len({a.exprId().id() for a in found}) != 1:
            raise PolicyViolation(f"more than one {self.entity} reaches a grouping; select one of them before it")
        return found[0]

    def grouped(self, plan):
        """A grouping without the groups of fewer than ``k`` entities, with the columns it had."""
        child = self.carried(plan.child())
        entity = self._only(child)
        alias = self.parser.parseExpression(f"count(DISTINCT `{entity.name()}`) AS {_ENTITIES}")
        qualified = list(items(entity.qualifier()))
        if qualified:
            name = ".".join(f"`{part}`" for part in [*qualified, entity.name()])
            alias = self.parser.parseExpression(f"count(DISTINCT {name}) AS {_ENTITIES}")
        counted = self.nodes.Aggregate(plan.groupingExpressions(), self.seq([*items(plan.aggregateExpressions()), alias]), child, self.none)
        enough = self.nodes.Filter(self.parser.parseExpression(f"{_ENTITIES} >= {self.k}"), counted)
        return self.nodes.Project(plan.output(), enough)

    def apply(self, plan):
        """The plan with a threshold at each grouping."""
        for expression in items(plan.expressions()):
            self._check_subqueries(expression)
        children = below(plan)
        new = [self.apply(c) for c in children]
        if any(a is not b for a, b in zip(children, new, strict=True)):
            plan = plan.withNewChildren(self.seq(new))
        if kind(plan) == "Aggregate" and not self._by_entity(plan) and self.holds_rows(plan.child()):
            return self.grouped(plan)
        return plan

    def _check_subqueries(self, expression) -> None:
        """Inside expressions only the total of a whole table can be left as it is."""
        for child in items(expression.children()):
            self._check_subqueries(child)
        if kind(expression) in _SUBQUERIES and not self._whole(expression.plan()):
            raise PolicyViolation("a subquery over rows of persons may only total a whole table; write it as a joined query")

    def _whole(self, plan) -> bool:
        name, children = kind(plan), below(plan)
        if not children or not self._reads_entity(plan):
            return True
        if name == "Aggregate" and plan.groupingExpressions().size():
            return False
        return name in ("Aggregate", "Project", "SubqueryAlias", "View", "ResolvedHint") and all(self._whole(c) for c in children)

    def _reads_entity(self, plan) -> bool:
        children = below(plan)
        return any(self._reads_entity(c) for c in children) if children else bool(self._entity_of(plan))


def with_threshold(df: DataFrame, entity: str, k: int) -> DataFrame:
    """The rows of a query without those of groups that fewer than ``k`` distinct entities are behind.

    Groupings over tables without the entity column, and over groups that have passed, are left as they are. No job
    is started; a grouping that cannot be checked raises :class:`PolicyViolation`.
    """
    spark = df.sparkSession
    plan = _Rewrite(df, entity, k).apply(analysed(df))
    made = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan)
    return DataFrame(made, spark)

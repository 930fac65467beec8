"""Task texts to task types by keyword votes, and task types to plans of ordered steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text votes for a type once for each of its keywords that it contains. Earlier types win ties.
KEYWORDS = {
    "REVISION_PUBLICATION": ("revision", "publish", "retract", "corrigendum", "preprint", "journal", "version", "upgrade", "修订", "发布", "撤稿", "更正", "预印本", "期刊", "版本", "升级"),
    "CURATION_COMMIT": ("curate", "curation", "commit", "assertion", "ingest", "策审", "策审", "入库", "提交", "断言"),
    "RETRIEVE": ("retrieve", "search", "evidence", "find", "lookup", "检索", "搜索", "证据", "查找"),
}
#: Steps of each type, in order; each depends on the one before.
STEPS = {"RETRIEVE": ("retrieve",), "CURATION_COMMIT": ("retrieve", "curation", "commit"), "REVISION_PUBLICATION": ("revision",)}


def task_type(text: Column, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """The type with the most votes; an exact type name counts at once; null for blank texts and those without a keyword."""
    name, types = F.upper(F.trim(text)), F.array(*map(F.lit, keywords))

    def of(low: Column) -> Column:
        return F.array(*(F.aggregate(F.array(*map(F.lit, words)), F.lit(0), lambda n, w: n + F.contains(low, w).cast("int")) for words in keywords.values()))

    def first(votes: Column) -> Column:
        best = F.array_max(votes)
        return F.when(best > 0, F.element_at(types, F.array_position(votes, best).cast("int")))

    voted = F.get(F.transform(F.transform(F.array(F.lower(text)), of), first), 0)
    return F.when(name.isin(*keywords), name).otherwise(voted)


def classify(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("task_type", task_type(F.col("text")))


def plan(tasks: DataFrame) -> DataFrame:
    """One row for each step of a classified task: position, step, depends_on; a step is named step-<number>-<name>."""
    steps = F.create_map(*(x for t, s in STEPS.items() for x in (F.lit(t), F.array(*(F.lit(f"step-{k + 1}-{name}") for k, name in enumerate(s))))))
    d = tasks.where("task_type is not null").withColumn("steps", F.element_at(steps, F.col("task_type")))
    d = d.select("task_id", "task_type", "steps", F.posexplode("steps").alias("position", "step"))
    return d.select("task_id", "task_type", F.col("position").cast("long").alias("position"), "step", F.get("steps", F.col("position") - 1).alias("depends_on"))


@dataclass
class Step:
    name: str
    run: Callable[[dict], object]
    needs: tuple[str, ...] = ()


@dataclass
class Run:
    """State of a workflow: completed results by step, the step that failed and why."""

    results: dict = field(default_factory=dict)
    failed: str | None = None
    error: str | None = None

    @property
    def status(self) -> str:
        return "FAILED" if self.failed else "COMPLETED"


def execute(steps: list[Step], state: Run | None = None) -> Run:
    """Run steps in list order. A step whose needs are unmet fails; nothing after a failure runs and nothing is tried again.
    Given a former state, completed steps are skipped."""
    state = state or Run()
    state.failed = state.error = None
    for step in steps:
        if step.name in state.results:
            continue
        unmet = [n for n in step.needs if n not in state.results]
        try:
            if unmet:
                raise RuntimeError(f"needs {', '.join(unmet)}")
            state.results[step.name] = step.run(state.results)
        except Exception as e:  # noqa: BLE001  the failure is the result
            state.failed, state.error = step.name, str(e)
            break
    return state

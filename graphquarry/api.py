"""The engine's tools over one snapshot of facts: each takes plain arguments and returns a DataFrame."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .facts import Facts
from .functions.render import briefing
from .functions.text import STOP_WORDS, task_terms, widened_task
from .operators import anchors as anchor_ops
from .operators import classify, prompts, retrieve
from .operators.neighbourhood import Bounds, listing, neighbourhood

#: Command names and the tools that they call.
COMMANDS = {"status": "task_status", "scope": "get_scope", "check": "check_change", "explain": "explain", "callers": "callers", "find": "find", "impact": "impact", "paths": "paths"}
BUDGET_SECONDS = 1.5


class Engine:
    """A snapshot and, once a task is set, its boundary."""

    def __init__(self, facts: Facts, bounds: Bounds = Bounds()):
        self.facts, self.bounds = facts, bounds
        self.spark = facts.files.sparkSession
        self.text: str | None = None

    def _row(self, **values: str) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{c} string" for c in values))

    def set_task(self, text: str) -> DataFrame:
        """Draw the boundary of a task; returns its briefing."""
        self.text = text
        self.tasks = self._row(task="task", text=text).withColumn("terms", task_terms(F.col("text"), STOP_WORDS))
        self.anchors = anchor_ops.anchors(self.facts, self.tasks)
        self.hood = neighbourhood(self.facts, self.anchors, self.bounds)
        return briefing(self.tasks, self.hood.members, self.hood.models)

    def take_prompt(self, text: str) -> str:
        """What a prompt does to the task: opened, or a verdict; wider or other jobs draw the boundary anew."""
        if self.text is None:
            self.set_task(text)
            return "OPENED"
        around = prompts.boundary(self.hood.members, self.anchors)
        verdict = prompts.verdicts(self._row(prompt="p", task="task", text=text), prompts.name_index(self.facts), around).first().verdict
        if verdict == "NEW":
            self.set_task(text)
        elif verdict == "WIDENED":
            self.set_task(self._row(a=self.text, b=text).select(widened_task(F.col("a"), F.col("b"))).first()[0])
        return verdict

    def task_status(self) -> DataFrame:
        return self.hood.stats

    def get_scope(self, most: int = 10) -> DataFrame:
        return listing(self.hood.members, most)

    def check_change(self, changes: DataFrame) -> DataFrame:
        """Verdicts on changes in the form of `classify.INTENT`; their task is this one."""
        return classify.verdicts(self.facts, self.hood, self.tasks, changes.withColumn("task", F.lit("task")))

    def explain(self, name: str) -> DataFrame:
        """Why a function is in scope, or nothing."""
        return self.hood.members.where((F.col("name") == name) | (F.col("file") == name)).select("name", "file", "distance", "reason")

    def callers(self, symbol: str, limit: int = retrieve.LIMIT) -> DataFrame:
        return retrieve.callers_of(self.facts, self.facts.functions.where(F.col("name") == symbol).select("key"), limit=limit)

    def find(self, text: str, limit: int = 15) -> DataFrame:
        return anchor_ops.search_view(self.facts, self._row(task="find", text=text), limit)

    def impact(self, symbol: str, limit: int = retrieve.LIMIT) -> DataFrame:
        return retrieve.impact(self.facts, symbol, limit)

    def paths(self, model: str, route: str | None = None, limit: int = retrieve.LIMIT) -> DataFrame:
        """Routes that reach a model; if none does by a call, the functions that touch it themselves."""
        found = retrieve.model_paths(self.facts, self._row(name=model), limit=limit, route=route)
        if not found.isEmpty():
            return found
        return retrieve.touchers(self.facts, self._row(name=model), limit)

    def run(self, command: str, *arguments) -> DataFrame:
        return getattr(self, COMMANDS[command])(*arguments)


def within_budget(ask: Callable[[], DataFrame], seconds: float = BUDGET_SECONDS) -> list[Row] | None:
    """The rows of an answer, or None if it takes longer; the jobs of an answer that is late are cancelled."""
    found: list[list[Row]] = []
    failed: list[BaseException] = []
    spark = None

    def work() -> None:
        nonlocal spark
        try:
            df = ask()
            spark = df.sparkSession
            spark.addTag(tag)
            found.append(df.collect())
        except BaseException as e:  # noqa: BLE001  handed to the caller below
            failed.append(e)

    tag = f"budget-{threading.get_ident()}"
    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        if spark is not None:
            spark.interruptTag(tag)
        return None
    if failed:
        raise failed[0]
    return found[0]

"""User extensions: twelve named points that are resolved when a plan is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.operators.results import action_status

#: name -> whether it returns a value (one callback) or only listens (any number)
INTERFACES = {
    "accept_url": True, "get_urls": False, "handle_pre_response": True, "handle_response": True, "handle_error": True, "wait_time": True,
    "resolve_dns": True, "resolve_dns_result": False, "queued_url": False, "dequeued_url": False, "finishing_statistics": False, "exit_status": True,
}
ACTIONS = ("normal", "retry", "finish", "stop")


@dataclass
class Hooks:
    callbacks: dict[str, list[Callable]] = field(default_factory=dict)

    def connect(self, name: str, callback: Callable) -> None:
        if name not in INTERFACES:
            raise ValueError(f"no such hook: {name}")
        held = self.callbacks.setdefault(name, [])
        if INTERFACES[name] and held:
            raise ValueError(f"hook is connected already: {name}")
        held.append(callback)

    def disconnect(self, name: str) -> None:
        self.callbacks.pop(name, None)

    def call(self, name: str, default, *args):
        """The callback's column, or ``default`` where none is connected. Callbacks take and give columns; a pandas UDF is one."""
        held = self.callbacks.get(name)
        return held[0](*args) if held else default

    def notify(self, name: str, *args) -> None:
        for f in self.callbacks.get(name, []):
            f(*args)


def attach(hooks: Hooks, plugin: object) -> Hooks:
    """Connects every method of a plugin that has the name of an interface."""
    for name in INTERFACES:
        if callable(getattr(plugin, name, None)):
            hooks.connect(name, getattr(plugin, name))
    return hooks


def action_of(hooks: Hooks, url: Column, code: Column, error: Column) -> Column:
    """The action for a row: of handle_error where there is an error, otherwise of handle_pre_response unless it is
    ``normal``, and of handle_response."""
    normal = F.lit("normal")
    before = hooks.call("handle_pre_response", normal, url, code)
    after = hooks.call("handle_response", normal, url, code)
    return F.when(error.isNotNull(), hooks.call("handle_error", normal, url, error)).when(before != "normal", before).otherwise(after)


def handled(results: DataFrame, hooks: Hooks, status: Column) -> DataFrame:
    """``results`` (url, status_code, error) with the action and the status after it."""
    return results.withColumn("action", action_of(hooks, F.col("url"), F.col("status_code"), F.col("error"))).withColumn("status", action_status(F.col("action"), status))


def exit_code(hooks: Hooks, code: int) -> int:
    """The code that exit_status makes of the crawl's own."""
    held = hooks.callbacks.get("exit_status")
    return held[0](code) if held else code


def wait_seconds(hooks: Hooks, seconds: Column) -> Column:
    return hooks.call("wait_time", seconds, seconds)


def more_urls(pages: DataFrame, hooks: Hooks) -> DataFrame | None:
    """The rows of all get_urls listeners: functions of the pages' frame."""
    parts = [f(pages) for f in hooks.callbacks.get("get_urls", [])]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out

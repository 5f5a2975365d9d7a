"""Plugins: named objects with functions that are called around generation and writing.

A plugin has any of these; each may give back a changed value, or None to leave it as it is:
on_schema(schema), before_generate(plan), after_generate(tables), before_insert(table, rows), with rows a DataFrame. What they
change are plans and DataFrames, so the work stays on the cluster. before_insert_batch(table, batch) sees the rows on their way, a
batch of Arrow at a time in the tasks that write them, and gives back a batch of the same columns. register_generators(register) adds generators when the plugin
is loaded; after_insert(table, n) hears how many rows a table got.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable
from typing import Any

from weftline.functions.generators import register

HOOKS = ("on_schema", "register_generators", "before_generate", "after_generate", "before_insert", "before_insert_batch", "after_insert")


class PluginError(ValueError):
    pass


def load_plugin(spec: str | dict) -> Any:
    """The plugin that "module" or "module:name" names, the name being plugin where none is given; a function is called with the
    options of {"name": ..., "options": {...}} and gives the plugin."""
    name, options = (spec, {}) if isinstance(spec, str) else (spec["name"], spec.get("options", {}))
    module, _, attribute = name.partition(":")
    try:
        found = getattr(importlib.import_module(module), attribute or "plugin")
    except (ImportError, AttributeError) as e:
        raise PluginError(f"cannot load the plugin {name}: {e}") from e
    plugin = found(**options) if callable(found) else found
    if not isinstance(getattr(plugin, "name", None), str):
        raise PluginError(f"the plugin {name} has no name")
    if not any(callable(getattr(plugin, h, None)) for h in HOOKS):
        raise PluginError(f"the plugin {plugin.name} has none of the functions {', '.join(HOOKS)}")
    if callable(getattr(plugin, "register_generators", None)):
        plugin.register_generators(register)
    return plugin


def through(plugins: Iterable, hook: str, value: Any, *before: Any) -> Any:
    """The value after each plugin's function in turn; before are arguments that come before it."""
    for p in plugins:
        if callable(fn := getattr(p, hook, None)):
            out = fn(*before, value)
            value = value if out is None else out
    return value


def batchwise(plugins: Iterable, table: str, rows: Any) -> Any:
    """rows (a DataFrame) with every batch put through the plugins that see batches."""
    seeing = [p for p in plugins if callable(getattr(p, "before_insert_batch", None))]
    if not seeing:
        return rows
    return rows.mapInArrow(lambda batches: (through(seeing, "before_insert_batch", b, table) for b in batches), rows.schema)

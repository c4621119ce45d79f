"""The memory and note operators behind one name each, told apart by an action."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import notes as N
from .chain import Parameter, Tool


def dispatch(actions: dict[str, Callable[..., DataFrame]], action: str, **args) -> DataFrame:
    if action not in actions:
        raise ValueError(f"unknown action: {action} (valid: {', '.join(actions)})")
    return actions[action](**args)


def action_tool(name: str, actions: dict[str, Callable[..., DataFrame]], parameters: tuple[Parameter, ...] = (), description: str = "") -> Tool:
    """A tool whose first parameter picks the action; the others are passed on."""
    first = Parameter("action", required=True, description=" | ".join(actions))
    return Tool(name, lambda action, **args: dispatch(actions, action, **args), (first, *parameters), description)


def existing(notes: DataFrame, note_id: str) -> DataFrame:
    """The note; an error in the job that reads it if there is none."""
    one = notes.sparkSession.range(1).select(F.lit(note_id).alias("id"))
    found = one.join(notes.filter(F.col("id") == note_id).withColumn("_found", F.lit(True)), "id", "left")
    return found.filter(F.when(F.col("_found"), True).otherwise(F.raise_error(F.lit(f"note {note_id!r} not found")).cast("boolean"))).select(*notes.columns)


def note_tool(notes: DataFrame) -> Tool:
    """create, update and delete return all notes as they are then; the others what they find."""
    none = notes.limit(0)

    def made(title="", content="", note_type=None, tags=(), now="1970-01-01 00:00:00", **_):
        if not (title and content):
            raise ValueError("a note needs a title and content")
        row = notes.sparkSession.createDataFrame([(title, content, note_type, list(tags), now)], "title string, content string, type string, tags array<string>, t string")
        return N.create(notes, row.withColumn("created_at", F.to_timestamp("t")).drop("t"))

    def changed(note_id, title="", content="", note_type="", tags=(), now="1970-01-01 00:00:00", **_):
        row = notes.sparkSession.createDataFrame([(note_id, title, note_type, content, list(tags), now)], "id string, title string, type string, content string, tags array<string>, t string")
        return N.update(notes, row.withColumn("updated_at", F.to_timestamp("t")).drop("t"))

    actions = {
        "create": made,
        "read": lambda note_id, **_: existing(notes, note_id),
        "update": changed,
        "delete": lambda note_id, **_: notes.filter(F.col("id") != note_id),
        "search": lambda query="", note_type=None, tags=(), limit=20, **_: N.search(notes, query, note_type, tags, limit) if query else none,
        "list": lambda note_type=None, tags=(), limit=20, **_: N.list_notes(notes, note_type, tags, limit),
        "summary": lambda **_: N.summary(notes),
    }
    text = [Parameter(p) for p in ("note_id", "title", "content", "note_type", "query", "now")]
    return action_tool("note", actions, (*text, Parameter("tags", "array"), Parameter("limit", "integer", default=20)), "Notes: create, read, change, delete, find")


def memory_tool(add: Callable[..., DataFrame], search: Callable[..., DataFrame]) -> Tool:
    """add(content, importance) and search(query, limit) of a session's memory; content and query may not be empty."""

    def need(run: Callable[..., DataFrame], name: str) -> Callable[..., DataFrame]:
        def checked(**args):
            if not args.get(name):
                raise ValueError(f"{name} is required")
            return run(**args)

        return checked

    actions = {"add": need(lambda content, importance=0.0, **_: add(content, importance), "content"), "search": need(lambda query, limit=10, **_: search(query, limit), "query")}
    return action_tool("memory", actions, (Parameter("content"), Parameter("query"), Parameter("importance", "number", default=0.0), Parameter("limit", "integer", default=10)), "Memory: add, search")
